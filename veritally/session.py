"""Session helpers: settings, the shared folder, shipping this package to the workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the scoring jobs are tuned for. Shuffle partitions are left to the
# cluster's own setting; AQE merges what is too small and splits what is too large.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Payloads are wide (an image is ~50 KB): bound a batch by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}

# For a session that scans wide payloads (an image is ~50 KB): the default of 4096 rows would hold
# 200 MB of them in every task. Other scans are better off with the default.
WIDE_PAYLOADS = {"spark.sql.parquet.columnarReaderBatchSize": "256"}

_shipped: set[str] = set()
_fallback_dirs: dict[str, str] = {}


def build_session(app_name: str = "veritally", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in `spark.checkpoint.dir`."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _fallback_dirs:
        _fallback_dirs[context.applicationId] = tempfile.mkdtemp(prefix="veritally-")
    return _fallback_dirs[context.applicationId]


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute now and keep the result in the shared folder, where a lost executor leaves it."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="veritally-"), "veritally")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
