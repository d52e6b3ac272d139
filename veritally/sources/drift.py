"""How the columns of many Parquet files differ, from their footers alone."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = "file string, position int, column string, type string"


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files below a folder, wherever Spark can list it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listing = [], files.listFiles(path, True)
    while listing.hasNext():
        place = listing.next().getPath()
        if not place.getName().startswith(("_", ".")):
            found.append(place.toString())
    return sorted(found)


def file_types(spark: SparkSession, folder: str, at_once: int = 16) -> DataFrame:
    """`file`, `position`, `column` and `type` for every column of every file below `folder`. Reads one
    footer per file and no row; `at_once` footers at a time. A file without rows counts like others."""
    files = data_files(spark, folder)

    def footer(file: str) -> list[tuple]:
        return [(file, k, x.name, x.dataType.simpleString()) for k, x in enumerate(spark.read.parquet(file).schema.fields)]

    with ThreadPoolExecutor(at_once) as pool:
        rows = [row for rows in pool.map(footer, files) for row in rows]
    return spark.createDataFrame(rows, TYPES)


def drift(types: DataFrame) -> DataFrame:
    """One row per column of `file_types`: `types` (its different types, sorted), `n_files` that have
    it, `n_without` it, and `conflict`: whether one read of all files would have to choose."""
    n_files = types.agg(F.countDistinct("file").alias("n"))
    per_column = types.groupBy("column").agg(F.array_sort(F.collect_set("type")).alias("types"), F.countDistinct("file").alias("n_files"))
    joined = per_column.join(F.broadcast(n_files))  # one row
    return joined.select("column", "types", "n_files", (F.col("n") - F.col("n_files")).alias("n_without"), (F.size("types") > 1).alias("conflict"))
