"""Failed rows set apart while everything is scored, once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FAILED = "failed"


@dataclass(frozen=True)
class Quarantined:
    """What was scored, what was not and why, and how many rows of each kind there are."""

    scored: DataFrame
    failed: DataFrame
    n_rows: int
    n_failed: int
    n_positive: int


def quarantine(rows: DataFrame, folder: str, *, error: str = "score_error", flag: str = "pred") -> Quarantined:
    """Write the result of `score` below `folder`, sound and failed rows apart, and count both in the
    same pass: the payloads are read and the model is asked once, whatever is done with either side
    afterwards. `folder` must be new, and one that every executor can reach."""
    if _FAILED in rows.columns:
        raise ValueError(f"column {_FAILED} exists already")
    counts = Observation()
    counted = rows.observe(
        counts, F.count(F.lit(1)).alias("n"), F.count_if(F.col(error).isNotNull()).alias("n_failed"), F.count_if(F.col(flag)).alias("n_positive")
    )
    counted.withColumn(_FAILED, F.col(error).isNotNull()).write.partitionBy(_FAILED).parquet(folder)
    # With the schema given, a side without rows is an empty table and not a missing folder.
    schema = T.StructType([*rows.schema.fields, T.StructField(_FAILED, T.BooleanType())])
    written = rows.sparkSession.read.schema(schema).parquet(folder)
    found = counts.get
    return Quarantined(
        written.where(~F.col(_FAILED)).drop(_FAILED), written.where(_FAILED).drop(_FAILED), found["n"], found["n_failed"], found["n_positive"]
    )
