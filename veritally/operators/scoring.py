"""Scorers, and the `score` operator that turns a payload column into a score column.

`score` drops the payload, so whatever follows (joins, grouping, replication) moves only
keys and flags. Queries take a scored table and never call a model themselves: the number
of model calls is the number of payload rows, whatever the joins multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.functions import batches
from veritally.functions.columns import PAYLOAD_BYTES_SQL, payload_bytes
from veritally.operators.joins import restrict_to_keys
from veritally.session import ship_package

RESULT = "score double, error string"


@dataclass(frozen=True)
class SqlScorer:
    """A score that SQL can express; `{x}` stands for the payload. Runs in the JVM."""

    name: str
    version: str
    score_sql: str
    input_type: str
    threshold: float = 0.0


@dataclass(frozen=True)
class ModelScorer:
    """A score computed by a model on batches of rows.

    load           gives the model; called on the driver, once per name and version, and broadcast
    decode         a list of payloads to one array with a row for each; if it raises, the payloads
                   are tried one by one, and what one raises is that row's error
    forward        (model, array) to one score per row
    rows_per_pass  rows of one forward pass
    arrow          `decode` takes an Arrow array as Spark sends it instead of a list, so that no row
                   becomes a Python object
    """

    name: str
    version: str
    load: Callable[[], Any]
    decode: Callable[[list | pa.Array], np.ndarray]
    forward: Callable[[Any, np.ndarray], np.ndarray]
    threshold: float = 0.0
    rows_per_pass: int = 256
    base64_text: bool = False
    arrow: bool = False


Scorer = SqlScorer | ModelScorer

# --- the built-in scorers -------------------------------------------------------------

LINES = SqlScorer(
    name="lines",
    version="1",
    # A newline is one byte, and byte lengths need no pass over the text.
    score_sql="CAST(120 * (octet_length({x}) - octet_length(replace({x}, chr(10), ''))) - length({x}) AS DOUBLE)",
    input_type="STRING",
)

VECTOR_LENGTH = 64


def _linear_weights() -> np.ndarray:
    return ((np.arange(VECTOR_LENGTH) * 7) % 11 - 5).astype(np.float64)


def _vectors(lists: pa.Array) -> np.ndarray:
    """A matrix over the values as they lie in the batch; an element that is missing is no number."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (wrong := lengths[lengths != VECTOR_LENGTH]).size:
        raise ValueError(f"expected {VECTOR_LENGTH} values, found shape ({wrong[0]},)")
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(-1, VECTOR_LENGTH)


def _dot(weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return vectors @ weights


LINEAR = ModelScorer("linear", "1", load=_linear_weights, decode=_vectors, forward=_dot, rows_per_pass=4096, arrow=True)


def linear_file_scorer(spark: SparkSession, path: str, *, name: str = "linear_file", version: str = "1") -> ModelScorer:
    """The linear model with weights from a Parquet table of `position` and `weight`, wherever
    Spark can read it. The model has VECTOR_LENGTH weights, whatever the data."""

    def load() -> np.ndarray:
        rows = spark.read.parquet(path).orderBy("position").limit(VECTOR_LENGTH + 1).collect()
        if [r["position"] for r in rows] != list(range(VECTOR_LENGTH)):
            raise ValueError(f"{path} does not hold the weights of {VECTOR_LENGTH} positions")
        return np.array([r["weight"] for r in rows], dtype=np.float64)

    return ModelScorer(name, version, load=load, decode=_vectors, forward=_dot, rows_per_pass=4096, arrow=True)


_SCORERS: dict[str, Scorer] = {}


def register_scorer(scorer: Scorer) -> Scorer:
    """Make a scorer available by name."""
    _SCORERS[scorer.name] = scorer
    return scorer


def get_scorer(scorer: str | Scorer) -> Scorer:
    if not isinstance(scorer, str):
        return scorer
    if scorer not in _SCORERS:
        raise KeyError(f"no scorer named {scorer!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[scorer]


for _scorer in (LINES, LINEAR):
    register_scorer(_scorer)

# --- model distribution ---------------------------------------------------------------

_handles: dict[tuple[str, str, str], Broadcast] = {}


def _model_handle(spark: SparkSession, scorer: ModelScorer) -> Broadcast:
    """The broadcast model; one per application, scorer name and version, whatever its size."""
    key = (spark.sparkContext.applicationId, scorer.name, scorer.version)
    if key not in _handles:
        _handles[key] = spark.sparkContext.broadcast(scorer.load())
    return _handles[key]


def release_models() -> None:
    """Drop the broadcast models of this process; the next use loads them again."""
    for handle in _handles.values():
        handle.unpersist()
    _handles.clear()


def _batch_function(spark: SparkSession, scorer: ModelScorer, on_missing_model: str):
    """Batches of payloads to batches of (score, error), as it runs on a worker.

    Without a model, the default is to fail here, on the driver.
    """
    if on_missing_model not in ("fail", "false"):
        raise ValueError("on_missing_model is 'fail' or 'false'")
    ship_package(spark)
    try:
        handle = _model_handle(spark, scorer)
    except Exception:
        if on_missing_model == "fail":
            raise
        return lambda arrays: map(batches.unscored_batch, arrays)

    decode = scorer.decode if scorer.arrow else _of_list(scorer.decode)
    forward, rows = scorer.forward, scorer.rows_per_pass

    def scored(arrays):
        model = handle.value
        for payloads in arrays:
            yield batches.score_batch(payloads, model, decode, forward, rows)

    return scored


def _of_list(decode: Callable[[list], np.ndarray]) -> Callable[[pa.Array], np.ndarray]:
    return lambda values: decode(values.to_pylist())


def model_udf(spark: SparkSession, scorer: ModelScorer, on_missing_model: str = "fail"):
    """Batch UDF payload -> struct<score, error>, Arrow arrays in and out."""
    scored = _batch_function(spark, scorer, on_missing_model)

    @F.arrow_udf(RESULT)
    def score_and_error(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scored(arrays)

    return score_and_error


# --- the operator ---------------------------------------------------------------------


def score(
    df: DataFrame,
    payload: str,
    scorer: str | Scorer = "lines",
    *,
    keep: Sequence[str] | None = None,
    threshold: float | None = None,
    on_missing_model: str = "fail",
    only_keys: DataFrame | None = None,
    filter_words: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Score every row once: `keep` columns (default: all but the payload) plus
    `score` (double), `pred` (score strictly above the threshold, never NULL) and
    `score_error` (why there is no score).

    only_keys     rows whose key is absent from this table are left out before scoring; with many
                  keys a Bloom filter keeps their payloads out of the exchange (`restrict_to_keys`)
    filter_words  the size of that filter, None to let Spark's estimate decide
    partitions    spread the rows over this many partitions first; see `partitions_for`
    """
    scorer = get_scorer(scorer)
    keep = [c for c in df.columns if c != payload] if keep is None else list(keep)
    if clash := {"score", "pred", "score_error"}.intersection(keep):
        raise ValueError(f"columns {sorted(clash)} would be there twice; name others in `keep`")
    df = df.select(*keep, F.col(payload).alias("_payload"))
    if only_keys is not None:
        df = restrict_to_keys(df, only_keys, words=filter_words)

    if isinstance(scorer, SqlScorer):
        result = _sql_result(scorer)
    else:
        is_text = isinstance(df.schema["_payload"].dataType, T.StringType)
        if scorer.base64_text and is_text:
            df = df.withColumn("_payload", payload_bytes("_payload"))
        if partitions:
            df = df.repartition(partitions)
        result = model_udf(df.sparkSession, scorer, on_missing_model)(F.col("_payload"))

    cut = scorer.threshold if threshold is None else threshold
    return df.select(*keep, result.alias("_result")).select(
        *keep,
        F.col("_result.score").alias("score"),
        F.coalesce(F.col("_result.score") > F.lit(float(cut)), F.lit(False)).alias("pred"),
        F.col("_result.error").alias("score_error"),
    )


def _sql_result(scorer: SqlScorer) -> Column:
    raw = F.expr(scorer.score_sql.format(x="_payload")).cast("double")
    value = F.when(F.abs(raw) < F.lit(float("inf")), raw)  # neither NaN nor infinite
    reason = F.when(F.col("_payload").isNull(), F.lit(batches.NO_PAYLOAD)).otherwise(F.lit(batches.NO_SCORE))
    # Asking for the score first lets the generated code share its evaluation with the other columns.
    error = F.when(value.isNull(), reason)
    return F.struct(value.alias("score"), error.alias("error"))


def partitions_for(scan: DataFrame) -> int | None:
    """How far to spread the rows of a file scan before a model scores them, or None.

    Model time, not bytes, is the load, so a scan of fewer splits than there are cores is
    spread over all of them; what moves is then at most one split per core. A larger scan is
    left alone. `scan` must be a plain scan: its splits are counted without running it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return 2 * cores if scan.rdd.getNumPartitions() < cores else None


# --- SQL surface ----------------------------------------------------------------------


def register_sql(
    spark: SparkSession,
    name: str,
    scorer: str | Scorer = "lines",
    *,
    threshold: float | None = None,
    on_missing_model: str = "fail",
) -> None:
    """Make `name(payload)` callable from SQL: a boolean, false where there is no score."""
    scorer = get_scorer(scorer)
    cut = float(scorer.threshold if threshold is None else threshold)
    if isinstance(scorer, SqlScorer):
        body = f"CAST({scorer.score_sql.format(x='payload')} AS DOUBLE)"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(payload {scorer.input_type}) RETURNS BOOLEAN "
            f"RETURN coalesce(abs({body}) < double('infinity') AND {body} > {cut!r}D, false)"
        )
        return
    scored = _batch_function(spark, scorer, on_missing_model)

    @F.arrow_udf("boolean")
    def flag(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for result in scored(arrays):
            above = result.field("score").to_numpy(zero_copy_only=False) > cut  # no score is not above
            yield pa.array(above)

    if scorer.base64_text:
        # Decoded in the plan, by the same rule as in `score`.
        spark.udf.register(f"{name}_of_bytes", flag)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(payload STRING) RETURNS BOOLEAN "
            f"RETURN {name}_of_bytes({PAYLOAD_BYTES_SQL.format(x='payload')})"
        )
        return
    spark.udf.register(name, flag)
