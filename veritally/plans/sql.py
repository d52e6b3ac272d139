"""The summary questions as SQL text over any tables, and SQL that calls a scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCORE_SUMMARY = """
SELECT total, predicted, CAST(100.0 * predicted AS DOUBLE) / total AS rate_pct
FROM (SELECT count(*) AS total, sum(if(pred, 1, 0)) AS predicted FROM {scored})
"""

LABEL_SUMMARY = """
SELECT total, positive, negative, CAST(100.0 * positive AS DOUBLE) / total AS rate_pct
FROM (
  SELECT count(*) AS total, sum(if(flag, 1, 0)) AS positive, sum(if(NOT flag, 1, 0)) AS negative
  FROM {labels}
)
"""

RATE_BY = """
WITH marks AS (SELECT id, count(*) AS n FROM {labels} GROUP BY id),
     weights AS (SELECT t.id, t.grp, sum(m.n) AS n FROM {attributes} t JOIN marks m ON t.id = m.id GROUP BY t.id, t.grp),
     sums AS (
       SELECT w.grp, sum(w.n) AS total, sum(if(i.pred, w.n, 0)) AS predicted
       FROM {scored} i JOIN weights w ON i.id = w.id
       GROUP BY w.grp
     )
SELECT grp, total, predicted, CAST(100.0 * predicted AS DOUBLE) / total AS rate_pct
FROM sums
ORDER BY rate_pct DESC, grp NULLS FIRST
LIMIT {top}
"""


def run(spark: SparkSession, text: str, **tables: DataFrame | int) -> DataFrame:
    """Run a query text with its holes filled by DataFrames and values.

    The same text serves every scale: only the tables bound to it change.
    """
    return spark.sql(text, **tables)


def scored_in_sql(table: DataFrame, key: str, payload: str, function: str) -> DataFrame:
    """Score with a function registered by `register_sql`, in its own step below any join."""
    return table.sparkSession.sql(
        f"SELECT `{key}` AS id, {function}(`{payload}`) AS pred FROM {{table}}", table=table
    )
