"""Replicated tables and the family of scales built from them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The scale factors.
FACTORS = (1, 5, 10, 20, 50, 100)


def replicate(df: DataFrame, copies: int, tag: str | None = "dup_batch") -> DataFrame:
    """`copies` copies of every row, told apart by `tag` (0 to copies - 1), or by nothing.

    One scan whatever the number of copies; rows multiply in place, without a shuffle.
    Score before replicating: copies then share one model call.
    """
    if copies < 1:
        raise ValueError("copies must be at least 1")
    name = tag or "_copy"
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    numbered = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(name))
    return numbered if tag else numbered.drop(name)


def replicate_each(
    df: DataFrame, factors: Iterable[int] = FACTORS, scale: str = "factor", tag: str = "dup_batch"
) -> DataFrame:
    """The whole family of scales in one table and one scan: for every factor, that many
    copies of every row."""
    per_factor = df.select("*", F.explode(F.array(*[F.lit(f) for f in factors])).alias(scale))
    return per_factor.select("*", F.explode(F.sequence(F.lit(0), F.col(scale) - 1)).alias(tag))


def weigh_each(
    df: DataFrame, factors: Iterable[int] = FACTORS, scale: str = "factor", copies: str = "copies"
) -> DataFrame:
    """The same family with its copies counted instead of made: for every factor one row, with the
    number of times it is there. `rate_by(..., per=scale, copies=copies)` takes such tables."""
    per_factor = df.select("*", F.explode(F.array(*[F.lit(f) for f in factors])).alias(scale))
    return per_factor.withColumn(copies, F.col(scale).cast("long"))


def union_by_name(tables: Iterable[DataFrame]) -> DataFrame:
    """Bag union of tables with the same columns in any order."""
    first, *others = tables
    for other in others:
        first = first.unionByName(other)
    return first


def scale_name(factor: int) -> str:
    return "original" if factor == 1 else f"{factor}x"


def scale_family(
    tables: Mapping[str, DataFrame], factors: Iterable[int] = FACTORS, *, views: bool = False
) -> dict[str, DataFrame]:
    """Every table at every factor, by `table_scale`; also as temporary views on request."""
    family = {
        f"{name}_{scale_name(factor)}": replicate(df, factor)
        for factor in factors
        for name, df in tables.items()
    }
    if views:
        for name, df in family.items():
            df.createOrReplaceTempView(name)
    return family
