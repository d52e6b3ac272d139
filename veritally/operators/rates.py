"""The summary questions: overall rates, and rates per group over a three-table join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.columns import count_true, rate_pct

Keys = str | Sequence[str]


def score_summary(
    scored: DataFrame,
    *,
    flag: str = "pred",
    total: str = "total",
    positive: str = "predicted",
    rate: str = "rate_pct",
) -> DataFrame:
    """One row: rows, rows predicted positive, and their percentage."""
    return (
        scored.agg(F.count(F.lit(1)).alias(total), count_true(F.col(flag)).alias(positive))
        .withColumn(rate, rate_pct(F.col(positive), F.col(total)))
    )


def label_summary(
    labels: DataFrame,
    flag: str,
    *,
    total: str = "total",
    positive: str = "positive",
    negative: str = "negative",
    rate: str = "rate_pct",
    unlabelled: str | None = None,
) -> DataFrame:
    """One row: rows, labelled positive, labelled negative, percentage positive.

    A NULL label counts in the total only; `unlabelled` names a column counting them.
    """
    measures = [
        F.count(F.lit(1)).alias(total),
        count_true(F.col(flag)).alias(positive),
        count_true(~F.col(flag)).alias(negative),
    ]
    if unlabelled:
        measures.append(F.count_if(F.col(flag).isNull()).alias(unlabelled))
    counts = labels.agg(*measures)
    names = [total, positive, negative, rate] + ([unlabelled] if unlabelled else [])
    return counts.withColumn(rate, rate_pct(F.col(positive), F.col(total))).select(*names)


def top_groups(groups: DataFrame, by: str, measure: str, n: int | None = 10, per: Keys = ()) -> DataFrame:
    """The n groups of the highest measure; ties in the order of the group key. With `per`, the n
    highest for each value of these columns: every task keeps n of each before they are merged."""
    order, outer = [F.desc(measure), F.asc_nulls_first(by)], _names(per)
    if not outer:
        ordered = groups.orderBy(*order)
        return ordered if n is None else ordered.limit(n)
    if n is None:
        return groups
    ranked = groups.withColumn("_rank", F.row_number().over(Window.partitionBy(*outer).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def rate_by(
    scored: DataFrame,
    labels: DataFrame,
    attributes: DataFrame,
    by: str,
    *,
    on: Keys = "id",
    scored_on: Keys | None = None,
    flag: str = "pred",
    total: str = "total",
    positive: str = "predicted",
    rate: str = "rate_pct",
    top: int | None = 10,
    count_first: bool = True,
    per: Keys = (),
    copies: str | None = None,
) -> DataFrame:
    """Predicted rate per value of `attributes.by`, over scored JOIN labels JOIN attributes.

    The labels take part as a join side only: they restrict and multiply rows.

    count_first  True: the labels are counted per key, and the attributes of labelled keys are
                 summed up to one weight per key and group; the scored rows then meet these
                 weights in one join and are never grouped by key. The result is that of the
                 plain join for any number of copies of a key, but n copies of each table cost
                 n times, not n**3 times, the work, and a hot key of the scored table meets
                 one row per group, so that Spark may split it.
                 False: the plain join.
    per          columns of all three tables that keep several questions apart in one plan (a scale
                 factor, a day): rows meet within them only, and `top` holds for each value.
                 They lead the result.
    copies       a column of all three tables: how many times a row is there (see `weigh_each`).
    """
    outer, inner = _names(per), _names(on)
    keys = inner + outer
    counted = [F.col(copies).alias("_copies")] if copies else []
    scored = scored.select(
        *[F.col(c).alias(k) for c, k in zip(_names(scored_on or on) + outer, keys, strict=True)],
        F.col(flag).alias("_flag"), *counted,
    )
    labels = labels.select(*keys, *counted)
    attributes = attributes.select(*keys, F.col(by).alias("_by"), *counted)
    if count_first:
        groups = _sums_of_counts(scored, labels, attributes, keys, ["_by"], outer, bool(copies))
    elif copies:
        raise ValueError("rows that stand for several are counted first")
    else:
        groups = _sums_of_rows(scored, labels, attributes, keys, outer)
    groups = groups.select(
        *outer,
        F.col("_by").alias(by),
        F.col("_total").alias(total),
        F.col("_positive").alias(positive),
        rate_pct(F.col("_positive"), F.col("_total")).alias(rate),
    )
    return top_groups(groups, by, rate, top, outer)


def rates_by_all(
    scored: DataFrame,
    labels: DataFrame,
    attributes: DataFrame,
    by: Sequence[str],
    *,
    on: Keys = "id",
    scored_on: Keys | None = None,
    flag: str = "pred",
    total: str = "total",
    positive: str = "predicted",
    rate: str = "rate_pct",
    top: int | None = 10,
) -> DataFrame:
    """`rate_by` for several attributes at once: one join, then one aggregation over the grouping sets
    (by[0]), (by[1]), ... Result: `attribute` (its name), `value` (as text) and the measures, the
    `top` values of each attribute."""
    if not by or len(set(by)) < len(by):
        raise ValueError("by: different attributes, one at least")
    keys = _names(on)
    scored = scored.select(*[F.col(c).alias(k) for c, k in zip(_names(scored_on or on), keys, strict=True)], F.col(flag).alias("_flag"))
    sets = [f"_by_{k}" for k in range(len(by))]
    named = attributes.select(*keys, *[F.col(c).cast("string").alias(s) for c, s in zip(by, sets)])
    met = _met(scored, labels.select(*keys), named, keys, sets, False)
    groups = met.groupingSets([[F.col(s)] for s in sets], *[F.col(s) for s in sets]).agg(
        *_sums(), *[F.grouping(s).alias(f"_out{s}") for s in sets]
    )
    # Of each row one set column is in; a NULL there is a group of its own.
    which = F.coalesce(*[F.when(F.col(f"_out{s}") == 0, F.lit(c)) for c, s in zip(by, sets)])
    value = F.coalesce(*[F.when(F.col(f"_out{s}") == 0, F.col(s)) for s in sets])
    groups = _checked(groups).select(
        which.alias("attribute"), value.alias("value"), F.col("_total").alias(total), F.col("_positive").alias(positive),
        rate_pct(F.col("_positive"), F.col("_total")).alias(rate),
    )
    return top_groups(groups, "value", rate, top, "attribute")


def _names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _sums_of_rows(scored: DataFrame, labels: DataFrame, attributes: DataFrame, keys: list[str], outer: list[str]) -> DataFrame:
    joined = scored.join(labels, keys).join(attributes, keys)
    return joined.groupBy(*outer, "_by").agg(
        F.count(F.lit(1)).alias("_total"), count_true(F.col("_flag")).alias("_positive")
    )


def _met(scored: DataFrame, labels: DataFrame, attributes: DataFrame, keys: list[str], by: list[str], weighted: bool) -> DataFrame:
    """Scored rows with their weight: the label rows times the attribute rows of their key and group."""
    times = F.col("_copies") if weighted else F.lit(1)
    per_label = labels.groupBy(*keys).agg(F.sum(times).cast("long").alias("_labels"))
    # Joined before they are grouped: only attributes of labelled keys are.
    weights = attributes.join(per_label, keys).groupBy(*keys, *by).agg(F.sum(F.col("_labels") * times).alias("_weight"))
    met = scored.join(weights, keys)
    return met.withColumn("_weight", F.col("_weight") * F.col("_copies")) if weighted else met


def _sums() -> list[Column]:
    return [
        F.sum("_weight").alias("_total"),
        F.sum(F.when(F.col("_flag"), F.col("_weight")).otherwise(F.lit(0).cast("long"))).alias("_positive"),
        F.sum(F.col("_weight").cast("double")).alias("_size"),
    ]


def _checked(sums: DataFrame) -> DataFrame:
    """Sums of weights outgrow BIGINT sooner than any join could; outside ANSI mode they would wrap."""
    fits = F.when(F.col("_size") < 2.0**63, F.col("_total")).otherwise(F.raise_error(F.lit("count beyond BIGINT")))
    return sums.withColumn("_total", fits)


def _sums_of_counts(
    scored: DataFrame, labels: DataFrame, attributes: DataFrame, keys: list[str], by: list[str], outer: list[str], weighted: bool
) -> DataFrame:
    met = _met(scored, labels, attributes, keys, by, weighted)
    return _checked(met.groupBy(*outer, *by).agg(*_sums()))
