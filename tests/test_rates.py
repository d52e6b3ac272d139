import random

import pandas as pd
import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from veritally import label_summary, rate_by, rates_by_all, replicate, score_summary, top_groups, weigh_each
from veritally.operators.replicate import replicate_each


def by_ethnicity(tables, **options):
    return rate_by(*tables, "ethnicity", on="id", scored_on="name", **options)


@pytest.mark.parametrize("count_first", [True, False])
def test_groups_of_the_three_row_fixture(tables, count_first):
    assert rows(by_ethnicity(tables, count_first=count_first)) == [
        ("E2", 1, 1, 100.0),
        (None, 1, 0, 0.0),
        ("E1", 1, 0, 0.0),
    ]


@pytest.mark.parametrize("count_first", [True, False])
def test_copies_in_all_three_tables_multiply(tables, count_first):
    result = by_ethnicity([replicate(t, 3) for t in tables], count_first=count_first)
    assert rows(result) == [("E2", 27, 27, 100.0), (None, 27, 0, 0.0), ("E1", 27, 0, 0.0)]


def test_aligned_copies_do_not_multiply(tables):
    scored, labels, attributes = [replicate(t, 3) for t in tables]
    result = rate_by(
        scored, labels, attributes, "is_veteran", on=["id", "dup_batch"], scored_on=["name", "dup_batch"]
    )
    assert rows(result) == [("no", 6, 3, 50.0), ("yes", 3, 0, 0.0)]


@pytest.mark.parametrize("factor", [1, 2, 3])
@pytest.mark.parametrize("by", ["ethnicity", "is_veteran"])
def test_counting_first_equals_the_plain_join(tables, factor, by):
    copies = [replicate(t, factor) for t in tables]
    first, plain = (
        rows(rate_by(*copies, by, on="id", scored_on="name", count_first=flag)) for flag in (True, False)
    )
    assert first == plain
    assert sum(total for _, total, _, _ in first) == 3 * factor**3


def test_rates_do_not_change_with_the_factor(tables):
    base = rows(by_ethnicity(tables))
    scaled = rows(by_ethnicity([replicate(t, 5) for t in tables]))
    assert [(g, r) for g, _, _, r in base] == [(g, r) for g, _, _, r in scaled]


@pytest.mark.parametrize("count_first", [True, False])
def test_null_keys_never_match(spark, count_first):
    scored = spark.createDataFrame([("a", True), (None, True)], "id string, pred boolean")
    labels = spark.createDataFrame([("a",), (None,)], "id string")
    attributes = spark.createDataFrame([("a", "x"), (None, "y")], "id string, g string")
    assert rows(rate_by(scored, labels, attributes, "g", count_first=count_first)) == [("x", 1, 1, 100.0)]


def test_a_hot_key_and_uneven_copies(spark, no_broadcast):
    """One key holds a third of the payload rows, in several groups; against brute force."""
    scored = [(0, i % 3 == 0) for i in range(200)] + [(i, i % 5 == 0) for i in range(1, 401)]
    labels = [(0,)] * 7 + [(i,) for i in range(1, 401, 2)]
    attributes = [(0, f"g{i % 4}") for i in range(50)] + [(i, f"g{i % 6}") for i in range(1, 401)]
    expected = (
        pd.DataFrame(scored, columns=["id", "pred"])
        .merge(pd.DataFrame(labels, columns=["id"]), on="id")
        .merge(pd.DataFrame(attributes, columns=["id", "g"]), on="id")
        .groupby("g")["pred"]
        .agg(["size", "sum"])
    )
    result = rate_by(
        spark.createDataFrame(scored, "id int, pred boolean"),
        spark.createDataFrame(labels, "id int"),
        spark.createDataFrame(attributes, "id int, g string"),
        "g",
        top=None,
    )
    assert {g: (total, hits) for g, total, hits, _ in rows(result)} == {
        g: (row["size"], row["sum"]) for g, row in expected.iterrows()
    }


def test_ties_at_the_cut_go_by_group_key(spark):
    groups = spark.createDataFrame([(f"g{i:02}", 1.0 if i < 3 else 0.5) for i in range(20)], "g string, r double")
    assert [g for g, _ in rows(top_groups(groups, "g", "r"))] == [f"g{i:02}" for i in range(10)]
    assert len(rows(top_groups(groups, "g", "r", None))) == 20


def test_a_null_label_counts_in_the_total_only(tables):
    summary = label_summary(tables[1], "isfraud", unlabelled="unlabelled")
    assert rows(summary) == [(3, 1, 1, pytest.approx(100 / 3), 1)]
    assert rows(label_summary(replicate(tables[1], 3), "isfraud")) == [(9, 3, 3, pytest.approx(100 / 3))]


def test_empty_tables_give_null_rates(tables):
    scored, labels, attributes = [t.limit(0) for t in tables]
    assert rows(score_summary(scored)) == [(0, None, None)]
    assert rows(label_summary(labels, "isfraud")) == [(0, None, None, None)]
    assert rows(by_ethnicity((scored, labels, attributes))) == []


def test_result_types(tables):
    assert by_ethnicity(tables).dtypes == [
        ("ethnicity", "string"), ("total", "bigint"), ("predicted", "bigint"), ("rate_pct", "double"),
    ]
    assert score_summary(tables[0]).dtypes == [("total", "bigint"), ("predicted", "bigint"), ("rate_pct", "double")]


def test_column_names_are_the_callers(tables):
    result = by_ethnicity(tables, total="n", positive="hits", rate="share")
    assert result.columns == ["ethnicity", "n", "hits", "share"]


def test_grouping_may_use_the_join_key(spark):
    table = spark.createDataFrame([(1, True), (2, False)], "id int, pred boolean")
    assert rows(rate_by(table, table, table, "id")) == [(1, 1, 1, 100.0), (2, 1, 0, 0.0)]


def test_score_after_join_equals_score_first(spark, tables):
    """Scoring the joined rows, the expensive order, gives the same groups."""
    _, labels, attributes = tables
    images = spark.createDataFrame([("a", "xx"), ("b", "yyyy"), ("c", None)], "name string, payload string")
    for factor in (1, 2, 3):
        img, lbl, meta = (replicate(t, factor, tag=None) for t in (images, labels, attributes))
        joined = img.join(lbl, img.name == lbl.id).join(meta, "id")
        late = joined.groupBy("ethnicity").agg(
            F.count("*").alias("total"), F.sum(F.when(F.length("payload") > 2, 1).otherwise(0)).alias("hits")
        )
        first = img.select("name", F.coalesce(F.length("payload") > 2, F.lit(False)).alias("pred"))
        early = rate_by(first, lbl, meta, "ethnicity", on="id", scored_on="name", top=None)
        assert sorted(map(str, rows(late))) == sorted(map(str, rows(early.drop("rate_pct"))))


def test_random_tables_against_nested_loops(spark):
    """Many-to-many keys, NULL keys, NULL groups and NULL flags."""
    rng = random.Random(7)
    keys = [None, 0, 1, 2, 3]
    for _ in range(6):
        scored = [(rng.choice(keys), rng.choice([True, False, None])) for _ in range(rng.randint(0, 12))]
        labels = [(rng.choice(keys),) for _ in range(rng.randint(0, 8))]
        attributes = [(rng.choice(keys), rng.choice(["x", "y", None])) for _ in range(rng.randint(0, 8))]
        groups = {}
        for key, flag in scored:
            for (label_key,) in labels:
                for attribute_key, group in attributes:
                    if key is not None and key == label_key == attribute_key:
                        total, hits = groups.get(group, (0, 0))
                        groups[group] = (total + 1, hits + (flag is True))
        result = rate_by(
            spark.createDataFrame(scored, "id int, pred boolean"),
            spark.createDataFrame(labels, "id int"),
            spark.createDataFrame(attributes, "id int, g string"),
            "g",
        )
        assert {g: (total, hits) for g, total, hits, _ in rows(result)} == groups


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_count_beyond_bigint_is_an_error(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        table = spark.range(3_000_000).select(F.lit(1).alias("id"), F.lit(True).alias("pred"), F.lit("g").alias("g"))
        with pytest.raises(Exception, match="OVERFLOW|beyond BIGINT"):
            rate_by(table, table, table, "g").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


FAMILY = (1, 2, 5)


def scales_one_by_one(tables, by, top):
    found = []
    for factor in FAMILY:
        copies = [replicate(t, factor) for t in tables]
        found += [(factor, *r) for r in rows(rate_by(*copies, by, on="id", scored_on="name", top=top))]
    return sorted(found, key=str)


@pytest.mark.parametrize("top", [None, 1, 2])
def test_all_scales_in_one_plan(tables, top):
    options = {"on": "id", "scored_on": "name", "per": "factor", "top": top}
    expected = scales_one_by_one(tables, "ethnicity", top)
    weighed = rate_by(*[weigh_each(t, FAMILY) for t in tables], "ethnicity", copies="copies", **options)
    assert sorted(rows(weighed), key=str) == expected
    made = rate_by(*[replicate_each(t, FAMILY) for t in tables], "ethnicity", **options)
    assert sorted(rows(made), key=str) == expected
    plain = rate_by(*[replicate_each(t, FAMILY) for t in tables], "ethnicity", count_first=False, **options)
    assert sorted(rows(plain), key=str) == expected


def test_scales_keep_ten_groups_per_task_before_the_exchange(tables):
    text = plan(rate_by(*[weigh_each(t, FAMILY) for t in tables], "ethnicity", scored_on="name", per="factor", copies="copies", top=2))
    assert text.count("WindowGroupLimit") == 2


def test_copies_want_counting_first(tables):
    with pytest.raises(ValueError, match="counted first"):
        rate_by(*[weigh_each(t, FAMILY) for t in tables], "ethnicity", scored_on="name", copies="copies", count_first=False)


@pytest.mark.parametrize("top", [None, 1, 10])
def test_several_attributes_from_one_join(spark, tables, top):
    scored, labels, attributes = (replicate(t, 2, tag=None) for t in tables)
    attributes = attributes.union(spark.createDataFrame([("b", None, None), ("a", "E3", None)], attributes.schema))
    both = rates_by_all(scored, labels, attributes, ["ethnicity", "is_veteran"], scored_on="name", top=top)
    expected = []
    for by in ("ethnicity", "is_veteran"):
        expected += [(by, *r) for r in rows(rate_by(scored, labels, attributes, by, scored_on="name", top=top))]
    assert both.columns == ["attribute", "value", "total", "predicted", "rate_pct"]
    assert sorted(rows(both), key=str) == sorted(expected, key=str)


def test_several_attributes_cost_one_join(tables, no_broadcast):
    text = plan(rates_by_all(*tables, ["ethnicity", "is_veteran"], scored_on="name"))
    assert text.count("SortMergeJoin") == 2 and text.count("Expand") == 1


def test_attributes_are_named_once(tables):
    for by in ([], ["ethnicity", "ethnicity"]):
        with pytest.raises(ValueError, match="different"):
            rates_by_all(*tables, by, scored_on="name")
