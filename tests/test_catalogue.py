"""Every registered query against its oracle, and against values known beforehand."""

import math
from pathlib import Path

import duckdb
import pytest
from frames import plan, rows

import __spark_entry__ as contract
from veritally.plans import catalogue

DATA = Path("/root/testdata")
SMALL = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="test tables are not there")

ORACLE = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def canonical(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in records]
    return sorted((tuple(r[i] for i in order) for r in plain), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    result = QUERIES[name](spark, str(SMALL))
    expected = duck.sql(ORACLE[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert canonical(rows(result), result.columns) == canonical(expected.fetchall(), expected.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 10


def test_known_values_at_a_hundredth(spark):
    sf_dir = str(DATA / "sf0.01")
    assert rows(QUERIES["score_summary"](spark, sf_dir)) == [(1000, 44, 4.4)]
    assert rows(QUERIES["label_summary"](spark, sf_dir)) == [(399, 51, 348, 12.781954887218046, 0)]
    assert rows(QUERIES["rate_by_lang"](spark, sf_dir)) == [
        ("es", 39, 2, 5.128205128205129),
        ("de", 46, 2, 4.3478260869565215),
        ("en", 262, 8, 3.053435114503817),
        ("fr", 52, 0, 0.0),
    ]
    assert [(s, n, p) for s, n, p, _ in rows(QUERIES["rate_by_source"](spark, sf_dir))] == [
        ("src2", 22, 2), ("src0", 13, 1), ("src16", 15, 1), ("src12", 16, 1), ("src14", 17, 1),
        ("src10", 19, 1), ("src19", 19, 1), ("src7", 20, 1), ("src15", 21, 1), ("src13", 22, 1),
    ]
    assert sorted((g, n, p) for g, n, p, _ in rows(QUERIES["rate_scaled_faithful"](spark, sf_dir))) == [
        ("de", 1242, 54), ("en", 7074, 216), ("es", 1053, 54), ("fr", 1404, 0),
    ]
    assert {g: n for g, n, _, _ in rows(QUERIES["rate_scaled_aligned"](spark, sf_dir))} == {
        "de": 138, "en": 786, "es": 117, "fr": 156,
    }
    assert QUERIES["linear_score"](spark, sf_dir).where("pred").count() == 240


@pytest.mark.parametrize("name", ["rate_by_source", "linear_rate_by_label", "sql_rate_by_source"])
def test_large_joins_move_keys_and_counts_only(spark, no_broadcast, name):
    """Without broadcasts: sort-merge joins, scoring below them, payloads in no key shuffle."""
    text = plan(QUERIES[name](spark, str(SMALL)))
    assert text.count("SortMergeJoin") == 2 and "TakeOrderedAndProject" in text
    assert "Cartesian" not in text and "NestedLoop" not in text
    above = text[: text.index("SortMergeJoin")]
    assert "text" not in above and "embedding" not in above and "Python" not in above


def test_queries_without_a_model_stay_in_the_jvm(spark):
    modelled = {"linear_score", "linear_rate_by_label", "sql_linear_summary", "linear_file_score", "score_errors", "missing_model"}
    for name in set(QUERIES) - modelled:
        assert "Python" not in plan(QUERIES[name](spark, str(SMALL))), name


def test_summaries_read_one_column_once(spark):
    for name in ("score_summary", "score_summary_scales"):
        text = plan(QUERIES[name](spark, str(SMALL)))
        assert text.count("FileScan") == 1 and "ReadSchema: struct<text:string>" in text


def test_all_scales_read_each_table_once(spark):
    text = plan(QUERIES["rate_scales_by_lang"](spark, str(SMALL)))
    assert text.count("FileScan") == 3 and text.count("octet_length(text") <= 4


def test_both_group_questions_share_their_scans(spark):
    assert plan(QUERIES["rates_by_all"](spark, str(SMALL))).count("FileScan") == 3
