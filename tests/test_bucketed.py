import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from veritally import BucketedTables, rate_by


@pytest.fixture
def tables(spark):
    made = BucketedTables(spark, "id", 4)
    yield made
    made.drop()


@pytest.fixture
def sources(spark):
    ids = spark.range(300).selectExpr("if(id % 50 = 0, NULL, id % 97) AS id", "id AS n")
    scored = ids.selectExpr("id", "n % 3 = 0 AS pred")
    labels = ids.where("n % 2 = 0").selectExpr("id", "n % 5 = 0 AS flag")
    return scored, labels, ids.selectExpr("id", "concat('g', n % 7) AS g")


def test_questions_join_stored_tables_without_exchange(spark, tables, sources, no_broadcast):
    stored = [tables.save(name, df) for name, df in zip(("scored", "labels", "attributes"), sources)]
    question = rate_by(*stored, "g")
    text = plan(question)
    assert text.count("SortMergeJoin") == 2
    assert "hashpartitioning(id" not in text  # nothing is exchanged by key
    assert text.count("Exchange hashpartitioning") == 1  # the groups
    assert rows(question) == rows(rate_by(*sources, "g"))


def test_buckets_are_one_sorted_file_each(spark, tables, sources):
    stored = tables.save("scored", sources[0])
    assert sorted(map(str, rows(stored))) == sorted(map(str, rows(sources[0])))
    assert len(stored.inputFiles()) <= 4


def test_tables_have_names_of_their_own_and_go(spark, tables, sources):
    tables.save("t", sources[0])
    with pytest.raises(ValueError, match="already"):
        tables.save("t", sources[0])
    other = BucketedTables(spark, "id", 4)
    assert other.save("t", sources[0].limit(0)).count() == 0
    name = other.names["t"]
    other.drop()
    assert not spark.catalog.tableExists(name) and tables.table("t").count() == 300


def test_groups_by_the_key_need_no_exchange_either(spark, tables, sources):
    per_key = tables.save("labels", sources[1]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan(per_key)
