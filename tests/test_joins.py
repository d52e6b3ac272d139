import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from veritally import score
from veritally.operators.joins import bloom_filter, may_have_key, restrict_to_keys


@pytest.fixture
def wide(spark):
    return spark.range(2000).select("id", F.repeat(F.lit("x"), 50).alias("payload")).repartition(3)


@pytest.fixture
def keys(spark):
    return spark.range(0, 2000, 40).select("id").union(spark.createDataFrame([(7,), (7,), (None,)], "id long"))


def wanted(keys):
    return sorted({r["id"] for r in keys.collect()} - {None})


@pytest.mark.parametrize("words", [0, 1, 2, 64, 1 << 12, 1 << 20])
def test_same_rows_at_any_filter_size(wide, keys, words):
    assert sorted(r["id"] for r in restrict_to_keys(wide, keys, words=words).collect()) == wanted(keys)


def test_the_filter_has_a_fixed_size_and_passes_few_others(spark, wide, keys):
    bits = bloom_filter(keys, 256)
    assert bits.count() <= 51 and bloom_filter(wide.select("id"), 16).count() == 16
    passing = [r["id"] for r in may_have_key(wide, ["id"], bits, 256).select("id").collect()]
    assert set(wanted(keys)) <= set(passing) and len(passing) < 2000 / 10
    full = bloom_filter(spark.range(100000).select("id"), 16)
    assert may_have_key(wide, ["id"], full, 16).count() == 2000


def test_rows_that_the_filter_drops_are_not_exchanged(spark, wide, keys, no_broadcast):
    """The join of the payload side: scan, filter by the broadcast words, and only then an exchange."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = plan(restrict_to_keys(wide, keys))
    semi = text.index("SortMergeJoin")
    assert "LeftSemi" in text[semi : text.index("\n", semi)]
    payload_side = text[semi:]
    assert payload_side.index("Exchange hashpartitioning(id") < payload_side.index("BroadcastHashJoin")
    bits = bloom_filter(keys)
    passing = may_have_key(wide, ["id"], bits).mapInArrow(count, "id long, payload string")
    assert sorted(r["id"] for r in passing.join(keys, "id", "left_semi").collect()) == wanted(keys)
    assert len(wanted(keys)) <= seen.value < 200


def test_few_keys_are_broadcast_without_a_filter(spark, wide):
    text = plan(restrict_to_keys(wide, spark.range(0, 2000, 40)))
    assert text.count("BroadcastHashJoin") == 1 and "bit_or" not in text


def test_keys_of_several_columns_and_odd_names(spark):
    df = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (None, "a", "r"), (2, None, "s")], "`k.1` long, k2 string, payload string")
    keys = spark.createDataFrame([(1, "b"), (2, None), (None, "a")], "`k.1` long, k2 string")
    assert rows(may_have_key(df, ["k.1", "k2"], bloom_filter(keys, 1 << 10), 1 << 10)) == [(1, "b", "q")]


def test_no_keys_and_no_rows(wide, keys):
    assert restrict_to_keys(wide, keys.limit(0), words=64).count() == 0
    assert restrict_to_keys(wide.limit(0), keys, words=64).count() == 0


def test_a_filter_of_an_odd_size_is_refused(keys):
    for words in (-1, 3, 1 << 23):
        with pytest.raises(ValueError, match="power of two"):
            bloom_filter(keys, words)


def test_scores_are_those_of_the_exact_join(spark, wide, keys):
    with_filter, without = (score(wide, "payload", "lines", only_keys=keys, filter_words=w) for w in (128, 0))
    assert sorted(rows(with_filter)) == sorted(rows(without)) and with_filter.count() == len(wanted(keys))
