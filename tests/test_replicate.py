import pytest
from frames import plan, rows
from pyspark.sql import functions as F

from veritally import label_summary, register_views, replicate, scale_family, union_by_name
from veritally.operators.replicate import replicate_each


@pytest.fixture
def small(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_replicate_equals_a_union_of_tagged_copies(small, n):
    union = union_by_name([small.withColumn("dup_batch", F.lit(i)) for i in range(n)])
    copies = replicate(small, n)
    assert copies.schema["dup_batch"].dataType.typeName() == "integer"
    assert sorted(map(str, rows(copies))) == sorted(map(str, rows(union)))


def test_replicate_without_tag_keeps_the_schema(small):
    copies = replicate(small, 4, tag=None)
    assert copies.columns == small.columns
    assert copies.count() == 12


def test_one_scan_and_no_shuffle(small):
    text = plan(replicate(small, 100))
    assert text.count("FileScan") == 1
    assert "Exchange" not in text and "Join" not in text and "Cartesian" not in text


def test_bad_arguments(small):
    with pytest.raises(ValueError):
        replicate(small, 0)
    with pytest.raises(ValueError):
        replicate(small.withColumn("dup_batch", F.lit(1)), 2)


def test_union_matches_columns_by_name(small):
    union = union_by_name([small, small.select("v", "k")])
    assert union.columns == ["k", "v"]
    assert union.where("k = 2 and v is null").count() == 4


def test_scale_family_registers_views(spark, small):
    family = scale_family({"items": small}, (1, 5), views=True)
    assert list(family) == ["items_original", "items_5x"]
    assert spark.sql("SELECT count(*) FROM items_5x").first()[0] == 15
    assert family["items_original"].columns == family["items_5x"].columns == ["k", "v", "dup_batch"]


def test_family_in_one_scan_equals_single_replications(small):
    whole = replicate_each(small, (1, 3))
    assert plan(whole).count("FileScan") == 1
    for factor in (1, 3):
        part = whole.where(F.col("factor") == factor).drop("factor")
        assert sorted(map(str, rows(part))) == sorted(map(str, rows(replicate(small, factor))))


def test_views(spark, small):
    register_views({"one": small})
    assert spark.table("one").count() == 3
