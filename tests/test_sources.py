import pytest
from frames import plan, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally import conform, read_csv, read_parquet
from veritally.functions.columns import label_flag
from veritally.sources.tables import empty_like, lossless_types, read_csv_rows, split_corrupt


@pytest.fixture
def label_file(tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("id,isfraud\n007,True\n8,0\n9,maybe\n10,\n")
    return str(path)


def test_csv_columns_are_text_under_their_header_names(spark, label_file):
    df = read_csv(spark, label_file)
    assert df.dtypes == [("id", "string"), ("isfraud", "string")]
    assert rows(df.withColumn("isfraud", label_flag("isfraud"))) == [
        ("007", True), ("8", False), ("9", None), ("10", None),
    ]


def test_csv_with_a_schema_checks_the_header(spark, label_file):
    assert read_csv(spark, label_file, "id string, isfraud string").count() == 4
    with pytest.raises(Exception):
        read_csv(spark, label_file, "key string, isfraud string").collect()


def test_csv_and_parquet_give_the_same_table(spark, label_file, tmp_path):
    expected = T.StructType([T.StructField("isfraud", T.BooleanType()), T.StructField("id", T.StringType())])
    from_csv = conform(read_csv(spark, label_file), expected)
    from_csv.write.parquet(str(tmp_path / "labels"))
    from_parquet = read_parquet(spark, str(tmp_path / "labels"), expected)
    assert from_csv.dtypes == from_parquet.dtypes == [("isfraud", "boolean"), ("id", "string")]
    assert sorted(map(str, rows(from_csv))) == sorted(map(str, rows(from_parquet)))


def test_several_files(spark, label_file, tmp_path):
    other = tmp_path / "more.csv"
    other.write_text("id,isfraud\n11,yes\n")
    assert read_csv(spark, [label_file, str(other)]).count() == 5
    spark.range(3).write.parquet(str(tmp_path / "p1"))
    spark.range(4).write.parquet(str(tmp_path / "p2"))
    assert read_parquet(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")]).count() == 7


def test_a_missing_column_is_an_error(spark, label_file):
    with pytest.raises(ValueError, match="score"):
        conform(read_csv(spark, label_file), T.StructType([T.StructField("score", T.DoubleType())]))


def test_a_type_no_cast_reaches_is_an_error(spark):
    with pytest.raises(Exception):
        conform(spark.range(1), T.StructType([T.StructField("id", T.ArrayType(T.StringType()))]))


def test_schema_probe_reads_nothing(spark, label_file):
    probe = empty_like(read_csv(spark, label_file))
    assert probe.columns == ["id", "isfraud"] and rows(probe) == []
    assert "FileScan" not in plan(probe)


def test_reading_two_columns_scans_two_columns(spark, tmp_path):
    spark.range(5).selectExpr("id", "'t' AS text", "'x' AS other").write.parquet(str(tmp_path / "wide"))
    text = plan(read_parquet(spark, str(tmp_path / "wide")).select("id", "other"))
    assert "ReadSchema: struct<id:bigint,other:string>" in text


DAMAGED = 'id,n,t\n1,5,"two\nlines"\n2,x,b\n3,7\n4,8,c,more\n5,,d\n,9,"say ""so"""\n'


def test_no_damaged_row_is_taken_for_a_sound_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text(DAMAGED)
    result = read_csv_rows(spark, str(tmp_path), "id INT, n INT, t STRING")
    sound, damaged = split_corrupt(result)
    assert sorted(rows(sound), key=str) == [(1, 5, "two\nlines"), (5, None, "d"), (None, 9, 'say "so"')]
    assert {r["id"]: r["corrupt_row"] for r in damaged.collect()} == {2: "2,x,b", 3: "3,7", 4: "4,8,c,more"}
    assert sound.count() + damaged.count() == result.count() == 6


@pytest.mark.parametrize("column", ["id", "n", "t"])
def test_a_row_is_damaged_whatever_is_asked_for(spark, tmp_path, column):
    (tmp_path / "a.csv").write_text(DAMAGED)
    result = read_csv_rows(spark, str(tmp_path), "id INT, n INT, t STRING")
    assert result.select(column, "corrupt_row").where("corrupt_row IS NOT NULL").count() == 3


def test_the_extra_column_has_a_name_of_its_own(spark, tmp_path):
    with pytest.raises(ValueError, match="exists"):
        read_csv_rows(spark, str(tmp_path), "id INT, corrupt_row STRING")


def test_types_lose_nothing(spark):
    values = {
        "flag": ["true", "false", None], "named": ["True", "False", "True"], "small": ["1", "-2", "30"], "padded": ["007", "1", "2"],
        "large": ["1", "5000000000", "2"], "huge": ["99999999999999999999", "1", "2"], "real": ["1.5", "-0.25", "1.0E10"], "money": ["1.50", "2.25", "3.10"],
        "day": ["2024-02-29", "1999-12-31", None], "no_day": ["2024-02-30", "2024-01-01", None], "time": ["2024-02-29 23:59:59", None, None],
        "mixed": ["1", "a", None], "blank": ["1", "", "2"], "none": [None, None, None], "a.b": ["4", "5", "6"],
    }
    df = spark.createDataFrame(list(zip(*values.values())), ", ".join(f"`{c}` string" for c in values))
    found = {r["column"]: (r["type"], r["n_values"], r["n_nulls"]) for r in lossless_types(df).collect()}
    kinds = {c: k for c, (k, _, _) in found.items()}
    assert kinds == {
        "flag": "boolean", "named": "string", "small": "int", "padded": "string", "large": "bigint", "huge": "string", "real": "double", "money": "string",
        "day": "date", "no_day": "string", "time": "timestamp", "mixed": "string", "blank": "string", "none": "string", "a.b": "int",
    }
    assert found["flag"][1:] == (2, 1) and found["none"][1:] == (0, 3)
    assert {r["type"] for r in lossless_types(df.limit(0), ["small", "flag"]).collect()} == {"string"}


def test_a_cast_to_the_type_found_can_be_undone(spark):
    df = spark.range(-50, 50).selectExpr("CAST(id AS STRING) AS a", "CAST(id / 8 AS STRING) AS b", "CAST(date_add(DATE'2024-01-01', CAST(id AS INT)) AS STRING) AS c")
    for r in lossless_types(df).collect():
        c = r["column"]
        assert r["type"] != "string"
        assert df.where(F.col(c).cast(r["type"]).cast("string") != F.col(c)).count() == 0


def test_types_take_one_pass(spark):
    df = spark.range(10).selectExpr("CAST(id AS STRING) AS a", "CAST(id AS STRING) AS b")
    assert plan(lossless_types(df)).count("Range") == 1
