import pytest
from frames import rows

from veritally.sources.drift import data_files, drift, file_types


@pytest.fixture
def folder(spark, tmp_path):
    base = spark.range(10).repartition(1)
    parts = {
        "a": base.selectExpr("id", "CAST(id AS INT) AS n", "'x' AS t"),
        "b": base.selectExpr("id", "CAST(id AS STRING) AS n", "'x' AS t"),
        "c/deep": base.selectExpr("id", "CAST(id AS INT) AS n", "array(struct(id AS k)) AS more"),
        "d": base.where("false").selectExpr("id", "CAST(id AS BIGINT) AS n", "'x' AS t"),
    }
    for name, df in parts.items():
        df.write.parquet(f"{tmp_path}/{name}")
    return str(tmp_path)


def test_conflicts_are_found_without_reading_rows(spark, folder):
    types = file_types(spark, folder)
    assert types.select("file").distinct().count() == len(data_files(spark, folder)) == 4
    found = {r["column"]: (r["types"], r["n_files"], r["n_without"], r["conflict"]) for r in drift(types).collect()}
    assert found == {
        "id": (["bigint"], 4, 0, False), "n": (["bigint", "int", "string"], 4, 0, True),
        "t": (["string"], 3, 1, False), "more": (["array<struct<k:bigint>>"], 1, 3, False),
    }


def test_damaged_rows_do_not_matter(spark, folder):
    """Only the footer is read: the pages of a file may be gone."""
    (file,) = [f for f in data_files(spark, folder) if "/a/" in f]
    place = file.removeprefix("file:")
    raw = open(place, "rb").read()
    footer = int.from_bytes(raw[-8:-4], "little") + 8
    open(place, "wb").write(raw[:4] + b"\0" * (len(raw) - 4 - footer) + raw[-footer:])
    for crc in __import__("pathlib").Path(place).parent.glob(".*.crc"):
        crc.unlink()
    assert ("n", "int") in {(c, t) for _, _, c, t in rows(file_types(spark, folder))}


def test_a_folder_without_files(spark, tmp_path):
    assert file_types(spark, str(tmp_path)).count() == 0 and drift(file_types(spark, str(tmp_path))).count() == 0
