import json

import pytest
from frames import rows

from veritally import ScoreStore
from veritally.sources.generations import MOST_PARTS, BucketTable

SCHEMA = "id long, v string"


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "table"), 8)


def frame(spark, ids, v="a"):
    return spark.createDataFrame([(i, v) for i in ids], SCHEMA)


def test_one_changed_key_rewrites_its_bucket_only(spark, table):
    table.replace(frame(spark, range(200)), "id")
    before = table.files()
    table.change(frame(spark, [17], "b"), "id", frame(spark, [17]).select("id"))
    after = table.files()
    assert sorted(rows(table.read())) == sorted([(i, "a") for i in range(200) if i != 17] + [(17, "b")])
    touched = {f.rsplit("/", 2)[1] for f in after - before}
    assert len(touched) == 1 and len(before & after) == len(before) - 1
    assert {f.rsplit("/", 2)[1] for f in before - after} == touched


def test_new_keys_are_added_without_rewriting(spark, table):
    table.replace(frame(spark, range(100)), "id")
    before = table.files()
    table.change(frame(spark, [1000, 1001, 1002]), "id")
    assert before < table.files() and table.read().count() == 103


def test_parts_are_put_together_again(spark, table):
    table.replace(frame(spark, [0]), "id")
    for i in range(1, MOST_PARTS + 4):
        table.change(frame(spark, [0], f"v{i}"), "id")
    assert max(len(p) for p in table.manifest().parts.values()) <= MOST_PARTS
    assert table.read().count() == MOST_PARTS + 4


def test_null_keys_are_keys(spark, table):
    table.replace(frame(spark, [None, None, 1]), "id")
    table.change(frame(spark, [None], "b"), "id", frame(spark, [None]).select("id"))
    assert sorted(rows(table.read()), key=str) == [(1, "a"), (None, "b")]


@pytest.mark.parametrize("point", ["data", "manifest"])
def test_a_crash_leaves_the_table_as_it_was(spark, table, monkeypatch, point):
    table.replace(frame(spark, range(50)), "id")
    before = sorted(rows(table.read()))

    def crash(*_):
        raise RuntimeError("crashed")

    with monkeypatch.context() as patch:
        patch.setattr(BucketTable, "_commit" if point == "data" else "_clean", crash)
        with pytest.raises(RuntimeError):
            table.change(frame(spark, range(50), "b"), "id", frame(spark, range(50)).select("id"))
    again = BucketTable(spark, table.place)
    if point == "data":  # written, but not listed
        assert sorted(rows(again.read())) == before
    else:  # listed, but not cleaned up
        assert {v for _, v in rows(again.read())} == {"b"}
    again.change(frame(spark, [99], "c"), "id")
    again.change(frame(spark, [98], "c"), "id")
    assert again.read().count() == 52
    listed = {name for back in (0, 1) for names in again.manifest(back).parts.values() for name in names}
    folders = {x.name for x in (__import__("pathlib").Path(table.place)).iterdir() if x.name.startswith("g-")}
    assert folders == listed  # nothing is left behind


def test_a_reader_keeps_its_files_for_one_more_write(spark, table):
    table.replace(frame(spark, range(20)), "id")
    reader = table.read()
    table.replace(frame(spark, range(5), "b"), "id")
    assert reader.count() == 20 and table.read().count() == 5


def test_two_writers_do_not_overwrite_each_other(spark, table):
    table.replace(frame(spark, range(20)), "id")
    before = table.manifest()
    table.change(frame(spark, [30]), "id")
    with pytest.raises(OSError, match="another writer"):
        table._commit(before, frame(spark, []).schema, {})
    assert table.read().count() == 21


def test_an_empty_table_keeps_its_columns(spark, table):
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(frame(spark, []), "id")
    assert table.exists() and table.read().columns == ["id", "v"] and table.read().count() == 0
    assert json.loads(table.manifest().text())["buckets"] == 8
    table.change(frame(spark, [3]), "id")
    assert rows(table.read()) == [(3, "a")]


def test_a_store_keeps_its_number_of_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(40)], "id long, t string")
    ScoreStore(spark, str(tmp_path), buckets=4).write(docs, "id", "t")
    other = ScoreStore(spark, str(tmp_path), buckets=32)
    assert other.append_new(docs, "id", "t").count() == 40
    assert other.table().manifest().buckets == 4 and set(other.table().manifest().parts) <= set(range(4))


def test_one_percent_of_changed_payloads_touches_few_files(spark, tmp_path):
    docs = spark.range(500).selectExpr("id", "repeat('x', CAST(id AS INT)) AS t")
    store = ScoreStore(spark, str(tmp_path), buckets=64)
    store.append_new(docs, "id", "t")
    before = store.table().files()
    changed = docs.selectExpr("id", "if(id % 100 = 0, concat(t, chr(10)), t) AS t")
    assert store.append_new(changed, "id", "t").count() == 500
    assert len(before - store.table().files()) <= 5
