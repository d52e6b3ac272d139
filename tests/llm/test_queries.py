"""Registered queries against their oracles, and the pipeline against a plain version."""

import math
import re
import shutil
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from test_dedup import plain_groups, plain_lines, plain_tiles
from test_scores import plain_measures
from veritally.llm import decontamination, queries, source_mix

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")


def canonical(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in records]
    return sorted((tuple(r[i] for i in order) for r in plain), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    result = queries.queries()[name](spark, str(DATA))
    expected = duck.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    assert canonical([tuple(r) for r in result.collect()], result.columns) == canonical(expected.fetchall(), expected.columns)


def test_every_operator_is_registered():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries() and "pipeline" not in contract.oracle_sql()


def plain_words(text):
    """Lower-cased runs of letters, digits and non-ASCII signs."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def quick_tiles(item, doc, shortest):
    """`plain_tiles` over the stretches of a document that share `shortest` words with the item."""
    seeds = {tuple(item[i : i + shortest]) for i in range(len(item) - shortest + 1)}
    near = [False] * len(doc)
    for j in range(len(doc) - shortest + 1):
        if tuple(doc[j : j + shortest]) in seeds:
            near[j : j + shortest] = [True] * shortest
    if not any(near):
        return []
    return plain_tiles(item, [w if n else f" {j}" for j, (w, n) in enumerate(zip(doc, near)) if n or (j and near[j - 1])], shortest)


def test_contamination_of_the_small_tables_equals_the_plain_version(spark):
    items = {r["item_id"]: plain_words(r["text"]) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).collect()}
    expected = {}
    for r in spark.read.parquet(str(DATA / "documents.parquet")).collect():
        doc, covered, best, longest = plain_words(r["text"]), [], 0.0, 0
        for i, item in items.items():
            tiles = quick_tiles(item, doc, decontamination.SEED)
            share, long = sum(t[2] for t in tiles) / max(len(item), 1), max((t[2] for t in tiles), default=0)
            if share >= decontamination.COVERAGE or long >= decontamination.LONG_TILE:
                covered.append(i)
                best, longest = max(best, share), max(longest, long)
        expected[r["doc_id"]] = sorted(covered), best, longest
    rows = queries.queries()["op10_decontamination"](spark, str(DATA)).collect()
    assert {r["doc_id"]: r["items"] for r in rows} == {i: e[0] for i, e in expected.items()}
    assert sum(bool(e[0]) for e in expected.values()) > 0
    for r in rows:
        covered, best, longest = expected[r["doc_id"]]
        assert r["kept"] == (not covered) and r["n_items"] == len(covered)
        if covered:  # pairs that cannot reach the threshold are not tiled
            assert r["best_coverage"] == pytest.approx(best) and r["longest_tile"] == longest


@pytest.mark.parametrize("name", ["op6_language_id", "op7_toxicity"])
def test_scores_of_the_small_tables(spark, name):
    rows = queries.queries()[name](spark, str(DATA)).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 for r in rows)
    assert 40 < sum(r["held_out"] for r in rows) < 90


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    result = queries.queries()["op6_language_id"](spark, str(DATA)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert result.where("lang = lang_pred").count() >= 0.9 * result.count()


def test_pipeline_equals_the_plain_stages(spark, docs, tmp_path):
    sf = tmp_path / "sf"
    item = " ".join(f"bench{i}" for i in range(20))
    leak = spark.createDataFrame([(500, "some words " + item + " " + " ".join(f"n{i}" for i in range(50)), "en", "src1", "kept", 1)], docs.schema)
    docs.union(leak).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    tables, given = [], spark.read.parquet(str(sf / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, str(sf))
        tables.append(given)
    text = {r["doc_id"]: r["text"] for r in docs.union(leak).collect()}

    def passes(t):
        words, chars, symbols, dup, repeat = plain_measures(t)
        lines = sum(bool(x.strip()) for x in (t or "").split("\n"))
        return words >= 50 and 2 * repeat <= words and 10 * symbols <= words and 2 * words <= chars <= 20 * words and 2 * dup <= lines

    expected = {i: t for i, t in text.items() if passes(t)}
    assert {r["doc_id"]: r["text"] for r in tables[0].collect()} == expected
    expected = {i: t for i, t in plain_lines(list(expected.items())) if t.strip()}
    assert {r["doc_id"]: r["text"] for r in tables[1].collect()} == expected
    keep = {i for i, _, _, kept in plain_groups(list(expected.items())) if kept}
    expected = {i: t for i, t in expected.items() if i in keep}
    assert {r["doc_id"] for r in tables[2].collect()} == set(expected)
    assert 500 in expected
    expected.pop(500)
    assert {r["doc_id"] for r in tables[3].collect()} == set(expected)
    for df in tables[:4]:
        assert df.columns == docs.columns
    duck = duckdb.connect()
    plain = spark.read.parquet(str(sf / "documents.parquet")).where(f"doc_id IN ({', '.join(map(str, expected))})").select("doc_id", "source").collect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["source"], expected[r["doc_id"]]) for r in plain])
    mixed = duck.sql(source_mix.ORACLE_SQL)
    order = [mixed.columns.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    wanted = sorted(tuple(r[i] for i in order) for r in mixed.fetchall())
    result = corpus_pipeline.run(spark, str(sf)).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(tuple(r) for r in result.collect()) == wanted == sorted(tuple(r) for r in tables[4].select(result.columns).collect())
    assert decontamination.SEED == 5
    shutil.rmtree(sf)
