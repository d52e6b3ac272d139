"""Every query and the pipeline on texts longer than a unit, on empty tables and on odd columns."""

import random
import re

import pytest

import corpus_pipeline
from veritally.llm import kit, language_id, license_digests, lm_scoring, queries, toxicity
from veritally.llm.license_texts import TEXTS

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PER_DOCUMENT = sorted(name for name in queries.queries() if name != "op12_hard_negatives")


def prose(rng, n_bytes):
    words, size = [], 0
    while size < n_bytes:
        words.append("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))))
        size += len(words[-1]) + 1
        if rng.random() < 0.1:
            words[-1] += "\n"
    return " ".join(words)


def long_rows():
    """A text of more than a unit, its copy, one of more than a piece, one word of that size, odd ones."""
    rng = random.Random(3)
    unit, piece = prose(rng, kit.UNIT_BYTES + 1000), prose(rng, 3 * kit.PIECE_BYTES // 2)
    texts = [unit, piece, unit, "x" * (kit.PIECE_BYTES + 10), None, "", " \n ", "a few words only here", "a few words only here"]
    return [(i, t, ("en", "de", None)[i % 3], f"src{i % 2}", len(t) if t else None) for i, t in enumerate(texts)] + [(None, texts[7], "en", None, 3)]


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("long")
    return write(spark, sf, long_rows()), long_rows()


def write(spark, sf, rows):
    spark.createDataFrame(rows, DOCUMENTS).repartition(2).write.parquet(f"{sf}/documents.parquet")
    ids = [r[0] for r in rows if r[0] is not None]
    labels = [(i, i % 2, (i // 2) % 2) for i in ids] + [(None, 1, 1), (9999, 1, 1), (0, None, None)] * bool(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    items = [(1, rows[0][1][: 300])] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    return str(sf)


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_texts_longer_than_a_unit(spark, long_tables, name):
    sf, rows = long_tables
    result = queries.queries()[name](spark, sf).collect()
    assert sorted((r["doc_id"] for r in result), key=str) == sorted((r[0] for r in rows), key=str)
    by_id = {r["doc_id"]: r for r in result}
    text = {r[0]: r[1] or "" for r in rows}
    if name.startswith("op1_"):
        assert all(r["n_tokens"] in (0, len(WORD.findall(text[i])), len(WORD.findall(text[i])) + 1) for i, r in by_id.items())
    if name.startswith("op2_"):
        assert by_id[2]["n_removed"] == by_id[2]["n_lines"] > 0 and by_id[8]["n_removed"] == 1
    if name.startswith("op3_"):
        assert {i: r["n_bytes"] for i, r in by_id.items()} == {i: len(t) for i, t in text.items()}
        assert by_id[2]["n_removed"] == len(text[2]) and by_id[2]["n_spans"] == 1 and not by_id[0]["n_removed"] and not by_id[1]["n_removed"]
    if name.startswith("op5_"):
        assert {by_id[i]["component_id"] for i in (0, 2)} == {0} and by_id[0]["n_shingles"] == by_id[2]["n_shingles"] > 500000 and by_id[8]["component_id"] == 7
    if name.startswith("op8_"):
        assert {i: r["n_words"] for i, r in by_id.items()} == {i: len(WORD.findall(t)) for i, t in text.items()}
    if name.startswith("op9_"):
        assert {i: r["size"] for i, r in by_id.items()} == {i: len(WORD.findall(t)) for i, t in text.items()}
    if name.startswith("op10_"):
        assert {i for i, r in by_id.items() if not r["kept"]} == {0, 2}
    if name.startswith("op11_"):
        assert by_id[0]["n_a"] == by_id[2]["n_a"] > 10**6 and by_id[0]["groups_sha256"] == by_id[2]["groups_sha256"] and by_id[3]["n_links"] > 0
    if name.startswith("op13_"):
        assert by_id[0]["ids_sha256"] == by_id[2]["ids_sha256"] and by_id[3]["n_tokens"] > 1000


@pytest.fixture(scope="module")
def no_tables(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), [])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, no_tables, name):
    assert queries.queries()[name](spark, no_tables).count() == 0


def test_pipeline_of_empty_tables_and_of_long_texts(spark, no_tables, long_tables):
    assert corpus_pipeline.run(spark, no_tables).count() == 0
    rows = corpus_pipeline.run(spark, long_tables[0]).collect()
    assert {r["doc_id"] for r in rows} == {1}  # 0 and 2 hold the benchmark item or are copies, the others are too short


def test_pipeline_passes_on_columns_named_like_its_own(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, 900), "en", "s", i) for i in range(6)]
    plain = spark.createDataFrame(rows, DOCUMENTS)
    named = plain.selectExpr("*", "7 AS carried_0", "'u' AS unit", "1 AS size", "'k' AS kept", "2 AS n_words", "CAST(n_chars AS STRING) AS taken")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (named, named.withColumn("n_chars", named["n_chars"].cast("string"))):
        given = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, str(tmp_path))
            assert given.dtypes == docs.dtypes
        assert {r["doc_id"]: r["text"] for r in given.collect()} == {r[0]: r[1] for r in rows}
        assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == 6


def test_models_of_no_rows_and_odd_labels(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    some = spark.createDataFrame([(1, "words of a text", None, None, 1), (2, None, "en", None, 1)], DOCUMENTS)
    assert {r["lang_pred"] for r in language_id.predict(some, language_id.fit(some)).collect()} == {"und"}
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(none, labels) is None and toxicity.fit(some, labels) is None
    assert toxicity.score(none, None).count() == 0


def test_languages_that_tie_go_by_name(spark):
    rows = [(i, "same words here", lang, None, 1) for i, lang in enumerate(["fr", "de", "en"] * 5)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    assert {r["lang_pred"] for r in found} == {"de"} and all(abs(r["score"] - 1 / 3) < 1e-9 for r in found)


def test_licences_with_equal_texts_go_by_name(spark):
    texts = spark.createDataFrame([("b-licence", "Some Rights, reserved."), ("a-licence", "some rights reserved"), (None, "x"), ("c", None)], "license_id string, text string")
    known = license_digests.known_licenses(spark, texts)
    docs = spark.createDataFrame([(1, "SOME rights  reserved!")], "doc_id long, text string")
    assert {r["license_id"] for r in license_digests.scan(docs, known).collect()} == {"a-licence"}


def test_listed_licences_are_found_however_they_are_set(spark):
    rows = [(k, re.sub(r"[.,;]", " ", text.upper()).replace("LICENSE", "LICENCE") + "\n\n(c) 2024 someone") for k, (_, text) in enumerate(TEXTS)]
    found = license_digests.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_digests.known_licenses(spark))
    assert {r["doc_id"]: r["license_id"] for r in found.collect()} == {k: name for k, (name, _) in enumerate(TEXTS)}


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} goes here", 5) for i in range(8)], "doc_id long, text string, n_tokens int")
    ids = docs.where("doc_id < 3").select("doc_id")
    plain = lm_scoring.score(docs.drop("n_tokens"), ids).collect()
    assert sorted(map(str, lm_scoring.score(docs, ids).collect())) == sorted(map(str, plain))
