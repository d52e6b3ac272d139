"""The registered queries: each operator run over the given tables.

Stand-ins for the identity tables: `documents.text` is the payload, `labels.toxic` the
label, `documents.source` and `documents.lang` the attributes; `embeddings` feeds the
linear model. The CSV queries write these stand-ins as the three files and read them back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions.columns import count_true, label_flag, payload_bytes, rate_pct
from veritally.operators.quarantine import quarantine
from veritally.operators.rates import label_summary, rate_by, rates_by_all, score_summary, top_groups
from veritally.operators.replicate import FACTORS, replicate, replicate_each, scale_family, scale_name, union_by_name, weigh_each
from veritally.operators.scoring import LINES, ModelScorer, SqlScorer, linear_file_scorer, partitions_for, register_sql, score
from veritally.plans import sql
from veritally.plans.identity import IdentityTables
from veritally.session import checkpointed, remove_folder, shared_folder
from veritally.sources.bucketed import BucketedTables
from veritally.sources.drift import drift, file_types
from veritally.sources.store import ScoreStore
from veritally.sources.tables import empty_like, lossless_types, read_csv, read_csv_rows, read_parquet, register_views

LINES_OF_TEXT = LINES.score_sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), "text", "lines", keep=["doc_id"])


def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return score(vectors, "embedding", "linear", keep=["vec_id"], partitions=partitions_for(vectors))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, use: Callable[[ScoreStore], DataFrame]) -> DataFrame:
    """What `use` reads from a new store, kept; the store itself is removed again."""
    store = ScoreStore(spark, new_folder(spark, "scores"))
    rows = checkpointed(use(store))
    store.drop()
    return rows


# --- the four questions ---------------------------------------------------------------


def q_score_summary(spark, sf_dir):
    return score_summary(scored_documents(spark, sf_dir))


def q_label_summary(spark, sf_dir):
    return label_summary(labels(spark, sf_dir), "flag", unlabelled="unlabelled")


def _rate(spark, sf_dir, by, **options):
    return rate_by(
        scored_documents(spark, sf_dir),
        labels(spark, sf_dir),
        documents(spark, sf_dir),
        by,
        on="doc_id",
        **options,
    )


def q_rate_by_source(spark, sf_dir):
    return _rate(spark, sf_dir, "source")


def q_rate_by_lang(spark, sf_dir):
    return _rate(spark, sf_dir, "lang")


def q_rate_plain_join(spark, sf_dir):
    return _rate(spark, sf_dir, "source", count_first=False)


def q_rate_preaggregated(spark, sf_dir):
    return _rate(spark, sf_dir, "source", top=None)


def q_rate_labelled_only(spark, sf_dir):
    marked = labels(spark, sf_dir)
    scored = score(
        documents(spark, sf_dir), "text", "lines", keep=["doc_id"], only_keys=marked.select("doc_id")
    )
    return rate_by(scored, marked, documents(spark, sf_dir), "lang", on="doc_id")


def q_rate_labelled_filtered(spark, sf_dir):
    """The same, with the Bloom filter that many keys would get."""
    marked = labels(spark, sf_dir)
    scored = score(
        documents(spark, sf_dir), "text", "lines", keep=["doc_id"], only_keys=marked.select("doc_id"), filter_words=1 << 16
    )
    return rate_by(scored, marked, documents(spark, sf_dir), "lang", on="doc_id")


def q_rates_by_all(spark, sf_dir):
    """Both group questions from one join."""
    return rates_by_all(scored_documents(spark, sf_dir), labels(spark, sf_dir), documents(spark, sf_dir), ["source", "lang"], on="doc_id")


def q_topk_groups(spark, sf_dir):
    scored = score(documents(spark, sf_dir), "text", "lines", keep=["source"])
    groups = scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), count_true(F.col("pred")).alias("predicted")
    )
    groups = groups.withColumn("rate_pct", rate_pct(F.col("predicted"), F.col("total")))
    return top_groups(groups, "source", "rate_pct", 10)


# --- scores, stored scores ------------------------------------------------------------


def q_score_column(spark, sf_dir):
    return scored_documents(spark, sf_dir)


def q_summary_from_store(spark, sf_dir):
    return score_summary(stored(spark, lambda s: s.write(documents(spark, sf_dir), "doc_id", "text")))


def q_rate_from_store(spark, sf_dir):
    scores = stored(spark, lambda s: s.write(documents(spark, sf_dir), "doc_id", "text"))
    return rate_by(scores, labels(spark, sf_dir), documents(spark, sf_dir), "source", on="doc_id")


def _twice(spark, first, second):
    def use(store):
        store.append_new(first, "doc_id", "text")
        return store.append_new(second, "doc_id", "text")

    return stored(spark, use)


def q_store_append_new(spark, sf_dir):
    """Labelled documents first, all of them in a second run."""
    docs = documents(spark, sf_dir)
    return _twice(spark, docs.join(labels(spark, sf_dir), "doc_id", "left_semi"), docs)


def q_store_changed_payload(spark, sf_dir):
    """All documents, then the same with line feeds put into the German texts."""
    docs = documents(spark, sf_dir)
    broken = F.when(F.col("lang") == "de", F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))
    return _twice(spark, docs, docs.withColumn("text", broken))


def q_store_other_table(spark, sf_dir):
    """All documents, then a table of the labelled ones: their scores only."""
    docs = documents(spark, sf_dir)
    return _twice(spark, docs, docs.join(labels(spark, sf_dir), "doc_id", "left_semi"))


def q_store_one_percent_changed(spark, sf_dir):
    """All documents, then the same with one text in a hundred doubled: the summary afterwards, and
    how many buckets the second run left as they were."""
    docs = documents(spark, sf_dir)
    doubled = F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    store = ScoreStore(spark, new_folder(spark, "scores"), buckets=64)
    store.append_new(docs, "doc_id", "text")
    before = store.table().manifest().parts
    store.append_new(docs.withColumn("text", doubled), "doc_id", "text")
    after = store.table().manifest().parts
    kept = sum(before[b] == after[b] for b in before)
    rows = checkpointed(score_summary(store.read()))
    store.drop()
    changed = docs.where("doc_id % 100 = 0 AND text IS NOT NULL").agg(F.count(F.lit(1)).alias("changed"))
    in_place = (F.lit(len(before) - kept) <= F.col("changed")) & (F.lit(len(before)) == F.lit(len(after)))
    return rows.crossJoin(changed).withColumn("others_kept", in_place)  # two tables of one row


def q_rate_from_bucketed_store(spark, sf_dir):
    """Scores, labels and attributes stored in buckets of their key, joined bucket by bucket."""
    tables = BucketedTables(spark, "doc_id")
    scored = tables.save("scored", scored_documents(spark, sf_dir))
    marked = tables.save("labels", labels(spark, sf_dir))
    attributes = tables.save("attributes", documents(spark, sf_dir).select("doc_id", "source"))
    rows = checkpointed(rate_by(scored, marked, attributes, "source", on="doc_id"))
    tables.drop()
    return rows


def q_linear_score(spark, sf_dir):
    return scored_vectors(spark, sf_dir)


def q_linear_rate_by_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rate_by(scored_vectors(spark, sf_dir), vectors, vectors, "label", on="vec_id")


def q_linear_file_score(spark, sf_dir):
    """The linear model with its weights read from an artefact."""
    path = new_folder(spark, "weights")
    weights = spark.range(64).select(F.col("id").alias("position"), ((F.col("id") * 7) % 11 - 5).cast("double").alias("weight"))
    weights.write.parquet(path)
    scorer = linear_file_scorer(spark, path, version=path)
    scored = score(table(spark, sf_dir, "embeddings"), "embedding", scorer, keep=["vec_id"])
    remove_folder(spark, path)  # the model is loaded and broadcast by now
    return scored


def _odd_vectors(spark, sf_dir) -> DataFrame:
    """All vectors, and beside them one cut short, one missing and one without a number for each
    vector of label 0."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    odd = vectors.where("label = 0")
    cases = [
        vectors.withColumn("kind", F.lit("good")),
        odd.withColumn("embedding", F.slice("embedding", 1, 63)).withColumn("kind", F.lit("short")),
        odd.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("kind", F.lit("null")),
        odd.withColumn("embedding", F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).withColumn("kind", F.lit("nan")),
    ]
    return score(union_by_name(cases), "embedding", "linear", keep=["kind"])


def q_score_errors(spark, sf_dir):
    """Every bad row is no fraud, with its reason."""
    scored = _odd_vectors(spark, sf_dir)
    return scored.groupBy("kind", "score_error").agg(F.count(F.lit(1)).alias("total"), count_true(F.col("pred")).alias("predicted"))


def q_score_quarantine(spark, sf_dir):
    """The same counts from what one pass wrote: sound rows on one side, failed ones on the other."""
    folder = new_folder(spark, "quarantine")
    apart = quarantine(_odd_vectors(spark, sf_dir), folder)
    measures = F.count(F.lit(1)).alias("total"), count_true(F.col("pred")).alias("predicted")
    both = [side.groupBy("kind", "score_error").agg(*measures) for side in (apart.scored, apart.failed)]
    rows = checkpointed(union_by_name(both).select("*", F.lit(apart.n_rows).cast("long").alias("n_rows"), F.lit(apart.n_failed).cast("long").alias("n_failed")))
    remove_folder(spark, folder)
    return rows


def q_sql_score_errors(spark, sf_dir):
    """A SQL score that is infinite, or no number, for many texts."""
    odd = SqlScorer("odd_score", "1", "if(length({x}) > 1000, double('infinity'), if(length({x}) > 500, double('nan'), double(length({x}))))", "STRING")
    scored = score(documents(spark, sf_dir), "text", odd, keep=["doc_id"])
    return scored.groupBy("pred", "score_error").agg(F.count(F.lit(1)).alias("total"))


def q_missing_model(spark, sf_dir):
    """A model that cannot be loaded, where the caller goes on without it."""

    def load():
        raise FileNotFoundError("no such weights")

    absent = ModelScorer("absent", "1", load=load, decode=list, forward=lambda model, rows: rows)
    scored = score(table(spark, sf_dir, "embeddings"), "embedding", absent, keep=["vec_id"], on_missing_model="false")
    return scored.groupBy("pred", "score_error").agg(F.count(F.lit(1)).alias("total"))


# --- replication ----------------------------------------------------------------------


def q_replicate_counts(spark, sf_dir):
    copies = replicate(documents(spark, sf_dir).select("lang", "n_chars"), 3)
    return copies.groupBy("lang", "dup_batch").agg(
        F.count(F.lit(1)).alias("total"), F.sum("n_chars").alias("chars")
    )


def q_replicate_untagged(spark, sf_dir):
    return replicate(table(spark, sf_dir, "labels"), 5, tag=None)


def q_union_by_name(spark, sf_dir):
    docs = documents(spark, sf_dir)
    marked = docs.join(labels(spark, sf_dir), "doc_id", "left_semi")
    union = union_by_name([docs.select("source", "n_chars"), marked.select("n_chars", "source")])
    return union.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum("n_chars").alias("chars"))


def q_score_summary_scales(spark, sf_dir):
    """The first question at every scale factor, over the replicated scored rows."""
    copies = replicate_each(scored_documents(spark, sf_dir).select("pred"))
    counts = copies.groupBy("factor").agg(F.count(F.lit(1)).alias("total"), count_true(F.col("pred")).alias("predicted"))
    return counts.withColumn("rate_pct", rate_pct(F.col("predicted"), F.col("total")))


def q_label_summary_scales(spark, sf_dir):
    copies = replicate_each(labels(spark, sf_dir).select("flag"))
    counts = copies.groupBy("factor").agg(
        F.count(F.lit(1)).alias("total"), count_true(F.col("flag")).alias("positive"), count_true(~F.col("flag")).alias("negative")
    )
    return counts.withColumn("rate_pct", rate_pct(F.col("positive"), F.col("total")))


def q_scale_family_counts(spark, sf_dir):
    """All three tables at all scales, row by row."""
    sources = {"scored": scored_documents(spark, sf_dir), "labels": labels(spark, sf_dir), "documents": documents(spark, sf_dir)}
    counts = []
    for name, df in sources.items():
        copies = replicate_each(df.select("doc_id")).groupBy("factor")
        counts.append(copies.agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("doc_id") + F.col("dup_batch")).alias("checksum")).withColumn("name", F.lit(name)))
    return union_by_name(counts)


def _rate_scales(spark, sf_dir, by):
    """The question at every scale factor, in one plan: scored once, each table read once."""
    return rate_by(
        weigh_each(scored_documents(spark, sf_dir)),
        weigh_each(labels(spark, sf_dir)),
        weigh_each(documents(spark, sf_dir).select("doc_id", by)),
        by,
        on="doc_id",
        per="factor",
        copies="copies",
    )


def q_rate_scales_by_source(spark, sf_dir):
    return _rate_scales(spark, sf_dir, "source")


def q_rate_scales_by_lang(spark, sf_dir):
    return _rate_scales(spark, sf_dir, "lang")


def _scaled(spark, sf_dir, by, factor, on, **options):
    return rate_by(
        replicate(scored_documents(spark, sf_dir), factor),
        replicate(labels(spark, sf_dir), factor),
        replicate(documents(spark, sf_dir).select("doc_id", by), factor),
        by,
        on=on,
        **options,
    )


def q_rate_scaled_faithful(spark, sf_dir):
    return _scaled(spark, sf_dir, "lang", 3, "doc_id")


def q_rate_scaled_rows(spark, sf_dir):
    return _scaled(spark, sf_dir, "lang", 3, "doc_id", count_first=False)


def q_rate_scaled_aligned(spark, sf_dir):
    return _scaled(spark, sf_dir, "lang", 3, ["doc_id", "dup_batch"])


def q_rate_scaled_100x(spark, sf_dir):
    return _scaled(spark, sf_dir, "source", 100, "doc_id")


# --- casts and codecs -----------------------------------------------------------------


def q_label_cast(spark, sf_dir):
    text = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), " True ")
        .when(F.col("toxic") == 1, "yes")
        .when(F.col("quality") == 1, "F")
        .otherwise("1.0")
    )
    marked = table(spark, sf_dir, "labels").select("doc_id", text.alias("label_text"))
    return marked.withColumn("flag", label_flag("label_text"))


def q_payload_decode(spark, sf_dir):
    """Every text as base64, without its padding, and damaged."""
    encoded = F.base64("text")
    kinds = {
        "whole": encoded,
        "unpadded": F.rtrim(encoded, F.lit("=")),
        "damaged": F.concat(F.lit("%"), encoded),
        "no-break space": F.concat(F.lit("\u00a0"), encoded),
    }
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("payload")) for k, v in kinds.items()])
    rows = documents(spark, sf_dir).select("doc_id", F.explode(cases).alias("c")).select("doc_id", "c.kind", "c.payload")
    data = rows.select("doc_id", "kind", payload_bytes("payload").alias("data"))
    return data.select("doc_id", "kind", F.octet_length("data").alias("n_bytes"), F.md5("data").alias("digest"))


# --- the report from CSV files --------------------------------------------------------

BASE64_LINES = SqlScorer("base64_lines", "1", LINES_OF_TEXT.format(x="decode(unbase64({x}), 'UTF-8')"), "STRING")


def from_files(spark, sf_dir, names: tuple[str, ...], ask: Callable[..., DataFrame]) -> DataFrame:
    """What `ask` reads from some of the files of the report, kept; the files are removed again."""
    folder = new_folder(spark, "csv")
    docs = documents(spark, sf_dir)
    flag = F.when(F.col("toxic") == 1, "True").when(F.col("toxic") == 0, "False")
    tables = {
        "idimage": lambda: docs.select(F.col("doc_id").alias("name"), F.translate(F.base64("text"), "\r\n", "").alias("imageData")),
        "idlabel": lambda: table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), flag.alias("isfraud")),
        "idmeta": lambda: docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("ethnicity"), F.col("source").alias("is_veteran")),
    }
    for name in names:
        tables[name]().write.option("header", True).csv(f"{folder}/{name}")
    rows = checkpointed(ask(*[f"{folder}/{name}" for name in names]))
    remove_folder(spark, folder)
    return rows


FILES = ("idimage", "idlabel", "idmeta")


def csv_report(spark, sf_dir, ask: Callable[[IdentityTables], DataFrame]) -> DataFrame:
    return from_files(spark, sf_dir, FILES, lambda *paths: ask(IdentityTables.from_csv(spark, *paths, BASE64_LINES)))


def q_csv_fraud_predicted(spark, sf_dir):
    images = lambda path: score(read_csv(spark, path), "imageData", BASE64_LINES, keep=["name"])
    return from_files(spark, sf_dir, ("idimage",), lambda path: IdentityTables(images(path), None, None).fraud_predicted())


def q_csv_fraud_ground_truth(spark, sf_dir):
    marks = lambda path: read_csv(spark, path).withColumn("isfraud", label_flag("isfraud"))
    return from_files(spark, sf_dir, ("idlabel",), lambda path: IdentityTables(None, marks(path), None).fraud_ground_truth())


def q_csv_fraud_by_ethnicity(spark, sf_dir):
    return csv_report(spark, sf_dir, IdentityTables.fraud_pattern_ethnicity_wise)


def q_csv_fraud_by_veteran_status(spark, sf_dir):
    return csv_report(spark, sf_dir, IdentityTables.fraud_rate_by_veteran_status)


def q_csv_typed_labels(spark, sf_dir):
    """The label file read with types given beforehand."""
    typed = lambda path: read_csv(spark, path, "id BIGINT, isfraud STRING").withColumn("isfraud", label_flag("isfraud"))
    return from_files(spark, sf_dir, ("idlabel",), typed)


def q_csv_lossless_types(spark, sf_dir):
    """Which types the columns of the three files could be read as."""
    report = lambda name, path: lossless_types(read_csv(spark, path)).select(F.lit(name).alias("file"), "*")
    return from_files(spark, sf_dir, FILES, lambda *paths: union_by_name([report(n, p) for n, p in zip(FILES, paths)]))


def q_csv_corrupt_rows(spark, sf_dir):
    """Texts with their line breaks in quotes, one row in ten with a word for a number, one with a value
    too many and one with a value too few."""
    folder = new_folder(spark, "csv")
    kind = F.col("doc_id") % 10
    text = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    number = F.when(kind == 1, F.concat(F.lit("x"), F.col("n_chars").cast("string"))).otherwise(F.col("n_chars").cast("string"))
    line = F.when(kind == 2, F.concat_ws(",", "doc_id", text, number, F.lit("more"))).when(kind == 3, F.concat_ws(",", "doc_id", text))
    documents(spark, sf_dir).select(line.otherwise(F.concat_ws(",", "doc_id", text, number)).alias("value")).write.text(folder)
    rows = read_csv_rows(spark, folder, "doc_id BIGINT, text STRING, n_chars BIGINT", header=False)
    damaged = F.col("corrupt_row").isNotNull()
    rows = rows.groupBy((F.col("doc_id") % 10).alias("kind"), damaged.alias("damaged")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(~damaged, F.col("n_chars"))).alias("chars")
    )
    rows = checkpointed(rows)
    remove_folder(spark, folder)
    return rows


def q_schema_probe(spark, sf_dir):
    """Tables and columns, from tables of which no row is read."""
    probes = []
    for name in ("documents", "labels", "embeddings"):
        empty = empty_like(table(spark, sf_dir, name))
        columns = F.array(*[F.lit(c) for c in empty.columns])
        probes.append(empty.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.explode(columns).alias("column_name"), "n_rows"))
    return union_by_name(probes)


def q_schema_drift(spark, sf_dir):
    """Documents as three deliveries left them: one with counts as text, one without languages."""
    folder = new_folder(spark, "deliveries")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    for name, df in {"first": docs, "second": docs.withColumn("n_chars", F.col("n_chars").cast("string")), "third": docs.drop("lang")}.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    rows = checkpointed(drift(file_types(spark, folder)).withColumn("types", F.array_join("types", ",")))
    remove_folder(spark, folder)
    return rows


def q_sql_views(spark, sf_dir):
    """Named views, and SQL over them that calls the scorer inside the aggregate over the join."""
    register_sql(spark, "lines_flag", "lines")
    docs = documents(spark, sf_dir)
    register_views({"idimage": docs.select(F.col("doc_id").alias("name"), "text"), "idlabel": labels(spark, sf_dir), "idmeta": docs.select("doc_id", "lang")})
    return spark.sql("""
        SELECT lang, count(*) AS total, sum(if(lines_flag(i.text), 1, 0)) AS predicted
        FROM idimage i JOIN idlabel l ON i.name = l.doc_id JOIN idmeta m ON l.doc_id = m.doc_id
        GROUP BY lang""")


def q_sql_scaled_views(spark, sf_dir):
    """Views of every table at every scale, queried by name."""
    scale_family({"scored": scored_documents(spark, sf_dir).select("doc_id", "pred"), "marks": labels(spark, sf_dir)}, views=True)
    parts = [f"SELECT {f} AS factor, 'scored' AS name, count(*) AS total, sum(if(pred, 1, 0)) AS hits FROM scored_{scale_name(f)}" for f in FACTORS]
    parts += [f"SELECT {f}, 'marks', count(*), sum(if(flag, 1, 0)) FROM marks_{scale_name(f)}" for f in FACTORS]
    return spark.sql(" UNION ALL ".join(parts))


# --- the same as SQL text -------------------------------------------------------------


def _sql_scored(spark, sf_dir):
    register_sql(spark, "lines_flag", "lines")
    return sql.scored_in_sql(documents(spark, sf_dir), "doc_id", "text", "lines_flag")


def q_sql_score_summary(spark, sf_dir):
    return sql.run(spark, sql.SCORE_SUMMARY, scored=_sql_scored(spark, sf_dir))


def q_sql_label_summary(spark, sf_dir):
    return sql.run(spark, sql.LABEL_SUMMARY, labels=labels(spark, sf_dir))


def q_sql_rate_by_source(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return sql.run(
        spark,
        sql.RATE_BY,
        scored=_sql_scored(spark, sf_dir),
        labels=labels(spark, sf_dir).withColumnRenamed("doc_id", "id"),
        attributes=docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp")),
        top=10,
    )


def q_sql_linear_summary(spark, sf_dir):
    register_sql(spark, "linear_flag", "linear")
    vectors = table(spark, sf_dir, "embeddings")
    return sql.run(
        spark, sql.SCORE_SUMMARY, scored=sql.scored_in_sql(vectors, "vec_id", "embedding", "linear_flag")
    )


def queries() -> dict[str, Query]:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_")}


# --- the same questions for DuckDB ----------------------------------------------------

_LINES = "120 * (length(text) - length(replace(text, chr(10), '')))"
_SCORED = f"scored AS (SELECT doc_id, {_LINES} > length(text) AS pred FROM documents)"
_VECTORS = """vectors AS (
    SELECT vec_id, label,
           list_inner_product(embedding::DOUBLE[], [((j * 7) % 11 - 5)::DOUBLE FOR j IN range(64)]) AS score
    FROM embeddings)"""


def _summary(source: str, flag: str = "pred") -> str:
    return f"""COUNT(*) AS total,
        CAST(SUM(CASE WHEN {flag} THEN 1 ELSE 0 END) AS BIGINT) AS predicted,
        CAST(100.0 * SUM(CASE WHEN {flag} THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS rate_pct
        FROM {source}"""


def _rate_sql(by: str, top: int | None = 10) -> str:
    return f"""WITH {_SCORED}
        SELECT m.{by}, {_summary("scored i JOIN labels l ON i.doc_id = l.doc_id JOIN documents m ON l.doc_id = m.doc_id",
                                 "i.pred")}
        GROUP BY m.{by} ORDER BY rate_pct DESC, m.{by} NULLS FIRST {f"LIMIT {top}" if top else ""}"""


def _scaled_sql(aligned: bool) -> str:
    def same(left: str, right: str) -> str:
        return f"{left}.doc_id = {right}.doc_id" + (f" AND {left}.c = {right}.c" if aligned else "")

    return f"""WITH {_SCORED}, copies AS (SELECT unnest(range(3)) AS c),
        i AS (SELECT scored.*, c FROM scored, copies),
        l AS (SELECT labels.*, c FROM labels, copies),
        m AS (SELECT documents.doc_id, documents.lang, c FROM documents, copies)
        SELECT m.lang, {_summary(f"i JOIN l ON {same('i', 'l')} JOIN m ON {same('l', 'm')}", "i.pred")}
        GROUP BY m.lang ORDER BY rate_pct DESC, m.lang LIMIT 10"""


def _scales_sql(by: str, factors: tuple[int, ...] = FACTORS, tagged: bool = True) -> str:
    """The question over replicated tables: copies are counted per key and table, then multiplied as a join does."""
    parts = [
        f"""SELECT * FROM (
        SELECT m.{by}, CAST(SUM(i.n * l.n * m.n) AS BIGINT) AS total, CAST(SUM(CASE WHEN pred THEN i.n * l.n * m.n ELSE 0 END) AS BIGINT) AS predicted,
               CAST(100.0 * SUM(CASE WHEN pred THEN i.n * l.n * m.n ELSE 0 END) AS DOUBLE) / SUM(i.n * l.n * m.n) AS rate_pct
               {f", {f} AS factor" if tagged else ""}
        FROM (SELECT doc_id, pred, count(*) AS n FROM scored, range({f}) GROUP BY doc_id, pred) i
        JOIN (SELECT doc_id, count(*) AS n FROM labels, range({f}) GROUP BY doc_id) l USING (doc_id)
        JOIN (SELECT doc_id, {by}, count(*) AS n FROM documents, range({f}) GROUP BY doc_id, {by}) m USING (doc_id)
        GROUP BY m.{by} ORDER BY rate_pct DESC, m.{by} NULLS FIRST LIMIT 10)"""
        for f in factors
    ]
    return f"WITH {_SCORED} " + " UNION ALL ".join(parts)


def _renamed(query: str, **names: str) -> str:
    return f"SELECT {', '.join(f'{old} AS {new}' for old, new in names.items())} FROM ({query})"


_LABELS = """COUNT(*) AS total,
    CAST(SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
    CAST(SUM(CASE WHEN NOT toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
    CAST(100.0 * SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS rate_pct"""
_SCORE_ROWS = f"""SELECT doc_id, CAST({_LINES} - length(text) AS DOUBLE) AS score,
    COALESCE({_LINES} > length(text), FALSE) AS pred,
    CASE WHEN text IS NULL THEN 'no payload' END AS score_error FROM documents"""
_SCORE_ERRORS = f"""WITH {_VECTORS}, odd AS (SELECT count(*) AS n FROM embeddings WHERE label = 0)
            SELECT 'good' AS kind, CAST(NULL AS VARCHAR) AS score_error, count(*) AS total,
                   CAST(sum(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted FROM vectors
            UNION ALL SELECT 'short', 'ValueError: expected 64 values, found shape (63,)', n, 0 FROM odd
            UNION ALL SELECT 'null', 'no payload', n, 0 FROM odd UNION ALL SELECT 'nan', 'no finite score', n, 0 FROM odd"""
_SCORE_SUMMARY = f"WITH {_SCORED} SELECT {_summary('scored')}"


def oracle_sql() -> dict[str, str]:
    factors = ", ".join(str(f) for f in FACTORS)
    return {
        "score_summary": _SCORE_SUMMARY,
        "label_summary": f"SELECT {_LABELS}, COUNT(*) - COUNT(toxic) AS unlabelled FROM labels",
        "rate_by_source": _rate_sql("source"),
        "rate_by_lang": _rate_sql("lang"),
        "rate_plain_join": _rate_sql("source"),
        "rate_preaggregated": _rate_sql("source", None),
        "rate_labelled_only": _rate_sql("lang"),
        "rate_labelled_filtered": _rate_sql("lang"),
        "rates_by_all": " UNION ALL ".join(
            f"SELECT '{by}' AS attribute, {by} AS value, total, predicted, rate_pct FROM ({_rate_sql(by)})" for by in ("source", "lang")
        ),
        "topk_groups": f"""SELECT source, {_summary("documents", f"{_LINES} > length(text)")}
            GROUP BY source ORDER BY rate_pct DESC, source NULLS FIRST LIMIT 10""",
        "score_column": _SCORE_ROWS,
        "summary_from_store": _SCORE_SUMMARY,
        "rate_from_store": _rate_sql("source"),
        "store_append_new": _SCORE_ROWS,
        "linear_score": f"""WITH {_VECTORS}
            SELECT vec_id, score, score > 0 AS pred, CAST(NULL AS VARCHAR) AS score_error FROM vectors""",
        "linear_rate_by_label": f"""WITH {_VECTORS}
            SELECT label, {_summary("vectors", "score > 0")}
            GROUP BY label ORDER BY rate_pct DESC, label NULLS FIRST LIMIT 10""",
        "linear_file_score": f"""WITH {_VECTORS}
            SELECT vec_id, score, score > 0 AS pred, CAST(NULL AS VARCHAR) AS score_error FROM vectors""",
        "score_errors": _SCORE_ERRORS,
        "score_quarantine": f"""SELECT *, (SELECT count(*) + 3 * count(*) FILTER (WHERE label = 0) FROM embeddings) AS n_rows,
            (SELECT 3 * count(*) FROM embeddings WHERE label = 0) AS n_failed FROM ({_SCORE_ERRORS})""",
        "sql_score_errors": """SELECT length(text) <= 500 AND length(text) > 0 AS pred,
            CASE WHEN length(text) > 500 THEN 'no finite score' END AS score_error, count(*) AS total FROM documents GROUP BY 1, 2""",
        "missing_model": "SELECT FALSE AS pred, 'no model' AS score_error, count(*) AS total FROM embeddings",
        "store_changed_payload": f"""WITH documents AS (SELECT doc_id,
            CASE WHEN lang = 'de' THEN replace(text, ' ', chr(10)) ELSE text END AS text FROM main.documents) {_SCORE_ROWS}""",
        "store_one_percent_changed": f"""WITH documents AS (SELECT doc_id,
            CASE WHEN doc_id % 100 = 0 THEN text || chr(10) || text ELSE text END AS text FROM main.documents), {_SCORED}
            SELECT {_summary("scored").replace("FROM scored", "")}, count(*) FILTER (WHERE doc_id % 100 = 0) AS changed, TRUE AS others_kept
            FROM scored""",
        "rate_from_bucketed_store": _rate_sql("source"),
        "store_other_table": f"{_SCORE_ROWS} WHERE doc_id IN (SELECT doc_id FROM labels)",
        "replicate_counts": """SELECT lang, CAST(c AS INTEGER) AS dup_batch, COUNT(*) AS total,
            CAST(SUM(n_chars) AS BIGINT) AS chars
            FROM documents, (SELECT unnest(range(3)) AS c) GROUP BY lang, c""",
        "replicate_untagged": "SELECT labels.* FROM labels, (SELECT unnest(range(5)) AS c)",
        "union_by_name": """SELECT source, COUNT(*) AS total, CAST(SUM(n_chars) AS BIGINT) AS chars
            FROM (SELECT source, n_chars FROM documents UNION ALL
                  SELECT source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
            GROUP BY source""",
        "score_summary_scales": f"""WITH {_SCORED}, f AS (SELECT unnest([{factors}]) AS factor)
            SELECT CAST(factor AS INTEGER) AS factor,
            {_summary("scored JOIN f ON TRUE JOIN (SELECT unnest(range(100)) AS c) ON c < factor")}
            GROUP BY factor""",
        "label_summary_scales": f"""WITH f AS (SELECT unnest([{factors}]) AS factor)
            SELECT CAST(factor AS INTEGER) AS factor, {_LABELS}
            FROM labels JOIN f ON TRUE JOIN (SELECT unnest(range(100)) AS c) ON c < factor
            GROUP BY factor""",
        "scale_family_counts": f"""WITH f AS (SELECT unnest([{factors}]) AS factor), c AS (SELECT unnest(range(100)) AS c),
            t AS (SELECT 'scored' AS name, doc_id FROM documents UNION ALL SELECT 'documents', doc_id FROM documents
                  UNION ALL SELECT 'labels', doc_id FROM labels)
            SELECT CAST(factor AS INTEGER) AS factor, name, COUNT(*) AS total, CAST(SUM(doc_id + c) AS BIGINT) AS checksum
            FROM t JOIN f ON TRUE JOIN c ON c < factor GROUP BY factor, name""",
        "rate_scales_by_source": _scales_sql("source"),
        "rate_scales_by_lang": _scales_sql("lang"),
        "csv_fraud_predicted": _renamed(_SCORE_SUMMARY, total="total_ids", predicted="fraud_predicted", rate_pct="fraud_rate_percentage"),
        "csv_fraud_ground_truth": _renamed(
            f"SELECT {_LABELS} FROM labels", total="total_ids", positive="total_fraud", negative="total_nonfraud", rate_pct="fraud_percentage"
        ),
        "csv_fraud_by_ethnicity": _renamed(
            _rate_sql("lang"), lang="ethnicity", total="total_customers", predicted="predicted_fraud", rate_pct="fraud_rate_pct"
        ),
        "csv_fraud_by_veteran_status": _renamed(
            _rate_sql("source"), source="is_veteran", total="total_individuals", predicted="predicted_fraud", rate_pct="fraud_rate_pct"
        ),
        "csv_typed_labels": "SELECT doc_id AS id, toxic = 1 AS isfraud FROM labels",
        "csv_lossless_types": """SELECT 'idimage' AS file, 'name' AS "column", 'int' AS type, count(*) AS n_values, 0 AS n_nulls FROM documents
            UNION ALL SELECT 'idimage', 'imageData', 'string', count(nullif(text, '')), count(*) - count(nullif(text, '')) FROM documents
            UNION ALL SELECT 'idlabel', 'id', 'int', count(*), 0 FROM labels
            UNION ALL SELECT 'idlabel', 'isfraud', 'string', count(toxic), count(*) - count(toxic) FROM labels
            UNION ALL SELECT 'idmeta', 'id', 'int', count(*), 0 FROM documents
            UNION ALL SELECT 'idmeta', 'ethnicity', 'string', count(lang), count(*) - count(lang) FROM documents
            UNION ALL SELECT 'idmeta', 'is_veteran', 'string', count(source), count(*) - count(source) FROM documents""",
        "csv_corrupt_rows": """SELECT doc_id % 10 AS kind, doc_id % 10 IN (1, 2, 3) AS damaged, count(*) AS total,
            CAST(sum(n_chars) FILTER (WHERE doc_id % 10 NOT IN (1, 2, 3)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2""",
        "schema_probe": """SELECT table_name, column_name, CAST(0 AS BIGINT) AS n_rows FROM information_schema.columns
            WHERE table_name IN ('documents', 'labels', 'embeddings')""",
        "schema_drift": """SELECT * FROM (VALUES ('doc_id', 'bigint', 3, 0, FALSE), ('lang', 'string', 2, 1, FALSE),
            ('n_chars', 'bigint,string', 3, 0, TRUE)) t("column", types, n_files, n_without, conflict)""",
        "sql_views": f"""WITH {_SCORED}
            SELECT m.lang, COUNT(*) AS total, CAST(SUM(CASE WHEN i.pred THEN 1 ELSE 0 END) AS BIGINT) AS predicted
            FROM scored i JOIN labels l USING (doc_id) JOIN documents m USING (doc_id) GROUP BY m.lang""",
        "sql_scaled_views": f"""WITH {_SCORED}, f AS (SELECT unnest([{factors}]) AS factor), c AS (SELECT unnest(range(100)) AS c),
            t AS (SELECT 'scored' AS name, pred AS hit FROM scored UNION ALL SELECT 'marks', toxic = 1 FROM labels)
            SELECT CAST(factor AS INTEGER) AS factor, name, COUNT(*) AS total, CAST(SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits
            FROM t JOIN f ON TRUE JOIN c ON c < factor GROUP BY factor, name""",
        "rate_scaled_faithful": _scaled_sql(aligned=False),
        "rate_scaled_rows": _scaled_sql(aligned=False),
        "rate_scaled_aligned": _scaled_sql(aligned=True),
        "rate_scaled_100x": _scales_sql("source", (100,), False),
        "label_cast": """SELECT doc_id, label_text,
            CASE WHEN lower(trim(label_text)) IN ('t', 'true', 'y', 'yes', '1') THEN TRUE
                 WHEN lower(trim(label_text)) IN ('f', 'false', 'n', 'no', '0') THEN FALSE END AS flag
            FROM (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN ' True ' WHEN toxic = 1 THEN 'yes'
                                      WHEN quality = 1 THEN 'F' ELSE '1.0' END AS label_text FROM labels)""",
        "payload_decode": """SELECT doc_id, kind,
            CASE WHEN kind IN ('whole', 'unpadded') AND text <> '' THEN CAST(octet_length(encode(text)) AS INTEGER) END AS n_bytes,
            CASE WHEN kind IN ('whole', 'unpadded') AND text <> '' THEN md5(text) END AS digest
            FROM documents, (SELECT unnest(['whole', 'unpadded', 'damaged', 'no-break space']) AS kind)""",
        "sql_score_summary": _SCORE_SUMMARY,
        "sql_label_summary": f"SELECT {_LABELS} FROM labels",
        "sql_rate_by_source": f"SELECT source AS grp, total, predicted, rate_pct FROM ({_rate_sql('source')})",
        "sql_linear_summary": f"WITH {_VECTORS} SELECT {_summary('vectors', 'score > 0')}",
    }
