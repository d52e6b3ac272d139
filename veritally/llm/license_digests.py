"""Licence scan by canonical digest lookup.

The canonical form of a line: lower case, every run of characters other than letters and digits
one space, equivalent spellings made one; copyright lines and "all rights reserved" are dropped.
The canonical form of a text is its canonical lines in order, so line breaks do not matter.
`scan` digests the entire text and each line of it (licence notices are lines of their own) and
hash-joins the digests to those of the known licences, which go through the same expressions.
All of it is built-in expressions; one row per document leaves the scan, after a map-side
reduction of its digests.

Defined results: a text that is NULL or has no letter or digit has a NULL digest and matches
nothing; each row of the input, repeated or with a NULL doc_id, gives a row; of several licences
with the same canonical text the first by name is given; columns other than doc_id and text are
ignored. Whole texts and whole lines are digested, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit
from veritally.llm.license_texts import SPELLINGS, TEXTS

COPYRIGHT_LINE = r"^[\s#*/;-]*(copyright|\(c\)|©)"
RESERVED = "all rights reserved"


def canonical_line(line: Column) -> Column:
    """Canonical words of a line; empty for copyright lines."""
    low = F.lower(line)
    words = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    for other, one in SPELLINGS:
        words = F.replace(words, F.lit(other), F.lit(one))
    return F.when(low.rlike(COPYRIGHT_LINE) | (words == RESERVED), F.lit("")).otherwise(words)


def canonical_lines(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)
    return F.filter(lines, lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_licenses(spark: SparkSession, texts=TEXTS) -> DataFrame:
    """digest, license_id of known texts: pairs of license_id and text, or a table of these columns, of
    any size. Texts of one digest go by the first license_id."""
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts), "license_id string, text string")
    whole = digest(F.array_join(canonical_lines(F.col("text")), " "))
    return rows.select(whole.alias("digest"), "license_id").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (of the entire text), n_notices (lines that are a known text) and
    notices (their licences, sorted, comma-separated; NULL if none) of every row of `docs`."""
    lines = kit.id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_key"), canonical_lines(F.col("text")).alias("lines"))
    units = lines.select(
        "doc_id", "text_key",
        F.explode(F.concat(
            F.array(F.struct(F.lit(True).alias("whole"), digest(F.array_join("lines", " ")).alias("digest"))),
            F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest"))),
        )).alias("u"),
    ).select("doc_id", "text_key", "u.whole", "u.digest")
    found = units.join(known, "digest", "left")
    whole, notice = F.col("whole"), ~F.col("whole") & F.col("license_id").isNotNull()
    one = lambda when: F.sum(F.when(when, F.lit(1)).otherwise(F.lit(0)))
    per_text = found.groupBy("doc_id", "text_key").agg(
        one(whole).alias("copies"),
        F.min(F.when(whole, F.col("digest"))).alias("digest"),
        F.min(F.when(whole, F.col("license_id"))).alias("license_id"),
        one(notice).alias("notice_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(notice, F.col("license_id")))), ",").alias("notices"),
    )
    # Repeated rows met in one group: give each its row again.
    return per_text.select(
        "doc_id", "digest", "license_id", (F.col("notice_lines") / F.col("copies")).cast("long").alias("n_notices"),
        F.when(F.col("notices") != "", F.col("notices")).alias("notices"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The known texts are a fixed list of this package: small enough to broadcast.
    return scan(kit.read_table(spark, sf_dir, "documents"), F.broadcast(known_licenses(spark)))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_words(line: str) -> str:
    words = rf"trim(regexp_replace(lower({line}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for other, one in SPELLINGS:
        words = f"replace({words}, {_sql_text(other)}, {_sql_text(one)})"
    return words


def oracle(documents: str = "documents") -> str:
    known = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in TEXTS)
    lines = f"""SELECT @key, n, CASE WHEN regexp_matches(lower(l), {_sql_text(COPYRIGHT_LINE)}) OR words = '{RESERVED}' THEN '' ELSE words END AS words
  FROM (SELECT *, {_sql_words('l')} AS words FROM (
    SELECT @key, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM @table))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {documents}),
k AS (SELECT row_number() OVER () AS kid, license_id, text FROM (VALUES {known}) v(license_id, text)),
kl AS ({lines.replace("@key", "kid").replace("@table", "k")}),
known AS (
  SELECT sha256(canon) AS digest, min(license_id) AS license_id
  FROM (SELECT kid, string_agg(words, ' ' ORDER BY n) AS canon FROM kl WHERE words <> '' GROUP BY kid) JOIN k USING (kid) GROUP BY 1),
dl AS (SELECT * FROM ({lines.replace("@key", "rid").replace("@table", "d")}) WHERE words <> ''),
whole AS (SELECT rid, sha256(string_agg(words, ' ' ORDER BY n)) AS digest FROM dl GROUP BY rid),
notice AS (
  SELECT rid, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM dl JOIN known ON sha256(words) = known.digest GROUP BY rid)
SELECT d.doc_id, whole.digest, known.license_id, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices, notices
FROM d LEFT JOIN whole USING (rid) LEFT JOIN known USING (digest) LEFT JOIN notice USING (rid)"""


ORACLE_SQL = oracle()
