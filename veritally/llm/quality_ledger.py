"""Rule bitmask ledger: every rule is evaluated once per document and kept as one failure bit.

`ledger` reads each text once and returns the measurements and `fail_bits`, in which bit k is set
where rule k fails. A policy is a name and a mask of the rules that it enforces; `apply_policy`
compares mask and bits, so a new policy version costs no second look at a text. `ablations`
counts with bitwise aggregation what each rule of a policy rejects, alone and among others.

Defined results: a NULL text is an empty one (no words: it fails the base rule). A row with a NULL
`doc_id` is measured like any other, repeated rows give repeated ledger rows, other columns of the
input are not looked at, and an empty table gives an empty ledger. Texts are measured whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritally.llm import kit

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def measure_piece(text: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The measurements of each row of `text`, in the order of MEASURES."""
    n = len(ends) - 1
    s, e, row = kit.words(text, ends)
    n_words = np.bincount(row, minlength=n)
    word_chars = kit.row_sums(kit.WORD[text] & _LEAD[text], ends)
    n_symbols = kit.row_sums(_SYMBOL[text], ends)

    salt = kit.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))  # keeps the rows of a piece apart
    ls, le = kit.runs(text != 10, ends)  # lines without any character have no word
    word_count = np.searchsorted(s, le) - np.searchsorted(s, ls)
    ls, le = ls[word_count > 0], le[word_count > 0]
    line_row = kit.rows_of(ls, ends)
    n_lines = np.bincount(line_row, minlength=n)
    keys = kit.span_hashes(text, ls, le) ^ salt[line_row]
    order = np.argsort(keys)
    again = order[~kit.first_true(keys[order])]
    n_dup_lines = np.bincount(line_row[again], minlength=n)

    n_repeat = np.zeros(n, np.int64)
    if len(s) > 2:
        h = kit.span_hashes(text, s, e)
        at = np.flatnonzero(row[2:] == row[:-2])
        three = kit.mix(h[at] * np.uint64(3) + kit.mix(h[at + 1] + h[at + 2] * np.uint64(5)) + salt[row[at]])
        order = np.argsort(three)
        new = kit.first_true(three[order])
        twice = ~new
        twice[:-1] |= twice[1:]  # the first of a group of equal windows as well
        found = at[order[twice]]
        covered = np.zeros(len(s), bool)
        for k in range(3):
            covered[found + k] = True
        n_repeat = np.bincount(row[covered], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines]


def _measure(batches):
    names = ["doc_id", *MEASURES]
    for batch, i, j, text, ends in kit.text_pieces(batches):
        columns = [pa.array(x.astype(np.int64)) for x in measure_piece(text, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=names)


def _rules() -> list[tuple[str, Column]]:
    """Name and failure condition of each rule. The place in the list is the rule's bit: append only."""
    words, c = F.col("n_words"), F.col
    return [
        ("too_few_words", words < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * words),
        ("symbols", 10 * c("n_symbols") > words),
        ("short_words", c("word_chars") < 2 * words),
        ("long_words", c("word_chars") > 20 * words),
        ("duplicate_lines", 100 * c("n_dup_lines") > 50 * c("n_lines")),
        ("too_many_words", words > 1_000_000),
    ]


RULES = ("too_few_words", "repeated_windows", "symbols", "short_words", "long_words", "duplicate_lines", "too_many_words")
BASE = ("too_few_words", "repeated_windows")
#: Versioned policies: the rules that each enforces.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines"),
    "v3": RULES,
}
POLICY = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(_rules()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `fail_bits` of every row of `docs`."""
    kit.prepare(docs.sparkSession)
    measured = kit.id_and_text(docs).mapInArrow(_measure, LEDGER_SCHEMA)
    return measured.withColumn("fail_bits", fail_bits())


def apply_policy(ledger_rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy; base failures are never kept."""
    failed = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(mask_of(rules)).cast("long")) != 0
    return ledger_rows.withColumn("base_failed", failed(BASE)).withColumn(
        "kept", ~failed(tuple(dict.fromkeys((*BASE, *POLICIES[policy]))))
    )


def ablations(ledger_rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: rule, documents that fail it (`n_failed`), that only it rejects
    (`n_only`: kept again without it), and the policy's `n_rejected` and `n_docs`.

    One pass: each document is reduced to its masked bits, and a row per distinct mask (at most
    two to the number of rules) is counted before the rules are taken apart."""
    mask = mask_of(POLICIES[policy])
    counted = (
        ledger_rows.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits"))
        .groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    )
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,))).cast("long").alias("bit")) for r in POLICIES[policy]])
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0).cast("long")))
    return (
        counted.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(F.col("bits") == F.col("bit")).alias("n_only"),
            total(F.col("bits") != 0).alias("n_rejected"),
            F.sum("n").alias("n_docs"),
        )
    )


def passing(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of `docs` that a policy keeps, with all their columns, in one scan."""
    kit.prepare(docs.sparkSession)
    carried = [F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(docs.columns)]
    schema = StructType()
    for k, field in enumerate(docs.schema.fields):
        schema.add(f"carried_{k}", field.dataType)
    for m in MEASURES:
        schema.add(m, "long")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            text, ends = kit.flat(batch.column(at))
            for i, j in kit.pieces(ends):
                found = [pa.array(x.astype(np.int64)) for x in measure_piece(text[ends[i] : ends[j]], ends[i : j + 1] - ends[i])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=schema.names)

    measured = docs.select(*carried).mapInArrow(run, schema).withColumn("fail_bits", fail_bits())
    return apply_policy(measured, policy).where("kept").select(*[F.col(f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(kit.read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


ORACLE_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
word AS (
  SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base),
win AS (
  SELECT rid, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o AS three
  FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (
  SELECT rid, i FROM win WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, three) > 1),
cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
line AS (
  SELECT rid, l FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM line GROUP BY rid),
m AS (
  SELECT b.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(d.n_lines, 0) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN cover c USING (rid) LEFT JOIN dup d USING (rid)),
f AS (
  SELECT *, CAST(
           CASE WHEN n_words < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
         + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
         + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
         + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits
FROM f"""
