"""Language identification by words, backing off to shorter and shorter character n-grams.

A word is a maximal run of letters, lower-cased. A known word adds, for each language, the log of
its smoothed frequency there. An unknown word is looked up by its character n-grams (of the word
with a mark at either end), longest first: at the first length with any known n-gram, the mean log
frequency of those known is added. A text's language has the highest sum (ties: the first by
name); the score is its posterior when every language is as likely beforehand.

The model is fitted on a bounded, documented sample: of the rows offered, about `sample_rows` by a
digest of doc_id, all words of each; every language has the same share of them, or all its rows if
those are fewer (others then have more). Of what occurs `MIN_COUNT` times, the model keeps per length
`MAX_ENTRIES` words or n-grams (fewer where these times the languages are over `MAX_VALUES`), those
with the highest frequency within any one language first. So the broadcast model is bounded by
those parameters, whatever the number of languages. Scoring covers whole texts of all rows.

Defined results: a text that is NULL or has no letter is `und` with score 0; a NULL doc_id counts
as the empty string for the hold-out; repeated rows give repeated results; rows without a language
are not learned from; columns other than doc_id, text and lang are ignored; with nothing to learn
from, every text is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)
SAMPLE_ROWS = 20_000
MIN_COUNT = 2
MAX_ENTRIES = 200_000
MAX_VALUES = 1 << 22  # of one table: entries times languages
MARK = 1  # stands at both ends of a word; no letter
SCHEMA = "doc_id long, lang_pred string, score double"

_letters: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Is a letter, and lower case, by code point."""
    if not _letters:
        points = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
        _letters.append(np.array([c.isalpha() for c in points]))
        _letters.append(np.array([ord(c.lower()[0]) for c in points], np.uint32))
    return _letters[0], _letters[1]


def letters_of(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of the rows, and start, end and row of each word."""
    lead = (text & 0xC0) != 0x80
    points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    point_ends = np.concatenate([[0], np.cumsum(lead)])[ends]
    letter, lower = _tables()
    s, e = kit.runs(letter[points], point_ends)
    return lower[points], s, e, kit.rows_of(s, point_ends)


def _fold(points: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` code points from each start."""
    h = np.full(len(starts), length, np.uint64)
    for k in range(length):
        h = (h ^ points[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def word_keys(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One key per distinct word, whatever its length."""
    up = np.uint64(0x100000001B3)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), up, np.uint64)]))
    inverse = np.uint64(pow(int(up), -1, 2**64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), inverse, np.uint64)]))
    mixed = kit.mix(points.astype(np.uint64) + np.uint64(77))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers[:-1])])
    return kit.mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))


def marked(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, each between two marks; their end offsets."""
    sizes = e - s + 2
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(ends[-1], MARK, np.uint32)
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    inner = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    out[inner] = points[(np.repeat(s, sizes) + place - 1)[inner]]
    return out, ends


def grams(points: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and word number of each n-gram that lies in one word and is not all marks."""
    sizes = np.diff(ends)
    at = np.arange(len(points))
    word = np.repeat(np.arange(len(sizes)), sizes)
    keep = at + length <= ends[1:][word]
    if length == 1:
        keep &= points != MARK
    at = at[keep]
    return _fold(points, at, length), word[keep]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each distinct key, and each key's place among those."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first, inverse


def _counts(batches):
    """Counts of words (length 0) and n-grams by language."""
    for batch, i, j, text, ends in kit.text_pieces(batches, 1 << 22):
        lang = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
        names, lang_no = np.unique(lang.astype(str), return_inverse=True)
        points, s, e, row = letters_of(text, ends)
        all_keys = word_keys(points, s, e)
        for no, name in enumerate(names):
            mine = lang_no[row] == no
            keys = all_keys[mine]
            if not len(keys):
                continue
            first, inverse = _distinct(keys)
            times = np.bincount(inverse)
            laid, laid_ends = marked(points, s[mine][first], e[mine][first])
            found = [(0, keys[first], times)]
            for n in LENGTHS:
                g, word = grams(laid, laid_ends, n)
                g_keys, g_inverse = np.unique(g, return_inverse=True)
                found.append((n, g_keys, np.bincount(g_inverse, weights=times[word], minlength=len(g_keys)).astype(np.int64)))
            for n, k, c in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array([str(name)] * len(k), pa.string()), pa.array(c.astype(np.int64))],
                    names=["length", "key", "lang", "n"],
                )


class Model:
    """Sorted keys and log frequencies (rows: keys, columns: languages) of words and n-grams."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def find(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if unknown."""
        known = self.tables[length][0]
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def word_scores(self, points: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Log frequencies of words by the longest level that knows them."""
        at = self.find(0, keys)
        out = np.zeros((len(s), len(self.langs)), np.float64)
        out[at >= 0] = self.tables[0][1][at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for n in LENGTHS:
            if not len(rest):
                break
            laid, ends = marked(points, s[rest], e[rest])
            g, word = grams(laid, ends, n)
            g_at = self.find(n, g)
            word, g_at = word[g_at >= 0], g_at[g_at >= 0]
            hits = np.bincount(word, minlength=len(rest))
            for c in range(len(self.langs)):
                sums = np.bincount(word, weights=self.tables[n][1][g_at, c], minlength=len(rest))
                out[rest, c] = np.where(hits > 0, sums / np.maximum(hits, 1), 0.0)
            rest = rest[hits == 0]
        return out

    def predict(self, text: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(ends) - 1
        points, s, e, row = letters_of(text, ends)
        if not len(s) or not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        keys = word_keys(points, s, e)
        first, inverse = _distinct(keys)
        per_word = self.word_scores(points, s[first], e[first], keys[first])
        sums = np.stack([np.bincount(row, weights=per_word[inverse, c], minlength=n) for c in range(len(self.langs))], 1)
        best = sums.argmax(1)
        with np.errstate(under="ignore"):
            score = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        has = np.bincount(row, minlength=n) > 0
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of `train` (doc_id, text, lang), from about `sample_rows` of its rows."""
    kit.prepare(train.sparkSession)
    rows = kit.id_and_text(train, F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    n_rows = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share, left, limits = 1 << 40, sample_rows, []
    for k, (name, n) in enumerate(sorted(n_rows.items(), key=lambda x: (x[1], x[0]))):
        quota = min(n, max(left / (len(n_rows) - k), 1))
        left -= quota
        limits += [F.lit(name), F.lit(int(share * quota / n))]
    limit = F.create_map(*limits)[F.col("lang")] if limits else F.lit(0)
    part = F.pmod(F.xxhash64(F.lit(7), F.coalesce("doc_id", F.lit(-1).cast("long"))), F.lit(share))
    sample = rows.where(part < limit)
    counted = (
        sample.select("doc_id", "text", "lang").mapInArrow(_counts, "length int, key long, lang string, n long")
        .groupBy("length", "key", "lang").agg(F.sum("n").alias("n"))
    )
    counted = kit.settled(counted)
    langs = sorted(r["lang"] for r in counted.where("length = 1").select("lang").distinct().collect())
    total = {(r["length"], r["lang"]): (r["n"], r["keys"]) for r in counted.groupBy("length", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys")).collect()}
    tables = {}
    for length in (0, *LENGTHS):
        by_key = counted.where(F.col("length") == length).groupBy("key").agg(
            F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"l{c}") for c, name in enumerate(langs)]
        ).where(F.col("all") >= MIN_COUNT)
        shares = [F.col(f"l{c}") / F.lit(float(max(total.get((length, name), (0, 0))[0], 1))) for c, name in enumerate(langs)]
        top = by_key.orderBy(F.greatest(*shares, F.lit(0.0), F.lit(0.0)).desc(), F.col("all").desc(), "key").limit(min(MAX_ENTRIES, MAX_VALUES // max(len(langs), 1))).toPandas()
        keys = top["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        counts = top[[f"l{c}" for c in range(len(langs))]].to_numpy(np.float64)[order] if langs else np.zeros((len(keys), 0))
        alike = float(len(keys) + 1)
        whole = np.array([total.get((length, name), (0, 0))[0] for name in langs], np.float64)
        tables[length] = (keys[order], np.log((counts + 0.5) / (whole + 0.5 * alike)) if langs else counts)
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of `docs`."""
    spark = docs.sparkSession
    kit.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch, i, j, text, ends in kit.text_pieces(batches):
            lang, score = shared.value.predict(text, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return kit.id_and_text(docs).mapInArrow(run, SCHEMA)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
