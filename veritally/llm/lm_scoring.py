"""Cross-entropy difference of two matched bigram models.

The target model counts the target documents, the background model all documents. They share the
vocabulary (every word of the corpus, and the end of a document), the order and the smoothing, and
are matched in size: background counts are scaled by r = target tokens / background tokens. With
c the (scaled) counts, N the target tokens and V the vocabulary,

    P(w) = (c(w) + 1) / (N + V),   P(w | h) = (c(h w) + MU P(w)) / (c(h) + MU)

and a document's losses are the means of -ln P over its words and its end, each after the word
before it (the first after the start). The score is target loss less background loss: the lower,
the more the document reads like the target.

Counts are exact and cover all documents. A unit (kit) sends each of its distinct words and word
pairs once, with its counts, to the bucket of its hash; the bucket adds up and returns to each
unit the totals of just the keys it sent, so no model is held anywhere as a whole and frequent
words cost a row's share per unit.

Defined results: a NULL text, or one without words, has 0 tokens and NULL losses and counts in
neither model; target ids that are NULL or match no document have no effect, repeated ids count
once; repeated rows are separate documents; without target documents all scores are 0; columns
other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit

MU = 16.0
DIGITS = 6
BUCKET_BYTES = 16 << 20
SENT_SCHEMA = "bucket long, unit long, n long, payload binary"
REPLY_SCHEMA = "unit long, bucket long, n long, payload binary, vocabulary long, background long, target long"
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double"
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


class Tokens:
    """Words and word pairs of a unit as keys: even for words, odd for pairs."""

    def __init__(self, ends: np.ndarray, text: np.ndarray):
        words, rows = [], []
        for i, j in kit.pieces(ends):
            a = ends[i]
            piece = text[a : ends[j]]
            s, e, row = kit.words(piece, ends[i : j + 1] - a)
            words.append(kit.span_hashes(kit.LOWER[piece], s, e))
            rows.append(row + i)
        words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        # An end after the last word of each document that has one.
        last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.zeros(0, np.int64)
        word = np.insert(words, last + 1, kit.mix(np.array([END]))[0])
        self.row = np.insert(rows, last + 1, rows[last])
        first = np.ones(len(word), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[first] = kit.mix(np.array([START]))[0]
        even = np.uint64(0xFFFFFFFFFFFFFFFE)
        self.word = word & even
        self.history = before & even
        self.pair = kit.mix(before * np.uint64(3) + kit.mix(word)) | np.uint64(1)
        # The start is a history, never a word: it is counted once for each document.
        self.keys, place, self.times = np.unique(
            np.concatenate([self.word, self.history[first], self.pair]), return_inverse=True, return_counts=True
        )
        self.place = place
        self.of_all = np.concatenate([self.row, self.row[first], self.row])

    def target_times(self, is_target: np.ndarray) -> np.ndarray:
        return np.bincount(self.place[is_target[self.of_all]], minlength=len(self.keys))


def _bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Byte after byte of all values: small numbers leave planes of zeros."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(body: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, 8 * n * at).reshape(8, n).T).view(np.uint64).reshape(-1)


def _send(n_buckets: int):
    def run(key, unit_table: pa.Table, flag_table: pa.Table) -> pa.Table:
        out = {"bucket": [], "unit": [], "n": [], "payload": []}
        for row in unit_table.to_pylist():
            ids, ends, text = kit.open_unit(row)
            tokens = Tokens(ends, text)
            times = tokens.target_times(np.isin(ids, flag_table["doc_id"].to_numpy()))
            cut = np.searchsorted(_bucket_of(tokens.keys, n_buckets), np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                i, j = cut[b : b + 2]
                keys = tokens.keys[i:j]
                body = _planes(np.diff(keys, prepend=np.uint64(0))) + _planes(tokens.times[i:j]) + _planes(times[i:j])
                for name, value in zip(out, (int(b), row["unit"], int(j - i), pa.compress(body, codec="zstd", asbytes=True))):
                    out[name].append(value)
        return pa.table(out, pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())]))

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of a bucket, returned to each unit in the order in which it sent its keys."""
    keys, background, target = [], [], []
    counts = table["n"].to_numpy()
    for n, payload in zip(counts.tolist(), table["payload"].to_pylist()):
        body = pa.decompress(payload, 24 * n, codec="zstd", asbytes=True)
        keys.append(np.cumsum(_from_planes(body, n, 0)))
        background.append(_from_planes(body, n, 1))
        target.append(_from_planes(body, n, 2))
    keys, background, target = np.concatenate(keys), np.concatenate(background), np.concatenate(target)
    order = np.argsort(keys, kind="stable")
    new = kit.first_true(keys[order])
    heads, number = np.flatnonzero(new), np.cumsum(new) - 1
    sums = [np.add.reduceat(x[order].astype(np.int64), heads) for x in (background, target)]
    start = int(kit.mix(np.array([START]))[0] & np.uint64(0xFFFFFFFFFFFFFFFE))
    is_word = (keys[order][heads] & np.uint64(1) == 0) & (keys[order][heads] != np.uint64(start))
    totals = int(is_word.sum()), int(sums[0][is_word].sum()), int(sums[1][is_word].sum())
    back = []
    for x in sums:
        whole = np.empty(len(keys), np.int64)
        whole[order] = x[number]
        back.append(np.split(whole, np.cumsum(counts)[:-1]))
    payload = [pa.compress(_planes(b) + _planes(t), codec="zstd", asbytes=True) for b, t in zip(*back)]
    once = lambda v: pa.array([v] + [0] * (table.num_rows - 1), pa.int64())
    return pa.table({
        "unit": table["unit"], "bucket": table["bucket"], "n": table["n"], "payload": pa.array(payload, pa.binary()),
        "vocabulary": once(totals[0]), "background": once(totals[1]), "target": once(totals[2]),
    })


def _losses(vocabulary: int, n_background: int, n_target: int):
    scale = n_target / n_background if n_background else 0.0

    def loss(c_word: np.ndarray, c_history: np.ndarray, c_pair: np.ndarray) -> np.ndarray:
        alone = (c_word + 1.0) / (n_target + vocabulary)
        return -np.log((c_pair + MU * alone) / (c_history + MU))

    def run(key, unit_table: pa.Table, reply_table: pa.Table) -> pa.Table:
        (row,) = unit_table.to_pylist()
        ids, ends, text = kit.open_unit(row)
        n = len(ids)
        tokens = Tokens(ends, text)
        background, target = [np.zeros(0)], [np.zeros(0)]
        for reply in sorted(reply_table.to_pylist(), key=lambda r: r["bucket"]):
            body = pa.decompress(reply["payload"], 16 * reply["n"], codec="zstd", asbytes=True)
            background.append(_from_planes(body, reply["n"], 0).astype(np.float64) * scale)
            target.append(_from_planes(body, reply["n"], 1).astype(np.float64))
        at = tokens.place
        m = len(tokens.word)
        word, pair = at[:m], at[len(at) - m :]
        history = np.searchsorted(tokens.keys, tokens.history)
        n_tokens = np.bincount(tokens.row, minlength=n)
        means = []
        for counts in (np.concatenate(target), np.concatenate(background)):
            per_token = loss(counts[word], counts[history], counts[pair]) if m else np.zeros(0)
            with np.errstate(invalid="ignore", divide="ignore"):
                means.append(np.bincount(tokens.row, weights=per_token, minlength=n) / n_tokens)
        none = n_tokens == 0
        return pa.table({
            "doc_id": kit.ids_back(ids), "n_tokens": pa.array(n_tokens.astype(np.int64)),
            "target_loss": pa.array(means[0], pa.float64(), mask=none), "background_loss": pa.array(means[1], pa.float64(), mask=none),
        })

    return run


def _ids(batches):
    for batch in batches:
        for unit, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.frombuffer(ids, np.int64)
            ids = np.unique(ids[ids != kit.NULL_ID])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), unit, np.int64)), pa.array(ids)], names=["unit", "doc_id"])


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss of every row of `docs`. `target_ids` has the
    doc_id of the target documents."""
    kit.prepare(docs.sparkSession)
    units = kit.units(docs)
    n_bytes = units.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = kit.bucket_count(n_bytes, BUCKET_BYTES)
    target = target_ids.select(F.col("doc_id").cast("long").alias("doc_id"))
    flags = units.select("unit", "ids").mapInArrow(_ids, "unit long, doc_id long").join(target, "doc_id", "left_semi").select("unit", "doc_id")
    with_units = lambda other, run, schema: units.groupBy("unit").cogroup(other.groupBy("unit")).applyInArrow(run, schema)
    replies = kit.settled(with_units(flags, _send(n_buckets), SENT_SCHEMA).groupBy("bucket").applyInArrow(_add_up, REPLY_SCHEMA))
    totals = replies.agg(*[F.sum(c) for c in ("vocabulary", "background", "target")]).first()
    return with_units(replies.select("unit", "bucket", "n", "payload"), _losses(*[x or 0 for x in totals]), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = kit.read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rows = score(kit.read_table(spark, sf_dir, "documents"), good)
    return rows.select(
        "doc_id", "n_tokens", F.round("target_loss", DIGITS).alias("target_loss"), F.round("background_loss", DIGITS).alias("background_loss"),
        F.round(F.col("target_loss") - F.col("background_loss"), DIGITS).alias("score"),
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_target,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
t AS (
  SELECT rid, is_target, unnest(list_append(words, ' end')) AS w, unnest(list_prepend(' start', words)) AS h FROM d WHERE len(words) > 0),
uni AS (SELECT w, count(*) AS b, count(*) FILTER (WHERE is_target) AS t FROM t GROUP BY w),
hist AS (SELECT h, count(*) AS b, count(*) FILTER (WHERE is_target) AS t FROM t GROUP BY h),
bi AS (SELECT h, w, count(*) AS b, count(*) FILTER (WHERE is_target) AS t FROM t GROUP BY h, w),
n AS (SELECT count(*) AS v, CAST(sum(b) AS DOUBLE) AS nb, CAST(sum(t) AS DOUBLE) AS nt FROM uni),
p AS (
  SELECT rid,
         -ln((bi.t + {MU} * (uni.t + 1) / (nt + v)) / (hist.t + {MU})) AS lt,
         -ln((bi.b * nt / nb + {MU} * (uni.b * nt / nb + 1) / (nt + v)) / (hist.b * nt / nb + {MU})) AS lb
  FROM t JOIN uni USING (w) JOIN hist USING (h) JOIN bi USING (h, w), n),
s AS (SELECT rid, count(*) AS n_tokens, sum(lt) / count(*) AS lt, sum(lb) / count(*) AS lb FROM p GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, round(lt, {DIGITS}) AS target_loss,
       round(lb, {DIGITS}) AS background_loss, round(lt - lb, {DIGITS}) AS score
FROM d LEFT JOIN s USING (rid)"""
