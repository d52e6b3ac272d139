"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Tokens are lower-cased runs of letters, in pieces of at most `WIDTH` letters. Every `WINDOW`
consecutive tokens, `STRIDE` apart, form a window, the last one ends with the text; the network
(see recurrent.py) gives each window a logit, and a text has the score of its worst window.

The network is trained in NumPy on a bounded, documented sample: of the labelled texts offered, at
most `SAMPLE_TOXIC` toxic and `SAMPLE_CLEAN` others (smallest digests of doc_id), those of at most
`SAMPLE_BYTES` bytes first. Where they are too few, longer ones follow, each by an excerpt of
`SAMPLE_BYTES` / 4 characters from a place given by a digest. So what the driver holds is bounded by
these three numbers. Labels
belong to documents, not to windows: after a first pass over all windows, toxic documents are
represented by their worst window (if it stands out among those of clean ones: labels may be
wrong), others by their worst and random ones. Scoring reads whole
texts of all rows, window by window, and the same model gives the same scores.

Defined results: a text that is NULL or has no letter scores 0; repeated rows give repeated
results; labels that are NULL, or have no document, are not learned from; columns other than
doc_id and text (doc_id and toxic of the labels) are ignored; with no toxic or no other label to
learn from, all scores are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit
from veritally.llm.language_id import letters_of, word_keys
from veritally.llm.recurrent import Adam, Classifier, sigmoid

WINDOW, STRIDE, WIDTH = 32, 16, 16
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 3000, 16384
MIN_DOCS, MIN_SHARE = 4, 0.0075  # documents of the sample, at least, with a word that has a vector of its own
MAX_WORDS = 20_000
CHARS = 192
THRESHOLD = 0.7
CLEAN_SHARE = 0.98  # of clean documents' worst windows, below which a toxic document shows nothing
SEED = 11


class Tokens:
    """Tokens of some texts: row, and number among the distinct ones (keys, chars)."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        parts = [self._piece(text[ends[i] : ends[j]], ends[i : j + 1] - ends[i], i) for i, j in kit.pieces(ends, 1 << 20)]
        if not parts:
            parts = [self._piece(text, ends, 0)]
        row, word, keys, chars = zip(*parts)
        self.row = np.concatenate(row)
        self.keys, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.chars = np.concatenate(chars)[first]
        before = np.cumsum([0, *(len(k) for k in keys)])
        self.word = number[np.concatenate([w + b for w, b in zip(word, before)])]

    @staticmethod
    def _piece(text: np.ndarray, ends: np.ndarray, first_row: int) -> tuple[np.ndarray, ...]:
        """Row and distinct-word number of each token, and keys and characters of the distinct words."""
        points, s, e, row = letters_of(text, ends)
        parts = -(-(e - s) // WIDTH)
        if len(s) and parts.max() > 1:
            place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            s, e, row = np.repeat(s, parts) + place * WIDTH, np.repeat(e, parts), np.repeat(row, parts)
            e = np.minimum(e, s + WIDTH)
        keys, first, word = np.unique(word_keys(points, s, e), return_index=True, return_inverse=True)
        s, e = s[first], e[first]
        at = s[:, None] + np.arange(WIDTH)
        inside = at < e[:, None]
        cp = points[np.minimum(at, max(len(points) - 1, 0))] if len(points) else np.zeros(at.shape, np.uint32)
        return row + first_row, word, keys, np.where(inside, np.where(cp < 128, cp, 128 + cp % 64), 0).astype(np.uint8)

    def windows(self, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows of distinct-token numbers, -1: none) and the row of each."""
        ends = np.searchsorted(self.row, np.arange(n_rows + 1))
        counts = np.diff(ends)
        number = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
        row = np.repeat(np.arange(n_rows), number)
        place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        start = np.maximum(np.minimum(place * STRIDE, counts[row] - WINDOW), 0)
        at = (ends[:-1][row] + start)[:, None] + np.arange(WINDOW)
        inside = at < ends[1:][row][:, None]
        found = np.full(at.shape, -1, np.int32)
        found[inside] = self.word[at[inside]]
        return found, row


class Model:
    def __init__(self, known: np.ndarray, net: Classifier, shift: float):
        self.known, self.net, self.shift = known, net, shift

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == keys, at + 1, 0) if len(self.known) else np.zeros(len(keys), np.int64)

    def score(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        tokens = Tokens(text, ends)
        windows, row = tokens.windows(n)
        out = np.zeros(n)
        if len(row):
            logit = self.net.logits(self.net.vectors(self.numbers(tokens.keys), tokens.chars), windows) + self.shift
            heads = np.flatnonzero(kit.first_true(row))
            out[row[heads]] = sigmoid(np.maximum.reduceat(logit, heads).astype(np.float64))
        return out


def _worst(logits: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Window with the highest logit of each document."""
    order = np.lexsort((logits, row))
    return order[np.append(row[order][1:] != row[order][:-1], True)]


def _draw(rng: np.random.Generator, windows: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Windows of `n` documents drawn alike, whatever their length (`windows` in document order)."""
    heads = np.flatnonzero(kit.first_true(row[windows]))
    sizes = np.diff(np.append(heads, len(windows)))
    doc = rng.integers(0, len(heads), n)
    return windows[heads[doc] + (rng.random(n) * sizes[doc]).astype(np.int64)]


def train(texts: list[str], labels: np.ndarray, rounds: int = 3, steps: int = 100, seed: int = SEED) -> Model | None:
    """A model of documents and their labels (0 or 1); None if a label is missing."""
    column = pa.array(texts, pa.large_string())
    text, ends = kit.flat(column)
    tokens = Tokens(text, ends)
    windows, row = tokens.windows(len(texts))
    labels = np.asarray(labels)
    if not len(row) or len(np.unique(labels[row])) < 2:
        return None
    rng = np.random.default_rng(seed)
    in_docs = np.unique(tokens.row * len(tokens.keys) + tokens.word) % len(tokens.keys)
    n_docs = np.bincount(in_docs, minlength=len(tokens.keys))
    common = np.lexsort((tokens.keys, -n_docs))[:MAX_WORDS]
    known = np.sort(tokens.keys[common[n_docs[common] >= max(MIN_DOCS, MIN_SHARE * len(texts))]])
    net = Classifier(len(known) + 1, CHARS, seed)
    model = Model(known, net, 0.0)
    numbers = model.numbers(tokens.keys)
    optimizer = Adam(net.p, 0.01, decay=0.05)
    toxic, clean = np.flatnonzero(labels[row] == 1), np.flatnonzero(labels[row] == 0)
    hard = clean
    for turn in range(rounds + 1):
        if turn:
            logits = net.logits(net.vectors(numbers, tokens.chars), windows)
            worst = _worst(logits, row)
            hard = worst[labels[row[worst]] == 0]
            # Toxic documents without a window that stands out among clean ones are set aside as mislabelled.
            found = worst[(labels[row[worst]] == 1) & (logits[worst] > np.quantile(logits[hard], CLEAN_SHARE))]
            toxic = found if len(found) else worst[labels[row[worst]] == 1]
            optimizer.rate = 0.01 / (1 + turn)
        for _ in range(steps * (2 if turn == 0 else 1)):
            chosen = np.concatenate([_draw(rng, toxic, row, 96), _draw(rng, clean, row, 96), rng.choice(hard, 64)])
            distinct, inverse = np.unique(windows[chosen], return_inverse=True)
            local = inverse.reshape(len(chosen), WINDOW)
            if distinct[0] < 0:
                distinct, local = distinct[1:], local - 1
            drop = rng.random(len(distinct)) < 0.3  # the characters alone have to do at times
            _, grads = net.gradients(np.where(drop, 0, numbers[distinct]), tokens.chars[distinct], local, labels[row[chosen]].astype(np.float32), np.ones(len(chosen), np.float32))
            optimizer.step(grads)
    # The cut between documents that serves the sample best becomes the threshold score.
    logits = net.logits(net.vectors(numbers, tokens.chars), windows)
    worst = _worst(logits, row)
    at, truth = logits[worst], labels[row[worst]] == 1
    order = np.argsort(-at)
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    k = int(f1.argmax())
    cut = float(at[order[k]] + (at[order[k + 1]] if k + 1 < len(order) else at[order[k]] - 2)) / 2
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return model


def fit(train_docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labelled rows of `train_docs`, from a bounded sample (see the module)."""
    spark = train_docs.sparkSession
    kit.prepare(spark)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    texts = kit.id_and_text(train_docs).where("text IS NOT NULL").withColumn("long", F.octet_length("text") > SAMPLE_BYTES)

    def first(offered: DataFrame, *more: str) -> DataFrame:
        by_digest = lambda value, n: offered.where(F.col("toxic") == value).orderBy("long", F.xxhash64(F.lit(3), "doc_id"), "doc_id", *more).limit(n)
        return by_digest(1, SAMPLE_TOXIC).union(by_digest(0, SAMPLE_CLEAN))

    ids = first(texts.groupBy("doc_id").agg(F.min("long").alias("long")).join(rows.distinct(), "doc_id"))
    ids = F.broadcast(ids.select("doc_id", "toxic"))  # so many at most
    size = SAMPLE_BYTES // 4  # characters, of at most 4 bytes
    places = F.greatest(F.length("text") - size + 1, F.lit(1)).cast("long")
    start = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), places).cast("int") + 1
    excerpt = F.when(F.col("long"), F.substring("text", start, F.lit(size))).otherwise(F.col("text"))
    found = kit.settled(texts.join(ids, "doc_id").select("doc_id", excerpt.alias("text"), "toxic", "long").dropDuplicates())
    sample = first(found, "text").toPandas()  # an id may have any number of texts
    sample = sample.sort_values(["doc_id", "toxic", "text"])
    return train(sample["text"].tolist(), sample["toxic"].to_numpy())


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    spark = docs.sparkSession
    kit.prepare(spark)
    texts = kit.id_and_text(docs)
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch, i, j, text, ends in kit.text_pieces(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.score(text, ends))], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = kit.read_table(spark, sf_dir, "documents"), kit.read_table(spark, sf_dir, "labels")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
