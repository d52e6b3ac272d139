"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII bytes, so punctuation does not
hide a match. Documents and test items are first joined on shared seeds of `SEED` words. A pair
goes on only if the item words under its shared seeds could reach the coverage threshold: every
tile has `SEED` words or more and so consists of shared seeds, which makes this an upper bound and
loses no pair. Then tiles are placed: the longest match between unmarked words of the document and
unmarked words of the item is marked in both, again and again, until none has `SEED` words. A
candidate length is searched by running Karp-Rabin hashes over the unmarked words and confirmed on
the words themselves. The coverage of an item is the share of its words under tiles, so an
item whose sentences were reordered is still covered; a document is contaminated if it covers
`COVERAGE` of any item, or one tile alone has `LONG_TILE` words of it.

The items are a stated query set. Spark deals them into blocks of about `BLOCK_WORDS` words by a hash;
one block at a time is read, broadcast and, when the hits of the documents with it are written,
released, so the driver and a worker hold one block however many items there are. The documents
are scanned once for each block, without a shuffle.

Defined results: NULL or empty texts match nothing and are kept; items with fewer than `SEED`
words, NULL items and empty benchmarks match nothing; items with equal texts are separate items;
repeated documents are judged each for itself, also with a NULL doc_id; columns other than doc_id and text
(item_id and text of the benchmark) are ignored. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit

SEED = 5
COVERAGE = 0.5
LONG_TILE = 24
BLOCK_WORDS = 1 << 20
SCHEMA = "doc_id long, digest long, items array<long>, best_coverage double, longest_tile long"

_PART = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _PART[_low : _high + 1] = True
_BASE = 1_000_003


def word_hashes(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and end offsets of the rows in words."""
    s, e = kit.runs(_PART[text], ends)
    return kit.span_hashes(kit.LOWER[text], s, e), np.searchsorted(s, ends)


def seed_hashes(h: np.ndarray, size: int = SEED) -> np.ndarray:
    """Hash of the `size` words that start at each word; shorter rests have none."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = out * np.uint64(0x100000001B3) + h[k : len(h) - size + 1 + k]
    return kit.mix(out)


class Items:
    """A block of test items, ready to be matched."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        column = pa.array([t or "" for t in texts], pa.large_string())
        h, ends = word_hashes(*kit.flat(column))
        self.words = [h[a:b] for a, b in zip(ends[:-1], ends[1:])]
        seeds = [seed_hashes(w) for w in self.words]
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = np.repeat(np.arange(len(ids)), [len(x) for x in seeds])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in seeds])[order] if seeds else flat.astype(np.int64)
        self.known = np.unique(self.seeds)


def _open_runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _windows(ints: list[int], open_runs: list[tuple[int, int]], size: int):
    """(running hash, start) of each window of `size` unmarked words."""
    drop = pow(_BASE, size, 1 << 64)
    for a, b in open_runs:
        if b - a < size:
            continue
        h = 0
        for k in range(a, b):
            h = (h * _BASE + ints[k]) & 0xFFFFFFFFFFFFFFFF
            if k - a >= size:
                h = (h - ints[k - size] * drop) & 0xFFFFFFFFFFFFFFFF
            if k - a >= size - 1:
                yield h, k - size + 1


def tile(item: np.ndarray, doc: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), longest first; ties go to the first in
    the item, then to the first in the document."""
    a, b = item.tolist(), doc.tolist()
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles = []

    def matches(size: int, first_only: bool) -> list[tuple[int, int]]:
        found: dict[int, list[int]] = {}
        for h, i in _windows(a, _open_runs(marked_a), size):
            found.setdefault(h, []).append(i)
        out = []
        if found:
            for h, j in _windows(b, _open_runs(marked_b), size):
                for i in found.get(h, ()):
                    if a[i : i + size] == b[j : j + size]:
                        if first_only:
                            return [(i, j)]
                        out.append((i, j))
        return sorted(out)

    top = min(len(a), len(b))
    while top >= shortest:
        low, high = shortest - 1, top  # a match of a length holds matches of every shorter one
        while low < high:
            size = (low + high + 1) // 2
            if matches(size, True):
                low = size
            else:
                high = size - 1
        if low < shortest:
            break
        for i, j in matches(low, False):
            if not marked_a[i : i + low].any() and not marked_b[j : j + low].any():
                marked_a[i : i + low] = True
                marked_b[j : j + low] = True
                tiles.append((i, j, low))
        top = low - 1  # each match of this length is now marked or touches a mark
    return tiles


def _near(doc: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Only the words of the document that a shared seed covers, cut from one another: no tile
    reaches outside, so tiling these is tiling the document."""
    covered = np.zeros(len(doc) + 1, bool)
    for k in range(SEED):
        covered[hits + k] = True
    covered = covered[:-1]
    pieces, at = [], 0
    for a, b in _open_runs(~covered):
        pieces.append(doc[a:b])
        at += 1
        pieces.append(np.array([at], np.uint64))  # a word that no item has
    return np.concatenate(pieces)


def judge(doc: np.ndarray, hits: np.ndarray, seeds: np.ndarray, items: Items) -> tuple[list[int], float, int]:
    """Items that a document covers, its best coverage and its longest tile."""
    left = np.searchsorted(items.seeds, np.unique(seeds), "left")
    right = np.searchsorted(items.seeds, np.unique(seeds), "right")
    rows = np.concatenate([np.arange(a, b) for a, b in zip(left, right)])
    covered, best, longest = [], 0.0, 0
    near = None
    for k in np.unique(items.owner[rows]):
        words = items.words[k]
        under = np.zeros(len(words), bool)
        for p in items.place[rows[items.owner[rows] == k]]:
            under[p : p + SEED] = True
        bound = int(under.sum())
        if bound < COVERAGE * len(words) and bound < LONG_TILE:
            continue
        if near is None:
            near = _near(doc, hits)
        tiles = tile(words, near)
        share = sum(t[2] for t in tiles) / len(words)
        long_one = max((t[2] for t in tiles), default=0)
        best, longest = max(best, share), max(longest, long_one)
        if share >= COVERAGE or long_one >= LONG_TILE:
            covered.append(items.ids[k])
    return covered, best, longest


def _piece_results(text: np.ndarray, ends: np.ndarray, items: Items) -> dict[int, tuple]:
    """What `judge` finds for each row of some texts that has any tile."""
    h, word_ends = word_hashes(text, ends)
    seeds = seed_hashes(h)
    if not len(items.known) or not len(seeds):
        return {}
    at = np.minimum(np.searchsorted(items.known, seeds), len(items.known) - 1)
    hit = np.flatnonzero(items.known[at] == seeds)
    row = kit.rows_of(hit, word_ends)
    inside = hit + SEED <= word_ends[row + 1]  # seeds do not cross documents
    hit, row = hit[inside], row[inside]
    results = {}
    for r in np.unique(row):
        a, b = word_ends[r], word_ends[r + 1]
        mine = hit[row == r]
        result = judge(h[a:b], mine - a, seeds[mine], items)
        if result[2]:
            results[int(r)] = result
    return results


def _matcher(shared):
    def run(batches):
        for batch, i, j, text, ends in kit.text_pieces(batches):
            results = _piece_results(text, ends, shared.value)
            if results:
                rows = pa.array([i + r for r in results])
                covered, best, longest = zip(*results.values())
                columns = [
                    batch.column(0).take(rows), batch.column(2).take(rows), pa.array(covered, pa.list_(pa.int64())),
                    pa.array(best, pa.float64()), pa.array(longest, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "items", "best_coverage", "longest_tile"])

    return run


def _filter(shared, at: int):
    """Rows, with all columns, whose text in column `at` covers no item of the block."""

    def run(batches):
        for batch in batches:
            text, ends = kit.flat(batch.column(at))
            keep = np.ones(batch.num_rows, bool)
            for i, j in kit.pieces(ends):
                results = _piece_results(text[ends[i] : ends[j]], ends[i : j + 1] - ends[i], shared.value)
                for r, (covered, _, _) in results.items():
                    keep[i + r] = not covered
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(benchmark: DataFrame, block_words: int | None = None) -> tuple[DataFrame, int]:
    """item_id, text and block of every item, and the number of blocks."""
    words = F.coalesce(F.size(F.split("text", r"\s+")), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(words)).first()[0] or 0
    n_blocks = max(1, -(-total // (block_words or BLOCK_WORDS)))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), n_blocks


def _with_block(spark: SparkSession, items: DataFrame, k: int):
    rows = items.where(F.col("block") == k).collect()  # one block
    return spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows]))


def _hits(texts: DataFrame, items: DataFrame, n_blocks: int) -> DataFrame:
    """What the blocks find in doc_id, text and digest of the documents."""
    spark, found = texts.sparkSession, None
    for k in range(n_blocks):
        shared = _with_block(spark, items, k)
        hits = texts.select("doc_id", "text", "digest").mapInArrow(_matcher(shared), SCHEMA)
        if n_blocks > 1:
            hits = kit.settled(hits)
            shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def uncontaminated(docs: DataFrame, benchmark: DataFrame, block_words: int | None = None) -> DataFrame:
    """The rows of `docs` that cover no item, with all their columns; in one scan if the items are one
    block."""
    spark = docs.sparkSession
    kit.prepare(spark)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(docs.columns)])
    back = [F.col(f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)]
    items, n_blocks = item_blocks(benchmark, block_words)
    if n_blocks == 1:
        shared = _with_block(spark, items, 0)
        return rows.mapInArrow(_filter(shared, docs.columns.index("text")), rows.schema).select(*back)
    texts = kit.id_and_text(docs).withColumn("digest", F.xxhash64("text"))
    covered = _hits(texts, items, n_blocks).where(F.size("items") > 0).select(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest")).distinct()
    carried = {c: f"carried_{k}" for k, c in enumerate(docs.columns)}
    same = F.col(carried["doc_id"]).cast("long").eqNullSafe(F.col("found_id")) & (F.xxhash64(F.col(carried["text"]).cast("string")) == F.col("found_digest"))
    return rows.join(covered, same, "left_anti").select(*back)


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int | None = None) -> DataFrame:
    """doc_id, items (sorted ids of the covered items), best_coverage and longest_tile of every row."""
    kit.prepare(docs.sparkSession)
    texts = kit.id_and_text(docs).withColumn("digest", F.xxhash64("text"))
    found = _hits(texts, *item_blocks(benchmark, block_words))
    # Equal rows have equal matches, so id and digest name them.
    per_text = found.groupBy(F.col("doc_id").alias("found_id"), F.col("digest").alias("found_digest")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("best_coverage").alias("best_coverage"), F.max("longest_tile").alias("longest_tile"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("digest") == F.col("found_digest"))
    return texts.select("doc_id", "digest").join(per_text, same, "left").select(
        "doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("best_coverage", F.lit(0.0)).alias("best_coverage"),
        F.coalesce("longest_tile", F.lit(0).cast("long")).alias("longest_tile"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: kit.read_table(spark, sf_dir, name)
    return contamination(read("documents"), read("benchmark")).select(
        "doc_id", F.size("items").cast("long").alias("n_items"), (F.size("items") == 0).alias("kept"),
        "items", "best_coverage", "longest_tile",
    )
