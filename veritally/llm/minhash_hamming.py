"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search.

A document's set is its distinct 5-word shingles (A-Z lower-cased). Documents with 100 |A n B| >=
75 |A u B| are linked; components of links are groups, and the smallest doc_id stays.

1. One scan gives each document a 128-bit digest of its set and `SLOTS` MinHash values of 16 bits.
   Documents with equal sets are one class; only classes are compared (copies never make pairs).
2. The first `CHUNKS * 3` slots are split into chunks of three. Two signatures that differ in at
   most 2 * CHUNKS - 1 of those slots have, by pigeonhole, a chunk with at most one error, so every
   chunk is indexed under the three ways to leave one slot out: such pairs always share a key. At
   the threshold similarity a pair exceeds that distance with a probability below 1e-6.
3. Stars first: in each key, every class is compared with one centre (the class with most copies),
   a row per class and key. Components of these links leave most keys with one component. Only
   classes of one key that are still in different components are then compared with one another.
   In both steps a pair must pass three tests inside the join: the sizes allow the threshold, the
   2-bit values of all slots differ in at most `MAX_FAR` slots, and the `PARITY` parity bits of
   the sets differ in no more places than the sets may differ in shingles (an exact bound, sharp
   for sets up to about that size). What passes is close to the threshold or above it, so large
   groups of copies and near copies leave rows in proportion to their size.
4. Each candidate pair is confirmed on the full shingle sets before it becomes a link. Between two
   components the nearest pair is confirmed first, the others only if that did not join them.

Links, components and sets stay distributed; intermediate tables are checkpoints.

Defined results: a NULL or empty text, or one without words, has an empty set and is linked with
nothing; with fewer than five words the whole sequence is the only shingle; a NULL doc_id is in no
group (component NULL) and kept; rows that share doc_id and text stand in one group and are kept
or dropped together; columns other than doc_id and text are ignored. Whole texts are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit

SHINGLE = 5
PERCENT = 75
SLOTS = 64
CHUNKS = 12
PARITY = 1024  # parity bits of a set
MAX_FAR = 29  # of 64 slots; at the threshold 12 are expected, more than 29 have a chance of 1e-7
MARKS = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, low array<long>, parity array<long>"

_rng = np.random.default_rng(75)
_MULTIPLY = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64)


def shingles(text: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the distinct shingles of each row, row by row."""
    s, e, row = kit.words(text, ends)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = kit.span_hashes(kit.LOWER[text], s, e)
    word_ends = np.searchsorted(row, np.arange(len(ends)))
    counts = np.diff(word_ends)
    at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = kit.mix(out * np.uint64(3) + h[at + k])
    out_row = row[at]
    short = np.flatnonzero((counts > 0) & (counts < size))  # the whole sequence is one shingle
    whole = np.zeros(len(short), np.uint64)
    for i, r in enumerate(short):
        x = np.array([counts[r]], np.uint64)
        for w in h[word_ends[r] : word_ends[r + 1]]:
            x = kit.mix(x * np.uint64(3) + w)
        whole[i] = x[0]
    if len(short):
        out, out_row = np.concatenate([out, whole]), np.concatenate([out_row, short])
    apart = kit.mix(out ^ kit.mix(out_row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(apart)
    keep = np.zeros(len(out), bool)
    keep[order[kit.first_true(apart[order])]] = True
    out, out_row = out[keep], out_row[keep]
    if len(short):
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return out, out_row


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16-bit MinHash slots of the runs of `h` that begin at `starts`."""
    out = np.empty((len(starts), SLOTS), np.uint16)
    for k in range(SLOTS):
        low = np.minimum.reduceat((h ^ _XOR[k]) * _MULTIPLY[k], starts)
        out[:, k] = (kit.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _packed_low(sig: np.ndarray) -> np.ndarray:
    """The low two bits of all slots, 32 slots to a long."""
    two = (sig & 3).astype(np.uint64)
    shift = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.stack([(two[:, a : a + 32] << shift).sum(1, dtype=np.uint64) for a in range(0, SLOTS, 32)], 1)


def _parity(h: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
    """Per row, PARITY bits: how often a shingle falls on the bit, odd or even."""
    n = len(row_ends) - 1
    out = np.zeros((n, PARITY // 64), np.int64)
    for a in range(0, n, 512):
        b = min(a + 512, n)
        part = h[row_ends[a] : row_ends[b]]
        row = np.repeat(np.arange(b - a), np.diff(row_ends[a : b + 1]))
        odd = np.bincount(row * PARITY + (kit.mix(part) & np.uint64(PARITY - 1)).astype(np.int64), minlength=(b - a) * PARITY) & 1
        out[a:b] = np.packbits(odd.astype(bool).reshape(b - a, PARITY), axis=1).view(np.int64)
    return out


def _longs(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))


def _mark(batches):
    names = ["doc_id", "n_shingles", "k1", "k2", "sig", "low", "parity"]
    for batch, i, j, text, ends in kit.text_pieces(batches):
        n = j - i
        h, row = shingles(text, ends)
        sizes = np.bincount(row, minlength=n)
        row_ends = np.concatenate([[0], np.cumsum(sizes)])
        keys = _set_keys(h, row_ends)
        sig = np.zeros((n, SLOTS), np.uint16)
        full = np.flatnonzero(sizes)
        if len(full):
            sig[full] = signatures(h, row_ends[full])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(i, n), pa.array(sizes.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]),
                pa.array([x.tobytes() for x in sig], pa.binary()), _longs(_packed_low(sig)), _longs(_parity(h, row_ends)),
            ],
            names=names,
        )


def _chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: per chunk, the three ways to leave a slot out."""
    out = np.empty((len(sig), CHUNKS * 3), np.uint64)
    wide = sig.astype(np.uint64)
    for c in range(CHUNKS):
        for k, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
            out[:, 3 * c + k] = kit.mix((wide[:, 3 * c + a] << np.uint64(16) | wide[:, 3 * c + b]) + np.uint64((3 * c + k + 1) << 32))
    return out


def _signature_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    raw, _ = kit.flat(batch.column(batch.schema.names.index(name)))
    return np.frombuffer(raw.tobytes(), np.uint16).reshape(-1, SLOTS)


def _index(batches):
    """(key, cid, copies) for every class and key."""
    for batch in batches:
        keys = _chunk_keys(_signature_column(batch, "sig")).reshape(-1).view(np.int64)
        repeat = np.repeat(np.arange(batch.num_rows), CHUNKS * 3)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), batch.column(0).take(pa.array(repeat)), batch.column(1).take(pa.array(repeat))], names=["key", "cid", "copies"]
        )


def _set_keys(h: np.ndarray, row_ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each row's set; the order of the set does not matter."""
    keys = []
    for salt in (11, 22):
        total = np.concatenate([[np.uint64(0)], np.cumsum(kit.mix(h ^ kit.mix(np.array([salt], np.uint64))))])
        keys.append((total[row_ends[1:]] - total[row_ends[:-1]]).view(np.int64))
    return keys


def _sets(batches):
    """(cid, shingles) of the rows whose text has the set of their class: an id may be repeated."""
    for batch, i, j, text, ends in kit.text_pieces(batches):
        h, row = shingles(text, ends)
        row_ends = np.searchsorted(row, np.arange(j - i + 1))
        k1, k2 = _set_keys(h, row_ends)
        right = (k1 == batch.column(3).slice(i, j - i).to_numpy()) & (k2 == batch.column(4).slice(i, j - i).to_numpy())
        column = pa.ListArray.from_arrays(pa.array(row_ends.astype(np.int32)), pa.array(h.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), column], names=["cid", "shingles"]).filter(pa.array(right))


def components(edges: DataFrame) -> DataFrame:
    """node, comp of every node of the edges (a, b): comp is the smallest node reachable."""
    both = kit.settled(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = kit.settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hop = label.join(near, "node").select("node", F.least("comp", "near").alias("hop"), F.col("comp").alias("old"))
        roots = label.select(F.col("node").alias("hop"), F.col("comp").alias("root"))
        moved = kit.settled(hop.join(roots, "hop").select("node", F.least("hop", "root").alias("comp"), "old"))
        label = moved.select("node", "comp")
        if moved.where(F.col("comp") != F.col("old")).isEmpty():
            return label


LOWS = tuple(f"low{k}" for k in range(SLOTS // 32))
PARITIES = tuple(f"parity{k}" for k in range(PARITY // 64))


def far_bits(side_a: str, side_b: str, names: tuple[str, ...], pairs: bool = False) -> Column:
    """Bits, or pairs of bits, in which the longs of two classes differ. The longs are columns of
    their own: a join that looks at very many pairs reads them without going through an array."""
    odd, total = F.lit(0x5555555555555555).cast("long"), None
    for name in names:
        d = F.col(f"{name}_{side_a}").bitwiseXOR(F.col(f"{name}_{side_b}"))
        n = F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(odd)) if pairs else F.bit_count(d)
        total = n if total is None else total + n
    return total


def may_link(a: str, b: str) -> Column:
    """Whether the traits of two classes leave the threshold open."""
    x, y = F.col(f"n_{a}"), F.col(f"n_{b}")
    # (100 - PERCENT) (x + y) / (100 + PERCENT) shingles may be in one of the sets only.
    return (
        (100 * F.least(x, y) >= PERCENT * F.greatest(x, y))
        & (far_bits(a, b, LOWS, pairs=True) <= MAX_FAR)
        & ((100 + PERCENT) * far_bits(a, b, PARITIES) <= (100 - PERCENT) * (x + y))
    )


def confirmed(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    of = lambda side: sets.select(F.col("cid").alias(side), F.col("shingles").alias(f"set_{side}"))
    joined = pairs.select("a", "b", *more).join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = joined.select("a", "b", *more, common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return both.where(100 * F.col("common") >= PERCENT * (F.col("sizes") - F.col("common"))).select("a", "b", *more)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`."""
    kit.prepare(docs.sparkSession)
    texts = kit.id_and_text(docs)
    marks = kit.settled(texts.mapInArrow(_mark, MARKS))
    classes = kit.settled(
        marks.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("k1", "k2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("low").alias("low"), F.first("parity").alias("parity"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    keys = classes.select("cid", "copies", "sig").mapInArrow(_index, "key long, cid long, copies long")
    centres = keys.groupBy("key").agg(F.max(F.struct("copies", (-F.col("cid")).alias("minus"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = kit.settled(keys.join(centres.select("key", (-F.col("top.minus")).alias("centre")), "key").select("key", "cid", "centre"))

    traits = classes.select(
        "cid", F.col("n_shingles").alias("n"), *[F.get("low", F.lit(k)).alias(c) for k, c in enumerate(LOWS)],
        *[F.get("parity", F.lit(k)).alias(c) for k, c in enumerate(PARITIES)],
    )
    named = ("n", *LOWS, *PARITIES)
    side = lambda c, rows=traits, *more: rows.select(*more, F.col("cid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in named])
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = shared.where("cid <> centre").select(*ordered("cid", "centre")).distinct()
    star = kit.settled(star.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b")).select("a", "b"))

    # Full sets of the classes that meet another one, from the texts of their first documents.
    wanted = classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "k1", "k2")
    sets = texts.join(wanted, "doc_id").select("doc_id", "text", "cid", "k1", "k2").mapInArrow(_sets, "cid long, shingles array<long>")
    sets = kit.settled(sets.dropDuplicates(["cid"]))
    links = kit.settled(confirmed(star, sets))
    comp = components(links)
    placed = shared.select("key", "cid").join(comp, shared["cid"] == comp["node"], "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    rows = kit.settled(placed.join(open_keys, "key", "left_semi").join(traits, "cid"))
    left, right = (side(x, rows, "key", F.col("comp").alias(f"comp_{x}")) for x in "ab")
    apart = (left["key"] == right["key"]) & (F.col("comp_a") < F.col("comp_b")) & may_link("a", "b")
    far = far_bits("a", "b", PARITIES)
    cross = left.join(right, apart).select("a", "b", "comp_a", "comp_b", far.alias("far"))
    cross = kit.settled(cross.groupBy("a", "b", "comp_a", "comp_b").agg(F.min("far").alias("far")))
    nearest = cross.groupBy("comp_a", "comp_b").agg(F.min(F.struct("far", "a", "b")).alias("n")).select("comp_a", "comp_b", "n.a", "n.b")
    joined = kit.settled(confirmed(nearest, sets, "comp_a", "comp_b"))
    rest = cross.join(joined, ["comp_a", "comp_b"], "left_anti").join(nearest, ["a", "b"], "left_anti")
    links = links.union(joined.select("a", "b")).union(confirmed(rest, sets))
    comp = components(links)

    of_class = classes.join(comp, classes["cid"] == comp["node"], "left").select("k1", "k2", "rep", F.coalesce("comp", "cid").alias("comp"))
    smallest = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "comp").select("k1", "k2", "component_id")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marks.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay when each group keeps its smallest doc_id, with all columns."""
    gone = groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(kit.read_table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {SHINGLE} + 2), lambda i: array_to_string(words[i:i + {SHINGLE} - 1], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_.n >= {PERCENT} * (x.n + y.n - both_.n)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, step.b FROM reach JOIN step ON step.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id IS NULL OR coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""
