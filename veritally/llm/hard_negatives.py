"""Hard negatives by Fagin's threshold algorithm over integer inner products.

Every component x of a vector becomes floor(256 x). A row's score is its integer inner product with
an anchor; rows come by score, downwards, then by vec_id. An anchor's positives are its first
`POSITIVES` other rows of the same label. A positive with score p opens the window of rows of other
labels with LOW p <= 100 score <= HIGH p, of which the first `NEGATIVES` are returned.

1. Rows are dealt into blocks by a hash of vec_id, anchors into groups; both are packed, one row
   each. A cell is a block and a group. The block goes to every group and the group to every block,
   so a cell has bounded size whatever label or vector is frequent, and no pair of rows is a row.
2. In a cell the block's rows are sorted once per dimension: the candidate lists. For an anchor each
   list is read from its high end where the anchor's component is positive and from its low end
   where it is negative, to equal depth. Rows met for the first time are scored in full (random
   access). The threshold is the score of a row with the components last read; no unread row
   scores more. Reading stops as soon as the threshold is strictly below the worst score still
   wanted in every window: a full window's last score, or the window's lower end (strictly, since
   an unread row of equal score may have a smaller vec_id). Depth doubles from round to round.
3. The first pass searches the lists of the anchor's own label for positives, the second those of the
   whole block for the windows; rows of the anchor's own label are passed over. What the cells
   keep, at most the number wanted per window, is merged by rank over the blocks.

Every anchor meets every block, since any row may score best: the work is that of the stated query
set against all rows, less what the thresholds save. Exchanged are rows times anchor groups and
anchors times blocks; `ROWS` and `ANCHORS` bound a cell's memory and set that price.

Defined results: rows with a NULL vec_id, label or vector, or with a NULL or non-finite component
take no part. Of several rows with one vec_id the one with the smallest label, then the smallest
vector bytes, counts. Shorter vectors are filled up with zeros; an empty vector is all zeros.
Components are limited to 32 bits after scaling and scores to 64. Windows of negative scores are
empty, since LOW p is above HIGH p there. Labels are integers. Other columns are ignored. An empty
table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.llm import kit

SCALE = 256
EVERY = 100  # anchors are rows whose vec_id is a multiple
POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100  # percent of the positive's score
ROWS, ANCHORS = 1 << 15, 1 << 15  # most rows of a block, most anchors of a group
FIRST_DEPTH = 32
LIMIT = 2**31 - 1
ROW_SCHEMA = "vec_id long, label long, vector binary"
BLOCK_SCHEMA = "block long, rows binary, labels binary, ends binary, vectors binary"
FOUND_SCHEMA = "anchor_id long, window long, other_id long, score long"


def _quantised(batches):
    for batch in batches:
        ids, labels, vectors = (batch.column(k) for k in range(3))
        ends = vectors.offsets.to_numpy().astype(np.int64)
        values = vectors.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        # The values of a NULL list, if any, belong to a row that goes.
        wrong = ~np.isfinite(values.to_numpy(zero_copy_only=False)) | values.is_null().to_numpy(zero_copy_only=False)
        wrong = np.diff(np.concatenate([[0], np.cumsum(wrong)])[ends]) > 0
        keep = ~wrong & ids.is_valid().to_numpy(False) & labels.is_valid().to_numpy(False) & vectors.is_valid().to_numpy(False)
        x = np.nan_to_num(values.fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0)
        raw = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype("<i4")
        packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([ids, labels, packed], names=["vec_id", "label", "vector"]).filter(pa.array(keep))


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector (32-bit integers) of the rows that take part, one per vec_id."""
    typed = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = typed.mapInArrow(_quantised, ROW_SCHEMA)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


# --- blocks -----------------------------------------------------------------------------------


def _pack(table: pa.Table) -> pa.Table:
    raw, ends = kit.flat(table["vector"])
    columns = [table["vec_id"].to_numpy().astype("<i8"), table["label"].to_numpy().astype("<i8"), ends.astype("<i8"), raw]
    return pa.table([table["block"].combine_chunks().slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["block", "rows", "labels", "ends", "vectors"])


def _blocks(rows: DataFrame, n: int, most: int) -> tuple[DataFrame, int]:
    """Rows packed into blocks of `most` rows, or of fewer so that all cores have some."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // most), min(2 * cores, n // 512))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    return numbered.groupBy("block").applyInArrow(_pack, BLOCK_SCHEMA), n_blocks


class Block:
    """The rows of a block: ids, labels and a matrix as wide as asked for."""

    def __init__(self, row: dict, prefix: str = ""):
        take = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.ids, self.labels = take("rows", "<i8"), take("labels", "<i8")
        self.ends, self.values = take("ends", "<i8") // 4, take("vectors", "<i4")
        self.size = np.diff(self.ends)
        self.width = int(self.size.max(initial=0))
        self.most = int(np.abs(self.values).max(initial=0))

    def matrix(self, width: int, kind) -> np.ndarray:
        out = np.zeros((len(self.ids), width), np.int64)
        row = np.repeat(np.arange(len(self.ids)), self.size)
        out[row, np.arange(len(self.values)) - self.ends[:-1][row]] = self.values
        return out.astype(kind)


def exact_kind(most_a: int, most_b: int, width: int):
    """The narrowest kind of number in which sums of `width` products are exact."""
    bound = most_a * most_b * max(width, 1)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


# --- threshold algorithm ------------------------------------------------------------------------


class Lists:
    """The rows of a matrix in order of every dimension."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.order = np.argsort(matrix, axis=0, kind="stable")

    def search(self, anchor: np.ndarray):
        """Rows met first in each round, their scores, and the threshold for all rows not met yet
        (None after the last). The caller stops when it likes."""
        n = len(self.matrix)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth, step = np.zeros(n, bool), 0, FIRST_DEPTH
        if not len(up) and not len(down):
            depth = n
            yield np.arange(n), np.zeros(n, np.int64), None
        while depth < n:
            stop = min(n, depth + step)
            if 2 * stop > n:
                stop = n  # nearly all rows are met by then
                new = ~met
            else:
                now = np.zeros(n, bool)
                now[self.order[n - stop : n - depth, up].reshape(-1)] = True
                now[self.order[depth:stop, down].reshape(-1)] = True
                new = now & ~met
                met |= now
            rows = np.flatnonzero(new)
            score = self.matrix[rows] @ anchor
            limit = None
            if stop < n:
                limit = self.matrix[self.order[n - stop, up], up] @ anchor[up] + self.matrix[self.order[stop - 1, down], down] @ anchor[down]
            yield rows, _long(score), limit
            depth, step = stop, 2 * step


def _long(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score], np.int64)
    return score.astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, downwards, then by id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_of(lists: Lists, ids: np.ndarray, anchor: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the first k rows but the anchor's own."""
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, score, limit in lists.search(anchor):
        other = ids[rows] != own
        found, scores = np.concatenate([found, ids[rows][other]]), np.concatenate([scores, score[other]])
        at = first(scores, found, k)
        found, scores = found[at], scores[at]
        if limit is None or (len(found) == k and limit < scores[-1]):
            break
    return found, scores


def best_in_windows(lists: Lists, ids: np.ndarray, allowed: np.ndarray, anchor: np.ndarray, tops: np.ndarray, k: int):
    """(top, ids, scores) of the first k allowed rows in the window below each of the tops."""
    lows = [-(-LOW * int(top) // 100) for top in tops]
    highs = [HIGH * int(top) // 100 for top in tops]
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = list(lows)
    for rows, score, limit in lists.search(anchor):
        fits = (score >= min(need)) & (score <= max(highs))
        rows, score = rows[fits], score[fits]
        fits = allowed[rows]
        found, scores = np.concatenate([found, ids[rows[fits]]]), np.concatenate([scores, score[fits]])
        chosen = []
        for low, high in zip(lows, highs):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            chosen.append(inside[first(scores[inside], found[inside], k)])
        need = [int(scores[at[-1]]) if len(at) == k else low for at, low in zip(chosen, lows)]
        if limit is None or limit < min(need):
            break
    return [(int(top), found[at], scores[at]) for top, at in zip(tops, chosen)]


# --- cells --------------------------------------------------------------------------------------


def _cells(blocks: DataFrame, n_blocks: int, groups: DataFrame, n_groups: int) -> DataFrame:
    """A row per block and group of anchors."""
    every = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = blocks.select("*", every("group", n_groups))
    right = groups.select(F.col("block").alias("group"), *[F.col(c).alias(f"a_{c}") for c in groups.columns if c != "block"], every("block", n_blocks))
    return left.join(right, ["block", "group"])


def _open(row: dict):
    """The block's rows, its matrix, the anchors and their matrix."""
    block, anchors = Block(row), Block(row, "a_")
    width = max(block.width, anchors.width)
    kind = exact_kind(block.most, anchors.most, width)
    return block, block.matrix(width, kind), anchors, anchors.matrix(width, kind)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (anchor, window, ids, scores)."""
    size = [len(r[2]) for r in rows]
    columns = [np.repeat(np.array([r[k] for r in rows], np.int64), size) for k in (0, 1)]
    columns += [np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor_id", "window", "other_id", "score"])


def _find_positives(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, matrix, anchors, given = _open(row)
                out = []
                for label in np.unique(anchors.labels):
                    mine = np.flatnonzero(block.labels == label)
                    if not len(mine):
                        continue
                    lists, ids = Lists(matrix[mine]), block.ids[mine]
                    for i in np.flatnonzero(anchors.labels == label):
                        out.append((anchors.ids[i], 0, *best_of(lists, ids, given[i], anchors.ids[i], k)))
                yield _found(out)

    return run


def _find_negatives(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, matrix, anchors, given = _open(row)
                tops, top_ends = np.frombuffer(row["a_tops"], "<i8"), np.frombuffer(row["a_top_ends"], "<i8")
                lists, out = Lists(matrix), []
                for i, own in enumerate(anchors.ids):
                    mine = tops[top_ends[i] : top_ends[i + 1]]
                    allowed = block.labels != anchors.labels[i]
                    if len(mine) and allowed.any():
                        out += [(own, *x) for x in best_in_windows(lists, block.ids, allowed, given[i], mine, k)]
                yield _found(out)

    return run


def _pack_anchors(table: pa.Table) -> pa.Table:
    out = _pack(table)
    tops = table["tops"].combine_chunks()
    ends = tops.offsets.to_numpy().astype("<i8")
    values = tops.values.to_numpy(zero_copy_only=False).astype("<i8")[ends[0] : ends[-1]]
    return out.append_column("tops", pa.array([values.tobytes()], pa.binary())).append_column("top_ends", pa.array([(ends - ends[0]).tobytes()], pa.binary()))


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = embeddings.sparkSession
    kit.prepare(spark)
    rows = kit.settled(quantised(embeddings))
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1))).first()
    blocks, n_blocks = _blocks(rows, n, ROWS)
    blocks = kit.settled(blocks)
    anchors = rows.where(is_anchor)
    n_groups = max(1, -(-n_anchors // ANCHORS))
    numbered = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)))
    groups = numbered.groupBy("block").applyInArrow(_pack, BLOCK_SCHEMA)
    near = _cells(blocks, n_blocks, groups, n_groups).mapInArrow(_find_positives(positives), FOUND_SCHEMA)
    near = kit.settled(_first(near, ["anchor_id"], positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A window is given by its positive's score; positives of one score share it.
    tops = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score"), False).alias("tops"))
    with_tops = numbered.join(tops, numbered["vec_id"] == tops["anchor_id"]).select("block", "vec_id", "label", "vector", "tops")
    groups = with_tops.groupBy("block").applyInArrow(_pack_anchors, BLOCK_SCHEMA + ", tops binary, top_ends binary")
    far = _cells(blocks, n_blocks, groups, n_groups).mapInArrow(_find_negatives(negatives), FOUND_SCHEMA)
    far = _first(far, ["anchor_id", "window"], negatives).select("anchor_id", F.col("window").alias("positive_score"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(embeddings: DataFrame) -> DataFrame:
    """Labels of every seventh row moved on by one, as the query wants it."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", moved.alias("label"), "embedding")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(kit.read_table(spark, sf_dir, "embeddings")))


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}"""
