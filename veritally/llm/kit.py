"""Helpers that the operators share: text as byte arrays, word hashes, packed rows.

Texts are handled as UTF-8 bytes in NumPy arrays, a few hundred documents at a time. A word is a
maximal run of `[^\\x20\\x09-\\x0D]`; all separators are ASCII, so bytes and code points agree.

A *unit* is a row that holds some megabytes of neighbouring documents, compressed. Operators that
have to come back to the texts exchange units instead of documents: what a unit sends to the rest
of the corpus is packed into one binary per receiving bucket, and what returns to it is packed the
same way, so the shuffle moves few rows and no row is larger than a unit or a bucket's share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.session import checkpointed, shared_folder, ship_package

NULL_ID = np.iinfo(np.int64).max  # stands for a missing doc_id inside packed rows: last in every order
UNIT_BYTES = 4 << 20  # text in a unit; a longer document is a unit of its own
PIECE_BYTES = 1 << 18  # text handled at once, so that the arrays stay in the cache
UNIT_SCHEMA = "unit long, n_docs long, n_bytes long, ids binary, ends binary, blob binary, rest binary"

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, name the checkpoint folder, bound Arrow batches by bytes."""
    ship_package(spark)
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(64 << 20))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def settled(df: DataFrame) -> DataFrame:
    """`df`, computed now and kept in the shared folder. Spark removes the shuffle files that only
    led to it as soon as it is written, not when the driver happens to collect its garbage."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return checkpointed(df.select("*"))  # planned anew, under the setting
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row["n"], row["b"] or 0


# --- arrays -----------------------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the end offsets of its rows, led by 0. NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, ends - ends[0]


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def pieces(ends: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `size` bytes, a row at least."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + size, "right")) - 1)
        j = min(j, n, i + 65536)
        yield i, j
        i = j


def text_pieces(batches, size: int = PIECE_BYTES):
    """(batch, first row, last row + 1, bytes, ends) over the second column of Arrow batches."""
    for batch in batches:
        text, ends = flat(batch.column(1))
        for i, j in pieces(ends, size):
            yield batch, i, j, text[ends[i] : ends[j]], ends[i : j + 1] - ends[i]


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true positions; runs do not cross rows."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    row_starts = ends[:-1][ends[:-1] < n]
    first[row_starts] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[row_starts[row_starts > 0] - 1] = True
    return np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1


def rows_of(positions: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(ends, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n + 1).bit_length())
    if size not in _powers:
        up = np.full(size, _STEP, np.uint64)
        down = np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        found = (np.cumprod(up), np.cumprod(down))
        if size > 1 << 22:
            return found  # of one very long text: not kept
        _powers[size] = found
    return _powers[size]


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of text[start:end]."""
    up, down = _powers_to(len(text))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    s, e = runs(WORD[text], ends)
    return s, e, rows_of(s, ends)


def row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values at each row's positions."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[ends])


# --- units ------------------------------------------------------------------------------------


def _unit(number: int, held: list) -> pa.RecordBatch:
    ids = np.concatenate([x[0] for x in held])
    sizes = np.concatenate([x[1] for x in held])
    text = np.concatenate([x[2] for x in held])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    blob = pa.compress(text.tobytes(), codec="zstd", asbytes=True) if len(text) else b""
    rest = None
    if held[0][3] is not None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0][3].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x[3])
        rest = sink.getvalue().to_pybytes()
    row = [[number], [len(ids)], [len(text)], [ids.tobytes()], [ends.tobytes()], [blob], [rest]]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(row, kinds)], names=["unit", "n_docs", "n_bytes", "ids", "ends", "blob", "rest"]
    )


def _to_units(batches):
    from pyspark import TaskContext

    part, n, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0
    for batch, i, j, text, ends in text_pieces(batches):
        if held and (size + len(text) > UNIT_BYTES or rows > 1 << 20):
            yield _unit(part << 32 | n, held)
            n, held, size, rows = n + 1, [], 0, 0
        carried = batch.slice(i, j - i).select(range(2, batch.num_columns)) if batch.num_columns > 2 else None
        held.append((ids_of(batch.column(0))[i:j].copy(), np.diff(ends), text.copy(), carried))
        size, rows = size + len(text), rows + j - i
    if held:
        yield _unit(part << 32 | n, held)


def units(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The documents packed into units, kept in the shared folder so that a unit never changes.
    With `carry`, all columns of `docs` but its text go along, under the names `carried_0`, ..."""
    others = [F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(docs.columns) if c != "text"] if carry else []
    return settled(id_and_text(docs, *others).mapInArrow(_to_units, UNIT_SCHEMA))


def carried_rows(row: dict) -> pa.Table:
    with pa.ipc.open_stream(row["rest"]) as stream:
        return stream.read_all()


def open_unit(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, ends and text of a unit row."""
    ids = np.frombuffer(row["ids"], np.int64)
    ends = np.frombuffer(row["ends"], np.int64)
    text = pa.decompress(row["blob"], row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""
    return ids, ends, np.frombuffer(text, np.uint8)


def unit_rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):  # one at a time: a batch may hold many units
            (row,) = batch.slice(k, 1).to_pylist()
            yield row["unit"], *open_unit(row)


# --- packed rows ------------------------------------------------------------------------------

PACKED_SCHEMA = "bucket long, unit long, part long, payload binary"


def deal(unit: int, part: int, buckets: np.ndarray, records: np.ndarray) -> pa.RecordBatch | None:
    """Records (a structured or plain array) dealt to buckets, one packed row per bucket.
    The order within a bucket is the order given."""
    if not len(records):
        return None
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_buckets)) + 1, [len(order)]])
    data = np.ascontiguousarray(records[order])
    raw, width = data.view(np.uint8).reshape(-1), data.dtype.itemsize
    payload = pa.Array.from_buffers(
        pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]
    )
    n = len(cut) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(sorted_buckets[cut[:-1]].astype(np.int64)), pa.array(np.full(n, unit, np.int64)), pa.array(np.full(n, part, np.int64)), payload],
        names=["bucket", "unit", "part", "payload"],
    )


def undeal(buckets: np.ndarray) -> np.ndarray:
    """Place in the given order of each record in the order in which `deal` sent them."""
    return np.argsort(buckets, kind="stable")


def unpack(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """All records of a bucket's rows, and the row number of each."""
    raw, ends = flat(table.column("payload"))
    records = np.frombuffer(raw.tobytes(), kind)
    return records, np.repeat(np.arange(table.num_rows), np.diff(ends) // np.dtype(kind).itemsize)


def bucket_count(n_bytes: int, per_bucket: int) -> int:
    return max(8, -(-n_bytes // per_bucket))


def first_true(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal neighbours starts in a sorted array."""
    out = np.ones(len(keys), bool)
    if len(keys) > 1:
        np.not_equal(keys[1:], keys[:-1], out=out[1:])
    return out
