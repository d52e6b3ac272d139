"""Line dedup by an exact set-similarity join.

The lines of all documents (pieces between line feeds that have a word) stand in one order: by
doc_id, then by place. A line's set is its distinct words, A-Z lower-cased. A line is removed if
100 |x n y| >= 80 |x u y| for the set x of any earlier line. This is judged on the input, so the
outcome does not depend on the order of work.

1. A sketch of `SKETCH` word counters (fixed size, so it may be broadcast) gives one rarity order
   for all words: by counter, then by hash. Any order common to all lines keeps the join exact. A
   counter never falls short, so a word counted once stands in one line only and is not sent.
2. Lines with equal sets are one class. A unit settles its own repeats and sends only its earliest
   line of a class: one record to the class, whose bucket tells the units whose line is not the
   earliest, and one to every word of its prefix, the |x| - ceil(0.8 |x|) + 1 rarest words: two
   matching sets share a word there. A prefix word counted more than `SPLIT` times is never a list of
   its own: sets that match share two words at least within prefixes that are longer by one, so the
   record goes to the pairs of that word and the words after it there. Such lists are parted further
   by classes of sizes, each with the lines that are just small enough to match its own.
   Records hold the size, how much of the set can still be shared from there on, and 64 parity bits.
3. Within a list a pair is taken where it shares its first word (or two), so both must have left
   what the required overlap still wants (the positional filter); it must pass the length filter and
   the parity bits, whose distance is at most the symmetric difference. Two lines that reach
   no line of their own size cannot match, which spares the pairs of long lists of unlike lines.
4. A line only needs one earlier match. A list proposes the `NEAREST` candidates of each line. Of
   these the nearest is verified first, by the Jaccard similarity of the whole sets, then the
   others; lines that had more candidates and found no match then meet all of them. So copies
   and near copies cost rows in proportion to their number, and no candidate is left out.
5. Later lines of a class, and first lines with a verified earlier match, are removed.

Defined results: lines without a word stay; a NULL text is an empty one, without lines; rows with
a NULL doc_id come last in the order; of repeated rows the lines of all but one go; other columns are ignored; an empty table gives an empty result. Whole texts
are read, and lines of any length are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritally.llm import kit

PERCENT = 80
SKETCH_BITS = 20
SKETCH = 1 << SKETCH_BITS
SEGMENT = 1 << 14
HASH_BYTES = 6  # of a word's hash, in the sets that are verified
SPLIT = 2048  # a word of more occurrences is only a list together with another
AT_ONCE = 1 << 18  # candidates held before those beyond the nearest are let go
NEAREST = 4  # candidates of a line that a list proposes at once
BUCKET_BYTES = 8 << 20
FIELDS = (("token", "<u8"), ("key", "<u8"), ("bits", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("size", "<u4"), ("reach", "<u4"))
SENT_SCHEMA = "bucket long, unit long, n long, payload binary"
JUDGED_SCHEMA = "kind int, unit long, line long, token long, size int, payload binary"
MEMBER_RECORD = np.dtype([("unit", "<i8"), ("doc", "<i8"), ("bits", "<u8"), ("line", "<u4"), ("size", "<u4"), ("reach", "<u4")])
PAIR_RECORD = np.dtype([("unit", "<i8"), ("x_unit", "<i8"), ("line", "<u4"), ("x_line", "<u4"), ("far", "<u2")])
PAIR_SCHEMA = "unit long, line long, x_unit long, x_line long, far long"
RESULT_SCHEMA = (
    StructType().add("doc_id", "long").add("n_lines", "long").add("n_removed", "long").add("kept", "string")
)
REPEATED, PAIR, LIST, OPEN = range(4)


def needed(sizes, percent: int = PERCENT):
    """Least overlap of two sets whose sizes have this sum, for the threshold."""
    return -(-percent * sizes // (100 + percent))


def prefix(sizes, percent: int = PERCENT):
    return sizes - -(-percent * sizes // 100) + 1


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Number of a class of sizes such that sets that may match are in the same or the next one."""
    return np.floor(np.log(np.maximum(sizes, 1)) / -np.log(PERCENT / 100) * (1 - 1e-9)).astype(np.int64)


class Lines:
    """Lines of a unit that have a word: start, end, row; and their words."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.start, self.end = kit.runs(text != 10, ends)
        self.row = kit.rows_of(self.start, ends)
        self.text, self.ends = text, ends

    def words(self):
        """(hash, line) of all words, some hundred lines at a time."""
        for i, j in kit.pieces(self.ends):
            a = self.ends[i]
            piece = self.text[a : self.ends[j]]
            s, e, _ = kit.words(piece, self.ends[i : j + 1] - a)
            yield kit.span_hashes(kit.LOWER[piece], s, e), np.searchsorted(self.start, s + a, "right") - 1


def _distinct(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = kit.mix(h ^ kit.mix(line.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(apart)
    keep = np.zeros(len(h), bool)
    keep[order[kit.first_true(apart[order])]] = True
    return h[keep], line[keep]


def _in_order(h: np.ndarray, count: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct words of each line, rarest first: hash, counter and line."""
    if not len(h):
        return h, count, line
    first = line[0]  # lines of one piece: few enough for the high bits
    low, bits = np.uint64(0), max(int(line[-1] - first).bit_length(), 1)
    if bits <= 20:
        rarity = np.minimum(count, np.uint32((1 << 20) - 1)).astype(np.uint64)
        low = np.uint64(64 - bits)
        key = (line - first).astype(np.uint64) << low | rarity << (low - np.uint64(20)) | h >> np.uint64(20 + bits)
        order = np.argsort(key)
        key, h, count, line = key[order], h[order], count[order], line[order]
        again = key[1:] == key[:-1]
        if (h[1:][again] == h[:-1][again]).all():  # else words that the key does not tell apart
            keep = np.concatenate([[True], ~again])
            return h[keep], count[keep], line[keep]
    order = np.lexsort((h, np.minimum(count, (1 << 20) - 1), line))
    h, count, line = h[order], count[order], line[order]
    keep = kit.first_true(line) | kit.first_true(h)
    return h[keep], count[keep], line[keep]


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(batches):
    total = np.zeros(SKETCH, np.int64)
    for _, _, ends, text in kit.unit_rows(batches):
        for h, _ in Lines(text, ends).words():
            np.add.at(total, _counter(h), 1)
    if total.any():
        parts = [pa.compress(total[a : a + SEGMENT].tobytes(), codec="zstd", asbytes=True) for a in range(0, SKETCH, SEGMENT)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["segment", "payload"])


def _segment(payload: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload, SEGMENT * 8, codec="zstd", asbytes=True), np.int64)


def _sum_segment(table: pa.Table) -> pa.Table:
    total = sum(_segment(x) for x in table["payload"].to_pylist())
    return pa.table({"segment": table["segment"].slice(0, 1), "payload": pa.array([pa.compress(total.tobytes(), codec="zstd", asbytes=True)], pa.binary())})


def sketch(units: DataFrame) -> np.ndarray:
    """Word counts by hash: always SKETCH counters, so it fits the driver whatever the corpus."""
    kind = "segment int, payload binary"
    rows = units.mapInArrow(_count, kind).groupBy("segment").applyInArrow(_sum_segment, kind).collect()
    out = np.zeros(SKETCH, np.uint32)
    for row in rows:
        out[row["segment"] * SEGMENT :][:SEGMENT] = np.minimum(_segment(row["payload"]), 2**32 - 1)
    return out


def _pack(bucket: int, unit: int, columns: dict[str, np.ndarray]) -> tuple:
    body = b"".join(np.ascontiguousarray(columns[name].astype(kind)).tobytes() for name, kind in FIELDS)
    return bucket, unit, len(columns["token"]), pa.compress(body, codec="zstd", asbytes=True)


def _open(table: pa.Table) -> dict[str, np.ndarray]:
    found = {name: [] for name, _ in FIELDS}
    width = sum(np.dtype(kind).itemsize for _, kind in FIELDS)
    for n, payload in zip(table["n"].to_pylist(), table["payload"].to_pylist()):
        body, at = pa.decompress(payload, n * width, codec="zstd", asbytes=True), 0
        for name, kind in FIELDS:
            found[name].append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
    out = {name: np.concatenate(x) for name, x in found.items()}
    out["unit"] = np.repeat(table["unit"].to_numpy(), table["n"].to_numpy())
    return out


_CLASS, _PAIRED, _SIZED = np.uint64(0xC1A5), np.uint64(0x9A12), np.uint64(0x512E)


def _lists(h: np.ndarray, count: np.ndarray, heads: np.ndarray, size: np.ndarray, split: int):
    """(list, line, reach) of the records of lines whose words lie in order from `heads` on."""
    total = np.repeat(size, size)
    pos = np.arange(len(h)) - np.repeat(heads, size)
    owner = np.repeat(np.arange(len(heads)), size)
    in_prefix = pos < prefix(total)
    at = np.flatnonzero(in_prefix & (count > 1) & (count <= split))
    out = [(h[at], owner[at], (total - pos)[at])]
    first = np.flatnonzero(in_prefix & (count > split))
    more = np.minimum(prefix(total[first]) + 1, total[first]) - 1 - pos[first]  # words after it in the longer prefix
    second = np.repeat(first + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    first = np.repeat(first, more)
    both = kit.mix(h[first] ^ kit.mix(h[second] + _PAIRED))
    reach = (total - pos)[second] + 1  # the first word is shared as well
    own = size_class(total[second])
    # The largest set that these words still allow: (100 + P) reach / P - size.
    partner = np.minimum((100 + PERCENT) * reach // PERCENT - total[second], 100 * total[second] // PERCENT)
    for up in (0, 1):  # its own class, and the next where that holds sets it may match
        goes = np.flatnonzero(size_class(partner) > own) if up else np.arange(len(both))
        out.append((kit.mix(both[goes] + (own[goes] + up).astype(np.uint64) * _SIZED), owner[second][goes], reach[goes]))
    return [np.concatenate(x) for x in zip(*out)]


def _send(shared, n_buckets: int, split: int = SPLIT):
    """Prefix records to the buckets of their lists, class records to that of the class, one per unit
    and class, and the lines that repeat an earlier one of their unit to a bucket of the unit
    (-1 - unit)."""

    def run(batches):
        rarity = shared.value
        for unit, ids, ends, text in kit.unit_rows(batches):
            lines = Lines(text, ends)
            kept, n_classes = [], 0
            classes = {k: [] for k in ("key", "bits", "line", "size", "shared")}
            for h, line in lines.words():
                h, count, line = _in_order(h, rarity[_counter(h)], line)
                if not len(h):
                    continue
                heads = np.flatnonzero(kit.first_true(line))
                size = np.diff(np.append(heads, len(line)))
                token, owner, reach = _lists(h, count, heads, size, split)
                kept.append((token, owner + n_classes, reach))
                n_classes += len(heads)
                key = np.add.reduceat(kit.mix(h + np.uint64(0x51ED)), heads)
                bits = np.bitwise_xor.reduceat(np.uint64(1) << (kit.mix(h) & np.uint64(63)), heads)
                for name, value in (("key", key), ("bits", bits), ("line", line[heads]), ("size", size), ("shared", count[heads] > 1)):
                    classes[name].append(value)
            if not kept:
                continue
            classes = {k: np.concatenate(v) for k, v in classes.items()}
            classes["doc"] = ids[lines.row[classes["line"]]]
            # The first line of each class of this unit, once per list.
            order = np.lexsort((classes["line"], classes["doc"], classes["bits"], classes["key"]))
            first = np.zeros(len(order), bool)
            first[order[kit.first_true(classes["key"][order]) | kit.first_true(classes["bits"][order])]] = True
            token, owner, reach = (np.concatenate(x) for x in zip(*kept))
            mine = first[owner]
            whole = np.flatnonzero(first & classes["shared"])  # a line with a word of its own has no equal
            token = np.concatenate([token[mine], kit.mix(classes["key"][whole] + _CLASS)])
            owner, reach = np.concatenate([owner[mine], whole]), np.concatenate([reach[mine], np.zeros(len(whole), np.int64)])
            records = {k: classes[k][owner] for k in ("key", "bits", "doc", "line", "size")} | {"token": token, "reach": reach}
            out = _by_bucket(unit, (token % np.uint64(n_buckets)).astype(np.int64), records)
            if not first.all():
                later = classes["line"][~first].astype("<u4")
                out.append((-1 - unit, unit, len(later), later.tobytes()))
            if not out:
                continue
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "unit", "n", "payload"])

    return run


def _by_bucket(unit: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> list[tuple]:
    if not len(bucket):
        return []
    order = np.lexsort((columns["token"], bucket))
    cut = np.append(np.flatnonzero(kit.first_true(bucket[order])), len(order))
    return [_pack(int(bucket[order[a]]), unit, {k: v[order[a:b]] for k, v in columns.items()}) for a, b in zip(cut[:-1], cut[1:])]


def _rows(kind: int, n: int, **columns) -> pa.Table:
    schema = {"kind": pa.int32(), "unit": pa.int64(), "line": pa.int64(), "token": pa.int64(), "size": pa.int32(), "payload": pa.binary()}
    columns["kind"] = np.full(n, kind)
    return pa.table({
        name: pa.array(columns[name], t) if isinstance(columns.get(name), list)
        else pa.array(columns[name].view(np.int64) if columns[name].dtype == np.uint64 else columns[name]).cast(t) if name in columns
        else pa.nulls(n, t)
        for name, t in schema.items()
    })


def _repeated_lines(unit: np.ndarray, line: np.ndarray) -> pa.Table:
    """These lines, packed by unit."""
    order = np.argsort(unit, kind="stable")
    unit, line = unit[order], line[order]
    cut = np.flatnonzero(kit.first_true(unit))
    payload = [x.tobytes() for x in np.split(line, cut[1:])] if len(unit) else []
    return _rows(REPEATED, len(cut) if len(unit) else 0, unit=unit[cut] if len(unit) else unit, payload=payload)


def _places(r: dict[str, np.ndarray]) -> np.ndarray:
    """Numbers in the order of all lines (doc, unit, line); records of one line get the same."""
    _, unit = np.unique(r["unit"], return_inverse=True)
    within = unit.astype(np.int64) << 32 | r["line"].astype(np.int64)
    order = np.lexsort((within, r["doc"]))
    new = kit.first_true(r["doc"][order]) | kit.first_true(within[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return place


def _nearest(x: np.ndarray, y: np.ndarray, far: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The `n` nearest candidates of each line (the earlier one first), and the lines that have more."""
    order = np.lexsort((place[x], far, y))
    x, y, far = x[order], y[order], far[order]
    start = np.flatnonzero(kit.first_true(y))
    rank = np.arange(len(y)) - np.repeat(start, np.diff(np.append(start, len(y))))
    near = rank < n
    return x[near], y[near], far[near], np.unique(y[~near])


def _candidates(
    r: dict[str, np.ndarray], place: np.ndarray, heads: np.ndarray, length: np.ndarray, nearest: int | None = None, open_y: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """(x, y, far) of the pairs within lists that pass all filters, x the earlier line; the records of
    a list lie together, smaller sets first. With `nearest`, of each y only so many are held at any
    time and returned, with the y that have more. With `open_y`, only pairs whose y is marked there."""
    size, reach, bits = r["size"].astype(np.int64), r["reach"].astype(np.int64), r["bits"]
    stop = np.repeat(heads + length, length)
    able = (100 + PERCENT) * reach >= 2 * PERCENT * size  # reaches a set of its own size
    none = np.zeros(0, np.int64)
    held, parts, n_parts, more = (none, none, none), [], 0, [none]

    def gather() -> tuple[np.ndarray, ...]:
        x, y, far = (np.concatenate(v) for v in zip(held, *parts))
        if nearest is None:
            return x, y, far
        x, y, far, others = _nearest(x, y, far, place, nearest)
        more.append(others)
        return x, y, far

    live, k = np.arange(len(size)), 1
    while len(live):
        live = live[live + k < stop[live]]
        live = live[100 * size[live] >= PERCENT * size[live + k]]  # sizes grow within a list
        a = live[able[live] | able[live + k]]
        b = a + k
        swap = place[a] > place[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        if open_y is not None:
            a, b = a[open_y[b]], b[open_y[b]]
        least = needed(size[a] + size[b])
        ok = np.minimum(reach[a], reach[b]) >= least
        a, b, least = a[ok], b[ok], least[ok]
        far = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64)
        ok = (far <= size[a] + size[b] - 2 * least) & (place[a] != place[b])
        parts.append((a[ok], b[ok], far[ok]))
        n_parts += len(parts[-1][0])
        if n_parts > AT_ONCE:
            held, parts, n_parts = gather(), [], 0
        k += 1
    x, y, far = gather()
    return x, y, far, np.unique(np.concatenate(more))


def _pair_records(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, far: np.ndarray) -> np.ndarray:
    packed = np.zeros(len(x), PAIR_RECORD)
    for name, value in (("unit", r["unit"][y]), ("x_unit", r["unit"][x]), ("line", r["line"][y]), ("x_line", r["line"][x]), ("far", np.minimum(far, 65535))):
        packed[name] = value
    return packed


def _pair_rows(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, far: np.ndarray) -> pa.Table:
    packed = _pair_records(r, x, y, far)
    parts = [packed[a : a + (1 << 16)] for a in range(0, len(packed), 1 << 16)]
    payload = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts]
    return _rows(PAIR, len(parts), payload=payload, size=np.array([p.nbytes for p in parts], np.int64))


def _judge(nearest: int):
    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return _rows(REPEATED, table.num_rows, unit=table["unit"].to_numpy(), payload=table["payload"].to_pylist())
        r = _open(table)
        place = _places(r)
        # One record per list and class: the earliest line of the class; smaller sets first.
        kind = kit.mix(r["key"] ^ kit.mix(r["bits"]))  # of the class: tells those of one list apart
        order = np.lexsort((place, kind, r["size"], r["token"]))
        token, kind = r["token"][order], kind[order]
        new = kit.first_true(token) | kit.first_true(kind)
        of_class = r["reach"][order] == 0
        later = order[~new & of_class]
        repeated = _repeated_lines(r["unit"][later], r["line"][later])
        order = order[new & ~of_class]
        r, place = {k: v[order] for k, v in r.items()}, place[order]
        heads = np.flatnonzero(kit.first_true(r["token"]))
        length = np.diff(np.append(heads, len(place)))
        x, y, far, more = _candidates(r, place, heads, length, nearest)  # a record is a line in a list
        _, once = np.unique(place[x] * (len(place) + 1) + place[y], return_index=True)
        pairs = _pair_rows(r, x[once], y[once], far[once])
        in_list = np.searchsorted(heads, more, "right") - 1
        members = np.zeros(len(place), MEMBER_RECORD)
        for name in MEMBER_RECORD.names:
            members[name] = r[name]
        wanted = np.unique(in_list)
        lists = _rows(
            LIST, len(wanted), token=r["token"][heads[wanted]], size=(length[wanted] * MEMBER_RECORD.itemsize).astype(np.int64),
            payload=[pa.compress(members[heads[i] : heads[i] + length[i]].tobytes(), codec="zstd", asbytes=True) for i in wanted],
        )
        waiting = _rows(OPEN, len(more), token=r["token"][more], unit=r["unit"][more], line=r["line"][more])
        return pa.concat_tables([repeated, pairs, lists, waiting])

    return run


def _opened(packed: np.ndarray) -> pa.RecordBatch:
    names = ["unit", "line", "x_unit", "x_line", "far"]
    return pa.RecordBatch.from_arrays([pa.array(packed[n].astype(np.int64)) for n in names], names=names)


def _late(key, lists: pa.Table, waiting: pa.Table) -> pa.Table:
    """All candidates of the lines of a list that wait for them. They leave as pairs: to open packed
    ones in the same stage would take a second Python worker per task."""
    if not lists.num_rows or not waiting.num_rows:
        return pa.Table.from_batches([_opened(np.zeros(0, PAIR_RECORD))])
    members = np.frombuffer(pa.decompress(lists["payload"][0].as_py(), lists["size"][0].as_py(), codec="zstd", asbytes=True), MEMBER_RECORD)
    r = {name: members[name] for name in MEMBER_RECORD.names}
    at = {(u, n) for u, n in zip(waiting["unit"].to_pylist(), waiting["line"].to_pylist())}
    is_open = np.array([(u, n) in at for u, n in zip(r["unit"].tolist(), r["line"].tolist())])
    x, y, far, _ = _candidates(r, _places(r), np.zeros(1, np.int64), np.array([len(members)]), open_y=is_open)
    cut = [slice(a, a + (1 << 16)) for a in range(0, max(len(x), 1), 1 << 16)]
    return pa.Table.from_batches([_opened(_pair_records(r, x[c], y[c], far[c])) for c in cut])


def _open_pairs(batches):
    for batch in batches:
        for size, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield _opened(np.frombuffer(pa.decompress(payload, size, codec="zstd", asbytes=True), PAIR_RECORD))


def _read_sets(key, unit_table: pa.Table, wanted: pa.Table) -> pa.Table:
    """Word sets of the wanted lines of a unit."""
    if not wanted.num_rows:
        return pa.table({"unit": pa.array([], pa.int64()), "line": pa.array([], pa.int64()), "words": pa.array([], pa.binary())})
    (row,) = unit_table.to_pylist()
    _, ends, text = kit.open_unit(row)
    lines = Lines(text, ends)
    at = np.unique(wanted["line"].to_numpy())
    chosen_ends = np.concatenate([[0], np.cumsum(lines.end[at] - lines.start[at])])
    sizes, raw = [], []
    for i, j in kit.pieces(chosen_ends):  # the arrays of a whole unit would stay with the worker
        here = chosen_ends[i : j + 1] - chosen_ends[i]
        place = np.arange(here[-1]) - np.repeat(here[:-1], np.diff(here))
        laid = text[np.repeat(lines.start[at[i:j]], np.diff(here)) + place]
        s, e, owner = kit.words(laid, here)
        h, owner = _distinct(kit.span_hashes(kit.LOWER[laid], s, e), owner)
        order = np.lexsort((h, owner))
        sizes.append(np.bincount(owner, minlength=j - i))
        raw.append(h[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
    cut = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * HASH_BYTES
    raw = np.concatenate(raw)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    return pa.table({"unit": pa.array(np.full(len(at), row["unit"], np.int64)), "line": pa.array(at.astype(np.int64)), "words": words})


def _dropped(text: np.ndarray, ends: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which bytes of some documents go with their lines between `start` and `end`."""
    drop = np.zeros(len(text) + 1, np.int32)
    np.add.at(drop, start, 1)
    np.add.at(drop, end, -1)
    drop = np.cumsum(drop)[:-1] > 0
    of_line = drop.copy()
    feed = np.flatnonzero(text == 10)
    inner = feed + 1 < len(text)
    follows = np.zeros(len(feed), bool)
    follows[inner] = of_line[feed[inner] + 1]
    start = ends[kit.rows_of(feed, ends)]
    follows &= feed + 1 < ends[kit.rows_of(feed, ends) + 1]  # the next line is of the same document
    drop[feed[follows]] = True
    before = np.concatenate([[0], np.cumsum(drop)])
    leading = (feed > start) & (before[feed] - before[start] == feed - start)
    leading[leading] = of_line[feed[leading] - 1]
    drop[feed[leading]] = True
    return drop


def _cut(key, unit_table: pa.Table, reply: pa.Table) -> pa.Table:
    """The texts of a unit without its removed lines."""
    (row,) = unit_table.to_pylist()
    ids, ends, text = kit.open_unit(row)
    lines = Lines(text, ends)
    gone = [np.frombuffer(x, "<u4").astype(np.int64) for x in reply["payload"].to_pylist() if x is not None]
    gone += [reply["line"].drop_null().to_numpy()]
    gone = np.unique(np.concatenate(gone)).astype(np.int64)
    kept, sizes, n_lines = [], [], []
    for i, j in kit.pieces(ends):  # the arrays of a whole unit would stay with the worker
        piece, here = text[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        of = slice(*np.searchsorted(lines.row, (i, j)))
        start, end = lines.start[of] - ends[i], lines.end[of] - ends[i]
        word_starts = kit.runs(kit.WORD[piece], here)[0]
        worded = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, start)
        n_lines.append(np.bincount(lines.row[of][worded] - i, minlength=j - i))
        out = gone[slice(*np.searchsorted(gone, (of.start, of.stop)))] - of.start
        stays = ~_dropped(piece, here, start[out], end[out])
        kept.append(piece[stays])
        sizes.append(kit.row_sums(stays, here))
    kept_ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    kept = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(kept_ends.tobytes()), pa.py_buffer(np.concatenate(kept).tobytes()))
    n = len(ids)
    out = pa.table({
        "doc_id": kit.ids_back(ids), "n_lines": pa.array(np.concatenate(n_lines).astype(np.int64)),
        "n_removed": pa.array(np.bincount(lines.row[gone], minlength=n).astype(np.int64)), "kept": kept.cast(pa.string()),
    })
    if row["rest"] is not None:
        rest = kit.carried_rows(row)
        for name in rest.column_names:
            out = out.append_column(name, rest[name])
    return out


def _agree(batches):
    """(unit, line) of the rows whose two sets reach the threshold."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        x, y = batch.column(2), batch.column(3)
        for k in range(batch.num_rows):
            a, b = x[k].as_buffer(), y[k].as_buffer()
            n = (a.size + b.size) // HASH_BYTES
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :HASH_BYTES] = np.frombuffer(a.to_pybytes() + b.to_pybytes(), np.uint8).reshape(n, HASH_BYTES)
            both = np.sort(wide.view(np.uint64).reshape(-1))
            common = int((both[1:] == both[:-1]).sum())
            keep[k] = 100 * common >= PERCENT * (n - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["unit", "line"]).filter(pa.array(keep))


def _same(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(unit, line) of the y lines whose set reaches the threshold with that of x."""
    # Alike in form, so that both joins read one exchange of the sets.
    x, y = (sets.select(F.col("unit").alias(f"{s}_unit"), F.col("line").alias(f"{s}_line"), F.col("words").alias(f"{s}_words")) for s in "xy")
    named = pairs.select(F.col("unit").alias("y_unit"), F.col("line").alias("y_line"), "x_unit", "x_line")
    both = named.join(x, ["x_unit", "x_line"]).join(y, ["y_unit", "y_line"])
    return both.select("y_unit", "y_line", "x_words", "y_words").mapInArrow(_agree, "unit long, line long").distinct()


def _once(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("unit", "line", "x_unit", "x_line").agg(F.min("far").alias("far"))


def _pairs_of(rows: DataFrame) -> DataFrame:
    return _once(rows.where(F.col("kind") == PAIR).select("size", "payload").mapInArrow(_open_pairs, PAIR_SCHEMA))


def _sets(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """The word sets of both lines of all pairs."""
    wanted = pairs.select("unit", "line").union(pairs.select("x_unit", "x_line")).distinct()
    return units.groupBy("unit").cogroup(wanted.groupBy("unit")).applyInArrow(_read_sets, "unit long, line long, words binary")


def matched_lines(units: DataFrame, n_bytes: int, nearest: int = NEAREST, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Lines that repeat a class, packed by unit, and first lines of a class with an earlier match."""
    spark = units.sparkSession
    n_buckets = kit.bucket_count(n_bytes, BUCKET_BYTES)
    rarity = spark.sparkContext.broadcast(sketch(units))
    judged = kit.settled(
        units.mapInArrow(_send(rarity, n_buckets, split), SENT_SCHEMA).groupBy("bucket").applyInArrow(_judge(nearest), JUDGED_SCHEMA)
    )
    y, x = ["unit", "line"], ["x_unit", "x_line"]
    pairs = kit.settled(_pairs_of(judged))
    sets = kit.settled(_sets(units, pairs))
    best = pairs.groupBy(*y).agg(F.min(F.struct("far", *x)).alias("b")).select(*y, "b.x_unit", "b.x_line")
    done = kit.settled(_same(best, sets))
    rest = pairs.join(done, y, "left_anti").join(best, [*y, *x], "left_anti")
    done = kit.settled(done.union(_same(rest, sets)))
    waiting = kit.settled(judged.where(F.col("kind") == OPEN).select("token", *y).join(done, y, "left_anti"))
    if not waiting.isEmpty():
        lists = judged.where(F.col("kind") == LIST).select("token", "size", "payload")
        late = lists.groupBy("token").cogroup(waiting.groupBy("token")).applyInArrow(_late, PAIR_SCHEMA)
        late = kit.settled(_once(late).join(pairs, [*y, *x], "left_anti"))
        done = kit.settled(done.union(_same(late, kit.settled(_sets(units, late)))))
    return judged.where(F.col("kind") == REPEATED).select("unit", "payload"), done


def dedup_lines(docs: DataFrame, carry: bool = False, nearest: int = NEAREST, split: int = SPLIT) -> DataFrame:
    """doc_id, n_lines, n_removed and the kept text of every row of `docs`; the lines counted are
    those with a word. With `carry`, the other columns of `docs` as well (see kit.units). `nearest`
    and `split` (see above) set the cost, not the result."""
    kit.prepare(docs.sparkSession)
    units = kit.units(docs, carry)
    n_bytes = units.agg(F.sum("n_bytes")).first()[0] or 0
    repeated, matched = matched_lines(units, n_bytes, nearest, split)
    none = F.lit(None)
    replies = repeated.select("unit", none.cast("long").alias("line"), "payload").union(matched.select("unit", "line", none.cast("binary")))
    schema = StructType(list(RESULT_SCHEMA.fields))
    for k, field in enumerate(docs.schema.fields if carry else []):
        if field.name != "text":
            schema.add(f"carried_{k}", field.dataType)
    return units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(_cut, schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that repeat earlier ones, and without documents of which nothing is
    left; n_chars, where there is such a column, is counted anew."""
    rows = dedup_lines(docs, carry=True).where("n_lines = 0 OR n_removed < n_lines")
    columns = []
    for k, c in enumerate(docs.columns):
        value = F.col("kept") if c == "text" else F.col(f"carried_{k}")
        if c == "n_chars":
            value = F.length("kept").cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return rows.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(kit.read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH piece AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
line AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, n) AS place FROM piece WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
word AS (
  SELECT DISTINCT place, unnest(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w
  FROM line),
setof AS (SELECT place, list(w ORDER BY w) AS ws, count(*) AS size FROM word GROUP BY place),
class AS (SELECT ws, size, min(place) AS place FROM setof GROUP BY ws, size),
df AS (SELECT w, count(*) AS df FROM word JOIN class USING (place) GROUP BY w),
ranked AS (
  SELECT place, w, size, row_number() OVER (PARTITION BY place ORDER BY df, w) AS pos FROM word JOIN class USING (place) JOIN df USING (w)),
head AS (SELECT * FROM ranked WHERE pos <= size - ceil({PERCENT} * size / 100.0) + 1),
pair AS (
  SELECT DISTINCT x.place AS x, y.place AS y FROM head x JOIN head y ON x.w = y.w AND x.place < y.place
  WHERE 100 * least(x.size, y.size) >= {PERCENT} * greatest(x.size, y.size)),
hit AS (
  SELECT DISTINCT p.y AS place FROM pair p JOIN class a ON a.place = p.x JOIN class b ON b.place = p.y
  WHERE 100 * len(list_intersect(a.ws, b.ws)) >= {PERCENT} * (a.size + b.size - len(list_intersect(a.ws, b.ws)))),
gone AS (
  SELECT doc_id, n FROM line WHERE place NOT IN (SELECT place FROM class) OR place IN (SELECT place FROM hit)),
kept AS (
  SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE g.n IS NULL), '') AS kept,
         count(g.n) AS n_removed, count(*) FILTER (WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) AS n_lines
  FROM piece LEFT JOIN gone g USING (doc_id, n) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)"""
