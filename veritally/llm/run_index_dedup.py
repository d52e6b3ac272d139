"""Repeated passages by a run-length index: a run-compressed Burrows-Wheeler transform.

A byte of a document is removed if a string of `MATCH` bytes that covers it also starts in a
document with a smaller doc_id. Strings are judged on the input, and every occurrence counts.

The corpus is parsed as for a prefix-free parsing of the transform. Each window of MATCH bytes has
an anchor, the smallest hash among the ANCHOR-byte strings in it, and consecutive windows with the
same anchor form a phrase. Equal windows have equal anchors, so phrases of one anchor hold all
occurrences of their windows, and anchors can be dealt to buckets that know nothing of each other.

1. Units (kit) send one record per anchor: a digest of its phrase, and whether the unit has it in
   several documents or with several phrases. A bucket sees which anchors occur in two documents
   and which of those have one phrase everywhere.
2. Units send the phrases of shared anchors: bytes and smallest doc_id, each distinct phrase once.
   An anchor with one phrase is one run at each row of the transform; only its documents are sent.
   An anchor with very many phrases (`HOT`) is split, so no bucket gathers a frequent passage's
   surroundings: its phrases are parsed once more by longer anchors (`LONGER`), the longer the more
   phrases there are, at last by whole windows, and dealt by those. A larger corpus makes more
   anchors hot; with the next length a phrase becomes about two, where windows alone would be
   sixteen strings of MATCH bytes.
3. A bucket sorts the suffixes of its distinct phrases, keeps the transform as runs, with the
   smallest doc_id sampled at the end of each run of suffixes that share MATCH bytes, and streams
   all phrases through it from right to left by LF steps over the runs. At each position this
   gives the matching statistic that matters: whether MATCH bytes match an earlier document.
4. Units get back, per phrase, its smallest doc_id and the windows that are older still, mark the
   covered bytes and return spans and what is left.

All exchanges are packed rows; nothing goes through the driver.

Defined results: a NULL text is empty; documents shorter than MATCH lose nothing; a NULL doc_id
is larger than any other, rows that share a doc_id (also NULL) are not earlier than each other;
columns other than doc_id and text are ignored; an empty table gives an empty result. Matches
never cross documents, and whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit

MATCH = 50
ANCHOR = 20
HOT = 2048  # phrases of one anchor, counted by unit, from which they are parsed by longer anchors
LONGER = (32, 41, MATCH)  # bytes of these, each for HOT_STEP times as many phrases as the one before
HOT_STEP = 8
BUCKET_BYTES = 4 << 20  # text per bucket: its suffixes are sorted in memory
GROUPS = 128  # from here on neighbouring buckets travel as one packed row, up to ...
TOGETHER = 8  # ... so many: rows are units times groups
# Codes of an anchor: in one document only, one phrase, several, very many (MANY + k: parsed by LONGER[k]).
ALONE, ONE, FEW, MANY = range(4)
RECORD = np.dtype([("a_low", "<u4"), ("a_high", "<u2"), ("c_low", "<u4"), ("c_high", "<u2"), ("n", "u1")])
KNOWN = np.dtype([("a_low", "<u4"), ("a_high", "<u2"), ("doc", "<i8")])
REPLY_SCHEMA = "unit long, kind int, bucket long, payload binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
_48 = np.uint64((1 << 48) - 1)


def _split48(values: np.ndarray, records: np.ndarray, name: str) -> None:
    records[f"{name}_low"] = values & np.uint64(0xFFFFFFFF)
    records[f"{name}_high"] = values >> np.uint64(32)


def _join48(records: np.ndarray, name: str) -> np.ndarray:
    return records[f"{name}_high"].astype(np.uint64) << np.uint64(32) | records[f"{name}_low"].astype(np.uint64)


def bucket_of(anchors: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of 48-bit hashes, in the order of the hashes."""
    return ((anchors >> np.uint64(16)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[..., : out.shape[-1] - step], out[..., step:])
        have += step
    return out


def _phrases(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, anchor (48 bits) and row of the phrases of some documents."""
    n = len(text) - MATCH + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    at = np.arange(len(text) - ANCHOR + 1)
    h = kit.span_hashes(text, at, at + ANCHOR)
    # The place in the low bits tells anchors of one window apart; equal hashes are equal strings.
    low = _sliding_min((h & ~np.uint64(63)) | (at.astype(np.uint64) & np.uint64(63)), MATCH - ANCHOR + 1)[:n]
    ok = np.ones(n + 1, bool)
    ok[n] = False
    lose = ends[1:-1]  # windows that start in the last MATCH - 1 bytes of a document would cross
    if len(lose):
        mark = np.zeros(len(text) + 2, np.int32)
        np.add.at(mark, np.maximum(lose - MATCH + 1, ends[:-2]), 1)
        np.add.at(mark, lose, -1)
        ok[:n] = np.cumsum(mark)[:n] == 0
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | ~ok[:-2]
    starts = np.flatnonzero(new & ok[:-1])
    stop = np.flatnonzero(ok[:-1] & (np.concatenate([new[1:], [True]]) | ~ok[1:])) + 1
    return starts, stop - starts, (low[starts] >> np.uint64(6)) & _48, kit.rows_of(starts, ends)


def _parsed_again(text: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: int) -> tuple[np.ndarray, ...]:
    """The phrases by anchors of `anchor` bytes in phrases by shorter ones: start, windows, anchor
    (the lower 48 bits: the upper ones of a smallest hash are low), content (48 bits) and number of the
    phrase that each is from."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a in range(0, len(start), 1 << 12):  # hashed from copies: a window does not need its surroundings
        s, n = start[a : a + (1 << 12)], windows[a : a + (1 << 12)]
        width = int(n.max()) + MATCH - 1
        laid = text[np.minimum(s[:, None] + np.arange(width), len(text) - 1)].reshape(-1)
        at = (np.arange(len(s)) * width)[:, None] + np.arange(width - anchor + 1)
        low = _sliding_min(kit.span_hashes(laid, at, at + anchor), MATCH - anchor + 1)
        new = np.arange(low.shape[1]) < n[:, None]
        new[:, 1:] &= low[:, 1:] != low[:, :-1]
        row, k = np.nonzero(new)
        stop = np.append(k[1:], 0)
        last = np.append(row[1:] != row[:-1], True)
        stop[last] = n[row[last]]
        begin = row * width + k
        parts.append((s[row] + k, stop - k, low[row, k] & _48, kit.span_hashes(laid, begin, begin + stop - k + MATCH - 1) & _48, row + a))
    return tuple(np.concatenate(x) for x in zip(*parts))


class Parsed:
    """The phrases of a unit, sorted by anchor and phrase, and its anchors."""

    def __init__(self, ends: np.ndarray, text: np.ndarray):
        parts = []
        for i, j in kit.pieces(ends):
            a = ends[i]
            piece = text[a : ends[j]]
            s, n, anchor, row = _phrases(piece, ends[i : j + 1] - a)
            parts.append((s + a, n, anchor, row + i, kit.span_hashes(piece, s, s + n + MATCH - 1) & _48))
        joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        order = np.lexsort((joined[4], joined[2]))
        self.start, self.windows, self.anchor, self.row, self.content = (x[order] for x in joined)
        self.new_anchor = kit.first_true(self.anchor)
        self.new_phrase = self.new_anchor | kit.first_true(self.content)
        self.heads = np.flatnonzero(self.new_anchor)
        self.group = np.cumsum(self.new_anchor) - 1  # anchor number of each phrase

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors, and their records: digest of the phrase; n: number of phrases (127 at most,
        0 for one) times 2, plus 1 if they stand in several documents."""
        heads = self.heads
        anchors = self.anchor[heads]
        out = np.zeros(len(heads), RECORD)
        if len(heads):
            _split48(anchors, out, "a")
            _split48(self.content[heads], out, "c")
            phrases = np.add.reduceat(self.new_phrase.astype(np.int64), heads)
            several = np.minimum.reduceat(self.row, heads) != np.maximum.reduceat(self.row, heads)
            out["n"] = np.where(phrases > 1, np.minimum(phrases, 127), 0) * 2 + several
        return anchors, out


def _send_anchors(n_buckets: int):
    def run(batches):
        for unit, _, ends, text in kit.unit_rows(batches):
            anchors, records = Parsed(ends, text).records()
            batch = kit.deal(unit, 0, bucket_of(anchors, n_buckets), records)
            if batch:
                yield batch

    return run


def _judge_anchors(hot: int):
    return lambda table: _codes_of(table, hot)


def _codes_of(table: pa.Table, hot: int) -> pa.Table:
    """A code for each record of a bucket, returned to the unit that sent it."""
    records, sender = kit.unpack(table, RECORD)
    anchors, content, n = _join48(records, "a"), _join48(records, "c"), records["n"].astype(np.int64)
    order = np.argsort(anchors, kind="stable")
    new = kit.first_true(anchors[order])
    heads = np.flatnonzero(new)
    content, n = content[order], n[order]
    times = np.diff(np.concatenate([heads, [len(order)]]))
    shared = (times > 1) | (np.maximum.reduceat(n & 1, heads) > 0)
    mixed = (np.minimum.reduceat(content, heads) != np.maximum.reduceat(content, heads)) | (np.maximum.reduceat(n, heads) > 1)
    phrases = np.add.reduceat(np.maximum(n >> 1, 1), heads)
    longer = sum((phrases > hot * HOT_STEP**k).astype(np.uint8) for k in range(len(LONGER)))
    code = np.where(~shared, ALONE, np.where(~mixed, ONE, FEW + longer)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = code[np.cumsum(new) - 1]
    cut = np.flatnonzero(kit.first_true(sender))
    payload = [x.tobytes() for x in np.split(out, cut[1:])]
    n_rows = table.num_rows
    return pa.table({"unit": table["unit"], "kind": pa.array(np.zeros(n_rows, np.int32)), "bucket": table["bucket"], "payload": pa.array(payload, pa.binary())})


def _codes(replies: list[dict], parsed: Parsed) -> np.ndarray:
    """The code of each phrase: replies in the order of the buckets are in the order of the anchors."""
    got = sorted((r for r in replies if r["kind"] == 0), key=lambda r: r["bucket"])
    by_anchor = np.frombuffer(b"".join(r["payload"] for r in got), np.uint8)
    return by_anchor[parsed.group]


class Shared:
    """What a unit sends and gets back: known phrases (one per anchor) and strings."""

    def __init__(self, parsed: Parsed, code: np.ndarray, ids: np.ndarray, text: np.ndarray, n_groups: int, together: int = 1):
        doc = ids[parsed.row]
        one = np.flatnonzero(code == ONE)
        self.one, heads = one, kit.first_true(parsed.group[one])
        self.one_of = np.cumsum(heads) - 1
        self.anchors = parsed.anchor[one[heads]]
        self.one_doc = np.minimum.reduceat(doc[one], np.flatnonzero(heads)) if len(one) else np.zeros(0, np.int64)
        few = np.flatnonzero(code == FEW)
        # Occurrences: phrases as they are, those of hot anchors by longer anchors.
        strings = [(parsed.start[few], parsed.windows[few], doc[few], parsed.anchor[few], parsed.content[few])]
        for k, longer in enumerate(LONGER):
            hot = np.flatnonzero(code == MANY + k)
            start, windows, anchor, content, of = _parsed_again(text, parsed.start[hot], parsed.windows[hot], longer)
            strings.append((start, windows, doc[hot][of], anchor, content))
        self.start, self.windows, self.doc, deal_by, same = (np.concatenate(x) for x in zip(*strings))
        order = np.lexsort((same, deal_by))
        new = kit.first_true(deal_by[order]) | kit.first_true(same[order])
        self.string_of = np.empty(len(order), np.int64)
        self.string_of[order] = np.cumsum(new) - 1
        first = order[new]
        self.string_start, self.string_size = self.start[first], self.windows[first] + MATCH - 1
        self.string_doc = np.minimum.reduceat(self.doc[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
        n_buckets = n_groups * together
        self.one_cut = np.searchsorted(bucket_of(self.anchors, n_groups), np.arange(n_groups + 1))
        self.bucket_cut = np.searchsorted(bucket_of(deal_by[first], n_buckets), np.arange(n_buckets + 1))
        self.string_cut = self.bucket_cut[::together]

    def groups(self) -> np.ndarray:
        return np.flatnonzero((np.diff(self.one_cut) > 0) | (np.diff(self.string_cut) > 0))


def _bytes_at(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return text[np.repeat(starts, sizes) + place]


def _send_phrases(n_groups: int, together: int):
    def run(key, unit_table, reply_table):
        (row,) = unit_table.to_pylist()
        ids, ends, text = kit.open_unit(row)
        parsed = Parsed(ends, text)
        out = {"bucket": [], "unit": [], "part": [], "payload": []}
        if len(parsed.heads):
            shared = Shared(parsed, _codes(reply_table.to_pylist(), parsed), ids, text, n_groups, together)
            known = np.zeros(len(shared.anchors), KNOWN)
            _split48(shared.anchors, known, "a")
            known["doc"] = shared.one_doc
            sizes = shared.string_size.astype(np.uint8)
            raw = _bytes_at(text, shared.string_start, shared.string_size)
            at = np.concatenate([[0], np.cumsum(shared.string_size)])
            counts = np.diff(shared.bucket_cut).reshape(-1, together)
            for g in shared.groups():
                (a, b), (i, j) = shared.one_cut[g : g + 2], shared.string_cut[g : g + 2]
                body = b"".join([
                    np.array([b - a, *counts[g]], np.int64).tobytes(), known[a:b].tobytes(), shared.string_doc[i:j].tobytes(),
                    sizes[i:j].tobytes(), raw[at[i] : at[j]].tobytes(),
                ])
                out["bucket"].append(int(g))
                out["unit"].append(row["unit"])
                out["part"].append(len(body))
                out["payload"].append(pa.compress(body, codec="zstd", asbytes=True))
        return pa.table(out, pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())]))

    return run


def _sorted_suffixes(padded: np.ndarray, left: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes in their order, equal ones in the order of their strings; and whether
    each shares MATCH bytes with the one before it. Sorted by 8 bytes; then those that are still equal
    to others, by the ranks of what follows, of 16, 32 and 64 bytes, until none are."""
    n = len(padded)
    word = padded.astype(np.uint64)
    for by in (1, 2, 4):
        after = np.zeros(n, np.uint64)
        after[: max(n - by, 0)] = word[by:]
        after[left <= by] = 0
        word = word << np.uint64(8 * by) | after
    suffix = np.argsort(word)
    new = kit.first_true(word[suffix])
    rank = np.empty(n, np.uint32)  # the row of the first suffix that is equal so far
    rank[suffix] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    del word
    rows = np.arange(n)
    at32 = None
    for by in (8, 16, 32, 64):
        if by == 32:
            at32 = rank.copy()
        # Rows that are alone are where they belong.
        alone = new & np.concatenate([new[1:], [True]])
        rows = rows[~alone]
        if not len(rows):
            break
        at = suffix[rows]
        own = rank[at]
        # What has ended within these bytes is equal to the end: then strings decide.
        follows = np.where(left[at] > by, rank[np.minimum(at + by, n - 1)], string[at])
        key = own.astype(np.uint64) << np.uint64(32) | follows
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = kit.first_true(key)
        suffix[rows] = at
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    at32 = rank if at32 is None else at32
    alike = np.zeros(n, bool)
    long = np.flatnonzero(left[suffix] > MATCH)
    x, y = at32[suffix[long]], at32[suffix[long] + MATCH - 32]
    alike[long[1:]] = (long[1:] == long[:-1] + 1) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return suffix, alike


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with samples at run ends.

    Strings end in a mark of their own, smaller than any byte and ordered as the strings are.
    Suffixes are sorted whole; LF steps need only the runs.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        ends = np.cumsum(sizes + 1)
        self.n = n = int(ends[-1])
        if n >= 1 << 31:
            raise ValueError("a bucket's strings must have less than 2 GiB")
        padded = np.zeros(n, np.uint8)  # 0 is the mark; UTF-8 has no byte 0xFF, so 1 can be added
        string = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes + 1)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        padded[inside] = np.minimum(text, 254) + np.uint8(1)
        left = (ends[string] - np.arange(n)).astype(np.uint8)  # bytes up to the end of the string, its mark included
        suffix, alike = _sorted_suffixes(padded, left, string)
        before = np.where(left[suffix - 1] > 1, padded[suffix - 1], 0)  # of a string's first byte: its mark
        run_start = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        self.run_start, self.run_byte = run_start, before[run_start]
        length = np.diff(np.concatenate([run_start, [n]]))
        # LF of a run's first row: rows that start with smaller bytes, and the same byte in earlier runs.
        by_byte = np.argsort(self.run_byte, kind="stable")
        to = np.empty(len(run_start), np.int64)
        to[by_byte] = np.concatenate([[0], np.cumsum(length[by_byte])[:-1]])
        self.run_shift = (to - run_start).astype(np.int32)
        self.run_of = np.repeat(np.arange(len(run_start), dtype=np.int32), length)
        # Rows whose suffixes share MATCH bytes are neighbours; their oldest document is sampled at the run's end.
        class_start = np.flatnonzero(~alike)
        self.class_doc = np.minimum.reduceat(docs[string[suffix]], class_start)
        self.class_of = np.repeat(np.arange(len(class_start), dtype=np.int32), np.diff(np.concatenate([class_start, [n]])))

    def older_windows(self, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Per string, bit k set if its window k also stands in a string of a smaller document."""
        by_size = np.argsort(-sizes, kind="stable")  # so that the strings still read are the first ones
        rows = by_size.astype(np.int32)  # the rows of the end marks
        left, docs = sizes[by_size].astype(np.int32), docs[by_size]
        bits = np.zeros(len(sizes), np.uint32)
        for step in range(1, int(left[0]) + 1 if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "right"))
            rows = rows[:live]
            rows = rows + self.run_shift[self.run_of[rows]]
            if step >= MATCH:
                older = self.class_doc[self.class_of[rows]] < docs[:live]
                bits[:live] |= older.astype(np.uint32) << (left[:live] - step).astype(np.uint32)
        out = np.empty_like(bits)
        out[by_size] = bits
        return out


def _older_in_bucket(docs: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per string of a bucket, its smallest document and the windows that are older still."""
    at = np.cumsum(sizes) - sizes
    strings = np.zeros((len(sizes), int(sizes.max())), np.uint8)
    strings[np.arange(strings.shape[1])[None, :] < sizes[:, None]] = raw
    strings += 1  # so that padding differs from bytes
    strings[np.arange(strings.shape[1])[None, :] >= sizes[:, None]] = 0
    as_bytes = strings.view(f"V{strings.shape[1]}").reshape(-1)
    laid = np.ascontiguousarray(strings).reshape(-1)
    s = np.arange(len(sizes)) * strings.shape[1]
    digest = kit.span_hashes(laid, s, s + sizes)
    order = np.lexsort((docs, digest))
    new = kit.first_true(digest[order])
    new[1:] |= as_bytes[order[1:]] != as_bytes[order[:-1]]
    # Distinct strings, in the order of their documents.
    first = order[new]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    by_doc = np.argsort(docs[first], kind="stable")
    first = first[by_doc]
    place = np.empty(len(first), np.int64)
    place[by_doc] = np.arange(len(first))
    number = place[number]
    index = RunIndex(_bytes_at(raw, at[first], sizes[first]), sizes[first], docs[first])
    return docs[first][number], index.older_windows(sizes[first], docs[first])[number]


def _judge_phrases(together: int):
    def run(table: pa.Table) -> pa.Table:
        known, docs, sizes, raw, counts = [], [], [], [], []
        for size, payload in zip(table["part"].to_pylist(), table["payload"].to_pylist()):
            body = pa.decompress(payload, size, codec="zstd", asbytes=True)
            count = np.frombuffer(body, np.int64, 1 + together)
            n_known, n = int(count[0]), int(count[1:].sum())
            at = count.nbytes
            known.append(np.frombuffer(body, KNOWN, n_known, at))
            at += n_known * KNOWN.itemsize
            docs.append(np.frombuffer(body, np.int64, n, at))
            sizes.append(np.frombuffer(body, np.uint8, n, at + 8 * n).astype(np.int64))
            raw.append(np.frombuffer(body, np.uint8, offset=at + 9 * n))
            counts.append(count)
        counts = np.array(counts)
        known, docs, sizes, raw = (np.concatenate(x) for x in (known, docs, sizes, raw))

        anchors = _join48(known, "a")
        order = np.argsort(anchors, kind="stable")
        heads = kit.first_true(anchors[order])
        known_doc = np.empty(len(order), np.int64)
        if len(order):
            known_doc[order] = np.minimum.reduceat(known["doc"][order], np.flatnonzero(heads))[np.cumsum(heads) - 1]

        bits, string_doc = np.zeros(len(docs), np.uint32), docs.copy()
        bucket = np.repeat(np.tile(np.arange(together), len(counts)), counts[:, 1:].reshape(-1))
        at = np.cumsum(sizes) - sizes
        for b in range(together):
            own = np.flatnonzero(bucket == b)
            if len(own):
                string_doc[own], bits[own] = _older_in_bucket(docs[own], sizes[own], _bytes_at(raw, at[own], sizes[own]))
        payload = []
        one_at = np.concatenate([[0], np.cumsum(counts[:, 0])])
        string_at = np.concatenate([[0], np.cumsum(counts[:, 1:].sum(axis=1))])
        for k in range(table.num_rows):
            i, j = string_at[k : k + 2]
            body = known_doc[one_at[k] : one_at[k + 1]].tobytes() + string_doc[i:j].tobytes() + bits[i:j].tobytes()
            payload.append(np.array([len(body)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True))
        return pa.table({"unit": table["unit"], "kind": pa.array(np.ones(table.num_rows, np.int32)), "bucket": table["bucket"], "payload": pa.array(payload, pa.binary())})

    return run


def _marked(parsed: Parsed, shared: Shared, replies: list[dict], ids: np.ndarray, n_bytes: int) -> np.ndarray:
    """Covered bytes of a unit."""
    ones, docs, bits = [], [], []
    for reply in sorted((r for r in replies if r["kind"] == 1), key=lambda r: r["bucket"]):
        size = int(np.frombuffer(reply["payload"], np.int64, 1)[0])
        body = pa.decompress(reply["payload"][8:], size, codec="zstd", asbytes=True)
        n = int(np.diff(shared.one_cut[reply["bucket"] : reply["bucket"] + 2])[0])
        m = int(np.diff(shared.string_cut[reply["bucket"] : reply["bucket"] + 2])[0])
        ones.append(np.frombuffer(body, np.int64, n))
        docs.append(np.frombuffer(body, np.int64, m, 8 * n))
        bits.append(np.frombuffer(body, np.uint32, m, 8 * (n + m)))
    change = np.zeros(n_bytes + 1, np.int32)
    if ones:
        oldest = np.concatenate(ones)[shared.one_of]
        hit = shared.one[ids[parsed.row[shared.one]] > oldest]
        np.add.at(change, parsed.start[hit], 1)
        np.add.at(change, parsed.start[hit] + parsed.windows[hit] + MATCH - 1, -1)
        later = shared.doc > np.concatenate(docs)[shared.string_of]
        every = (np.uint64(1) << shared.windows.astype(np.uint64)) - np.uint64(1)
        mine = np.where(later, every, np.concatenate(bits)[shared.string_of].astype(np.uint64))
        for k in range(MATCH - ANCHOR + 1):
            at = shared.start[mine >> np.uint64(k) & np.uint64(1) > 0] + k
            np.add.at(change, at, 1)
            np.add.at(change, at + MATCH, -1)
    return np.cumsum(change)[:-1] > 0


def _cut(n_groups: int, together: int):
    def run(key, unit_table, reply_table):
        (row,) = unit_table.to_pylist()
        ids, ends, text = kit.open_unit(row)
        parsed = Parsed(ends, text)
        covered = np.zeros(len(text), bool)
        if len(parsed.heads):
            replies = reply_table.to_pylist()
            shared = Shared(parsed, _codes(replies, parsed), ids, text, n_groups, together)
            covered = _marked(parsed, shared, replies, ids, len(text))
        s, e = kit.runs(covered, ends)
        owner = kit.rows_of(s, ends)
        cut = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
        kept_ends = ends - np.concatenate([[0], np.cumsum(covered)])[ends]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept_ends.astype(np.int64).tobytes()), pa.py_buffer(text[~covered].tobytes())])
        return pa.table({
            "doc_id": kit.ids_back(ids), "n_bytes": pa.array(np.diff(ends)),
            "starts": pa.ListArray.from_arrays(pa.array(cut), pa.array(s - ends[owner])),
            "ends": pa.ListArray.from_arrays(pa.array(cut), pa.array(e - ends[owner])),
            "kept": kept.cast(pa.binary()),
        })

    return run


def _grouped(n_buckets: int) -> tuple[int, int]:
    """Groups of buckets, and buckets in each."""
    together = min(max(n_buckets // GROUPS, 1), TOGETHER)
    return -(-n_buckets // together), together


def cut_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed byte spans, and the kept bytes of every row.
    `hot` (see above) sets the cost, not the result."""
    kit.prepare(docs.sparkSession)
    n_groups, together = _grouped(kit.bucket_count(kit.corpus_size(docs)[1], BUCKET_BYTES))
    units = kit.units(docs)
    by_bucket = lambda sent, judge: sent.groupBy("bucket").applyInArrow(judge, REPLY_SCHEMA)
    codes = kit.settled(by_bucket(units.mapInArrow(_send_anchors(n_groups), kit.PACKED_SCHEMA), _judge_anchors(hot)))
    with_units = lambda replies, run, schema: units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(run, schema)
    replies = kit.settled(by_bucket(with_units(codes, _send_phrases(n_groups, together), kit.PACKED_SCHEMA), _judge_phrases(together)))
    return with_units(codes.union(replies), _cut(n_groups, together), RESULT_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_repeats(kit.read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS place, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT rid, place, p, array_slice(b, p + 1, p + {MATCH}) AS s
  FROM (SELECT rid, place, b, unnest(range(octet_length(b) - {MATCH} + 1)) AS p FROM d)),
oldest AS (SELECT s, min(place) AS oldest FROM w GROUP BY s HAVING min(place) < max(place)),
hit AS (SELECT rid, p FROM w JOIN oldest USING (s) WHERE oldest < place),
marked AS (
  SELECT rid, p, sum(CASE WHEN p > before + {MATCH} OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS span
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM hit)),
gone AS (SELECT rid, min(p) AS a, max(p) + {MATCH} AS z FROM marked GROUP BY rid, span),
cut AS (
  SELECT rid, a, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS from_, z FROM gone),
kept AS (
  SELECT rid, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
         string_agg(hex(array_slice(b, from_ + 1, a)), '' ORDER BY a) AS head FROM cut JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(last, 0) + 1, octet_length(b))))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""
