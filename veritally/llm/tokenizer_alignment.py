"""Alignment of two tokenizers over a corpus, with a fast path for tokens that have the same bytes.

Tokenizer A (a `tokenizers` file) encodes space + text; tokenizer B (a `sentencepiece` model) encodes
the text and adds that space itself. Byte offsets where tokens of both end cut the text into groups.
A link is a pair of an A and a B token whose byte ranges end together: the last two of a group. The
count of a pair of ids is the number of links of the whole corpus that hold it.

1. One scan tokenizes and groups. Both tokenizers run once on each different chunk of a unit (see
   `tokens`: chunks end at group borders), so groups, links and their digests are made per chunk and
   added up per document. A unit keeps its chunks' links and the chunk numbers of its documents.
2. The identity map is an array from A ids to the B id of the same bytes. Links of an A token with
   its identity are counted in one vector of the vocabulary's length per task; Spark adds the vectors.
3. All other links enter the pair exchange: a unit sends each of its different pairs once, with its
   number of occurrences, to the pair's bucket, and gets the corpus-wide count back. A frequent pair
   costs a record per unit, however often it occurs.
4. The highest count of every B id is one number per id. Each unit then adds up its documents.

What is broadcast is bounded by the vocabularies: both token tables, the identity counts, the
highest counts.

Defined results: a document has no tokens, and zeros with an empty digest, if its text is NULL or
empty, or if the joined bytes of its A or its B tokens differ from space + text (B reads U+2581 as a
space, for example); such documents add nothing to the counts. Special tokens inside texts are plain
text. Repeated rows and rows with a NULL doc_id are documents of their own. Texts of any length are
tokenized whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit, tokens

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
AT_ONCE = 4096  # chunks per call of a tokenizer
BUCKET_BYTES = 16 << 20  # text per bucket of pairs
LINKED_SCHEMA = "unit long, n_docs long, n_chunks long, n_different long, n_links long, n_bytes long, docs binary, digests binary, linked binary"
MEASURES = ("n_a", "n_b", "n_groups")
PAIR = np.dtype([("pair", "<u8"), ("n", "<i8")])
REPLY_SCHEMA = "unit long, bucket long, payload binary, highest binary"
HIGHEST = np.dtype([("b", "<i8"), ("n", "<i8")])
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --- tokenizers -------------------------------------------------------------------------------


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def _byte_alphabet() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the other
    bytes in order for the code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, in one worker."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = _byte_alphabet()
        a_words = [b""] * (max(self.a.get_vocab().values(), default=-1) + 1)
        for word, i in self.a.get_vocab().items():
            plain = all(c in letters for c in word)
            a_words[i] = bytes(letters[c] for c in word) if plain else word.encode()
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        is_byte = [self.b.is_byte(i) for i in range(size)]
        b_words = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(pieces, is_byte)]
        self.a_bytes, self.b_bytes = (self._laid(x) for x in (a_words, b_words))
        # Of B ids with the same bytes a piece goes before a byte, then the lower id.
        whole = {}
        for i in sorted(range(size), key=lambda i: (is_byte[i], i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                whole.setdefault(b_words[i], i)
        self.identity = np.array([whole.get(w, -1) if w else -1 for w in a_words], np.int64)
        # Chunks may be encoded alone if no piece goes on after a space within it.
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)

    @staticmethod
    def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    def encode(self, chunks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all chunks and where each chunk's end, for A and for B. Chunks start with a space."""
        a, b = [], []
        for i in range(0, len(chunks), AT_ONCE):
            texts = [c.decode() for c in chunks[i : i + AT_ONCE]]
            a += [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            b += self.b.encode([t[1:] for t in texts], num_threads=1)
        out = []
        for rows in (a, b):
            ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            out.append((np.fromiter(chain.from_iterable(rows), np.int64, ends[-1]), ends))
        return out


_loaded: dict[str, Tokenizers] = {}


def _tokenizers(shared) -> Tokenizers:
    """This worker's tokenizers; a worker serves many tasks and keeps the last pair."""
    key, a_file, b_file = shared.value
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(a_file, b_file)
    return _loaded[key]


# --- groups -----------------------------------------------------------------------------------

def _decimal(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits, right-aligned in 8 columns whose last is free, and which of them to keep."""
    out = np.zeros((len(ids), 8), np.uint8)
    rest = ids.copy()
    for k in range(6, -1, -1):
        rest, digit = np.divmod(rest, 10)
        out[:, k] = digit + 48
    keep = np.arange(8) >= 7 - np.maximum(1, np.searchsorted(10 ** np.arange(1, 8), ids, "right") + 1)[:, None]
    return out, keep


class Aligned:
    """Groups of chunks: `valid` chunks have the same bytes in both tokenizers and the text. For
    each chunk the number of A tokens, B tokens and groups; its links; its groups as text."""

    def __init__(self, kinds: Tokenizers, chunks: list[bytes]):
        (a, a_ends), (b, b_ends) = kinds.encode(chunks)
        text = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64)
        self.valid = self._same(kinds.a_bytes, a, a_ends, text, ends) & self._same(kinds.b_bytes, b, b_ends, text, ends)
        rows = np.flatnonzero(self.valid)
        a, a_ends = tokens.pick(a, a_ends, rows)
        b, b_ends = tokens.pick(b, b_ends, rows)
        a_stop, b_stop = (np.cumsum(np.diff(at)[x]) for (_, at), x in ((kinds.a_bytes, a), (kinds.b_bytes, b)))
        size = int(a_stop[-1]) if len(a) else 0
        both = np.zeros(size + 1, np.uint8)
        both[a_stop] += 1
        both[b_stop] += 2
        a_last, b_last = both[a_stop] == 3, both[b_stop] == 3
        self.a, self.b = a[a_last], b[b_last]  # the links, in order
        a_group, b_group = (np.cumsum(x) - x for x in (a_last, b_last))
        self.link_ends = np.zeros(len(chunks) + 1, np.int64)
        self.measures = np.zeros((len(MEASURES), len(chunks)), np.int64)
        groups = np.concatenate([[0], np.cumsum(a_last)])[a_ends]
        for k, at in enumerate((a_ends, b_ends, groups)):
            self.measures[k, rows] = np.diff(at)
        self.link_ends[1:] = np.cumsum(self.measures[2])
        # Text: the A tokens of a group, then its B tokens.
        n_groups = len(self.a)
        a_before, b_before = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups))]) for g in (a_group, b_group))
        place = np.concatenate([np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_before[b_group + 1]])
        ids, mark = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
        ids[place] = np.concatenate([a, b])
        mark[place] = np.concatenate([np.where(a_last, ord("|"), ord(",")), np.where(b_last, ord(";"), ord(","))])
        letters, keep = _decimal(ids)
        letters[:, 7] = mark
        width = np.concatenate([[0], np.cumsum(keep.sum(1))])
        body, cut = letters[keep].tobytes(), width[a_ends + b_ends].tolist()
        self.texts = [b""] * len(chunks)
        for r, i, j in zip(rows.tolist(), cut[:-1], cut[1:]):
            self.texts[r] = body[i:j]

    @staticmethod
    def _same(words, ids: np.ndarray, id_ends: np.ndarray, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        data, at = words
        size = np.concatenate([[0], np.cumsum(np.diff(at)[ids])])
        same = np.diff(size[id_ends]) == np.diff(ends)
        rows = np.flatnonzero(same)
        chosen, _ = tokens.pick(ids, id_ends, rows)
        laid, _ = tokens.pick(data, at, chosen)
        given, given_ends = tokens.pick(text, ends, rows)
        wrong = np.concatenate([[0], np.cumsum(laid != given)])
        same[rows] = np.diff(wrong[given_ends]) == 0
        return same


def _documents(kinds: Tokenizers, text: np.ndarray, ends: np.ndarray):
    """The groups of all different chunks, the chunk numbers of all rows in order, and where each
    row's end; rows without tokens have none."""
    stops = tokens.chunk_ends(text, ends, kinds.cut)
    number, contents = tokens.distinct_chunks(text, stops)
    aligned = Aligned(kinds, contents.to_pylist())
    row_ends = np.searchsorted(stops, ends)
    bad = np.concatenate([[0], np.cumsum(~aligned.valid[number])])
    good = np.flatnonzero((np.diff(bad[row_ends]) == 0) & (np.diff(ends) > 0))
    kept, at = tokens.pick(number, row_ends, good)
    out = np.zeros(len(ends), np.int64)
    out[good + 1] = np.diff(at)
    return aligned, kept, np.cumsum(out)


def _texts(aligned: Aligned, number: np.ndarray, ends: np.ndarray):
    """The groups of each row as text, empty without tokens."""
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield b"".join([aligned.texts[k] for k in number[i:j].tolist()])[:-1]


# --- one unit ---------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(x.astype("<i8")).tobytes() for x in arrays), codec="zstd", asbytes=True)


def _opened(payload: bytes, *sizes: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(payload, 8 * sum(sizes), codec="zstd", asbytes=True), "<i8")
    return np.split(raw, np.cumsum(sizes)[:-1])


def _linked(shared):
    def run(batches):
        from pyspark import TaskContext

        kinds, part = _tokenizers(shared), TaskContext.get().partitionId()
        for n, (batch, i, j, text, ends) in enumerate(kit.text_pieces(batches, kit.UNIT_BYTES)):
            aligned, number, at = _documents(kinds, text, ends)
            per_chunk = np.concatenate([np.zeros((len(MEASURES), 1), np.int64), np.cumsum(aligned.measures[:, number], axis=1)], axis=1)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in _texts(aligned, number, at)]
            row = {
                "unit": part << 32 | n, "n_docs": j - i, "n_chunks": len(number), "n_different": len(aligned.valid), "n_links": len(aligned.a), "n_bytes": len(text),
                "docs": _packed(kit.ids_of(batch.column(0).slice(i, j - i)), at, *np.diff(per_chunk[:, at])),
                "digests": pa.compress("".join(x.ljust(64) for x in digests).encode(), codec="zstd", asbytes=True),
                "linked": _packed(number, aligned.link_ends, aligned.a, aligned.b),
            }
            yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int64() if isinstance(v, int) else pa.binary()) for k, v in row.items()]))

    return run


class Unit:
    """A unit's links by chunk, and the chunks of its documents."""

    def __init__(self, row: dict, identity: np.ndarray):
        self.unit, self.n_docs, different = row["unit"], row["n_docs"], row["n_different"]
        self.number, self.link_ends, self.a, self.b = _opened(row["linked"], row["n_chunks"], different + 1, row["n_links"], row["n_links"])
        self.times = np.repeat(np.bincount(self.number, minlength=different), np.diff(self.link_ends))  # of each link
        self.alike = identity[self.a] == self.b
        self.pairs, self.place = np.unique((self.a[~self.alike] << 32 | self.b[~self.alike]).astype(np.uint64), return_inverse=True)
        self.pair_times = np.bincount(self.place, self.times[~self.alike], len(self.pairs)).astype(np.int64)
        # Chunks of documents that count nowhere are not among the numbers, so their pairs occur 0 times.
        self.sent = self.pair_times > 0

    def buckets(self, n_buckets: int) -> np.ndarray:
        return (kit.mix(self.pairs[self.sent]) % np.uint64(n_buckets)).astype(np.int64)


def _identity_counts(shared_identity):
    def run(batches):
        identity = shared_identity.value
        total = np.zeros(len(identity), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, identity)
                np.add.at(total, unit.a[unit.alike], unit.times[unit.alike])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["a", "n"])

    return run


def _send(shared_identity, n_buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, shared_identity.value)
                records = np.zeros(int(unit.sent.sum()), PAIR)
                records["pair"], records["n"] = unit.pairs[unit.sent], unit.pair_times[unit.sent]
                if (sent := kit.deal(unit.unit, 0, unit.buckets(n_buckets), records)) is not None:
                    yield sent

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of a bucket's pairs, returned to each unit in the order in which it sent them."""
    records, owner = kit.unpack(table, PAIR)
    pairs, place = np.unique(records["pair"], return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, records["n"])
    b = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, b, total)
    highest = np.zeros(np.count_nonzero(most), HIGHEST)
    highest["b"], highest["n"] = np.flatnonzero(most), most[most > 0]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=table.num_rows))]) * 8
    return pa.table({
        "unit": table["unit"], "bucket": table["bucket"], "payload": tokens.binary(total[place], ends),
        "highest": pa.array([highest.tobytes(), *[None] * (table.num_rows - 1)], pa.binary()),
    })


def _open_highest(batches):
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            rows = np.frombuffer(payload, HIGHEST)
            yield pa.RecordBatch.from_arrays([pa.array(rows["b"].copy()), pa.array(rows["n"].copy())], names=["b", "n"])


def _measure(shared_identity, shared_counts, n_buckets: int):
    def run(key, unit_table: pa.Table, reply_table: pa.Table) -> pa.Table:
        identity = shared_identity.value
        of_a, highest = shared_counts.value
        (row,) = unit_table.to_pylist()
        unit = Unit(row, identity)
        ids, at, *measures = _opened(row["docs"], unit.n_docs, unit.n_docs + 1, *[unit.n_docs] * len(MEASURES))
        replies = sorted(zip(reply_table["bucket"].to_pylist(), reply_table["payload"].to_pylist()))
        returned = np.frombuffer(b"".join(p for _, p in replies), "<i8")
        sent = np.zeros(int(unit.sent.sum()), np.int64)
        sent[kit.undeal(unit.buckets(n_buckets))] = returned
        of_pair = np.zeros(len(unit.pairs), np.int64)
        of_pair[unit.sent] = sent
        count = np.empty(len(unit.a), np.int64)
        count[unit.alike] = of_a[unit.a[unit.alike]]
        count[~unit.alike] = of_pair[unit.place]
        best = count == highest[unit.b]

        def by_document(values: np.ndarray) -> np.ndarray:
            chunk = np.diff(np.concatenate([[0], np.cumsum(values)])[unit.link_ends])
            return np.diff(np.concatenate([[0], np.cumsum(chunk[unit.number])])[at])

        digests = pa.decompress(row["digests"], 64 * unit.n_docs, codec="zstd", asbytes=True).decode()
        return pa.table({
            "doc_id": kit.ids_back(ids), **{name: pa.array(x) for name, x in zip(MEASURES, measures)},
            "n_links": pa.array(by_document(np.ones(len(count), np.int64))), "n_best": pa.array(by_document(best.astype(np.int64))),
            "count_sum": pa.array(by_document(count)),
            "groups_sha256": pa.array([digests[k : k + 64].strip() for k in range(0, len(digests), 64)], pa.string()),
        })

    return run


# --- the corpus -------------------------------------------------------------------------------


def _share(spark: SparkSession, a_path: str | None, b_path: str | None):
    """The files of both tokenizers, as large as the vocabularies, and the identity map."""
    kit.prepare(spark)
    files = []
    for path in (a_path or default_paths()[0], b_path or default_paths()[1]):
        with open(path, "rb") as file:
            files.append(file.read())
    kinds = Tokenizers(*files)
    key = hashlib.sha256(b"".join(files)).hexdigest()
    context = spark.sparkContext
    return context.broadcast((key, *files)), context.broadcast(kinds.identity), kinds.b.get_piece_size()


def _spaced(docs: DataFrame) -> DataFrame:
    """doc_id and space + text; nothing in place of a NULL or empty text."""
    text = F.col("text")
    return kit.id_and_text(docs).select("doc_id", F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).alias("text"))


def _other_pairs(shared_identity):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                unit = Unit(row, shared_identity.value)
                pairs = unit.pairs[unit.sent].astype(np.int64)
                columns = (pairs >> 32, pairs & 0xFFFFFFFF, unit.pair_times[unit.sent])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n"])

    return run


def _units(docs: DataFrame, shared) -> DataFrame:
    return kit.settled(_spaced(docs).mapInArrow(_linked(shared), LINKED_SCHEMA))


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b and n: the number of links that hold the ids a and b, for all pairs that are linked."""
    shared, identity, _ = _share(docs.sparkSession, a_path, b_path)
    units = _units(docs, shared)
    alike = units.mapInArrow(_identity_counts(identity), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    to_b = docs.sparkSession.createDataFrame([(a, b) for a, b in enumerate(identity.value.tolist()) if b >= 0], "a long, b long")
    others = units.mapInArrow(_other_pairs(identity), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return alike.join(F.broadcast(to_b), "a").select("a", "b", "n").union(others)


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and the groups of every row: `a1,a2|b1;a3|b2,b3`, empty without tokens."""
    shared, _, _ = _share(docs.sparkSession, a_path, b_path)

    def run(batches):
        kinds = _tokenizers(shared)
        for batch, i, j, text, ends in kit.text_pieces(batches, kit.UNIT_BYTES):
            rows = [t.decode() for t in _texts(*_documents(kinds, text, ends))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.string())], names=["doc_id", "groups"])

    return _spaced(docs).mapInArrow(run, "doc_id long, groups string")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, the numbers of A tokens, B tokens, groups, links and links with the highest count of
    their B id, the sum of the counts over the links, and the SHA-256 of the groups, per row."""
    spark = docs.sparkSession
    shared, identity, b_size = _share(spark, a_path, b_path)
    units = _units(docs, shared)
    n_bytes = units.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = kit.bucket_count(n_bytes, BUCKET_BYTES)
    replies = kit.settled(units.mapInArrow(_send(identity, n_buckets), kit.PACKED_SCHEMA).groupBy("bucket").applyInArrow(_add_up, REPLY_SCHEMA))
    alike = units.mapInArrow(_identity_counts(identity), "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    tops = replies.where("highest IS NOT NULL").select("highest").mapInArrow(_open_highest, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    of_a, highest = np.zeros(len(identity.value), np.int64), np.zeros(b_size, np.int64)
    for row in alike.toLocalIterator():  # a row per id of A
        of_a[row["a"]] = row["n"]
    for row in tops.toLocalIterator():  # a row per id of B
        highest[row["b"]] = row["n"]
    known = identity.value >= 0
    np.maximum.at(highest, identity.value[known], of_a[known])
    counts = spark.sparkContext.broadcast((of_a, highest))
    with_replies = units.groupBy("unit").cogroup(replies.select("unit", "bucket", "payload").groupBy("unit"))
    return with_replies.applyInArrow(_measure(identity, counts, n_buckets), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(kit.read_table(spark, sf_dir, "documents"))
