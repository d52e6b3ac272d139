"""Byte-level BPE, encoding and decoding by queries of an in-process DuckDB in every task.

The vocabulary is a file of ranks (base64 of the bytes, rank), read once by the driver. Its merge
table has a row for every token and every way to cut its bytes into two tokens; it is as large as
the vocabulary makes it and is broadcast.

Encoding: the split pattern cuts a text into words, with letters, digits and white space as the
library's engine knows them (`other_classes`). A word that is a token is that token. All other
different words of some megabytes of text become rows (word, position, token), one per byte, the
positions counted through all of them. A recursive query joins each position and its right neighbour with the merge table and contracts
every word's leftmost pair of the least rank, until no word has a pair left. Words that change no
more drop out of the recursion; the last step of each, in order of position, is its encoding.

Decoding: rows (document, position, token) join the vocabulary, and an ordered aggregation puts
the bytes together.

A recursion over a word of n bytes makes up to n^2 / 2 rows. Words are given to it in lots of at
most `LOT` such rows. A word of more than `LONG` bytes would take millions of steps (a text may be
one word), so it is contracted by a queue of its pairs, ordered by rank and position, which makes
the same contractions in the same order. Nothing is cut off or left out either way.

Spark deals out the documents and no row needs another, so there is no exchange. A task holds a
few megabytes of text, the words it has seen (at most `SEEN`, then it starts afresh) and one lot.

Defined results: a NULL or empty text has no tokens, decodes to no bytes and both digests are those
of the empty string; rows with a NULL doc_id and repeated rows give one row each; special tokens
are ordinary text; texts of any length are encoded whole; other columns are ignored; an empty table
gives an empty result. Ids to decode that are not in the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm import kit, tokens

LONG = 256  # bytes of a word
LOT = 5_000_000  # rows of one recursion
SEEN = 300_000  # words and chunks a task remembers
PIECE = 4 << 20  # text handled at once
VOCABULARY = "byte_bpe_50k.tiktoken"

CONTRACT = """
WITH RECURSIVE state(step, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM given
  UNION ALL
  (WITH near AS (
     SELECT step, word, pos, tok, lead(word) OVER w AS next_word, lead(tok) OVER w AS following, lag(pos) OVER w AS before
     FROM state WINDOW w AS (ORDER BY pos)),
   least AS (
     SELECT word, min(merged::BIGINT << 32 | pos) AS pair
     FROM near JOIN merges ON pair_key = tok::BIGINT << 32 | following WHERE word = next_word GROUP BY word)
   SELECT step + 1, word, pos, CASE WHEN pos = pair & 4294967295 THEN (pair >> 32)::INT ELSE tok END
   FROM near JOIN least USING (word) WHERE before IS DISTINCT FROM pair & 4294967295))
SELECT word, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
GROUP BY word ORDER BY word"""

JOIN_UP = """
SELECT doc, string_agg(letters, '' ORDER BY pos) AS letters, count(*) AS n
FROM given JOIN vocabulary USING (tok) GROUP BY doc ORDER BY doc"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, filter(bytes.strip, file))}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, merged) for each way to cut a token into two tokens."""
    rows = [
        (left, right, rank)
        for word, rank in ranks.items()
        for i in range(1, len(word))
        if (left := ranks.get(word[:i])) is not None and (right := ranks.get(word[i:])) is not None
    ]
    return np.array(rows, np.int64).reshape(-1, 3)


#: Classes of the split pattern, each with a sign that is in it in every version of Unicode and in no
#: contraction; a sign of no class stands for all others.
CLASSES = ((r"\p{L}", "\u00e9"), (r"\p{N}", "5"), (r"\s", "\u00a0"))
OTHER = "\u00a7"


def other_classes() -> dict[int, str]:
    """Signs that the library's pattern engine has in another class than `regex` has: their versions of
    Unicode differ. Each with a sign of the class it has there."""
    import regex
    import tiktoken

    signs = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    here, there = {}, {}
    for pattern, sign in CLASSES:
        # Text that the pattern does not match has no tokens.
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        there |= dict.fromkeys(bytes(engine.encode_ordinary(signs)).decode(), sign)
        here |= dict.fromkeys(regex.findall(pattern, signs), sign)
    return {ord(c): there.get(c, OTHER) for c in here.keys() | there.keys() if here.get(c) != there.get(c)}


class Codec:
    """One vocabulary in one worker."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str):
        import duckdb
        import regex

        self.ranks, self.merges, self.split = ranks, merges, regex.compile(pattern)
        self.elsewhere = other_classes()
        self.lowest = chr(min(self.elsewhere, default=0x10FFFF))
        self.cut = pattern == default_pattern()
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        # No spill: a lot is small, and a task's own folder is no place on a cluster.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._load("merges", pair_key=merges[:, 0] << 32 | merges[:, 1], merged=merges[:, 2].astype(np.int32))
        tok = pa.array(list(ranks.values()), pa.int32())
        self._load("vocabulary", tok=tok, letters=pa.array([word.decode("latin-1") for word in ranks], pa.string()))
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.pairs: dict[int, int] | None = None

    def _load(self, name: str, **columns) -> None:
        self.db.register("columns", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM columns")
        self.db.unregister("columns")

    def _ask(self, sql: str, **columns) -> pa.Table:
        self.db.register("given", pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("given")

    # --- encoding ---

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as little-endian 32-bit integers."""
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        out = self._ask(CONTRACT, word=word, pos=np.arange(len(data), dtype=np.int32), tok=self.of_byte[data])
        lists = out["ids"].combine_chunks()
        ends = lists.offsets.to_numpy()
        raw = lists.values.to_numpy()[ends[0] : ends[-1]].astype("<u4").tobytes()
        ends = ((ends - ends[0]) * 4).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _contract_long(self, word: bytes) -> bytes:
        if self.pairs is None:
            self.pairs = dict(zip((self.merges[:, 0] << 32 | self.merges[:, 1]).tolist(), self.merges[:, 2].tolist()))
        n, merged = len(word), self.pairs.get
        tok = array("q", self.of_byte[np.frombuffer(word, np.uint8)].tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        queue = [m << 32 | i for i in range(n - 1) if (m := merged(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i, new = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if tok[i] < 0 or j >= n or merged(tok[i] << 32 | tok[j]) != new:
                continue  # one of the two has changed since
            tok[i], tok[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := merged(new << 32 | tok[k])) is not None:
                    heapq.heappush(queue, m << 32 | i)
            if (h := before[i]) >= 0 and (m := merged(tok[h] << 32 | new)) is not None:
                heapq.heappush(queue, m << 32 | h)
        ids = np.frombuffer(tok, np.int64)
        return ids[ids >= 0].astype("<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        if text.isascii() or max(text) < self.lowest:
            return self.split.findall(text)
        seen = text.translate(self.elsewhere)  # as long as the text
        return [text[a:b] for a, b in (m.span() for m in self.split.finditer(seen))]

    def _learn(self, found: list[list[str]]) -> None:
        """Encode the words not seen so far."""
        if len(self.words) > SEEN:
            self.words.clear()
        fresh, open_words = {word for row in found for word in row if word not in self.words}, []
        for word in fresh:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.words[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.words[word] = self._contract_long(raw)
            else:
                open_words.append((len(raw), raw, word))
        open_words.sort()
        rows = np.cumsum([n * n // 2 + 1 for n, _, _ in open_words])
        lot = (rows - 1) // LOT if len(rows) else rows
        for k in np.unique(lot):
            i, j = np.searchsorted(lot, [k, k + 1])
            part = open_words[i:j]
            self.words.update(zip([x[2] for x in part], self._contract([x[1] for x in part])))

    def encode(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and where each row's end, led by 0."""
        stops = tokens.chunk_ends(text, ends, self.cut)
        number, contents = tokens.distinct_chunks(text, stops)
        contents = contents.to_pylist()
        if len(self.chunks) > SEEN:
            self.chunks.clear()
        fresh = [c for c in contents if c not in self.chunks]
        found = [self._words(c.decode()) for c in fresh]
        self._learn(found)
        known = self.words
        self.chunks.update((c, b"".join([known[w] for w in row])) for c, row in zip(fresh, found))
        coded = [self.chunks[c] for c in contents]
        size = np.array([len(x) // 4 for x in coded], np.int64)
        ids, chunk_end = tokens.pick(np.frombuffer(b"".join(coded), "<u4"), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), number)
        return ids, chunk_end[np.searchsorted(stops, ends)] if len(number) else np.zeros(len(ends), np.int64)

    # --- decoding ---

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and where each row's end, led by 0."""
        doc = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        out = self._ask(JOIN_UP, doc=doc, pos=np.arange(len(ids), dtype=np.int64), tok=ids.astype(np.int64))
        if int(np.sum(out["n"].to_numpy())) != len(ids):
            raise ValueError("ids that are not in the vocabulary")
        parts = [x.encode("latin-1") for x in out["letters"].to_pylist()]
        size = np.zeros(len(ends) - 1, np.int64)
        size[out["doc"].to_numpy()] = [len(x) for x in parts]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


_codecs: dict[tuple, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec; a worker serves many tasks and keeps the last vocabulary."""
    key, pattern, ranks, merges = shared.value
    if (key, pattern) not in _codecs:
        _codecs.clear()
        _codecs[key, pattern] = Codec(ranks, merges, pattern)
    return _codecs[key, pattern]


def _share(spark: SparkSession, path: str | None, pattern: str | None):
    kit.prepare(spark)
    ranks = read_ranks(path or default_path())
    merges = merge_table(ranks)
    key = hashlib.sha256(merges.tobytes()).hexdigest()
    return spark.sparkContext.broadcast((key, pattern or default_pattern(), ranks, merges))


def _encoded(shared, with_bytes: bool):
    def run(batches):
        codec = _codec(shared)
        for batch, i, j, text, ends in kit.text_pieces(batches, PIECE):
            ids, id_ends = codec.encode(text, ends)
            columns = {"doc_id": batch.column(0).slice(i, j - i), "ids": tokens.binary(ids.astype("<u4"), id_ends * 4)}
            if with_bytes:
                columns["bytes"] = tokens.binary(*codec.decode(ids, id_ends))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _decoded(shared):
    def run(batches):
        codec = _codec(shared)
        for batch, i, j, raw, ends in kit.text_pieces(batches, PIECE):
            data = tokens.binary(*codec.decode(np.frombuffer(raw.tobytes(), "<u4"), ends // 4))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), data], names=["doc_id", "bytes"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers in one binary) of every row."""
    shared = _share(docs.sparkSession, path, pattern)
    return kit.id_and_text(docs).mapInArrow(_encoded(shared, False), "doc_id long, ids binary")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes of every row of doc_id and ids, as `encode` makes them."""
    shared = _share(coded.sparkSession, path, None)
    return coded.select("doc_id", F.col("ids")).mapInArrow(_decoded(shared), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes decoded from them, in one pass."""
    shared = _share(docs.sparkSession, path, pattern)
    return kit.id_and_text(docs).mapInArrow(_encoded(shared, True), "doc_id long, ids binary, bytes binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(kit.read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )
