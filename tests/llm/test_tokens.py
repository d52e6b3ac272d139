"""Byte-level BPE, tokenizer alignment and hard negatives against plain versions."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritally.llm import byte_bpe, hard_negatives, kit, tokenizer_alignment, tokens

RNG = random.Random(11)
ODD_SIGNS = [" ", " ", "\n", "\t", "\r", "a", "b", "'", "s", "é", "　", "\u0085", " ", "▁", "\U0001f600", "1", ".", "\0", "՘", "᠎"]
ODD = [
    None, "", " ", "  ", "\n", " \t\n ", "a\n  b", "a  b ", " x", "x" * 3000, "".join(RNG.choices("abcdefg", k=3000)), "漢字" * 200, "é à ü", "a  b", "a  b",
    "it's 'll we're I'M", "\0 a", "<|endoftext|> x <s> </s> <unk> <0x41>", "▁ a", "word ▁x y", "a b c", "a b c", "᠎ a ᠎b", "café crème é x",
    *["".join(RNG.choices(ODD_SIGNS, k=RNG.randint(1, 400))) for _ in range(60)], " ".join("".join(RNG.choices("abcdefghij", k=RNG.randint(1, 14))) for _ in range(3000)),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one without an id, with columns named like results."""
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_links int").repartition(3)


# --- chunks -------------------------------------------------------------------------------------


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_chunks_tile_the_rows_and_start_at_single_spaces():
    texts = [t or "" for t in ODD]
    text, ends = laid(texts)
    stops = tokens.chunk_ends(text, ends)
    assert set(ends.tolist()) <= set(stops.tolist()) and (np.diff(stops) > 0).all()
    for a in set(stops[1:-1].tolist()) - set(ends.tolist()):
        row = kit.rows_of(np.array([a]), ends)[0]
        before, after = text[ends[row] : a].tobytes().decode(), text[a : ends[row + 1]].tobytes().decode()
        assert after[0] == " " and not before[-1].isspace() and not after[1].isspace()
    number, contents = tokens.distinct_chunks(text, stops)
    assert b"".join(contents[i].as_py() for i in number.tolist()) == text.tobytes() and len(set(contents.to_pylist())) == len(contents)


def test_words_between_plain_spaces_are_chunks():
    text, ends = laid(["one two  three été ça\nva bien ", "x y"])
    stops = tokens.chunk_ends(text, ends)
    parts = [text[a:b].tobytes().decode() for a, b in itertools.pairwise(stops.tolist())]
    assert parts == ["one", " two  three", " été", " ça\nva", " bien ", "x", " y"]


# --- byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def as_ids(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


def test_bpe_equals_the_library_and_comes_back(odd, reference):
    found = {r["doc_id"]: (as_ids(r["ids"]), bytes(r["bytes"])) for r in byte_bpe.round_trip(odd).collect()}
    assert found == {i or None: (reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(ODD)}


def test_bpe_encodes_and_decodes_apart(odd):
    coded = byte_bpe.encode(odd)
    assert coded.columns == ["doc_id", "ids"]
    assert {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(coded).collect()} == {i or None: (t or "").encode() for i, t in enumerate(ODD)}


def test_bpe_of_texts_longer_than_a_piece(spark, reference):
    prose = " ".join("".join(RNG.choices("etaoinshr", k=RNG.randint(1, 9))) for _ in range(150000))
    word = "".join(RNG.choices("abcd", k=60000))
    rows = [(1, prose + prose[::-1]), (2, word), (3, "short"), (3, "short")]
    found = sorted((r["doc_id"], as_ids(r["ids"]), len(r["bytes"])) for r in byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted((i, reference.encode_ordinary(t), len(t)) for i, t in rows)


def test_bpe_with_another_vocabulary_and_pattern(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = r"\w+|\W"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = ["Der Zug fährt ab. Où est-il ? 漢字かな", "a  b"]
    found = {r["doc_id"]: as_ids(r["ids"]) for r in byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, pattern).collect()}
    assert found == {i: own.encode_ordinary(t) for i, t in enumerate(texts)}


def plain_contraction(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(3))
def test_contractions_in_any_vocabulary(seed):
    """Vocabularies in which a longer token may come before its parts: leftmost, least rank first."""
    rng = random.Random(seed)
    words = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(40)}
    ranks = {bytes([b]): b for b in range(256)}
    for k, word in enumerate(sorted(words, key=lambda w: rng.random())):
        ranks[word] = 256 + k
    codec = byte_bpe.Codec(ranks, byte_bpe.merge_table(ranks), byte_bpe.default_pattern())
    given = [bytes(rng.choices(b"abc", k=rng.randint(1, 40))) for _ in range(200)]
    expected = [plain_contraction(w, ranks) for w in given]
    assert [as_ids(x) for x in codec._contract(given)] == expected
    assert [as_ids(codec._contract_long(w)) for w in given] == expected


def test_signs_of_every_class_are_split_as_by_the_library(reference):
    """Every code point beside letters, digits, white space, contractions and itself."""
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    codec = byte_bpe.Codec(ranks, byte_bpe.merge_table(ranks), byte_bpe.default_pattern())
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    unlike = sorted(codec.elsewhere) + points[:: len(points) // 4000] + list(range(0x3000))
    texts = [f"a{c}'s{c}{c}1{c} {c}!{c}  {c}\n{c}" for c in map(chr, unlike)]
    text, ends = laid(texts)
    ids, at = codec.encode(text, ends)
    expected = [reference.encode_ordinary(t) for t in texts]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at.tolist())] == expected


def test_ids_outside_the_vocabulary_are_refused(spark):
    bad = spark.createDataFrame([(1, bytearray((99999).to_bytes(4, "little")))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(bad).collect()


def test_bpe_of_no_rows(odd):
    assert byte_bpe.round_trip(odd.limit(0)).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(odd.limit(0))).count() == 0


def test_bpe_query_digests(spark, tmp_path, odd):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for r in byte_bpe.query(spark, str(tmp_path)).where("doc_id = 2 OR doc_id = 6").collect():
        assert r["decoded_sha256"] == hashlib.sha256(ODD[r["doc_id"]].encode()).hexdigest()
    empty = byte_bpe.query(spark, str(tmp_path)).where("n_tokens = 0").collect()
    assert len(empty) == 2 and {(r["ids_sha256"], r["decoded_sha256"]) for r in empty} == {(hashlib.sha256(b"").hexdigest(),) * 2}


# --- alignment ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    a_bytes = {i: word for word, i in ranks.items()} | {50256: b"<|endoftext|>"}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, a_bytes, b_bytes


def plain_alignment(rows, both):
    """Rows of `align`, and the pair counts, by whole texts and sets of offsets."""
    a_kind, b_kind, a_bytes, b_bytes = both
    documents = []
    for i, t in rows:
        whole = (" " + (t or "")).encode()
        a = a_kind.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_kind.encode(t) if t else []
        if not t or b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
            documents.append((i, 0, 0, [], ""))
            continue
        a_end, b_end = (list(itertools.accumulate(len(words[x]) for x in ids)) for words, ids in ((a_bytes, a), (b_bytes, b)))
        groups, links, i_a, i_b = [], [], 0, 0
        for end in sorted(set(a_end) & set(b_end)):
            j_a, j_b = a_end.index(end, i_a) + 1, b_end.index(end, i_b) + 1
            groups.append(",".join(map(str, a[i_a:j_a])) + "|" + ",".join(map(str, b[i_b:j_b])))
            links.append((a[j_a - 1], b[j_b - 1]))
            i_a, i_b = j_a, j_b
        documents.append((i, len(a), len(b), links, ";".join(groups)))
    count = Counter(link for d in documents for link in d[3])
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(highest.get(y, 0), n)
    result = [
        (i, n_a, n_b, len(links), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if links else "")
        for i, n_a, n_b, links, text in documents
    ]
    return sorted(result, key=str), dict(count), {i: text for i, *_, text in documents}


def test_alignment_equals_the_plain_version(odd, both):
    expected, counts, texts = plain_alignment([(i or None, t) for i, t in enumerate(ODD)], both)
    result = tokenizer_alignment.align(odd)
    assert result.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in result.collect()), key=str) == expected
    assert {(r["a"], r["b"]): r["n"] for r in tokenizer_alignment.pair_counts(odd).collect()} == counts
    assert {r["doc_id"]: r["groups"] for r in tokenizer_alignment.groups(odd).collect()} == texts


def test_alignment_over_several_units(spark, both, monkeypatch):
    """Long texts fill units of their own; pairs are counted over all of them."""
    words = ["".join(RNG.choices("abcdefgh", k=RNG.randint(1, 7))) for _ in range(400)]
    rows = [(i, " ".join(RNG.choices(words, k=700000 if i < 2 else 3000))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    assert sorted((tuple(r) for r in tokenizer_alignment.align(df).collect()), key=str) == plain_alignment(rows, both)[0]


def test_identity_pairs_never_enter_the_exchange(spark):
    kit.prepare(spark)
    shared, identity, _ = tokenizer_alignment._share(spark, None, None)
    plain = spark.createDataFrame([(1, "the house of the people")], "doc_id long, text string")
    units = tokenizer_alignment._units(plain, shared)
    assert units.mapInArrow(tokenizer_alignment._send(identity, 8), kit.PACKED_SCHEMA).count() == 0
    assert units.mapInArrow(tokenizer_alignment._identity_counts(identity), "a long, n long").agg(F.sum("n")).first()[0] == 5


def test_identity_map_prefers_pieces_to_bytes():
    a_path, b_path = tokenizer_alignment.default_paths()
    kinds = tokenizer_alignment.Tokenizers(open(a_path, "rb").read(), open(b_path, "rb").read())
    known = np.flatnonzero(kinds.identity >= 0)
    for a in known[:: len(known) // 200].tolist():
        (data, ends), b = kinds.a_bytes, int(kinds.identity[a])
        (b_data, b_ends) = kinds.b_bytes
        assert data[ends[a] : ends[a + 1]].tobytes() == b_data[b_ends[b] : b_ends[b + 1]].tobytes()
    assert not any(kinds.b.is_byte(int(b)) for a, b in enumerate(kinds.identity) if b >= 0 and kinds.b_bytes[0][kinds.b_bytes[1][b]] < 0x80 and kinds.b.id_to_piece(int(b)).isalpha())


def test_alignment_of_no_rows(odd):
    assert tokenizer_alignment.align(odd.limit(0)).count() == 0
    assert tokenizer_alignment.pair_counts(odd.where("text IS NULL")).count() == 0


# --- hard negatives -------------------------------------------------------------------------------


def plain_negatives(rows, every, positives=5, negatives=5):
    usable = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: r[1]):
        usable.setdefault(i, (label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for anchor, (label, q) in usable.items():
        if anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, w)), i, lab) for i, (lab, w) in usable.items() if i != anchor))
        for score, i, _ in [s for s in scored if s[2] == label][:positives]:
            p = -score
            window = [(-s, j) for s, j, lab in scored if lab != label and 80 * p <= -100 * s <= 100 * p]
            out += [(anchor, i, k + 1, j, p, s) for k, (s, j) in enumerate(window[:negatives])]
    return sorted(out)


def random_rows(seed, n, dims, spread, ids=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append(((ids or range(n))[i], rng.randrange(3), [float(np.float32(c + rng.gauss(0, spread))) for c in centre]))
    return rows


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, **options).collect())


@pytest.mark.parametrize("seed, dims, spread", [(1, 8, 0.3), (2, 3, 0.05), (3, 16, 2.0)])
def test_negatives_equal_the_plain_version(spark, seed, dims, spread):
    rows = random_rows(seed, 700, dims, spread)
    assert mined(spark, rows, every=10) == plain_negatives(rows, 10)


def test_negatives_over_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    rows = random_rows(4, 600, 6, 0.4)
    assert mined(spark, rows, every=7, positives=3, negatives=2) == plain_negatives(rows, 7, 3, 2)


def test_ties_go_by_id_and_repeated_vectors_count(spark):
    rows = [(i, i % 3, [1.0, float(i % 2)]) for i in range(0, 300)]
    assert mined(spark, rows, every=50) == plain_negatives(rows, 50)


def test_odd_rows_take_no_part(spark):
    rows = random_rows(5, 200, 4, 0.5)
    odd = [(None, 1, [1.0] * 4), (1000, None, [1.0] * 4), (1001, 1, None), (1002, 1, [float("nan")] * 4), (1003, 1, [float("inf")] * 4), (1004, 1, [None, 1.0, 1.0, 1.0])]
    assert mined(spark, rows + odd, every=20) == plain_negatives(rows, 20) == plain_negatives(rows + odd, 20)
    assert mined(spark, rows + rows, every=20) == plain_negatives(rows, 20)  # repeated rows are one
    assert mined(spark, rows + [(2000, 1, []), (2020, 2, [3.0])], every=20) == plain_negatives(rows + [(2000, 1, [0.0] * 4), (2020, 2, [3.0, 0.0, 0.0, 0.0])], 20)
    assert mined(spark, [], every=20) == [] and mined(spark, [(1, 1, [1.0])], every=20) == []


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e6])
def test_large_components_are_summed_exactly(spark, scale):
    rows = [(i, label, [x * scale for x in v]) for i, label, v in random_rows(6, 120, 5, 0.5)]
    rows = [(i, label, [float(np.float32(min(max(x, -8e6), 8e6))) for x in v]) for i, label, v in rows]
    assert mined(spark, rows, every=20) == plain_negatives(rows, 20)


def test_reading_stops_below_the_threshold():
    """A clear winner is found without reading the lists to the end, and without a wrong answer."""
    rng = np.random.default_rng(1)
    matrix = np.floor(256 * rng.normal(size=(4000, 4)) * 0.1).astype(np.float64)
    matrix[17:22] = 256 * 2
    lists = hard_negatives.Lists(matrix)
    read = 0
    for rows, _, limit in lists.search(np.array([256.0, 256.0, 256.0, 256.0])):
        read += len(rows)
        if limit is not None and limit < 4 * 256 * 512:
            break
    assert read < 1000
    ids, _ = hard_negatives.best_of(lists, np.arange(4000), np.array([256.0] * 4), -1, 5)
    assert ids.tolist() == [17, 18, 19, 20, 21]


def test_a_threshold_equal_to_the_last_score_reads_on():
    """An unread row of the same score may have a smaller id."""
    matrix = np.ones((600, 2))
    ids = np.arange(600)[::-1].copy()
    found, _ = hard_negatives.best_of(hard_negatives.Lists(matrix), ids, np.array([1.0, 1.0]), -1, 5)
    assert found.tolist() == [0, 1, 2, 3, 4]


def test_relabelling_moves_every_seventh_label(spark):
    df = spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (14, None, [1.0]), (-7, 3, [1.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r["vec_id"], r["label"]) for r in hard_negatives.relabelled(df).collect()) == [(-7, 4), (7, 0), (8, 9), (14, None)]
