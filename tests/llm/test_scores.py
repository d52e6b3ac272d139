"""Ledger, licences, language, toxicity, language models and the mix against plain versions."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.llm import language_id, license_digests, lm_scoring, quality_ledger, recurrent, source_mix, toxicity
from veritally.llm.license_texts import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_ledger_equals_the_plain_version(docs, corpus):
    rows = quality_ledger.apply_policy(quality_ledger.ledger(docs)).collect()
    assert {r["doc_id"]: tuple(r[m] for m in quality_ledger.MEASURES[:5]) for r in rows} == {i: plain_measures(t) for i, t in corpus}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablations(odd_docs):
    ledger = quality_ledger.ledger(odd_docs)
    assert ledger.count() == odd_docs.count() and quality_ledger.ledger(odd_docs.limit(0)).count() == 0
    bits = [r["fail_bits"] for r in ledger.collect()]
    for policy, rules in quality_ledger.POLICIES.items():
        mask = quality_ledger.mask_of(rules)
        assert quality_ledger.apply_policy(ledger, policy).where("kept").count() == sum(not b & mask for b in bits)
        found = {r["rule"]: (r["n_failed"], r["n_only"], r["n_rejected"], r["n_docs"]) for r in quality_ledger.ablations(ledger, policy).collect()}
        for rule in rules:
            one = quality_ledger.mask_of((rule,))
            assert found[rule] == (sum(bool(b & one) for b in bits), sum(b & mask == one for b in bits), sum(bool(b & mask) for b in bits), len(bits))
    kept = quality_ledger.passing(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == quality_ledger.apply_policy(ledger).where("kept").count()


def test_licences(spark):
    mit = next(t for i, t in TEXTS if i == "MIT")
    other = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("MIT LICENSE", "mit licence").replace(", ", " -- ").replace("\n", "\n\n")
    rows = [(1, mit), (2, other), (3, "some text\n" + "Licensed under the Apache Licence,  version 2.0\nmore"), (4, None), (5, ""), (6, "!!!\n(c) me"), (7, "plain"), (1, mit), (None, mit)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    result = license_digests.scan(df, license_digests.known_licenses(spark)).collect()
    assert sorted(((r["doc_id"], r["license_id"], r["n_notices"], r["notices"]) for r in result), key=str) == sorted(
        [(1, "MIT", 0, None), (1, "MIT", 0, None), (2, "MIT", 0, None), (3, None, 1, "Apache-2.0"), (4, None, 0, None), (5, None, 0, None),
         (6, None, 0, None), (7, None, 0, None), (None, "MIT", 0, None)], key=str)
    digests = {r["doc_id"]: r["digest"] for r in result}
    assert digests[1] == digests[2] and digests[4] is digests[5] is digests[6] is None
    assert license_digests.scan(df.limit(0), license_digests.known_licenses(spark)).count() == 0
    assert {r["license_id"] for r in license_digests.known_licenses(spark).collect()} == {i for i, _ in TEXTS}


def test_language(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schen", "wurt", "gelb"], "cc": ["été", "ça", "où"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    train = [(i, make(lang, 30), lang) for i, lang in enumerate(list(parts) * 30)] + [(990, None, "aa"), (991, make("aa", 9), None), (992, "", "zz")]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == list(parts)
    test = [(i, make(lang, 25).upper() + " kalolomimi", lang) for i, lang in enumerate(list(parts) * 20)]
    odd = [(900, None), (901, ""), (902, "12 !? —"), (903, "ka"), (903, "ka"), (None, "ka lo"), (904, "qqq www"), (905, "ka" * 3000)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in test] + [(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    result = language_id.predict(df, model).collect()
    assert len(result) == df.count() and all(0 <= r["score"] <= 1 for r in result)
    found = {r["doc_id"]: r["lang_pred"] for r in result}
    assert sum(found[i] == lang for i, _, lang in test) >= 59
    assert found[900] == found[901] == found[902] == "und" and found[903] == "aa"
    empty = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(df, empty).collect()} == {"und"}


def test_a_rare_language_is_learned_from_a_large_table(spark):
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=4)) for _ in range(30))
    rows = [(i, make("abcdef"), "hot") for i in range(4000)] + [(5000 + i, make("uvwxyz"), "rare") for i in range(4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert model.langs == ["hot", "rare"]
    test = spark.createDataFrame([(1, make("abcdef")), (2, make("uvwxyz"))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(test, model).collect()} == {1: "hot", 2: "rare"}


def test_a_hot_language_leaves_room_for_the_words_of_others(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_ENTRIES", 8)
    hot, rare = [" ".join(f"{letter}{x}" for x in "abcdefgh" for letter in letters) for letters in ("pq", "u")]
    rows = [(i, hot, "hot") for i in range(60)] + [(100 + i, rare, "rare") for i in range(3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    points, s, e, _ = language_id.letters_of(np.frombuffer(rare.encode(), np.uint8), np.array([0, len(rare)]))
    assert (model.find(0, language_id.word_keys(points, s, e)) >= 0).any()


def test_backoff_takes_the_longest_known_length():
    key = lambda text: language_id._fold(np.array([ord(c) for c in text], np.uint32), np.array([0]), len(text))[0]
    none = (np.zeros(0, np.uint64), np.zeros((0, 2)))
    tables = {n: none for n in (0, *language_id.LENGTHS)}
    tables[3] = (np.array([key("abc")]), np.array([[-1.0, -9.0]]))
    tables[1] = (np.array([key("a")]), np.array([[-9.0, -1.0]]))
    model = language_id.Model(["x", "y"], tables)
    score = lambda text: model.predict(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0][0]
    assert score("zabcz") == "x" and score("zaz") == "y"


def test_gradients():
    rng = np.random.default_rng(0)
    net = recurrent.Classifier(6, 20)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()} | {"out": rng.standard_normal(16)}
    words, chars = np.array([0, 1, 2, 3, 5]), rng.integers(1, 20, (5, 7))
    chars[2, 4:] = chars[4, 2:] = 0
    windows = rng.integers(0, 5, (4, 6))
    windows[1, 4:] = windows[3, 1:] = -1
    args = words, chars, windows, np.array([1, 0, 1, 0.0]), np.ones(4)
    _, grads = net.gradients(*args)
    for name, value in net.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "words" and at[0] == 0:
                continue  # the unknown word has no vector of its own
            was, losses = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = was + step
                losses.append(net.gradients(*args)[0])
            value[at] = was
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.02, abs=2e-4)


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(60)]
    make = lambda n, bad: " ".join(rng.choices(words, k=n) + ["zork"] * bad + rng.choices(words, k=n))
    texts = [make(rng.randint(5, 80), i % 2 * 3) for i in range(120)]
    model = toxicity.train(texts, np.arange(120) % 2, rounds=1, steps=60)
    test = [(i, make(60, i % 2 * 3)) for i in range(40)] + [(100, None), (101, ""), (102, "123 !"), (None, make(5, 0)), (103, "x" * 5000), (104, make(4000, 1))]
    df = spark.createDataFrame([(i, t, "x") for i, t in test], "doc_id long, text string, score string")
    result = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert len(result) == len(test) and all(0 <= s <= 1 for s in result.values())
    assert sum((result[i] >= toxicity.THRESHOLD) == (i % 2 == 1) for i in range(40)) >= 38
    assert result[100] == result[101] == result[102] == 0
    assert toxicity.train(["a", "b"], np.array([0, 0])) is None and toxicity.train([], np.array([])) is None
    assert {r["score"] for r in toxicity.score(df, None).collect()} == {0.0}


def test_toxicity_learns_from_long_texts_and_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append((texts, labels.tolist())))
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def sample(rows):
        toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
        texts, found = seen.pop()
        assert all(len(t.encode()) <= 400 for t in texts)
        return sorted(found), texts

    assert sample([(i, f"\U00020000é{i} " * 200) for i in range(40)])[0] == [0] * 5 + [1] * 5
    found, texts = sample([(i, f"word{i} " * (200 if i < 30 else 3)) for i in range(40)])
    assert found == [0] * 5 + [1] * 5 and all(len(t.split()) == 3 for t in texts)
    assert sample([(i % 2, f"text {i}") for i in range(40)])[0] == [0] * 5 + [1] * 5


def test_windows_cover_every_token():
    text = " ".join("abcdefghij"[i % 10] * (1 + i % 20) for i in range(77)).encode()
    tokens = toxicity.Tokens(np.frombuffer(text, np.uint8), np.array([0, 0, len(text)]))
    windows, row = tokens.windows(2)
    assert set(row.tolist()) == {1} and (windows >= 0).all()
    assert set(windows.reshape(-1).tolist()) == set(tokens.word.tolist())


def test_language_model_losses_equal_the_plain_version(spark, docs, odd_docs, corpus):
    target = {1, 3, 4, 30}
    ids = spark.createDataFrame([(i,) for i in (*target, 3, None, 999)], "doc_id long")
    sides = {"target": (Counter(), Counter(), Counter()), "background": (Counter(), Counter(), Counter())}
    tokens = {}
    for i, text in corpus:
        words = WORD.findall((text or "").translate(LOWER))
        if words:
            tokens[i] = list(zip(["<s>", *words], [*words, "</s>"]))
            for side in ("target", "background") if i in target else ("background",):
                for h, w in tokens[i]:
                    for counts, k in zip(sides[side], (w, h, (h, w))):
                        counts[k] += 1
    n, v = {s: sum(c[0].values()) for s, c in sides.items()}, len(sides["background"][0])
    mu = lm_scoring.MU

    def loss(side, i):
        r = n["target"] / n[side]
        word, history, pair = sides[side]
        p = [(r * pair[h, w] + mu * (r * word[w] + 1) / (n["target"] + v)) / (r * history[h] + mu) for h, w in tokens[i]]
        return -sum(map(math.log, p)) / len(p)

    result = lm_scoring.score(docs, ids).collect()
    assert len(result) == len(corpus)
    for r in result:
        i = r["doc_id"]
        assert r["n_tokens"] == len(tokens.get(i, ()))
        if i in tokens:
            assert r["target_loss"] == pytest.approx(loss("target", i)) and r["background_loss"] == pytest.approx(loss("background", i))
        else:
            assert r["target_loss"] is None and r["background_loss"] is None
    assert lm_scoring.score(odd_docs, ids).count() == odd_docs.count()
    assert lm_scoring.score(docs.limit(0), ids).count() == 0
    without = lm_scoring.score(docs, ids.limit(0)).where("n_tokens > 0").collect()
    assert all(r["target_loss"] == pytest.approx(r["background_loss"]) for r in without)


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(3)
    targets = [(f"s{k:02}", k, float(rng.randint(1, 4000))) for k in range(12)] + [("t", 12, 0.0)]
    df = spark.createDataFrame(targets, "skey string, place long, target double").withColumn("source_size", F.lit(1).cast("long"))
    per_shard = 100
    found = {(r["skey"], r["shard"]): r["quota"] for r in source_mix.quotas(df, per_shard).collect()}
    blocks = round(sum(t for _, _, t in targets) / source_mix.BLOCK)
    shards = -(-blocks // per_shard)
    ends = [(s + 1) * blocks // shards for s in range(shards)]
    seats, expected = Counter(), Counter()
    for b in range(blocks):
        best = max((t for t in targets if t[2] > 0), key=lambda t: (t[2] / (2 * seats[t[0]] + 1), -t[1]))[0]
        seats[best] += 1
        expected[best, next(s for s, end in enumerate(ends) if b < end)] += 1
    assert {k: q for k, q in found.items() if q} == dict(expected)
    assert {r["shard"] for r in source_mix.quotas(df, per_shard, 3).collect()} == {0, 1, 2}


def test_targets_fill_up_by_weight(spark):
    sizes = {"s1": 1000, "s2": 10, "s3": 500, "s4": 3, "t": 400}
    df = spark.createDataFrame(list(sizes.items()), "skey string, size long")
    result = {r["skey"]: r["target"] for r in source_mix.targets(df).collect()}
    weights = dict(zip(sorted(sizes), (5, 2, 1, 5, 2)))
    total, open_, plain = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        share = {s: total * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            plain |= share
            break
        plain |= {s: 2.0 * sizes[s] for s in full}
        total -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert result == pytest.approx(plain)


def test_mix(odd_docs):
    first, again = (sorted((tuple(r) for r in source_mix.mix(odd_docs).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == odd_docs.count()
    by_source = {}
    for _, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size
        by_source.setdefault((source_size, target), []).append(taken)
    for (source_size, target), taken in by_source.items():
        assert sum(taken) <= 2 * source_size and abs(sum(taken) - target) <= 4 * source_mix.BLOCK
    assert source_mix.mix(odd_docs.limit(0)).count() == 0
    assert source_mix.mix(odd_docs.withColumn("text", F.lit(None).cast("string"))).where("taken > 0").count() == 0


def many_sources(spark):
    """Documents of all sizes, one longer than a shard's stretch, in sources of unlike weight."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300, 900]), f"s{i % 6}" if i % 6 else None) for i in range(300)]
    rows += [(1000, "long " * 30000, "s1"), (1001, "long " * 30000, "s1"), (1002, "x", "s9"), (1003, None, "s8")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("shard_blocks, shards", [(64, 1024), (64, 7), (1 << 12, 1024), (1 << 20, 1)])
def test_targets_hold_for_any_number_of_shards(spark, shard_blocks, shards):
    by_source = {}
    for r in source_mix.mix(many_sources(spark), "seed", shard_blocks, shards).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 4 * source_mix.BLOCK


def test_shards_choose_their_words(spark):
    """Each shard takes its quota from its own stretch of each source: other shards, other words."""
    docs = many_sources(spark)
    taken = {n: {r["doc_id"]: r["taken"] for r in source_mix.mix(docs, "seed", 64, n).collect()} for n in (1, 5, 50)}
    assert taken[1] != taken[5] != taken[50] != taken[1]
    by_source = source_mix.targets(source_mix.sized(docs, "seed").groupBy("skey").agg(F.sum("size").alias("size")))
    shares = source_mix.quotas(by_source, 64, 50)
    rows = source_mix.selection(by_source, shares, "seed").collect()
    quota = {(r["skey"], r["shard"]): r["quota"] for r in shares.collect()}
    size = {r["skey"]: r["source_size"] for r in by_source.collect()}
    for r in rows:
        around = -(-size[r["skey"]] // source_mix.BLOCK)
        length = (r["shard"] + 1) * around // 50 - r["shard"] * around // 50
        blocks = r["rounds"] * length + (r["high"] - r["low"] + r["wrap"]) // source_mix.BLOCK
        assert blocks <= 2 * length and abs(blocks - quota[r["skey"], r["shard"]]) <= 2
    short = sum(quota.values()) - sum(r["rounds"] * ((r["shard"] + 1) * -(-size[r["skey"]] // 16) // 50 - r["shard"] * -(-size[r["skey"]] // 16) // 50) + (r["high"] - r["low"] + r["wrap"]) // 16 for r in rows)
    assert 0 <= short <= 3 * len(size)


def test_mix_with_columns_named_like_its_own(spark):
    docs = many_sources(spark)
    named = docs.selectExpr("*", "1 AS size", "'x' AS target", "2 AS taken", "'k' AS skey", "'c' AS cell", "3 AS shard", "4 AS start")
    first, again = (sorted(map(str, source_mix.mix(d).collect())) for d in (docs, named))
    assert first == again


SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="test tables are not there")
def test_toxicity_on_held_out_labels(spark):
    """Labels are noisy and few at this size; these are the figures that must hold at least."""
    scored = toxicity.query(spark, str(SF)).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    found = {(r["toxic"], r["predicted"]): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    toxic = found.get((1, 1), 0) + found.get((1, 0), 0)
    clean = found.get((0, 1), 0) + found.get((0, 0), 0)
    assert found.get((1, 1), 0) >= 0.5 * toxic and found.get((0, 1), 0) <= 0.05 * clean


def letters(text):
    """Words of letters in lower case, as the module has them."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words.append(word)
            word = ""
    return words


def parts(word, n):
    whole = "\1" + word + "\1"
    return [g for g in (whole[i : i + n] for i in range(len(whole) - n + 1)) if n > 1 or g != "\1"]


def plain_languages(rows):
    """(doc_id, language, score) by dictionaries of words and n-grams."""
    langs = sorted({lang for _, t, lang in rows if lang and letters(t)})
    counts = {n: {lang: Counter() for lang in langs} for n in (0, *language_id.LENGTHS)}
    for _, t, lang in rows:
        if lang in langs:
            for word in letters(t):
                counts[0][lang][word] += 1
                for n in language_id.LENGTHS:
                    counts[n][lang].update(parts(word, n))
    tables = {}
    for n, by_lang in counts.items():
        total = sum(by_lang.values(), Counter())
        kept = [g for g, c in total.items() if c >= language_id.MIN_COUNT]
        below = {lang: sum(by_lang[lang].values()) + 0.5 * (len(kept) + 1) for lang in langs}
        tables[n] = {g: [math.log((by_lang[lang][g] + 0.5) / below[lang]) for lang in langs] for g in kept}
    for i, t, _ in rows:
        sums = [0.0] * len(langs)
        for word in letters(t):
            found = [tables[0][word]] if word in tables[0] else []
            for n in language_id.LENGTHS:
                found = found or [tables[n][g] for g in parts(word, n) if g in tables[n]]
            sums = [s + sum(f[c] for f in found) / max(len(found), 1) for c, s in enumerate(sums)]
        if not letters(t):
            yield i, language_id.UNKNOWN, 0.0
        else:
            yield i, langs[sums.index(max(sums))], 1 / sum(math.exp(s - max(sums)) for s in sums)


def test_languages_equal_a_plain_scorer(spark):
    rng = random.Random(9)
    sets = {lang: ["".join(rng.choices(signs, k=rng.randint(1, 8))) for _ in range(60)] for lang, signs in (("a", "abcdé"), ("b", "cdefß"), ("c", "漢字かなc"))}
    rows = []
    for i in range(90):
        lang = rng.choice("abc")
        rows.append((i, " ".join(rng.choices(sets[lang], k=rng.randint(0, 30)) + rng.choices(sets[rng.choice("abc")], k=2)) + "!9", rng.choice([lang, lang, None])))
    rows += [(200, None, "a"), (201, "", "b"), (202, "12 34", "c"), (203, "Zzzqx ÉÉ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    for i, lang, score in plain_languages(rows):
        assert found[i][1] == pytest.approx(score, abs=1e-9) and (found[i][0] == lang or abs(score - 0.5) < 1e-9)


def test_scores_are_those_of_the_model_applied_plainly(spark, docs, corpus):
    """`score` and `predict` over partitions equal the fitted model on one text at a time."""
    labels = spark.createDataFrame([(i, i % 2) for i, _ in corpus], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    languages = language_id.fit(docs)
    predicted = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, languages).collect()}
    for i, t in corpus:
        text = np.frombuffer((t or "").encode(), np.uint8)
        ends = np.array([0, len(text)], np.int64)
        assert found[i] == pytest.approx(float(model.score(text, ends)[0]), abs=1e-5)
        lang, score = languages.predict(text, ends)
        assert predicted[i][0] == lang[0] and predicted[i][1] == pytest.approx(float(score[0]))
