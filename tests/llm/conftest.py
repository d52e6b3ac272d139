import random

import pytest

LETTERS = "abcdefghij"


def prose(rng, n, sentence=8):
    """Lines of made-up words."""
    words = ["".join(rng.choices(LETTERS, k=rng.randint(2, 6))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + sentence]) for i in range(0, n, sentence))


@pytest.fixture(scope="session")
def corpus():
    """Ids and texts with copies, near copies, shared passages, repeated lines and odd cases."""
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([5, 60, 90, 150])) for _ in range(25)]
    shared = prose(rng, 40)
    for k in range(12):
        base = texts[k].split(" ")
        for _ in range(rng.randint(1, 6)):
            base[rng.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
    texts += [texts[0], texts[0], texts[3] + "\n" + shared, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 20)]
    texts += ["", None, " \t\n ", "one", "two words", "!!! ???", "é à ü ß 漢字", "x" * 4000, "a b c d e " * 300, "word " * 60, "\n\nlead\n\ntail\n"]
    texts += ["\n".join([texts[5].split("\n")[0]] * 4)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with further columns, some named like results."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}" if i % 9 else None, "kept", i) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n_words long").repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark, docs):
    """The same with repeated rows, and rows without an id."""
    nameless = docs.where("doc_id % 7 = 0").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "kept", "n_words")
    return docs.union(docs.where("doc_id % 5 = 0")).union(nameless)
