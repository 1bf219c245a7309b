import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["the", "of", "an", "ing", "er", "ti", "on", "wh", "sh", "re", "ou", "nd", "ha", "st", "é", "ß"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def prose(rng, n):
    out = words(rng, n)
    for i in range(12, n, 17):
        out[i] += "."
    return "".join(w + ("\n" if i % 40 == 39 else " ") for i, w in enumerate(out)).strip()


def edited(rng, text, k):
    out = text.split(" ")
    for _ in range(k):
        out[rng.randrange(len(out))] = rng.choice(words(rng, 1))
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: prose, exact and near copies in groups, and every odd case."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(60, 300)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1]]
    texts += [edited(rng, texts[2], k) for k in (1, 2, 2, 3)] + [edited(rng, texts[3], 6) for _ in range(8)]
    texts += [None, "", " \n\t ", "one two three", "one two three", "x" * 40_000, "word " * 9_000, "a\x02b\x1fc <|endoftext|> \\ <| |>", "!!! ### $$$ " * 30]
    rows = [(i * 3, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i % 4 if i % 2 else 0}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
