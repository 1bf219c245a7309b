import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import jaccard_join, line_dedup
from tributary.llm.components import components
from tributary.llm.shingles import shingle_sets

from .conftest import words


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(60)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_and_links_equal_brute_force(docs, corpus, no_docs):
    out = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    sets = dict(zip([r[0] for r in corpus], shingle_sets([r[1] or "" for r in corpus])))
    u, degree, texts = Union(), Counter(), defaultdict(set)
    for a in sets:
        u.find(a)
        for b in sets:
            if a < b and len(sets[a]) and len(sets[b]):
                n = len(np.intersect1d(sets[a], sets[b]))
                if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                    u.join(a, b)
                    degree.update((a, b))
                    if n < max(len(sets[a]), len(sets[b])):
                        texts[a].add(sets[b].tobytes())
                        texts[b].add(sets[a].tobytes())
    assert {k: (r["class_id"], r["n_links"], r["n_text_links"]) for k, r in out.items()} == {k: (u.find(k), degree[k], len(texts[k])) for k in sets}
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {k for k in sets if u.find(k) == k}
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_large_buckets_split_and_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1500)
    monkeypatch.setattr(jaccard_join, "SHORT", 50)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):  # near copies of one text
        own = list(base)
        own[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(40, 70):  # one passage in texts that differ
        rows.append((i, " ".join(base[:30] + [f"y{i}_{k}" for k in range(100)])))
    out = {r["doc_id"]: r for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[i]["class_id"] for i in range(40)} == {0} and all(out[i]["n_links"] == 39 for i in range(40))
    assert all(out[i]["class_id"] == i and out[i]["n_links"] == 0 for i in range(40, 70))


@pytest.mark.parametrize("shared", [300, 400])
def test_pairs_with_a_passage_of_many_are_found(spark, shared):
    """Pairs of similarity 0.8 to 0.85 in texts that all share a passage; no text meets another pair's."""
    rng, n, pairs = np.random.default_rng(5), 450, 1500 if shared == 300 else 400
    passage = [f"p{i}" for i in range(shared)]
    rows = []
    for g in range(pairs):
        own = [f"g{g}w{i}" for i in range(n - shared)]
        copy = list(own)
        for at in rng.choice(n - shared, 9 if shared == 300 else 4, replace=False):
            copy[at] = f"g{g}x{at}"
        rows += [(2 * g, " ".join(passage + own)), (2 * g + 1, " ".join(passage + copy))]
    sets = shingle_sets([t for _, t in rows])
    like = [len(np.intersect1d(sets[2 * g], sets[2 * g + 1])) / len(np.union1d(sets[2 * g], sets[2 * g + 1])) >= 0.8 for g in range(pairs)]
    assert sum(like) > 0.5 * pairs
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit(1)).withColumn("root", F.lit(2))
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect()}
    found = sum(out[2 * g + 1] == (2 * g, 1) for g in range(pairs) if like[g])
    assert found >= 0.99 * sum(like)
    assert all(out[k] == (k, 0) for g in range(pairs) if not like[g] for k in (2 * g, 2 * g + 1))


def test_null_ids_and_short_texts(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b"), (3, "a  b"), (4, None)], "doc_id long, text string")
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(rows).collect()}
    assert out == {None: (None, 0), 1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (4, 0)}
    assert {r["doc_id"] for r in jaccard_join.keep_one(rows).collect()} == {None, 1, 2, 4}


def shingles(line):
    words = line.split()
    return frozenset(" ".join(words[i : i + 2])[:9] for i in range(len(words)))


def test_line_classes_equal_brute_force(docs, corpus, no_docs):
    out = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_classes(docs).collect()}
    lines = {(d, i): x.strip(" ").lower() for d, t, *_ in corpus for i, x in enumerate((t or "").split("\n"))}
    assert set(out) == set(lines)
    long = {k: shingles(x) for k, x in lines.items() if len(x.split()) >= 5}
    u = Union()
    for a in long:
        for b in long:
            if a < b and len(long[a] & long[b]) >= 0.8 * len(long[a] | long[b]):
                u.join(a, b)
    assert all((out[k]["line_class"] is None and out[k]["kept"]) for k in lines if k not in long)
    by_class = defaultdict(set)
    for k in long:
        by_class[out[k]["line_class"]].add(u.find(k))
    assert all(len(roots) == 1 for roots in by_class.values())
    assert len(by_class) == len({u.find(k) for k in long})
    assert {k for k in long if out[k]["kept"]} == {min(k for k in long if u.find(k) == root) for root in {u.find(k) for k in long}}
    assert line_dedup.line_classes(no_docs).count() == 0


@pytest.mark.parametrize("small", [64, 4])
def test_all_lines_of_a_bucket_meet(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rng = np.random.default_rng(4)
    base = [f"c{i}{i * 7919 % 1000}" for i in range(30)]
    rows = []
    for g in range(120):  # texts with one passage in common, two or three near copies of each
        own = base + [f"g{g}x{k}" for k in range(14)]
        for c in range(2 + g % 2):
            line = list(own)
            line[int(rng.integers(44))] = f"e{g}y{c}"
            rows.append((len(rows), " ".join(line)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = line_dedup.exploded(df, "doc_id", "text", 5)
    keys = {r["key"]: r["id"] for r in lines.collect()}
    buckets = defaultdict(set)
    for r in line_dedup.banded(line_dedup.signatures(lines)).collect():
        buckets[r["band"]].add(keys[r["key"]])
    sets = {i: shingles(x) for i, x in rows}
    u = Union()
    for a, b in {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            u.join(a, b)
    assert max(map(len, buckets.values())) > 20
    out = line_dedup.line_classes(df).collect()
    assert {r["doc_id"] for r in out if r["kept"]} == {i for i, _ in rows if u.find(i) == i}


def test_planted_lines_are_found(spark):
    """Recall on planted pairs of similarity 0.8 to 0.95, and no line of another pair in a class."""
    rng = random.Random(9)
    rows = []
    while len(rows) < 3000:
        line = words(rng, rng.randrange(8, 70))
        copy = list(line)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = "".join(words(rng, 3))
        a, b = shingles(" ".join(line).lower()), shingles(" ".join(copy).lower())
        if 0.8 <= len(a & b) / len(a | b) < 0.95:
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(copy))]
    out = {r["doc_id"]: r["line_class"] for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(out[i] == out[i + 1] for i in range(0, len(rows), 2))
    assert found >= 0.98 * len(rows) / 2
    assert len({out[i] for i in range(0, len(rows), 2)}) == len(rows) / 2


def test_short_and_unspaced_lines(spark):
    rows = [(2, "Yes.\n\nno"), (1, "yes. \nYES, of course"), (None, "yes."), (3, "今天天气很好我们去公园散步然后回家吃饭"), (4, "今天天气很好我们去公园散步然后回家吃饭。"), (5, "今天天气很好我们也可以去海边游泳然后看书"), (6, "x" * 1_000_000), (7, "X" * 1_000_000), (8, "x" * 999_999)]
    df = spark.createDataFrame([(d, t, "k", "n") for d, t in rows], "doc_id long, text string, key string, norm string")
    out = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_classes(df, min_words=1).collect()}
    assert {k for k, r in out.items() if r["kept"]} == {(2, 1), (2, 2), (1, 1), (None, 0), (3, 0), (5, 0), (6, 0), (8, 0)}
    assert out[2, 1]["line_class"] is None and out[2, 0]["line_class"] == out[1, 0]["line_class"] == out[None, 0]["line_class"]
    text_ids = line_dedup.line_classes(spark.createDataFrame([("b", "one line"), ("a", "one line"), (None, "")], "doc_id string, text string"), min_words=1)
    assert {(r["doc_id"], r["kept"]) for r in text_ids.collect()} == {("b", False), ("a", True), (None, True)}


def test_dropping_lines(spark):
    rows = [(1, "keep this line of words\nshort", "x"), (2, "keep this line of words\nanother line of some words\nshort", "y"), (3, "keep this line of words", "z"), (4, None, "n"), (5, "", "e")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string, line_no string")).collect()}
    assert out == {1: rows[0][1], 2: "another line of some words\nshort", 4: None, 5: ""}


def pairs_at(sets, similarity):
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_lines_of_a_large_bucket_that_are_proved_apart_make_no_pair(spark, monkeypatch):
    rng = random.Random(11)
    base = rng.sample(range(-(1 << 31), 1 << 31), 80)
    sets = {}
    for key in range(150):  # most pairs are about 0.7 alike
        own = list(base)
        for at in rng.sample(range(80), 6 if key % 30 else 1):
            own[at] = rng.randrange(-(1 << 31), 1 << 31)
        sets[key] = set(own)
    rows = spark.createDataFrame([(k, len(s), sorted(s)) for k, s in sets.items()], "key long, n int, sh array<int>")
    large, roots = spark.range(150).select(F.lit(1).alias("band"), F.col("id").alias("key")), spark.createDataFrame([], "node long, root long")
    true = pairs_at(sets, 0.8)
    assert {tuple(sorted(r)) for r in line_dedup.apart(large, roots, rows, 0.8).collect()} == true
    monkeypatch.setattr(line_dedup, "holding", lambda pairs, *_: pairs)
    handed = line_dedup.apart(large, roots, rows, 0.8).count()
    assert 100 < len(true) <= handed <= 2 * len(true) < 0.3 * 150 * 149 / 2


def test_texts_that_are_proved_apart_make_no_pair(spark):
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(120):  # most pairs are about 0.7 alike
        own = list(base)
        for at in rng.sample(range(200), 3 if i % 30 else 1):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "id long, text string")
    sketches = docs.select("id", F.lit(bytearray(2 * jaccard_join.SKETCH)).alias("sketch"))  # all alike: they drop no pair
    got = {tuple(sorted(r)) for r in jaccard_join.prefix_links(docs.select("id", F.col("id").alias("root")), docs, sketches, 0.8, 5).collect()}
    true = pairs_at({i: set(s.tolist()) for (i, _), s in zip(rows, shingle_sets([t for _, t in rows]))}, 0.8)
    assert 50 < len(true) and true <= got and len(got) <= 2 * len(true) < 0.3 * 120 * 119 / 2
