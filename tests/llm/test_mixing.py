import math
from collections import Counter, defaultdict

import pytest

from tributary.llm import mixing


def weights(tokens, a):
    x = {s: t**a for s, t in tokens.items() if t}
    return {s: v / sum(x.values()) for s, v in x.items()}


def entropy(w):
    return -sum(v * math.log(v) for v in w.values())


def test_exponent_meets_its_target(spark):
    tokens = {f"s{i}": 3**i * 10 for i in range(8)}
    rows = spark.createDataFrame([(t, float(max(tokens.values()))) for t in tokens.values()], "tokens long, most double")
    a = mixing.exponent(rows, 0.9, None)
    assert entropy(weights(tokens, a)) == pytest.approx(0.9 * math.log(8), abs=1e-6)
    b = mixing.exponent(rows, None, 2.0)
    assert (max(tokens.values()) / min(tokens.values())) ** (1 - b) == pytest.approx(2.0, rel=1e-6)
    assert mixing.exponent(rows, 0.9, 2.0) == max(a, b)
    assert mixing.exponent(rows.where("false"), 0.9, 2.0) == 1.0


def test_mixture_meets_weights_and_drops_nothing(docs, corpus, no_docs):
    out = mixing.mix(docs.withColumn("mix_pos", docs.doc_id), entropy_share=0.97, max_repeats=1.5, block_tokens=2000).collect()
    size = {d: len((t or "").split()) for d, t, *_ in corpus}
    source = {d: s for d, _, _, s, _ in corpus}
    times = Counter(r["doc_id"] for r in out)
    assert set(times) == set(size) and max(times.values()) <= 2
    assert all(times[d] == 1 for d, n in size.items() if n == 0)
    total, got = Counter(), Counter()
    for d, n in size.items():
        total[source[d]] += n
        got[source[d]] += n * times[d]
    want = {r["source"]: r["mix_weight"] for r in out if size[r["doc_id"]]}
    assert sum(want.values()) == pytest.approx(1.0)
    budget = max(total[s] / w for s, w in want.items())
    largest = max(size.values())
    for s, w in want.items():
        blocks = -(-total[s] // 2000)
        assert abs(got[s] - w * budget) <= blocks * largest
    for epoch, block, pos in {(r["mix_epoch"], r["mix_block"], r["mix_pos"]) for r in out}:
        assert epoch >= 1
    assert mixing.mix(no_docs).count() == 0


def test_budget_samples_whole_blocks_evenly(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "'a b c d e' as text", "if(id < 3000, 'big', 'small') as source")
    out = mixing.mix(rows, entropy_share=None, max_repeats=None, budget=10_000.0, block_tokens=1000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["big"] == pytest.approx(1500, abs=20) and n["small"] == pytest.approx(500, abs=10)
    assert out.dropDuplicates(["doc_id"]).count() == out.count()


def test_repeated_rows_pass_each(spark):
    rows = spark.createDataFrame([(1, "a b", "s")] * 5 + [(2, None, None)], "doc_id long, text string, source string")
    got = defaultdict(int)
    for r in mixing.mix(rows).collect():
        got[r["doc_id"]] += 1
    assert got == {1: 5, 2: 1}
