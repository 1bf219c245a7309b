"""Safety rules, reports, proofs and migration checks."""

import itertools

import pytest
from pyspark.sql import functions as F

from tributary.operators import inspect, migration as M, proofs, safety as S

CHANGE = "id long, change string, from_type string, to_type string, nullable boolean, backfill string, rows_affected long, protected boolean"


def test_gates(spark):
    kinds = [("add_column", None, None, None, None), ("drop_column", None, None, None, None), ("drop_index", None, None, None, None), ("rename_column", None, None, None, None), ("alter_column_type", "Int", "Float", None, None),
             ("alter_column_type", "Float", "Int", None, None), ("set_nullable", None, None, True, None), ("set_nullable", None, None, False, "0"), ("set_nullable", None, None, False, None)]
    rows = [(i, *k, n, p) for i, (k, n, p) in enumerate(itertools.product(kinds, (0, 500, 20_000, 10**6), (False, True)))]
    out = {r["id"]: r for r in S.classify(spark.createDataFrame(rows, CHANGE), S.DEVELOPMENT).withColumn("s", S.strictness()).withColumn("why", S.rationale()).collect()}
    severe = {0: "safe", 1: "destructive", 2: "ambiguous", 3: "ambiguous", 4: "safe", 5: "destructive", 6: "safe", 7: "ambiguous", 8: "destructive"}
    back = {0: True, 1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: False, 8: False}
    for i, r in out.items():
        kind, n, protected = i // 8, rows[i][6], rows[i][7]
        shadow, many = (100, 1000) if protected else (10_000, 50_000)
        bad = severe[kind] != "safe"
        want = 2 if bad and not back[kind] and n > shadow else 1 if bad or n > many else 0
        assert (r["severity"], r["reversible"], r["s"]) == (severe[kind], back[kind], want)
        assert r["why"]
        if protected:
            assert r["s"] >= out[i - 1]["s"]  # the same change unprotected
    assert {r["gate"] for r in out.values()} == set(S.GATES)


def test_budgets_and_lifecycle(spark):
    held = spark.createDataFrame([(1, "confirm", 0, None), (2, "shadow_validate", 0, 10), (3, "confirm", 20_000_000, None)], "id long, gate string, proposed_ms long, settled_ms long")
    got = {r["id"]: (r["state"], r["cost"]) for r in S.review_holds(held, S.PROPOSAL_TTL_MS).collect()}
    assert got == {1: ("expired", 0), 2: ("settled", 5)}
    decisions = spark.createDataFrame([(2, "promoted", 5)], "id long, decision string, at_ms long")
    assert {r["id"]: r["state"] for r in S.lifecycle(held, decisions, S.PROPOSAL_TTL_MS + 1).collect()} == {1: "expired", 2: "promoted", 3: "pending"}
    spend = spark.createDataFrame([("a", 0, 6), ("a", 50, 5), ("a", 100, 5), ("b", 0, 11)], "scope string, at_ms long, cost long")
    assert [(r["spent"], r["over"]) for r in S.rolling_spend(spend, 10, window_ms=100).orderBy("scope", "at_ms").collect()] == [(6, False), (11, True), (10, False), (11, True)]


def test_spend_adds_each_row_once_whatever_the_window_holds(spark):
    rows = [("a", 50 * (i % 40), -3 if i % 7 == 0 else i, i) for i in range(400)] + [("b", 5, None, 900), ("b", 90, 4, 901), ("b", 300, None, 902), ("c", None, 2, 903), ("c", None, 5, 904), ("c", 7, 1, 905)]
    out = S.rolling_spend(spark.createDataFrame(rows, "scope string, at_ms long, cost long, id long"), 10, window_ms=100)
    inside = lambda x, r: x[0] == r[0] and (x[1] is r[1] is None or None not in (x[1], r[1]) and r[1] - 100 < x[1] <= r[1])
    want = {r[3]: (lambda costs: sum(costs) if costs else None)([x[2] for x in rows if inside(x, r) and x[2] is not None]) for r in rows}
    assert {r["id"]: r["spent"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rangeframe, unboundedpreceding$" in plan and "rangeframe, -99" not in plan  # a sliding frame adds its whole window again for every row
    fractions = S.rolling_spend(spark.createDataFrame([("a", 0, 1e17), ("a", 200, 0.1)], "scope string, at_ms long, cost double"), 10, window_ms=100)
    assert {r["spent"] for r in fractions.collect()} == {1e17, 0.1}

def test_claims_and_describe(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("a", None, "y"), ("c", 3, "x")], "_key string, n long, t string")
    assert S.claim(df, F.col("n").isNull()).first()["first_key"] == "a"
    assert S.claim(df, F.col("n") > 5).first()["holds"]
    assert {(r["_holders"], r["_first"]) for r in S.unique_violations(df, ["t"]).collect()} == {(2, "b")}
    assert S.unique_violations(df, ["n"]).count() == 0
    out = {r["column"]: r for r in inspect.describe(df, withhold=frozenset({"n"})).collect()}
    assert out["n"]["null_bp"] == 3333 and out["n"]["examples"] is None and out["n"]["refused"] == "withheld"
    assert out["t"]["examples"] == ["y", "x"] and out["t"]["table_rows"] == 3
    regions = spark.createDataFrame([("r", 0), ("s", None), ("t", 10**6)], "region string, merged_ms long")
    assert {r["region"] for r in inspect.lagging(regions, 10**6).collect()} == {"r", "s"}
    changes = spark.createDataFrame([(1, 1, "add_table", "t", None, "human", None), (2, 2, "add_column", "t", "x", "agent", "s1"), (3, 3, "set_nullable", "t", "x", "human", None)], "seq long, commit_id long, change string, table string, column string, author_kind string, session_id string")
    got = {r["column"]: r for r in inspect.schema_provenance(changes).collect()}
    assert got["x"]["declared_seq"] == 2 and got["x"]["touched_by_agent"] and got["x"]["last_author"] == "human" and not got[None]["touched_by_agent"]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 8, 13])
def test_merkle_proofs(spark, n):
    rows = [(f"k{i:02d}", f"v{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "key string, value string").repartition(3)
    level = [proofs._hash("leaf", k, v) for k, v in rows]
    while len(level) > 1:
        level = [proofs._hash("node", *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    root = level[0] if level else proofs.ZERO
    assert proofs.merkle_root(df) == root
    if n in (5, 13):
        levels = proofs.merkle_levels(df)
        for low, high in (("k01", "k03"), ("k", "l"), ("k03x", "k03y"), ("a", "b"), ("z", "zz")):
            proof = proofs.prove_range(levels, low, high)
            assert proofs.verify_range(proof, root, low, high) == [k for k, _ in rows if low <= k < high]
            assert proofs.verify_range(proof, "0" * 63 + "1", low, high) is None
        cut = proofs.prove_range(levels, "k01", "k04")
        assert proofs.verify_range(proofs.RangeProof(cut.start, (*cut.entries[:2], *cut.entries[3:]), cut.beside, cut.size), root, "k01", "k04") is None


def test_chains_and_sync(spark):
    chain, prev = [], proofs.ZERO
    for i in range(5):
        h = proofs.chain_hash(prev, str(i), "x")
        chain.append((prev, h, (str(i), "x")))
        prev = h
    assert proofs.verify_inclusion(chain[2:], prev) and not proofs.verify_inclusion(chain[2:4], prev)
    assert not proofs.verify_inclusion([*chain[:2], (chain[2][0], chain[2][1], ("9", "x")), *chain[3:]], prev)
    log = spark.createDataFrame([(i, p, h) for i, (p, h, _) in enumerate(chain) if i != 2], "seq long, prev_hash string, entry_hash string")
    assert [r["seq"] for r in proofs.chain_breaks(log).collect()] == [3]
    anchors = spark.createDataFrame([(3, chain[3][1], 10), (1, chain[1][1], 20), (4, "bad", 30)], "covered_seq long, head_hash string, published_ms long")
    found = {r["covered_seq"]: (r["shrinks"], r["unknown"], r["stale"]) for r in proofs.anchor_findings(anchors, log, 10**9).collect()}
    assert found == {3: (False, False, False), 1: (True, False, False), 4: (False, True, True)}
    entries = spark.createDataFrame([("h1", "s1"), ("h2", "s2")], "content_hash string, session_id string")
    assert [r["content_hash"] for r in proofs.unsigned(entries, spark.createDataFrame([("h1", "s1"), ("h2", "s9")], "content_hash string, signer string")).collect()] == ["h2"]


def test_values_and_plans(spark):
    cells = {
        "Bool": {"t": True, "off": False, "maybe": None}, "Int": {"-12": -12, "1.5": None, "99999999999999999999": None}, "Float": {"1e3": 1000.0, "x": None},
        "Bytes": {"\\x00ff": b"\x00\xff", "00ff": None}, "Timestamp": {"1970-01-01": 0, "1969-12-31 23:59:59.5+00": -500, "2040-01-31T00:00:00Z": 2211580800000, "no": None}, "Text": {"": ""}, "Map": {'{"a":1}': '{"a":1}', "{": None},
    }
    for kind, want in cells.items():
        df = spark.createDataFrame([(k,) for k in want] + [(None,)], "c string")
        got = {r["c"]: r["v"] for r in df.select("c", M.parsed(F.col("c"), kind).alias("v")).collect()}
        assert {k: bytes(v) if isinstance(v, bytearray) else v for k, v in got.items() if k is not None} == want and got[None] is None
    bad = M.unparseable(spark.createDataFrame([("1", "x"), ("y", "z"), (None, "2")], "a string, b string"), {"a": "Int", "b": "Int"})
    assert {r["column"]: (r["bad"], r["example"]) for r in bad.collect()} == {"a": (1, "y"), "b": (2, "x")}
    assert M.map_type("numeric").lossy and M.map_type("_text").kind == "List" and M.map_type("hstore") == M.Mapping("Text", True)
    assert M.plan_import("audit", {"note": "text"}, []).blocked and not M.plan_import("o", {"a": "int8"}, ["a"]).blocked


def test_archive_rules(spark):
    segments = spark.createDataFrame([(0, 9, 1), (10, 19, 5), (25, 29, 2), (30, 39, 9)], "first_seq long, last_seq long, archived_ms long")
    assert [tuple(r) for r in M.manifest_gaps(segments).collect()] == [(20, 24)]
    assert [r["first_seq"] for r in M.expired(segments, 3).collect()] == [0]
    assert [r["first_seq"] for r in M.expired(segments, 100).orderBy("first_seq").collect()] == [0, 10, 25]
