"""Branches, batch checks, rebasing, reflection and tampering."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import branches as B
from tributary.operators import folds, proofs, safety
from tributary.plans.query import Param, table
from tributary.sources import relational
from tributary.sources.log_store import LogStore


def test_branches(spark):
    events = spark.createDataFrame([], B.EVENT)
    events = B.create(events, "main", parent=None)
    events = B.create(events, "try", fork_seq=5)
    events = B.create(events, "shadow/1", parent="try", fork_seq=8)
    assert B.get(events, "try") == {"branch_id": 1, "name": "try", "parent": 0, "fork_seq": 5, "discarded": False}
    for bad in (lambda: B.create(events, "try"), lambda: B.create(events, "x", parent="no"), lambda: B.discard(events, "main"), lambda: B.discard(events, "shadow/1"), lambda: B.discard(events, "no"), lambda: B.restore(events, "try")):
        with pytest.raises(B.BranchRefused):
            bad()
    gone = B.discard(events, "try")
    assert B.get(gone, "try") is None and {r["name"] for r in B.listed(gone).collect()} == {"main", "shadow/1"}
    with pytest.raises(B.BranchRefused):
        B.create(gone, "try")
    back = B.restore(gone, "try")
    assert B.get(back, "try")["fork_seq"] == 5
    line = folds.lineage(spark, B.as_lineage(back), 2).collect()
    assert {(r["branch_id"], r["max_seq"]) for r in line} == {(2, None), (1, 8), (0, 5)}


def test_parameters_in_nested_terms(spark):
    q = table("t").filter(("or", ("a", "eq", Param("x", int)), ("not", ("b", "in", [Param("y"), 3]))), ("a", "gt", Param("x", int)))
    assert [p.name for p in q.params()] == ["x", "y"]
    with pytest.raises(TypeError):
        from tributary.plans.query import bound

        bound(("a", "eq", F.col("b")), {})


def test_batch_checks(spark):
    schema = "key string, email string, kind string"
    current = spark.createDataFrame([("t:1", "a", "Int"), ("t:2", "b", "Int")], schema)
    proposed = spark.createDataFrame([("t:3", "a", "Int"), ("t:2", "c", "Text"), ("t:4", None, "Null")], schema)
    declared = spark.createDataFrame([("t", "n", "Int")], "table string, column string, type string")
    out = safety.refused_writes(proposed, current, declared, ["email"], {"n": F.col("kind")}, safety.Policy(1, 1, ceiling=2))
    assert {(r["key"], r["rule"]) for r in out.collect()} == {("t:3", "unique"), ("t:2", "type"), (None, "breaker")}
    held = spark.createDataFrame([(0, None, "shadow_validate")] * 4, "proposed_ms long, settled_ms long, gate string")
    assert safety.reserve(held, 0, "agent", 1) == (True, 20) and safety.reserve(held, 1, "agent", 1) == (False, 20)


def test_rebase(spark):
    schema = "seq long, op string, key string, prev_hash string, entry_hash string"
    log = spark.createDataFrame([(0, "put", "t:a", proofs.ZERO, "h0")], schema)
    suffix = spark.createDataFrame([(7, "put", "t:b", "x", "y"), (9, "delete", "t:a", "y", "z")], schema)
    out = proofs.rebase(log, suffix, "op", "key").orderBy("seq").collect()
    assert [(r["seq"], r["key"]) for r in out] == [(1, "t:b"), (2, "t:a")]
    assert out[0]["prev_hash"] == "h0" and out[1]["prev_hash"] == out[0]["entry_hash"]
    empty = proofs.rebase(log.where("false"), suffix, "op", "key").orderBy("seq").collect()
    assert [r["seq"] for r in empty] == [0, 1] and empty[0]["prev_hash"] == proofs.ZERO


def test_reflection(spark):
    columns = spark.createDataFrame([("t", "b", "text", 2), ("t", "a", "int8", 1), ("u", "x", "_text", 1)], "table_name string, column_name string, udt_name string, ordinal_position int")
    keys = spark.createDataFrame([("t", "a", 1)], "table_name string, column_name string, ordinal_position int")
    t, u = relational.plans_of(columns, keys)
    assert (t.table, t.key, list(t.columns), t.blocked) == ("t", ("a",), ["a", "b"], None) and u.blocked and u.columns["x"].kind == "List"


def test_changed_commits_are_found(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/log")
    store.put("t:a", {"n": 1}, "me", 1)
    bulk = spark.range(50).select(F.lit("put").alias("op"), F.concat(F.lit("t:"), "id").alias("key"), F.col("id").cast("string").alias("value"))
    store.append_bulk(bulk, "me", 2)
    store.append([{"op": "put", "key": "t:b", "value": 2}, {"op": "delete", "key": "t:a"}], "me", 3)
    assert store.altered() == []
    for seq in (1, 2):
        path = f"{tmp_path}/log/commits/{seq}"
        rows = spark.read.parquet(path)
        changed = spark.createDataFrame(rows.withColumn("value", F.when(F.col("key").isin("t:7", "t:b"), "x").otherwise(F.col("value"))).collect(), rows.schema)
        changed.write.mode("overwrite").parquet(path)
        assert store.altered() == list(range(1, seq + 1))
