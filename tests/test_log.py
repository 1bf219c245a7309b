"""Log folds, branches, time travel, convergent types and merges against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import crdt, folds, merge
from tributary.sources.archive import audit, drill, restore, sweep
from tributary.sources.catalog import Catalog
from tributary.sources.log_store import LogStore, Refused
from tributary.streaming.follower import breaker_stream, follow

LOG = "seq long, tx_pos int, branch_id long, commit_id long, op string, key string, value string, timestamp_ms long"


def random_log(seed, n=200):
    rng = random.Random(seed)
    out, commit = [], {0: -1, 1: -1}
    for seq in range(n):
        b = rng.randrange(2) if seq > n // 2 else 0
        commit[b] += 1
        for tx in range(rng.choice([1, 1, 3])):
            op = "delete" if rng.random() < 0.3 else "put"
            out.append((seq, tx, b, commit[b], op, f"t{rng.randrange(2)}:k{rng.randrange(12)}", None if op == "delete" else str(rng.randrange(5)), 1000 + seq * 10))
    return out


def plain_fold(rows):
    state = {}
    for seq, tx, b, commit, op, key, value, ts in sorted(rows):
        if op == "put":
            state[key] = (value, commit)
        else:
            state.pop(key, None)
    return state


def state(df):
    return {r["key"]: (r["value"], r["version"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_and_time_travel(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    main = [r for r in rows if r[2] == 0]
    only = log.where("branch_id = 0")
    assert state(folds.fold(only)) == plain_fold(main)
    line = folds.lineage(spark, [(0, None, None), (1, 0, 100)], 1)
    mine = [r for r in rows if r[2] == 1 or r[0] <= 100]
    assert state(folds.fold(folds.history(log, line))) == plain_fold(mine)
    at = main[len(main) // 2]
    early = [r for r in main if r[0] <= at[0]]
    assert state(folds.as_of(only, commit=at[3])) == state(folds.as_of(only, timestamp_ms=at[7] + 3)) == plain_fold(early)
    a, b = plain_fold(early), plain_fold(main)
    want = {k: ("added" if k not in a else "removed" if k not in b else "changed") for k in a.keys() | b.keys() if a.get(k, (None,))[0] != b.get(k, (None,))[0]}
    assert {r["key"]: r["change"] for r in folds.diff(folds.fold(only, at[0]), folds.fold(only)).collect()} == want
    assert folds.diff(folds.fold(only), folds.fold(only)).count() == 0
    half = folds.fold(only, at[0]).withColumn("seq", F.lit(at[0]).cast("long"))
    assert {k: v for k, (v, _) in state(folds.from_snapshot(half, only.where(F.col("seq") > at[0]))).items()} == {k: v for k, (v, _) in b.items()}


def test_feed_reaches_the_end_and_refuses_gaps(spark):
    rows = [r for r in random_log(3) if r[2] == 0]
    log = spark.createDataFrame(rows, LOG)
    seen, cursor = {}, -1
    while True:
        got = folds.since(log, cursor, 40)
        if got.next_commit == cursor:
            break
        for r in got.changes.collect():
            assert seen.get(r["key"]) == r["before"]
            seen[r["key"]] = r["after"]
        cursor = got.next_commit
    assert {k: v for k, v in seen.items() if v is not None} == {k: v for k, (v, _) in plain_fold(rows).items()}
    assert folds.since(log, 3, 10, horizon=9) == folds.Gap(9)
    with pytest.raises(folds.BeforeTheBeginning):
        folds.as_of(log, timestamp_ms=1)
    with pytest.raises(folds.BelowHorizon):
        folds.as_of(log, commit=3, horizon=5)


def test_schema_changes_erase_what_was_before_them(spark):
    fields = spark.createDataFrame([("t:a", "x", "1", 1), ("t:a", "y", "2", 1), ("t:a", "x", "3", 5), ("u:b", "x", "4", 1)], "key string, column string, value string, seq long")
    left = folds.drop_columns(fields, spark.createDataFrame([("t", "x", 3)], "table string, column string, seq long"))
    assert {(r["key"], r["column"], r["value"]) for r in left.collect()} == {("t:a", "y", "2"), ("t:a", "x", "3"), ("u:b", "x", "4")}
    renamed = folds.rename_columns(fields, spark.createDataFrame([("t", "x", "z", 3)], "table string, old string, new string, seq long"))
    assert {(r["column"], r["value"]) for r in renamed.collect()} == {("z", "1"), ("y", "2"), ("x", "3"), ("x", "4")}
    keys = spark.createDataFrame([("a:b:c",), (":x",), ("x:",), ("plain",)], "key string")
    assert [(r[0], r[1]) for r in keys.select(folds.table_of(F.col("key")), folds.pk_of(F.col("key"))).collect()] == [("a", "b:c"), (None, None), (None, None), (None, None)]


def test_schema_fold():
    field = {"name": "x", "type": "Int"}
    changes = [
        {"change": "add_table", "table": "t", "fields": [field]}, {"change": "add_column", "table": "t", "column": "y", "type": "Text"}, {"change": "alter_column_type", "table": "t", "column": "x", "to_type": "Float"},
        {"change": "rename_column", "table": "t", "column": "y", "to": "z"}, {"change": "set_nullable", "table": "t", "column": "z", "nullable": False}, {"change": "set_crdt", "table": "t", "column": "x", "kind": "counter"},
        {"change": "add_index", "table": "t", "index": "i", "columns": ["x"]}, {"change": "drop_index", "table": "t", "index": "i"}, {"change": "add_column", "table": "nowhere", "column": "q", "type": "Int"},
    ]
    assert folds.fold_schema(changes) == {"t": {"x": {"type": "Float", "nullable": True, "crdt": "counter"}, "z": {"type": "Text", "nullable": False, "crdt": None}, "#indexes": {}}}
    assert folds.fold_schema([*changes, {"change": "drop_column", "table": "t", "column": "x"}, {"change": "drop_table", "table": "t"}]) == {}


def test_convergent_types(spark):
    ops = spark.createDataFrame([("c", 0, 5, 1), ("c", 0, -2, 2), ("c", 1, 7, 3)], "key string, replica long, amount long, seq long")
    whole = crdt.counter_state(ops)
    for a, b in ((ops.where("seq < 3"), ops), (ops, ops), (ops.where("replica = 0"), ops.where("replica = 1"))):
        assert crdt.counter_value(crdt.merge_counters(crdt.counter_state(a), crdt.counter_state(b))).first()["value"] == crdt.counter_value(whole).first()["value"] == 10
    adds = spark.createDataFrame([(0, "s", "x", 1), (1, "s", "x", 4), (0, "s", "y", 2), (0, "s", "z", 5)], "lineage long, key string, element string, seq long")
    removes = spark.createDataFrame([(0, "s", "x", 3), (0, "s", "y", 6)], "lineage long, key string, element string, seq long")
    assert crdt.observed_set(adds, removes).first()["value"] == ["x", "z"]
    ins = [("d", 1, 0, None, None, "a"), ("d", 2, 0, 1, 0, "b"), ("d", 2, 1, 1, 0, "c"), ("d", 3, 0, 2, 0, "e"), ("d", 9, 0, 8, 0, "lost")]
    seq = crdt.sequence(spark.createDataFrame(ins, "key string, counter long, replica long, after_counter long, after_replica long, value string"), spark.createDataFrame([("d", 2, 0)], "key string, counter long, replica long"))
    assert [r["value"] for r in seq.orderBy("pos").collect()] == ["a", "c", "e"]
    mixed = spark.createDataFrame([("k", "increment", 1), ("k", "set_add", 2), ("k", "increment", 3)], "key string, crdt_op string, seq long")
    ok, rejected = crdt.split_by_kind(mixed)
    assert (ok.count(), [r["seq"] for r in rejected.collect()]) == (2, [2])


SIDE = "seq long, op string, key string, value string, crdt_kind string"


def test_merge_table(spark):
    source = [(1, "put", "a", "1", None), (2, "put", "b", "1", None), (3, "put", "c", "1", None), (4, "crdt", "d", None, "counter"), (5, "crdt", "e", None, "counter"), (6, "delete", "f", None, None), (7, "delete", "g", None, None)]
    target = [(1, "put", "b", "1", None), (2, "put", "c", "2", None), (3, "crdt", "d", None, "counter"), (4, "put", "e", "1", None), (5, "delete", "f", None, None), (6, "put", "h", "1", None), (7, "put", "g", "1", None)]
    s, t = (spark.createDataFrame(x, SIDE) for x in (source, target))
    got = {r["key"]: r["verdict"] for r in merge.classify(merge.effects(s), merge.effects(t)).collect()}
    assert got == {"a": "apply", "b": "same", "c": "conflict", "d": "converge", "e": "conflict", "f": "same", "g": "conflict", "h": "keep"}
    assert isinstance(merge.merge(s, t), merge.Conflicted) and isinstance(merge.merge(s.where("false"), t), merge.UpToDate)
    clean = merge.merge(s.where("key in ('a', 'b', 'd')"), t)
    assert [r["key"] for r in clean.apply.collect()] == ["a"] and [r["key"] for r in clean.converge.collect()] == ["d"]


def test_schema_merges():
    add = {"change": "add_column", "table": "t", "column": "x", "type": "Int"}
    other = {"change": "add_column", "table": "t", "column": "x", "type": "Text"}
    drop = {"change": "drop_table", "table": "t"}
    rename = {"change": "rename_column", "table": "t", "column": "y", "to": "x"}
    clash = lambda a, b: bool(merge.schema_conflicts(a, b))
    assert not clash([add], [add]) and clash([add], [other]) and clash([drop], [add]) and not clash([drop], [drop])
    assert clash([rename], [add]) and not clash([add], [{**other, "table": "u"}]) and not clash([add], [{**add, "column": "z"}])


def test_queue_is_first_in_first_out(spark):
    side = lambda *rows: spark.createDataFrame([(i, "put", k, v, None) for i, (k, v) in enumerate(rows)], SIDE)
    q = merge.MergeQueue(side(("z", "0")))
    first, second = q.enqueue(side(("a", "1"))), q.enqueue(side(("b", "1")))
    assert (first, second, q.position_of(second)) == (1, 2, 1)
    assert isinstance(q.enqueue(side(("a", "2"))), merge.Conflicted)
    landed = []
    assert q.pop_head(lambda s, m: landed.append(type(m).__name__)) == 1 and landed == ["Merged"]
    q.withdraw(second)
    assert q.pop_head(lambda s, m: None) is None and q.enqueue(side(("c", "1"))) == 3


def test_store_conditions_snapshots_archive_and_follower(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/log")
    store.put("t:a", {"n": 1}, "me", 1)
    store.append([{"op": "put", "key": "t:b", "value": {"n": 2}}, {"op": "put", "key": "t:c", "value": {"n": 3}}], "me", 2)
    assert store.get("t:a")[1] == 0 and store.get("t:zz") is None
    with pytest.raises(Refused):
        store.put_if("t:a", {"n": 9}, None, "me", 3)
    store.put_if("t:a", {"n": 9}, 0, "me", 3)
    with pytest.raises(Refused):
        store.append([{"op": "put", "key": "k", "value": 1}] * 2, "me", 4)
    with pytest.raises(Refused):
        store.append([{"op": "put", "key": "k", "value": 1}], "me", 4, expected=0)
    store.delete("t:b", "me", 5)
    log = store.read()
    assert {r["key"] for r in folds.fold(log).collect()} == {"t:a", "t:c"}
    links = {r["seq"]: (r["prev_hash"], r["entry_hash"]) for r in log.collect()}
    assert all(links[s][0] == links[s - 1][1] for s in links if s)
    snap = spark.read.parquet(store.snapshot("one"))
    assert state(folds.from_snapshot(snap, log.where("false"))) == state(folds.fold(log))
    parts = [sweep(log, f"file://{tmp_path}/arch/{i}", a, b) for i, (a, b) in enumerate([(0, 1), (2, 3)])]
    assert audit(spark, parts) == [] and drill(spark, parts, log)
    assert restore(spark, parts, newest=1).count() == 2
    assert audit(spark, [{**parts[0], "mark": 1}]) == [parts[0]["target"]]
    catalog = Catalog(spark)
    catalog.register_log("t", log.withColumn("value", F.expr("regexp_replace(value, '.*\"value\":([0-9]+).*', '{\"n\":$1}')")), "n long")
    assert {(r["_key"], r["n"]) for r in catalog.table("t").collect()} == {("a", 9), ("c", 3)}

    got = []
    run = lambda: follow(spark, store.root, f"file://{tmp_path}/ck", lambda df, n: got.extend((r["key"], r["change"]) for r in df.collect()), f"file://{tmp_path}/st").awaitTermination()
    run()
    assert sorted(got) == [("t:a", "added"), ("t:c", "added")]
    got.clear()
    store.put("t:c", {"n": 4}, "me", 9)
    store.put("t:d", {"n": 5}, "me", 10)
    run()
    assert sorted(got) == [("t:c", "changed"), ("t:d", "added")]


def test_breaker_stream_equals_batch(spark, tmp_path):
    from tributary.operators import safety

    rng, at, rows = random.Random(1), 0, []
    for seq in range(300):
        at += rng.randrange(0, 2000)
        rows.append((f"s{seq % 3}", seq, at, rng.randrange(0, 60)))
    schema = "scope string, seq long, at_ms long, rows long"
    policy = safety.Policy(rows=0, shadow=0, ceiling=300, window_ms=20_000)
    df = spark.createDataFrame(rows, schema)
    batch = {(r["scope"], r["seq"]): r["tripped"] for r in safety.breaker(df, policy).collect()}
    want, window, tripped = {}, {}, set()
    for scope, seq, t, n in rows:
        w = window.setdefault(scope, [])
        w[:] = [x for x in w if x[0] + policy.window_ms > t]
        if scope not in tripped and sum(x[1] for x in w) + n > policy.ceiling:
            tripped.add(scope)
        elif scope not in tripped:
            w.append((t, n))
        want[scope, seq] = scope in tripped
    assert batch == want and tripped
    firsts = {r["scope"]: r["seq"] for r in safety.trips(df, policy).collect()}
    assert firsts == {s: min(q for (z, q), hit in want.items() if z == s and hit) for s in tripped}
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = breaker_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "w")), policy)
    q = stream.writeStream.format("memory").queryName("breaker_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["scope"], r["seq"]): r["tripped"] for r in spark.table("breaker_out").collect()} == want
