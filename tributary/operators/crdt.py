"""Convergent types folded from their operations.

Operations of a key come from replicas (branches). Each fold is commutative in the
order in which rows are read, so a merge is the fold of the union of both sides'
operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kind that each operation belongs to.
KIND_OF_OP = {"increment": "counter", "set_register": "register", "set_add": "set", "set_remove": "set", "seq_insert": "sequence", "seq_remove": "sequence"}


def kind_of_op(op: str = "crdt_op"):
    return F.create_map(*(F.lit(x) for pair in KIND_OF_OP.items() for x in pair))[F.col(op)]


def split_by_kind(ops: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): operations of another kind than their key's, which is the declared one or that of its first operation."""
    own = ops.withColumn("kind", kind_of_op())
    first = own.groupBy("key").agg(F.min_by("kind", "seq").alias("key_kind"))
    if declared is not None:
        first = first.join(declared.select("key", F.col("kind").alias("declared")), "key", "left").select("key", F.coalesce("declared", "key_kind").alias("key_kind"))
    joined = own.join(first, "key")
    same = F.col("kind").eqNullSafe(F.col("key_kind"))
    return joined.where(same).drop("key_kind"), joined.where(~same)


def counter_state(ops: DataFrame) -> DataFrame:
    """(key, replica, pos, neg): what each replica added and took."""
    n = F.col("amount")
    return ops.groupBy("key", "replica").agg(F.sum(F.greatest(n, F.lit(0))).alias("pos"), F.sum(F.greatest(-n, F.lit(0))).alias("neg"))


def merge_counters(*states: DataFrame) -> DataFrame:
    """Each replica's greatest totals: states that share a past merge without counting it twice."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy("key", "replica").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))


def counter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg((F.sum("pos") - F.sum("neg")).alias("value"))


def register(ops: DataFrame) -> DataFrame:
    """The write of the greatest (timestamp_ms, replica, commit_id)."""
    return ops.groupBy("key").agg(F.max_by("value", F.struct("timestamp_ms", "replica", "commit_id")).alias("value"))


def observed_set(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """key and sorted elements with an add that no remove had seen.

    A remove sees the adds of its element before it in the same lineage. Only each
    element's last remove matters, so both sides shrink to one row for each
    (lineage, key, element) before they meet.
    """
    by = ["lineage", "key", "element"]
    last_add = adds.groupBy(*by).agg(F.max("seq").alias("added"))
    last_remove = removes.groupBy(*by).agg(F.max("seq").alias("removed"))
    live = last_add.join(last_remove, by, "left").where(F.col("removed").isNull() | (F.col("added") > F.col("removed")))
    return live.select("key", "element").distinct().groupBy("key").agg(F.array_sort(F.collect_list("element")).alias("value"))


def sequence_order(elements: list[tuple]) -> list[tuple]:
    """Depth-first order of (id, origin, removed, value); siblings by falling id. Elements of an unknown origin are unreachable."""
    children: dict = {}
    for e in elements:
        children.setdefault(e[1], []).append(e)
    for c in children.values():
        c.sort(key=lambda e: e[0])  # a stack takes the greatest first
    out, stack, seen = [], list(children.get(None, [])), set()
    while stack:
        e = stack.pop()
        if e[0] not in seen:
            seen.add(e[0])
            out.append(e)
            stack += children.get(e[0], [])
    return out


def sequence(inserts: DataFrame, removes: DataFrame) -> DataFrame:
    """(key, pos, counter, replica, value) of the live elements of each sequence.

    inserts: key, counter, replica (the id), after_counter, after_replica (null: at
    the start), value. removes: key, counter, replica. A sequence is one document
    and its tree is walked in one task.
    """
    gone = removes.select("key", "counter", "replica", F.lit(True).alias("gone")).distinct()
    marked = inserts.join(gone, ["key", "counter", "replica"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    whole = marked.groupBy("key").agg(F.collect_list(F.struct("counter", "replica", "after_counter", "after_replica", "gone", "value")).alias("es"))

    def walk(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for key, es in zip(pdf["key"], pdf["es"]):
                known = [((e["counter"], e["replica"]), None if e["after_counter"] is None else (e["after_counter"], e["after_replica"]), e["gone"], e["value"]) for e in es]
                live = [e for e in sequence_order(known) if not e[2]]
                rows += [(key, pos, *e[0], e[3]) for pos, e in enumerate(live)]
            yield pd.DataFrame(rows, columns=["key", "pos", "counter", "replica", "value"])

    return whole.mapInPandas(walk, "key string, pos long, counter long, replica long, value string")


def register_state(ops: DataFrame) -> DataFrame:
    """(key, stamp, value): the last write of each register with its stamp."""
    stamp = F.struct("timestamp_ms", "replica", "commit_id")
    return ops.groupBy("key").agg(F.max(stamp).alias("stamp"), F.max_by("value", stamp).alias("value"))


def merge_registers(*states: DataFrame) -> DataFrame:
    return union_all(states).groupBy("key").agg(F.max("stamp").alias("stamp"), F.max_by("value", "stamp").alias("value"))


def set_state(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(lineage, key, element, added, removed): the last add and the last remove of each element in each lineage."""
    by = ["lineage", "key", "element"]
    return adds.groupBy(*by).agg(F.max("seq").alias("added")).join(removes.groupBy(*by).agg(F.max("seq").alias("removed")), by, "full")


def merge_sets(*states: DataFrame) -> DataFrame:
    """Later adds and removes of each lineage win: states that share a past merge to their union."""
    return union_all(states).groupBy("lineage", "key", "element").agg(F.max("added").alias("added"), F.max("removed").alias("removed"))


def set_value(state: DataFrame) -> DataFrame:
    live = state.where(F.col("added").isNotNull() & (F.col("removed").isNull() | (F.col("added") > F.col("removed"))))
    return live.select("key", "element").distinct().groupBy("key").agg(F.array_sort(F.collect_list("element")).alias("value"))


def merge_sequences(*sides: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(inserts, removes) of the union: elements have ids of their own, so each counts once, and a removed one stays removed."""
    ids = ["key", "counter", "replica"]
    return union_all([i for i, _ in sides]).dropDuplicates(ids), union_all([r for _, r in sides]).select(*ids).distinct()


def union_all(frames) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def same_kind(kinds: DataFrame) -> DataFrame:
    """Keys whose states are of more than one kind: their merge is refused. kinds: key, kind."""
    return kinds.groupBy("key").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1").select("key")


def converged(counters: DataFrame | None = None, registers: DataFrame | None = None, sets: DataFrame | None = None, sequences: DataFrame | None = None) -> DataFrame:
    """(key, kind, value) of all convergent fields, the value as JSON: a number, a value or null, a list. Each frame has key and value; that of sequences key, pos and value."""
    parts = []
    for kind, df in (("counter", counters), ("register", registers), ("set", sets)):
        if df is not None:
            value = F.to_json("value") if kind == "set" else F.regexp_extract(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", 1)
            parts.append(df.select("key", F.lit(kind).alias("kind"), value.alias("value")))
    if sequences is not None:
        whole = sequences.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
        parts.append(whole.select("key", F.lit("sequence").alias("kind"), F.to_json(F.transform("v", lambda x: x["value"])).alias("value")))
    return union_all(parts)
