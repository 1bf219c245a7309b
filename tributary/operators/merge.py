"""Three-way merges: what each side did since the base, classified key by key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effects(side: DataFrame) -> DataFrame:
    """Net effect of a side's writes since the base on each key: kind (assign or crdt kind) and value; a delete assigns null.

    The last write decides whether an assignment or a convergent operation stands;
    convergent operations then accumulate in their own folds.
    """
    kind = F.when(F.col("op") == "crdt", F.col("crdt_kind")).otherwise(F.lit("assign"))
    value = F.when(F.col("op") == "put", F.col("value"))
    at = F.struct("seq", "tx_pos") if "tx_pos" in side.columns else F.col("seq")
    rows = side.where(F.col("op").isin("put", "delete", "crdt"))
    return rows.groupBy("key").agg(F.max_by(F.struct(kind.alias("kind"), value.alias("value")), at).alias("e")).select("key", "e.kind", "e.value")


def classify(source: DataFrame, target: DataFrame) -> DataFrame:
    """key, verdict, and both values. Verdicts: apply, keep, converge, same, conflict."""
    s = source.select("key", F.col("kind").alias("s_kind"), F.col("value").alias("s_value"))
    t = target.select("key", F.col("kind").alias("t_kind"), F.col("value").alias("t_value"))
    both_assign = (F.col("s_kind") == "assign") & (F.col("t_kind") == "assign")
    verdict = (
        F.when(F.col("t_kind").isNull(), "apply")
        .when(F.col("s_kind").isNull(), "keep")
        .when(both_assign & F.col("s_value").eqNullSafe(F.col("t_value")), "same")
        .when(~both_assign & (F.col("s_kind") == F.col("t_kind")), "converge")
        .otherwise("conflict")
    )
    return s.join(t, "key", "full").select("key", verdict.alias("verdict"), "s_value", "t_value", "s_kind", "t_kind")


@dataclass(frozen=True)
class Merged:
    """Assignments and converging keys to land; a conflicting merge lands nothing."""

    apply: DataFrame
    converge: DataFrame


@dataclass(frozen=True)
class Conflicted:
    conflicts: DataFrame
    schema: tuple = ()


@dataclass(frozen=True)
class UpToDate:
    pass


def merge(source: DataFrame, target: DataFrame, source_schema: list[dict] = (), target_schema: list[dict] = ()) -> Merged | Conflicted | UpToDate:
    """All or nothing: any conflict of data or schema leaves only the conflicts."""
    mine = effects(source)
    if not source_schema and mine.isEmpty():
        return UpToDate()
    found = classify(mine, effects(target))
    conflicts = found.where("verdict = 'conflict'")
    clashes = schema_conflicts(list(source_schema), list(target_schema))
    if clashes or not conflicts.isEmpty():
        return Conflicted(conflicts, tuple(clashes))
    return Merged(found.where("verdict = 'apply'").select("key", "s_value"), found.where("verdict = 'converge'").select("key", F.col("s_kind").alias("kind")))


TABLE_WIDE = {"add_table", "drop_table"}


def subject(change: dict) -> tuple[str, str | None]:
    """What a schema change declares: a table, or a table's column or index."""
    return change["table"], None if change["change"] in TABLE_WIDE else change.get("column") or change.get("index")


def schema_conflicts(source: list[dict], target: list[dict]) -> list[tuple[dict, dict]]:
    """Pairs of changes that cannot both hold. Schema changes are few and live on the driver.

    Equal changes agree. A change of a whole table clashes with any change to that
    table unless both sides made the same list; a rename clashes with whatever
    declares its new name.
    """
    out = []
    for a in source:
        for b in target:
            if a == b or a["table"] != b["table"]:
                continue
            wide = {a["change"], b["change"]} & TABLE_WIDE
            same_list = [c for c in source if c["table"] == a["table"]] == [c for c in target if c["table"] == a["table"]]
            renamed = {c.get("to") for c in (a, b) if c["change"] == "rename_column"} - {None}
            if (wide and not same_list) or (not wide and (subject(a) == subject(b) or renamed & {subject(a)[1], subject(b)[1]})) or len(renamed) == 1 and a.get("to") == b.get("to"):
                out.append((a, b))
    return out


@dataclass
class MergeQueue:
    """First in, first out; each entry is tried against the target and all entries before it. Tickets are never used again."""

    target: DataFrame
    waiting: list[tuple[int, DataFrame]] = field(default_factory=list)
    issued: int = 0

    def ahead(self, place: int) -> DataFrame:
        rows = self.target
        for _, source in self.waiting[:place]:
            rows = rows.unionByName(source)
        return rows

    def enqueue(self, source: DataFrame) -> int | Conflicted:
        found = merge(source, self.ahead(len(self.waiting)))
        if isinstance(found, Conflicted):
            return found
        self.issued += 1
        self.waiting.append((self.issued, source))
        return self.issued

    def withdraw(self, ticket: int) -> None:
        self.waiting = [(t, s) for t, s in self.waiting if t != ticket]

    def position_of(self, ticket: int) -> int | None:
        return next((i for i, (t, _) in enumerate(self.waiting) if t == ticket), None)

    def revalidate(self) -> list[int]:
        """Tickets that no longer merge behind those before them; they leave the queue."""
        refused, kept = [], []
        for ticket, source in self.waiting:
            before = MergeQueue(self.target, kept).ahead(len(kept))
            if isinstance(merge(source, before), Conflicted):
                refused.append(ticket)
            else:
                kept.append((ticket, source))
        self.waiting = kept
        return refused

    def pop_head(self, land: Callable[[DataFrame, Merged | UpToDate | Conflicted], None]) -> int | None:
        if not self.waiting:
            return None
        ticket, source = self.waiting.pop(0)
        land(source, merge(source, self.target))
        self.target = self.target.unionByName(source)
        return ticket


def shadow_findings(before: DataFrame, shadow: DataFrame, table: str) -> DataFrame:
    """Per table, rows added, changed and removed on a shadow branch, and whether that table may change. States have key and value."""
    from tributary.operators.folds import diff, table_of

    moved = diff(before, shadow).withColumn("table", table_of(F.col("key")))
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "changed", "removed")]
    return moved.groupBy("table").agg(*counts).withColumn("expected", F.col("table").eqNullSafe(F.lit(table)))
