"""Table states as folds of an append-only log, and what time travel makes of them.

A log row: seq (global append order), tx_pos (order inside a transaction),
branch_id, commit_id, op (put, delete, crdt, schema, branch, merge), key
(``table:pk``), value (any type; tagged text in the store), author, timestamp_ms.
Every state is derived; forks copy nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_OPS = ("put", "delete", "crdt", "schema", "merge")


class BeforeTheBeginning(LookupError):
    """The log has no commit as early as asked."""


class BelowHorizon(LookupError):
    """The commits asked for have been expired."""


def table_of(key: Column) -> Column:
    """Table of a ``table:pk`` key; null where either part is empty."""
    return F.when(key.rlike(r"(?s)^[^:]+:.+$"), F.substring_index(key, ":", 1))


def pk_of(key: Column) -> Column:
    return F.when(table_of(key).isNotNull(), F.regexp_extract(key, r"(?s)^[^:]+:(.*)$", 1))


def lineage(spark: SparkSession, branches: list[tuple[int, int | None, int | None]], branch: int) -> DataFrame:
    """(branch_id, max_seq) of a branch and its ancestors. branches: (id, parent, fork_seq), a driver-side catalog."""
    by_id = {b: (parent, fork) for b, parent, fork in branches}
    rows, at, limit = [], branch, None
    while at is not None:
        rows.append((at, limit))
        parent, fork = by_id[at]
        limit = fork if limit is None or (fork is not None and fork < limit) else limit
        at = parent
    return spark.createDataFrame(rows, "branch_id long, max_seq long")


def history(log: DataFrame, line: DataFrame) -> DataFrame:
    """Log rows that a branch sees: its own and its ancestors' up to each fork. The lineage has a row for each ancestor and is broadcast."""
    seen = log.join(F.broadcast(line), "branch_id")
    return seen.where(F.col("max_seq").isNull() | (F.col("seq") <= F.col("max_seq"))).drop("max_seq")


def newest(rows: DataFrame, by: list[str], *fields: str) -> DataFrame:
    """The fields of each group's last row in (seq, tx_pos) order: one partial and one final aggregate."""
    at = F.struct("seq", "tx_pos") if "tx_pos" in rows.columns else F.col("seq")
    return rows.groupBy(*by).agg(F.max_by(F.struct(*fields), at).alias("last")).select(*by, "last.*")


def fold(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Current rows: key, value and version (the commit that last wrote the key). Deleted keys are absent."""
    rows = log.where(F.col("op").isin("put", "delete"))
    rows = rows if upto is None else rows.where(F.col("seq") <= upto)
    return newest(rows, ["key"], "op", "value", "commit_id").where("op = 'put'").select("key", "value", F.col("commit_id").alias("version"))


def from_snapshot(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """The fold of a saved fold (key, value, version, seq) and the log rows after it."""
    before = snapshot.select("key", "value", F.col("version").alias("commit_id"), "seq", F.lit(0).alias("tx_pos"), F.lit("put").alias("op"))
    return fold(before.unionByName(tail.where(F.col("op").isin("put", "delete")).select(*before.columns)))


def resolve(log: DataFrame, commit: int | None = None, timestamp_ms: int | None = None, horizon: int = 0) -> int:
    """The seq that a point in time means: of a commit id, of the last commit at or before a time, or of now."""
    rows = log
    if commit is not None:
        rows = rows.where(F.col("commit_id") <= commit)
        if commit < horizon:
            raise BelowHorizon(commit)
    elif timestamp_ms is not None:
        rows = rows.where(F.col("timestamp_ms") <= timestamp_ms)
    seq, commit_found = rows.agg(F.max("seq"), F.max("commit_id")).first()
    if seq is None:
        raise BeforeTheBeginning(commit if commit is not None else timestamp_ms)
    if commit_found < horizon:
        raise BelowHorizon(commit_found)
    return seq


def as_of(log: DataFrame, commit: int | None = None, timestamp_ms: int | None = None, horizon: int = 0) -> DataFrame:
    """The table state at a point in time; refuses a point before the log or the horizon and never answers with another."""
    return fold(log, resolve(log, commit, timestamp_ms, horizon))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change (added, changed, removed), before and after, for keys whose values differ."""
    b = before.select("key", F.col("value").alias("before"), F.lit(True).alias("in_b"))
    a = after.select("key", F.col("value").alias("after"), F.lit(True).alias("in_a"))
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return b.join(a, "key", "full").withColumn("change", change).where("change is not null").select("key", "change", "before", "after")


def between(log: DataFrame, before: Column, after: Column) -> DataFrame:
    """The diff of a log's folds at two points, each given by which rows it has (the first's are among the second's): one aggregate, no join."""
    rows = log.where(F.col("op").isin("put", "delete") & after)
    at = F.struct("seq", "tx_pos") if "tx_pos" in log.columns else F.col("seq")
    last = lambda known: F.max_by(F.struct("op", "value"), F.when(known, at))
    both = rows.groupBy("key").agg(last(before).alias("b"), last(F.lit(True)).alias("a"))
    in_b, in_a = F.coalesce(F.col("b.op") == "put", F.lit(False)), F.col("a.op") == "put"
    old, new = F.when(in_b, F.col("b.value")), F.when(in_a, F.col("a.value"))
    change = F.when(in_a & ~in_b, "added").when(in_b & ~in_a, "removed").when(in_a & in_b & ~old.eqNullSafe(new), "changed")
    return both.select("key", change.alias("change"), old.alias("before"), new.alias("after")).where("change is not null")


@dataclass(frozen=True)
class Delivered:
    changes: DataFrame
    next_commit: int


@dataclass(frozen=True)
class Gap:
    """The cursor's next commit has been expired: the follower must start again from a snapshot."""

    horizon: int


def since(log: DataFrame, after_commit: int, limit: int, horizon: int = 0) -> Delivered | Gap:
    """Changes of the next ``limit`` commits after a cursor, net of writes that cancel. -1 is before the first commit."""
    if after_commit + 1 < horizon:
        return Gap(horizon)
    ahead = log.where(F.col("commit_id") > after_commit).select("commit_id").distinct().orderBy("commit_id").limit(limit)
    upto = ahead.agg(F.max("commit_id")).first()[0]
    if upto is None:
        return Delivered(diff(fold(log.where("false")), fold(log.where("false"))), after_commit)
    return Delivered(between(log, F.col("commit_id") <= after_commit, F.col("commit_id") <= upto), upto)


def touches_rows() -> Column:
    return F.col("op").isin(*ROW_OPS)


def branch_point(log: DataFrame) -> int | None:
    """Commit of the last branch creation."""
    return log.where("op = 'branch'").agg(F.max_by("commit_id", "seq")).first()[0]


def drop_rows(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """Writes that survive table drops: those after the last drop of their table. drops: (table, seq), as few as schema changes."""
    last = drops.groupBy(F.col("table").alias("__t")).agg(F.max("seq").alias("drop_seq"))
    kept = rows.join(F.broadcast(last), table_of(F.col("key")) == F.col("__t"), "left")
    return kept.where(F.col("drop_seq").isNull() | (F.col("seq") > F.col("drop_seq"))).drop("__t", "drop_seq")


def drop_columns(fields: DataFrame, drops: DataFrame) -> DataFrame:
    """The same for fields (key, column, seq, ...): a field survives if written after its column's last drop. A row without fields is gone."""
    last = drops.groupBy(F.col("table").alias("__t"), F.col("column").alias("__c")).agg(F.max("seq").alias("drop_seq"))
    on = (table_of(F.col("key")) == F.col("__t")) & (F.col("column") == F.col("__c"))
    kept = fields.join(F.broadcast(last), on, "left")
    return kept.where(F.col("drop_seq").isNull() | (F.col("seq") > F.col("drop_seq"))).drop("__t", "__c", "drop_seq")


def rename_columns(fields: DataFrame, renames: DataFrame) -> DataFrame:
    """Fields under their new names: a rename at seq s moves what was written before it. renames: (table, old, new, seq)."""
    r = F.broadcast(renames.select(F.col("table").alias("__t"), "old", "new", F.col("seq").alias("rename_seq")))
    on = (table_of(F.col("key")) == F.col("__t")) & (F.col("column") == F.col("old")) & (F.col("seq") < F.col("rename_seq"))
    moved = fields.join(r, on, "left").groupBy(*fields.columns).agg(F.min_by("new", "rename_seq").alias("__new"))
    return moved.withColumn("column", F.coalesce("__new", "column")).drop("__new")


def fold_schema(changes: list[dict]) -> dict[str, dict[str, dict]]:
    """Declared tables after schema changes in order: {table: {column: {type, nullable, crdt}}}. Schema changes are few and live on the driver.

    Indexes are recorded under ``#indexes``; changes of unknown tables declare nothing.
    """
    tables: dict[str, dict[str, dict]] = {}
    for c in changes:
        t, what, column = c["table"], c["change"], c.get("column")
        if what == "add_table":
            tables[t] = {f["name"]: {"type": f["type"], "nullable": f.get("nullable", True), "crdt": f.get("crdt")} for f in c.get("fields", [])}
            continue
        if t not in tables:
            continue
        if what == "drop_table":
            del tables[t]
        elif what == "add_column":
            tables[t][column] = {"type": c["type"], "nullable": c.get("nullable", True), "crdt": c.get("crdt")}
        elif what == "drop_column":
            tables[t].pop(column, None)
        elif what == "rename_column":
            tables[t] = {c["to"] if k == column else k: v for k, v in tables[t].items()}
        elif what in ("add_index", "drop_index"):
            names = tables[t].setdefault("#indexes", {})
            names.update({c["index"]: c.get("columns")}) if what == "add_index" else names.pop(c["index"], None)
        elif column in tables[t]:
            field = {"alter_column_type": "type", "set_nullable": "nullable", "set_crdt": "crdt"}[what]
            tables[t][column] = tables[t][column] | {field: c[{"type": "to_type", "nullable": "nullable", "crdt": "kind"}[field]]}
    return tables


def type_violations(fields: DataFrame, declared: DataFrame) -> DataFrame:
    """Written fields whose kind is neither the declared type nor null: (key, column, kind, type).

    fields: key, column, kind; declared: table, column, type, as few as columns are.
    Undeclared columns may hold anything.
    """
    d = F.broadcast(declared.select(F.col("table").alias("__t"), F.col("column").alias("__c"), "type"))
    joined = fields.join(d, (table_of(F.col("key")) == F.col("__t")) & (F.col("column") == F.col("__c")))
    return joined.where((F.col("kind") != F.col("type")) & (F.col("kind") != "Null")).select("key", "column", "kind", "type")
