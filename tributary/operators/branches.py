"""The catalog of branches: a small frame, one row for each branch, folded from its events like any table.

An event is (seq, branch_id, name, op, parent, fork_seq); op is create, discard or
restore. A fork copies nothing. The main branch and shadow branches stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN, SHADOW = "main", "shadow/"
EVENT = "seq long, branch_id long, name string, op string, parent long, fork_seq long"


class BranchRefused(ValueError):
    """A branch operation whose precondition does not hold."""


def listed(events: DataFrame, discarded: bool = False) -> DataFrame:
    """branch_id, name, parent, fork_seq and discarded of each branch, from its last event; parents and forks are those of its creation."""
    made = F.struct("name", "parent", "fork_seq")
    rows = events.groupBy("branch_id").agg(F.min_by(made, F.when(F.col("op") == "create", F.col("seq"))).alias("m"), F.max_by("op", "seq").alias("last"))
    rows = rows.select("branch_id", "m.*", (F.col("last") == "discard").alias("discarded"))
    return rows if discarded else rows.where("not discarded")


def get(events: DataFrame, name: str) -> dict | None:
    row = listed(events).where(F.col("name") == name).first()
    return row.asDict() if row else None


def _add(events: DataFrame, *row) -> DataFrame:
    last = events.agg(F.max("seq")).first()[0]
    return events.unionByName(events.sparkSession.createDataFrame([(0 if last is None else last + 1, *row)], EVENT))


def create(events: DataFrame, name: str, parent: str | None = MAIN, fork_seq: int | None = None) -> DataFrame:
    """The events with a new branch; a name that is in use, or once was, is refused, as is an unknown parent."""
    every = listed(events, discarded=True)
    if not every.where(F.col("name") == name).isEmpty():
        raise BranchRefused(f"there is a branch {name}")
    own = get(events, parent) if parent else None
    if parent and own is None:
        raise BranchRefused(f"no branch {parent}")
    number = every.agg(F.max("branch_id")).first()[0]
    return _add(events, 0 if number is None else number + 1, name, "create", own["branch_id"] if own else None, fork_seq)


def discard(events: DataFrame, name: str) -> DataFrame:
    """The events with a branch discarded; its rows stay in the log, so it can be restored. Main and shadow branches are refused."""
    found = get(events, name)
    if name == MAIN or name.startswith(SHADOW):
        raise BranchRefused(f"{name} is protected")
    if found is None:
        raise BranchRefused(f"no branch {name}")
    return _add(events, found["branch_id"], name, "discard", None, None)


def restore(events: DataFrame, name: str) -> DataFrame:
    row = listed(events, discarded=True).where((F.col("name") == name) & F.col("discarded")).first()
    if row is None:
        raise BranchRefused(f"no discarded branch {name}")
    return _add(events, row["branch_id"], name, "restore", None, None)


def as_lineage(events: DataFrame) -> list[tuple[int, int | None, int | None]]:
    """The catalog as ``folds.lineage`` takes it; a row for each branch."""
    return [(r["branch_id"], r["parent"], r["fork_seq"]) for r in listed(events, discarded=True).collect()]
