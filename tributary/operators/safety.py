"""Rules for schema changes and writes as column expressions and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.values import WIDENS

GATES = ("auto_apply", "confirm", "shadow_validate")


@dataclass(frozen=True)
class Policy:
    """Thresholds in rows; ``shadow`` is capped, a policy can only tighten it."""

    rows: int
    shadow: int
    ceiling: int
    window_ms: int = 60_000
    ambiguous_is_safe: bool = False


# The two published policies, the cap of the shadow threshold and lifetimes in ms.
PROTECTED = Policy(rows=1_000, shadow=100, ceiling=100_000)
DEVELOPMENT = Policy(rows=50_000, shadow=10_000, ceiling=250_000)
SHADOW_CAP = 10_000
SHADOW_TTL_MS, PROPOSAL_TTL_MS, DAY_MS = 86_400_000, 14_400_000, 86_400_000
# Review costs by gate and ceilings by scope for a day; query spend ceilings in ms.
REVIEW_COST = {"auto_apply": 0, "confirm": 1, "shadow_validate": 5}
REVIEW_CEILING = {"project": 60, "branch": 40, "agent": 20}
SPEND_CEILING = {"query": 10_000, "agent": 3_600_000, "project": 28_800_000}

ADDITIVE = ("add_table", "add_column", "add_index", "set_crdt")


def _widening() -> Column:
    pairs = F.concat_ws(">", "from_type", "to_type")
    return (F.col("from_type") == F.col("to_type")) | (F.col("from_type") == "Null") | pairs.isin(*(f"{a}>{b}" for a, b in sorted(WIDENS)))


def severity() -> Column:
    """safe, ambiguous or destructive, from change, from_type, to_type, nullable and backfill."""
    c = F.col("change")
    return (
        F.when(c.isin(*ADDITIVE), "safe")
        .when(c.isin("drop_table", "drop_column"), "destructive")
        .when(c.isin("drop_index", "rename_column"), "ambiguous")
        .when(c == "alter_column_type", F.when(_widening(), "safe").otherwise("destructive"))
        .when(c == "set_nullable", F.when(F.col("nullable"), "safe").when(F.col("backfill").isNotNull(), "ambiguous").otherwise("destructive"))
    )


def reversible() -> Column:
    c = F.col("change")
    return F.when(c == "set_nullable", F.col("nullable")).when(c == "alter_column_type", _widening()).otherwise(~c.isin("drop_table", "drop_column"))


def classify(changes: DataFrame, policy: Policy) -> DataFrame:
    """Adds severity, reversible, destructive and gate to a table of proposed changes (with rows_affected and protected)."""
    tight = {k: F.when(F.col("protected"), min(getattr(policy, k), getattr(PROTECTED, k))).otherwise(getattr(policy, k)) for k in ("rows", "shadow")}
    shadow = F.least(tight["shadow"], F.lit(SHADOW_CAP))
    out = changes.withColumn("severity", severity()).withColumn("reversible", reversible())
    destructive = F.col("severity") == "destructive" if policy.ambiguous_is_safe else F.col("severity") != "safe"
    out = out.withColumn("destructive", destructive)
    strict = F.col("destructive") & ~F.col("reversible") & (F.col("rows_affected") > shadow)
    gate = F.when(strict, "shadow_validate").when(F.col("destructive") | (F.col("rows_affected") > tight["rows"]), "confirm").otherwise("auto_apply")
    return out.withColumn("gate", gate)


def strictness(gate: str = "gate") -> Column:
    return F.array_position(F.array(*map(F.lit, GATES)), F.col(gate)).cast("long") - 1


def rationale() -> Column:
    """The rule that decided the gate and its remedy, from the same facts."""
    return (
        F.when(F.col("gate") == "shadow_validate", F.format_string("irreversible over %d rows: validate on a shadow branch", "rows_affected"))
        .when(F.col("destructive"), F.concat(F.lit("a "), "severity", F.lit(" change: confirm it")))
        .when(F.col("gate") == "confirm", F.format_string("touches %d rows: confirm it", "rows_affected"))
        .otherwise(F.lit("additive and small: applied"))
    )


def in_slices(rows: DataFrame, at: str, width: int) -> DataFrame:
    """Each row in the slice of its time and, with __later = 1, in the next: a window of ``width`` back from any row lies in the row's own slice, whatever the size of its scope."""
    own = F.floor(F.col(at) / width)
    slices = F.when(own.isNull(), F.array(own)).otherwise(F.array(own, own + 1))  # rows without a time meet once
    return rows.select("*", F.posexplode(slices).alias("__later", "__slice"))


def window_totals(writes: DataFrame, policy: Policy, scope: str, at: str, rows: str, seq: str) -> DataFrame:
    """Adds __rows: rows of the scope in the window up to each write, in arrival order.

    A sample has left when its time plus the window is at or before now. Running
    totals by arrival order less the total at the last sample that has left make
    the window sum, so equal times do not count later writes. Times do not fall
    with seq within a scope.
    """
    w = Window.partitionBy(scope, "__slice")
    totals = in_slices(writes, at, policy.window_ms).withColumn("__run", F.sum(rows).over(w.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
    gone = F.max("__run").over(w.orderBy(at).rangeBetween(Window.unboundedPreceding, -policy.window_ms))
    return totals.withColumn("__rows", F.col("__run") - F.coalesce(gone, F.lit(0))).where("__later = 0").drop("__later", "__slice", "__run")


def trips(writes: DataFrame, policy: Policy, scope: str = "scope", at: str = "at_ms", rows: str = "rows", seq: str = "seq") -> DataFrame:
    """First write over the ceiling of each scope: (scope, seq)."""
    totals = window_totals(writes, policy, scope, at, rows, seq)
    return totals.where(F.col("__rows") > policy.ceiling).groupBy(scope).agg(F.min(seq).alias(seq))


def breaker(writes: DataFrame, policy: Policy, scope: str = "scope", at: str = "at_ms", rows: str = "rows", seq: str = "seq") -> DataFrame:
    """Adds window_rows (rows of the scope in the window up to this write, in arrival order) and tripped, which latches.

    The write that trips is counted; those after it are refused and the window is
    empty (0). The first trip of each scope, one row, joins back to the writes.
    """
    totals = window_totals(writes, policy, scope, at, rows, seq)
    first = totals.where(F.col("__rows") > policy.ceiling).groupBy(scope).agg(F.min(seq).alias("__trip"))
    out = totals.join(first, scope, "left")
    tripped = F.coalesce(F.col(seq) >= F.col("__trip"), F.lit(False))
    after = F.coalesce(F.col(seq) > F.col("__trip"), F.lit(False))
    return out.withColumn("window_rows", F.when(after, F.lit(0)).otherwise(F.col("__rows"))).withColumn("tripped", tripped).drop("__rows", "__trip")


def rolling_spend(events: DataFrame, ceiling: int, scope: str = "scope", at: str = "at_ms", cost: str = "cost", window_ms: int = DAY_MS) -> DataFrame:
    """Adds spent (the scope's cost within the window before and at each event) and over. Review budgets and query spend are both this.

    Whole costs are the total up to an event less the total up to the last one that
    has left: both frames only grow, so each row is added once, however many share
    a window. Fractions, which a difference would round, are added window by window.
    Events without a time count with each other.
    """
    w = Window.partitionBy(scope, "__slice").orderBy(at)
    now, left = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -window_ms)
    within = lambda f: f.over(now) - F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.coalesce(f.over(left), F.lit(0)))
    spent = F.sum(cost).over(w.rangeBetween(-(window_ms - 1), 0))
    if isinstance(events.schema[cost].dataType, T.IntegralType | T.DecimalType):
        spent = F.when(within(F.count(cost)) > 0, within(F.sum(cost)))
    out = in_slices(events, at, window_ms).withColumn("spent", spent).where("__later = 0").drop("__later", "__slice")
    return out.withColumn("over", F.col("spent") > ceiling)


def review_holds(proposals: DataFrame, now_ms: int) -> DataFrame:
    """State of each proposal at a time: settled, expired or held, and the cost that still counts. proposals: proposed_ms, settled_ms, gate."""
    cost = F.create_map(*(F.lit(x) for p in REVIEW_COST.items() for x in p))[F.col("gate")]
    state = F.when(F.col("settled_ms") <= now_ms, "settled").when(F.col("proposed_ms") + PROPOSAL_TTL_MS <= now_ms, "expired").otherwise("held")
    out = proposals.where(F.col("proposed_ms") <= now_ms).withColumn("state", state)
    counts = (F.col("state") != "expired") & (F.col("proposed_ms") + DAY_MS > now_ms)
    return out.withColumn("cost", F.when(counts, cost).otherwise(0))


def triage(pending: DataFrame) -> DataFrame:
    """One batch for each table: the strictest gate, rows in all, the cost of the strictest and of all, strictest and largest first."""
    cost = F.create_map(*(F.lit(x) for p in REVIEW_COST.items() for x in p))[F.col("gate")]
    ranked = pending.withColumn("__s", strictness()).withColumn("__c", cost)
    out = ranked.groupBy("table").agg(
        F.max("__s").alias("strictness"), F.sum("rows_affected").alias("rows_affected"), F.count("*").alias("changes"), F.max("__c").alias("cost"), F.sum("__c").alias("cost_unbatched")
    )
    return out.orderBy(F.desc("strictness"), F.desc("rows_affected"), "table")


def replay(decisions: DataFrame, policy: Policy) -> DataFrame:
    """How recorded decisions (with their gate) come out under a policy: counts of same, stricter, looser."""
    again = classify(decisions.withColumnRenamed("gate", "recorded"), policy)
    moved = strictness() - strictness("recorded")
    return again.groupBy(F.when(moved > 0, "stricter").when(moved < 0, "looser").otherwise("same").alias("divergence")).agg(F.count("*").alias("n"))


def claim(df: DataFrame, violates: Column, key: str = "_key") -> DataFrame:
    """Whether no row violates: rows examined, violations, and the first violating key."""
    bad = F.coalesce(violates, F.lit(False))
    return df.agg(F.count("*").alias("examined"), F.count(F.when(bad, 1)).alias("violations"), F.min(F.when(bad, F.col(key))).alias("first_key")).withColumn("holds", F.col("violations") == 0)


def unique_violations(rows: DataFrame, columns: list[str], key: str = "_key") -> DataFrame:
    """Values that several keys hold, with their number (_holders) and first key (_first). A row with a missing column is exempt."""
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in columns))
    return whole.groupBy(*columns).agg(F.count("*").alias("_holders"), F.min(key).alias("_first")).where("_holders > 1")


def lifecycle(held: DataFrame, decisions: DataFrame, now_ms: int) -> DataFrame:
    """State of each proposal: applied, rejected, promoted, expired or pending. held: id, gate, proposed_ms; decisions: id, decision, at_ms."""
    last = decisions.where(F.col("at_ms") <= now_ms).groupBy("id").agg(F.min_by("decision", "at_ms").alias("decision"))
    ttl = F.when(F.col("gate") == "shadow_validate", SHADOW_TTL_MS).otherwise(PROPOSAL_TTL_MS)
    state = F.when(F.col("gate") == "auto_apply", "applied").when(F.col("decision").isNotNull(), F.col("decision")).when(F.col("proposed_ms") + ttl <= now_ms, "expired").otherwise("pending")
    return held.join(last, "id", "left").withColumn("state", state).drop("decision")


def reserve(held: DataFrame, cost: int, scope: str, now_ms: int) -> tuple[bool, int]:
    """Whether a proposal of this cost still fits in a scope's review budget of a day, and what is used. held: as in ``review_holds``."""
    used = review_holds(held, now_ms).agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    return used + cost <= REVIEW_CEILING[scope], used


def refused_writes(proposed: DataFrame, current: DataFrame, declared: DataFrame, unique: list[str], kinds: dict[str, Column], policy: Policy | None = None) -> DataFrame:
    """(key, rule, detail) for each rule that a proposed batch would break: nothing is written while there are rows.

    proposed and current: key and columns. ``kinds`` gives the kind of each declared
    column's values; ``declared`` is (table, column, type). Types are checked in the
    scan, uniqueness by one grouping over the rows after the write, the breaker on
    the batch's number of rows.
    """
    from tributary.operators.folds import type_violations

    fields = proposed.select("key", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), k.alias("kind")) for c, k in kinds.items()))))
    out = type_violations(fields, declared).select("key", F.lit("type").alias("rule"), F.concat_ws(" ", "column", "kind", "type").alias("detail"))
    if unique:
        after = current.join(proposed.select("key"), "key", "left_anti").select("key", *unique).withColumn("new", F.lit(False)).unionByName(proposed.select("key", *unique).withColumn("new", F.lit(True)))
        taken = unique_violations(after.where("new").unionByName(after.where("not new")), unique, "key").select(*unique, F.col("_first").alias("holder"))
        clash = proposed.join(taken, unique).select("key", F.lit("unique").alias("rule"), F.concat(F.lit("also held by or beside "), "holder").alias("detail"))
        out = out.unionByName(clash)
    if policy is not None:
        n = proposed.agg(F.count("*").alias("n")).where(F.col("n") > policy.ceiling)
        out = out.unionByName(n.select(F.lit(None).cast("string").alias("key"), F.lit("breaker").alias("rule"), F.format_string("%d rows", "n").alias("detail")))
    return out
