"""Reports over tables, schemas and logs: describe, statistics, provenance, attribution, storage, impact, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.values import spark_kind
from tributary.operators.relational import KEY

# Rows that describe looks at, examples by default and at most.
DESCRIBE_ROWS, EXAMPLES, MAX_EXAMPLES = 1000, 3, 20
# Estimated cost of a schema change, ms and µs for each row.
BASE_COST_MS, ROW_COST_US = 5, 20


def describe(df: DataFrame, examples: int = EXAMPLES, withhold: frozenset[str] = frozenset(), rows: int = DESCRIBE_ROWS) -> DataFrame:
    """A row for each column: type, null fraction in basis points and first distinct examples over the first rows in key order, and the table's rows.

    One top-k read and one aggregate; examples of withheld columns are refused.
    """
    n = min(examples, MAX_EXAMPLES)
    names = [c for c in df.columns if c != KEY]
    ranked = df.orderBy(KEY).limit(rows)
    cells = ranked.select(KEY, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(spark_kind(df.schema[c].dataType)).alias("type"), F.col(c).cast("string").alias("v")) for c in names))).alias("c")).select(KEY, "c.*")
    stats = cells.groupBy("column", "type").agg(F.round(F.avg(F.col("v").isNull().cast("int")) * 10000).cast("long").alias("null_bp"))
    seen = cells.where("v is not null").groupBy("column", "v").agg(F.min(KEY).alias("first"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("first", "v"))  # at most ``rows`` values a column
    shown = seen.withColumn("place", place).where(F.col("place") <= n).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("e"))
    total = df.agg(F.count("*").alias("table_rows"))
    out = stats.join(shown, "column", "left").crossJoin(F.broadcast(total))  # one row
    hidden = F.col("column").isin(*withhold) if withhold else F.lit(False)
    given = F.when(~hidden, F.coalesce(F.transform("e", lambda x: x["v"]), F.array().cast("array<string>")))
    return out.select("column", "type", "null_bp", given.alias("examples"), F.when(hidden, "withheld").alias("refused"), "table_rows")


def statistics(df: DataFrame, *columns: str) -> DataFrame:
    """(column, rows, distinct): exact, with the columns counted in one pass over exploded cells that combine before the shuffle."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("c")).select("c.*")
    per = cells.groupBy("column", "v").agg(F.count("*").alias("n"))
    return per.groupBy("column").agg(F.sum("n").alias("rows"), F.count("v").alias("distinct"))


def schema_provenance(changes: DataFrame) -> DataFrame:
    """Per subject (table, column): when declared, by whom last, whether an agent ever touched it.

    changes: seq, commit_id, change, table, column, author_kind, session_id.
    """
    declares = F.col("change").isin("add_table", "add_column", "alter_column_type")
    return changes.groupBy("table", "column").agg(
        F.max(F.when(declares, F.col("seq"))).alias("declared_seq"),
        F.max_by("author_kind", "seq").alias("last_author"),
        F.bool_or(F.col("author_kind") == "agent").alias("touched_by_agent"),
        F.count("*").alias("changes"),
        F.array_sort(F.collect_set("session_id")).alias("sessions"),
    )


def activity(log: DataFrame, by: str = "author") -> DataFrame:
    """Entries of each author: their number by op, first and last commit and time. An entry seen on several branches counts once if it has entry_hash."""
    rows = log.dropDuplicates(["entry_hash"]) if "entry_hash" in log.columns else log
    ops = [F.count(F.when(F.col("op") == op, 1)).alias(f"{op}s") for op in ("put", "delete")]
    spans = [f(c).alias(f"{n}_{c}") for c in ("commit_id", "timestamp_ms") for f, n in ((F.min, "first"), (F.max, "last"))]
    return rows.groupBy(by).agg(F.count("*").alias("entries"), *ops, *spans)


def sessions(log: DataFrame) -> DataFrame:
    """The same for agent sessions, with their prompts and agents, in the order of their first commit."""
    rows = log.where("author_kind = 'agent'")
    return rows.groupBy("session_id").agg(F.count("*").alias("entries"), F.min("commit_id").alias("first_commit"), F.count_distinct("prompt_hash").alias("prompts"), F.array_sort(F.collect_set("agent")).alias("agents")).orderBy("first_commit")


def storage(states: DataFrame) -> DataFrame:
    """Bytes and rows that each branch alone holds, and under a null branch those that several share. states: branch_id, key, value.

    A row's size is that of its key and its encoded value; parts add up to the total.
    """
    size = F.octet_length("key") + F.octet_length("value")
    held = states.groupBy("key", "value").agg(F.count_distinct("branch_id").alias("holders"), F.min("branch_id").alias("b"))
    owner = F.when(F.col("holders") == 1, F.col("b")).alias("branch_id")
    return held.select(owner, size.cast("long").alias("size")).groupBy("branch_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def impact(df: DataFrame, column: str | None = None, missing: bool = False) -> DataFrame:
    """Rows that a change of a table or column would touch, and its estimated cost in ms."""
    touched = df if column is None else df.where(F.col(column).isNull() if missing else F.col(column).isNotNull())
    n = F.count("*")
    return touched.agg(n.alias("rows_affected"), (F.lit(BASE_COST_MS) + F.floor(n * ROW_COST_US / 1000)).cast("long").alias("cost_ms"))


# Fixed value: a region whose last merge is older is lagging, ms.
LAG_MS = 15 * 60 * 1000


def lagging(regions: DataFrame, now_ms: int) -> DataFrame:
    """Regions whose last merge is too old; one never merged lags most. regions: region, merged_ms."""
    lag = F.when(F.col("merged_ms").isNull(), F.lit(2**63 - 1)).otherwise(now_ms - F.col("merged_ms"))
    return regions.withColumn("lag_ms", lag).where(F.col("lag_ms") > LAG_MS)


def may_serve(versions: DataFrame, floors: DataFrame) -> DataFrame:
    """Per key with a read floor, whether a replica's version reaches it; a key the replica lacks is behind."""
    joined = floors.join(versions.select("key", "version"), "key", "left")
    return joined.withColumn("serve", F.coalesce(F.col("version") >= F.col("floor"), F.lit(False)))


def review(audit: DataFrame, floor: int, limit: int) -> DataFrame:
    """The riskiest recent entries: risk at least floor, by falling risk and time."""
    return audit.where(F.col("risk") >= floor).orderBy(F.desc("risk"), F.desc("timestamp_ms")).limit(limit)
