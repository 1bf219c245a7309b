"""Importing relational tables: type mapping, text values, and checking a copy cell by cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relational type names, the value kind of each, and whether the mapping loses something.
TYPES = {
    "bool": ("Bool", False), "int2": ("Int", False), "int4": ("Int", False), "int8": ("Int", False), "float4": ("Float", False), "float8": ("Float", False),
    "numeric": ("Float", True), "decimal": ("Float", True), "text": ("Text", False), "varchar": ("Text", False), "char": ("Text", False), "bpchar": ("Text", False),
    "name": ("Text", False), "citext": ("Text", False), "uuid": ("Text", False), "bytea": ("Bytes", False), "timestamptz": ("Timestamp", False), "timestamp": ("Timestamp", True),
    "date": ("Timestamp", True), "time": ("Text", True), "timetz": ("Text", True), "interval": ("Text", True), "json": ("Map", False), "jsonb": ("Map", False),
}
# Spellings of booleans in text, and the separator of composite keys.
TRUE_TEXT, FALSE_TEXT = ("t", "true", "TRUE", "yes", "on", "1"), ("f", "false", "FALSE", "no", "off", "0")
KEY_SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Mapping:
    kind: str
    lossy: bool


def map_type(name: str) -> Mapping:
    """Arrays (a leading underscore) are lists; unknown types come over as text, with loss."""
    if name in TYPES:
        return Mapping(*TYPES[name])
    return Mapping("List", False) if name.startswith("_") else Mapping("Text", True)


@dataclass(frozen=True)
class ImportPlan:
    """Columns with their kinds; ``blocked`` says why a table cannot come over (no primary key)."""

    table: str
    key: tuple[str, ...]
    columns: dict[str, Mapping]
    blocked: str | None = None


def plan_import(table: str, columns: dict[str, str], primary_key: list[str]) -> ImportPlan:
    mapped = {c: map_type(t) for c, t in columns.items()}
    return ImportPlan(table, tuple(primary_key), mapped, None if primary_key else f"{table} has no primary key")


def row_key(*columns: str) -> Column:
    """Primary key as text; composite keys join with a separator."""
    return F.concat_ws(KEY_SEPARATOR, *(F.col(c).cast("string") for c in columns))


def parsed(c: Column, kind: str) -> Column:
    """The value that a text cell stands for; null where it does not parse (see ``unparseable``)."""
    if kind == "Bool":
        return F.when(c.isin(*TRUE_TEXT), True).when(c.isin(*FALSE_TEXT), False)
    if kind == "Int":
        return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    if kind == "Float":
        return c.try_cast("double")
    if kind == "Bytes":
        return F.when(c.rlike(r"^\\x(?:[0-9a-fA-F]{2})*$"), F.unhex(F.substring(c, F.lit(3), F.length(c))))
    if kind == "Timestamp":
        bare = F.regexp_replace(F.trim(c), r"(:\d{2}(?:\.\d+)?)(?:[+-]\d{2}(?::?\d{2})?|Z)$", "$1")
        return F.unix_millis(F.try_to_timestamp(bare))
    if kind == "Map":
        return F.when(F.try_parse_json(c).isNotNull(), c)
    return c


def unparseable(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, bad, example) of text columns with cells that do not parse."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), (F.col(c).isNotNull() & parsed(F.col(c), k).isNull()).alias("bad")) for c, k in kinds.items()]
    return df.select(F.explode(F.array(*cells)).alias("c")).where("c.bad").groupBy("c.column").agg(F.count("*").alias("bad"), F.min(F.substring("c.v", 1, 120)).alias("example"))


def verify(source: DataFrame, copy: DataFrame, key: str, lossy: frozenset[str] = frozenset()) -> DataFrame:
    """Differences of a copy: (key, column, source, copy, finding).

    Finding: missing_row, extra_row, expected (a column whose mapping loses
    something) or unexpected. Null and absent are the same. One shuffle by key.
    """
    columns = [c for c in source.columns if c != key]
    s = source.select(F.col(key).cast("string").alias("key"), *(F.col(c).cast("string").alias(f"s_{c}") for c in columns), F.lit(True).alias("in_s"))
    t = copy.select(F.col(key).cast("string").alias("key"), *((F.col(c) if c in copy.columns else F.lit(None)).cast("string").alias(f"t_{c}") for c in columns), F.lit(True).alias("in_t"))
    both = s.join(t, "key", "full")
    row = F.struct(F.lit("").alias("column"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("copy"), F.when(F.col("in_t").isNull(), "missing_row").when(F.col("in_s").isNull(), "extra_row").alias("finding"))
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("source"), F.col(f"t_{c}").alias("copy"), F.when(F.col("in_s") & F.col("in_t") & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), "expected" if c in lossy else "unexpected").alias("finding"))
        for c in columns
    ]
    return both.select("key", F.inline(F.array(row, *cells))).where("finding is not null")


def verify_counts(source: DataFrame, copy: DataFrame) -> DataFrame:
    return source.agg(F.count("*").alias("source_rows")).crossJoin(copy.agg(F.count("*").alias("copy_rows")))  # one row each


#: Slices that a manifest is cut into where each must know what those before it reach.
SLICES = 4096


def manifest_gaps(segments: DataFrame) -> DataFrame:
    """Runs of sequence numbers that no archived segment covers: (gap_from, gap_to). segments: first_seq, last_seq.

    The running reach is taken inside slices of equal width; what the slices before
    reach comes from a table of SLICES rows at most.
    """
    span = segments.agg(F.min("first_seq").alias("low"), F.max("first_seq").alias("high")).first()
    if span["low"] is None:
        return segments.select(F.col("first_seq").alias("gap_from"), F.col("last_seq").alias("gap_to")).where("false")
    width = max(1, -(-(span["high"] - span["low"] + 1) // SLICES))
    sliced = segments.withColumn("slice", F.floor((F.col("first_seq") - span["low"]) / width))
    own = F.max("last_seq").over(Window.partitionBy("slice").orderBy("first_seq").rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sliced.groupBy("slice").agg(F.max("last_seq").alias("last")).select("slice", F.max("last").over(earlier).alias("carried"))
    reach = sliced.withColumn("own", own).join(carried, "slice").withColumn("reach", F.greatest("own", "carried"))  # greatest skips nulls
    return reach.where(F.col("first_seq") > F.col("reach") + 1).select((F.col("reach") + 1).alias("gap_from"), (F.col("first_seq") - 1).alias("gap_to"))


def expired(segments: DataFrame, before_ms: int) -> DataFrame:
    """Segments that retention may drop: a run of old ones from the start, never the last one."""
    stop = segments.agg(F.min(F.when(F.col("archived_ms") >= before_ms, F.col("first_seq"))).alias("young"), F.max("first_seq").alias("newest"))
    return segments.crossJoin(F.broadcast(stop)).where("first_seq < newest and (young is null or first_seq < young)").drop("young", "newest")  # one row
