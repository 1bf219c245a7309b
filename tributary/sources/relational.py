"""A relational database as a source: partitioned JDBC reads with mapped types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.migration import ImportPlan, parsed, plan_import, row_key
from tributary.operators.relational import KEY


def read_table(spark: SparkSession, url: str, plan: ImportPlan, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table over JDBC, cut by its first key column where that has numeric bounds. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", plan.table).options(**options)
    if bounds:
        reader = reader.options(partitionColumn=plan.key[0], lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def imported(rows: DataFrame, plan: ImportPlan) -> DataFrame:
    """Keyed rows of the plan's kinds, from columns given as text."""
    if plan.blocked:
        raise ValueError(plan.blocked)
    return rows.select(row_key(*plan.key).alias(KEY), *(parsed(F.col(c).cast("string"), m.kind).alias(c) for c, m in plan.columns.items()))


def as_puts(rows: DataFrame, table: str) -> DataFrame:
    """op, key and value for the log store's bulk append."""
    value = F.to_json(F.struct(*(c for c in rows.columns if c != KEY)))
    return rows.select(F.lit("put").alias("op"), F.concat_ws(":", F.lit(table), F.col(KEY)).alias("key"), value.alias("value"))


# The columns of the standard information schema that describe tables and primary keys.
COLUMNS_SQL = "(SELECT table_name, column_name, udt_name, ordinal_position FROM information_schema.columns WHERE table_schema = '{schema}') c"
KEYS_SQL = (
    "(SELECT k.table_name, k.column_name, k.ordinal_position FROM information_schema.key_column_usage k JOIN information_schema.table_constraints t "
    "ON t.constraint_name = k.constraint_name AND t.table_schema = k.table_schema WHERE t.constraint_type = 'PRIMARY KEY' AND k.table_schema = '{schema}') k"
)


def reflect(spark: SparkSession, url: str, schema: str = "public", **options: str) -> list[ImportPlan]:
    """An import plan for each table of a database, from its information schema over JDBC."""
    read = lambda sql: spark.read.format("jdbc").option("url", url).option("dbtable", sql.format(schema=schema)).options(**options).load()
    return plans_of(read(COLUMNS_SQL), read(KEYS_SQL))


def plans_of(columns: DataFrame, keys: DataFrame) -> list[ImportPlan]:
    """Plans from (table_name, column_name, udt_name, ordinal_position) and (table_name, column_name, ordinal_position); a row for each column of a schema."""
    kinds: dict[str, dict[str, str]] = {}
    for r in columns.orderBy("table_name", "ordinal_position").collect():
        kinds.setdefault(r["table_name"], {})[r["column_name"]] = r["udt_name"]
    primary: dict[str, list[str]] = {}
    for r in keys.orderBy("table_name", "ordinal_position").collect():
        primary.setdefault(r["table_name"], []).append(r["column_name"])
    return [plan_import(t, c, primary.get(t, [])) for t, c in kinds.items()]
