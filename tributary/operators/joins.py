"""Joins of keyed tables: inner only, the outer table's key, the inner table's columns winning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.aggregates import Aggregate
from tributary.functions.predicates import family
from tributary.operators.relational import KEY, order


def combined(outer: DataFrame, inner: DataFrame, on: Column, o: DataFrame, i: DataFrame) -> DataFrame:
    """The join's rows: the outer key, then all other columns by name, those of the inner where both have one."""
    joined = o.join(i, on, "inner")
    names = sorted({c for c in (*outer.columns, *inner.columns) if c != KEY})
    return joined.select(F.col(f"o.{KEY}").alias(KEY), *(F.col(f"i.{c}" if c in inner.columns else f"o.{c}").alias(c) for c in names))


def _comparable(outer: DataFrame, column: str, inner: DataFrame, other: str) -> bool:
    return column in outer.columns and other in inner.columns and family(outer.schema[column].dataType) == family(inner.schema[other].dataType)


def equal(outer: DataFrame, inner: DataFrame, column: str, inner_column: str = KEY) -> DataFrame:
    """Rows with equal values; with columns of different types, none. By default a point lookup by the inner key."""
    o, i = outer.alias("o"), inner.alias("i")
    on = F.col(f"o.{column}") == F.col(f"i.{inner_column}") if _comparable(outer, column, inner, inner_column) else F.lit(False)
    return combined(outer, inner, on, o, i)


def within(outer: DataFrame, inner: DataFrame, column: str, low: str, high: str, width: float) -> DataFrame:
    """Outer values in [low, high) of an inner row.

    Both sides are cut into bins of ``width`` and meet on the bin, so the join is by
    equality and spreads; an interval goes to each bin that it touches. Choose
    ``width`` near the usual interval length.
    """
    binned = outer.withColumn("__bin", F.floor(F.col(column) / width))
    spans = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    covered = inner.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(spans))
    o, i = binned.alias("o"), covered.alias("i")
    on = (F.col("o.__bin") == F.col("i.__bin")) & (F.col(f"o.{column}") >= F.col(f"i.{low}")) & (F.col(f"o.{column}") < F.col(f"i.{high}"))
    return combined(outer, inner, on, o, i)


def compared(outer: DataFrame, inner: DataFrame, column: str, op: str, inner_column: str) -> DataFrame:
    """Rows with ``inner_column op column`` for any comparison. The result itself may be quadratic; ``within`` is for bounded ranges."""
    o, i = outer.alias("o"), inner.alias("i")
    a, b = F.col(f"i.{inner_column}"), F.col(f"o.{column}")
    on = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "!=": a != b}[op] if _comparable(outer, column, inner, inner_column) else F.lit(False)
    return combined(outer, inner, on, o, i)


def top_n(outer: DataFrame, inner: DataFrame, column: str, inner_column: str, by: tuple, n: int) -> DataFrame:
    """For each outer row the first n inner rows of its value: ranked once for each value, then joined."""
    rank = F.row_number().over(Window.partitionBy(inner_column).orderBy(*order(inner, *by)))
    first = inner.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    return equal(outer, first, column, inner_column)


def aggregated(outer: DataFrame, inner: DataFrame, column: str, inner_column: str, aggregates: list[Aggregate]) -> DataFrame:
    """For each outer row the aggregates of its inner rows: counts and sums are zero where there are none.

    The inner side is reduced by key before the join.
    """
    per = inner.groupBy(F.col(inner_column).alias("__k")).agg(*(a.expression(inner) for a in aggregates))
    joined = outer.join(per, F.col(column) == F.col("__k"), "left")
    filled = {a.name: F.coalesce(a.name, F.lit(0)) for a in aggregates if a.function in ("count", "sum")}
    return joined.withColumns(filled).select(KEY, *sorted(c for c in outer.columns if c != KEY), *(a.name for a in aggregates))
