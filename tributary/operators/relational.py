"""Scan, lookup, filter, project, sort, limit and aggregate over keyed tables.

A keyed table is a frame with the column ``_key``. All of these are plain DataFrame
calls; what they add is the engine's rules: rows in key order under a limit, nulls
last, ties by key, unknown columns null, and group columns before aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.aggregates import Aggregate
from tributary.functions.predicates import Predicate, all_of, is_null

KEY = "_key"


def scan(df: DataFrame, key: str | Column) -> DataFrame:
    """Exposes a column as the key; the other columns stay, in name order. 32-bit integers widen to 64."""
    named = df.withColumn(KEY, F.col(key) if isinstance(key, str) else key)
    kinds = dict(named.dtypes)
    wide = [F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in [KEY, *sorted(df.columns)]]
    return named.select(*wide)


def lookup(df: DataFrame, key) -> DataFrame:
    """No or one row by key: a pushed-down equality."""
    return df.where(F.col(KEY) == F.lit(key))


def where(df: DataFrame, *terms: Predicate) -> DataFrame:
    return df.where(all_of(*terms).keep(df))


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Columns by name and order; unknown ones are null text."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def order(df: DataFrame, *by: tuple[str, bool] | str) -> list[Column]:
    """Sort columns: missing is greater than any value, the key breaks ties. ``(name, True)`` is descending."""
    named = [(b, False) if isinstance(b, str) else b for b in by]
    out = [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in named if c in df.columns]
    return [*out, F.col(KEY).asc()] if KEY in df.columns else out


def sort(df: DataFrame, *by: tuple[str, bool] | str) -> DataFrame:
    return df.orderBy(*order(df, *by))


def page(df: DataFrame, count: int, offset: int = 0, by: tuple = ()) -> DataFrame:
    """Rows offset to offset + count in the given order, else in key order: one top-k, no full sort."""
    ordered = df.orderBy(*order(df, *by)) if by or KEY in df.columns else df
    return (ordered.offset(offset) if offset else ordered).limit(count)


def aggregate(df: DataFrame, group_by: list[str], aggregates: list[Aggregate], having: Predicate | None = None) -> DataFrame:
    """Group columns first, then aggregates. Without groups one row, even of an empty input."""
    known = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in group_by]
    out = df.groupBy(*known).agg(*(a.expression(df) for a in aggregates)) if aggregates else df.select(*known).distinct()
    return out if having is None else where(out, having)


def missing(column: str) -> Predicate:
    return is_null(column)


def preview(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """The first n rows in key order and whether there are more; reads n + 1."""
    return page(df, n), page(df, n + 1).count() > n
