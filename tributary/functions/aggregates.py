"""Aggregates with the engine's rules for nulls, empty groups and overflow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.predicates import family

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.function if self.column is None else f"{self.function}_{self.column}")

    def named(self, alias: str) -> Aggregate:
        return Aggregate(self.function, self.column, alias)

    def expression(self, df: DataFrame) -> Column:
        if self.column is None:
            return F.count(F.lit(1)).alias(self.name)
        kind = df.schema[self.column].dataType if self.column in df.columns else T.NullType()
        c = F.col(self.column) if self.column in df.columns else F.lit(None).cast("long")
        return _FUNCTIONS[self.function](c, kind).alias(self.name)


def saturating_sum(c: Column, kind: T.DataType) -> Column:
    """Of nothing, zero. Integers, decimals without places among them, sum exactly and saturate at the ends of 64 bits; other types than numbers are skipped."""
    if family(kind) != "number":
        return F.lit(0).cast("long") + F.count(F.lit(None))
    wide = isinstance(kind, T.DecimalType) and kind.scale == 0
    if wide or isinstance(kind, T.IntegralType):
        low, high = (F.lit(v).cast("decimal(38,0)") for v in (LONG_MIN, LONG_MAX))
        exact = F.coalesce(F.sum(c if wide else c.cast(T.DecimalType(19 if isinstance(kind, T.LongType) else 10, 0))), F.lit(0).cast("decimal(38,0)"))
        return F.least(F.greatest(exact, low), high).cast("long")
    return F.coalesce(F.sum(c), F.lit(0).cast(kind if isinstance(kind, T.DoubleType) else "double"))


def mean(c: Column, kind: T.DataType) -> Column:
    """Sum over the number of non-null values, null for none; values that are no numbers count but add nothing."""
    if family(kind) != "number":
        return F.when(F.count(c) > 0, F.lit(0.0))
    return F.avg(c.cast("double"))


_FUNCTIONS = {
    "count": lambda c, kind: F.count(c),
    "sum": saturating_sum,
    "avg": mean,
    "min": lambda c, kind: F.min(c),
    "max": lambda c, kind: F.max(c),
}


def count() -> Aggregate:
    return Aggregate("count")


def count_of(column: str) -> Aggregate:
    return Aggregate("count", column)


def total(column: str) -> Aggregate:
    return Aggregate("sum", column)


def least(column: str) -> Aggregate:
    return Aggregate("min", column)


def greatest(column: str) -> Aggregate:
    return Aggregate("max", column)


def average(column: str) -> Aggregate:
    return Aggregate("avg", column)
