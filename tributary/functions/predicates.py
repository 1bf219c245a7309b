"""Two-valued predicates.

A comparison with a missing value, an operand of another type or NaN is false, and
NOT is plain negation, so ``not_(eq("age", 30))`` keeps rows without an age. A
predicate has two columns: ``keep`` for positive positions, the bare comparison,
which may be null where it is false and so still reaches the Parquet scan; and
``exact``, never null, which NOT negates.
"""

from __future__ import annotations

import datetime
import decimal
import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



@dataclass(frozen=True)
class Predicate:
    """``build(df)`` gives (keep, exact); columns unknown to df are missing in every row."""

    build: Callable[[DataFrame], tuple[Column, Column]]

    def keep(self, df: DataFrame) -> Column:
        return self.build(df)[0]

    def exact(self, df: DataFrame) -> Column:
        return self.build(df)[1]


def family(kind: T.DataType) -> str:
    """Types of one family compare; others never match."""
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return kind.typeName()


def family_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "timestamp"
    return "binary" if isinstance(value, (bytes, bytearray)) else "string"


def _compare(name: str, value: Any, op: Callable[[Any, Any], Column]) -> Predicate:
    def build(df: DataFrame) -> tuple[Column, Column]:
        if name not in df.columns or value is None:
            return F.lit(False), F.lit(False)
        kind = df.schema[name].dataType
        if family(kind) != family_of(value) or value != value:
            return F.lit(False), F.lit(False)
        bare = op(F.col(name), F.lit(value))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            bare = bare & ~F.isnan(name)
        return bare, F.coalesce(bare, F.lit(False))

    return Predicate(build)


def eq(name: str, value: Any) -> Predicate:
    """Equal; with None, rows whose column is an explicit null (a null in a declared column)."""
    return is_null(name, declared=True) if value is None else _compare(name, value, operator.eq)


def ne(name: str, value: Any) -> Predicate:
    return _compare(name, value, operator.ne)


def lt(name: str, value: Any) -> Predicate:
    return _compare(name, value, operator.lt)


def lte(name: str, value: Any) -> Predicate:
    return is_null(name, declared=True) if value is None else _compare(name, value, operator.le)


def gt(name: str, value: Any) -> Predicate:
    return _compare(name, value, operator.gt)


def gte(name: str, value: Any) -> Predicate:
    return is_null(name, declared=True) if value is None else _compare(name, value, operator.ge)


def is_in(name: str, values: list[Any]) -> Predicate:
    """One of the values, each under the rules of eq; an empty list matches nothing."""

    def build(df: DataFrame) -> tuple[Column, Column]:
        if name not in df.columns:
            return F.lit(False), F.lit(False)
        kind = df.schema[name].dataType
        plain = [v for v in values if v is not None and v == v and family(kind) == family_of(v)]
        bare = F.col(name).isin(plain) if plain else F.lit(False)
        if plain and isinstance(kind, (T.DoubleType, T.FloatType)):
            bare = bare & ~F.isnan(name)
        exact = F.coalesce(bare, F.lit(False))
        if None in values:
            bare = exact = exact | F.col(name).isNull()
        return bare, exact

    return Predicate(build)


def is_null(name: str, declared: bool = False) -> Predicate:
    """Missing or null; ``declared``: an unknown column does not match."""

    def build(df: DataFrame) -> tuple[Column, Column]:
        c = F.col(name).isNull() if name in df.columns else F.lit(not declared)
        return c, c

    return Predicate(build)


def everything() -> Predicate:
    return Predicate(lambda df: (F.lit(True), F.lit(True)))


def all_of(*terms: Predicate) -> Predicate:
    """Conjunction; of nothing, true."""
    return Predicate(lambda df: tuple(functools.reduce(operator.and_, (t.build(df)[i] for t in terms), F.lit(True)) for i in (0, 1)))


def any_of(*terms: Predicate) -> Predicate:
    """Disjunction; of nothing, false."""
    return Predicate(lambda df: tuple(functools.reduce(operator.or_, (t.build(df)[i] for t in terms), F.lit(False)) for i in (0, 1)))


def not_(term: Predicate) -> Predicate:
    def build(df: DataFrame) -> tuple[Column, Column]:
        c = ~term.exact(df)
        return c, c

    return Predicate(build)
