"""A fluent query over a table of a catalog, and its plain-dict form.

Sort, limit and filters may come in any order; filters add up; ``aggregate`` takes
the place of a projection. The query lowers straight to a DataFrame, Catalyst does
the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame

from tributary.functions import aggregates as A
from tributary.functions import predicates as P
from tributary.functions.aggregates import Aggregate
from tributary.operators import relational as R
from tributary.sources.catalog import Catalog

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Param:
    """A value given when the query runs; with a type, checked before any row is read."""

    name: str
    kind: type | None = None


@dataclass(frozen=True)
class Query:
    table: str
    terms: tuple = ()
    columns: tuple[str, ...] | None = None
    by: tuple = ()
    count: int | None = None
    skip: int = 0
    groups: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    having: P.Predicate | None = None
    pk: Any = field(default=None)

    def key(self, value: Any) -> Query:
        return replace(self, pk=value)

    def filter(self, *terms) -> Query:
        return replace(self, terms=self.terms + terms)

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def order_by(self, *columns: str) -> Query:
        return replace(self, by=self.by + tuple((c, False) for c in columns))

    def order_by_desc(self, *columns: str) -> Query:
        return replace(self, by=self.by + tuple((c, True) for c in columns))

    def limit(self, n: int) -> Query:
        return replace(self, count=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def aggregate(self, group_by: list[str], *aggregates: Aggregate, having: P.Predicate | None = None) -> Query:
        return replace(self, groups=tuple(group_by), aggregates=aggregates, columns=None, having=having)

    def params(self) -> list[Param]:
        """Parameters of all terms, nested ones included, each name once in the order of its first place."""
        found: dict[str, Param] = {}
        for t in self.terms:
            for p in params_of(t):
                found.setdefault(p.name, p)
        return list(found.values())

    def run(self, catalog: Catalog, **bindings: Any) -> DataFrame:
        for p in self.params():
            if p.name not in bindings:
                raise KeyError(f"parameter ${p.name} is not bound")
            if p.kind is not None and bindings[p.name] is not None and not isinstance(bindings[p.name], p.kind):
                raise TypeError(f"parameter ${p.name} is not a {p.kind.__name__}")
        df = catalog.table(self.table)
        if self.pk is not None:
            df = R.lookup(df, self.pk)
        df = R.where(df, *(bound(t, bindings) for t in self.terms))
        if self.aggregates or self.groups:
            df = R.aggregate(df, list(self.groups), list(self.aggregates), self.having)
        if self.count is not None:
            df = R.page(df, self.count, self.skip, self.by)
        elif self.by or self.skip:
            df = R.sort(df, *self.by)
            df = df.offset(self.skip) if self.skip else df
        return df if self.columns is None else R.project(df, *self.columns)


def table(name: str) -> Query:
    return Query(name)


OPERATORS = {"eq": P.eq, "ne": P.ne, "lt": P.lt, "lte": P.lte, "gt": P.gt, "gte": P.gte, "in": P.is_in}


AGGREGATES = {"count": A.count, "count_of": A.count_of, "sum": A.total, "avg": A.average, "min": A.least, "max": A.greatest}
COMBINED = {"and": P.all_of, "or": P.any_of, "not": P.not_}


def params_of(term) -> list[Param]:
    if isinstance(term, P.Predicate):
        return []
    if term[0] in COMBINED:
        return [p for t in term[1:] for p in params_of(t)]
    return [v for v in (term[2] if isinstance(term[2], list | tuple) else [term[2]]) if isinstance(v, Param)]


def bound(term, bindings: dict[str, Any]) -> P.Predicate:
    """A predicate, (column, operator, value, Param or list of them), or (and | or | not, term, ...)."""
    if isinstance(term, P.Predicate):
        return term
    if term[0] in COMBINED:
        return COMBINED[term[0]](*(bound(t, bindings) for t in term[1:]))
    name, op, value = term

    def given(v: Any) -> Any:
        if isinstance(v, Column):
            raise TypeError(f"{op} on {name} compares with a value, not with a column")
        return bindings[v.name] if isinstance(v, Param) else v

    return OPERATORS[op](name, [given(v) for v in value] if isinstance(value, list | tuple) else given(value))


def from_dict(ast: dict) -> Query:
    """{table, columns, filter, orderBy, limit, offset, groupBy, aggregates}.

    filter is {op, column, value(s)} or {op: and | or | not, terms}; an aggregate is
    {fn: count | count_of | sum | avg | min | max, column, as}.
    """
    names = [ast["table"], *(ast.get("columns") or []), *(o["column"] for o in ast.get("orderBy") or []), *(ast.get("groupBy") or [])]
    names += [a[k] for a in ast.get("aggregates") or [] for k in ("column", "as") if a.get(k)]

    def predicate(f: dict) -> P.Predicate:
        if f["op"] in ("and", "or"):
            return (P.all_of if f["op"] == "and" else P.any_of)(*map(predicate, f["terms"]))
        if f["op"] == "not":
            return P.not_(predicate(f["terms"][0]))
        names.append(f["column"])
        return P.is_null(f["column"]) if f["op"] == "is_null" else OPERATORS[f["op"]](f["column"], f["values"] if f["op"] == "in" else f["value"])

    terms = (predicate(ast["filter"]),) if ast.get("filter") else ()
    for n in names:
        if not NAME.fullmatch(n):
            raise ValueError(f"{n!r} is no identifier")
    if (ast.get("limit") or 0) < 0 or (ast.get("offset") or 0) < 0:
        raise ValueError("limit and offset are not negative")
    by = tuple((o["column"], o.get("direction", "asc") == "desc") for o in ast.get("orderBy") or [])
    query = Query(ast["table"], terms, tuple(ast["columns"]) if ast.get("columns") else None, by, ast.get("limit"), ast.get("offset") or 0)
    if not ast.get("aggregates") and not ast.get("groupBy"):
        return query
    made = [AGGREGATES[a["fn"]](*([a["column"]] if a.get("column") else [])) for a in ast.get("aggregates") or []]
    return query.aggregate(ast.get("groupBy") or [], *(m.named(a["as"]) if a.get("as") else m for m, a in zip(made, ast.get("aggregates") or [])))
