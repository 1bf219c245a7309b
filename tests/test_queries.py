"""Every registered query against its SQL, on small data."""

import os

import duckdb
import pytest

from tributary import queries as Q
from tributary.functions import aggregates as A
from tributary.operators import joins
from tributary.plans.query import Param, Query, from_dict, table
from tributary.sources.catalog import Catalog

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in at) for r in data)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n in Q.SQL])
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    want = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.fixture(scope="module")
def shop(spark):
    c = Catalog(spark)
    c.register("invoices", spark.createDataFrame([("inv-3", "u99", 100), ("inv-1", "u14", 500), ("inv-2", "u15", 750), ("inv-4", None, 1)], "id string, unit string, amount long"), "id")
    c.register("units", spark.createDataFrame([("u14", "Acme", 1), ("u15", "Borden", 2)], "id string, tenant string, amount long"), "id")
    return c


def test_point_join(shop):
    out = joins.equal(shop.table("invoices"), shop.table("units"), "unit").orderBy("_key").collect()
    assert [(r["_key"], r["tenant"], r["amount"]) for r in out] == [("inv-1", "Acme", 1), ("inv-2", "Borden", 2)]
    assert joins.equal(shop.table("invoices"), shop.table("units"), "amount").count() == 0  # types differ
    assert joins.equal(shop.table("invoices"), shop.table("units"), "no_such").count() == 0


def test_lateral_aggregate_counts_zero(shop):
    out = joins.aggregated(shop.table("invoices"), shop.table("units").withColumnRenamed("_key", "k"), "unit", "k", [A.count(), A.total("amount"), A.greatest("amount")])
    assert {r["_key"]: (r["count"], r["sum_amount"], r["max_amount"]) for r in out.collect()} == {"inv-1": (1, 1, 1), "inv-2": (1, 2, 2), "inv-3": (0, 0, None), "inv-4": (0, 0, None)}


def test_query_builder(shop):
    assert table("nowhere").run(shop).count() == 0
    q = table("invoices").limit(1).filter(("amount", "gte", Param("a", int))).order_by_desc("amount").offset(1).select("_key")
    assert [r[0] for r in q.run(shop, a=100).collect()] == ["inv-1"]
    assert [p.name for p in q.params()] == ["a"]
    with pytest.raises(KeyError):
        q.run(shop)
    with pytest.raises(TypeError):
        q.run(shop, a="100")
    assert isinstance(from_dict({"table": "invoices"}), Query)
    for bad in ({"table": "a b"}, {"table": "t", "limit": -1}, {"table": "t", "filter": {"op": "eq", "column": "x;", "value": 1}}):
        with pytest.raises(ValueError):
            from_dict(bad)


def test_saturating_sum_of_products_beyond_64_bits(spark, tmp_path):
    """Keys from 92234 on, whose product alone passes 64 bits; the other sum stays exact inside them."""
    duckdb.sql(f"copy (select * replace (case when o_orderkey % 3 = 0 then o_orderkey * 100000 when o_orderkey % 3 = 1 then -o_orderkey * 100000 else 0 end as o_orderkey, case o_orderkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end as o_orderstatus) from '{DATA}/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = {tuple(r) for r in Q.QUERIES["agg_sum_saturating"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(Q.SQL["agg_sum_saturating"]).fetchall()) == {("A", 2**63 - 1), ("B", -(2**63)), ("C", 0)}
