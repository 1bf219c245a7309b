import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from tributary.functions import aggregates as A
from tributary.functions import predicates as P
from tributary.functions import values as V
from tributary.operators import relational as R

SCHEMA = "_key string, name string, age long, score double, active boolean"
ROWS = [("1", "Alice", 30, 1.5, True), ("2", "Bob", 25, float("nan"), False), ("3", "Carol", 35, 2.5, True), ("4", "Dave", None, None, True)]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def keys(df, *terms):
    return "".join(sorted(r["_key"] for r in R.where(df, *terms).collect()))


@pytest.mark.parametrize(
    ("term", "want"),
    [
        (P.eq("age", 30), "1"), (P.ne("age", 30), "23"), (P.lt("age", 30), "2"), (P.lte("age", 30), "12"), (P.gt("age", 30), "3"), (P.gte("age", 30), "13"),
        (P.not_(P.eq("age", 30)), "234"), (P.not_(P.ne("age", 30)), "14"), (P.not_(P.not_(P.eq("age", 30))), "1"),
        (P.is_in("age", [25, 30.0]), "12"), (P.is_in("age", []), ""), (P.is_in("age", [25, None]), "24"), (P.not_(P.is_in("age", [25])), "134"),
        (P.is_null("age"), "4"), (P.not_(P.is_null("age")), "123"), (P.is_null("unknown"), "1234"), (P.eq("unknown", 1), ""), (P.not_(P.eq("unknown", 1)), "1234"),
        (P.eq("age", None), "4"), (P.ne("age", None), ""), (P.lte("age", None), "4"), (P.gte("age", None), "4"), (P.lt("age", None), ""), (P.eq("unknown", None), ""),
        (P.eq("age", "30"), ""), (P.not_(P.eq("age", "30")), "1234"), (P.eq("name", 1), ""), (P.eq("active", True), "134"), (P.eq("active", 1), ""),
        (P.gt("score", 1), "13"), (P.eq("score", float("nan")), ""), (P.not_(P.gt("score", 1)), "24"), (P.lt("score", 100.0), "13"), (P.eq("age", 30.0), "1"),
        (P.all_of(), "1234"), (P.any_of(), ""), (P.everything(), "1234"), (P.any_of(P.eq("age", 25), P.all_of(P.gt("age", 30), P.eq("active", True))), "23"),
    ],
)
def test_two_valued_logic(users, term, want):
    assert keys(users, term) == want
    assert keys(users, P.not_(term)) == "".join(k for k in "1234" if k not in want)


def test_positive_comparisons_reach_the_scan(spark, users, tmp_path):
    users.write.parquet(str(tmp_path / "u"))
    df = spark.read.parquet(str(tmp_path / "u"))
    plan = R.where(df, P.gt("age", 20), P.lt("score", 9.0)).select("name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,20)" in plan and "LessThan(score,9.0)" in plan


def test_order_and_pages(spark, users):
    assert [r["_key"] for r in R.sort(users, "age").collect()] == ["2", "1", "3", "4"]
    assert [r["_key"] for r in R.sort(users, ("age", True)).collect()] == ["4", "3", "1", "2"]
    assert [r["_key"] for r in R.sort(users, "active").collect()] == ["2", "1", "3", "4"]
    assert [r["_key"] for r in R.page(users, 2, 1).collect()] == ["2", "3"]
    assert R.page(users, 0).count() == 0
    ties = spark.createDataFrame([(k, 1) for k in "cab"], "_key string, n long")
    assert [r["_key"] for r in R.page(ties, 2, by=("n",)).collect()] == ["a", "b"]


def test_projection_of_unknown_columns(users):
    out = R.project(users, "no", "name")
    assert out.dtypes == [("no", "string"), ("name", "string")] and {r["no"] for r in out.collect()} == {None}


def test_aggregates(spark, users):
    aggs = [A.count(), A.count_of("age"), A.total("age"), A.average("age"), A.least("name"), A.greatest("age"), A.total("no"), A.total("name"), A.average("name")]
    r = R.aggregate(users, [], aggs).first().asDict()
    assert r == {"count": 4, "count_age": 3, "sum_age": 90, "avg_age": 30.0, "min_name": "Alice", "max_age": 35, "sum_no": 0, "sum_name": 0, "avg_name": 0.0}
    none = R.aggregate(users.where("false"), [], aggs).first().asDict()
    assert none["count"] == 0 and none["sum_age"] == 0 and none["avg_age"] is None and none["min_name"] is None
    assert R.aggregate(users.where("false"), ["active"], [A.count()]).count() == 0
    top = spark.createDataFrame([("a", 2**63 - 1), ("b", 5), ("c", -(2**63)), ("d", -(2**63))], "_key string, n long")
    sums = {k: R.aggregate(top.where(F.col("_key").isin(*k)), [], [A.total("n")]).first()[0] for k in ("ab", "cd", "abc")}
    assert sums == {"ab": 2**63 - 1, "cd": -(2**63), "abc": 4}
    assert {tuple(r) for r in R.aggregate(users, ["active"], [A.count().named("n")], P.gt("n", 1)).collect()} == {(True, 3)}


def test_tagged_values(spark):
    values = [None, True, 1, 1.0, "x", b"\x00", [1, "a"], {"b": 1, "a": None}]
    assert len({V.encode(v) for v in values}) == len(values)
    assert V.encode({"b": 1, "a": 2}) == V.encode({"a": 2, "b": 1})
    kinds = ["Null", "Bool", "Int", "Float", "Text", "Timestamp"]
    wide = {("Null", k) for k in kinds} | {(k, k) for k in kinds} | {("Int", "Float"), ("Int", "Text"), ("Bool", "Text"), ("Timestamp", "Int")}
    assert {(a, b) for a, b in itertools.product(kinds, kinds) if V.widens(a, b)} == wide
    cells = spark.createDataFrame([("a", V.encode(1)), ("a", V.encode("x")), ("a", V.encode(None)), ("b", V.encode(2)), ("b", V.encode(0.5)), ("c", V.encode(None))], "g string, v string")
    out = {r["g"]: (r["s"], r["m"]) for r in cells.groupBy("g").agg(V.untyped_sum(F.col("v")).alias("s"), V.untyped_mean(F.col("v")).alias("m")).collect()}
    assert out == {"a": (V.encode(1), 0.5), "b": (V.encode(2.5), 1.25), "c": (V.encode(0), None)}
    now = datetime.datetime(2020, 1, 1)
    typed = spark.createDataFrame([(1, 1.0, "x", True, now, None)], "i long, f double, t string, b boolean, ts timestamp, n long")
    got = typed.select(*(V.encoded(F.col(c), typed.schema[c].dataType) for c in typed.columns)).first()
    assert list(got)[:4] == [V.encode(1), V.encode(1.0), V.encode("x"), V.encode(True)] and got[5] == V.encode(None)
