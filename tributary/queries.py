"""The registered queries over the supplied tables, each beside the SQL that it is compared with."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import aggregates as A
from tributary.functions import predicates as P
from tributary.functions import values as V
from tributary.operators import crdt, folds, inspect, joins, merge, migration, proofs, relational as R, safety
from tributary.plans.query import Param, from_dict, table
from tributary.sources.catalog import parquet_catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def keyed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return parquet_catalog(spark, d).table(name)


def ran(q, spark: SparkSession, d: str, **bindings) -> DataFrame:
    return q.run(parquet_catalog(spark, d), **bindings)


# Scan, projection, lookup, filters ------------------------------------------------------------


@query("SELECT CAST(r_regionkey AS BIGINT) AS _key, r_name, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region")
def scan_region(spark, d):
    return keyed(spark, d, "region")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def project_orders(spark, d):
    return ran(table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), spark, d)


@query("SELECT o_orderkey, CAST(NULL AS VARCHAR) AS no_such FROM orders")
def project_missing_col(spark, d):
    return ran(table("orders").select("o_orderkey", "no_such"), spark, d)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def lookup_customer(spark, d):
    return ran(table("customer").key(42).select("c_custkey", "c_name"), spark, d)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def range_orders(spark, d):
    q = table("orders").filter(P.gte("o_totalprice", 1000), P.lt("o_totalprice", 50000), ("o_orderdate", "gte", Param("since", datetime.datetime)))
    return ran(q.select("o_orderkey"), spark, d, since=datetime.datetime(1995, 1, 1))


for _op, _sql, _make in (
    ("eq", "o_orderstatus = 'F'", lambda: P.eq("o_orderstatus", "F")),
    ("ne", "o_orderstatus <> 'F'", lambda: P.ne("o_orderstatus", "F")),
    ("lt", "o_totalprice < 90000", lambda: P.lt("o_totalprice", 90000)),
    ("lte", "o_custkey <= 700", lambda: P.lte("o_custkey", 700)),
    ("gt", "o_totalprice > 90000", lambda: P.gt("o_totalprice", 90000)),
    ("gte", "o_custkey >= 700", lambda: P.gte("o_custkey", 700)),
    ("in", "o_orderpriority IN ('1-URGENT', '5-LOW')", lambda: P.is_in("o_orderpriority", ["1-URGENT", "5-LOW", None])),
    ("true", "TRUE", lambda: P.everything()),
    ("missing_col", "TRUE", lambda: P.is_null("no_such")),
    ("decimal", "o_totalprice > 90000.5", lambda: P.gt("o_totalprice", decimal.Decimal("90000.5"))),
    ("and_or", "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 50000", lambda: P.all_of(P.any_of(P.eq("o_orderstatus", "F"), P.eq("o_orderstatus", "O")), P.gt("o_totalprice", 50000))),
    ("not", "NOT (o_orderstatus = 'F' OR o_custkey > 700)", lambda: P.not_(P.any_of(P.eq("o_orderstatus", "F"), P.gt("o_custkey", 700)))),
    ("type_mismatch", "FALSE", lambda: P.eq("o_custkey", "700")),
):

    def _filtered(spark, d, make=_make):
        return ran(table("orders").filter(make()).select("o_orderkey"), spark, d)

    QUERIES[f"filter_{_op}"], SQL[f"filter_{_op}"] = _filtered, f"SELECT o_orderkey FROM orders WHERE {_sql}"


def _events_with_nulls(spark, d) -> DataFrame:
    return keyed(spark, d, "events").withColumn("big", F.when(F.col("value") > 100, F.col("value")))


@query("SELECT event_id FROM events WHERE (CASE WHEN value > 100 THEN value END) IS NULL")
def filter_isnull(spark, d):
    return R.where(_events_with_nulls(spark, d), P.is_null("big")).select("event_id")


@query("SELECT event_id FROM events WHERE NOT COALESCE((CASE WHEN value > 100 THEN value END) > 150, FALSE)")
def filter_not_twovalued(spark, d):
    return R.where(_events_with_nulls(spark, d), P.not_(P.gt("big", 150))).select("event_id")


@query("SELECT event_id, CASE WHEN value > 100 THEN value END AS big FROM events ORDER BY big DESC NULLS FIRST, event_id LIMIT 700")
def sort_nulls(spark, d):
    return R.page(_events_with_nulls(spark, d), 700, by=(("big", True),)).select("event_id", "big")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(spark, d):
    return ran(table("orders").order_by_desc("o_totalprice").limit(25).select("o_orderkey", "o_totalprice"), spark, d)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_orders(spark, d):
    return ran(table("orders").limit(20).offset(40).select("o_orderkey"), spark, d)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT (c_acctbal > 0) ORDER BY c_acctbal, c_custkey LIMIT 30")
def ast_query(spark, d):
    ast = {
        "table": "customer", "columns": ["c_custkey", "c_name"], "limit": 30, "orderBy": [{"column": "c_acctbal"}],
        "filter": {"op": "or", "terms": [{"op": "eq", "column": "c_mktsegment", "value": "BUILDING"}, {"op": "not", "terms": [{"op": "gt", "column": "c_acctbal", "value": 0}]}]},
    }
    return ran(from_dict(ast), spark, d)


# Aggregates -----------------------------------------------------------------------------------


@query("SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 10")
def flagship(spark, d):
    q = table("lineitem").filter(("l_shipdate", "gte", Param("since", datetime.datetime)))
    q = q.aggregate(["l_returnflag"], A.count().named("n"), A.total("l_quantity").named("qty")).order_by("l_returnflag").limit(10)
    return ran(q, spark, d, since=datetime.datetime(1994, 1, 1)).withColumn("qty", F.round("qty", 2))


@query("SELECT COUNT(*) AS count, COUNT(o_orderstatus) AS count_o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS sum_o_custkey, ROUND(AVG(o_custkey), 6) AS avg_o_custkey, MIN(o_totalprice) AS min_o_totalprice, MAX(o_totalprice) AS max_o_totalprice FROM orders")
def agg_global(spark, d):
    out = ran(table("orders").aggregate([], A.count(), A.count_of("o_orderstatus"), A.total("o_custkey"), A.average("o_custkey"), A.least("o_totalprice"), A.greatest("o_totalprice")), spark, d)
    return out.withColumn("avg_o_custkey", F.round("avg_o_custkey", 6))


@query("SELECT COUNT(*) AS n, CAST(COALESCE(SUM(o_custkey), 0) AS BIGINT) AS total, AVG(o_custkey) AS mean FROM orders WHERE o_orderkey < 0")
def agg_empty_sum_zero(spark, d):
    return ran(table("orders").filter(P.lt("o_orderkey", 0)).aggregate([], A.count().named("n"), A.total("o_custkey").named("total"), A.average("o_custkey").named("mean")), spark, d)


@query("SELECT o_orderpriority, COUNT(*) AS count, MIN(o_orderkey) AS min_o_orderkey FROM orders GROUP BY 1")
def agg_group(spark, d):
    return ran(table("orders").aggregate(["o_orderpriority"], A.count(), A.least("o_orderkey")), spark, d)


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2")
def agg_group_multi(spark, d):
    return ran(table("lineitem").aggregate(["l_returnflag", "l_linestatus"], A.count().named("n"), A.total("l_suppkey").named("s")), spark, d)


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 15")
def agg_having_filter(spark, d):
    return ran(table("orders").aggregate(["o_custkey"], A.count().named("n"), having=P.gt("n", 15)), spark, d)


@query("SELECT o_orderstatus, CAST(LEAST(GREATEST(SUM(CAST(o_orderkey AS HUGEINT) * 100000000000000), -9223372036854775808), 9223372036854775807) AS BIGINT) AS s FROM orders GROUP BY 1")
def agg_sum_saturating(spark, d):
    # the products pass 64 bits from key 92234 on, as their sum does
    big = keyed(spark, d, "orders").withColumn("v", F.col("o_orderkey").cast("decimal(19,0)") * F.lit(100000000000000).cast("decimal(15,0)"))
    return R.aggregate(big, ["o_orderstatus"], [A.total("v").named("s")])


@query("SELECT event_type, CASE WHEN event_type = 'click' THEN 'Float' ELSE 'Int' END AS kind, CAST(SUM(event_id) AS DOUBLE) AS v FROM events WHERE event_type <> 'error' GROUP BY 1")
def agg_untyped_sum(spark, d):
    e = keyed(spark, d, "events").where("event_type <> 'error'")
    cell = F.when(F.col("event_type") == "click", V.encoded(F.col("event_id").cast("double"), e.schema["value"].dataType)).otherwise(V.encoded(F.col("event_id"), e.schema["event_id"].dataType))
    out = e.groupBy("event_type").agg(V.untyped_sum(cell).alias("s"))
    return out.select("event_type", V.kind(F.col("s")).alias("kind"), V.number(F.col("s")).alias("v"))


# Joins ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_point(spark, d):
    return joins.equal(keyed(spark, d, "orders"), keyed(spark, d, "customer"), "o_custkey").select("o_orderkey", "c_name")


@query("SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def join_filter(spark, d):
    return joins.equal(keyed(spark, d, "nation"), keyed(spark, d, "supplier"), "n_nationkey", "s_nationkey").select("n_name", "s_suppkey")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey < r_regionkey")
def join_theta(spark, d):
    return joins.compared(keyed(spark, d, "region"), keyed(spark, d, "nation"), "r_regionkey", "<", "n_regionkey").select("r_name", "n_name")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal - 5 AND c_acctbal < s_acctbal + 5")
def join_range(spark, d):
    spans = keyed(spark, d, "supplier").withColumns({"low": F.col("s_acctbal") - 5, "high": F.col("s_acctbal") + 5})
    return joins.within(keyed(spark, d, "customer"), spans, "c_acctbal", "low", "high", 10.0).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey WHERE r <= 3")
def join_topn_lateral(spark, d):
    return joins.top_n(keyed(spark, d, "customer"), keyed(spark, d, "orders"), "c_custkey", "o_custkey", (("o_totalprice", True),), 3).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, COUNT(o_orderkey) AS n, CAST(COALESCE(SUM(o_orderkey), 0) AS BIGINT) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_agg_lateral(spark, d):
    aggs = [A.count().named("n"), A.total("o_orderkey").named("s")]
    return joins.aggregated(keyed(spark, d, "customer"), keyed(spark, d, "orders"), "c_custkey", "o_custkey", aggs).select("c_custkey", "n", "s")


@query("SELECT CAST(n_nationkey AS BIGINT) AS _key, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_collision(spark, d):
    nation = keyed(spark, d, "nation").withColumnRenamed("n_name", "name")
    return joins.equal(nation, keyed(spark, d, "region").withColumnRenamed("r_name", "name"), "n_regionkey").select("_key", "name")


# The events table as a log: key u:<user>, an error deletes, other events put their value -----


def events_log(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        F.col("event_id").alias("seq"), F.lit(0).alias("tx_pos"), F.lit(0).cast("long").alias("branch_id"), F.col("event_id").alias("commit_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.concat(F.lit("u:"), F.col("user_id")).alias("key"), "value",
        F.col("user_id").alias("author"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "event_type", "user_id",
    )


LOG_SQL = "WITH log AS (SELECT event_id AS seq, 'u:' || user_id AS key, value, event_type, user_id, (epoch_us(ts) // 1000) AS ms FROM events)"
FOLD_SQL = "SELECT key, arg_max(value, seq) AS value, max(seq) AS version FROM {t} GROUP BY key HAVING arg_max(event_type, seq) <> 'error'"


@query(f"{LOG_SQL} {FOLD_SQL.format(t='log')}")
def fold_latest(spark, d):
    return folds.fold(events_log(spark, d))


@query(f"{LOG_SQL} SELECT COUNT(*) AS live, (SELECT COUNT(DISTINCT key) FROM log) AS seen FROM ({FOLD_SQL.format(t='log')})")
def fold_with_deletes(spark, d):
    log = events_log(spark, d)
    return folds.fold(log).agg(F.count("*").alias("live")).crossJoin(log.agg(F.count_distinct("key").alias("seen")))


@query(f"{LOG_SQL} SELECT key, version FROM ({FOLD_SQL.format(t='log')})")
def row_versions(spark, d):
    return folds.fold(events_log(spark, d)).select("key", "version")


@query(f"{LOG_SQL} {FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= 5000)')}")
def asof_commit(spark, d):
    return folds.as_of(events_log(spark, d), commit=5000)


@query(f"{LOG_SQL} {FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= (SELECT max(seq) FROM log WHERE ms <= (SELECT (min(ms) + max(ms)) // 2 FROM log)))')}")
def asof_timestamp(spark, d):
    log = events_log(spark, d)
    low, high = log.agg(F.min("timestamp_ms"), F.max("timestamp_ms")).first()
    return folds.as_of(log, timestamp_ms=(low + high) // 2)


DIFF_SQL = (
    "SELECT COALESCE(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS change, b.value AS before, a.value AS after "
    "FROM b FULL JOIN a ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value OR a.key IS NULL OR b.key IS NULL"
)


@query(f"{LOG_SQL}, b AS ({FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= 5000)')}), a AS ({FOLD_SQL.format(t='log')}) {DIFF_SQL}")
def row_diff(spark, d):
    return folds.between(events_log(spark, d), F.col("seq") <= 5000, F.lit(True))


@query(f"{LOG_SQL}, b AS ({FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= 3999)')}), a AS ({FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= 4499)')}) {DIFF_SQL}")
def change_feed(spark, d):
    return folds.since(events_log(spark, d), after_commit=3999, limit=500).changes


@query(f"{LOG_SQL} {FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= 5000 OR seq % 2 = 1)')}")
def branch_history(spark, d):
    log = events_log(spark, d).withColumn("branch_id", F.when((F.col("seq") > 5000) & (F.col("seq") % 2 == 1), 1).otherwise(0).cast("long"))
    return folds.fold(folds.history(log, folds.lineage(spark, [(0, None, None), (1, 0, 5000)], 1)))


@query(f"{LOG_SQL} {FOLD_SQL.format(t='(SELECT * FROM log WHERE seq > 6000)')}")
def fold_after_drop(spark, d):
    drops = spark.createDataFrame([("u", 2000), ("u", 6000), ("other", 9000)], "table string, seq long")
    return folds.fold(folds.drop_rows(events_log(spark, d), drops))


# Convergent types: replica = user % 3, key = event type --------------------------------------


def _crdt_ops(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").alias("commit_id"), F.col("event_type").alias("key"), (F.col("user_id") % 3).alias("replica"), F.floor("value").alias("whole"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "value", "user_id", "event_type")


COUNTER_SQL = "SELECT event_type AS key, CAST(SUM(CASE WHEN event_id % 2 = 0 THEN FLOOR(value) ELSE -FLOOR(value) END) AS BIGINT) AS value FROM events GROUP BY 1"


@query(COUNTER_SQL)
def crdt_counter(spark, d):
    ops = _crdt_ops(spark, d).withColumn("amount", F.when(F.col("seq") % 2 == 0, F.col("whole")).otherwise(-F.col("whole")))
    return crdt.counter_value(crdt.counter_state(ops)).select("key", F.col("value").cast("long").alias("value"))


@query(COUNTER_SQL)
def crdt_counter_merge(spark, d):
    """Two copies of one history, one cut short, merge to the whole."""
    ops = _crdt_ops(spark, d).withColumn("amount", F.when(F.col("seq") % 2 == 0, F.col("whole")).otherwise(-F.col("whole")))
    states = crdt.counter_state(ops.where("seq < 4000")), crdt.counter_state(ops)
    return crdt.counter_value(crdt.merge_counters(*states)).select("key", F.col("value").cast("long").alias("value"))


@query("SELECT event_type AS key, arg_max(value, ((epoch_us(ts) // 1000), user_id % 3, event_id)) AS value FROM events GROUP BY 1")
def crdt_lww(spark, d):
    return crdt.register(_crdt_ops(spark, d))


@query(
    "WITH l AS (SELECT user_id % 3 AS lineage, user_id % 100 AS k, event_type AS e, max(event_id) FILTER (event_id % 4 <> 0) AS a, max(event_id) FILTER (event_id % 4 = 0) AS r FROM events GROUP BY 1, 2, 3) "
    "SELECT CAST(k AS VARCHAR) AS key, e AS element FROM l WHERE a IS NOT NULL AND (r IS NULL OR a > r) GROUP BY 1, 2"
)
def crdt_orset(spark, d):
    ops = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 3).alias("lineage"), (F.col("user_id") % 100).cast("string").alias("key"), F.col("event_type").alias("element"), F.col("event_id").alias("seq"))
    found = crdt.observed_set(ops.where("seq % 4 <> 0"), ops.where("seq % 4 = 0"))
    return found.select("key", F.explode("value").alias("element"))


@query("SELECT CAST(conv_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn AS counter, text AS value FROM conversations WHERE turn % 5 <> 3")
def crdt_sequence(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    key, zero = F.col("conv_id").cast("string").alias("key"), F.lit(0).cast("long")
    after = F.when(F.col("turn") > 0, F.col("turn") - 1).alias("after_counter")
    inserts = turns.select(key, F.col("turn").alias("counter"), zero.alias("replica"), after, F.when(F.col("turn") > 0, zero).alias("after_replica"), F.col("text").alias("value"))
    removes = turns.where("turn % 5 = 3").select(key, F.col("turn").alias("counter"), zero.alias("replica"))
    return crdt.sequence(inserts, removes).select("key", F.col("pos"), "counter", "value")


@query(
    "WITH o AS (SELECT 'k' || (event_id % 50) AS key, event_id AS seq, CASE WHEN event_type = 'view' THEN 'counter' WHEN event_type = 'click' THEN 'set' ELSE 'register' END AS kind FROM events) "
    "SELECT COUNT(*) AS rejected FROM o JOIN (SELECT key, arg_min(kind, seq) AS k FROM o GROUP BY key) f ON f.key = o.key WHERE kind <> k"
)
def crdt_rejected(spark, d):
    op = F.when(F.col("event_type") == "view", "increment").when(F.col("event_type") == "click", "set_add").otherwise("set_register")
    ops = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("k"), F.col("event_id") % 50).alias("key"), F.col("event_id").alias("seq"), op.alias("crdt_op"))
    return crdt.split_by_kind(ops)[1].agg(F.count("*").alias("rejected"))


# Merge: events after a cut, odd ones on a branch ---------------------------------------------

SIDES_SQL = (
    "WITH e AS (SELECT event_id AS seq, 'u:' || user_id || ':' || (event_id % 17) AS key, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(FLOOR(value / 50) AS BIGINT) END AS v, "
    "user_id % 10 = 0 OR (user_id % 10 = 1 AND event_id % 2 = 1) AS c FROM events WHERE event_id > (SELECT (MIN(event_id) + MAX(event_id)) // 2 FROM events)), "
    "s AS (SELECT key, BOOL_OR(c) AS c, arg_max(COALESCE(v, -1), seq) AS v FROM e WHERE seq % 2 = 1 GROUP BY key), t AS (SELECT key, BOOL_OR(c) AS c, arg_max(COALESCE(v, -1), seq) AS v FROM e WHERE seq % 2 = 0 GROUP BY key), "
    "m AS (SELECT COALESCE(s.key, t.key) AS key, CASE WHEN t.key IS NULL THEN 'apply' WHEN s.key IS NULL THEN 'keep' WHEN s.c AND t.c THEN 'converge' WHEN s.c OR t.c THEN 'conflict' WHEN s.v = t.v THEN 'same' ELSE 'conflict' END AS verdict FROM s FULL JOIN t ON s.key = t.key) "
)


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """All events after the middle one, odd ones on a branch; users ending in 0 count on both sides, those ending in 1 on the branch only."""
    e = spark.read.parquet(f"{d}/events.parquet")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    counts = (F.col("user_id") % 10 == 0) | ((F.col("user_id") % 10 == 1) & (F.col("event_id") % 2 == 1))
    op = F.when(counts, "crdt").when(F.col("event_type") == "error", "delete").otherwise("put")
    rows = e.where(F.col("event_id") > (low + high) // 2).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u:"), "user_id", F.lit(":"), F.col("event_id") % 17).alias("key"), op.alias("op"), F.floor(F.col("value") / 50).alias("value"), F.when(counts, "counter").alias("crdt_kind")
    )
    return rows.where("seq % 2 = 1"), rows.where("seq % 2 = 0")


@query(SIDES_SQL + "SELECT key, verdict FROM m")
def merge_classify(spark, d):
    source, target = _sides(spark, d)
    return merge.classify(merge.effects(source), merge.effects(target)).select("key", "verdict")


@query(SIDES_SQL + "SELECT key FROM m WHERE verdict = 'conflict'")
def merge_conflicts(spark, d):
    found = merge.merge(*_sides(spark, d))
    return found.conflicts.select("key")


# Reports --------------------------------------------------------------------------------------


@query("SELECT 'c_mktsegment' AS column, COUNT(*) AS rows, COUNT(DISTINCT c_mktsegment) AS distinct FROM customer UNION ALL SELECT 'c_nationkey', COUNT(*), COUNT(DISTINCT c_nationkey) FROM customer".replace("AS column", 'AS "column"').replace("AS rows", 'AS "rows"').replace("AS distinct", 'AS "distinct"'))
def table_stats(spark, d):
    return inspect.statistics(keyed(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query(
    "WITH f AS (SELECT event_id, event_type, CASE WHEN value > 100 THEN 'x' END AS big FROM events ORDER BY event_id LIMIT 1000) "
    "SELECT 'big' AS \"column\", 'Text' AS type, CAST(ROUND(AVG(CASE WHEN big IS NULL THEN 1 ELSE 0 END) * 10000) AS BIGINT) AS null_bp, (SELECT COUNT(*) FROM events) AS table_rows FROM f "
    "UNION ALL SELECT 'event_type', 'Text', CAST(ROUND(AVG(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) * 10000) AS BIGINT), (SELECT COUNT(*) FROM events) FROM f"
)
def describe_columns(spark, d):
    e = keyed(spark, d, "events").select("_key", "event_type", F.when(F.col("value") > 100, "x").alias("big"))
    return inspect.describe(e).select("column", "type", "null_bp", "table_rows")


@query("SELECT user_id AS author, COUNT(*) AS entries, COUNT(*) FILTER (event_type <> 'error') AS puts, COUNT(*) FILTER (event_type = 'error') AS deletes, MIN(event_id) AS first_commit_id, MAX(event_id) AS last_commit_id, (epoch_us(MIN(ts)) // 1000) AS first_timestamp_ms, (epoch_us(MAX(ts)) // 1000) AS last_timestamp_ms FROM events GROUP BY 1")
def activity_by_user(spark, d):
    return inspect.activity(events_log(spark, d))


@query(
    "WITH s AS (SELECT 0 AS b, 'u:' || user_id AS key, CAST(MAX(event_id) AS VARCHAR) AS v FROM events WHERE event_id <= 7000 GROUP BY user_id UNION ALL SELECT 1, 'u:' || user_id, CAST(MAX(event_id) AS VARCHAR) FROM events GROUP BY user_id), "
    "h AS (SELECT key, v, COUNT(DISTINCT b) AS n, MIN(b) AS b FROM s GROUP BY 1, 2) "
    "SELECT CAST(CASE WHEN n = 1 THEN b END AS BIGINT) AS branch_id, CAST(SUM(strlen(key) + strlen(v)) AS BIGINT) AS bytes, COUNT(*) AS rows FROM h GROUP BY 1"
)
def storage_attribution(spark, d):
    log = events_log(spark, d).withColumn("op", F.lit("put")).withColumn("value", F.col("seq").cast("string"))
    states = [folds.fold(log, upto).select(F.lit(b).cast("long").alias("branch_id"), "key", "value") for b, upto in ((0, 7000), (1, None))]
    return inspect.storage(states[0].unionByName(states[1]))


@query("SELECT COUNT(*) AS rows_affected, 5 + COUNT(*) * 20 // 1000 AS cost_ms FROM events WHERE value > 100")
def impact_estimate(spark, d):
    return inspect.impact(_events_with_nulls(spark, d), "big")


CHANGES_SQL = (
    "WITH c AS (SELECT event_id AS id, 't' || (user_id % 20) AS \"table\", CAST(FLOOR(value * 100) AS BIGINT) AS rows_affected, event_id % 3 = 0 AS protected, "
    "CASE event_type WHEN 'signup' THEN 'add_column' WHEN 'click' THEN 'drop_column' WHEN 'error' THEN 'drop_table' WHEN 'view' THEN 'rename_column' ELSE 'set_nullable' END AS change FROM events), "
    "k AS (SELECT *, change IN ('drop_column', 'drop_table', 'set_nullable', 'rename_column') AS destructive, change IN ('add_column', 'rename_column') AS reversible FROM c), "
    "g AS (SELECT *, CASE WHEN destructive AND NOT reversible AND rows_affected > CASE WHEN protected THEN 100 ELSE 10000 END THEN 'shadow_validate' "
    "WHEN destructive OR rows_affected > CASE WHEN protected THEN 1000 ELSE 50000 END THEN 'confirm' ELSE 'auto_apply' END AS gate FROM k) "
)


def _changes(spark, d) -> DataFrame:
    kinds = {"signup": "add_column", "click": "drop_column", "error": "drop_table", "view": "rename_column"}
    change = F.coalesce(F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("event_type")], F.lit("set_nullable"))
    none = F.lit(None).cast("string")
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id") % 20).alias("table"), F.floor(F.col("value") * 100).alias("rows_affected"), (F.col("event_id") % 3 == 0).alias("protected"),
        change.alias("change"), none.alias("from_type"), none.alias("to_type"), F.lit(False).alias("nullable"), none.alias("backfill"),
    )


@query(CHANGES_SQL + "SELECT id, gate, destructive, reversible FROM g")
def classify_changes(spark, d):
    return safety.classify(_changes(spark, d), safety.DEVELOPMENT).select("id", "gate", "destructive", "reversible")


@query(
    CHANGES_SQL + "SELECT \"table\", MAX(CASE gate WHEN 'auto_apply' THEN 0 WHEN 'confirm' THEN 1 ELSE 2 END) AS strictness, CAST(SUM(rows_affected) AS BIGINT) AS rows_affected, COUNT(*) AS changes, "
    "MAX(CASE gate WHEN 'auto_apply' THEN 0 WHEN 'confirm' THEN 1 ELSE 5 END) AS cost, CAST(SUM(CASE gate WHEN 'auto_apply' THEN 0 WHEN 'confirm' THEN 1 ELSE 5 END) AS BIGINT) AS cost_unbatched FROM g GROUP BY 1"
)
def triage_batches(spark, d):
    out = safety.triage(safety.classify(_changes(spark, d), safety.DEVELOPMENT))
    return out.withColumn("strictness", F.col("strictness").cast("int"))


@query(
    CHANGES_SQL + ", r AS (SELECT CASE gate WHEN 'auto_apply' THEN 0 WHEN 'confirm' THEN 1 ELSE 2 END AS o, CASE WHEN destructive AND NOT reversible AND rows_affected > 100 THEN 2 WHEN destructive OR rows_affected > 1000 THEN 1 ELSE 0 END AS n FROM g) "
    "SELECT CASE WHEN n > o THEN 'stricter' WHEN n < o THEN 'looser' ELSE 'same' END AS divergence, COUNT(*) AS n FROM r GROUP BY 1"
)
def replay_decisions(spark, d):
    return safety.replay(safety.classify(_changes(spark, d), safety.DEVELOPMENT), safety.PROTECTED)


BREAKER = safety.Policy(rows=0, shadow=0, ceiling=300, window_ms=600_000)


def _writes(spark, d) -> DataFrame:
    """Arrival in time order; the sequence is the rank by (ts, event_id)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_type").alias("scope"), F.col("event_id").alias("id"), at.alias("at_ms"), F.floor("value").alias("rows"), F.struct(at.alias("a"), F.col("event_id").alias("i")).alias("seq"))


@query(
    "WITH w AS (SELECT event_type AS scope, event_id AS id, (epoch_us(ts) // 1000) AS at_ms, CAST(FLOOR(value) AS BIGINT) AS n FROM events), "
    "r AS (SELECT *, SUM(n) OVER (PARTITION BY scope ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS run FROM w), "
    "g AS (SELECT *, run - COALESCE(MAX(run) OVER (PARTITION BY scope ORDER BY at_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 600000 PRECEDING), 0) AS win FROM r) "
    "SELECT scope, id, CAST(CASE WHEN COALESCE(MAX(CASE WHEN win > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY at_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 0 ELSE win END AS BIGINT) AS window_rows, "
    "MAX(CASE WHEN win > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) = 1 AS tripped FROM g"
)
def breaker_rolling(spark, d):
    return safety.breaker(_writes(spark, d), BREAKER).select("scope", "id", "window_rows", "tripped")


@query("SELECT event_type AS scope, event_id AS id, CAST(SUM(CAST(FLOOR(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS BIGINT) AS spent FROM events")
def spend_rolling(spark, d):
    w = _writes(spark, d).withColumnRenamed("rows", "cost")
    return safety.rolling_spend(w, ceiling=10_000, window_ms=3_600_000).select("scope", "id", "spent")


@query("SELECT COUNT(*) AS examined, COUNT(*) FILTER (o_totalprice < 1000) AS violations, MIN(o_orderkey) FILTER (o_totalprice < 1000) AS first_key, COUNT(*) FILTER (o_totalprice < 1000) = 0 AS holds FROM orders")
def claim_first_violation(spark, d):
    return safety.claim(keyed(spark, d, "orders"), F.col("o_totalprice") < 1000)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def unique_violations(spark, d):
    rows = keyed(spark, d, "lineitem")
    return safety.unique_violations(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("_holders").alias("n"))


@query("WITH c AS (SELECT event_id AS id, CAST(event_id AS VARCHAR) AS h, CASE WHEN event_id = 0 THEN 'start' WHEN event_id % 997 = 0 THEN 'lost' ELSE CAST(event_id - 1 AS VARCHAR) END AS p FROM events) SELECT id FROM c WHERE p <> 'start' AND NOT EXISTS (SELECT 1 FROM c x WHERE x.h = c.p)")
def chain_breaks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    prev = F.when(F.col("event_id") == 0, proofs.ZERO).when(F.col("event_id") % 997 == 0, "lost").otherwise((F.col("event_id") - 1).cast("string"))
    log = e.select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("entry_hash"), prev.alias("prev_hash"))
    return proofs.chain_breaks(log).select("id")


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 100 = 0 THEN '' ELSE 'c_mktsegment' END AS \"column\", CASE WHEN c_custkey % 100 = 0 THEN 'missing_row' ELSE 'unexpected' END AS finding FROM customer WHERE c_custkey % 100 = 0 OR c_custkey % 77 = 0 "
    "UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_acctbal', 'expected' FROM customer WHERE c_custkey % 100 <> 0 AND c_custkey % 50 = 7 UNION ALL SELECT '-1', '', 'extra_row'"
)
def verify_cells(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    altered = c.where("c_custkey % 100 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 77 == 0, "?").otherwise(F.col("c_mktsegment")))
    altered = altered.withColumn("c_acctbal", F.when(F.col("c_custkey") % 50 == 7, F.lit(1e9)).otherwise(F.col("c_acctbal")))
    invented = c.orderBy("c_custkey").limit(1).withColumn("c_custkey", F.lit(-1).cast("long"))
    return migration.verify(c, altered.unionByName(invented), "c_custkey", frozenset({"c_acctbal"})).select("key", "column", "finding")


@query("SELECT event_id AS seq FROM events WHERE event_id % 10 = 3")
def sync_to_send(spark, d):
    log = events_log(spark, d).withColumn("content_hash", proofs.content_hash("op", "key", "value", "timestamp_ms", "seq"))
    return proofs.to_send(log, log.where("seq % 10 <> 3")).select("seq")


@query("SELECT DISTINCT 'u:' || a.user_id AS key FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_id % 10 = 3 AND b.event_id % 10 = 4")
def sync_conflicts(spark, d):
    log = events_log(spark, d).withColumn("content_hash", proofs.content_hash("op", "key", "value", "timestamp_ms", "seq"))
    return proofs.sync_conflicts(log.where("seq % 10 <> 4"), log.where("seq % 10 <> 3"))


#: SQL of a length-prefixed field of a hashed record.
FIELD_SQL = "lpad(to_hex(strlen({0})), 16, '0') || hex({0})"
NODE_SQL = "sha256(unhex('0000000000000004' || hex('{kind}') || " + FIELD_SQL.format("{a}") + " || " + FIELD_SQL.format("{b}") + "))"


@query(
    f"WITH RECURSIVE t(l) AS (SELECT list({NODE_SQL.format(kind='leaf', a='CAST(o_orderkey AS VARCHAR)', b='o_orderstatus')} ORDER BY CAST(o_orderkey AS VARCHAR)) FROM orders UNION ALL "
    f"SELECT list_transform(range(0, (len(l) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(l) THEN {NODE_SQL.format(kind='node', a='l[2 * i + 1]', b='l[2 * i + 2]')} ELSE l[2 * i + 1] END) FROM t WHERE len(l) > 1) "
    "SELECT l[1] AS root FROM t WHERE len(l) = 1"
)
def merkle_root(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    return spark.createDataFrame([(proofs.merkle_root(rows),)], "root string")


def _chain(spark, d) -> DataFrame:
    """Each event as an entry with its hash; every 997th was changed afterwards, every 1009th put in beside another."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.concat(F.lit("u:"), "user_id").alias("key"))
    prev = F.sha2(F.when(F.col("seq") % 1009 == 7, F.col("seq") - 2).otherwise(F.col("seq") - 1).cast("string"), 256)
    log = e.withColumn("branch_id", F.lit(0).cast("long")).withColumn("prev_hash", prev)
    log = log.withColumn("entry_hash", proofs.linked_hash("prev_hash", "op", "key"))
    return log.withColumn("op", F.when(F.col("seq") % 997 == 5, F.concat("op", F.lit("!"))).otherwise(F.col("op")))


@query("SELECT event_id AS seq FROM events WHERE event_id % 997 = 5")
def chain_altered(spark, d):
    return proofs.chain_altered(_chain(spark, d), "op", "key").select("seq")


@query("SELECT COUNT(*) AS forks FROM events a JOIN events b ON b.event_id = a.event_id - 1 WHERE a.event_id % 1009 = 7")
def chain_forks(spark, d):
    return proofs.chain_forks(_chain(spark, d)).agg(F.count("*").alias("forks"))


@query("SELECT event_type AS cell, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n FROM events")
def parse_cells(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return e.select(F.col("event_type").alias("cell"), migration.parsed(text, "Int").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, (event_id % 7) >= 3 AND event_id % 11 <> 0 AS serve FROM events")
def read_floor(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    key = F.col("event_id").cast("string").alias("key")
    have = e.where("event_id % 11 <> 0").select(key, (F.col("event_id") % 7).alias("version"))
    return inspect.may_serve(have, e.select(key, F.lit(3).alias("floor"))).select("key", "serve")


@query("SELECT event_id AS id, value AS risk FROM events WHERE value >= 50 ORDER BY value DESC, ts DESC, event_id LIMIT 40")
def audit_review(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.col("value").alias("risk"), F.col("ts").alias("timestamp_ms"))
    return inspect.review(e, 50, 40).select("id", "risk")


@query(f"{LOG_SQL} {FOLD_SQL.format(t='log')}")
def fold_from_snapshot(spark, d):
    log = events_log(spark, d)
    half = folds.fold(log, 5000).withColumn("seq", F.col("version"))
    return folds.from_snapshot(half, log.where("seq > 5000"))


@query(
    "WITH w AS (SELECT event_type AS scope, event_id AS id, (epoch_us(ts) // 1000) AS at_ms, CAST(FLOOR(value) AS BIGINT) AS n FROM events), "
    "r AS (SELECT *, SUM(n) OVER (PARTITION BY scope ORDER BY at_ms, id ROWS UNBOUNDED PRECEDING) AS run FROM w), "
    "g AS (SELECT *, run - COALESCE(MAX(run) OVER (PARTITION BY scope ORDER BY at_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 600000 PRECEDING), 0) AS win FROM r) "
    "SELECT scope, arg_min(id, (at_ms, id)) AS id FROM g WHERE win > 300 GROUP BY scope"
)
def breaker_trips(spark, d):
    return safety.trips(_writes(spark, d), BREAKER).select("scope", F.col("seq.i").alias("id"))


@query("SELECT 't' || (user_id % 20) AS \"table\", MAX(event_id) FILTER (event_type IN ('signup', 'click')) AS declared_seq, BOOL_OR(event_id % 5 = 0) AS touched_by_agent, COUNT(*) AS changes FROM events GROUP BY 1")
def schema_provenance(spark, d):
    change = F.when(F.col("event_type") == "signup", "add_table").when(F.col("event_type") == "click", "add_column").otherwise("set_nullable")
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("user_id") % 20).alias("table"), F.lit(None).cast("string").alias("column"), change.alias("change"),
        F.when(F.col("event_id") % 5 == 0, "agent").otherwise("human").alias("author_kind"), F.col("user_id").cast("string").alias("session_id"),
    )
    return inspect.schema_provenance(rows).select("table", "declared_seq", "touched_by_agent", "changes")


@query(f"{LOG_SQL}, b AS ({FOLD_SQL.format(t='(SELECT * FROM log WHERE seq <= 9000)')}), a AS ({FOLD_SQL.format(t='log')}), x AS ({DIFF_SQL}) SELECT 'u' AS \"table\", COUNT(*) FILTER (change = 'added') AS added, COUNT(*) FILTER (change = 'changed') AS changed, COUNT(*) FILTER (change = 'removed') AS removed, FALSE AS expected FROM x")
def shadow_findings(spark, d):
    log = events_log(spark, d)
    return merge.shadow_findings(folds.fold(log, 9000), folds.fold(log), "orders")


@query("SELECT event_type AS region FROM events GROUP BY 1 HAVING epoch_us(MAX(ts)) // 1000 + 900000 < 1706700000000")
def lagging_regions(spark, d):
    regions = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("region")).agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("merged_ms"))
    return inspect.lagging(regions, 1_706_700_000_000).select("region")


@query("SELECT o_orderkey * 10 - 10 AS gap_from, o_orderkey * 10 - 1 AS gap_to FROM orders o WHERE o_orderkey > (SELECT MIN(o_orderkey) FROM orders) + 1 AND (o_orderkey - 1) % 7 = 0 AND o_orderkey % 7 <> 0")
def archive_gaps(spark, d):
    """Segments of ten entries for each order key, those of every seventh lost."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 7 <> 0")
    return migration.manifest_gaps(o.select((F.col("o_orderkey") * 10).alias("first_seq"), (F.col("o_orderkey") * 10 + 9).alias("last_seq")))


@query("SELECT 't:' || event_id AS key, 'value' AS \"column\", CASE WHEN event_type = 'view' THEN 'Text' ELSE 'Float' END AS kind, 'Int' AS type FROM events WHERE event_type IN ('view', 'click')")
def type_violations(spark, d):
    kind = F.when(F.col("event_type") == "view", "Text").when(F.col("event_type") == "click", "Float").when(F.col("event_type") == "error", "Null").otherwise("Int")
    fields = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("t:"), "event_id").alias("key"), F.lit("value").alias("column"), kind.alias("kind"))
    return folds.type_violations(fields, spark.createDataFrame([("t", "value", "Int")], "table string, column string, type string"))


@query("SELECT event_type AS \"column\", COUNT(*) AS bad FROM events WHERE event_id % 5 = 0 AND event_type = 'view' GROUP BY 1")
def unparseable_cells(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.when((F.col("event_id") % 5 == 0) & (F.col("event_type") == "view"), "x").otherwise(F.col("event_id").cast("string")).alias("view"))
    return migration.unparseable(e, {"view": "Int"}).select("column", "bad")


# Rules and reports that need a history of their own ------------------------------------------


@query("SELECT event_id AS seq FROM events WHERE event_type <> 'click'")
def row_ops(spark, d):
    op = F.when(F.col("event_type") == "signup", "schema").when(F.col("event_type") == "click", "branch").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "put").otherwise("merge")
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), op.alias("op")).where(folds.touches_rows()).select("seq")


@query("SELECT MAX(event_id) AS commit_id FROM events WHERE event_type = 'click'")
def branch_point(spark, d):
    log = events_log(spark, d).withColumn("op", F.when(F.col("event_type") == "click", "branch").otherwise(F.col("op")))
    return spark.createDataFrame([(folds.branch_point(log),)], "commit_id long")


@query("SELECT (MIN(event_id) + MAX(event_id)) // 2 AS horizon FROM events")
def feed_gap(spark, d):
    """A cursor behind the horizon gets the horizon, not changes."""
    log = events_log(spark, d)
    low, high = log.agg(F.min("commit_id"), F.max("commit_id")).first()
    found = folds.since(log, low, 100, horizon=(low + high) // 2)
    return spark.createDataFrame([(found.horizon,)], "horizon long")


FIELDS_SQL = "WITH m AS (SELECT (MIN(event_id) + MAX(event_id)) // 2 AS cut FROM events) "


def _fields(spark, d) -> tuple[DataFrame, int]:
    e = spark.read.parquet(f"{d}/events.parquet")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    return e.select(F.concat(F.lit("u:"), "user_id").alias("key"), F.col("event_type").alias("column"), F.col("event_id").alias("seq")), (low + high) // 2


@query(FIELDS_SQL + "SELECT event_id AS seq FROM events, m WHERE NOT (event_type = 'view' AND event_id <= cut) AND NOT (event_type = 'click' AND event_id <= cut // 2)")
def drop_columns(spark, d):
    fields, cut = _fields(spark, d)
    drops = spark.createDataFrame([("u", "view", cut), ("u", "view", 3), ("u", "click", cut // 2), ("other", "error", cut)], "table string, column string, seq long")
    return folds.drop_columns(fields, drops).select("seq")


@query(FIELDS_SQL + "SELECT event_id AS seq, CASE WHEN event_type = 'view' AND event_id < cut THEN 'seen' WHEN event_type = 'click' AND event_id < cut // 2 THEN 'hit' ELSE event_type END AS \"column\" FROM events, m")
def rename_columns(spark, d):
    fields, cut = _fields(spark, d)
    renames = spark.createDataFrame([("u", "view", "seen", cut), ("u", "click", "hit", cut // 2), ("other", "error", "oops", cut)], "table string, old string, new string, seq long")
    return folds.rename_columns(fields, renames).select("seq", "column")


PROPOSED_SQL = (
    "WITH p AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS ms, CASE event_type WHEN 'signup' THEN 'auto_apply' WHEN 'error' THEN 'shadow_validate' ELSE 'confirm' END AS gate, event_id % 3 = 0 AS done FROM events), n AS (SELECT (MIN(ms) + MAX(ms)) // 2 AS now FROM p) "
)


def _proposals(spark, d) -> tuple[DataFrame, int]:
    gate = F.when(F.col("event_type") == "signup", "auto_apply").when(F.col("event_type") == "error", "shadow_validate").otherwise("confirm")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), gate.alias("gate"), F.unix_millis(F.col("ts").cast("timestamp")).alias("proposed_ms"))
    rows = rows.withColumn("settled_ms", F.when(F.col("id") % 3 == 0, F.col("proposed_ms") + 3_600_000))
    low, high = rows.agg(F.min("proposed_ms"), F.max("proposed_ms")).first()
    return rows, (low + high) // 2


@query(
    PROPOSED_SQL + ", s AS (SELECT id, ms, gate, CASE WHEN done AND ms + 3600000 <= now THEN 'settled' WHEN ms + 14400000 <= now THEN 'expired' ELSE 'held' END AS state, now FROM p, n WHERE ms <= now) "
    "SELECT state, COUNT(*) AS n, CAST(SUM(CASE WHEN state <> 'expired' AND ms + 86400000 > now THEN CASE gate WHEN 'auto_apply' THEN 0 WHEN 'confirm' THEN 1 ELSE 5 END ELSE 0 END) AS BIGINT) AS cost FROM s GROUP BY 1"
)
def review_budget(spark, d):
    rows, now = _proposals(spark, d)
    return safety.review_holds(rows, now).groupBy("state").agg(F.count("*").alias("n"), F.sum("cost").cast("long").alias("cost"))


@query(
    PROPOSED_SQL + "SELECT id, CASE WHEN gate = 'auto_apply' THEN 'applied' WHEN done AND ms + 3600000 <= now THEN CASE WHEN id % 2 = 0 THEN 'promoted' ELSE 'rejected' END "
    "WHEN ms + CASE gate WHEN 'shadow_validate' THEN 86400000 ELSE 14400000 END <= now THEN 'expired' ELSE 'pending' END AS state FROM p, n"
)
def proposal_lifecycle(spark, d):
    rows, now = _proposals(spark, d)
    decided = rows.where("settled_ms is not null").select("id", F.when(F.col("id") % 2 == 0, "promoted").otherwise("rejected").alias("decision"), F.col("settled_ms").alias("at_ms"))
    return safety.lifecycle(rows.drop("settled_ms"), decided, now).select("id", "state")


@query(
    CHANGES_SQL + "SELECT id, CASE WHEN gate = 'shadow_validate' THEN 'irreversible over ' || rows_affected || ' rows: validate on a shadow branch' "
    "WHEN destructive THEN 'a ' || CASE WHEN change = 'rename_column' THEN 'ambiguous' ELSE 'destructive' END || ' change: confirm it' WHEN gate = 'confirm' THEN 'touches ' || rows_affected || ' rows: confirm it' ELSE 'additive and small: applied' END AS why FROM g"
)
def rationale(spark, d):
    return safety.classify(_changes(spark, d), safety.DEVELOPMENT).select("id", safety.rationale().alias("why"))


@query("WITH m AS (SELECT MAX(o_orderkey) AS newest, MIN(o_orderkey) FILTER (o_orderkey % 1000 = 999 AND o_orderkey > (SELECT MAX(o_orderkey) // 2 FROM orders)) AS young FROM orders) SELECT o_orderkey * 10 AS first_seq FROM orders, m WHERE o_orderkey < newest AND o_orderkey < young")
def retention_expired(spark, d):
    """Old segments up to the first young one, which is past the middle of the orders."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    half = o.agg(F.max("o_orderkey")).first()[0] // 2
    young = (F.col("o_orderkey") % 1000 == 999) & (F.col("o_orderkey") > half)
    segments = o.select((F.col("o_orderkey") * 10).alias("first_seq"), (F.col("o_orderkey") * 10 + 9).alias("last_seq"), F.when(young, 2_000).otherwise(1_000).cast("long").alias("archived_ms"))
    return migration.expired(segments, 1_500).select("first_seq")


@query("SELECT 'big' AS \"column\", CAST(NULL AS VARCHAR) AS example, 'withheld' AS refused UNION ALL SELECT 'event_type', (SELECT event_type FROM events ORDER BY event_id LIMIT 1), NULL")
def describe_withheld(spark, d):
    e = keyed(spark, d, "events").select("_key", "event_type", F.when(F.col("value") > 100, "x").alias("big"))
    return inspect.describe(e, withhold=frozenset({"big"})).select("column", F.get("examples", F.lit(0)).alias("example"), "refused")


@query("SELECT CAST(conv_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS pos, turn AS counter FROM conversations")
def crdt_siblings(spark, d):
    """Every turn inserted at the start: concurrent siblings, the latest first."""
    key, zero, none = F.col("conv_id").cast("string").alias("key"), F.lit(0).cast("long"), F.lit(None).cast("long")
    inserts = spark.read.parquet(f"{d}/conversations.parquet").select(key, F.col("turn").alias("counter"), zero.alias("replica"), none.alias("after_counter"), none.alias("after_replica"), F.col("text").alias("value"))
    return crdt.sequence(inserts, inserts.select("key", "counter", "replica").where("false")).select("key", "pos", "counter")


def _twice(spark, d) -> tuple[DataFrame, DataFrame]:
    """One history seen by two replicas, one of them cut at its middle."""
    ops = _crdt_ops(spark, d)
    low, high = ops.agg(F.min("seq"), F.max("seq")).first()
    return ops.where(F.col("seq") <= (low + high) // 2), ops


@query("SELECT event_type AS key, arg_max(value, ((epoch_us(ts) // 1000), user_id % 3, event_id)) AS value FROM events GROUP BY 1")
def crdt_register_merge(spark, d):
    return crdt.merge_registers(*map(crdt.register_state, _twice(spark, d))).select("key", "value")


@query(
    "WITH l AS (SELECT user_id % 3 AS lineage, user_id % 100 AS k, event_type AS e, max(event_id) FILTER (event_id % 4 <> 0) AS a, max(event_id) FILTER (event_id % 4 = 0) AS r FROM events GROUP BY 1, 2, 3) "
    "SELECT CAST(k AS VARCHAR) AS key, e AS element FROM l WHERE a IS NOT NULL AND (r IS NULL OR a > r) GROUP BY 1, 2"
)
def crdt_set_merge(spark, d):
    def state(ops):
        rows = ops.select((F.col("user_id") % 3).alias("lineage"), (F.col("user_id") % 100).cast("string").alias("key"), F.col("event_type").alias("element"), "seq")
        return crdt.set_state(rows.where("seq % 4 <> 0"), rows.where("seq % 4 = 0"))

    return crdt.set_value(crdt.merge_sets(*map(state, _twice(spark, d)))).select("key", F.explode("value").alias("element"))


@query(
    "SELECT event_type AS key, 'counter' AS kind, CAST(CAST(SUM(CAST(FLOOR(value) AS BIGINT)) AS BIGINT) AS VARCHAR) AS value FROM events GROUP BY 1 "
    "UNION ALL SELECT 'r:' || event_type, 'register', CAST(arg_max(user_id, ((epoch_us(ts) // 1000), user_id % 3, event_id)) AS VARCHAR) FROM events GROUP BY event_type "
    "UNION ALL SELECT 's:' || CAST(conv_id AS VARCHAR), 'sequence', '[' || string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) || ']' FROM conversations GROUP BY conv_id"
)
def crdt_converged(spark, d):
    ops = _crdt_ops(spark, d)
    counters = crdt.counter_value(crdt.counter_state(ops.withColumn("amount", F.col("whole")))).withColumn("value", F.col("value").cast("long"))
    registers = crdt.register(ops.withColumn("value", F.col("user_id"))).withColumn("key", F.concat(F.lit("r:"), "key"))
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat(F.lit("s:"), "conv_id").alias("key"), F.col("turn").alias("pos"), F.col("turn").alias("value"))
    return crdt.converged(counters, registers, sequences=turns)


@query(
    "SELECT 'u:' || event_id AS key, 'type' AS rule FROM events WHERE event_id % 2 = 1 AND event_type = 'view' "
    "UNION ALL SELECT DISTINCT 'u:' || a.event_id, 'unique' FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts = b.ts AND a.event_id <> b.event_id WHERE a.event_id % 2 = 1"
)
def refused_writes(spark, d):
    """Odd events proposed beside even ones: views have text where a number is declared, (user, time) must be unique."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u:"), "event_id").alias("key"), "user_id", "ts", F.when(F.col("event_type") == "view", "Text").otherwise("Int").alias("kind"), "event_id")
    declared = spark.createDataFrame([("u", "value", "Int")], "table string, column string, type string")
    return safety.refused_writes(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), declared, ["user_id", "ts"], {"value": F.col("kind")}).select("key", "rule")


@query("SELECT event_type, COUNT(*) AS n, MAX(value) AS top FROM events WHERE value > 10 AND (event_type <> 'purchase' OR user_id < 75) GROUP BY 1")
def ast_aggregate(spark, d):
    ast = {
        "table": "events", "groupBy": ["event_type"], "aggregates": [{"fn": "count", "as": "n"}, {"fn": "max", "column": "value", "as": "top"}],
        "filter": {"op": "and", "terms": [{"op": "gt", "column": "value", "value": 10}, {"op": "or", "terms": [{"op": "ne", "column": "event_type", "value": "purchase"}, {"op": "lt", "column": "user_id", "value": 75}]}]},
    }
    return ran(from_dict(ast), spark, d)
