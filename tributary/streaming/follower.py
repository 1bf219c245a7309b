"""Followers of the log: a change feed by micro-batch, and a breaker with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tributary.operators.folds import diff, fold
from tributary.operators.safety import Policy
from tributary.sources.log_store import LOG


def follow(spark: SparkSession, root: str, checkpoint: str, deliver: Callable[[DataFrame, int], None], state: str) -> StreamingQuery:
    """Delivers the row changes of each micro-batch of new commits, once each.

    The state before a batch is the Parquet fold that the last one left under
    ``state``; only keys that the batch touches are compared. A batch that runs
    again after a failure finds the same state, as each writes its own version.
    """
    log = spark.readStream.schema(LOG).parquet(f"{root}/commits/*")

    def batch(rows: DataFrame, number: int) -> None:
        named = spark.read.text(f"{root}/manifest").select(F.get_json_object("value", "$.seq").cast("long").alias("seq"))
        unseen = rows.select("seq").distinct().join(named, "seq", "left_anti")
        if not unseen.isEmpty():  # a commit is written before it is made visible: the batch fails and is tried again
            raise RuntimeError("a commit of this batch is not in the manifest yet")
        rows = rows.where(F.col("op").isin("put", "delete"))
        empty = spark.createDataFrame([], "key string, value string, version long, seq long")
        before = spark.read.parquet(f"{state}/{number - 1}") if number else empty
        touched = rows.select("key").distinct()
        old = before.join(touched, "key", "left_semi")
        log_form = old.select("key", "value", F.col("version").alias("commit_id"), "seq", F.lit(0).alias("tx_pos"), F.lit("put").alias("op"))
        new = fold(log_form.unionByName(rows.select(*log_form.columns)))
        kept = before.join(touched, "key", "left_anti").select("key", "value", "version", "seq")
        last = rows.agg(F.max("seq")).first()[0]
        kept.unionByName(new.withColumn("seq", F.lit(last).cast("long"))).write.mode("overwrite").parquet(f"{state}/{number}")
        deliver(diff(old, new), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breaker_stream(writes: DataFrame, policy: Policy) -> DataFrame:
    """(scope, seq, window_rows, tripped) of every write of a stream of (scope, seq, at_ms, rows), the window kept as state of each scope.

    Arrival order inside a batch is by seq. A tripped scope stays tripped and its
    state is one flag; else the state holds the writes of one window.
    """

    def record(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tripped, ats, ns = state.get if state.exists else (False, [], [])
        ats, ns = list(ats), list(ns)
        rows = pd.concat(list(pdfs)).sort_values("seq")
        out = []
        for seq, at, n in zip(rows["seq"], rows["at_ms"], rows["rows"]):
            while ats and ats[0] + policy.window_ms <= at:
                ats.pop(0)
                ns.pop(0)
            total = sum(ns) + (0 if tripped else n)
            if not tripped and total > policy.ceiling:
                tripped = True
            elif not tripped:
                ats.append(int(at))
                ns.append(int(n))
            out.append((key[0], seq, total, tripped))
        state.update((tripped, [] if tripped else ats, [] if tripped else ns))
        yield pd.DataFrame(out, columns=["scope", "seq", "window_rows", "tripped"])

    return writes.groupBy("scope").applyInPandasWithState(
        record, "scope string, seq long, window_rows long, tripped boolean", "tripped boolean, ats array<long>, ns array<long>", "append", GroupStateTimeout.NoTimeout
    )
