"""The append-only log as Parquet: one folder for each commit, written whole and then made visible by a manifest entry.

Writers are one at a time (``version`` guards it); readers see only commits that the
manifest names, so a write that failed half way is never read. Paths go through
Spark's own readers and writers, any store will do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.values import encode
from tributary.operators import folds
from tributary.operators.proofs import ZERO, chain_hash, digest_parts, local_digest

LOG = "seq long, tx_pos int, branch_id long, commit_id long, op string, key string, value string, crdt_op string, crdt_kind string, amount long, replica long, author string, timestamp_ms long, prev_hash string, entry_hash string"


class Refused(ValueError):
    """A write whose precondition, type or uniqueness does not hold."""


@dataclass
class LogStore:
    spark: SparkSession
    root: str

    def manifest(self) -> list[dict]:
        rows = self.spark.read.text(f"{self.root}/manifest").collect() if self._exists("manifest") else []
        return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["seq"])

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """All visible log rows."""
        known = self.manifest()
        paths = [f"{self.root}/commits/{m['seq']}" for m in known]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def append(self, rows: list[dict[str, Any]], author: str, now_ms: int, branch: int = 0, expected: int | None = None) -> int:
        """One commit of one or more row operations (op, key, value, ...); returns its seq. ``expected``: the last seq the writer saw."""
        known = self.manifest()
        last = known[-1] if known else {"seq": -1, "hash": ZERO, "commits": {}}
        if expected is not None and expected != last["seq"]:
            raise Refused(f"the log is at {last['seq']}, not {expected}")
        if not rows or len({r["key"] for r in rows}) < len(rows):
            raise Refused("a transaction has rows, each of another key")
        seq, commit = last["seq"] + 1, last["commits"].get(str(branch), -1) + 1
        values = [encode(r["value"]) if "value" in r else None for r in rows]
        mark = chain_hash(last["hash"], local_digest([(r["op"], r["key"], v) for r, v in zip(rows, values)]))
        full = [
            (seq, i, branch, commit, r["op"], r["key"], v, r.get("crdt_op"), r.get("crdt_kind"), r.get("amount"), branch, author, now_ms, last["hash"], mark) for i, (r, v) in enumerate(zip(rows, values))
        ]
        self.spark.createDataFrame(full, LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{seq}")
        self._note({"seq": seq, "hash": mark, "commits": last["commits"] | {str(branch): commit}})
        return seq

    def append_bulk(self, rows: DataFrame, author: str, now_ms: int, branch: int = 0) -> int:
        """A large commit from a frame of op, key and value (already encoded), written by the executors."""
        known = self.manifest()
        last = known[-1] if known else {"seq": -1, "hash": ZERO, "commits": {}}
        seq, commit = last["seq"] + 1, last["commits"].get(str(branch), -1) + 1
        mark = chain_hash(last["hash"], rows.agg(*digest_parts("op", "key", "value")).first()["digest"])
        given = {"seq": seq, "tx_pos": 0, "branch_id": branch, "commit_id": commit, "replica": branch, "author": author, "timestamp_ms": now_ms, "prev_hash": last["hash"], "entry_hash": mark}
        full = rows.select("op", "key", "value").withColumns({k: F.lit(v) for k, v in given.items()})
        kinds = [c.split(" ") for c in LOG.split(", ")]
        full.select(*((F.col(n) if n in full.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds)).write.mode("overwrite").parquet(f"{self.root}/commits/{seq}")
        self._note({"seq": seq, "hash": mark, "commits": last["commits"] | {str(branch): commit}})
        return seq

    def altered(self) -> list[int]:
        """Commits whose rows do not give the hash that was recorded, or that do not follow the one before: one pass over the log, a row for each commit."""
        ends = [f(c).alias(f"{n}_{c}") for c in ("prev_hash", "entry_hash") for n, f in (("low", F.min), ("high", F.max))]
        found = {r["seq"]: r for r in self.read().groupBy("seq").agg(*digest_parts("op", "key", "value"), *ends).collect()}
        wrong, before = [], ZERO
        for m in self.manifest():
            r = found.get(m["seq"])
            mark = chain_hash(before, r["digest"] if r else local_digest([]))
            recorded = r is None or {r["low_prev_hash"], r["high_prev_hash"]} == {before} and {r["low_entry_hash"], r["high_entry_hash"]} == {mark}
            if m["hash"] != mark or not recorded:
                wrong.append(m["seq"])
            before = m["hash"]
        return wrong

    def _note(self, entry: dict) -> None:
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/manifest")

    def put(self, key: str, value: Any, author: str, now_ms: int, **more: Any) -> int:
        return self.append([{"op": "put", "key": key, "value": value}], author, now_ms, **more)

    def delete(self, key: str, author: str, now_ms: int, **more: Any) -> int:
        return self.append([{"op": "delete", "key": key}], author, now_ms, **more)

    def get(self, key: str) -> tuple[str, int] | None:
        """(value, version) of a key now."""
        row = folds.fold(self.read().where(F.col("key") == key)).first()
        return (row["value"], row["version"]) if row else None

    def put_if(self, key: str, value: Any, version: int | None, author: str, now_ms: int) -> int:
        """A put that holds only if the key is absent (None) or at a version; else it is refused with the current one."""
        at = self.manifest()[-1]["seq"] if self._exists("manifest") else -1
        now = self.get(key)
        if (now[1] if now else None) != version:
            raise Refused(f"{key} is at {now[1] if now else None}")
        return self.append([{"op": "put", "key": key, "value": value}], author, now_ms, expected=at)

    def snapshot(self, name: str) -> str:
        """Saves the current fold with its last seq; a later fold reads it and the tail only."""
        log = self.read()
        seq = self.manifest()[-1]["seq"]
        folds.fold(log).withColumn("seq", F.lit(seq)).write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")
        return f"{self.root}/snapshots/{name}"

    def land(self, apply: DataFrame, converge: list[dict[str, Any]], author: str, now_ms: int, branch: int = 0) -> int:
        """Lands a merge: its assignments in one bulk commit, converged values logged beside them so that a replay has them, then a marker."""
        puts = apply.select(F.when(F.col("s_value").isNull(), "delete").otherwise("put").alias("op"), "key", F.col("s_value").alias("value"))
        self.append_bulk(puts, author, now_ms, branch)
        return self.append([*converge, {"op": "merge", "key": "#merge"}], author, now_ms, branch)

    def status(self) -> dict[str, Any]:
        """Commits, rows and last seq; None before the first commit, which is not zero."""
        known = self.manifest()
        if not known:
            return {"commits": None, "rows": None, "last_seq": None}
        return {"commits": len(known), "rows": self.read().count(), "last_seq": known[-1]["seq"]}
