"""Tamper evidence: hashes of log entries, chains, Merkle trees and sync plans.

SHA-256 over length-prefixed fields. Trees are built level by level as DataFrames;
proofs are small and checked in plain Python.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.lineage import cut

ZERO = "0" * 64


def prefixed(*fields: Column) -> Column:
    return F.concat(*(F.concat(F.lpad(F.hex(F.octet_length(f)), 16, "0"), F.hex(f.cast("binary"))) for f in (F.coalesce(f.cast("string"), F.lit("")) for f in fields)))


def content_hash(*fields: str) -> Column:
    """Hash of an entry without its predecessor: equal on any chain."""
    return F.sha2(F.unhex(prefixed(F.lit("entry"), *map(F.col, fields))), 256)


def leaf_hash(key: Column, value: Column) -> Column:
    return F.sha2(F.unhex(prefixed(F.lit("leaf"), key, value)), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(prefixed(F.lit("node"), left, right)), 256)


def _hash(*fields: str) -> str:
    return hashlib.sha256(b"".join(len(f.encode()).to_bytes(8, "big") + f.encode() for f in fields)).hexdigest()


def chain_hash(prev: str, *fields: str) -> str:
    """Hash of an entry with its predecessor; chains grow one by one, at append."""
    return _hash("chain", prev, *fields)


def chain_breaks(log: DataFrame) -> DataFrame:
    """Entries whose prev_hash is no entry's hash and not the start: an anti join, no order needed."""
    return log.where(F.col("prev_hash") != ZERO).join(log.select(F.col("entry_hash").alias("prev_hash")).distinct(), "prev_hash", "left_anti")


def linked_hash(prev: str, *fields: str) -> Column:
    """The same for the rows of a log: the hash that an entry ought to have."""
    return F.sha2(F.unhex(prefixed(F.lit("chain"), F.col(prev), *map(F.col, fields))), 256)


def chain_altered(log: DataFrame, *fields: str) -> DataFrame:
    """Entries whose fields or predecessor were changed under an old hash: each hash is computed again in the scan."""
    return log.where(~F.col("entry_hash").eqNullSafe(linked_hash("prev_hash", *fields)))


def chain_forks(log: DataFrame) -> DataFrame:
    """(branch_id, prev_hash, entries) of predecessors that several entries of one branch claim: an entry was put in or dealt twice."""
    return log.groupBy("branch_id", "prev_hash").agg(F.count("*").alias("entries")).where("entries > 1")


def digest_parts(*fields: str) -> list[Column]:
    """Aggregates of a digest of a set of rows in any order, for commits too large to hash in one place: the rows' number and the sums of four parts of their hashes."""
    one = F.sha2(F.unhex(prefixed(F.lit("row"), *map(F.col, fields))), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(one, 1 + 14 * k, 14), 16, 10).cast("decimal(18,0)")), F.lit(0)) for k in range(4)]
    return [F.concat_ws("|", F.count("*"), *parts).alias("digest")]


def local_digest(rows: list[tuple]) -> str:
    """The same of rows at hand; a missing field counts as empty."""
    hashes = [_hash("row", *("" if v is None else str(v) for v in r)) for r in rows]
    return "|".join(str(x) for x in (len(rows), *(sum(int(h[14 * k : 14 * k + 14], 16) for h in hashes) for k in range(4))))


def leaves(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(pos, key, hash) of a keyed table's leaves in key order, one for each key.

    Positions come from range partitions: an index inside each and the sizes of
    those before it, so no task sees the whole table.
    """
    one = df.groupBy(F.col(key).alias("key")).agg(F.min(value).alias("value"))
    ranged = one.repartitionByRange("key").withColumn("part", F.spark_partition_id()).select("key", "part", leaf_hash(F.col("key"), F.col("value")).alias("hash"))
    ranged = cut(ranged)
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select((F.col("start") + F.col("inside")).alias("pos"), "key", "hash")


def next_level(level: DataFrame) -> DataFrame:
    """Parents of a level: pairs hash together, an odd last node moves up as it is."""
    half = F.floor(F.col("pos") / 2).alias("pos")
    pair = level.groupBy(half).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("pos") % 2 == 1, F.col("hash"))).alias("r"))
    return pair.select("pos", F.when(F.col("r").isNull(), F.col("l")).otherwise(node_hash(F.col("l"), F.col("r"))).alias("hash"))


def merkle_levels(df: DataFrame, key: str = "key", value: str = "value") -> list[DataFrame]:
    """Leaf level first; log2(n) grouped passes, each half the size, lineage cut in between."""
    first = leaves(df, key, value)
    out = [cut(first)]
    n = out[0].count()
    while n > 1:
        out.append(cut(next_level(out[-1].select("pos", "hash"))))
        n = -(-n // 2)
    return out


def merkle_root(df: DataFrame, key: str = "key", value: str = "value") -> str:
    """Root of the tree; that of an empty table is all zeros."""
    top = merkle_levels(df, key, value)[-1].select("hash").first()
    return top["hash"] if top else ZERO


@dataclass(frozen=True)
class RangeProof:
    """Leaves from one before a range to one after it (where there are such), with the hashes beside them at each level and the number of leaves."""

    start: int
    entries: tuple[tuple[str, str], ...]
    beside: tuple[tuple[str | None, str | None], ...]
    size: int


def prove_range(levels: list[DataFrame], low: str, high: str) -> RangeProof:
    """Proof that the leaves in [low, high) are all there are. An absent key is an empty range from it to its successor."""
    size = levels[0].count()
    below = levels[0].where(F.col("key") < low).agg(F.max("pos")).first()[0]
    above = levels[0].where(F.col("key") >= high).agg(F.min("pos")).first()[0]
    first = below if below is not None else 0
    last = above if above is not None else size - 1
    rows = levels[0].where((F.col("pos") >= first) & (F.col("pos") <= last)).orderBy("pos").collect()  # the answer itself
    beside, a, b, n = [], first, last, size
    for level in levels[:-1]:
        want = {p for p in (a - 1 if a % 2 else None, b + 1 if b % 2 == 0 and b + 1 < n else None) if p is not None}
        got = {r["pos"]: r["hash"] for r in level.where(F.col("pos").isin(list(want) or [-1])).collect()}
        beside.append((got.get(a - 1) if a % 2 else None, got.get(b + 1) if b % 2 == 0 else None))
        a, b, n = a // 2, b // 2, -(-n // 2)
    return RangeProof(first, tuple((r["key"], r["hash"]) for r in rows), tuple(beside), size)


def verify_range(proof: RangeProof, root: str, low: str, high: str) -> list[str] | None:
    """The range's keys if the proof holds, else None."""
    keys = [k for k, _ in proof.entries]
    if proof.size == 0:
        return [] if root == ZERO else None
    ordered = all(a < b for a, b in zip(keys, keys[1:]))
    closed = bool(keys) and (proof.start == 0 or keys[0] < low) and (proof.start + len(keys) == proof.size or keys[-1] >= high)
    if not ordered or not closed:
        return None
    row, a, n = [h for _, h in proof.entries], proof.start, proof.size
    for before, after in proof.beside:
        if a % 2:
            if before is None:
                return None
            row, a = [before, *row], a - 1
        if len(row) % 2 and a + len(row) < n:
            if after is None:
                return None
            row = [*row, after]
        row = [_hash("node", *row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        a, n = a // 2, -(-n // 2)
    return [k for k in keys if low <= k < high] if row == [root] else None


def inclusion(log: DataFrame, seq: int) -> DataFrame:
    """The chain from an entry to the head, in order."""
    return log.where(F.col("seq") >= seq).orderBy("seq")


def verify_inclusion(entries: list[tuple[str, str, tuple[str, ...]]], head: str) -> bool:
    """entries: (prev_hash, entry_hash, fields) in order. Each hash must be right and linked to the next, the last the head."""
    linked = all(a[1] == b[0] for a, b in zip(entries, entries[1:]))
    return bool(entries) and linked and entries[-1][1] == head and all(chain_hash(p, *f) == h for p, h, f in entries)


def anchor_findings(anchors: DataFrame, heads: DataFrame, now_ms: int, fresh_ms: int = 86_400_000) -> DataFrame:
    """Anchors with what is wrong: covers less than one before, names a hash that is not in the log, or (the last) is old."""
    order = Window.orderBy("published_ms")  # anchors are few: one a day
    out = anchors.join(heads.select("seq", F.col("entry_hash").alias("known")), anchors["covered_seq"] == heads["seq"], "left").drop("seq")
    out = out.withColumn("shrinks", F.coalesce(F.col("covered_seq") < F.lag("covered_seq").over(order), F.lit(False)))
    last = F.lead("covered_seq").over(order).isNull()
    wrong = ~F.col("head_hash").eqNullSafe(F.col("known"))
    return out.withColumn("unknown", wrong).withColumn("stale", last & (F.col("published_ms") + fresh_ms < now_ms)).drop("known")


def to_send(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Entries that the other side lacks, by content hash."""
    return mine.join(theirs.select("content_hash").distinct(), "content_hash", "left_anti")


def sync_conflicts(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Keys that both sides assigned since they parted."""
    a, b = to_send(mine, theirs), to_send(theirs, mine)
    writes = F.col("op").isin("put", "delete")
    return a.where(writes).select("key").distinct().join(b.where(writes).select("key").distinct(), "key", "left_semi")


def rebase(log: DataFrame, suffix: DataFrame, *fields: str) -> DataFrame:
    """A received suffix as entries after the log's head: seq follows on and each entry is chained to the one before it.

    Content hashes stay, so a second sync sends nothing. A chain is sequential by
    nature; its entries' fields are hashed to content in the scan, and only those
    hashes go through one fold.
    """
    head = log.agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("hash")).first()
    seq, prev = (-1, ZERO) if head["seq"] is None else head
    rows = suffix.select("seq", content_hash(*fields).alias("content")).orderBy("seq")
    out = []
    for i, r in enumerate(rows.toLocalIterator(), 1):  # hashes only, partition by partition
        mark = chain_hash(prev, r["content"])
        out.append((r["seq"], seq + i, prev, mark))
        prev = mark
    moved = log.sparkSession.createDataFrame(out, "old_seq long, new_seq long, new_prev string, new_hash string")
    kept = [c for c in suffix.columns if c not in ("seq", "prev_hash", "entry_hash")]
    return suffix.join(moved, suffix["seq"] == moved["old_seq"]).select(F.col("new_seq").alias("seq"), *kept, F.col("new_prev").alias("prev_hash"), F.col("new_hash").alias("entry_hash"))


def unsigned(entries: DataFrame, signatures: DataFrame) -> DataFrame:
    """Entries without a signature of their own author's session. Checking a signature itself needs a crypto library and is left to the caller."""
    return entries.join(signatures.select("content_hash", F.col("signer").alias("session_id")), ["content_hash", "session_id"], "left_anti")
