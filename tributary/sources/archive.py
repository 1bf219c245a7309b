"""Archiving commits: copies with digests, restore and drills. Gaps and retention are in ``operators.migration``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.folds import fold


def digest(rows: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free hash of them."""
    cells = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(cells)).alias("mark"), F.sum(F.xxhash64(F.lit(1), cells) % 1_000_003).alias("check"))


def sweep(log: DataFrame, target: str, first_seq: int, last_seq: int) -> dict:
    """Copies a range of the log and proves it by reading it back."""
    part = log.where(F.col("seq").between(first_seq, last_seq))
    part.write.mode("overwrite").parquet(target)
    there, here = digest(log.sparkSession.read.parquet(target)).first(), digest(part).first()
    if there != here:
        raise IOError(f"{target} does not read back as written")
    return {"target": target, "first_seq": first_seq, "last_seq": last_seq, "rows": here["rows"], "mark": here["mark"], "check": here["check"]}


def audit(spark: SparkSession, manifest: list[dict]) -> list[str]:
    """Targets whose content is not what the manifest says."""
    bad = []
    for m in manifest:
        found = digest(spark.read.parquet(m["target"])).first()
        if (found["rows"], found["mark"], found["check"]) != (m["rows"], m["mark"], m["check"]):
            bad.append(m["target"])
    return bad


def restore(spark: SparkSession, manifest: list[dict], newest: int | None = None) -> DataFrame:
    """The log of all segments, or of the newest n."""
    chosen = sorted(manifest, key=lambda m: m["first_seq"])[-newest if newest else None :]
    return spark.read.parquet(*(m["target"] for m in chosen))


def drill(spark: SparkSession, manifest: list[dict], live: DataFrame) -> bool:
    """Whether a full restore folds to the live state."""
    restored = fold(restore(spark, manifest)).select("key", "value")
    now = fold(live).select("key", "value")
    return restored.exceptAll(now).isEmpty() and now.exceptAll(restored).isEmpty()
