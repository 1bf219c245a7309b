"""Mixing sources to target weights (operator 3).

A source's weight is its token share to the power of an exponent, normalised. The
exponent is bisected so that the weights' entropy reaches a target, or so that no
document of a small source is repeated more often than allowed. The weights are
realised block by block: a source's documents are dealt to random blocks, and
each block repeats a permutation of its documents until its part of the budget is
spent, so no source needs one long running sum.

DataFrame functions only. Defined cases: null sources are one source; null and
empty texts have no tokens and pass once; repeated rows count and pass each on
its own; an empty table mixes to no rows; a text of any length is one row; input columns named like the added ones
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import cut

#: White-space tokens; any other count can be passed in its place.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bisection steps, five in each pass over the source table: its 31 inner points are the midpoints of five levels.
PASSES, POINTS = 6, 32
ADDED = ("mix_weight", "mix_tokens", "mix_epoch", "mix_block", "mix_pos")


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def _measures(totals: DataFrame, low: float, high: float) -> DataFrame:
    """Entropy (nats) and most repeats of a source, relative to the least repeated, at each exponent of a grid."""
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(POINTS - 1)), lambda k: F.lit(low) + k * ((high - low) / POINTS)))
    # T**a is scaled by the largest source: x = (T / most)**a, so that nothing overflows
    at = totals.select(grid.alias("a"), F.log(F.col("tokens") / F.col("most")).alias("ln"))
    x = F.exp(F.col("a") * F.col("ln"))
    entropy = F.log(F.sum(x)) - F.sum(x * F.col("a") * F.col("ln")) / F.sum(x)
    spread = F.max(F.exp((F.col("a") - 1) * F.col("ln"))) / F.min(F.exp((F.col("a") - 1) * F.col("ln")))
    return at.groupBy("a").agg(entropy.alias("entropy"), spread.alias("spread"))


def exponent(totals: DataFrame, entropy_share: float | None, max_repeats: float | None) -> float:
    """The largest exponent in [0, 1] whose entropy reaches ``entropy_share`` of the uniform one; at least the smallest that keeps the repeats.

    ``totals``: tokens (positive) and most (of any source) for each source. Each
    pass brings 31 pairs of numbers to the driver, whatever the number of sources.
    """
    bounds = []
    n = totals.count()
    if n == 0:
        return 1.0
    target = None if entropy_share is None else entropy_share * F.log(F.lit(float(n)))
    for wanted, seek in ((target, "entropy"), (max_repeats, "spread")):
        if wanted is None:
            continue
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            # both measures fall as the exponent grows
            ok = F.col("entropy") >= wanted if seek == "entropy" else F.col("spread") > wanted
            at = _measures(totals, low, high).agg(F.max(F.when(ok, F.col("a"))).alias("yes"), F.min(F.when(~ok, F.col("a"))).alias("no")).first()
            low, high = low if at["yes"] is None else at["yes"], high if at["no"] is None else at["no"]
        bounds.append(low if seek == "entropy" else high)
    return max(bounds, default=1.0)


def mix(
    df: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    tokens: Column | None = None,
    entropy_share: float | None = 0.97,
    max_repeats: float | None = 1.5,
    budget: float | None = None,
    block_tokens: int = 1 << 20,
    seed: int = 11,
) -> DataFrame:
    """The input's rows, each as often as the mixture wants it, with mix_weight, mix_tokens, mix_epoch, mix_block and mix_pos.

    ``budget`` tokens in all; by default the least with which every source passes
    whole at least once, so nothing is dropped. A block's last epoch stops at the
    first document that reaches its budget. Read in the order (mix_block, mix_pos) the
    rows are a sequence of block permutations in which the blocks of all sources and
    epochs come at random, so that every long stretch has the weights. A document
    without tokens passes once.
    """
    df = df.drop(*ADDED)
    sized = df.withColumn("mix_tokens", word_count() if tokens is None else tokens.cast("long"))
    per = sized.groupBy(F.col(source_col).alias("__source")).agg(F.sum("mix_tokens").alias("tokens"))
    per = cut(per.where(F.col("tokens") > 0))  # one row for each source
    most = per.agg(F.max("tokens")).first()[0] or 1
    totals = per.withColumn("most", F.lit(float(most)))
    a = exponent(totals, entropy_share, max_repeats)
    ln = F.log(F.col("tokens") / F.lit(float(most)))
    scale = totals.agg(F.sum(F.exp(a * ln)).alias("z"), F.min(F.exp((a - 1) * ln)).alias("least")).first()
    z, least = scale["z"] or 1.0, scale["least"] or 1.0
    # repeats of a source: budget * weight / tokens
    repeats = F.exp((a - 1) * ln) / least if budget is None else F.lit(budget / (z * most)) * F.exp((a - 1) * ln)
    plan = totals.select("__source", (F.exp(a * ln) / z).alias("mix_weight"), repeats.alias("__repeats"), F.ceil(F.col("tokens") / block_tokens).alias("__blocks"))

    joined = sized.join(plan, F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source")
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col))
    shuffled = F.xxhash64(F.lit(seed + 1), F.col(id_col))
    joined = joined.withColumn("__block", F.pmod(draw, F.coalesce("__blocks", F.lit(1))))
    block = Window.partitionBy(source_col, "__block")
    run = block.orderBy(shuffled, id_col, "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("mix_tokens").over(run), F.lit(0))
    part = F.sum("mix_tokens").over(block)
    whole = F.floor(F.coalesce("__repeats", F.lit(1.0)) + 1e-9)
    left_over = (F.coalesce("__repeats", F.lit(1.0)) - whole) * part
    epochs = whole + (before < left_over - 1e-6 * part).cast("long")
    epochs = F.when(F.col("mix_tokens") == 0, F.lit(1)).otherwise(epochs).cast("long")
    dealt = joined.withColumn("__epochs", epochs).where(F.col("__epochs") > 0)
    dealt = dealt.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__epochs"))))
    dealt = dealt.withColumn("mix_block", F.xxhash64(F.lit(seed + 2), F.col("mix_epoch"), F.col(source_col), F.col("__block")))
    dealt = dealt.withColumn("mix_pos", F.xxhash64(F.lit(seed + 1), F.col("mix_epoch"), F.col(id_col)))
    dealt = dealt.withColumn("mix_weight", F.coalesce("mix_weight", F.lit(0.0)))
    return dealt.select(*df.columns, *ADDED)
