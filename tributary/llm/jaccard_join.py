"""Similarity join of word-shingle sets by chosen paths (operator 2).

In each run a set of n shingles chooses those whose run hash is below 1/(s n): a
pair of similarity s shares a chosen shingle with a probability of at least
1 - 1/e, and the runs are as many as the target recall needs. Sets that share a
chosen shingle meet in a bucket. Small buckets are compared by brute force on
MinHash sketches. In larger ones every set is compared with the bucket's pivot,
and the sets that are not like it are split again on a MinHash value (one of the
set's shingles) chosen by a hash of the path so far, for DEPTH levels. What those
levels leave apart is not dropped: all sets of every large first bucket that still
holds two components go through an exact prefix join, so that a pair is missed only
where no run lets it share a bucket, as the number of runs allows for. Connected
candidates are then compared exactly, block by block, on their whole shingle sets;
the links that hold give classes and link counts.

Texts with equal shingle sets are one set from the start, so exact copies cost one
comparison. Counts of links are exact inside connected candidates: the work there
is quadratic in the number of different texts of a group, in matrix products of
bounded blocks that spread over tasks; no pair is ever a row.

Defined cases: null and empty texts have no shingles and are each a class of their
own; texts of fewer than five words are one shingle; rows that share an id count
as one document; rows with a null id are not compared (null class, no links) and
stay in ``keep_one``; an empty table gives no rows; a text of any length is one set
in one task. Of the input's columns only the id and the text are read here, so the
others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import cut, one_blas_thread, small
from tributary.llm.components import components, extended
from tributary.llm.shingles import mix, shingle_sets

SKETCH = 64
#: Sets of a bucket that are compared by brute force; shingles of a block in the exact comparison, where a set counts as SHORT at least.
SMALL, BLOCK, SHORT = 64, 1_000_000, 500
DEPTH = 4
#: Every HOT_SHARE-th left-over set is looked at for frequent shingles; those in HOT_LEAST of these sets come last in the prefix order, HOT_MOST at most. Any order is exact; a good one is fast.
HOT_SHARE, HOT_LEAST, HOT_MOST = 4, 3, 500_000
#: How far below the threshold a sketch may fall: three standard deviations of SKETCH values.
SLACK = 0.15
#: Columns of a set's parities, a power of two in number, 64 bits each.
PARITY = [f"x{k}" for k in range(8)]
PLACES = np.arange(SKETCH, dtype=np.uint64) << np.uint64(16)
_FACTORS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(shingles: np.ndarray) -> bytes:
    """16 bits of each of SKETCH minima."""
    least = np.full(SKETCH, ~np.uint64(0))
    for lo in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[lo : lo + 4096, None] * _FACTORS).min(axis=0))
    return (least & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 bits for each name in PARITY: whether the shingles of one remainder are odd in number. Two sets differ in no fewer shingles than their parities in bits."""
    odd = np.bincount((shingles & np.uint64(64 * len(PARITY) - 1)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def chosen(shingles: np.ndarray, path: int, similarity: float) -> np.ndarray:
    """Keys of the children that a set takes at a node of the tree."""
    h = mix(shingles ^ np.uint64(path))
    limit = min(1.0, 1.0 / (similarity * len(shingles))) if len(shingles) else 0.0
    return mix(h[h <= np.uint64(min(limit * 2.0**64, 2.0**64 - 2048))] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)


def runs_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / -1.0))


def sketched(docs: DataFrame, similarity: float, runs: int, words: int) -> DataFrame:
    """id, set key (two longs), sketch and first-level buckets of every document with a shingle."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = mix(np.arange(101, 101 + runs, dtype=np.uint64))
        for pdf in it:
            rows = []
            for doc, s in zip(pdf["id"], shingle_sets(list(pdf["text"]), words)):
                if len(s):
                    hi, lo = np.frombuffer(hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), dtype=np.int64)
                    rows.append((doc, hi, lo, len(s), sketch(s), np.concatenate([chosen(s, r, similarity) for r in roots])))
            yield pd.DataFrame(rows, columns=["id", "hi", "lo", "n", "sketch", "paths"])

    return docs.mapInPandas(batches, "id long, hi long, lo long, n long, sketch binary, paths array<long>")


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def small_links(rows: DataFrame, least: float) -> DataFrame:
    """Spanning links (a, b) of each small bucket's sets whose sketches agree; at most SMALL rows to a bucket."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for ids, sketches in zip(pdf["ids"], pdf["sketches"]):
                m = np.frombuffer(b"".join(sketches), dtype=np.uint16).reshape(len(ids), SKETCH)
                root = list(range(len(ids)))
                for i in range(1, len(ids)):
                    like = np.nonzero(agree(m[:i], m[i]) >= least)[0]
                    for j in {root[j] for j in like}:
                        out.append((ids[i], ids[j]))
                        root = [i if r == j else r for r in root]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    lists = rows.groupBy("path").agg(F.collect_list(F.struct("id", "sketch")).alias("l")).select(F.col("l.id").alias("ids"), F.col("l.sketch").alias("sketches"))
    return lists.mapInPandas(batches, "a long, b long")


def candidates(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the ids of sets that may be alike, and the members (path, id) of the large first buckets."""
    least = similarity - SLACK

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        pair = [np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, SKETCH) for s in (a, b)]
        return pd.Series(agree(*pair))

    def children(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for doc, path, raw in zip(pdf["id"], pdf["path"], pdf["sketch"]):
                values = np.frombuffer(raw, dtype=np.uint16).astype(np.uint64) | PLACES  # a minimum and its place are one token of SKETCH
                rows += [(doc, raw, int(k)) for k in chosen(values, path % (1 << 64), similarity)]
            yield pd.DataFrame(rows, columns=["id", "sketch", "path"])

    found = large = None
    level = sets.select("id", "sketch", F.explode("paths").alias("path"))
    for _ in range(DEPTH):
        buckets = level.groupBy("path").agg(F.count("*").alias("m"), F.min("id").alias("pivot"), F.min_by("sketch", "id").alias("pivot_sketch")).where("m > 1")
        like = F.when(F.col("m") > SMALL, likeness("sketch", "pivot_sketch") >= least)
        met = cut(level.join(buckets, "path").select("id", "sketch", "path", "m", "pivot", like.alias("like")))
        links = small_links(met.where(F.col("m") <= SMALL), least)
        links = cut(links.union(met.where("like and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))).distinct())
        found = links if found is None else found.union(links)
        large = met.where(F.col("m") > SMALL).select("path", "id") if large is None else large
        rest = met.where("not like").select("id", "sketch", "path")
        if rest.isEmpty():
            break
        level = rest.mapInPandas(children, "id long, sketch binary, path long")
    return found, large


def left_over(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of all sets in large buckets that hold more than one component."""
    rows = large.join(roots, F.col("id") == F.col("node"), "left").select("path", "id", F.coalesce("root", "id").alias("root"))
    mixed = rows.groupBy("path").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("path")
    return small(rows.join(mixed, "path", "left_semi").select("id", "root").distinct())


def prefix_links(rest: DataFrame, docs: DataFrame, sketches: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links (a, b) between all left-over sets of different components that may be alike. rest: id, root; docs: id, text.

    With every set's shingles in one order, frequent ones last, two sets as similar
    share one of the first n - ceil(s n) + 1 of the longer and of the first
    n - ceil(2 s n / (1 + s)) + 1 of the shorter. Texts that have only a common
    passage do not meet: the prefix of the shorter ends before the passage begins.
    Nor do texts whose parities prove them less similar, so that few pairs become rows.
    """
    texts = docs.join(rest, "id")

    def often(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = shingle_sets(list(pdf["text"]), words)
            yield pd.DataFrame({"sh": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)})

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SHARE)) == 0).select("text").mapInPandas(often, "sh long")
    counts = some.groupBy("sh").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST)
    hot = counts.orderBy(F.desc("n"), "sh").limit(HOT_MOST).toPandas()  # HOT_MOST rows at most: an order, not a cut
    hot_sh = np.sort(hot["sh"].to_numpy(np.int64)) if len(hot) else np.zeros(0, np.int64)
    rank = dict(zip(hot["sh"], hot["n"])) if len(hot) else {}
    hot_n = np.array([rank[x] for x in hot_sh], dtype=np.int64)

    def prefixes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for doc, root, s in zip(pdf["id"], pdf["root"], shingle_sets(list(pdf["text"]), words)):
                odd = dict(zip(PARITY, parities(s)))
                s, n = s.view(np.int64), len(s)
                at = np.minimum(np.searchsorted(hot_sh, s), max(len(hot_sh) - 1, 0))
                freq = np.where(hot_sh[at] == s, hot_n[at], 0) if len(hot_sh) else np.zeros(n, np.int64)
                order = np.lexsort((s, freq))
                probe = n - math.ceil(similarity * n - 1e-9) + 1
                index = n - math.ceil(2 * similarity / (1 + similarity) * n - 1e-9) + 1
                out.append(pd.DataFrame({"sh": s[order[:probe]], "id": doc, "root": root, "n": n, "indexed": np.arange(probe) < index, **odd}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["sh", "id", "root", "n", "indexed", *PARITY])

    held = cut(texts.select("id", "root", "text").mapInPandas(prefixes, f"sh long, id long, root long, n long, indexed boolean, {', '.join(f'{x} long' for x in PARITY)}"))
    other = held.where("indexed").select("sh", F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("root", "n", *PARITY)))
    differ = functools.reduce(operator.add, (F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_b"))) for x in PARITY))
    longer = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("id") > F.col("b")))  # of sets of one size either may count as the longer
    fits = longer & (F.col("n_b") >= similarity * F.col("n") - 1e-9) & (F.col("root") != F.col("root_b"))
    fits &= differ <= (F.col("n") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    pairs = held.join(other, "sh").where(fits).select(F.col("id").alias("a"), "b").distinct()

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(agree(*(np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, SKETCH) for s in (a, b))))

    near = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    return near.where(likeness("sa", "sb") >= similarity - SLACK).select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of incidence matrices over slices of their common shingles."""
    flat = [np.concatenate(x) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    codes = []
    for f, o in zip(flat, owner):
        at = np.minimum(np.searchsorted(common, f), max(len(common) - 1, 0))
        ok = common[at] == f if len(common) else np.zeros(len(f), dtype=bool)
        order = np.argsort(at[ok], kind="stable")
        codes.append((at[ok][order], o[ok][order]))
    step = max(64, 8_000_000 // max(len(left), len(right), 1))
    for lo in range(0, len(common), step):
        width = min(step, len(common) - lo)
        parts = []
        for (code, own), rows in zip(codes, (len(left), len(right))):
            a, b = np.searchsorted(code, [lo, lo + width])
            part = np.zeros((rows, width), dtype=np.float32)
            part[own[a:b], code[a:b] - lo] = 1.0
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def compared(placed: DataFrame, similarity: float) -> DataFrame:
    """(id, link, docs, texts): links of each set found in a pair of blocks. placed: id, weight, root, i, j, side and shingles."""

    def judge(rows: list[tuple]) -> list[tuple]:
        left = [r for r in rows if r[5] != 1]
        right = [r for r in rows if r[5] != 0]
        if not left or not right:
            return []
        sizes = [np.array([len(r[6]) for r in x], dtype=np.float64) for x in (left, right)]
        inter = overlaps([r[6] for r in left], [r[6] for r in right]).astype(np.float64)  # counts, exact in both
        alike = inter * (1 + similarity) >= similarity * (sizes[0][:, None] + sizes[1][None, :]) - 1e-6
        same = left[0][5] == 2
        if same:
            np.fill_diagonal(alike, False)
        out = []
        for own, other, m in ((left, right, alike), *([] if same else [(right, left, alike.T)])):
            ids, weights = np.array([r[0] for r in other], dtype=np.int64), np.array([r[1] for r in other], dtype=np.int64)
            texts, docs = m.sum(axis=1), m @ weights
            first = np.where(m, ids[None, :], np.iinfo(np.int64).max).min(axis=1)
            out += [(r[0], int(f), int(d), int(t)) for r, f, d, t in zip(own, first, docs, texts) if t]
        if any(r[5] != 2 for r in rows) or len(rows) > 2:  # the least partner alone need not connect a block: add a spanning forest
            out += [(left[i][0], right[j][0], 0, 0) for i, j in forest(alike)]
        return out

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_blas_thread()
        at, rows = None, []
        for pdf in it:
            out = []
            for r in zip(pdf["id"], pdf["weight"], pdf["root"], pdf["i"], pdf["j"], pdf["side"], pdf["shingles"]):
                if r[2:5] != at:
                    out += judge(rows) if rows else []
                    at, rows = r[2:5], []
                rows.append((*r[:6], np.asarray(r[6], dtype=np.int64).view(np.uint64)))
            yield pd.DataFrame(out, columns=["id", "link", "docs", "texts"], dtype="int64")
        if rows:
            yield pd.DataFrame(judge(rows), columns=["id", "link", "docs", "texts"], dtype="int64")

    return placed.mapInPandas(batches, "id long, link long, docs long, texts long")


def forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect whatever the bipartite graph connects: a breadth-first search over rows."""
    out, left_new, right_new = [], np.ones(alike.shape[0], dtype=bool), np.ones(alike.shape[1], dtype=bool)
    for start in range(alike.shape[0]):
        if not left_new[start]:
            continue
        left_new[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            fresh = np.nonzero(alike[i] & right_new)[0]
            right_new[fresh] = False
            out += [(i, int(j)) for j in fresh]
            for j in fresh:
                rows = np.nonzero(alike[:, j] & left_new)[0]
                left_new[rows] = False
                out += [(int(k), int(j)) for k in rows]
                queue += rows.tolist()
    return out


def near_duplicates(df: DataFrame, similarity: float = 0.8, recall: float = 0.995, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, class_id (least id of the class), n_links (other documents at the similarity or more) and n_text_links (other shingle sets) of every row."""
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_sets = cut(sketched(docs, similarity, runs_for(recall), words))
    reps = cut(all_sets.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("weight"), F.max("n").alias("n")))
    sets = all_sets.join(reps, ["hi", "lo"]).where("id = rep").dropDuplicates(["id"]).select("id", "sketch", "paths")
    found, large = candidates(sets, similarity)
    maybe = components(found)
    rest = left_over(large, maybe)
    if not rest.isEmpty():
        more = prefix_links(rest, docs, sets, similarity, words)
        maybe = extended(maybe, more)
    members = reps.join(maybe, F.col("rep") == F.col("node")).select(F.col("rep").alias("id"), "weight", "n", "root")
    sizes = members.groupBy("root").agg(F.ceil(F.sum(F.greatest("n", F.lit(SHORT))) / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def with_sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [s.view(np.int64) for s in shingle_sets(list(pdf["text"]), words)]
            yield pdf.drop(columns="text").assign(shingles=found)

    texts = members.drop("n").join(docs, "id")
    held = texts.mapInPandas(with_sets, "id long, root long, weight long, blocks int, own int, shingles array<long>")
    # a set goes to every pair of blocks that its own is in: once where there is one block
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("own") == F.col("i"), 0).otherwise(1)
    placed = held.select("id", "weight", "root", "own", F.explode(pairs).alias("p"), "shingles").select("id", "weight", "root", "own", "p.i", "p.j", "shingles")
    placed = placed.select("id", "weight", "root", "i", "j", side.alias("side"), "shingles").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "id")
    judged = cut(compared(placed, similarity))
    roots = components(judged.select(F.col("id").alias("a"), F.col("link").alias("b")))
    degree = judged.groupBy("id").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    per_set = reps.join(roots, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("id"), "left")
    per_set = per_set.select("hi", "lo", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    per_doc = all_sets.select("id", "hi", "lo").join(per_set, ["hi", "lo"]).select("id", "class_id", "n_links", "n_text_links").dropDuplicates(["id"])
    out = df.select(F.col(id_col)).join(per_doc, F.col(id_col) == F.col("id"), "left")
    return out.select(
        F.col(id_col), F.coalesce("class_id", F.col(id_col).cast("long")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def keep_one(df: DataFrame, similarity: float = 0.8, recall: float = 0.995, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the least of their class, and those without an id."""
    gone = near_duplicates(df, similarity, recall, words, id_col, text_col).where(F.col("class_id") != F.col(id_col)).select(id_col).distinct()
    return df.join(gone, id_col, "left_anti")
