"""Language-model scores of whole documents (operator 9).

Counts of all training words come first. Every document is then coded once: the
commonest words and the end have ids, other words the id of an open class given
by their last two characters. Tasks train copies of one recurrent model on their
own share of every training document's segments; the copies are averaged after
each round. Scoring carries the state from window to window to the end of each
document. The model's probability of a word of an open class is that of the class
given the state, times the word's smoothed share of the class's training count;
counts of rare words come by a join, so no vocabulary is broadcast whole.

Parameters that bound what travels: ``words`` modelled words and ``frequent`` words
whose counts go along with the tasks.

Defined cases: null and empty texts are the end token alone; null ids count as
empty text for the split; repeated rows are scored each; without training
documents all counts are zero and the model keeps its initial weights; an empty
table gives no rows; a text of any length is one row, scored window by window. Of
the input's columns only the id and the text are read, so the others may have any
name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm import gru
from tributary.llm.common import cut, one_blas_thread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES, OPEN = 32, 32
#: Lanes of a training batch, at most, and tokens of a lane, at least; texts that are held at once.
STREAMS, LANE, SLICE = 256, 256, 2000


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode().lower().decode()


def open_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % OPEN


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents. docs: text, held_out."""
    words = docs.where("not held_out").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    ascii_ = F.octet_length("word") == F.char_length("word")
    words = words.select(F.when(ascii_, F.lower("word")).otherwise(F.translate("word", UPPER, LOWER)).alias("word"))  # translate is slow: only where lower would change more than A-Z
    return words.groupBy("word").agg(F.count("*").alias("n"))


def commonest(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words above the least count that at most ``most`` words reach, commonest first.

    The count comes from a histogram of counts, so no task sends more than its own
    share of the result to the driver.
    """
    above = F.sum("words").over(Window.orderBy(F.desc("n")))  # a row for each distinct count
    least = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("above", above).where(F.col("above") <= most).agg(F.min("n")).first()[0]
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    return sorted(((r["word"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def coded(docs: DataFrame, frequent: list[tuple[str, int]], words: int, ends: int, log_share: np.ndarray) -> DataFrame:
    """Each document's token ids and its sums over frequent words; its rare words with how often they occur."""
    index = {w: i for i, (w, _) in enumerate(frequent)}
    log_n = np.log10(np.array([n for _, n in frequent], dtype=np.float64) + 0.5)
    log_end = math.log10(ends + 0.5)
    modelled = min(len(frequent), words - 1)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for lo in range(0, len(pdf), SLICE):
                part = pdf.iloc[lo : lo + SLICE]
                split = [_WORD.findall(lowered(t)) for t in part["text"]]
                flat = np.empty(sum(map(len, split)), dtype=object)
                flat[:] = [w for ws in split for w in ws]
                codes, distinct = pd.factorize(flat)
                at = np.fromiter((index.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
                group = np.fromiter((open_class(w) for w in distinct), dtype=np.int64, count=len(distinct))
                ids = np.where((at >= 0) & (at < modelled), at + 1, words + group)
                known = np.where(at >= 0, log_n[np.maximum(at, 0)], 0.0) if len(log_n) else np.zeros(len(at))
                is_open = ids >= words
                share = np.where(is_open, log_share[group], 0.0)
                rows, a = [], 0
                for ws in split:
                    own = codes[a : a + len(ws)]
                    a += len(ws)
                    rare, times = np.unique(own[at[own] < 0], return_counts=True)
                    rows.append((
                        len(ws) + 1, np.append(ids[own], 0).astype(np.uint16).tobytes(), float(known[own].sum()) + log_end,
                        float((known * is_open)[own].sum() - share[own].sum()), int((at[own] >= 0).sum()) + (ends > 0), [distinct[i] for i in rare], times.tolist(),
                    ))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids", "log_frequent", "log_open", "n_frequent", "rare", "times"])
                yield pd.concat([part[["id", "held_out"]].reset_index(drop=True), out], axis=1)

    return docs.mapInPandas(batches, "id string, held_out boolean, n_tokens long, ids binary, log_frequent double, log_open double, n_frequent long, rare array<string>, times array<long>")


def batches_of(it: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lanes of the documents of each batch of rows."""
    for pdf in it:
        if len(pdf):
            texts = [np.frombuffer(raw, dtype=np.uint16) for raw in pdf["ids"]]
            yield gru.lanes(texts, max(1, min(STREAMS, sum(map(len, texts)) // LANE)))


def pack(p: dict) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def unpack(raw: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(raw, dtype=np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def one_round(docs: DataFrame, p: dict, vocab: gru.Vocabulary, rounds: int, turn: int, rate: float) -> dict:
    """Every task trains a copy on its own documents; the mean, weighted by tokens, in two levels."""

    def trained(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        one_blas_thread()
        q, seen = gru.train(p, vocab, batches_of(it), rate)
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 16], "seen": [seen], "weights": [pack(q)]})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) * n for w, n in zip(pdf["weights"], pdf["seen"]))
        seen = int(pdf["seen"].sum())
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "seen": [seen], "weights": [(total / seen).astype(np.float32).tobytes()]})

    schema = "part int, seen long, weights binary"
    own = ~F.col("held_out") & (F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn)
    rows = docs.where(own).select("ids").mapInPandas(trained, schema).groupBy("part").applyInPandas(mean, schema).collect()  # 16 rows at most
    if not rows:
        return p
    total = sum(np.frombuffer(r["weights"], dtype=np.float32).astype(np.float64) * r["seen"] for r in rows) / sum(r["seen"] for r in rows)
    return unpack(total.astype(np.float32).tobytes(), p)


def score_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 1024, frequent: int = 65_536, rounds: int = 4, rate: float = 0.01
) -> DataFrame:
    """Id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (recurrent model), log10, of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), is_held_out(id_col).alias("held_out"))
    counts = cut(word_counts(docs))
    ends = docs.where("not held_out").count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = totals[0] + ends, totals[1] + (ends > 0)
    top = commonest(counts, frequent)
    modelled = top[: words - 1]
    group = (F.crc32(F.right("word", F.lit(2))) % OPEN).alias("g")
    mass = {r["g"]: (r["n"], r["m"]) for r in counts.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") + 0.5).alias("m")).collect()}
    open_n, open_mass = np.zeros(OPEN), np.full(OPEN, 0.5)
    for g, (a, b) in mass.items():
        open_n[g] += a
        open_mass[g] += b
    for w, c in modelled:
        open_n[open_class(w)] -= c
        open_mass[open_class(w)] -= c + 0.5

    vocab = gru.Vocabulary(words, CLASSES, OPEN)
    seen = np.zeros(vocab.size)
    seen[0], seen[1 : len(modelled) + 1], seen[words:] = ends, [c for _, c in modelled], open_n
    base = cut(coded(docs, top, words, ends, np.log10(open_mass)).withColumn("row", F.monotonically_increasing_id()))
    p = gru.initial(vocab, seen)
    for turn in range(rounds):
        p = one_round(base, p, vocab, rounds, turn, rate / (1 + turn))

    def scored(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_blas_thread()
        for pdf in it:
            got = gru.score(p, vocab, [np.frombuffer(x, dtype=np.uint16) for x in pdf["ids"]])
            yield pdf.drop(columns="ids").assign(model=got / math.log(10))

    model = base.select("row", "id", "held_out", "n_tokens", "n_frequent", "log_frequent", "log_open", "ids").mapInPandas(
        scored, "row long, id string, held_out boolean, n_tokens long, n_frequent long, log_frequent double, log_open double, model double"
    )
    rare = base.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare")
    )
    out = model.join(rare, "row", "left").withColumn("log_rare", F.coalesce("log_rare", F.lit(0.0)))
    return out.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("log_frequent") + F.col("log_rare") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("model") + F.col("log_open") + F.col("log_rare")).alias("score"),
    )
