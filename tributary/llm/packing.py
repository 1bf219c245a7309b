"""Packing token pieces into fixed-length sequences (operator 4).

A document is its ids and one end id. It is cut into whole sequences and one
rest. Rests are dealt to groups of documents by a hash of id and text; inside a group they come in
decreasing length, by Spark's sort, and each goes to the first sequence with
room, found in a tournament tree of the sequences' free space. A task streams
over its sorted rows and holds one group's tree.

Null texts are empty documents (the end id alone). Repeated rows are packed once
each. An empty table packs to no rows. Ties of length go by id and place. A text of any
length is encoded in one task. Of the input's columns only the id and the text are
read, so the others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.tokens import byte_bpe

PIECES = "id string, start long, length long, ids_crc32 long, doc_tokens long, grp long, rest boolean"


class Tournament:
    """Bins in order of opening; each inner node holds the most free space below it."""

    def __init__(self, capacity: int, leaves: int = 64):
        self.capacity, self.leaves, self.used = capacity, leaves, 0
        self.free = [0] * (2 * leaves)

    def _grow(self) -> None:
        leaf = self.free[self.leaves :]
        self.leaves *= 2
        self.free = [0] * self.leaves + leaf + [0] * len(leaf)
        for i in range(self.leaves - 1, 0, -1):
            self.free[i] = max(self.free[2 * i], self.free[2 * i + 1])

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of the first bin with room; a new one if none has."""
        free = self.free
        if free[1] < size:
            if self.used == self.leaves:
                self._grow()
                free = self.free
            i = self.leaves + self.used
            self.used += 1
            free[i] = self.capacity
        else:
            i = 1
            while i < self.leaves:
                i *= 2
                i += free[i] < size
        at, offset = i - self.leaves, self.capacity - free[i]
        free[i] -= size
        while i > 1:
            i //= 2
            free[i] = max(free[2 * i], free[2 * i + 1])
        return at, offset


def token_pieces(df: DataFrame, path: str, seq_len: int, group_docs: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece of each document, with the group its rest was dealt to."""
    groups = max(1, -(-df.count() // group_docs))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path)
        for pdf in it:
            rows = []
            for doc, text, grp in zip(pdf["id"], pdf["text"], pdf["grp"]):
                raw = bpe.buffer(text) + b"\0\0\0\0"
                total = len(raw) // 4
                for a in range(0, total, seq_len):
                    n = min(seq_len, total - a)
                    rows.append((doc, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), total, grp, n < seq_len))
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "grp", "rest"])

    src = df.select(
        F.col(id_col).cast("string").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(groups)).alias("grp"),  # the same again in a task that is run twice
    )
    return src.mapInPandas(batches, PIECES)


def pack(df: DataFrame, path: str, seq_len: int = 1024, group_docs: int = 1024, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset: doc id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = token_pieces(df, path, seq_len, group_docs, seed, id_col, text_col)
    schema = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # whole sequences are numbered by task from 2**62 on, the others by group from 0 on
        part = TaskContext.get().partitionId()
        whole = (1 << 62) + (part << 40)
        grp, tree = None, None
        for pdf in it:
            ids, offsets = [], []
            for g, n, rest in zip(pdf["grp"], pdf["length"], pdf["rest"]):
                if not rest:
                    ids.append(whole)
                    offsets.append(0)
                    whole += 1
                    continue
                if g != grp:
                    grp, tree = g, Tournament(seq_len)
                at, offset = tree.place(n)
                ids.append((g << 24) + at)
                offsets.append(offset)
            out = pdf[["id", "start", "length", "ids_crc32", "doc_tokens"]]
            yield out.assign(sequence_id=pd.Series(ids, dtype="int64"), offset=pd.Series(offsets, dtype="int64"))

    dealt = pieces.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "id", "start")
    out = dealt.mapInPandas(batches, schema)
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), *out.columns[1:])
