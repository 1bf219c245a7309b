"""Helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import glob
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether the shuffle files of a query go when it has run; else they stay until the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside leave no shuffle files."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the session's shared folder; its shuffle files go.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset,
    as in tests, one beside the warehouse is used.
    """
    checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint()  # a new frame, as the setting is read when one is made


def checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """The frame, cut, with a broadcast hint where its rows are few; beyond that the join shuffles. Its rows must be narrow."""
    df = cut(df)
    with released(df.sparkSession):
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@functools.lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Lets this worker's numpy multiply in one thread: tasks are the parallelism, and waiting threads burn the other tasks' cores."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
