"""What several operators share: reading tables, cutting lineage, connected components, text batches."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators.state import shared_folder

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# of the GNU C library; None elsewhere
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage: a reliable checkpoint in the folder that spark.checkpoint.dir names.

    The shuffle files that led to the checkpoint
    go once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.select("*")  # a query takes the setting when it is made
    finally:
        spark.conf.set(_CLEAN, before)
    return out.checkpoint(eager=True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each endpoint of edges (a, b) reaches; ids without an edge don't appear.

    Each id points to the least of its smaller neighbours.  A round hooks an id's other smaller neighbours to that one
    and lets every id jump to where its own points, until nothing moves.  A round is a grouped minimum and two joins,
    so a hub's neighbours are never gathered in one place; it is checkpointed, and the driver sees two numbers of it.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        points = pairs.groupBy("u").agg(F.min("v").alias("p"))
        hooked = pairs.join(points, "u").where("v <> p").select(F.col("v").alias("u"), F.col("p").alias("v")).distinct()
        ahead = points.select(F.col("u").alias("p"), F.col("p").alias("further"))
        jumped = points.join(ahead, "p", "left").select("u", F.coalesce("further", "p").alias("v"))
        pairs = cut(jumped.union(hooked))
        before, state = state, pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def give_back() -> None:
    """What this process has freed goes back to the system: Python workers are kept from task to task, and their free memory with them."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def giving_back(f: Callable) -> Callable:
    """A function of groups that gives back what each group leaves free."""

    @functools.wraps(f)
    def run(*args):
        try:
            return f(*args)
        finally:
            give_back()

    run.__signature__ = inspect.signature(f)  # Spark counts the arguments
    return run


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text each; one row may be longer.  After each given batch free memory is given back."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
        part = np.cumsum(sizes) // most_bytes
        at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        give_back()
