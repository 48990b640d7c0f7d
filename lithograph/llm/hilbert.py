"""Operator 8, approximate nearest neighbours by shifted space-filling curves.

Vectors are projected at random to a few dimensions; each of several Hilbert curves, over a grid shifted its own
way, puts them in one order.  Each order is cut at its quantiles into ranges of about equally many vectors.  A query
meets the vectors of its own range and of the ranges next to it, over the ranges' edges, on every curve; what the curves' windows hold is
merged and reranked by inner product.  A window is a share of the rows, so recall does not fall as they grow; the price is that the
work is queries times that share of the rows (see the README for recall and cost).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import cut, table
from lithograph.llm.vectors import dimension, matrix


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of grid coordinates, each below 2**bits; all bits together under 64.

    Gray-code method of Skilling (2004): coordinates are turned, from the coarsest bit on, into the curve's own frame.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """Several Hilbert orderings of unit directions: projections to `axes` dimensions on grids that are shifted and turned."""

    def __init__(self, dim: int, curves: int, axes: int = 6, bits: int = 10):
        draw = np.random.Generator(np.random.PCG64(1891))
        self.planes = draw.standard_normal((curves, dim, axes))
        self.shifts = draw.uniform(0, 1, (curves, axes))
        self.bits = bits

    def keys(self, rows: np.ndarray, curve: int) -> np.ndarray:
        unit = rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        # a projected coordinate is about normal; eight deviations and the shift span the grid
        side = (np.clip(unit @ self.planes[curve], -4, 4) + 4) / 9 + self.shifts[curve] / 9
        return hilbert_index(np.minimum((side * 2**self.bits).astype(np.int64), 2**self.bits - 1), self.bits)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _dots(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that a pair has one score on every curve."""
    return np.einsum("ij,j->i", rows, q)


def _best(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, questions: np.ndarray, k: int):
    """(query, row, score) places of each question's k best rows, a few hundred questions at a time."""
    size = np.sqrt(np.einsum("ij,ij->i", rows, rows)).max(initial=0.0)
    for at in range(0, len(qids), 256):
        x = questions[at : at + 256]
        slack = 1e-12 * size * np.sqrt(np.einsum("ij,ij->i", x, x))
        for i, s in enumerate(x @ rows.T):
            s[ids == qids[at + i]] = -np.inf
            floor = np.partition(s, len(s) - k)[len(s) - k] - slack[i] if len(s) > k else -np.inf
            near = np.flatnonzero((s >= floor) & (s > -np.inf))
            score = _dots(x[i], rows[near])
            for j in _top(ids[near], score, k):
                yield qids[at + i], ids[near[j]], score[j]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    curves: int = 8,
    ranges: int = 32,
    reach: int = 2,
    least: int = 1024,
    block: int = 2048,
    query_block: int = 1024,
    key: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k nearest vectors, by inner product in double precision, of each query but the query's own key.

    Returns query_id, rank (from 1; ties to the smaller key), vec_id and score; all candidates where there are
    fewer than k.  Each curve is cut into `ranges` ranges, of `least` vectors at least, and a query meets its own and `reach` on both
    sides.  With curves=1 and reach=ranges the search is exact.  Vectors that are null, zero, hold null or non-finite
    numbers, or have another length than most take no part, as queries and as candidates; so do null keys.  Rows that
    repeat a key are candidates of their own if their scores differ; queries that repeat one ask together.  No task
    holds more than about `block` vectors and `query_block` queries at once: larger ranges, as equal vectors make them, are dealt in pieces.
    """
    dim = dimension(vectors, embedding)

    def bare(df, asks):
        return df.select(df[key].cast("long").alias("id"), df[embedding].alias("v"), F.lit(asks).alias("q")).where("id is not null and v is not null")

    kind = vectors.schema[embedding].dataType.simpleString()

    def placed(batches):
        order = Curves(dim, curves)
        for batch in batches:
            x, usable = matrix(batch.column("v"), dim)
            batch, x = batch.take(pa.array(np.flatnonzero(usable))), x[usable]
            at = np.stack([order.keys(x, c) for c in range(curves)], axis=1) if len(x) else np.zeros((0, curves), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, curves, dtype=np.int32)), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "q", "at"])

    rows = cut(bare(vectors, False).union(bare(queries, True)).distinct().mapInArrow(placed, f"id long, v {kind}, q boolean, at array<long>"))
    edges = _edges(rows.where("not q"), curves, ranges, least)

    # a range is the number of edges that a place has reached
    number = [F.struct(F.lit(c).alias("curve"), sum(((F.col("at")[c] >= e).cast("int") for e in edges[c]), F.lit(0)).alias("range")) for c in range(curves)]
    dealt = rows.select("id", "v", "q", F.explode(F.array(*number)).alias("place")).select("id", "v", "q", "place.curve", "place.range", F.xxhash64("id", "v").alias("salt"))
    sizes = {(r.curve, r.range, r.q): r["count"] for r in dealt.groupBy("curve", "range", "q").count().collect()}  # 2 * curves * ranges rows at most
    pieces = []
    for (c, r, q), n in sizes.items():
        asks = sum(sizes.get((c, s, True), 0) for s in range(r - reach, r + reach + 1))
        if not q and asks:
            pieces.append((c, r, -(-n // block), -(-asks // query_block)))
    plan = F.broadcast(rows.sparkSession.createDataFrame(pieces, "curve int, range int, pieces int, parts int"))

    # every piece of a range meets every part of the queries around it
    by = ["curve", "range", "piece", "part"]
    data = dealt.where("not q").join(plan, ["curve", "range"]).select("id", "v", "curve", "range", F.expr("cast(pmod(salt, pieces) as int) piece"), F.expr("explode(sequence(0, parts - 1)) part"))
    around = dealt.where("q").withColumn("range", F.explode(F.sequence(F.col("range") - reach, F.col("range") + reach)))
    asked = around.join(plan, ["curve", "range"]).select(*(F.col(c).alias(c) for c in ("id", "v", "curve", "range")), F.expr("explode(sequence(0, pieces - 1)) piece"), F.expr("cast(pmod(salt, parts) as int) part"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, _), (y, _) = matrix(left.column("v"), dim), matrix(right.column("v"), dim)
        found = list(_best(np.asarray(left.column("id")), x, np.asarray(right.column("id")), y, k)) if len(x) else []
        a, b, s = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    near = data.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(met, "query_id long, vec_id long, score double")
    # a pair that several curves found has one score, so one dense rank; most rows go before the shuffle
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()


def _edges(rows: DataFrame, curves: int, ranges: int, least: int) -> list[list[int]]:
    """Each curve's places between its ranges: its quantiles, each once; ranges * curves numbers at most."""
    parts = min(ranges, rows.count() // least)
    if parts < 2:
        return [[] for _ in range(curves)]
    shares = [i / parts for i in range(1, parts)]
    found = rows.select(F.posexplode("at").alias("curve", "place")).groupBy("curve").agg(F.percentile_approx("place", shares, 10000).alias("edges")).collect()
    by_curve = {r.curve: sorted(set(r.edges)) for r in found}
    return [by_curve[c] for c in range(curves)]


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {"op8_hilbert": op8_hilbert}
ORACLES: dict[str, str] = {}
