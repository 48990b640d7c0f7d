"""Operator 7, embedding near-dedup by E8 lattice hashing.

A table projects the unit vectors at random onto two blocks of eight coordinates and decodes each block to its
nearest point of the E8 lattice; the two points, with the label, are a vector's cell.  A vector is filed in its
cell and looked up in the neighbouring cells that it is nearest to.  The vectors of a cell are verified by their
cosine, and links that connect them are kept.  All links of a vector lie in its component, so a second pass over the
components counts them.

Equal vectors of one label are one class, which counts as often as it occurs.  Cells and components above a block
are split into blocks that meet pairwise, so none is gathered in one task.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import components, cut, table
from lithograph.llm.vectors import dimension, matrix
from lithograph.llm.words import mix

#: How near to the threshold a product of matrices leaves open on which side a cosine is.
_OPEN = 1e-12


def e8_roots() -> np.ndarray:
    """The 240 lattice points nearest to the origin."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum: the worst-rounded coordinate goes the other way where the sum is odd."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def e8_decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, integers of even sum or these moved by one half, to each row of eight."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


class Tables:
    """The hash tables of vectors of one dimension."""

    def __init__(self, dim: int, tables: int, probes: int, scale: float, blocks: int = 2):
        draw = np.random.Generator(np.random.PCG64(811))
        self.planes = draw.standard_normal((tables, blocks, dim, 8)) * scale
        self.weights = draw.integers(1, 2**63, (tables, blocks, 8), dtype=np.uint64) | np.uint64(1)
        self.probes, self.roots = probes, e8_roots()

    def cells(self, unit: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """[row, table, 1 + probes]: the codes of the home cell and of the nearest neighbours; seed: a number of each row's label."""
        n, (tables, blocks) = len(unit), self.planes.shape[:2]
        out = np.empty((n, tables, 1 + self.probes), np.uint64)
        for t in range(tables):
            points, gains, shifts = np.zeros(n, np.uint64), [], []
            for b in range(blocks):
                x = unit @ self.planes[t, b]
                p = e8_decode(x)
                weight = self.weights[t, b]
                points += ((2 * p).astype(np.int64).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
                gains.append((x - p) @ self.roots.T)
                shifts.append(((2 * self.roots).astype(np.int64).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64))
            gain, shift = np.concatenate(gains, axis=1), np.concatenate(shifts)
            nearest = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes]
            out[:, t, 0] = points
            out[:, t, 1:] = points[:, None] + shift[nearest]
            out[:, t] = mix(out[:, t] + mix(seed + np.uint64(t + 1))[:, None])
        return out


def connecting(unit: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links, of cosine `least` or more, that connect all rows which such links connect; a leader's rows aren't compared again."""
    n = len(unit)
    root = np.arange(n)
    links = []
    for i in range(n):
        rest = np.flatnonzero(root != root[i])
        if not len(rest):
            break
        for j in rest[_linked(unit[rest], unit[i : i + 1], least)[:, 0]]:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each row of a with each of b is least at least; near the threshold a sum in one fixed order decides."""
    cosine = a @ b.T
    out = cosine >= least
    for i, j in np.argwhere(np.abs(cosine - least) <= _OPEN):
        out[i, j] = np.cumsum(a[i] * b[j])[-1] >= least
    return out


def _units(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows, _ = matrix(column, dim)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, tables: int = 6, probes: int = 3, scale: float = 0.5, block: int = 4096, key: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """Link the vectors of equal, non-null labels whose cosine in double precision is `least` at least.

    Returns key, n_links (other rows linked directly), component_id (the least key that links reach) and kept (key =
    component_id), one row per row of vectors.  Vectors that are null, zero, hold null or non-finite numbers, have
    another length than most, or have no label are linked with nothing.  Equal rows are linked rows of their own.
    Links below `least` don't occur; recall is measured in the tests.
    """
    dim = dimension(vectors, embedding)
    bare = vectors.select(vectors[key].cast("long").alias("k"), vectors[embedding].alias("v"), vectors[label].cast("string").alias("l"))

    def classed(batches):
        for batch in batches:
            rows, usable = matrix(batch.column("v"), dim)
            names = batch.column("l").to_pylist()
            c = [xxhash.xxh3_64_intdigest(f"{x}\0".encode() + r.tobytes()) if ok and x is not None else None for x, r, ok in zip(names, rows, usable)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(c, pa.uint64()).cast(pa.int64(), safe=False), batch.column("l"), batch.column("v")], names=["k", "c", "l", "v"])

    kind = bare.schema["v"].dataType.simpleString()
    base = cut(bare.mapInArrow(classed, f"k long, c long, l string, v {kind}"))
    classes = cut(base.where("c is not null").groupBy("c").agg(F.min("k").alias("rep"), F.count("*").alias("times"), F.first("l").alias("l"), F.first("v").alias("v")))

    def filed(batches):
        hashing = Tables(dim, tables, probes, scale)
        for batch in batches:
            unit = _units(batch.column("v"), dim)
            seed = np.array([xxhash.xxh3_64_intdigest(x) for x in batch.column("l").to_pylist()], np.uint64)
            codes = hashing.cells(unit, seed)
            each = tables * (1 + probes)
            home = np.tile(np.arange(each) % (1 + probes) == 0, len(unit))
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.reshape(-1).view(np.int64)), batch.column("c").take(pa.array(np.repeat(np.arange(len(unit)), each))), pa.array(home)], names=["cell", "c", "home"]
            )

    cells = classes.select("c", "l", "v").mapInArrow(filed, "cell long, c long, home boolean")
    shared = (
        cells.groupBy("cell")
        .agg(F.count("*").alias("n"), F.bool_or("home").alias("some"))
        .where("n > 1 and some")
        .select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    met = _block_pairs(cells.select("cell", "c").join(shared, "cell"), "cell").join(classes.select("c", "v"), "c")
    count = classes.count()
    buckets = max(8, count * tables // 4000)

    def verified(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("cell", "ascending"), ("x", "ascending"), ("y", "ascending"), ("c", "ascending")])
        unit, c = _units(rows.column("v"), dim), np.asarray(rows.column("c"))
        group = np.stack([np.asarray(rows.column(n)) for n in ("cell", "x", "y")])
        at = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [len(c)]])
        a, b = [], []
        for lo, hi in zip(at, at[1:]):
            if hi - lo > 1:
                for i, j in connecting(unit[lo:hi], least):
                    if c[lo + i] != c[lo + j]:
                        a.append(c[lo + i])
                        b.append(c[lo + j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = met.withColumn("bucket", F.pmod(F.xxhash64("cell", "x", "y"), F.lit(buckets))).groupBy("bucket").applyInArrow(verified, "a long, b long").distinct()
    stars = cut(components(links))
    groups = cut(stars.withColumnRenamed("id", "c").join(classes.select("c", "rep", "times"), "c"))
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    parts = _block_pairs(groups.select("component", "c", "times").join(sizes, "component"), "component").join(classes.select("c", "v"), "c")

    def counted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("component", "ascending"), ("x", "ascending"), ("y", "ascending"), ("b", "ascending")])
        unit, c, times = _units(rows.column("v"), dim), np.asarray(rows.column("c")), np.asarray(rows.column("times"))
        group = np.stack([np.asarray(rows.column(n)) for n in ("component", "x", "y")])
        at = np.concatenate([[0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [len(c)]])
        own = np.asarray(rows.column("b"))
        out = np.zeros(len(c), np.int64)
        for lo, hi in zip(at, at[1:]):
            x, y = group[1, lo], group[2, lo]
            mid = lo + int((own[lo:hi] == x).sum())  # the first block's rows, then the second's
            first, second = (slice(lo, hi), slice(lo, hi)) if x == y else (slice(lo, mid), slice(mid, hi))
            for i in range(first.start, first.stop, 1024):
                part = slice(i, min(i + 1024, first.stop))
                near = _linked(unit[part], unit[second], least)
                out[part] += near @ times[second]
                if x != y:
                    out[second] += times[part] @ near
        return pa.table([pa.array(c), pa.array(out)], names=["c", "near"])

    near = (
        parts.withColumn("bucket", F.pmod(F.xxhash64("component", "x", "y"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(counted, "c long, near long")
        .groupBy("c")
        .agg(F.sum("near").alias("near"))
    )
    least_key = groups.groupBy("component").agg(F.min("rep").alias("least"))
    linked = groups.join(least_key, "component").join(near, "c").select("c", "least", "near")
    ids = classes.select("c", "rep", "times").join(linked, "c", "left").select("c", F.coalesce("least", "rep").alias("least"), (F.coalesce("near", "times") - 1).alias("n_links"))
    out = base.select("k", "c").join(ids, "c", "left")
    top = F.coalesce("least", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), top.alias("component_id"), F.coalesce(F.col("k") == top, F.lit(True)).alias("kept"))


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """Each row once for each pair (x, y) of its group's blocks that its own block b is part of; rows have blocks, the number of them."""
    return (
        rows.withColumn("b", F.pmod(F.xxhash64("c", F.lit(7)), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("b", "o"))
        .withColumn("y", F.greatest("b", "o"))
        .drop("o", "blocks")
    )


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_lattice": op7_lattice}
#: The same in SQL, every pair of one label compared: for small tables.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
), u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.93
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1) USING (vec_id)
"""
ORACLES = {"op7_lattice": SQL}
