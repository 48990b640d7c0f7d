"""Operator 11, hard-negative mining by a block matrix multiply in two dimensions (SUMMA).

Rows are dealt into blocks by a hash of their id, and each block is cut into shards of a few dimensions; so are the anchors.
The score matrix, anchors by rows, is a grid of tiles.  Each shard of anchors travels along its row of the grid and each shard of
rows along its column; where the two of one dimension chunk meet, a task multiplies them to a partial tile of 64-bit
integers.  Partial tiles are shuffled to their tile and added, so no task ever holds a whole row or column.  From each finished tile an
anchor's best rows of its own label are kept; the tiles' best are merged to its positives.  Then every tile gives, for each
pair of an anchor and a positive, its best rows of other labels within the pair's window of scores, and these are merged too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import cut, table

#: Components farther out than this count as this far.
MOST = 1 << 62


def packed(values: np.ndarray) -> bytes:
    """Integers (64 bits, one or two dimensions) as bytes: like bytes of all numbers side by side, then compressed."""
    values = np.ascontiguousarray(values, "<i8")
    head = np.array([values.ndim, *values.shape], "<i8").tobytes()
    return head + zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    shape = np.frombuffer(data, "<i8", n, 8)
    size = int(np.prod(shape))
    raw = zstandard.ZstdDecompressor().decompress(data[8 + 8 * n :], max_output_size=max(1, 8 * size))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view("<i8").reshape(shape)


def _framed(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i8", n, 8)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def integers(lists: list, scale: int) -> list[np.ndarray]:
    """floor(scale * x) of each component, as 64-bit integers."""
    out = []
    for x in lists:
        v = np.floor(np.asarray(x, np.float64) * scale)
        # 2**62 is a double, so what lies within the bounds converts as it is
        out.append(np.clip(v, -float(MOST), float(MOST)).astype(np.int64))
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by doubles where all sums are exact in them."""
    top = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if top[0] * top[1] * max(1, a.shape[1]) < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n best allowed entries of each row of scores: higher scores first, then smaller ids; all, if fewer."""
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, low)
    if masked.shape[1] > n:
        # whatever reaches the n-th best score may be among the best, ties included
        least = np.partition(masked, masked.shape[1] - n, axis=1)[:, masked.shape[1] - n]
        allowed = allowed & (masked >= least[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], ~scores[row, col], row))  # ~x falls as x grows and can't overflow
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n]


def _shard(width: int, scale: int, side: int):
    """A function of one block's rows (id, label, vec) to its shards, one for each `width` dimensions."""

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        vec = integers(rows.column("vec").to_pylist(), scale)
        ids, labels = rows.column("id").to_pylist(), rows.column("label").to_pylist()
        once = sorted({(a, b, v.tobytes()) for a, b, v in zip(ids, labels, vec)})
        length = max((len(v) // 8 for _, _, v in once), default=0)
        out = {"i": [], "k": [], "data": []}
        head = [packed(np.array([r[c] for r in once], np.int64)) for c in (0, 1)]
        for k in range(max(1, -(-length // width))):
            part = np.zeros((len(once), width), np.int64)
            for at, (_, _, v) in enumerate(once):
                piece = np.frombuffer(v, np.int64)[k * width : (k + 1) * width]
                part[at, : len(piece)] = piece
            for c, v in zip(out, (name[0].as_py(), k, _framed(*(head if k == 0 else [b"", b""]), packed(part)))):
                out[c].append(v)
        n = len(out["k"])
        return pa.table([pa.array(out["i"], pa.int32()), pa.array(out["k"], pa.int32()), pa.array([side] * n, pa.int32()), pa.array(out["data"], pa.binary())], names=["b", "k", "side", "data"])

    return run


def _multiply(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The partial tile of one dimension chunk; chunk 0 also carries ids and labels of both sides."""
    got = {s: _parts(d) for s, d in zip(rows.column("side").to_pylist(), rows.column("data").to_pylist())}
    data = []
    if len(got) == 2:
        data.append(_framed(packed(product(unpacked(got[0][2]), unpacked(got[1][2]))), got[0][0], got[0][1], got[1][0], got[1][1]))
    ij = [pa.array([name[c].as_py()] * len(data), pa.int32()) for c in (0, 1)]
    return pa.table([*ij, pa.array(data, pa.binary())], names=["i", "j", "data"])


def _add(positives: int):
    """A function of a tile's partial tiles to their sum, with each anchor's best rows of its own label in it."""

    def run(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total, meta = None, None
        for data in rows.column("data"):
            parts = _parts(data.as_py())
            part = unpacked(parts[0])
            total = part if total is None else total + part
            meta = parts[1:] if parts[1] else meta
        anchor, anchor_label, ids, label = map(unpacked, meta)
        row, col = best(total, ids, (anchor_label[:, None] == label) & (anchor[:, None] != ids), positives)
        found = packed(np.stack([row, ids[col], total[row, col]]))
        ij = [pa.array([name[c].as_py()], pa.int32()) for c in (0, 1)]
        return pa.table([*ij, pa.array([_framed(packed(total), *meta)], pa.binary()), pa.array([found], pa.binary())], names=["i", "j", "data", "found"])

    return run


def _candidates(batches):
    for batch in batches:
        for i, data in zip(batch.column("i"), batch.column("found")):
            row, ids, score = unpacked(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i.as_py()), pa.int32()), pa.array(row, pa.int32()), pa.array(ids), pa.array(score)], names=["i", "a", "id", "score"])


def _negatives(least_percent: int, most_percent: int, n: int):
    """A function of tiles with their anchors' positives to the best rows of other labels in each window."""

    def run(batches):
        for batch in batches:
            for data, i, known in zip(batch.column("data"), batch.column("i"), batch.column("positives")):
                total, anchor, anchor_label, ids, label = map(unpacked, _parts(data.as_py()))
                other = anchor_label[:, None] != label
                known = known.as_py()
                for rank in sorted({p["p"] for p in known}):
                    mine = sorted((p["a"], p["id"], p["score"]) for p in known if p["p"] == rank)
                    a, positive, score = (np.array(c, np.int64) for c in zip(*mine))
                    # whole numbers: 100 * x >= least * s and 100 * x <= most * s, by quotient and rest so that nothing overflows
                    low = least_percent * (score // 100) - (-(least_percent * (score % 100)) // 100)
                    high = most_percent * (score // 100) + most_percent * (score % 100) // 100
                    mask = other[a] & (total[a] >= low[:, None]) & (total[a] <= high[:, None])
                    row, col = best(total[a], ids, mask, n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), i.as_py()), pa.int32()), pa.array(a[row], pa.int32()), pa.array(np.full(len(row), rank), pa.int32()), *(pa.array(x) for x in (anchor[a[row]], positive[row], ids[col], score[row], total[a[row], col]))],
                        names=["i", "a", "p", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
                    )

    return run


def mine(
    rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100,
    scale: int = 256, width: int = 32, anchor_block: int = 512, row_block: int = 2048,
) -> DataFrame:
    """Hard negatives of the rows (vec_id, embedding, label) for which the SQL condition `anchor` holds.

    Scores are inner products of floor(scale * x), exact in 64 bits (they wrap beyond; components count as 2**62 at most).  An
    anchor's positives are its `positives` best other rows of its label; for each, the result has the `negatives` best
    rows of other labels with least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score.
    Higher scores come first, then smaller ids.  Rows with a null id, label or vector, or with a component that is null or not
    finite, take no part.  A shorter vector counts as filled up with zeros, an empty one scores 0.  Rows that are
    equal in all three count once; others that share an id are rows of their own, but never candidates of an anchor with that id.
    No rows or no anchors give an empty result, and other columns are not looked at.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    plain = usable.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"), F.expr(anchor).alias("is_anchor"))
    size = plain.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    down, across = max(1, -(-size.a // anchor_block)), max(1, -(-size.n // row_block))
    shard = "b int, k int, side int, data binary"

    def shards(df: DataFrame, blocks: int, side: int) -> DataFrame:
        dealt = df.select("id", "label", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
        return dealt.groupBy("b").applyInArrow(_shard(width, scale, side), shard)

    def along(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = shards(plain.where("is_anchor"), down, 0).select(F.col("b").alias("i"), along(across).alias("j"), "k", "side", "data")
    right = shards(plain, across, 1).select(along(down).alias("i"), F.col("b").alias("j"), "k", "side", "data")
    partial = left.union(right).groupBy("i", "j", "k").applyInArrow(_multiply, "i int, j int, data binary")
    tiles = cut(partial.groupBy("i", "j").applyInArrow(_add(positives), "i int, j int, data binary, found binary"))
    first = Window.partitionBy("i", "a").orderBy(F.desc("score"), "id")
    merged = tiles.select("i", "found").mapInArrow(_candidates, "i int, a int, id long, score long").withColumn("p", F.row_number().over(first)).where(F.col("p") <= positives)
    # a block has anchor_block anchors or about as many, each with a few positives
    known = merged.groupBy("i").agg(F.collect_list(F.struct("a", "p", "id", "score")).alias("positives"))
    shape = "i int, a int, p int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = tiles.select("i", "data").join(known, "i").select("data", "i", "positives").mapInArrow(_negatives(least_percent, most_percent, negatives), shape)
    nearest = Window.partitionBy("i", "a", "p").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(e.select("vec_id", "embedding", moved.alias("label")), "vec_id % 100 = 0")


#: The same by all products of anchors and rows: for small tables.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum([a.q[i] * b.q[i] FOR i IN range(1, 1 + least(len(a.q), len(b.q)))])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": SQL}
