"""Operator 2, n-gram Jaccard join by tries over globally ordered n-gram sets.

Texts with the same set of n-grams are one class, and classes are joined.  Candidates come from prefix filters, which
lose no pair.  Sets of a and b n-grams that are similar enough share at least `need(max(a, b))` of them.  In the order of
their hashes, the same for all sets, a class files its first a - need(a) + spare(a) n-grams; two similar classes then
share spare(need(a)) of what they filed.  The filed n-grams are ordered again by how many classes filed them, rarest
first, and all but the last spare(need(a)) - 1 stay: a similar pair still has one of them in common.  Classes
connected by such n-grams form a group.  In each group the whole sets go into one trie, the n-grams that most of the group
hold first, so that near copies share long paths.  The trie is walked once for all sets together: overlaps with a path
are added up as it is shared, a set leaves a subtree once what remains on both sides cannot make the similarity, and it is
linked with a whole subtree once its overlap is enough for every set there.  Every link is decided on the whole sets and counted; components of
the links give the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm import words as W
from lithograph.llm.common import components, cut, giving_back, small_batches, table

#: How many n-grams more than needed are filed, beside three of four of those that a set can do without.
SPARE = 16


def need(size, percent: int):
    """The overlap that a set of this size needs with any other."""
    return -(-size * percent // 100)


def spare(size, percent: int):
    """How many n-grams beyond the first size - need(size) + 1 are filed; it doesn't fall as sizes grow."""
    return np.minimum(need(size, percent), SPARE + (size - need(size, percent)) * 3 // 4)


def filed(size, percent: int):
    """(how many n-grams a set of this size files, how many of them stay)."""
    n = size - need(size, percent) + spare(size, percent)
    return n, n - spare(need(size, percent), percent) + 1


def _digest(s: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def ngram_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(k, th, size, h1, h2, first, filed): each row's set of n-grams by size, digest, how many of those filed stay, and the filed ones.

    docs has k, t and th, a hash of t.
    """

    def run(batches):
        for batch in small_batches(batches, "t"):
            sets = W.shingle_sets(W.split(batch.column("t"), lower=True), n)
            digests = [_digest(s) for s in sets]
            sizes = np.array([len(s) for s in sets], np.int64)
            many, first = filed(sizes, percent)
            low = [s[:m].view(np.int64) for s, m in zip(sets, np.where(sizes > 0, many, 0))]
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    batch.column("th"),
                    pa.array(sizes),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(first),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64))),
                ],
                names=["k", "th", "size", "h1", "h2", "first", "filed"],
            )

    return docs.mapInArrow(run, "k long, th long, size long, h1 long, h2 long, first long, filed array<long>")


def _grams(rows: DataFrame, n: int) -> DataFrame:
    """(group, c, size, gram): the whole sets of rows (component, c, size, t)."""

    def run(batches):
        for batch in small_batches(batches, "t", 1 << 19):
            sets = W.shingle_sets(W.split(batch.column("t"), lower=True), n)
            times = [len(s) for s in sets]
            columns = (np.asarray(batch.column(x)) for x in ("component", "c", "size"))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, times)) for x in columns), pa.array(np.concatenate(sets).view(np.int64))], names=["group", "c", "size", "gram"])

    return rows.mapInArrow(run, "group long, c long, size long, gram long")


def _sharing(held: DataFrame, within: list[str], first: Column, total: Column) -> DataFrame:
    """(c, component) of the classes that an n-gram of their first parts connects, within one group where that is given.

    held has c and gram.  A class's n-grams are ordered by how many classes hold them, the rarest first; `first` of its
    `total` count.  Those that one class alone holds come first and match nothing, so only the others are ordered.
    """
    often = held.groupBy(*within, "gram").agg(F.count("*").alias("df")).where("df > 1")
    common = held.join(often, [*within, "gram"])
    mine = Window.partitionBy("c")
    part = (
        common.withColumn("at", F.row_number().over(mine.orderBy("df", "gram")))
        .withColumn("once", total - F.count("*").over(mine))
        .where(F.col("at") + F.col("once") <= first)
        .select(*within, "c", "gram")
    )
    least = part.groupBy(*within, "gram").agg(F.min("c").alias("m"), F.count("*").alias("n")).where("n > 1")
    edges = part.join(least, [*within, "gram"]).where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b"))
    return components(edges).withColumnRenamed("id", "c")


def _least(a, b, percent: int):
    """The overlap that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def _paths(sets: list[np.ndarray]) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, int]:
    """(which set, path, size, how much of its path each has in common with the one before, distinct n-grams), by path."""
    g = len(sets)
    grams, back, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, -counts))] = np.arange(len(grams))
    sizes = np.array([len(s) for s in sets])
    ordered = [np.sort(x) for x in np.split(place[back], np.cumsum(sizes)[:-1])]
    by_path = sorted(range(g), key=lambda i: ordered[i].astype(">i8").tobytes())
    seqs = [ordered[i] for i in by_path]
    n = sizes[by_path]
    shared = np.zeros(g, np.int64)
    for i in range(1, g):
        m = min(n[i], n[i - 1])
        odd = np.flatnonzero(seqs[i][:m] != seqs[i - 1][:m])
        shared[i] = odd[0] if len(odd) else m
    return by_path, seqs, n, shared, len(grams)


def trie_join(sets: list[np.ndarray], percent: int, weight: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, counts) of the sets whose Jaccard similarity is percent/100 at least.

    The links, each of them exact, connect all sets that such links connect, directly or through others; there are fewer than sets.
    counts has for each set the weight of all others linked with it.  Where side (0 or 1 for each set) is
    given, only sets of different sides count and are linked.
    """
    g = len(sets)
    if g < 2:
        return [], np.zeros(g, np.int64)
    by_path, seqs, n, shared, width = _paths(sets)
    flat, begin = np.concatenate(seqs), np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(g), n)
    path_key = owner * width + flat
    order = np.argsort(flat, kind="stable")
    holder = owner[order]  # the sets that hold each n-gram, by n-gram
    first = np.searchsorted(flat[order], np.arange(width + 1))
    w = np.ones(g, np.int64) if weight is None else np.asarray(weight, np.int64)[by_path]
    own = np.zeros(g, np.int64) if side is None else np.asarray(side, np.int64)[by_path]
    sums = np.zeros((2, g + 1), np.int64)
    for x in (0, 1):
        np.cumsum(w * (own == x), out=sums[x, 1:])
    other = own if side is None else 1 - own
    root, links = np.arange(g), []

    def link(some: np.ndarray, lo: int, hi: int) -> None:
        """Each of some is linked with all of lo..hi that it may be linked with."""
        for x in (0, 1):
            a = some[other[some] == x]
            b = np.arange(lo, hi)[own[lo:hi] == x]
            if len(a) and len(b):
                both = np.concatenate([b, a])
                roots, at = np.unique(root[both], return_index=True)
                if len(roots) > 1:
                    # one of each root: those of b meet a[0], those of a meet b[0]
                    for i in at:
                        u, v = (int(both[i]), int(a[0])) if i < len(b) else (int(both[i]), int(b[0]))
                        if root[u] != root[v]:
                            links.append((by_path[u], by_path[v]))
                            root[root == root[u]] = root[v]

    found = -w if side is None else np.zeros(g, np.int64)  # a set meets itself once
    # (lo, hi, depth, who, overlap): lo..hi share their first depth n-grams; who may still be linked with some of them
    todo = [(0, g, 0, np.arange(g), np.zeros(g, np.int64))]
    while todo:
        lo, hi, depth, who, overlap = todo.pop()
        # the longest path that all of them share, as one step
        to = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else int(n[lo])
        if to > depth:
            step = seqs[lo][depth:to]
            times = first[step + 1] - first[step]
            at = np.repeat(first[step] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            overlap = overlap + np.bincount(holder[at], minlength=g)
        passed = np.searchsorted(path_key, who * width + seqs[lo][to - 1], side="right") - begin[who] if to else 0
        least, most = int(n[lo:hi].min()), int(n[lo:hi].max())
        have = overlap[who]
        sure = have >= _least(n[who], most, percent)
        some = who[sure]
        if len(some):
            found[some] += sums[other[some], hi] - sums[other[some], lo]
            link(some, lo, hi)
        if hi - lo == 1:
            continue
        who = who[~sure & (have + np.minimum(n[who] - passed, most - to) >= _least(n[who], least, percent))]
        if len(who):
            cuts = [lo, *(np.flatnonzero(shared[lo + 1 : hi] <= to) + lo + 1).tolist(), hi]
            todo += [(a, b, to, who, overlap) for a, b in zip(cuts, cuts[1:])]
    out = np.empty(g, np.int64)
    out[by_path] = found
    return links, out


def _class_texts(bare: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (c, rep, th and others) with t, one row a class: the text of the row that stands for it.

    The row is found by its key and its text's hash, so that a key which many rows share brings none of the others.
    """
    mine = rows.withColumnRenamed("th", "h")
    return bare.join(mine, bare["k"].eqNullSafe(mine["rep"]) & (bare["th"] == mine["h"])).drop("k", "h").dropDuplicates(["c"])


def _blocked(bare: DataFrame, groups: DataFrame, block_sets: int, block_grams: int) -> DataFrame:
    """(component, x, y, b, c, times, t): each class's text once for each pair (x, y) of its group's blocks that has its block b."""
    blocks = groups.groupBy("component").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / block_sets), F.ceil(F.sum("size") / block_grams)).cast("int").alias("blocks")
    )
    member = (
        _class_texts(bare, groups.select("component", "c", "times", "rep", "th"))
        .join(blocks, "component")
        .withColumn("b", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "c", "times", "t")
    )
    # groups differ much in work: as many tasks as the session says, whatever their bytes
    return member.repartition(int(bare.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "x", "y")


def join(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", block_sets: int = 400, block_grams: int = 400_000) -> DataFrame:
    """Group the whole texts whose sets of n-grams have a Jaccard similarity of percent/100 at least, for any percent from 1 to 100.

    Returns key, n_shingles, class_id (equal for texts of one set, of one call; null without words), n_links (other rows linked directly,
    those of the same class too) and component_id (the least key that links reach), one row per row of docs.  Words
    are lower-cased in A to Z; a text of fewer words is one n-gram.  A text that is null, empty or blank has an empty set
    and is linked with nothing.  A null key is a row of its own and the least key only where there is no other.  Equal rows
    are linked rows of their own; other columns are not looked at; an empty table gives no rows.  Groups above
    block_sets sets or block_grams n-grams are split by the first parts of the whole sets; what stays together above that
    is compared block by block, each block with every other, by the same trie.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    bare = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).withColumn("th", F.xxhash64("t"))
    sets = ngram_sets(bare, n, percent)
    base = cut(sets.drop("filed", "first"))
    # the sets are worked out once more: to keep what every row files would take more disk than that takes time
    classes = sets.where("size > 0").groupBy("h1", "h2").agg(
        F.min("k").alias("rep"), F.coalesce(F.min_by("th", "k"), F.min("th")).alias("th"), F.count("*").alias("times"), F.first("size").alias("size"), F.first("first").alias("first"), F.first("filed").alias("filed")
    )
    # written, so that a class keeps its number
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()))
    held = classes.select("c", "first", F.size("filed").alias("total"), F.explode("filed").alias("gram"))
    near = _sharing(held, [], F.col("first"), F.col("total"))
    groups = cut(near.join(classes.select("c", "size", "times", "rep", "th"), "c"))
    sized = groups.groupBy("component").agg(((F.count("*") > block_sets) | (F.sum("size") > block_grams)).alias("large"))
    marked = cut(groups.join(sized, "component"))
    # Groups above a block are mostly texts that share a passage and little else.  There the whole sets are ordered, by how
    # many of the group hold an n-gram, and only those that share one in the first part that the similarity needs stay together.
    suspects = marked.where("large").select("component", "c", "size", "times", "rep", "th")
    grams = _grams(_class_texts(bare, suspects).select("component", "c", "size", "t"), n)
    kept = _sharing(grams, ["group"], F.col("size") - F.ceil(F.col("size") * percent / 100) + 1, F.col("size"))
    groups = cut(marked.where("not large").drop("large").unionByName(kept.join(suspects.drop("component"), "c")))

    @giving_back
    def run(rows: pa.Table) -> pa.Table:
        """Links (a, b), and (a, null, near): what a class's row counts in this pair of blocks."""
        c, block = np.asarray(rows.column("c")), np.asarray(rows.column("b"))
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        sets = W.shingle_sets(W.split(rows.column("t").combine_chunks(), lower=True), n)
        links, near = trie_join(sets, percent, np.asarray(rows.column("times")), None if x == y else block == y)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        some = np.flatnonzero(near)
        a, b = np.concatenate([c[pairs[:, 0]], c[some]]), pa.concat_arrays([pa.array(c[pairs[:, 1]], pa.int64()), pa.nulls(len(some), pa.int64())])
        return pa.table([pa.array(a, pa.int64()), b, pa.array(np.concatenate([np.zeros(len(pairs), np.int64), near[some]]), pa.int64())], names=["a", "b", "near"])

    found = cut(_blocked(bare, groups, block_sets, block_grams).groupBy("component", "x", "y").applyInArrow(run, "a long, b long, near long"))
    near = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("near").alias("near"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "c")
    linked = joined.join(classes.select("c", "rep"), "c")
    least_key = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    tops = linked.join(least_key, "component").select("c", "component_id")
    ids = (
        classes.select("h1", "h2", "c", "rep", "times")
        .join(tops, "c", "left")
        .join(near, "c", "left")
        .select(F.col("h1").alias("i1"), F.col("h2").alias("i2"), "c", (F.coalesce("near", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    out = base.drop("th").join(ids, (F.col("h1") == F.col("i1")) & (F.col("h2") == F.col("i2")) & (F.col("size") > 0), "left")
    return out.select(F.col("k").alias(key), F.col("size").alias("n_shingles"), F.col("c").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "k").alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links")


#: The same in SQL, every pair that shares a shingle compared: for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), rare AS (SELECT doc_id, s FROM g WHERE s IN (SELECT s FROM g GROUP BY s HAVING count(*) > 1)
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY 1) USING (doc_id)
"""

QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES = {"op2_ngram_join": SQL}
