"""The call graph: resolving calls, reaching callers and callees level by level, and the views on them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.functions.scalars import grams, label, simple_method_name
from lithograph.operators.state import cut

#: The roles of a node, the one that wins first.
ROLES = ("root", "callee", "caller")
#: The length of the runs of signs by which scopes find fqns.
GRAM = 3


class Adjacency(NamedTuple):
    """The same edges (source, target) twice: `out` kept by source, `into` by target, so that a step either way moves no edges."""

    out: DataFrame
    into: DataFrame


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (id, source, target) with targets `~scope.name` put to a method's fqn; those without a candidate go.

    Of several methods of the name the first by fqn whose fqn holds the scope, in any case, is taken, else the first.
    A target without the mark, or without a dot after it, stays or goes as it is: only the mark asks for resolution.
    A common name's methods are never paired with all its calls or scopes: see hinted.
    """
    plain = calls.where(~F.col("target").startswith("~")).select("id", "source", "target")
    bare = F.substring("target", 2, 1 << 30)
    open_ = calls.where(F.col("target").startswith("~") & bare.contains(".")).select(
        "id", "source", F.lower(F.left(bare, F.length(bare) - F.length(F.substring_index(bare, ".", -1)) - 1)).alias("scope"), F.substring_index(bare, ".", -1).alias("name")
    )
    named = methods.select("fqn", simple_method_name("fqn").alias("name")).distinct()
    first = named.groupBy("name").agg(F.min("fqn").alias("first"))
    found = open_.join(first, "name").join(hinted(open_.select("name", "scope"), named), ["name", "scope"], "left")
    return plain.unionByName(found.select("id", "source", F.coalesce("hinted", "first").alias("target")))


def hinted(hints: DataFrame, named: DataFrame, slots: int = 32) -> DataFrame:
    """(name, scope, hinted) for hints (name, scope in lower case): the first fqn of named (name, fqn) that holds the scope in any case.

    An index of three signs (or as many as a shorter scope has) keeps how many of a name's fqns hold a gram, and the first of them.  What
    holds a scope holds its grams, so no answer comes before the last of their first fqns; where that one holds the scope it is the answer,
    as it is for each scope of three signs or fewer.  Only the other scopes read the fqns of their rarest gram, beyond the bound,
    in `slots` parts.  A scope with a gram that no fqn of its name has, and an empty one, is not among the rows.
    """
    # hints repeat much more than they differ, and are read three times
    asked = cut(hints.where("scope <> ''").distinct().withColumn("size", F.least(F.lit(GRAM), F.length("scope"))))
    sizes = asked.groupBy("name").agg(F.collect_set("size").alias("sizes"))  # at most GRAM numbers
    low = F.lower("fqn")
    of_fqn = F.flatten(F.transform("sizes", lambda n: grams(low, n)))
    postings = named.join(sizes, "name").select("name", "fqn", F.explode(of_fqn).alias("gram"))
    index = postings.groupBy("name", "gram").agg(F.count("*").alias("n"), F.min("fqn").alias("least"))
    each = asked.withColumn("grams", grams(F.col("scope"), F.col("size"))).select("name", "scope", F.size("grams").alias("all"), F.explode("grams").alias("gram"))
    met = each.join(index, ["name", "gram"]).groupBy("name", "scope", "all").agg(F.count("*").alias("held"), F.max("least").alias("bound"), F.min(F.struct("n", "gram")).alias("rarest"))
    met = cut(met.where(F.col("held") == F.col("all")))
    settled = F.lower("bound").contains(F.col("scope"))
    first = met.where(settled).select("name", "scope", F.col("bound").alias("hinted"))
    if met.where(~settled).isEmpty():
        return first
    rest = met.where(~settled).select("name", "scope", "bound", F.col("rarest.gram").alias("gram"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    dealt = postings.withColumn("slot", F.pmod(F.xxhash64("fqn"), F.lit(slots)).cast("int"))
    later = dealt.join(rest, ["name", "gram", "slot"]).where((F.col("fqn") > F.col("bound")) & low.contains(F.col("scope")))
    return first.union(later.groupBy("name", "scope").agg(F.min("fqn").alias("hinted")))


def edges_of(resolved: DataFrame) -> DataFrame:
    """Distinct (source, target); a self-loop is an edge."""
    return resolved.where(F.col("target").isNotNull() & ~F.col("target").startswith("~")).select("source", "target").distinct()


def vertices_of(methods: DataFrame, edges: DataFrame) -> DataFrame:
    return methods.select("fqn").union(edges.select("source")).union(edges.select("target")).distinct()


def reached(edges: DataFrame, root, depth: int) -> DataFrame:
    """(fqn, depth) of what root reaches over (source, target) within depth steps; root itself isn't in it.

    A level is one join of the frontier with the edges and one anti-join with what was seen.  Each level is
    checkpointed, and the loop ends with an empty frontier.  Self-loops and cycles come to nothing new.
    """
    kind = edges.schema["source"].dataType
    start = edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("fqn"), F.lit(0).alias("depth"))
    seen, frontier = [start], start
    for level in range(1, depth + 1):
        ahead = edges.join(frontier.select(F.col("fqn").alias("source")), "source").select(F.col("target").alias("fqn")).distinct()
        known = reduce(DataFrame.union, seen).select("fqn")
        frontier = cut(ahead.join(known, "fqn", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.union, seen).where("depth > 0")


def callees(edges: DataFrame | Adjacency, root, depth: int) -> DataFrame:
    return reached(edges.out if isinstance(edges, Adjacency) else edges, root, depth)


def callers(edges: DataFrame | Adjacency, root, depth: int) -> DataFrame:
    edges = edges.into if isinstance(edges, Adjacency) else edges
    return reached(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), root, depth)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("fqn").distinct()
    return edges.join(ids.withColumnRenamed("fqn", "source"), "source", "left_semi").join(ids.withColumnRenamed("fqn", "target"), "target", "left_semi")


def view(edges: DataFrame | Adjacency, root, up: int, down: int) -> tuple[DataFrame, DataFrame]:
    """(nodes (fqn, role, depth, label), edges) around root; a node that is both callee and caller is a callee.

    An unknown root is the only node of its view.  The edges are worked out once for all levels, or read as they are kept.
    """
    edges = edges if isinstance(edges, Adjacency) else Adjacency(*[cut(edges)] * 2)
    kind = edges.out.schema["source"].dataType
    parts = [edges.out.sparkSession.range(1).select(F.lit(root).cast(kind).alias("fqn"), F.lit(0).alias("depth"), F.lit(0).alias("role"))]
    if down:
        parts.append(callees(edges, root, down).withColumn("role", F.lit(1)))
    if up:
        parts.append(callers(edges, root, up).withColumn("role", F.lit(2)))
    first = reduce(DataFrame.unionByName, parts).groupBy("fqn").agg(F.min(F.struct("role", "depth")).alias("r"))
    roles = F.array(*map(F.lit, ROLES))
    nodes = first.select("fqn", roles[F.col("r.role")].alias("role"), F.col("r.depth").alias("depth"), label(F.col("fqn").cast("string")).alias("label"))
    return nodes, induced(edges.out, nodes)


def call_hierarchy(edges: DataFrame | Adjacency, root, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    return view(edges, root, depth, depth)


def callers_view(edges: DataFrame | Adjacency, root, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    return view(edges, root, depth, 0)


def callees_view(edges: DataFrame | Adjacency, root, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    return view(edges, root, 0, depth)
