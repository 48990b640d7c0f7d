"""Inconsistency reports as groups: a row for each group of entities that differ, with how many pairs it stands for.

The report is a list of pairs, whose number grows with the square of a group.  What is stored grows with the entities: the groups,
each with its members' key, the exact number of its pairs and one of them.  Any group's pairs, and the first pairs of the whole
report in its order, are worked out when they are asked for.

Four passes share one form.  A pass gives each entity a key, on which entities meet, and a signature, in which a pair has to differ;
links say which keys meet, a key itself or two similar ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.functions.scalars import entity_id, signature_reason
from lithograph.operators.inconsistency import REPORT, SAME_BODY, similar_names
from lithograph.operators.state import cut

#: The passes: what they report on and as which kind.
PASSES = {"signature": ("METHOD", "DIVERGENT_SIGNATURE"), "method": ("METHOD", "SIMILAR_NAME"), "field": ("FIELD", "SIMILAR_NAME"), "body": ("METHOD", "SIMILAR_BODY")}
_GROUP = ("pass", "key1", "key2", "score", "distance")


def members(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(pass, key, sig, fqn, ord, name, shown, parameters): each entity once for each pass that it takes part in.

    methods has fqn, simple_name, declaring_type_fqn, return_type, parameter_count, body_hash and ord, fields have fqn, simple_name,
    field_type and ord; ord tells rows apart and orders them.  Null names and null hashes of bodies take no part where a pass needs them.
    """
    none = F.lit(None)

    def of(rows: DataFrame, name: str, key: Column, sig: Column, shown: Column = none, parameters: Column = none) -> DataFrame:
        return rows.select(
            F.lit(name).alias("pass"), key.alias("key"), sig.alias("sig"), "fqn", "ord", F.col("simple_name").alias("name"), shown.cast("string").alias("shown"), parameters.cast("long").alias("parameters")
        )

    # equal texts stand for equal values, nulls included
    text = lambda *columns: F.to_json(F.struct(*columns))
    named = methods.where("simple_name is not null")
    return (
        of(named, "signature", F.col("simple_name"), text("return_type", "parameter_count"), F.col("return_type"), F.col("parameter_count"))
        .unionByName(of(named, "method", F.col("simple_name"), text("body_hash")))
        .unionByName(of(fields.where("simple_name is not null"), "field", F.col("simple_name"), text("field_type"), F.col("field_type")))
        .unionByName(of(named.where("body_hash is not null and declaring_type_fqn is not null"), "body", text("declaring_type_fqn", "body_hash"), F.col("simple_name")))
    )


def links(rows: DataFrame) -> DataFrame:
    """(pass, key1, key2, score, distance): the keys that meet; a key meets itself but for similar names of methods."""
    keys = rows.select("pass", "key").distinct()
    own = keys.where("pass <> 'method'").select("pass", F.col("key").alias("key1"), F.col("key").alias("key2"), F.when(F.col("pass") == "body", 0.95).otherwise(1.0).alias("score"), F.lit(0).alias("distance"))
    parts = [own]
    for name in ("method", "field"):
        near = similar_names(keys.where(F.col("pass") == name), "key")
        parts.append(near.select(F.lit(name).alias("pass"), F.col("name1").alias("key1"), F.col("name2").alias("key2"), F.col("similarity").alias("score"), F.col("distance").cast("int").alias("distance")))
    return reduce(DataFrame.unionByName, parts)


def _summaries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by signature, by key): numbers, the last member of each, and of a key also the last with another signature than that."""
    member = F.struct("ord", "fqn", "name", "shown", "parameters")
    sigs = rows.groupBy("pass", "key", "sig").agg(F.count("*").alias("n"), F.max(member).alias("last"))
    keys = sigs.groupBy("pass", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max(F.struct("last", "sig")).alias("top"))
    other = sigs.join(keys.select("pass", "key", F.col("top.sig").alias("top_sig")), ["pass", "key"]).where(~F.col("sig").eqNullSafe(F.col("top_sig")))
    second = other.groupBy("pass", "key").agg(F.max(F.struct("last", "sig")).alias("second"))
    return sigs, keys.join(second, ["pass", "key"], "left")


def _reason() -> Column:
    """The report's text of a pair (a, b); fixed values."""
    shown = [F.coalesce(F.col(f"{x}.shown"), F.lit("null")) for x in "ab"]
    return (
        F.when(F.col("pass") == "signature", signature_reason("a.name", "a.shown", "b.shown", "a.parameters", "b.parameters"))
        .when(F.col("pass") == "method", F.format_string("Names differ by %d edit(s); bodies diverge", "distance"))
        .when(F.col("pass") == "field", F.format_string("Field names similar (dist=%d) but types differ: %s vs %s", F.col("distance"), *shown))
        .otherwise(F.lit(SAME_BODY))
    )


def _named(pairs: DataFrame, *kept: str) -> DataFrame:
    """Pairs (pass, score, distance, a, b) as report rows; the earlier by ord comes first."""
    turned = pairs.withColumns({"a": F.when(F.col("a.ord") < F.col("b.ord"), F.col("a")).otherwise(F.col("b")), "b": F.when(F.col("a.ord") < F.col("b.ord"), F.col("b")).otherwise(F.col("a"))})
    of = lambda i: F.coalesce(*(F.when(F.col("pass") == p, F.lit(v[i])) for p, v in PASSES.items()))
    return turned.select(
        *kept, F.col("a.fqn").alias("entity1_fqn"), of(0).alias("entity1_kind"), F.col("b.fqn").alias("entity2_fqn"), of(0).alias("entity2_kind"), of(1).alias("kind"), _reason().alias("reason"), F.col("score").alias("similarity_score")
    )


def groups(rows: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """(pass, key1, key2, distance, members, pairs and the columns of a report): each group with its exact number of pairs and one of them.

    Grouped counts and joins of keys; nothing is paired but signatures that two similar names share.  With touched (pass, key)
    only the groups that have one of these keys.
    """
    met = links(rows)
    if touched is not None:
        some = [touched.select("pass", F.col("key").alias(k), F.lit(True).alias(f"by_{k}")).distinct() for k in ("key1", "key2")]
        met = met.join(some[0], ["pass", "key1"], "left").join(some[1], ["pass", "key2"], "left").where("by_key1 or by_key2").select("pass", "key1", "key2", "score", "distance")
    met = cut(met)
    if touched is not None:
        rows = rows.join(met.select("pass", F.explode(F.array("key1", "key2")).alias("key")).distinct(), ["pass", "key"], "left_semi")
    sigs, keys = map(cut, _summaries(rows))
    one, two = (keys.select("pass", *(F.col(c).alias(f"{c}{i}") for c in ("key", "n", "same", "top", "second"))) for i in (1, 2))
    both = met.join(one, ["pass", "key1"]).join(two, ["pass", "key2"])
    s1, s2 = (sigs.select("pass", "sig", F.col("key").alias(f"key{i}"), F.col("n").alias(f"c{i}")) for i in (1, 2))
    shared = met.where("key1 <> key2").select("pass", "key1", "key2").join(s1, ["pass", "key1"]).join(s2, ["pass", "key2", "sig"]).groupBy("pass", "key1", "key2").agg(F.sum(F.col("c1") * F.col("c2")).alias("shared"))
    own = F.col("key1") == F.col("key2")
    pairs = F.when(own, ((F.col("n1") * F.col("n1") - F.col("same1")) / 2).cast("long")).otherwise(F.col("n1") * F.col("n2") - F.coalesce("shared", F.lit(0)))
    counted = both.join(shared, ["pass", "key1", "key2"], "left").withColumn("pairs", pairs).where("pairs > 0")
    # two last members with different signatures: of one key, or of two
    unlike = ~F.col("top1.sig").eqNullSafe(F.col("top2.sig"))
    a = F.when(own | unlike | F.col("second2").isNotNull(), F.col("top1.last")).otherwise(F.col("second1.last"))
    b = F.when(own, F.col("second1.last")).when(unlike | F.col("second2").isNull(), F.col("top2.last")).otherwise(F.col("second2.last"))
    size = F.when(own, F.col("n1")).otherwise(F.col("n1") + F.col("n2"))
    return _named(counted.withColumns({"a": a, "b": b, "members": size}), "pass", "key1", "key2", "distance", "members", "pairs")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    member = F.struct("ord", "fqn", "name", "shown", "parameters", "sig")
    return tuple(rows.select("pass", F.col("key").alias(f"key{i}"), member.alias(x)) for i, x in ((1, "a"), (2, "b")))


def expand(found: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs of some groups, as report rows with ids that are the same in every run."""
    a, b = _sides(rows)
    met = found.select("pass", "key1", "key2", F.col("similarity_score").alias("score"), "distance").join(a, ["pass", "key1"]).join(b, ["pass", "key2"])
    pairs = met.where(~F.col("a.sig").eqNullSafe(F.col("b.sig")) & F.when(F.col("key1") == F.col("key2"), F.col("a.ord") < F.col("b.ord")).otherwise(F.col("a.ord") != F.col("b.ord")))
    return with_ids(_named(pairs))


def with_ids(reports: DataFrame) -> DataFrame:
    return reports.withColumn("id", entity_id("kind", "entity1_fqn", "entity2_fqn", "reason"))


def _ordered(reports: DataFrame, limit: int) -> DataFrame:
    return reports.orderBy(F.desc("similarity_score"), "kind", "entity1_fqn", "entity2_fqn", "reason").limit(limit)


def _first_of(found: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` pairs by both names of groups of one score and kind.

    An entity can come first in a pair if one of the keys that it meets has a later member with another signature, which the last two
    of these keys tell.  The first `limit` such entities by name hold the pairs that are asked for; they alone meet others.
    """
    turned = found.select("pass", "key1", "key2", F.col("similarity_score").alias("score"), "distance")
    way = turned.union(turned.where("key1 <> key2").select("pass", F.col("key2").alias("key1"), F.col("key1").alias("key2"), "score", "distance"))
    _, keys = _summaries(rows.join(found.select("pass", F.explode(F.array_distinct(F.array("key1", "key2"))).alias("key")).distinct(), ["pass", "key"], "left_semi"))
    ends = keys.select("pass", F.col("key").alias("key2"), F.explode(F.array("top", "second")).alias("e")).where("e is not null")
    lasts = way.join(ends, ["pass", "key2"]).groupBy("pass", F.col("key1").alias("key"), F.col("e.sig").alias("esig")).agg(F.max("e.last.ord").alias("last"))
    top = lasts.groupBy("pass", "key").agg(F.max(F.struct("last", "esig")).alias("top"))
    second = lasts.join(top, ["pass", "key"]).where(~F.col("esig").eqNullSafe(F.col("top.esig"))).groupBy("pass", "key").agg(F.max("last").alias("second"))
    bound = top.join(second, ["pass", "key"], "left")
    later = F.when(F.col("sig").eqNullSafe(F.col("top.esig")), F.col("second")).otherwise(F.col("top.last"))
    able = rows.join(bound, ["pass", "key"]).where(F.col("ord") < later).select(*rows.columns)
    # names that tie with the last one stay
    edge = able.orderBy("fqn").limit(limit).agg(F.max("fqn").alias("edge"))
    heads = able.join(F.broadcast(edge), F.col("fqn") <= F.col("edge")).drop("edge")
    a, b = _sides(heads)[0], _sides(rows)[1]
    pairs = way.join(a, ["pass", "key1"]).join(b, ["pass", "key2"]).where((F.col("a.ord") < F.col("b.ord")) & ~F.col("a.sig").eqNullSafe(F.col("b.sig")))
    return _ordered(with_ids(_named(pairs)), limit)


def first(found: DataFrame, rows: DataFrame, limit: int = 200, kind: str | None = None) -> DataFrame:
    """The report's first `limit` rows: by score, then kind, then both names; of one kind, or of all.

    Groups count their pairs, so the scores and kinds whose pairs all belong to the first `limit` are known without making any; these
    are expanded, and of the one that the limit cuts only its first pairs are made.
    """
    some = found if kind in (None, "", "ALL") else found.where(F.col("kind") == kind)
    classes = some.groupBy("similarity_score", "kind").agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("similarity_score"), "kind").limit(limit)
    total, whole, partial = 0, [], None
    for r in classes.collect():  # one row for each score and kind, at most `limit`, as each has a pair
        if total >= limit:
            break
        total += r.pairs
        if total <= limit:
            whole.append((r.similarity_score, r.kind))
        else:
            partial = (r.similarity_score, r.kind)
    of = lambda c: (F.col("similarity_score") == c[0]) & (F.col("kind") == c[1])
    parts = [expand(some.where(reduce(lambda x, y: x | y, map(of, whole))), rows)] if whole else []
    parts += [_first_of(some.where(of(partial)), rows, limit)] if partial else []
    out = reduce(DataFrame.unionByName, parts) if parts else expand(some.limit(0), rows)
    return _ordered(out, limit).select("id", *REPORT)


def count(found: DataFrame) -> DataFrame:
    """(kind, groups, pairs): the report's size without its pairs."""
    return found.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("pairs").alias("pairs"))
