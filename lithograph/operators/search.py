"""Full-text search over entities: boosted fields, every term required, the last term a prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.functions.scalars import spaced_camel
from lithograph.operators.state import cut

#: What a match in each field weighs, and the most hits a search gives.
BOOSTS = {"simple_name": 3.0, "fqn": 2.0, "search": 1.0}
MOST_HITS = 100
#: Possessive: no part of a word can begin another match, so none is tried again.
TOKEN = r"([\p{L}\p{N}_]++(?:\.[\p{L}\p{N}_]++)*+)"
#: So many tokens of queries, each once a query, are sent to all tasks.
MOST_SENT = 200_000
#: So many tokens of documents, each once a document, are scored by one task.
_HELD = 200_000


def tokens(text: Column) -> Column:
    """Lower-case words; a dot or underscore between letters doesn't part them."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN))


def search_text(*parts: Column) -> Column:
    """Each part as it is, with its camel case apart and with its dots apart; null parts are empty."""
    spread = [x for p in map(lambda p: F.coalesce(p, F.lit("")), parts) for x in (p, spaced_camel(p), F.translate(p, ".", " "))]
    return F.concat_ws(" ", *spread)


def documents(types: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """What is searched: (id, kind, label, fqn, declaring_type, simple_name, search) of all entities."""

    def of(rows: DataFrame, kind: Column, declaring: Column, fourth: str) -> DataFrame:
        shown = [F.coalesce(c, F.lit("")) for c in (F.col("id"), kind, F.col("simple_name"), F.col("fqn"), declaring, F.col("simple_name"))]
        names = ("id", "kind", "label", "fqn", "declaring_type", "simple_name")
        search = search_text(F.col("simple_name"), F.col("fqn"), declaring, F.col(fourth))
        return rows.select(*(c.alias(n) for c, n in zip(shown, names)), search.alias("search"))

    return (
        of(types, F.col("kind"), F.col("package_fqn"), "kind")
        .unionByName(of(methods, F.lit("METHOD"), F.col("declaring_type_fqn"), "return_type"))
        .unionByName(of(fields, F.lit("FIELD"), F.col("declaring_type_fqn"), "field_type"))
    )


def index(docs: DataFrame) -> DataFrame:
    """(id, field, token, n): the searched fields' tokens; fqn is one token, in its own case.  Write it partitioned by field."""
    words = {"simple_name": tokens(F.col("simple_name")), "fqn": F.array("fqn"), "search": tokens(F.col("search"))}
    parts = [docs.select("id", F.lit(f).alias("field"), F.explode(w).alias("token")) for f, w in words.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id", "field", "token").agg(F.count("*").alias("n"))


def _prefix(term: str):
    return lambda token: token.startswith(term)


def _equal(term: str):
    return lambda token: token == F.lit(term)


def search(docs: DataFrame, text: str | None, limit: int = 30) -> DataFrame:
    """Hits (id, kind, label, fqn, declaring_type, score), best first; ties by kind, fqn and id.

    A term may match in any field; its score is the boosts of the fields that it matches in.  Text without any
    token falls back to what its letters occur in; blank text finds nothing.
    """
    shown = ["id", "kind", "label", "fqn", "declaring_type"]
    limit = min(limit, MOST_HITS)
    if not text or not text.strip():
        return docs.select(*shown, F.lit(0.0).alias("score")).limit(0)
    terms = [t for t in "".join(c if c.isalnum() or c in "_. " else " " for c in text.lower()).split() if t.strip(".")]
    words = {"simple_name": tokens(F.col("simple_name")), "fqn": F.array("fqn"), "search": tokens(F.col("search"))}
    if terms:
        scores = []
        for i, term in enumerate(t.strip(".") for t in terms):
            match = _prefix(term) if i == len(terms) - 1 else _equal(term)
            scores.append(reduce(lambda a, b: a + b, (F.when(F.exists(w, match), BOOSTS[f]).otherwise(0.0) for f, w in words.items())))
        found = docs.select(*shown, F.array(*scores).alias("each")).where(F.forall("each", lambda s: s > 0))
        scored = found.withColumn("score", F.aggregate("each", F.lit(0.0), lambda a, s: a + s)).drop("each")
    else:
        scored = docs.where(F.lower("search").contains(text.strip().lower())).select(*shown, F.lit(BOOSTS["search"]).alias("score"))
    return scored.orderBy(F.desc("score"), "kind", "fqn", "id").limit(limit)


def sender(asked: DataFrame):
    """How what goes with queries' tokens (query_id, token) is joined: sent to all tasks, if there are MOST_SENT of them at most."""
    return F.broadcast if asked.limit(MOST_SENT + 1).count() <= MOST_SENT else lambda df: df


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of queries (query_id, text) against docs (doc_id, text) by BM25, all documents that share a token.

    Only tokens of some query travel, counted by document.  All of a document's meet in one task, which adds up its scores, so that
    no part of a score travels; the queries' tokens are sent to it, if they are MOST_SENT at most.
    """
    words = tokens(F.col("text"))
    asked = queries.select("query_id", F.explode(F.array_distinct(words)).alias("token"))
    sent = sender(asked)
    # sizes first: beside a generator they would be worked out again for each of its rows
    split = docs.select("doc_id", words.alias("w"))
    size = split.select("doc_id", F.size("w").alias("size"), "w").select("doc_id", "size", F.explode("w").alias("token"))
    held = cut(size.join(sent(asked.select("token").distinct()), "token", "left_semi").groupBy("doc_id", "size", "token").agg(F.count("*").alias("tf")))
    total = docs.agg(F.count("*").alias("docs"), F.avg(F.size(words)).alias("mean"))  # one row
    df = held.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("token", idf.alias("idf"), "mean").join(asked, "token")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    # a row of held meets all queries that have its token, so the tasks' input says little of their work
    joined = held.repartition(held.count() // _HELD + 1, "doc_id").join(sent(weights), "token")
    return joined.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
