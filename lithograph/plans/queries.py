"""The operators over the driver's tables: each binding says which table stands for which entity."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.functions import scalars as S
from lithograph.operators import adjacency, catalog, graph, history, impact, inconsistency, index, maintenance, reports, search
from lithograph.operators.state import cut, shared_folder
from lithograph.plans.registry import query, table
from lithograph.sources import java


# --- lookups, lists and counts ---------------------------------------------------------------------------------


@query(
    "entity_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders")),
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders")})


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are root packages, nations are packages in them."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    roots = region.select(F.col("r_name").alias("fqn"), F.lit(None).cast("string").alias("parent_fqn"))
    return roots.union(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"))


@query(
    "package_tree",
    """SELECT r_name AS fqn, NULL AS parent_fqn, true AS is_root FROM region
       UNION ALL SELECT n_name, r_name, false FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def package_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.package_tree(packages(spark, sf_dir))


@query("types_in_package", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 ORDER BY s_name, s_suppkey")
def types_in_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listed(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_nationkey", 3, "s_name", "s_suppkey").drop("s_nationkey")


@query("members_of_type", "SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 1 ORDER BY l_linenumber, l_partkey")
def members_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listed(table(spark, sf_dir, "lineitem"), "l_orderkey", 1, "l_linenumber", "l_partkey").select("l_linenumber", "l_partkey", "l_quantity")


@query("point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), 77, "c_custkey")


@query(
    "detail_with_parent",
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, '') AS source_file
       FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_name) AS p_name FROM part WHERE p_size < 40 GROUP BY p_partkey) ON l_partkey = p_partkey""",
)
def detail_with_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("declaring_type_fqn"))
    types = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("fqn"), F.col("p_name").alias("source_file"))
    return catalog.with_source_file(members, types).drop("declaring_type_fqn")


@query(
    "type_detail",
    """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 2 = 0) AS n_methods, count(*) FILTER (l_linenumber % 2 = 1) AS n_fields,
         min(l_linenumber) FILTER (l_linenumber % 2 = 0) AS first_line, max(l_linenumber) FILTER (l_linenumber % 2 = 0) AS last_line FROM lineitem GROUP BY 1),
       n AS (SELECT o_custkey, count(*) AS n_notes, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS newest FROM orders GROUP BY 1)
       SELECT o_orderkey AS fqn, coalesce(n_methods, 0) AS n_methods, coalesce(n_fields, 0) AS n_fields, first_line, last_line, coalesce(n_notes, 0) AS n_notes, newest::VARCHAR AS newest_note
       FROM orders o LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN n ON n.o_custkey = o_orderkey""",
)
def type_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are types, their even lines methods and the odd ones fields; a customer's orders are notes on the type of its number."""
    orders = table(spark, sf_dir, "orders")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("declaring_type_fqn"), F.col("l_linenumber").alias("start_line"), F.col("l_partkey").alias("id"))
    notes = orders.select(F.col("o_custkey").alias("entity_fqn"), F.col("o_totalprice").alias("created_at"), F.col("o_orderkey").alias("id"))
    detail = catalog.type_details(orders.select(F.col("o_orderkey").alias("fqn")), members.where("start_line % 2 = 1"), members.where("start_line % 2 = 0"), notes)
    line = F.transform("methods", lambda m: m["start_line"])
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("methods", "fields", "notes")]
    return detail.select("fqn", *sizes, F.array_min(line).alias("first_line"), F.array_max(line).alias("last_line"), F.get("notes", F.lit(0))["id"].cast("string").alias("newest_note"))


@query("packages_by_fqn", "SELECT r_name AS fqn, NULL AS parent_fqn FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def packages_by_fqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.in_order(packages(spark, sf_dir))


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("fqn"), F.col("p_name").alias("simple_name"))


@query("types_by_fqn", "SELECT p_partkey AS id, p_type AS fqn, p_name AS simple_name FROM part")
def types_by_fqn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank search lists all types."""
    return catalog.types_or_search(part_types(spark, sf_dir), "  ")


@query(
    "wildcard_search",
    "SELECT p_partkey AS id, p_name AS simple_name FROM part WHERE lower(p_type) LIKE '%b_l%t%' OR lower(p_name) LIKE '%b_l%t%' ORDER BY p_name, p_partkey LIMIT 50",
)
def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.types_or_search(part_types(spark, sf_dir), "B_l%t").select("id", "simple_name")


@query("notes_of_entity", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_totalprice DESC, o_orderkey")
def notes_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are its notes, the dearest the newest."""
    notes = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return catalog.listed(notes, "o_custkey", 7, F.desc("o_totalprice"), "o_orderkey").drop("o_custkey")


@query(
    "member_files",
    """SELECT p_partkey AS id, p_brand AS declaring_type_fqn, file FROM part JOIN (SELECT p_brand, arg_min(p_name, p_partkey) AS file FROM part WHERE p_size < 3 GROUP BY 1) USING (p_brand)""",
)
def member_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are members of the type that their brand names; small parts are types, several of one name."""
    part = table(spark, sf_dir, "part")
    types = part.where("p_size < 3").select(F.col("p_brand").alias("fqn"), F.col("p_name").alias("source_file"), F.col("p_partkey").alias("ord"))
    return history.entity_files(part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("declaring_type_fqn")), types)


@query(
    "name_search",
    "SELECT p_partkey AS id, p_name AS simple_name FROM part WHERE lower(p_type) LIKE '%bolt%' OR lower(p_name) LIKE '%bolt%' ORDER BY p_name, p_partkey LIMIT 50",
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("fqn"), F.col("p_name").alias("simple_name"))
    return catalog.search_types(types, "Bolt").select("id", "simple_name")


@query(
    "member_counts",
    "SELECT n_nationkey AS fqn, count(s_suppkey) AS method_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey",
)
def member_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fqn"))
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("declaring_type_fqn"))
    return catalog.member_counts(types, members, "method_count")


@query("package_type_count", "SELECT r_regionkey AS fqn, count(n_nationkey) AS type_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def package_type_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.package_type_counts(
        table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("fqn")), table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("package_fqn"))
    )


_FILE = "regexp_extract(url, '://([^?#]*)', 1)"


@query(
    "package_file_count",
    f"""WITH p AS (SELECT {_FILE} AS path FROM pages),
        k AS (SELECT split_part(path, '/', 2) AS fqn, path FROM p WHERE path LIKE '%/%/%')
        SELECT fqn, greatest(count(*) - 1, (SELECT count(*) FROM p WHERE contains(p.path, k.fqn || '/'))) AS file_count
        FROM k GROUP BY fqn""",
)
def package_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path is a file, its first folder the package that it declares."""
    files = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    declared = files.where(F.col("path").like("%/%/%")).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("fqn"))
    return catalog.package_file_counts(declared, files)


@query("kind_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY event_type")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"))
    return catalog.with_kind(rows, "click").groupBy(F.col("kind").alias("event_type")).agg(F.count("*").alias("n"))


@query("scan_totals", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS parsed, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scan_totals(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "F").alias("ok")))


# --- maintenance -----------------------------------------------------------------------------------------------

_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(
    "upsert_last_wins",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in _LINE.split(", "))}) AS rn FROM lineitem) WHERE rn = 1""",
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.last_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE.split(", "))


@query(
    "upsert",
    """SELECT c_custkey, coalesce(total, c_acctbal) AS c_acctbal, c_name FROM customer
       LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders JOIN (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_orderkey GROUP BY 1) ON o_custkey = c_custkey""",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's balance becomes the price of the last order, where there is one."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    new = table(spark, sf_dir, "orders").join(old.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return maintenance.upsert(old, new.select("c_custkey", F.col("o_totalprice").alias("c_acctbal"), "c_name", F.col("o_orderkey").alias("at")), "c_custkey", "at")


@query("replace_delete", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND doc_id IS DISTINCT FROM 4")
def replace_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return maintenance.deleted(maintenance.replaced(labels, labels.where("quality = 1")), "doc_id", 4)[0]


@query(
    "note_written",
    """SELECT c_custkey::VARCHAR AS id, 'app.' || c_name AS entity_fqn, c_mktsegment AS content, c_nationkey::BIGINT AS created_at, c_nationkey::BIGINT + 1 AS updated_at FROM customer WHERE c_custkey <> 5
       UNION ALL SELECT '5', 'app.X', 'seen', 1000, 1000 UNION ALL SELECT 'new', 'app.Y', 'first', 2000, 2000""",
)
def note_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are notes: one is written again, one is new."""
    notes = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("app."), "c_name").alias("entity_fqn"), F.col("c_mktsegment").alias("content"), F.col("c_nationkey").cast("long").alias("created_at"), (F.col("c_nationkey") + 1).cast("long").alias("updated_at")
    )
    return maintenance.written_note(maintenance.written_note(notes, "5", "app.X", "seen", 1000), "new", "app.Y", "first", 2000)


@query(
    "git_meta_upsert",
    f"""SELECT CASE WHEN d.k IS NULL THEN m.entity_fqn ELSE d.k END AS entity_fqn, CASE WHEN d.k IS NULL THEN n ELSE c END AS commit_count
        FROM (SELECT 'app.' || c_name AS entity_fqn, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*)::INT AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) m
        FULL JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'app.' ELSE 'new.' END || c_name AS k, (c_custkey % 9)::INT AS c FROM customer) d ON d.k = m.entity_fqn""",
)
def git_meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other customer's change history is written again, the others are new."""
    people = table(spark, sf_dir, "customer")
    new = people.select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "app.").otherwise("new."), "c_name").alias("entity_fqn"), (F.col("c_custkey") % 9).cast("int").alias("commit_count"), F.col("c_custkey").alias("at"))
    return maintenance.upsert(order_meta(spark, sf_dir).select("entity_fqn", "commit_count"), new, "entity_fqn", "at")


# --- inconsistencies -------------------------------------------------------------------------------------------


def part_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are methods: the name is theirs, the type is what they return, the size how many parameters they take."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.col("p_brand"), F.lit("."), F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("fqn"),
        F.col("p_name").alias("simple_name"),
        F.col("p_type").alias("return_type"),
        F.col("p_size").alias("parameter_count"),
    )


_METHODS = "(SELECT p_partkey AS ord, p_brand || '.' || p_name || '#' || p_partkey AS fqn, p_name, p_type, p_size FROM part)"


@query(
    "divergent_signature",
    f"""SELECT a.fqn AS entity1_fqn, b.fqn AS entity2_fqn, rtrim('Method ''' || a.p_name || ''' has divergent signature: '
         || CASE WHEN a.p_type <> b.p_type THEN 'return type (' || a.p_type || ' vs ' || b.p_type || ') ' ELSE '' END
         || CASE WHEN a.p_size <> b.p_size THEN 'param count (' || a.p_size || ' vs ' || b.p_size || ')' ELSE '' END) AS reason, 1.0::DOUBLE AS similarity_score
        FROM {_METHODS} a JOIN {_METHODS} b ON a.p_name = b.p_name AND a.ord < b.ord WHERE a.p_type IS DISTINCT FROM b.p_type OR a.p_size IS DISTINCT FROM b.p_size""",
)
def divergent_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistency.divergent_signatures(part_methods(spark, sf_dir)).select("entity1_fqn", "entity2_fqn", "reason", "similarity_score")


@query(
    "divergent_counts",
    f"""SELECT a.p_name AS simple_name, count(*) AS pairs FROM {_METHODS} a JOIN {_METHODS} b ON a.p_name = b.p_name AND a.ord < b.ord
        WHERE a.p_type IS DISTINCT FROM b.p_type OR a.p_size IS DISTINCT FROM b.p_size GROUP BY 1""",
)
def divergent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistency.divergent_counts(part_methods(spark, sf_dir))


_SIMILAR = "levenshtein({a}, {b}) <= 2 AND 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1) >= 0.75"


@query(
    "similar_names",
    f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS name1, b.name AS name2, levenshtein(a.name, b.name) AS distance,
        1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS similarity FROM n a JOIN n b ON a.name < b.name WHERE {_SIMILAR.format(a="a.name", b="b.name")}""",
)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = inconsistency.similar_names(part_methods(spark, sf_dir))
    return found.select("name1", "name2", F.col("distance").cast("long").alias("distance"), "similarity")


def _named(select: str) -> str:
    return f"WITH r AS ({select})"


@query(
    "similar_methods",
    _named("SELECT min(p_partkey) AS ord, p_name || '.' || p_brand AS fqn, p_name AS name, p_brand AS hash FROM part GROUP BY p_name, p_brand")
    + f""" SELECT a.fqn AS entity1_fqn, b.fqn AS entity2_fqn, 'Names differ by ' || levenshtein(a.name, b.name) || ' edit(s); bodies diverge' AS reason,
        1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS similarity_score
        FROM r a JOIN r b ON a.ord < b.ord AND a.name <> b.name AND a.hash <> b.hash WHERE {_SIMILAR.format(a="a.name", b="b.name")}""",
)
def similar_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("simple_name"), F.col("p_brand").alias("body_hash")).agg(F.min("p_partkey").alias("ord"))
    methods = rows.withColumn("fqn", F.concat("simple_name", F.lit("."), "body_hash"))
    return inconsistency.similar_methods(methods).select("entity1_fqn", "entity2_fqn", "reason", "similarity_score")


@query(
    "similar_fields",
    _named("SELECT min(p_partkey) AS ord, p_name || '.' || p_brand AS fqn, p_name AS name, p_brand AS type FROM part GROUP BY p_name, p_brand")
    + f""" SELECT a.fqn AS entity1_fqn, b.fqn AS entity2_fqn, 'Field names similar (dist=' || levenshtein(a.name, b.name) || ') but types differ: ' || a.type || ' vs ' || b.type AS reason,
        1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS similarity_score
        FROM r a JOIN r b ON a.ord < b.ord AND a.type <> b.type WHERE {_SIMILAR.format(a="a.name", b="b.name")}""",
)
def similar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("simple_name"), F.col("p_brand").alias("field_type")).agg(F.min("p_partkey").alias("ord"))
    fields = rows.withColumn("fqn", F.concat("simple_name", F.lit("."), "field_type"))
    return inconsistency.similar_fields(fields).select("entity1_fqn", "entity2_fqn", "reason", "similarity_score")


def document_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.concat("source", F.lit("."), F.col("doc_id").cast("string")).alias("fqn"), F.col("doc_id").cast("string").alias("simple_name"), F.col("source").alias("declaring_type_fqn"), F.sha2("text", 256).alias("body_hash")
    )


_BODIES = """SELECT a.source || '.' || a.doc_id AS entity1_fqn, b.source || '.' || b.doc_id AS entity2_fqn, 'SIMILAR_BODY' AS kind, 0.95::DOUBLE AS similarity_score
             FROM documents a JOIN documents b ON a.source = b.source AND sha256(a.text) = sha256(b.text) AND a.doc_id < b.doc_id"""


@query("similar_body", _BODIES)
def similar_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistency.similar_bodies(document_methods(spark, sf_dir)).select("entity1_fqn", "entity2_fqn", "kind", "similarity_score")


@query(
    "inconsistency_topk",
    f"""SELECT * FROM (SELECT a.fqn AS entity1_fqn, b.fqn AS entity2_fqn, 'DIVERGENT_SIGNATURE' AS kind, 1.0::DOUBLE AS similarity_score FROM {_METHODS} a JOIN {_METHODS} b ON a.p_name = b.p_name AND a.ord < b.ord
        WHERE a.p_type IS DISTINCT FROM b.p_type OR a.p_size IS DISTINCT FROM b.p_size UNION ALL {_BODIES}) ORDER BY similarity_score DESC, kind, entity1_fqn, entity2_fqn LIMIT 200""",
)
def inconsistency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first 200, of all pairs, without making the others."""
    both = inconsistency.first_divergent(part_methods(spark, sf_dir)).unionByName(inconsistency.first_similar_bodies(document_methods(spark, sf_dir)))
    return inconsistency.top_reports(both).select("entity1_fqn", "entity2_fqn", "kind", "similarity_score")


@query("first_similar_bodies", f"{_BODIES} ORDER BY entity1_fqn, entity2_fqn LIMIT 200")
def first_similar_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistency.first_similar_bodies(document_methods(spark, sf_dir)).select("entity1_fqn", "entity2_fqn", "kind", "similarity_score")


@query(
    "body_classes",
    "SELECT source AS declaring_type_fqn, sha256(text) AS body_hash, count(*) AS members, min(source || '.' || doc_id) AS first_fqn FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
)
def body_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistency.body_classes(document_methods(spark, sf_dir))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the entities of all four passes: methods of their brand with the type as body, and fields that have the brand as type."""
    part = table(spark, sf_dir, "part")
    methods = part_methods(spark, sf_dir).join(part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("declaring_type_fqn"), F.col("p_type").alias("body_hash")), "ord")
    fields = part.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("f."), F.col("p_partkey").cast("string")).alias("fqn"), F.col("p_name").alias("simple_name"), F.col("p_brand").alias("field_type"))
    return reports.members(methods, fields)


_ALIKE = "1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))"
_REPORTS = f"""WITH m AS (SELECT p_brand || '.' || p_name || '#' || p_partkey AS fqn, p_partkey AS ord, * FROM part), n AS (SELECT DISTINCT p_name FROM part), s AS (
    SELECT a.p_name AS n1, b.p_name AS n2, levenshtein(a.p_name, b.p_name) AS d, {_ALIKE} AS score FROM n a, n b WHERE {_SIMILAR.format(a="a.p_name", b="b.p_name")}
  ), r AS (SELECT 1.0::DOUBLE AS similarity_score, 'DIVERGENT_SIGNATURE' AS kind, a.fqn AS entity1_fqn, b.fqn AS entity2_fqn, rtrim('Method ''' || a.p_name || ''' has divergent signature: '
         || CASE WHEN a.p_type <> b.p_type THEN 'return type (' || a.p_type || ' vs ' || b.p_type || ') ' ELSE '' END
         || CASE WHEN a.p_size <> b.p_size THEN 'param count (' || a.p_size || ' vs ' || b.p_size || ')' ELSE '' END) AS reason
         FROM m a JOIN m b ON a.p_name = b.p_name AND a.ord < b.ord WHERE a.p_type <> b.p_type OR a.p_size <> b.p_size
    UNION ALL SELECT score, 'SIMILAR_NAME', a.fqn, b.fqn, 'Names differ by ' || d || ' edit(s); bodies diverge' FROM s JOIN m a ON a.p_name = n1 JOIN m b ON b.p_name = n2 AND a.ord < b.ord WHERE d > 0 AND a.p_type <> b.p_type
    UNION ALL SELECT score, 'SIMILAR_NAME', 'f.' || a.ord, 'f.' || b.ord, 'Field names similar (dist=' || d || ') but types differ: ' || a.p_brand || ' vs ' || b.p_brand FROM s JOIN m a ON a.p_name = n1 JOIN m b ON b.p_name = n2 AND a.ord < b.ord WHERE a.p_brand <> b.p_brand
    UNION ALL SELECT 0.95, 'SIMILAR_BODY', a.fqn, b.fqn, '{inconsistency.SAME_BODY}' FROM m a JOIN m b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name <> b.p_name AND a.ord < b.ord)"""


@query("report_sizes", f"{_REPORTS} SELECT kind, count(*) AS pairs FROM r GROUP BY kind")
def report_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs the report has of each kind, from its groups."""
    return reports.count(reports.groups(reported(spark, sf_dir))).select("kind", "pairs")


@query("report_first", f"{_REPORTS} SELECT * FROM r ORDER BY similarity_score DESC, kind, entity1_fqn, entity2_fqn, reason LIMIT 200")
def report_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of the whole report, over all four passes."""
    rows = reported(spark, sf_dir)
    return reports.first(cut(reports.groups(rows)), rows).select("entity1_fqn", "entity2_fqn", "kind", "reason", "similarity_score")


@query("report_first_of_kind", f"{_REPORTS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY similarity_score DESC, entity1_fqn, entity2_fqn, reason) <= 200")
def report_first_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of each kind."""
    rows = reported(spark, sf_dir)
    found = cut(reports.groups(rows))
    kinds = [reports.first(found, rows, kind=kind) for kind in ("DIVERGENT_SIGNATURE", "SIMILAR_NAME", "SIMILAR_BODY")]
    return reduce(DataFrame.unionByName, kinds).select("entity1_fqn", "entity2_fqn", "kind", "reason", "similarity_score")


# --- history ---------------------------------------------------------------------------------------------------


def order_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are commits: each customer is an entity whose commits are its orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("commit_count"), F.max("o_orderkey").alias("last_commit_time"))
    people = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return people.select(
        F.concat(F.lit("app."), F.col("c_name")).alias("entity_fqn"),
        F.when(F.col("o_custkey").isNotNull(), F.col("c_mktsegment")).alias("last_author_name"),
        F.col("c_nationkey").alias("last_author_email"),
        "last_commit_time",
        F.coalesce("commit_count", F.lit(0)).alias("commit_count"),
    )


_META = """(SELECT 'app.' || c_name AS entity_fqn, CASE WHEN o_custkey IS NOT NULL THEN c_mktsegment END AS author, c_nationkey AS email, t, coalesce(n, 0) AS n
            FROM customer LEFT JOIN (SELECT o_custkey, count(*)::INT AS n, max(o_orderkey) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query(
    "top_authors",
    f"""SELECT author AS name, email, count(*) AS entity_count, max(t) AS last_change FROM {_META} WHERE author IS NOT NULL
        GROUP BY 1, 2 ORDER BY entity_count DESC, name, email NULLS FIRST LIMIT 10""",
)
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.top_authors(order_meta(spark, sf_dir))


@query("hot_entities", f"SELECT entity_fqn, n AS commit_count, split_part(entity_fqn, '.', -1) AS label FROM {_META} WHERE n > 0 ORDER BY n DESC, entity_fqn LIMIT 20")
def hot_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.hottest_entities(order_meta(spark, sf_dir)).select("entity_fqn", "commit_count", "label")


@query(
    "blame_newest",
    """WITH e AS (SELECT o_orderkey AS fqn, o_custkey % 7 AS lo, o_custkey % 7 + 2 AS hi FROM orders),
            x AS (SELECT fqn, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY fqn ORDER BY l_shipdate DESC, l_linenumber, l_partkey DESC) AS rn
                  FROM e JOIN lineitem ON l_orderkey = fqn AND l_linenumber BETWEEN greatest(lo, 1) AND greatest(lo, 1, hi))
       SELECT fqn AS entity_fqn, l_suppkey AS last_author_email FROM x WHERE rn = 1""",
)
def blame_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are entities and files, their lines blamed lines: of equal dates the first line is the newest."""
    entities = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fqn"), F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 7).alias("start_line"), (F.col("o_custkey") % 7 + 2).alias("end_line"))
    lines = table(spark, sf_dir, "lineitem")
    # a line number may stand twice in an order: the part decides, as line by line a file has one
    one = maintenance.last_wins(
        lines.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("commit_time"), "l_partkey", "l_suppkey"), ["file", "line"], ["commit_time", "l_partkey"]
    )
    blame = one.select("file", "line", "commit_time", F.col("l_partkey").cast("string").alias("commit"), F.col("l_partkey").alias("author"), F.col("l_suppkey").alias("email"), F.lit(0).alias("author_time"), F.lit("m").alias("message"))
    counts = lines.groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").cast("int").alias("commit_count"))
    return history.newest_change(entities, blame, counts).select("entity_fqn", "last_author_email")


@query("commit_counts", "SELECT l_suppkey AS file, count(DISTINCT l_orderkey)::INT AS commit_count FROM lineitem GROUP BY 1")
def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.commit_counts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("commit")))


@query(
    "entities_with_history",
    f"""SELECT c_custkey, fqn, author AS last_author_name, n AS commit_count FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'x.' ELSE 'app.' END || c_name AS fqn FROM customer) LEFT JOIN {_META} ON entity_fqn = fqn""",
)
def entities_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "x.").otherwise("app."), "c_name").alias("fqn"))
    return catalog.with_git_meta(named, order_meta(spark, sf_dir)).select("c_custkey", "fqn", "last_author_name", "commit_count")


@query(
    "heat_ratio",
    f"""WITH h AS (SELECT entity_fqn, n FROM {_META} WHERE n > 0 ORDER BY n DESC, entity_fqn LIMIT 20)
        SELECT m.entity_fqn AS fqn, coalesce(h.n, 0) AS commit_count, coalesce(h.n, 0) / (SELECT max(n) FROM h) AS heat FROM {_META} m LEFT JOIN h USING (entity_fqn)""",
)
def heat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = order_meta(spark, sf_dir)
    return catalog.heat(meta.select(F.col("entity_fqn").alias("fqn")), history.hottest_entities(meta))


@query(
    "buckets",
    f"""SELECT entity_fqn, CASE WHEN n > 10 THEN 'High' WHEN n > 3 THEN 'Medium' ELSE 'Low' END AS churn, CASE WHEN n <= 4 THEN 'low' WHEN n <= 10 THEN 'medium' ELSE 'high' END AS complexity,
        least(n * 5, 100) AS bar, n / (SELECT greatest(max(n), 1) FROM {_META}) AS ratio FROM {_META}""",
)
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = catalog.with_ratio(order_meta(spark, sf_dir))
    return meta.select("entity_fqn", S.churn_bucket("commit_count").alias("churn"), S.complexity_bucket("commit_count").alias("complexity"), S.complexity_bar("commit_count").alias("bar"), "ratio")


# --- graph and impact ------------------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part calls the one on the next line of the same order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("source"))
    return cut(graph.edges_of(a.join(lines.withColumnRenamed("l_partkey", "target"), ["l_orderkey", "l_linenumber"])))


def _reach(edges: str, depth: int) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED {edges}, r(fqn, depth) AS (SELECT (SELECT min(source) FROM e), 0 UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.fqn WHERE r.depth < {depth})"""


@query("callees", _reach(_EDGES, 4) + " SELECT fqn, min(depth) AS depth FROM r GROUP BY fqn HAVING min(depth) > 0")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph.callees(edges, edges.agg(F.min("source")).first()[0], 4)


_BACK = f"(SELECT target AS source, source AS target FROM {_EDGES})"


@query("callers", _reach(_BACK, 4) + " SELECT fqn, min(depth) AS depth FROM r GROUP BY fqn HAVING min(depth) > 0")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph.callers(edges, edges.agg(F.min("target")).first()[0], 4)


_VIEW = f"""WITH RECURSIVE e AS MATERIALIZED {_EDGES}, root AS (SELECT min(source) AS fqn FROM e),
  d(fqn, depth) AS (SELECT fqn, 0 FROM root UNION SELECT e.target, d.depth + 1 FROM d JOIN e ON e.source = d.fqn WHERE d.depth < 3),
  u(fqn, depth) AS (SELECT fqn, 0 FROM root UNION SELECT e.source, u.depth + 1 FROM u JOIN e ON e.target = u.fqn WHERE u.depth < 3),
  n AS (SELECT fqn, min(p) AS p FROM (SELECT fqn, 0 AS p FROM root UNION ALL SELECT fqn, 1 FROM d UNION ALL SELECT fqn, 2 FROM u) GROUP BY fqn)"""


@query("call_hierarchy", _VIEW + " SELECT fqn, CASE p WHEN 0 THEN 'root' WHEN 1 THEN 'callee' ELSE 'caller' END AS role FROM n")
def call_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph.call_hierarchy(edges, edges.agg(F.min("source")).first()[0])[0].select("fqn", "role")


@query("kept_hierarchy", _VIEW + " SELECT fqn, CASE p WHEN 0 THEN 'root' WHEN 1 THEN 'callee' ELSE 'caller' END AS role FROM n")
def kept_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy walked over edges that are kept in buckets by each end."""
    path = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    adjacency.write(part_edges(spark, sf_dir), path)
    both = adjacency.read(spark, path)
    return graph.call_hierarchy(both, both.out.agg(F.min("source")).first()[0])[0].select("fqn", "role")


@query("callees_view", _reach(_EDGES, 4) + " SELECT fqn, CASE min(depth) WHEN 0 THEN 'root' ELSE 'callee' END AS role, min(depth) AS depth FROM r GROUP BY fqn")
def callees_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph.callees_view(edges, edges.agg(F.min("source")).first()[0])[0].drop("label")


@query("callers_view", _reach(_BACK, 4) + " SELECT fqn, CASE min(depth) WHEN 0 THEN 'root' ELSE 'caller' END AS role, min(depth) AS depth FROM r GROUP BY fqn")
def callers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph.callers_view(edges, edges.agg(F.min("target")).first()[0])[0].drop("label")


@query("graph_vertices", f"SELECT p_partkey AS fqn FROM part UNION SELECT source FROM {_EDGES} UNION SELECT target FROM {_EDGES}")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices_of(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fqn")), part_edges(spark, sf_dir))


@query("induced_edges", _VIEW + " SELECT source, target FROM e WHERE source IN (SELECT fqn FROM n) AND target IN (SELECT fqn FROM n)")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir)
    return graph.call_hierarchy(edges, edges.agg(F.min("source")).first()[0])[1]


@query(
    "resolve_calls",
    """WITH m AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) || '.' || p_name || '(' || p_size || ')' AS fqn, p_name AS name FROM part),
       c AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name AS name, CASE WHEN l_linenumber % 2 = 0 THEN lower(replace(p_brand, '#', '')) ELSE 'x' END AS scope FROM lineitem JOIN part ON p_partkey = l_partkey),
       h AS (SELECT DISTINCT name, scope FROM c), f AS (SELECT name, min(fqn) AS first FROM m GROUP BY 1),
       b AS (SELECT h.name, h.scope, min(m.fqn) AS hinted FROM h JOIN m ON m.name = h.name AND contains(lower(m.fqn), h.scope) GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, l_partkey, coalesce(hinted, first) AS target FROM c JOIN f USING (name) LEFT JOIN b USING (name, scope)""",
)
def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines call their part's name, every other one with the brand as its scope."""
    part = table(spark, sf_dir, "part")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    methods = part.select(F.concat(brand, F.lit("."), "p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("fqn"))
    scope = F.when(F.col("l_linenumber") % 2 == 0, brand).otherwise("X")
    calls = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    calls = calls.select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("source"), F.concat(F.lit("~"), scope, F.lit("."), "p_name").alias("target"))
    return graph.resolve_calls(calls, methods).select("id.*", "target")


@query(
    "field_impact",
    """WITH t AS (SELECT json_extract_string(props, '$.k') AS field_fqn, user_id AS method_fqn, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2, 3),
       c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click')
       SELECT field_fqn, method_fqn, CASE event_type WHEN 'view' THEN 'reader' ELSE 'writer' END AS role, n FROM t
       UNION ALL SELECT field_fqn, method_fqn, 'propagator', n FROM t WHERE event_type = 'view' AND method_fqn IN (SELECT user_id FROM c)""",
)
def field_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impact(event_relationships(spark, sf_dir))


def event_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are methods: a view reads the field props.k, a purchase writes it, a click is a call."""
    kind = F.when(F.col("event_type") == "view", "READS_FIELD").when(F.col("event_type") == "purchase", "WRITES_FIELD").when(F.col("event_type") == "click", "CALLS")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("from_entity_fqn"), F.get_json_object("props", "$.k").alias("to_entity_fqn"), kind.alias("kind")).where("kind is not null")


@query(
    "impact_nodes",
    """WITH t AS (SELECT json_extract_string(props, '$.k') AS f, user_id::VARCHAR AS m, min(CASE event_type WHEN 'view' THEN 1 ELSE 2 END) AS p FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2)
       SELECT f AS field_fqn, m AS id, CASE p WHEN 1 THEN 'reader' ELSE 'writer' END AS role FROM t UNION ALL SELECT DISTINCT f, f, 'field' FROM t""",
)
def impact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = impact.impact(event_relationships(spark, sf_dir)).withColumn("method_fqn", F.col("method_fqn").cast("string"))
    return impact.impact_nodes(found)


@query(
    "impact_edges",
    """WITH t AS (SELECT json_extract_string(props, '$.k') AS f, user_id AS m, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2, 3)
       SELECT f AS field_fqn, m AS source, CASE event_type WHEN 'view' THEN 'READS_FIELD' ELSE 'WRITES_FIELD' END AS kind, n FROM t
       UNION ALL SELECT f, m, 'CALLS', n FROM t WHERE event_type = 'view' AND m IN (SELECT user_id FROM events WHERE event_type = 'click')""",
)
def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.impact_edges(impact.impact(event_relationships(spark, sf_dir))).drop("target")


# --- search ----------------------------------------------------------------------------------------------------


_SEARCHED = r"""WITH d AS (SELECT p_partkey AS id, 'METHOD' AS kind, p_brand || '.' || p_name AS fqn, p_name, regexp_extract_all(lower(p_name), '[a-z0-9_]+(\.[a-z0-9_]+)*') AS n,
            regexp_extract_all(lower(concat_ws(' ', p_name, trim(regexp_replace(p_name, '([A-Z])', ' \1', 'g')), replace(p_name, '.', ' '), p_brand || '.' || p_name, trim(regexp_replace(p_brand || '.' || p_name, '([A-Z])', ' \1', 'g')), replace(p_brand || '.' || p_name, '.', ' '),
              p_brand, trim(regexp_replace(p_brand, '([A-Z])', ' \1', 'g')), replace(p_brand, '.', ' '), p_type, trim(regexp_replace(p_type, '([A-Z])', ' \1', 'g')), replace(p_type, '.', ' '))), '[a-z0-9_]+(\.[a-z0-9_]+)*') AS s FROM part)"""
_STARTS = "3.0 * len(list_filter(n, lambda t: starts_with(t, 'bo'))).sign() + 2.0 * starts_with(fqn, 'bo')::INT + 1.0 * len(list_filter(s, lambda t: starts_with(t, 'bo'))).sign()"
_EQUALS = "3.0 * len(list_filter(n, lambda t: t = 'brand')).sign() + 2.0 * (fqn = 'brand')::INT + 1.0 * len(list_filter(s, lambda t: t = 'brand')).sign()"
_HITS = "SELECT id::VARCHAR AS id, kind, fqn, score::DOUBLE AS score FROM x ORDER BY score DESC, kind, fqn, id::VARCHAR LIMIT 30"


def searched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are methods, named by their names, declared by their brands."""
    part = table(spark, sf_dir, "part")
    methods = part.select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_brand", F.lit("."), "p_name").alias("fqn"), F.col("p_name").alias("simple_name"), F.col("p_brand").alias("declaring_type_fqn"), F.col("p_type").alias("return_type"))
    none = methods.limit(0)
    return search.documents(none.withColumns({"kind": F.lit(""), "package_fqn": F.lit("")}), methods, none.withColumn("field_type", F.lit("")))


@query("prefix_search", f"{_SEARCHED}, x AS (SELECT *, {_STARTS} AS score FROM d WHERE {_STARTS} > 0) {_HITS}")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(searched_parts(spark, sf_dir), "Bo").select("id", "kind", "fqn", "score")


@query("terms_search", f"{_SEARCHED}, x AS (SELECT *, {_STARTS} + {_EQUALS} AS score FROM d WHERE {_STARTS} > 0 AND {_EQUALS} > 0) {_HITS}")
def terms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both terms are required, the last one as a prefix."""
    return search.search(searched_parts(spark, sf_dir), "brand Bo").select("id", "kind", "fqn", "score")


@query("signs_search", f"{_SEARCHED}, x AS (SELECT *, 1.0 AS score FROM d WHERE contains(fqn, '#')) {_HITS}")
def signs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without a token is looked for as it stands."""
    return search.search(searched_parts(spark, sf_dir), " # ").select("id", "kind", "fqn", "score")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(\.[\p{L}\p{N}_]+)*')"


_RANKED = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), q AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS})) AS token FROM benchmark),
        t AS (SELECT doc_id, len(w) AS size, unnest(w) AS token FROM d), h AS (SELECT doc_id, size, token, count(*) AS tf FROM t WHERE token IN (SELECT token FROM q) GROUP BY ALL),
        f AS (SELECT token, count(*) AS df FROM h GROUP BY 1), a AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
        s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
        FROM h JOIN f USING (token) JOIN q USING (token), a GROUP BY 1, 2)
        SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30"""


@query("ranked_search", _RANKED)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark text against the documents: its 30 best."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scored = search.bm25(table(spark, sf_dir, "documents"), queries).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(best)).where("place <= 30").drop("place")


def _built(spark: SparkSession) -> str:
    """A new folder for an index, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


@query("index_search", f"{_SEARCHED}, x AS (SELECT *, {_STARTS} AS score FROM d WHERE {_STARTS} > 0) {_HITS}")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix_search from a stored index, which reads the shards that can still bring a hit."""
    path = _built(spark)
    index.write_entities(searched_parts(spark, sf_dir), path)
    return index.search_entities(spark, path, "Bo").select("id", "kind", "fqn", "score")


@query("index_terms_search", f"{_SEARCHED}, x AS (SELECT *, {_STARTS} + {_EQUALS} AS score FROM d WHERE {_STARTS} > 0 AND {_EQUALS} > 0) {_HITS}")
def index_terms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _built(spark)
    index.write_entities(searched_parts(spark, sf_dir), path)
    return index.search_entities(spark, path, "brand Bo").select("id", "kind", "fqn", "score")


@query(
    "index_wildcard_search",
    "SELECT p_partkey AS id, p_name AS simple_name FROM part WHERE lower(p_type) LIKE '%b_l%t%' OR lower(p_name) LIKE '%b_l%t%' ORDER BY p_name, p_partkey LIMIT 50",
)
def index_wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wildcard_search from a stored index of runs of signs, which reads the folders that hold them."""
    path = _built(spark)
    index.write_types(part_types(spark, sf_dir), path, shard_rows=1024)
    return index.search_types(spark, path, "B_l%t").select("id", "simple_name")


@query("index_signs_search", f"{_SEARCHED}, x AS (SELECT *, 1.0 AS score FROM d WHERE contains(fqn, '#')) {_HITS}")
def index_signs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _built(spark)
    index.write_entities(searched_parts(spark, sf_dir), path)
    return index.search_entities(spark, path, " # ").select("id", "kind", "fqn", "score")


@query("index_ranked_search", _RANKED)
def index_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ranked_search from a stored index of the documents."""
    path = _built(spark)
    index.write_texts(table(spark, sf_dir, "documents"), path)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search_texts(spark, path, queries, 30, digits=6).select("query_id", "doc_id", "score")


# --- extraction ------------------------------------------------------------------------------------------------


def supplier_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a class for each nation, with a field and a method for each of its suppliers, one a line."""
    key = lambda c: F.col(c).cast("string")
    members = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    rows = table(spark, sf_dir, "nation").join(members, F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    fields = F.transform("keys", lambda k: F.concat(F.lit("  int f"), k.cast("string"), F.lit(" = "), k.cast("string"), F.lit(";\n")))
    methods = F.transform(
        "keys",
        lambda k: F.concat(F.lit("  void m"), k.cast("string"), F.lit("(int a) { if (a > 0 && a < 9) { this.f"), k.cast("string"), F.lit(" = a; } m"), k.cast("string"), F.lit("(a); other.go(f"), k.cast("string"), F.lit("); }\n")),
    )
    head = F.concat(F.lit("package r"), key("n_regionkey"), F.lit(";\npublic class N"), key("n_nationkey"), F.lit(" extends Base implements One, Two {\n"))
    return rows.select(
        F.concat(F.lit("/src/r"), key("n_regionkey"), F.lit("/N"), key("n_nationkey"), F.lit(".java")).alias("path"),
        F.concat(head, F.array_join(fields, ""), F.array_join(methods, ""), F.lit("}\n")).alias("content"),
    )


_MEMBERS = """(SELECT 'r' || n_regionkey || '.N' || n_nationkey AS type, s_suppkey AS k, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY n_nationkey) AS n
               FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(
    "extract_types",
    """SELECT 'r' || n_regionkey || '.N' || n_nationkey AS fqn, 'r' || n_regionkey AS package_fqn, 'CLASS' AS kind, 'public' AS modifiers, 'Base' AS super_class, 'One,Two' AS interfaces, 2 AS start_line,
       (3 + 2 * count(s_suppkey))::INT AS end_line, (2 + 2 * count(s_suppkey))::INT AS line_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey""",
)
def extract_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = java.extract(supplier_sources(spark, sf_dir))["types"]
    return found.select("fqn", "package_fqn", "kind", "modifiers", "super_class", F.array_join("interfaces", ",").alias("interfaces"), "start_line", "end_line", "line_count")


@query("extract_fields", f"SELECT type || '.f' || k AS fqn, type AS declaring_type_fqn, 'int' AS field_type, k::VARCHAR AS initializer, (2 + i)::INT AS start_line FROM {_MEMBERS}")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.extract(supplier_sources(spark, sf_dir))["fields"].select("fqn", "declaring_type_fqn", "field_type", "initializer", "start_line")


@query(
    "extract_methods",
    f"SELECT type || '.m' || k || '(int)' AS fqn, type AS declaring_type_fqn, 'void' AS return_type, 1 AS n_parameters, (2 + n + i)::INT AS start_line, (2 + n + i)::INT AS end_line, 3 AS cyclomatic_complexity FROM {_MEMBERS}",
)
def extract_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = java.extract(supplier_sources(spark, sf_dir))["methods"]
    return found.select("fqn", "declaring_type_fqn", "return_type", F.size("parameters").alias("n_parameters"), "start_line", "end_line", "cyclomatic_complexity")


@query(
    "extract_relationships",
    f"""WITH m AS {_MEMBERS}, t AS (SELECT 'r' || n_regionkey || '.N' || n_nationkey AS type FROM nation)
        SELECT type || '.m' || k || '(int)' AS from_entity_fqn, type || '.f' || k AS to_entity_fqn, 'WRITES_FIELD' AS kind, 0 AS source_line FROM m
        UNION ALL SELECT type || '.m' || k || '(int)', type || '.f' || k, 'READS_FIELD', 0 FROM m
        UNION ALL SELECT type || '.m' || k || '(int)', type || '.m' || k, 'CALLS', (2 + n + i)::INT FROM m
        UNION ALL SELECT type || '.m' || k || '(int)', '~other.go', 'CALLS', (2 + n + i)::INT FROM m
        UNION ALL SELECT type, 'Base', 'EXTENDS', 0 FROM t UNION ALL SELECT type, 'One', 'IMPLEMENTS', 0 FROM t UNION ALL SELECT type, 'Two', 'IMPLEMENTS', 0 FROM t""",
)
def extract_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.extract(supplier_sources(spark, sf_dir))["relationships"].select("from_entity_fqn", "to_entity_fqn", "kind", "source_line")


@query(
    "extract_packages",
    """SELECT 'r' || n_regionkey AS fqn, NULL AS parent_fqn, count(*)::INT AS file_count, count(*)::INT AS type_count FROM nation GROUP BY n_regionkey""",
)
def extract_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.extract(supplier_sources(spark, sf_dir))["packages"].select("fqn", "parent_fqn", "file_count", "type_count")


# --- scalars ---------------------------------------------------------------------------------------------------


@query("body_hash", r"SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) AS body_hash FROM documents")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.body_hash("text").alias("body_hash"))


@query(
    "fqn_labels",
    """SELECT s_suppkey, lower(n_name) || '.' || replace(s_name, '#', '.') || '(int,long)' AS fqn, split_part(replace(s_name, '#', '.'), '.', -1) AS simple_name,
       CASE WHEN contains(s_name, '#') THEN replace(s_name, '#', '.') ELSE lower(n_name) || '.' || s_name END AS label, upper(substr(n_name, 1, 1)) AS initials FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def fqn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("fqn", F.concat(F.lower("n_name"), F.lit("."), F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("(int,long)")))
    return rows.select("s_suppkey", "fqn", S.simple_method_name("fqn").alias("simple_name"), S.label("fqn").alias("label"), S.initials("n_name").alias("initials"))


@query("progress_pct", "SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE least(100, floor(o_orderkey % 60 * 100 / (o_custkey % 50)))::INT END AS pct FROM orders")
def progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.progress_percent(F.col("o_orderkey") % 60, F.col("o_custkey") % 50).alias("pct"))


@query("json_params", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 30) AS k, coalesce(try_cast(event_type AS INT), 4) AS depth FROM events")
def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.integer_parameter(F.get_json_object("props", "$.k"), 30).alias("k"), S.integer_parameter("event_type", 4).alias("depth"))


@query(
    "epoch_times",
    """SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 7919 * 1000000), '%Y-%m-%d %H:%M:%S') AS of_seconds,
       strftime(make_timestamp((o_orderkey * 999983 // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS of_millis FROM orders""",
)
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.epoch_seconds_text(key * 7919).alias("of_seconds"), S.epoch_millis_text(key * 999983).alias("of_millis"))
