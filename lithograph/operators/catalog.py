"""Lookups, lists, counts and details over the model's tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.operators.state import cut


def by_id(rows: DataFrame, value: str, column: str = "id") -> DataFrame:
    """The row of an id."""
    return rows.where(F.col(column) == value).limit(1)


def listed(rows: DataFrame, column: str, value, *order) -> DataFrame:
    """The rows whose column has the value, in order; add a key to the order where it ties."""
    return rows.where(F.col(column) == value).orderBy(*order)


def in_order(rows: DataFrame, *order) -> DataFrame:
    """All rows by their fqn, or by another order."""
    return rows.orderBy(*(order or ("fqn",)))


def search_types(types: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Types whose fqn or simple name holds the text in any case; % and _ in it are wildcards, as they aren't escaped."""
    pattern = f"%{text.lower()}%"
    return (
        types.where(F.lower("fqn").like(pattern) | F.lower("simple_name").like(pattern)).orderBy(F.asc_nulls_first("simple_name"), "id").limit(limit)
    )


def types_or_search(types: DataFrame, text: str | None) -> DataFrame:
    """All types by fqn where the text is blank, else a search."""
    return search_types(types, text) if text and text.strip() else in_order(types)


def with_kind(rows: DataFrame, kind: str | None) -> DataFrame:
    """The rows of one kind, or all."""
    return rows if kind in (None, "", "ALL") else rows.where(F.col("kind") == kind)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()))


def package_tree(packages: DataFrame) -> DataFrame:
    """(fqn, parent_fqn, is_root): a package whose parent isn't there is a root."""
    parents = packages.select(F.col("fqn").alias("parent")).distinct()
    return packages.join(parents, F.col("parent_fqn") == F.col("parent"), "left").select("fqn", "parent_fqn", F.col("parent").isNull().alias("is_root"))


def with_source_file(members: DataFrame, types: DataFrame) -> DataFrame:
    """Methods or fields with the source file of their declaring type, empty where there is none."""
    files = types.groupBy(F.col("fqn").alias("declaring_type_fqn")).agg(F.min("source_file").alias("source_file"))
    return members.join(files, "declaring_type_fqn", "left").withColumn("source_file", F.coalesce("source_file", F.lit("")))


def type_details(types: DataFrame, fields: DataFrame, methods: DataFrame, notes: DataFrame) -> DataFrame:
    """Each type with its fields and methods by line and its notes, newest first, as arrays."""

    def nested(rows: DataFrame, key: str, name: str, *order: str) -> DataFrame:
        # struct fields sort in order of place, so the sort keys come first
        value = F.struct(*order, *(c for c in rows.columns if c not in order))
        return rows.groupBy(F.col(key).alias("fqn")).agg(F.array_sort(F.collect_list(value)).alias(name))

    newest = notes.withColumn("age", -F.col("created_at"))
    out = types.join(nested(fields, "declaring_type_fqn", "fields", "start_line", "id"), "fqn", "left")
    out = out.join(nested(methods, "declaring_type_fqn", "methods", "start_line", "id"), "fqn", "left")
    out = out.join(nested(newest, "entity_fqn", "notes", "age", "id"), "fqn", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("fields", "methods", "notes")})


def member_counts(types: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Each type's fqn with its number of members, 0 where it has none."""
    n = members.groupBy(F.col("declaring_type_fqn").alias("fqn")).agg(F.count("*").alias(name))
    return types.select("fqn").join(n, "fqn", "left").select("fqn", F.coalesce(name, F.lit(0)).alias(name))


def package_type_counts(packages: DataFrame, types: DataFrame) -> DataFrame:
    n = types.groupBy(F.col("package_fqn").alias("fqn")).agg(F.count("*").alias("type_count"))
    return packages.select("fqn").join(n, "fqn", "left").select("fqn", F.coalesce("type_count", F.lit(0)).alias("type_count"))


def _trie(paths: DataFrame, *kept: str) -> DataFrame:
    """(id, parent, part, depth, above, last, kept) for each beginning of each path (an array of parts); the parent of a first part is ''.

    An id is a hash of the parent's id and the part, so that what goes over the network grows with a path's length and not with
    the sum of its beginnings' lengths.  above are the ids of the beginnings before; last says that the path ends here.
    """
    ids = F.aggregate("parts", F.array().cast("array<string>"), lambda ids, part: F.concat(ids, F.array(F.md5(F.concat(F.coalesce(F.try_element_at(ids, F.lit(-1)), F.lit("")), F.lit("/"), part)))))
    each = paths.withColumn("ids", ids).select(*kept, "parts", "ids", F.posexplode("ids").alias("i", "id"))
    above = F.slice("ids", F.lit(1), F.col("i"))
    return each.select(*kept, "id", F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit("")).alias("parent"), F.get("parts", "i").alias("part"), (F.col("i") + 1).alias("depth"), above.alias("above"), (F.col("i") + 1 == F.size("ids")).alias("last"))


def package_file_counts(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(fqn, file_count) of each package: files whose path holds the package's path, or files beyond the first that declare it, if more.

    declared has a fqn for each file that declares it; files has a path for each file.  A path holds `a/b` where `a/b/` stands in it,
    from within a folder's name on too.  Folders and packages are two tries, walked together: a package's first part meets the
    ends of the distinct folder names, each further part the folders right below.  So a folder is met once for each beginning that
    leads to it, and its files are a count kept in the trie.  Of places of one package below each other the outermost counts.
    A null fqn is a package that no path holds.
    """
    again = declared.groupBy("fqn").agg((F.count("*") - 1).alias("again"))
    path = F.translate("path", "\\", "/")
    folders = files.select(F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.split("folder", "/")
    nodes = _trie(folders.select("n", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("parts")), "n")
    nodes = cut(nodes.groupBy("id", "parent", "part", "above").agg(F.sum("n").alias("n")))
    wanted = _trie(again.where("fqn is not null").select("fqn", F.split(F.translate("fqn", ".", "/"), "/").alias("parts")), "fqn")
    wanted = cut(wanted.select("id", "parent", "part", "depth", F.when(F.col("last"), F.col("fqn")).alias("fqn")).distinct())
    steps = wanted.groupBy(F.col("id").alias("package"), F.col("parent").alias("before"), F.col("part").alias("step")).agg(F.max("depth").alias("depth"))
    name_ends = nodes.select("part").distinct().select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("part") + 1), lambda i: F.col("part").substr(i, F.length("part")))).alias("step"))
    starts = name_ends.join(steps.where("before = ''"), "step").select("part", "package")
    levels = [cut(nodes.join(starts, "part").select("package", "id"))]
    for _ in range(1, wanted.agg(F.max("depth")).first()[0] or 0):
        below = nodes.select(F.col("parent").alias("id"), F.col("id").alias("child"), F.col("part").alias("step")).join(levels[-1].withColumnRenamed("package", "before"), "id")
        levels.append(cut(below.join(steps, ["before", "step"]).select("package", F.col("child").alias("id"))))
        if levels[-1].isEmpty():
            break
    named = wanted.where("fqn is not null").select("fqn", F.col("id").alias("package"))
    met = reduce(DataFrame.union, levels).join(named.select("package"), "package", "left_semi")
    full = met.join(nodes.select("id", "above", "n"), "id")
    outer = met.select("package", F.col("id").alias("up"))
    within = full.select("package", "id", F.explode("above").alias("up")).join(outer, ["package", "up"], "left_semi").select("package", "id").distinct()
    held = full.join(within, ["package", "id"], "left_anti").groupBy("package").agg(F.sum("n").alias("held")).join(named, "package").select("fqn", "held")
    return again.join(held, "fqn", "left").select("fqn", F.greatest("again", F.coalesce("held", F.lit(0))).alias("file_count"))


def with_git_meta(entities: DataFrame, git_meta: DataFrame, key: str = "fqn") -> DataFrame:
    return entities.join(git_meta, F.col(key) == F.col("entity_fqn"), "left").drop("entity_fqn")


def heat(nodes: DataFrame, hot: DataFrame, key: str = "fqn") -> DataFrame:
    """Each node's commit count among the hot entities, 0 elsewhere, and its ratio to the highest."""
    top = hot.agg(F.greatest(F.max("commit_count"), F.lit(1)).alias("most"))  # one row
    n = F.coalesce("commit_count", F.lit(0))
    joined = nodes.join(hot.select(F.col("entity_fqn").alias(key), "commit_count"), key, "left")
    return joined.crossJoin(F.broadcast(top)).select(key, n.alias("commit_count"), (n / F.col("most")).alias("heat"))


def with_ratio(rows: DataFrame, column: str = "commit_count") -> DataFrame:
    """The rows with their column's ratio to its maximum."""
    top = rows.agg(F.greatest(F.max(column), F.lit(1)).alias("most"))  # one row
    return rows.crossJoin(F.broadcast(top)).withColumn("ratio", F.col(column) / F.col("most")).drop("most")


def scan_totals(files: DataFrame) -> DataFrame:
    """(total, parsed, failed) of (path, ok) rows."""
    return files.agg(F.count("*").alias("total"), F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("failed"))


def ranked(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in order, numbered from 1; only as many as the report shows meet in one task."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
