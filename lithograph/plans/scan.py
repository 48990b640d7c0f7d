"""A scan: sources to a snapshot of the model's tables, and a snapshot's tables to queries.

What was found in a file is kept by file: rows carry their file's path and the batch that read it, and a snapshot says which batch of
each file counts.  So a batch of changed files is parsed alone, and its rows take the place of what these files gave before.  A
snapshot is a folder of its own.  It counts from the moment that its row is in the list of snapshots, so readers never
see half a scan; notes are kept beside the snapshots and outlive them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions import model
from lithograph.operators import adjacency, catalog, graph, history, index, maintenance, reports, search
from lithograph.operators.state import cut
from lithograph.sources import git, java

#: What extraction gives for each file.
_FOUND = ("types", "fields", "methods", "relationships", "declared")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The table's rows as they are stored: the last of each id, in the model's columns and types."""
    schema = model.TABLES[name]
    kept = maintenance.last_wins(rows, [model.KEYS[name]], ["ord"]) if "ord" in rows.columns else rows
    return kept.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def scan(spark: SparkSession, root: str, store: str) -> dict[str, int]:
    """Read all Java sources below root and make their snapshot the newest one of store; total, parsed and failed files.

    ValueError where root isn't there.  Files with errors are counted and left out.  Without a repository, or where git
    fails, git_meta is empty.
    """
    return publish(spark, java.read_sources(spark, root), store, git.repository_root(root))


def publish(spark: SparkSession, files: DataFrame, store: str, repository: str | None = None) -> dict[str, int]:
    """scan() of (path, content) rows: they alone are the new snapshot."""
    return _advance(spark, files, store, repository, None, None)


def refresh(spark: SparkSession, files: DataFrame, store: str, repository: str | None = None, removed: DataFrame | None = None) -> dict[str, int]:
    """The newest snapshot with the files (path, content) put in or replaced, and those of removed (path) gone; totals of all files.

    Only the given files are parsed, and only reports on names of changed files are worked out again; the tables, the index and
    the history are made of the kept rows.  The result is that of publish() with all files.  A path may stand in files once.
    """
    return _advance(spark, files, store, repository, _newest(spark, store), removed)


def clear(spark: SparkSession, store: str) -> None:
    """Make an empty snapshot the newest one; notes stay."""
    publish(spark, spark.createDataFrame([], "path string, content string"), store)


def expire(spark: SparkSession, store: str, keep: int = 2) -> list[str]:
    """Remove the folders of all but the newest `keep` snapshots, and the files' rows that no kept one counts; what was removed.

    Who still reads a kept snapshot is not disturbed: `keep` says how many scans a reader may last.  The list of snapshots keeps its rows.
    """
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    turns = [r.folder for r in spark.read.parquet(f"{store}/snapshots").orderBy(F.desc("turn"), "folder").select("folder").collect()]  # a row a scan
    kept = turns[:keep]
    # a row for each batch that some file's rows still come from
    used = {r.batch for folder in kept for r in spark.read.parquet(f"{folder}/owners").select("batch").distinct().collect()} | {folder.rsplit("/", 1)[1] for folder in kept}
    gone = [folder for folder in turns[keep:] if fs.exists(jvm.org.apache.hadoop.fs.Path(folder))]
    old = [f"{store}/raw/{name}/batch={folder.rsplit('/', 1)[1]}" for name in _FOUND for folder in turns[keep:] if folder.rsplit("/", 1)[1] not in used]
    removed = gone + [path for path in old if fs.exists(jvm.org.apache.hadoop.fs.Path(path))]
    for folder in gone:
        adjacency.forget(spark, f"{folder}/calls")
    for path in removed:
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
    return removed


def _live(spark: SparkSession, store: str, owners: DataFrame, name: str) -> DataFrame:
    """The rows that the files of a snapshot gave."""
    rows = spark.read.parquet(f"{store}/raw/{name}").withColumn("path", F.col("path" if name == "declared" else "ord.path"))
    return rows.join(owners.select("path", "batch"), ["path", "batch"], "left_semi").drop("batch", *([] if name == "declared" else ["path"]))


def _advance(spark: SparkSession, files: DataFrame, store: str, repository: str | None, before, removed: DataFrame | None) -> dict[str, int]:
    number = f"b{uuid.uuid4().hex}"  # with a letter first, so that no number is read from the folder's name
    folder = f"{store}/{number}"
    found = java.extract(files)
    for name in _FOUND:
        found[name].write.parquet(f"{store}/raw/{name}/batch={number}")  # also without rows, as the file tells the columns
    owners = found["files"].select("path", "ok", F.lit(number).alias("batch"))
    old = spark.read.parquet(f"{before.folder}/owners") if before else None
    if before:
        changed = owners.select("path") if removed is None else owners.select("path").union(removed.select("path"))
        owners = owners.union(old.join(changed, "path", "left_anti").select("path", "ok", "batch"))
    owners.write.parquet(f"{folder}/owners")
    owners = spark.read.parquet(f"{folder}/owners")
    raw = {name: _live(spark, store, owners, name) for name in _FOUND}
    packages = java.package_rows(raw["declared"], raw["types"], owners.select("path"))
    for name, rows in ({n: raw[n] for n in ("types", "fields", "methods", "relationships")} | {"packages": packages}).items():
        _stored(rows, name).write.parquet(f"{folder}/{name}")
    adjacency.write(_call_edges(*(spark.read.parquet(f"{folder}/{n}") for n in ("relationships", "methods"))), f"{folder}/calls")
    # reports and the index see every row that was found, the stored tables the last of each id
    members = _report_members(raw["methods"], raw["fields"])
    if before:
        # names that a changed file has now or had before
        new = owners.where(F.col("batch") == number)
        gone = old.join(owners.select("path", "batch"), ["path", "batch"], "left_anti")
        sides = [_report_members(_live(spark, store, o, "methods"), _live(spark, store, o, "fields")).select("pass", "key") for o in (new, gone)]
        touched = cut(sides[0].union(sides[1]).distinct())
        kept = spark.read.parquet(f"{before.folder}/report_groups")
        for key in ("key1", "key2"):
            kept = kept.join(touched.withColumnRenamed("key", key), ["pass", key], "left_anti")
        again = reports.groups(members, touched)
        kept.select(again.columns).union(again).write.parquet(f"{folder}/report_groups")
    else:
        reports.groups(members).write.parquet(f"{folder}/report_groups")
    index.write_entities(search.documents(raw["types"], raw["methods"], raw["fields"]), f"{folder}/index")
    index.write_types(spark.read.parquet(f"{folder}/types"), f"{folder}/type_names")
    spans = [raw[n].select("fqn", "declaring_type_fqn", "start_line", F.col("end_line") if n == "methods" else F.col("start_line").alias("end_line")) for n in ("methods", "fields")]
    own = raw["types"].select("fqn", F.col("fqn").alias("declaring_type_fqn"), "start_line", "end_line")
    entities = history.entity_files(spans[0].unionByName(spans[1]).unionByName(own).dropDuplicates(["fqn"]), raw["types"])
    if repository:
        paths = raw["types"].select(F.col("source_file").alias("file"))
        meta = history.newest_change(entities, git.blame_lines(paths, repository), history.commit_counts(git.file_commits(paths, repository)))
    else:
        meta = spark.createDataFrame([], model.TABLES["git_meta"])
    _stored(meta, "git_meta").write.parquet(f"{folder}/git_meta")
    totals = owners.agg(F.count("*").alias("total"), F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("failed")).first().asDict()
    turn = (_newest(spark, store) or (0, ""))[0] + 1
    spark.createDataFrame([(turn, folder)], "turn int, folder string").write.mode("append").parquet(f"{store}/snapshots")
    return totals


def _newest(spark: SparkSession, store: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/snapshots")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{store}/snapshots").orderBy(F.desc("turn"), "folder").first()


def _report_members(methods: DataFrame, fields: DataFrame) -> DataFrame:
    return reports.members(methods.withColumn("parameter_count", F.size("parameters")), fields)


def _folder(spark: SparkSession, store: str) -> str:
    newest = _newest(spark, store)
    if newest is None:
        raise ValueError(f"no snapshot in {store}")
    return newest.folder


def load(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table (or `search`, the searched rows, or `report_groups`) of the newest snapshot; ValueError before the first scan.

    Inconsistencies are stored as groups: all their pairs are worked out when they are loaded.
    """
    folder = _folder(spark, store)
    if name == "inconsistencies":
        pairs = reports.expand(spark.read.parquet(f"{folder}/report_groups"), _members_of(spark, store, folder))
        return pairs.select(*(F.col(f.name).cast(f.dataType) for f in model.TABLES[name]))
    return spark.read.parquet(f"{folder}/index/docs").drop("shard") if name == "search" else spark.read.parquet(f"{folder}/{name}")


def find(spark: SparkSession, store: str, text: str | None, limit: int = 30) -> DataFrame:
    """The newest snapshot's entities that match a text, best first, from its index."""
    return index.search_entities(spark, f"{_folder(spark, store)}/index", text, limit)


def find_types(spark: SparkSession, store: str, text: str | None, limit: int = 50) -> DataFrame:
    """The newest snapshot's types whose fqn or simple name holds a text in any case, from its index; all by fqn where the text is blank."""
    if not text or not text.strip():
        return catalog.in_order(load(spark, store, "types"))
    return index.search_types(spark, f"{_folder(spark, store)}/type_names", text, limit)


def _members_of(spark: SparkSession, store: str, folder: str) -> DataFrame:
    owners = spark.read.parquet(f"{folder}/owners")
    return _report_members(_live(spark, store, owners, "methods"), _live(spark, store, owners, "fields"))


def first_reports(spark: SparkSession, store: str, limit: int = 200, kind: str | None = None) -> DataFrame:
    """The first inconsistencies of the newest snapshot in the report's order, of one kind or all, without making the others."""
    folder = _folder(spark, store)
    return reports.first(spark.read.parquet(f"{folder}/report_groups"), _members_of(spark, store, folder), limit, kind)


def statistics(spark: SparkSession, store: str) -> DataFrame:
    """(table_name, n) of what the statistics count; inconsistencies by their groups' numbers of pairs."""
    tables = {n: load(spark, store, n) for n in model.COUNTED if n != "inconsistencies"}
    found = load(spark, store, "report_groups").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"))
    return catalog.counts(tables).unionByName(found.select(F.lit("inconsistencies").alias("table_name"), "n"))


def _call_edges(relationships: DataFrame, methods: DataFrame) -> DataFrame:
    calls = relationships.where("kind = 'CALLS'").select("id", F.col("from_entity_fqn").alias("source"), F.col("to_entity_fqn").alias("target"))
    return graph.edges_of(graph.resolve_calls(calls, methods.select("fqn")))


def call_graph(spark: SparkSession, store: str) -> graph.Adjacency:
    """The call graph of the newest snapshot as it is kept, for walks either way: distinct (source, target), calls put to methods."""
    return adjacency.read(spark, f"{_folder(spark, store)}/calls")


def call_edges(spark: SparkSession, store: str) -> DataFrame:
    """The kept edges of call_graph(), by source."""
    return call_graph(spark, store).out
