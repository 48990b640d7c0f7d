"""Change history: the newest change in a range of lines, authors and churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.functions.scalars import first_line, hot_label, short_hash


def commit_counts(changes: DataFrame) -> DataFrame:
    """(file, commit_count) of (file, commit) rows."""
    return changes.groupBy("file").agg(F.countDistinct("commit").cast("int").alias("commit_count"))


def entity_files(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Entities with the file of their declaring type, of types with one fqn the first by ord; without a type they go."""
    first = types.groupBy(F.col("fqn").alias("declaring_type_fqn")).agg(F.min_by("source_file", "ord").alias("file"))
    return entities.join(first, "declaring_type_fqn")


def newest_change(entities: DataFrame, blame: DataFrame, counts: DataFrame, width: int = 256) -> DataFrame:
    """git_meta of entities (fqn, file, start_line, end_line): the newest commit on their lines, ties to the first line.

    Lines are from 1; a start below 1 is 1 and an end before the start is the start.  Blame rows without a commit don't
    count, and an entity without any has no row.  The range join is an equi-join on file and bucket of `width` lines:
    an entity asks every bucket that it spans, a line stands in one.
    """
    start = F.greatest(F.lit(1), F.col("start_line"))
    end = F.greatest(start, F.col("end_line"))
    asked = entities.select("fqn", "file", start.alias("lo"), end.alias("hi")).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)))
    )
    lines = blame.where(F.col("commit").isNotNull()).withColumn("bucket", F.floor(F.col("line") / width))
    newest = F.max_by(F.struct("author", "email", "author_time", "commit", "message"), F.struct("commit_time", -F.col("line")))
    found = (
        asked.join(lines, ["file", "bucket"]).where(F.col("line").between(F.col("lo"), F.col("hi"))).groupBy("fqn", "file").agg(newest.alias("c"))
    )
    return found.join(counts, "file", "left").select(
        F.col("fqn").alias("entity_fqn"),
        F.col("c.author").alias("last_author_name"),
        F.col("c.email").alias("last_author_email"),
        F.col("c.author_time").alias("last_commit_time"),
        short_hash("c.commit").alias("last_commit_hash"),
        first_line("c.message").alias("last_commit_msg"),
        F.coalesce("commit_count", F.lit(0)).alias("commit_count"),
    )


def top_authors(git_meta: DataFrame, limit: int = 10) -> DataFrame:
    """Authors by how many entities they changed last."""
    return (
        git_meta.where(F.col("last_author_name").isNotNull())
        .groupBy(F.col("last_author_name").alias("name"), F.col("last_author_email").alias("email"))
        .agg(F.count("*").alias("entity_count"), F.max("last_commit_time").alias("last_change"))
        .orderBy(F.desc("entity_count"), "name", F.asc_nulls_first("email"))
        .limit(limit)
    )


def hottest_entities(git_meta: DataFrame, limit: int = 20) -> DataFrame:
    """Entities by their file's commits, those without any left out."""
    return (
        git_meta.where("commit_count > 0")
        .orderBy(F.desc("commit_count"), "entity_fqn")
        .limit(limit)
        .withColumn("label", hot_label("entity_fqn"))
    )
