"""Analysts' notes beside the snapshots: a log that is only added to, so that notes outlive scans and clears.

Writing a note adds a row, and so does taking one away; what counts of each note is its last row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions import model
from lithograph.operators import maintenance

_LOG = "id string, entity_fqn string, content string, at long, turn long, tie string, gone boolean"


def _log(spark: SparkSession, store: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/notes")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_LOG).parquet(f"{store}/notes") if there else spark.createDataFrame([], _LOG)


def _append(spark: SparkSession, store: str, note_id: str, entity: str | None, content: str | None, now_ms: int | None, gone: bool) -> None:
    turn = (_log(spark, store).agg(F.max("turn")).first()[0] or 0) + 1
    spark.createDataFrame([(note_id, entity, content, now_ms, turn, uuid.uuid4().hex, gone)], _LOG).coalesce(1).write.mode("append").parquet(f"{store}/notes")


def write(spark: SparkSession, store: str, entity: str, content: str, now_ms: int, note_id: str | None = None) -> str:
    """Put in a note, or replace the one of that id: both its times become now; its id."""
    note_id = note_id or str(uuid.uuid4())
    _append(spark, store, note_id, entity, content, now_ms, False)
    return note_id


def delete(spark: SparkSession, store: str, note_id: str) -> bool:
    """Take a note away; whether it was there."""
    there = not load(spark, store).where(F.col("id") == note_id).isEmpty()
    if there:
        _append(spark, store, note_id, None, None, None, True)
    return there


def load(spark: SparkSession, store: str, entity: str | None = None) -> DataFrame:
    """The notes that count, of one entity or all, in the model's columns; an empty store has none."""
    last = maintenance.last_wins(_log(spark, store), ["id"], ["turn", "tie"]).where("not gone")
    rows = last.select("id", "entity_fqn", "content", F.col("at").alias("created_at"), F.col("at").alias("updated_at")).select(*model.TABLES["analyst_notes"].names)
    return rows if entity is None else rows.where(F.col("entity_fqn") == entity)
