"""Incremental scans: a stream of source files keeps a store of sources, and its snapshot, up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithograph.operators import maintenance
from lithograph.plans import scan

_FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, root: str, store: str, checkpoint: str, follow: bool = False) -> StreamingQuery:
    """Take in the .java files below root that are new since the checkpoint; with follow, those to come as well.

    Each batch parses its own files alone, the newest text of a path counting, and publishes a snapshot in which they are
    put in or replaced.  A batch that runs again after a failure replaces its files by the same once more.
    """
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root)
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("at"))

    def batch(new: DataFrame, number: int) -> None:
        if new.isEmpty():
            return
        latest = maintenance.last_wins(new, ["path"], ["at"]).select("path", "content")
        scan.refresh(new.sparkSession, latest, store)

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(f"ingest-{uuid.uuid4().hex}")
    return query.start() if follow else query.trigger(availableNow=True).start()
