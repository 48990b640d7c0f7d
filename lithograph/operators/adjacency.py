"""A call graph kept for walking: its edges in buckets by source, and again by target."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators.graph import Adjacency
from lithograph.operators.state import cut

#: The folder of each side and the column that its buckets are by.
_SIDES = {"out": "source", "into": "target"}


def _table(path: str, side: str) -> str:
    return f"edges_{side}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def write(edges: DataFrame, path: str, bucket_edges: int = 1 << 20) -> None:
    """Keep edges (source, target) below path, which must be new.  A bucket has about bucket_edges edges, and a file of its own."""
    edges = cut(edges.select("source", "target"))
    buckets = max(1, -(-edges.count() // bucket_edges))
    spark = edges.sparkSession
    for side, column in _SIDES.items():
        dealt = edges.repartition(buckets, column).sortWithinPartitions(column)
        dealt.write.bucketBy(buckets, column).sortBy(column).option("path", f"{path}/{side}").mode("error").saveAsTable(_table(path, side))
        dealt.limit(0).write.parquet(f"{path}/shape/{side}")  # edges without rows leave no file to tell the columns
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/buckets")


def read(spark: SparkSession, path: str) -> Adjacency:
    """The edges of write().  The session's catalog learns of the folders here, where it doesn't know them: the files' names tell their buckets."""
    sides = []
    for side, column in _SIDES.items():
        name = _table(path, side)
        if not spark.catalog.tableExists(name):
            shape = spark.read.parquet(f"{path}/shape/{side}").schema
            buckets = spark.read.parquet(f"{path}/buckets").first().buckets
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{path}/{side}'")
        sides.append(spark.table(name).select(F.col("source"), F.col("target")))
    return Adjacency(*sides)


def forget(spark: SparkSession, path: str) -> None:
    """Take the edges of a path out of the session's catalog; their files stay."""
    for side in _SIDES:
        spark.sql(f"DROP TABLE IF EXISTS {_table(path, side)}")
