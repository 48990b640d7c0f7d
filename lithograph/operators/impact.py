"""Field impact: who reads, writes and passes on a field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def impact(relationships: DataFrame, field=None) -> DataFrame:
    """(field_fqn, method_fqn, role, n) of relationships (from_entity_fqn, to_entity_fqn, kind): n counts occurrences.

    Readers and writers are methods with READS_FIELD and WRITES_FIELD; propagators are the readers that call
    something, with their readings.  All fields at once, or one.
    """
    touch = relationships.where(F.col("kind").isin("READS_FIELD", "WRITES_FIELD"))
    if field is not None:
        touch = touch.where(F.col("to_entity_fqn") == field)
    touch = touch.groupBy(F.col("to_entity_fqn").alias("field_fqn"), F.col("from_entity_fqn").alias("method_fqn"), "kind").agg(F.count("*").alias("n"))
    calling = relationships.where("kind = 'CALLS'").select(F.col("from_entity_fqn").alias("method_fqn")).distinct()
    readers = touch.where("kind = 'READS_FIELD'").drop("kind")
    writers = touch.where("kind = 'WRITES_FIELD'").drop("kind")
    return (
        readers.withColumn("role", F.lit("reader"))
        .unionByName(writers.withColumn("role", F.lit("writer")))
        .unionByName(readers.join(calling, "method_fqn", "left_semi").withColumn("role", F.lit("propagator")))
        .select("field_fqn", "method_fqn", "role", "n")
    )


def impact_nodes(found: DataFrame) -> DataFrame:
    """(field_fqn, id, role): the field and each method once; reader comes before writer, and so before propagator.

    A propagator is a reader, so that role never shows here.
    """
    order = F.when(F.col("role") == "reader", 1).when(F.col("role") == "writer", 2).otherwise(3)
    methods = found.groupBy("field_fqn", F.col("method_fqn").alias("id")).agg(F.min_by("role", order).alias("role"))
    fields = found.select("field_fqn", F.col("field_fqn").alias("id"), F.lit("field").alias("role")).distinct()
    return methods.unionByName(fields)


def impact_edges(found: DataFrame) -> DataFrame:
    """(field_fqn, source, target, kind, n): readings go field to method no more than the model says; n stands for so many edges.

    A propagator has a second edge, of kind CALLS, beside that of its reading.
    """
    kind = F.when(F.col("role") == "reader", "READS_FIELD").when(F.col("role") == "writer", "WRITES_FIELD").otherwise("CALLS")
    return found.select("field_fqn", F.col("method_fqn").alias("source"), F.col("field_fqn").alias("target"), kind.alias("kind"), "n")
