"""Upserts, replacements and deletions on snapshots: each gives the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old with the rows of new put in or replaced by key; of equal keys in new the one of the highest order stays.

    One shuffle by key, with the maximum taken before it; new's order column isn't kept.
    """
    columns = [c for c in old.columns if c != key]
    state = old.select(key, F.struct(F.lit(0).alias("late"), F.lit(None).cast(new.schema[order].dataType).alias("at"), *columns).alias("row"))
    change = new.select(key, F.struct(F.lit(1).alias("late"), F.col(order).alias("at"), *columns).alias("row"))
    # rows compare by late, then by place, then by their columns, so that equal places give one result
    latest = state.unionByName(change).groupBy(key).agg(F.max("row").alias("row"))
    return latest.select(*(key if c == key else F.col(f"row.{c}").alias(c) for c in old.columns))


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last by order."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    latest = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("row"))
    return latest.select(*(c if c in key else F.col(f"row.{c}").alias(c) for c in rows.columns))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """new in old's place; an empty new leaves old as it is."""
    return old if new.isEmpty() else new.select(old.columns)


def deleted(rows: DataFrame, key: str, value) -> tuple[DataFrame, bool]:
    """(the rows without the key, whether it was there)."""
    return rows.where(~F.col(key).eqNullSafe(F.lit(value))), not rows.where(F.col(key) == value).isEmpty()


def written_note(notes: DataFrame, note_id: str, entity: str, content: str, now_ms: int) -> DataFrame:
    """notes with a note put in or replaced; both its times become now, also where it was there before."""
    new = notes.sparkSession.createDataFrame([(note_id, entity, content, now_ms, now_ms)], notes.schema).withColumn("at", F.lit(now_ms))
    return upsert(notes, new, "id", "at")
