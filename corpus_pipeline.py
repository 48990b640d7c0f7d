"""A corpus pipeline of five operators: language identification, near-duplicate removal, substring dedup, secret
masking and packing.  Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents."""

from __future__ import annotations

import uuid

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm import jaccard, langid, packing, secrets_scan, substrings
from lithograph.llm.common import small_batches, table
from lithograph.operators.state import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of rows that are sent to Python at once; Spark's own limits, 64 MB and 10,000 rows, leave the executors' native memory in pieces.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _modest(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for the session, unless it has a limit of its own: a stage is planned when it is written, after it has returned."""
    spark.conf.set(_BATCH, spark.conf.get(_BATCH, str(BATCH_BYTES)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language shows; those that every dictionary packs about equally well go.  The lang column stays."""
    _modest(spark)
    return langid.recognised(docs.select(COLUMNS), langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group of near copies: five words, a similarity of 0.8 or more.

    Rows that share a doc_id stay or go together, equal ones once.
    """
    _modest(spark)
    groups = jaccard.join(docs, n=5, percent=80)
    kept = groups.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("times"))
    found = docs.select(COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("id")))
    once, more = found.where("times = 1"), found.where("times > 1").dropDuplicates(["doc_id", "text"])
    return once.select(COLUMNS).union(more.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of twenty words and more that stand earlier in the corpus; one left without words goes."""
    _modest(spark)
    found = substrings.repeats(docs, carry=("lang", "source"))
    left = found.where("n_removed = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; every document stays."""
    _modest(spark)

    def run(batches):
        for batch in small_batches(batches, "text"):
            new = pa.array([secrets_scan.masked(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), new, batch.column("lang"), batch.column("source")], names=COLUMNS[:4])

    kinds = dict(docs.dtypes)
    shape = ", ".join(f"{c} {kinds[c]}" for c in COLUMNS[:4])
    return docs.select(COLUMNS[:4]).mapInArrow(run, shape).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents packed into sequences of 2048 tokens: a row for each piece."""
    _modest(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the folder of spark.checkpoint.dir and read again.

    A null doc_id is a key like others, a null text counts as without a letter and goes in the first stage, an empty
    table gives no rows, and columns beyond those of documents are not carried.  Without that folder a cluster raises.
    """
    folder = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir') or shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


#: No SQL: compression, tries and packing have none; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None
