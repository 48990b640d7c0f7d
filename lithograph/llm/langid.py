"""Operator 4, language identification by compression.

Each language has a raw-content dictionary of sample text.  A text is compressed in short blocks, each from several
places on, with every dictionary, whatever its length; the language whose blocks take the fewest bytes wins, and the margin to the next says how sure that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm.common import small_batches, table

#: From how many places of a block its size is taken.
VIEWS = 4
_LETTER = regex.compile(r"\p{L}")


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 512, dictionary_bytes: int = 110 << 10, most_languages: int = 256
) -> dict[str, bytes]:
    """A dictionary of at most dictionary_bytes for each language of the labelled rows (null texts and languages are left out).

    It is a bounded sample: at most docs_per_language rows a language, the first by a hash of key and text in each of so
    many hash ranges, and from each an equal share of the dictionary's bytes, from a place that the hash draws over the whole text.
    Every language of the rows gets one; more than most_languages raise ValueError, so that what reaches the driver stays bounded.
    """
    rows = labelled.select(labelled[lang].alias("l"), labelled[text].alias("t"), F.xxhash64(labelled[key], labelled[text]).alias("h")).where("t <> '' and l is not null")
    languages = rows.select("l").distinct().limit(most_languages + 1).count()
    if languages > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    chosen = rows.groupBy("l", F.pmod("h", F.lit(docs_per_language)).alias("range")).agg(F.min_by("t", "h").alias("t"), F.min("h").alias("h"))
    size, share = F.length("t"), F.ceil(dictionary_bytes / F.count("*").over(Window.partitionBy("l"))).cast("int")
    place = F.pmod(F.xxhash64("h"), F.greatest(size - share, F.lit(0)) + 1).cast("int") + 1
    found = chosen.withColumn("share", share).select("l", "h", "share", F.substring("t", place, share).alias("t")).collect()
    out = {}
    for name in sorted({r.l for r in found}):
        parts = sorted((r.h, r.t, r.share) for r in found if r.l == name)
        out[name] = b"\n".join(t.lower().encode()[:share] for _, t, share in parts)[:dictionary_bytes]
    return out


class Sizer:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], block: int):
        self.languages = sorted(dictionaries)
        self.block = block
        self.packers = []
        for name in self.languages:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # matches of three bytes and on, found lazily: the optimal parsers price a raw dictionary's matches too high
            params = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=17, chain_log=17, search_log=3, min_match=3, target_length=32, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            raw.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=params))

    def sizes(self, text: str) -> list[int]:
        """Bytes over all blocks of the whole text; a block counts from its start and from `VIEWS` - 1 words further on, as the few bytes of one view alone tie."""
        raw = text.lower().encode()
        parts = []
        for i in range(0, len(raw), self.block):
            words = raw[i : i + self.block].split()
            starts = sorted({len(words) * j // VIEWS for j in range(VIEWS)}) if words else []
            parts += [b" ".join(words[j:]) for j in starts]
        return [sum(len(p.compress(x)) for x in parts) for p in self.packers]

    def best(self, text: str) -> tuple[str, float]:
        """(language, margin): the margin is the part by which the next language's size is larger, 0 to 1; ties go to the first name."""
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.languages[0], 1.0
        order = np.argsort(sizes, kind="stable")
        a, b = sizes[order[0]], sizes[order[1]]
        return self.languages[order[0]], (b - a) / b


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id", block: int = 1024, narrow: float = 0.01) -> DataFrame:
    """(key, lang_pred, score, rejected) of every whole text.

    score is the margin, stretched so that `narrow` is 0.5; rejected marks margins under `narrow` and texts that
    are null or have no letter, which get lang_pred `und` and score 0.  Repeated rows give a row each; other columns
    are not looked at.  Without any dictionary every text is `und`.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries, block) if dictionaries else None
        for batch in small_batches(batches, "t"):
            names, scores, out = [], [], []
            for t in batch.column("t").to_pylist():
                if sizer is None or not t or not _LETTER.search(t):
                    name, margin = "und", 0.0
                else:
                    name, margin = sizer.best(t)
                names.append(name)
                scores.append(margin / (margin + narrow))
                out.append(name == "und" or margin < narrow)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=["k", "lang_pred", "score", "rejected"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("k", key)


def recognised(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", block: int = 1024, narrow: float = 0.01) -> DataFrame:
    """The rows of docs, all columns, whose text classify() doesn't reject; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries, block) if dictionaries else None
        for batch in small_batches(batches, text):
            texts = batch.column(text).to_pylist()
            yield batch.filter(pa.array([bool(sizer and t and _LETTER.search(t) and sizer.best(t)[1] >= narrow) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the key as text, modulo 3, is 1; a null key is not in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
