"""Operator 9, best-two-fit packing of documents into sequences of a fixed number of tokens.

Every document becomes ids plus an end id and, where longer than a sequence, pieces.  Full pieces are
sequences of their own.  The others are dealt into blocks of about the same number of pieces; a block is
packed by itself: bins are filled greedily, largest piece that fits first, then a bin's smallest piece gives
way to two unpacked pieces that fill its place and gap more tightly.  Only lengths travel, not ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import cut, small_batches, table

SPECIAL = "<|endoftext|>"


@lru_cache(2)
def _encoder(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={SPECIAL: len(merges)})


def token_ids(text: str | None, ranks: str) -> np.ndarray:
    """The byte-level BPE ids of a whole text; the end-of-text string is one id, as its tokenizer file says."""
    if not text:
        return np.zeros(0, np.uint32)
    coder = _encoder(ranks)
    return np.asarray(coder.encode(text, allowed_special="all", disallowed_special=()) if SPECIAL in text else coder.encode_ordinary(text), dtype=np.uint32)


def pieces(docs: DataFrame, ranks: str, room: int, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document: its ids and end_id, cut from the end into pieces of room ids.

    Only the first piece of a document may be shorter.  A null text is empty: its only id is end_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("t").to_pylist()):
                ids = np.append(token_ids(text, ranks), np.uint32(end_id)).astype("<u4")
                n, head = len(ids), len(ids) % room or room
                at = [0, *range(head, n, room), n]
                for p, (a, b) in enumerate(zip(at, at[1:])):
                    row.append(i)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            keys = batch.column("k").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.  Deterministic; equal lengths are taken in their order.

    A bin takes the largest unpacked piece that fits, again and again.  Where a gap is left, its smallest piece is
    put back for two unpacked ones, if two fill the gap that this opens better.  Counts by length stand for the
    unpacked pieces, so a block costs its bins times the lengths, not its pieces squared.
    """
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(room + 2))
    left = np.diff(first)  # unpacked pieces of each length
    taken = first[:-1].copy()
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fits = np.zeros(room + 1, np.int64)  # the largest unpacked length up to each length

    def refresh(n: int) -> None:
        if not left[n]:  # the last of its length: what pointed to it points below
            below = fits[n - 1] if n else 0
            stop = n
            while stop <= room and fits[stop] == n:
                stop += 1
            fits[n:stop] = below

    present = np.flatnonzero(left)
    fits[:] = present[np.searchsorted(present, np.arange(room + 1), side="right") - 1] if len(present) else 0
    fits[: present[0] if len(present) else 0] = 0
    total, b = len(lengths), 0
    while total:
        gap, chosen = room, []
        while gap and (n := int(fits[gap])):
            chosen.append(n)
            left[n] -= 1
            gap -= n
            refresh(n)
        if gap:
            small = chosen[-1]
            hole = gap + small
            # two lengths a >= c, each unpacked, that fill more of the hole than the smallest piece does
            best, pair = small, None
            a = int(fits[hole])
            while a and 2 * a > best:
                c = int(fits[min(hole - a, a)])
                if c == a and left[a] < 2:
                    c = int(fits[a - 1]) if a > 1 else 0
                if c and a + c > best:
                    best, pair = a + c, (a, c)
                    if best == hole:
                        break
                a = int(fits[a - 1]) if a > 1 else 0
            if pair:
                chosen.pop()
                for n in pair:
                    left[n] -= 1
                    chosen.append(n)
                    refresh(n)
                if not left[small]:
                    top = small
                    while top <= room and fits[top] < small:
                        top += 1
                    fits[small:top] = small
                left[small] += 1
        at = 0
        for n in chosen:
            i = order[taken[n]]
            taken[n] += 1
            bins[i], offsets[i] = b, at
            at += n
        total -= len(chosen)
        b += 1
    return bins, offsets


def pack(docs: DataFrame, ranks: str, room: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id", block: int = 100_000) -> DataFrame:
    """Pack whole documents into sequences of at most room ids; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.  Pieces of one block share
    sequences; a block has about `block` pieces whatever the input's size, so each block leaves one sequence or so
    partly filled.  Null and empty texts give one piece of end_id alone; a null key stays null; repeated rows are
    packed as documents of their own; an empty table gives no rows; other columns are not looked at.
    """
    made = cut(pieces(docs.select(docs[key].alias("k"), docs[text].alias("t")), ranks, room, end_id))
    whole = made.where(F.col("length") == room)
    parts = made.where(F.col("length") < room)
    groups = max(1, round(parts.count() / block))
    # dealt by a hash of the row, so that each block has the corpus's mix of lengths
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), room)
        return pdf.assign(b=bins, offset=offsets)

    packed = dealt.groupBy("g").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, g long, b long, offset long")
    # sequence numbers: a block's number and the bin's; full pieces take negative ones
    shared = packed.withColumn("sequence_id", F.col("b") * groups + F.col("g")).drop("g", "b")
    alone = whole.withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", -1 - F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return alone.select(columns).union(shared.select(columns))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
