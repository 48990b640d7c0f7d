"""Operator 10, BPE encoding and decoding by a pair occurrence index.

The distinct words of a block of texts are laid out as one row of symbols.  An index maps each pair of
neighbours that has a rank to all its positions; active ranks are applied in ascending order, and a merge
takes the pairs around it out of their lists and puts the new pairs in.  Every distinct word is encoded
once a block, however often it occurs, so a hot word costs no more than a rare one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from lithograph.llm.common import small_batches, table


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a vocabulary file whose words end in a suffix, lower-cased, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        self.names = names
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Unicode versions differ in new scripts; texts with other than these characters are split by the library itself
        self.rare = regex.compile(r"[^\u0000-\u036F\u0391-\u03C9\u0410-\u044F\u2010-\u2027\u20AC\u3041-\u3096\u4E00-\u9FA5\uAC00-\uD7A3]")
        tok = Tokenizer.from_file(path)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.known: dict[str, tuple[bytes, str, int]] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text, special strings as they are."""
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.rare.search(text):
            pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]
        # one letter at a time has no final sigma, so that letter is lowered beforehand
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def learn(self, words: Iterable[str], most_kept: int = 400_000) -> None:
        """Encode the words that aren't known yet; what is known is dropped when it grows past most_kept."""
        words = set(words)
        if len(self.known) > most_kept:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known and w not in self.special]
        for w, ids in zip(new, self._merge(new)):
            self.known[w] = (b"".join(i.to_bytes(4, "little") for i in ids), " ".join(self.names[i] for i in ids), len(ids))
        for w, i in self.special.items():
            self.known[w] = (i.to_bytes(4, "little"), w, 1)

    def _merge(self, words: list[str]) -> list[list[int]]:
        ids, letters, suffix, ranks = self.ids, self.letters, self.suffix, self.ranks
        symbol: list[int] = []  # -1: not part of a word, or merged into the symbol on its left
        ends: list[int] = []
        for w in words:
            raw = [letters[b] for b in w.encode()]
            raw[-1] += suffix
            symbol.extend(ids[c] for c in raw)
            symbol.append(-1)
            ends.append(len(symbol))
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        get = ranks.get
        for i in range(n - 1):
            if (hit := get((symbol[i], symbol[i + 1]))) is not None:
                where.setdefault(hit[0], []).append(i)
                if hit[0] not in made:
                    made[hit[0]] = (symbol[i], symbol[i + 1], hit[1])
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = made[rank]
            for i in sorted(where.pop(rank)):
                if symbol[i] != left or symbol[j := after[i]] != right:
                    continue  # a merge has taken one of the two
                symbol[i], symbol[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                for x in (before[i], i):
                    if x >= 0 and (hit := get((symbol[x], symbol[after[x]]))) is not None:
                        if (r := hit[0]) not in where:
                            where[r] = []
                            made[r] = (symbol[x], symbol[after[x]], hit[1])
                            heapq.heappush(active, r)
                        where[r].append(x)
        out, at = [], 0
        for e in ends:
            out.append([s for s in symbol[at : e - 1] if s >= 0])
            at = e
        return out

    def block(self, texts: list[str]) -> Iterator[tuple[int, bytes, str]]:
        """(number of ids, ids as little-endian 32-bit integers, decoded text) of each text."""
        split = [self.words(t) for t in texts]
        self.learn(w for ws in split for w in ws)
        known = self.known
        for ws in split:
            found = [known[w] for w in ws]
            yield sum(f[2] for f in found), b"".join([f[0] for f in found]), " ".join([f[1] for f in found])


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns key, n_tokens, ids (array<int>) and decoded; with digests, ids_sha256 and decoded_sha256 stand for
    the last two.  A null or empty text has no ids and decodes to the empty text.  Repeated rows and keys give
    one row each; other columns are not looked at; an empty table gives no rows.
    """
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(vocabulary)
        for batch in small_batches(batches, "t", 16 << 20):
            n, ids, decoded = [], [], []
            for count, raw, back in coder.block(batch.column("t").fill_null("").to_pylist()):
                n.append(count)
                ids.append(hashlib.sha256(raw).hexdigest() if digests else memoryview(raw).cast("I").tolist())
                decoded.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
            out = [batch.column("k"), pa.array(n, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["k", "n_tokens", *(x.split()[0] for x in tail.split(", "))])

    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, {tail}")
    return rows.withColumnRenamed("k", key)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


QUERIES = {"op10_bpe": op10_bpe}
ORACLES: dict[str, str] = {}
