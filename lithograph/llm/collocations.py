"""Operator 13, phrases by vertical positional lists: each word and phrase has the list of the places where it occurs.

Texts are dealt into chunks, and each chunk's words are numbered once and kept as numbers.  In a chunk each word has a list of positions; pieces are kept apart by a gap in the numbering.  A phrase
becomes longer by one word by merging its list with the words' own: where a word stands at the position behind an occurrence, the
two join, and the occurrences that go on with one word are the longer phrase's list.  The length of the list is its exact
frequency in the chunk.  Chunks send lengths to buckets by phrase, where they are added; what occurs often enough gets a
number there that no other phrase of its length has, and the chunks that sent it are told.  Only such phrases are extended, and only where
the words behind their first are such a phrase, too.  Words are told apart by their bytes and phrases by numbers, never by
hashes.  The cuts, scores and the choice among nested phrases are joins of the frequent phrases.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.llm import words as W
from lithograph.llm.common import cut, table

_PACKET = "bucket long, chunk long, data binary"
_REPLY = "chunk long, level int, data binary"
_FREQUENT = "level int, id long, before long, word long, f long, lang string, text string"
#: Packets: a word or phrase of a chunk with its place in the chunk's list and its frequency there.
_WORD = np.dtype([("at", "<u4"), ("n", "<u4"), ("size", "<u4")])
_PHRASE = np.dtype([("before", "<i8"), ("word", "<i8"), ("at", "<u4"), ("n", "<u4")])
#: A chunk's words: each one's distance in position from the one before it (1, or 2 over a gap), and its place in the chunk's list of words.
_CODED = np.dtype([("step", "<u1"), ("place", "<u4")])
#: Replies: the number that a frequent one got.
_KNOWN = np.dtype([("at", "<u4"), ("id", "<i8")])
#: The bucket of a chunk's own words.
_WHOLE = -1
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _BREAK.copy()
_APART[[0x20, 9]] = True


def squeezed(entries: np.ndarray, rest: bytes = b"") -> bytes:
    """Entries, like bytes of all of them side by side, and any bytes behind, compressed."""
    rows = np.ascontiguousarray(entries).view(np.uint8).reshape(len(entries), entries.dtype.itemsize)
    return np.array([len(entries)], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(rows.T.tobytes() + rest)


def loosened(data: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    size = n * kind.itemsize
    return np.frombuffer(raw, np.uint8, size).reshape(kind.itemsize, n).T.copy(order="C").reshape(-1).view(kind), raw[size:]


def _key(lang: str) -> bytes:
    raw = lang.encode()
    return struct.pack("<I", len(raw)) + raw


def _read(key: bytes) -> tuple[str, str]:
    """(language, word) of a key: the length of the language's name, the name, the word."""
    n = 4 + struct.unpack_from("<I", key)[0]
    return key[4:n].decode(), key[n:].decode()


def _steps(values: np.ndarray) -> np.ndarray:
    """What each value adds to the one before it: values that rise become small."""
    return np.diff(values, prepend=values.dtype.type(0))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


class Vocabulary:
    """A chunk's words: keys (language and word), how often each occurs, and every word's position and place among the keys."""

    def __init__(self, rows: pa.Table):
        text = rows.column("t").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        raw, offset = W.raw_bytes(text)
        inside = ~_APART[raw]
        start, end = W.bounds(inside, offset)
        row = np.searchsorted(offset, start, side="right") - 1
        broken = np.cumsum(_BREAK[raw])[start] if len(raw) else np.zeros(0, np.int64)
        fresh = np.zeros(len(start), np.int64)
        fresh[1:] = (row[1:] != row[:-1]) | (broken[1:] != broken[:-1])
        position = np.arange(len(start)) + np.cumsum(fresh)
        code, texts = W.word_codes(W.LOWER[raw[inside]], start, end)
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
        prefix = [_key(x) for x in lang.dictionary.to_pylist()]
        both, code = np.unique(np.asarray(lang.indices, dtype=np.int64)[row] * max(1, len(texts)) + code, return_inverse=True)
        keys = [prefix[b // len(texts)] + texts[b % len(texts)] for b in both.tolist()]
        # sorted by their bytes, so that a word's place does not depend on the order of rows
        order = sorted(range(len(keys)), key=keys.__getitem__)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys = [keys[i] for i in order]
        self.position, self.place = position, place[code] if len(code) else code
        self.counts = np.bincount(self.place, minlength=len(keys)).astype(np.int64)

    def coded(self) -> bytes:
        out = np.empty(len(self.place), _CODED)
        out["step"], out["place"] = _steps(self.position), self.place
        return squeezed(out)


class Lists:
    """A chunk's positional lists: of all its words, then of longer and longer phrases."""

    def __init__(self, coded: bytes):
        words, _ = loosened(coded, _CODED)
        place = words["place"].astype(np.int64)
        self.here = np.cumsum(words["step"], dtype=np.int64), place
        self.counts = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
        self.level = 1

    def name(self, known: np.ndarray) -> None:
        """Keep the frequent ones of the current lists, under the numbers they got."""
        at, place = self.here
        ids = np.zeros(len(self.counts), np.int64)
        ids[known["at"]] = known["id"]
        named = ids[place]
        kept = named > 0
        self.here = at[kept], named[kept]
        if self.level == 1:
            self.postings = self.here

    def extend(self) -> np.ndarray:
        """Make the lists of phrases one word longer and return (before, word) of each, sorted; counts has their lengths."""
        at, ids = self.here
        where, word = self.postings
        # both are sorted by position: a merge of each occurrence with the posting behind it
        behind = np.searchsorted(where, at + self.level)
        joined = behind < len(where)
        joined[joined] = where[behind[joined]] == at[joined] + self.level
        if self.level > 1:
            after = np.searchsorted(at, at + 1)
            goes_on = after < len(at)
            goes_on[goes_on] = at[after[goes_on]] == at[goes_on] + 1
            joined &= goes_on
        first, a = np.unique(ids[joined], return_inverse=True)
        second, b = np.unique(word[behind[joined]], return_inverse=True)
        pairs, place, self.counts = np.unique(a * max(1, len(second)) + b, return_inverse=True, return_counts=True)
        self.here = at[joined], place
        self.level += 1
        width = max(1, len(second))
        return np.stack([first[pairs // width], second[pairs % width]], axis=1) if len(pairs) else np.zeros((0, 2), np.int64)


def _dealt(bucket: np.ndarray, chunk: int, pack) -> pa.Table:
    """Rows of _PACKET: pack(places) for the places of each bucket."""
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return pa.table([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([pack(p) for p in parts], pa.binary())], names=["bucket", "chunk", "data"])


def _word_packets(chunk: int, lists: Vocabulary, buckets: int) -> pa.Table:
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(k) % buckets for k in lists.keys), np.int64, len(lists.keys))

    def pack(places: np.ndarray) -> bytes:
        out = np.empty(len(places), _WORD)
        keys = [lists.keys[i] for i in places.tolist()]
        out["at"], out["n"], out["size"] = _steps(places), lists.counts[places], [len(k) for k in keys]
        return squeezed(out, b"".join(keys))

    return _dealt(bucket, chunk, pack)


def _phrase_packets(chunk: int, pairs: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    mixed = W.mix(W.mix(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64))

    def pack(places: np.ndarray) -> bytes:
        out = np.empty(len(places), _PHRASE)
        out["before"], out["word"], out["at"], out["n"] = _steps(pairs[places, 0]), pairs[places, 1], _steps(places), counts[places]
        return squeezed(out)

    return _dealt((mixed % np.uint64(buckets)).astype(np.int64), chunk, pack)


def _replies(chunk: np.ndarray, at: np.ndarray, ids: np.ndarray, level: int) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else []
    data = []
    for p in parts:
        out = np.empty(len(p), _KNOWN)
        out["at"], out["id"] = _steps(at[p]), _steps(ids[p])
        data.append(squeezed(out))
    return pa.table([pa.array([int(chunk[p[0]]) for p in parts], pa.int64()), pa.array([level] * len(parts), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "level", "data"])


def _summed(entries: np.ndarray, *columns: str) -> np.ndarray:
    """Entries whose columns came as steps, with their values."""
    for c in columns:
        if c in entries.dtype.names:
            entries[c] = _sums(entries[c])
    return entries


def _added(packets: pa.Table, kind: np.dtype):
    """(chunk of each entry, entries, the bytes behind each packet's)."""
    got = [(_summed(e, "at", "before"), rest) for e, rest in (loosened(d, kind) for d in packets.column("data").to_pylist())]
    chunk = np.repeat(np.asarray(packets.column("chunk"), dtype=np.int64), [len(e) for e, _ in got])
    return chunk, np.concatenate([e for e, _ in got]) if got else np.zeros(0, kind), [b for _, b in got]


def _numbered(frequent: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """A number above 0 for each frequent one, not given by any other bucket; 0 for the rest."""
    return np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket + 1, 0)


class _Words:
    """A bucket's words, added over all chunks."""

    def __init__(self, packets: pa.Table, least: int, bucket: int, buckets: int):
        self.chunk, self.entries, rest = _added(packets, _WORD)
        at = np.zeros(len(self.entries) + 1, np.int64)
        np.cumsum(self.entries["size"], out=at[1:])
        column = pa.Array.from_buffers(pa.large_binary(), len(self.entries), [None, pa.py_buffer(at), pa.py_buffer(b"".join(rest))])
        coded = column.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys = [keys[i] for i in order]
        self.back = place[np.asarray(coded.indices)] if len(keys) else np.zeros(0, np.int64)
        self.total = np.zeros(len(keys), np.int64)
        np.add.at(self.total, self.back, self.entries["n"].astype(np.int64))
        self.ids = _numbered(self.total >= least, bucket, buckets)


class _Phrases:
    """A bucket's phrases, added over all chunks."""

    def __init__(self, packets: pa.Table, least: int, bucket: int, buckets: int):
        self.chunk, self.entries, _ = _added(packets, _PHRASE)
        first, a = np.unique(self.entries["before"], return_inverse=True)
        second, b = np.unique(self.entries["word"], return_inverse=True)
        width = max(1, len(second))
        pairs, self.back = np.unique(a * width + b, return_inverse=True)
        self.before, self.word = first[pairs // width] if len(pairs) else first, second[pairs % width] if len(pairs) else second
        self.total = np.zeros(len(pairs), np.int64)
        np.add.at(self.total, self.back, self.entries["n"].astype(np.int64))
        self.ids = _numbered(self.total >= least, bucket, buckets)


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", lang: str = "lang", key: str = "doc_id", chunk_bytes: int = 4 << 20) -> DataFrame:
    """(lang, words, f) of every phrase of 1 to `longest` words that occurs at least `least` times in the texts of its language; words is an array.

    A row with null words has the number of all word occurrences of its language.  Texts are lower-cased (A-Z) and split at
    `.,;:!?` and U+000A to U+000D into pieces, and those at spaces and tabs into words; phrases don't cross pieces.  A null text is empty, a null
    language is `und`; rows that share a key count each.  An empty table gives no rows, and other columns are not looked at.
    """
    bare = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("t"), docs[key].alias("k")).where("t is not null")
    size = bare.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(1, -(-size // chunk_bytes))
    # by key and text, so that neither a frequent key nor a frequent text is dealt to one place
    dealt = bare.select("lang", "t", F.pmod(F.xxhash64("k", "t", "lang"), F.lit(buckets)).alias("chunk"))

    def words(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        chunk, v = name[0].as_py(), Vocabulary(rows)
        whole = pa.table([pa.array([_WHOLE], pa.int64()), pa.array([chunk], pa.int64()), pa.array([v.coded()], pa.binary())], names=["bucket", "chunk", "data"])
        return pa.concat_tables([whole, _word_packets(chunk, v, buckets)])

    def longer(level: int):
        def run(name: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
            pairs, counts = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            if rows.num_rows and replies.num_rows:
                known: dict[int, list] = {}
                for of, data in zip(replies.column("level").to_pylist(), replies.column("data").to_pylist()):
                    known.setdefault(of, []).append(_summed(loosened(data, _KNOWN)[0], "at", "id"))
                lists = Lists(rows.column("data")[0].as_py())
                for of in range(1, level):
                    lists.name(np.concatenate(known.get(of, [np.zeros(0, _KNOWN)])))
                    pairs = lists.extend()
                counts = lists.counts
            return _phrase_packets(name[0].as_py(), pairs, counts, buckets)

        return run

    def told(level: int):
        def run(name: tuple[pa.Scalar, ...], packets: pa.Table) -> pa.Table:
            b = (_Words if level == 1 else _Phrases)(packets, least, name[0].as_py(), buckets)
            ids = b.ids[b.back]
            return _replies(b.chunk[ids > 0], b.entries["at"][ids > 0], ids[ids > 0], level)

        return run

    names = ["level", "id", "before", "word", "f", "lang", "text"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def listed(level: int):
        def run(name: tuple[pa.Scalar, ...], packets: pa.Table) -> pa.Table:
            b = (_Words if level == 1 else _Phrases)(packets, least, name[0].as_py(), buckets)
            some = np.flatnonzero(b.ids > 0)
            none = [None] * len(some)
            if level > 1:
                cols = [[level] * len(some), b.ids[some], b.before[some], b.word[some], b.total[some], none, none]
            else:
                read = [_read(k) for k in b.keys]
                per: dict[str, int] = {}
                for (of, _), n in zip(read, b.total.tolist()):
                    per[of] = per.get(of, 0) + n
                sums = [None] * len(per)
                cols = [[1] * len(some) + [0] * len(per), [*b.ids[some].tolist(), *sums], none + sums, none + sums, [*b.total[some].tolist(), *per.values()], [read[i][0] for i in some] + list(per), [read[i][1] for i in some] + sums]
            return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        return run

    first = cut(dealt.groupBy("chunk").applyInArrow(words, _PACKET))
    coded, packets = first.where(F.col("bucket") == _WHOLE).select("chunk", "data"), first.where(F.col("bucket") != _WHOLE)
    found = packets.groupBy("bucket").applyInArrow(listed(1), _FREQUENT)
    known = packets.groupBy("bucket").applyInArrow(told(1), _REPLY)
    for level in range(2, longest + 1):
        packets = coded.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(longer(level), _PACKET)
        found = found.union(packets.groupBy("bucket").applyInArrow(listed(level), _FREQUENT))
        if level < longest:
            known = known.union(packets.groupBy("bucket").applyInArrow(told(level), _REPLY))
    found = cut(found)
    single = found.where("level = 1").select("id", "lang", F.array("text").alias("words"), "f")
    one = single.select(F.col("id").alias("word"), F.col("words").alias("last"))
    total = found.where("level = 0").groupBy("lang").agg(F.sum("f").alias("f"))
    out, before = single.drop("id").union(total.select("lang", F.lit(None).cast("array<string>"), "f")), single
    for level in range(2, longest + 1):
        mine = found.where(F.col("level") == level).select("id", "before", "word", "f")
        shorter = before.select(F.col("id").alias("before"), "lang", "words")
        before = mine.join(shorter, "before").join(one, "word").select("id", "lang", F.concat("words", "last").alias("words"), "f")
        out = out.union(before.drop("id"))
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, nested_percent: int = 80, top: int = 2000, **how) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words by score: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the frequencies of the phrase and of its parts at the cut that scores lowest (the first of such), with score
    floor(2000000 * a / (l + r)); n counts all words of the language.  Phrases that lie in a longer one with nested_percent of their
    frequency or more are left out.  Ties go by a, then by the phrase's bytes.  Nulls and empty tables as in frequent_phrases.
    """
    counted = cut(frequent_phrases(docs, least, longest, **how))
    total = counted.where("words is null").select("lang", F.col("f").alias("n"))
    phrases = counted.where("words is not null").select("lang", "words", F.array_join("words", " ").alias("phrase"), "f")
    several = phrases.where("size(words) > 1")
    part = phrases.where(F.size("words") < longest)
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(19, 0)) * 2000000) div cast(l + r as decimal(19, 0))")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))
    # all parts of two words and more of the longer phrases, each with the highest frequency of one that holds it
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    holders = several.where(size > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    wide = "decimal(19, 0)"
    nested = F.col("held").cast(wide) * 100 >= F.col("a").cast(wide) * nested_percent
    left = lowest.join(holders, ["lang", "phrase"], "left").where(F.col("held").isNull() | ~nested)
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same in SQL, with a row for each phrase of each place: for small tables.
SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece
), g AS (SELECT lang, k, unnest([ws[i:i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS ws FROM w, range(1, 5) AS t(k)
), f AS (SELECT lang, ws, count(*) AS f FROM g GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ws) = 1 GROUP BY lang
), c AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1 AND f >= 30
), cut AS (SELECT c.lang, c.ws, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM c, range(1, 4) AS t(k), f x, f y
  WHERE k < len(c.ws) AND x.lang = c.lang AND y.lang = c.lang AND x.ws = c.ws[1:k] AND y.ws = c.ws[k + 1:]
), low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
), part AS (SELECT lang, unnest(flatten([[ws[i:i + m - 1] FOR i IN range(1, len(ws) - m + 2)] FOR m IN range(2, len(ws))])) AS ws, a FROM c WHERE len(ws) > 2
), held AS (SELECT lang, ws, max(a) AS held FROM part GROUP BY ALL
), kept AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN held USING (lang, ws) WHERE held IS NULL OR 100::HUGEINT * held < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": SQL}
