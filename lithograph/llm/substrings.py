"""Operator 6, substring dedup by prefix-partitioned suffix trees.

A suffix begins at every word.  Each window of `window` words is filed under a prefix: the run of a few words with the least
hash in it, so that equal windows, and mostly neighbouring ones too, are filed together.  Prefixes that the corpus holds once go
no further.  The suffixes of a prefix are one group where they fit `group_suffixes`; a group that is larger is split by
longer prefixes, the window's own first words, by as many as are needed to make the parts fit, up to the whole window.
Groups reach a task as runs of words, each shared by the suffixes that begin in it.  There a suffix array with the lengths of
common beginnings stands for the group's suffix tree: an inner node as deep as a window or deeper is a stretch of the
array whose neighbours have as many words in common.  Its earliest suffix stays, the others are
repeats; runs of them along a text are its maximal repeats.  All comparisons in the trees are of words' own hashes (64 bits).

Texts are dealt into chunks by a hash of their key and text.  A chunk compares its own windows first and sends only the
earliest of equal ones, so a passage that a third of all texts share is sent once a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm import words as W
from lithograph.llm.common import giving_back, table

_U = np.uint64
_PACKET = "bucket long, chunk long, data binary"
_REPLY = "chunk long, level int, data binary"
#: A prefix of a chunk, with how many different windows the chunk files under it.
_COUNT = np.dtype([("hash", "<u8"), ("n", "<u4")])
#: A longer prefix of a chunk: the prefix it belongs to, how many windows the chunk files under it, and which length it has.
_LONGER = np.dtype([("prefix", "<u8"), ("hash", "<u8"), ("n", "<u4"), ("step", "<u4")])
#: A run of words: its group, the chunk's number of its first window, how many windows and words it has, and its text's key and hash.
_RUN = np.dtype([("group", "<u8"), ("at", "<u4"), ("windows", "<u2"), ("words", "<u2"), ("key", "<i8"), ("text", "<i8")])

#: What a reply says: a prefix that other chunks hold too, one with too many windows, a repeat; else a prefix and its longer length.
SHARED, HEAVY, REPEAT = 0, -1, -2


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each `width` neighbours, in steps that double."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = op(out[: len(out) - step], out[step:])
        span += step
    return out


def prefix_length(window: int) -> int:
    return max(1, 2 * window // 5)


def lengths(window: int) -> list[int]:
    """The lengths of the longer prefixes, in words: from the least to the whole window."""
    return sorted({max(1, window * i // 4) for i in range(1, 5)})


def suffix_array(words: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the suffixes that begin at each word and end at stop, by doubling.

    order sorts them by their first words, as far as a power of two that is at least depth; common has for each but the first how many first words
    it shares with the one before it, exact below that power.
    """
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    ranks, span = [rank.astype(np.int32) + 1], 1
    at = np.arange(n)
    while span < depth:
        after = np.zeros(n, np.int64)
        inside = at + span < stop
        after[inside] = ranks[-1][at[inside] + span]
        _, rank = np.unique(ranks[-1].astype(np.int64) * (n + 2) + after, return_inverse=True)
        ranks.append(rank.astype(np.int32) + 1)
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    common = np.zeros(max(0, n - 1), np.int64)
    # the largest powers first: where both have as many words left and they are equal, go on behind them
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        a, b = order[:-1] + common, order[1:] + common
        some = np.flatnonzero((a + step <= stop[order[:-1]]) & (b + step <= stop[order[1:]]))
        same = some[ranks[level][a[some]] == ranks[level][b[some]]]
        common[same] += step
    return order, common


def deep_nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, in their own order, the number of the inner node of that depth or more above it; a suffix below none has a number of its own."""
    node = np.empty(len(order), np.int64)
    node[order] = np.concatenate([[0], np.cumsum(common < depth)]) if len(order) else order
    return node


class Chunk:
    """A chunk's texts in the order of their keys and their texts' hashes h, with its windows and their prefixes."""

    def __init__(self, rows: pa.Table, window: int):
        rows = rows.take(pc.sort_indices(rows, [("k", "ascending"), ("h", "ascending")], null_placement="at_start"))
        self.rows = rows
        key = rows.column("k").combine_chunks()
        self.null_key = np.asarray(key.is_null())
        self.key = np.asarray(key.fill_null(0), dtype=np.int64)
        # a null key counts as before every other
        self.rank = np.where(self.null_key, np.iinfo(np.int64).min, self.key)
        self.hash = np.asarray(rows.column("h").combine_chunks(), dtype=np.int64)
        self.text = rows.column("t").combine_chunks()
        self.text = self.text.chunk(0) if isinstance(self.text, pa.ChunkedArray) else self.text
        self.words = w = W.split(self.text)
        self.window = window
        p = prefix_length(window)
        self.at, self.whole = W.runs(w, window)
        self.prefix = np.zeros(0, np.uint64)
        if len(self.at):
            start = np.arange(len(w.hash) - p + 1)
            short = W.mix(W.run_sums(w.hash, start, start + p, W.WIDE))
            least = _sliding(short, window - p + 1, np.minimum)
            self.prefix = least[self.at]
        self.own, self.counts = np.unique(self.prefix, return_counts=True)

    def same(self, some: np.ndarray) -> np.ndarray:
        """For each of some windows the place in some of the earliest that has the same words."""
        _, first, back = np.unique(self.whole[some], return_index=True, return_inverse=True)
        to = first[back]
        mine, other, h = self.at[some], self.at[some[to]], self.words.hash
        differ = np.zeros(len(some), bool)
        for i in range(self.window):
            differ |= h[mine + i] != h[other + i]
        return np.where(differ, np.arange(len(some)), to)  # one hash for different words: each speaks for itself

    def group(self, some: np.ndarray, heavy: dict[int, np.ndarray]) -> np.ndarray:
        """The group of each of some windows: its prefix, or a longer one where heavy says so (length to prefixes)."""
        out = self.prefix[some].copy()
        for length, which in heavy.items():
            long = np.flatnonzero(_in(self.prefix[some], which))
            out[long] = self.longer(some[long], length)
        return out

    def longer(self, some: np.ndarray, length: int) -> np.ndarray:
        """A hash of each window's prefix and of its own first `length` words."""
        a = self.at[some]
        return W.mix(self.prefix[some] + W.mix(W.run_sums(self.words.hash, a, a + length, W.NARROW) + _U(length)))

    def found(self, replies: dict[int, list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        """(windows whose prefix has others, the place of the earliest equal one of them, those of them to send, what is heavy).

        The earliest of equal windows are sent, if other chunks hold their prefix too.
        """
        elsewhere = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r, "<u8") for r in replies.get(SHARED, []))]))
        some = np.flatnonzero(_in(self.prefix, np.union1d(self.own[self.counts > 1], elsewhere)))
        heavy = {length: np.unique(np.concatenate([np.frombuffer(r, "<u8") for r in replies[length]])) for length in lengths(self.window) if length in replies}
        to = self.same(some)
        sent = some[to == np.arange(len(some))]
        return some, to, sent[_in(self.prefix[sent], elsewhere)], heavy


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _dealt(values: np.ndarray, chunk: int, buckets: int, payload: np.ndarray) -> pa.Table:
    """Rows of _PACKET: the payload's entries by bucket of their values."""
    bucket = ((values >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(payload[order], cuts) if len(order) else []
    heads = bucket[order][np.concatenate([[0], cuts])] if len(order) else []
    return pa.table([pa.array(heads, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "chunk", "data"])


def _replies(chunk: np.ndarray, data: np.ndarray, level: np.ndarray) -> pa.Table:
    """Rows of _REPLY: data by chunk and level."""
    order = np.lexsort((level, chunk))
    c, v = chunk[order], level[order]
    cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(v) != 0)) + 1
    parts = np.split(data[order], cuts) if len(order) else []
    heads = np.concatenate([[0], cuts]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    return pa.table([pa.array(c[heads], pa.int64()), pa.array(v[heads], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "level", "data"])


def _gathered(packets: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, entry) of every entry of the packets."""
    parts = [np.frombuffer(b, kind) for b in packets.column("data").to_pylist()]
    chunk = np.repeat(np.asarray(packets.column("chunk"), dtype=np.int64), [len(p) for p in parts])
    return chunk, np.concatenate(parts) if parts else np.zeros(0, kind)


def _by_level(replies: pa.Table) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for level, data in zip(replies.column("level").to_pylist(), replies.column("data").to_pylist()):
        out.setdefault(level, []).append(data)
    return out


def _runs(c: Chunk, some: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, words): neighbouring windows of one group and text as one run each, and all runs' words one after the other."""
    w = c.words
    row = np.searchsorted(w.first, c.at[some], side="right") - 1
    fresh = np.ones(len(some), bool)
    # a run has at most as many windows as a prefix has places in one, so that it stays short
    fresh[1:] = (np.diff(c.at[some]) != 1) | (group[1:] != group[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(some)))
    most = 4 * c.window
    while (count > most).any():
        fresh[head[count > most] + most] = True
        head = np.flatnonzero(fresh)
        count = np.diff(np.append(head, len(some)))
    out = np.empty(len(head), _RUN)
    out["group"], out["at"], out["windows"], out["words"] = group[head], some[head], count, count + c.window - 1
    out["key"], out["text"] = c.rank[row[head]], c.hash[row[head]]
    n = count + c.window - 1
    at = np.repeat(c.at[some[head]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return out, w.hash[at]


def _packed(heads: np.ndarray, words: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """Rows of _PACKET: the runs by bucket of their group; a packet has the number of runs, their heads, then their words."""
    bucket = ((heads["group"] >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.cumsum(heads["words"].astype(np.int64)) - heads["words"]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    data, names = [], []
    for a, b in zip(cuts, cuts[1:]):
        mine = order[a:b]
        n = heads["words"][mine].astype(np.int64)
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        names.append(int(bucket[mine[0]]))
        data.append(np.array([b - a], "<u8").tobytes() + heads[mine].tobytes() + words[at].tobytes())
    return pa.table([pa.array(names, pa.int64()), pa.array([chunk] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"])


def _unpacked(packets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, head, words) of all runs of the packets."""
    heads, words = [], []
    for b in packets.column("data").to_pylist():
        n = int(np.frombuffer(b, "<u8", 1)[0])
        heads.append(np.frombuffer(b, _RUN, n, 8))
        words.append(np.frombuffer(b, "<u8", offset=8 + n * _RUN.itemsize))
    chunk = np.repeat(np.asarray(packets.column("chunk"), dtype=np.int64), [len(h) for h in heads])
    return chunk, np.concatenate(heads), np.concatenate(words)


def slices(head: np.ndarray, most_words: int) -> list[np.ndarray]:
    """The runs in slices of whole groups: those that begin within the same most_words words of the runs in order of groups."""
    order = np.argsort(head["group"], kind="stable")
    group, size = head["group"][order], head["words"][order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else order
    before = (np.cumsum(size) - size)[first]
    return np.split(order, first[np.flatnonzero(np.diff(before // most_words)) + 1])


def later_suffixes(chunk: np.ndarray, head: np.ndarray, words: np.ndarray, window: int, most_words: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, window's number there) of the suffixes that have an earlier one below a node of depth `window` or more.

    The runs are those of whole groups; each group has a tree of its own, as a suffix begins with its group's number.  Trees are
    built for about most_words words at a time, or for a group that is larger alone.
    """
    size = head["words"].astype(np.int64)
    begin = np.cumsum(size) - size
    parts = []
    for mine in slices(head, most_words):
        n = size[mine]
        at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts.append(_later(chunk[mine], head[mine], words[at], window))
    return np.concatenate([c for c, _ in parts]), np.concatenate([a for _, a in parts])


def _later(chunk: np.ndarray, head: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """later_suffixes of one slice."""
    size = head["words"].astype(np.int64)
    end = np.cumsum(size)
    # one suffix array for all groups of the slice: words of different groups are kept apart by their groups
    _, group = np.unique(head["group"], return_inverse=True)
    _, word = np.unique(words, return_inverse=True)
    owner = np.repeat(np.arange(len(head)), size)
    order, common = suffix_array(group[owner].astype(np.int64) * (len(words) + 1) + word, end[owner], window)
    node = deep_nodes(order, common, window)
    n = head["windows"].astype(np.int64)
    run = np.repeat(np.arange(len(head)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = head["at"].astype(np.int64)[run] + place
    mine = node[(end - size)[run] + place]
    sort = np.lexsort((at, head["text"][run], head["key"][run], mine))
    later = np.zeros(len(sort), bool)
    later[1:] = mine[sort][1:] == mine[sort][:-1]
    return chunk[run][sort][later], at[sort][later]


def _chunks(bare: DataFrame, chunks: int) -> DataFrame:
    """bare (k, t and others) with h, the text's hash, and chunk: by key and text, so that a key which many rows share is dealt out too."""
    return bare.withColumn("h", F.xxhash64("t")).withColumn("chunk", F.pmod(F.xxhash64("k", "h"), F.lit(chunks)))


def repeats(
    docs: DataFrame, window: int = 20, text: str = "text", key: str = "doc_id", chunk_bytes: int = 3 << 20, group_suffixes: int = 100_000, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Find the words covered by a window of `window` words that also starts earlier, and take them out.

    Earlier means a smaller key, or the same text and an earlier start; a null key comes before all others, and
    rows that share a key are in the order of their texts' hashes.  Returns key, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space), kept (the kept text; whole runs keep their white space) and spans (start and
    end of each maximal removed run, in words), one row per row of docs, and the columns of carry as they are.  A null
    or empty text has no words; its kept text is itself; an empty table gives no rows; other columns are not looked at.
    A prefix with more than group_suffixes windows is split by longer ones; a group of whole windows has one a chunk at most.
    """
    bare = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"), *(docs[c].alias(f"carry{i}") for i, c in enumerate(carry)))
    size = bare.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = _chunks(bare, chunks)
    steps = lengths(window)

    @giving_back
    def prefixes(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = Chunk(rows, window)
        out = np.empty(len(c.own), _COUNT)
        _, first = np.unique(c.whole, return_index=True)
        out["hash"], out["n"] = c.own, np.bincount(np.searchsorted(c.own, c.prefix[first]), minlength=len(c.own))
        return _dealt(c.own, name[0].as_py(), chunks, out)

    @giving_back
    def shared(packets: pa.Table) -> pa.Table:
        """Which prefixes another chunk holds too, and which have too many windows for one group."""
        chunk, e = _gathered(packets, _COUNT)
        _, back, holders = np.unique(e["hash"], return_inverse=True, return_counts=True)
        more = holders[back] > 1
        heavy = np.bincount(back, weights=e["n"], minlength=len(holders))[back] > group_suffixes
        level = np.repeat([SHARED, HEAVY], [more.sum(), heavy.sum()])
        return _replies(np.concatenate([chunk[more], chunk[heavy]]), np.concatenate([e["hash"][more], e["hash"][heavy]]), level)

    @giving_back
    def heavy_counts(name: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        """Of the heavy prefixes, how many windows the chunk files under each longer one."""
        found = _by_level(replies)
        if not rows.num_rows or HEAVY not in found:
            return _dealt(np.zeros(0, np.uint64), 0, chunks, np.zeros(0, _LONGER))
        c = Chunk(rows, window)
        some = c.found(found)[2]
        some = some[_in(c.prefix[some], np.unique(np.concatenate([np.frombuffer(r, "<u8") for r in found[HEAVY]])))]
        parts = []
        for i, length in enumerate(steps[:-1]):
            h, first, counts = np.unique(c.longer(some, length), return_index=True, return_counts=True)
            out = np.empty(len(h), _LONGER)
            out["prefix"], out["hash"], out["n"], out["step"] = c.prefix[some[first]], h, counts, i
            parts.append(out)
        every = np.concatenate(parts) if parts else np.zeros(0, _LONGER)
        return _dealt(every["prefix"], name[0].as_py(), chunks, every)

    @giving_back
    def chosen(packets: pa.Table) -> pa.Table:
        """For each heavy prefix the least length whose groups all fit, as a reply of that level to the chunks that hold it."""
        chunk, e = _gathered(packets, _LONGER)
        _, back = np.unique(e["prefix"], return_inverse=True)
        best = np.full(back.max() + 1 if len(back) else 0, len(steps) - 1)
        for i in range(len(steps) - 2, -1, -1):
            mine = np.flatnonzero(e["step"] == i)
            _, h = np.unique(e["hash"][mine], return_inverse=True)
            over = np.bincount(h, weights=e["n"][mine])[h] > group_suffixes if len(mine) else np.zeros(0, bool)
            fits = np.ones(len(best), bool)
            fits[back[mine[over]]] = False
            best[fits] = i
        who = np.unique(np.stack([chunk, back]), axis=1) if len(back) else np.zeros((2, 0), np.int64)
        names = np.zeros(len(best), np.uint64)
        names[back] = e["prefix"]
        return _replies(who[0], names[who[1]], np.array(steps)[best[who[1]]])

    @giving_back
    def suffixes(name: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _dealt(np.zeros(0, np.uint64), 0, chunks, np.zeros(0, _COUNT))
        c = Chunk(rows, window)
        _, _, some, heavy = c.found(_by_level(replies))
        return _packed(*_runs(c, some, c.group(some, heavy)), name[0].as_py(), chunks)

    @giving_back
    def deep(packets: pa.Table) -> pa.Table:
        chunk, at = later_suffixes(*_unpacked(packets), window)
        return _replies(chunk, at.astype("<u4"), np.full(len(at), REPEAT))

    kept_type = "k long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start:long,end:long>>"
    kept_type += "".join(f", carry{i} {bare.schema[f'carry{i}'].dataType.simpleString()}" for i in range(len(carry)))
    carried = [f"carry{i}" for i in range(len(carry))]

    @giving_back
    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["k", "n_words", "n_removed", "kept_sha256", "kept", "spans"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        if not rows.num_rows:
            return pa.table([*(pa.array([], t) for t in types), *(rows.column(n) for n in carried)], names=names + carried)
        c = Chunk(rows, window)
        found = _by_level(replies)
        some, to, _, _ = c.found(found)
        here = some[to != np.arange(len(some))]
        there = [np.frombuffer(d, "<u4") for d in found.get(REPEAT, [])]
        start = c.at[np.concatenate([here, *there]).astype(np.int64)] if len(c.at) else np.zeros(0, np.int64)
        # what a chunk sent for equal windows of its own is the earliest: where that goes, they are gone too
        w = c.words
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        out = [[] for _ in names]
        raw = w.data.tobytes()
        for i in range(rows.num_rows):
            a, b = w.first[i], w.first[i + 1]
            off = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
            spans = edge.reshape(-1, 2)
            bounds = np.concatenate([[0], edge, [b - a]]).reshape(-1, 2)  # the kept runs between
            runs = [raw[w.start[a + x] : w.end[a + y - 1]] for x, y in bounds if y > x]
            joined = b" ".join(b" ".join(r.split()) for r in runs)  # bytes.split() parts at the same six characters
            text = c.text[i].as_py()
            for col, v in zip(out, (None if c.null_key[i] else int(c.key[i]), b - a, int(off.sum()), hashlib.sha256(joined).hexdigest(), text if not len(spans) else b" ".join(runs).decode(), [{"start": int(x), "end": int(y)} for x, y in spans])):
                col.append(v)
        return pa.table([*(pa.array(v, t) for v, t in zip(out, types)), *(c.rows.column(n) for n in carried)], names=names + carried)

    first = dealt.groupBy("chunk").applyInArrow(prefixes, _PACKET).groupBy("bucket").applyInArrow(shared, _REPLY)
    both = lambda replies: dealt.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    longer = both(first).applyInArrow(heavy_counts, _PACKET).groupBy("bucket").applyInArrow(chosen, _REPLY)
    told = first.union(longer)
    second = both(told).applyInArrow(suffixes, _PACKET).groupBy("bucket").applyInArrow(deep, _REPLY)
    done = both(first.union(second)).applyInArrow(finish, kept_type)
    return done.withColumnsRenamed({"k": key} | dict(zip(carried, carry)))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same in SQL, with a row for each window: for small tables.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest([md5_number(array_to_string(ws[j:j + 19], ' ')) FOR j IN range(1, len(ws) - 18)]) AS h FROM w
), later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1
), gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS off FROM later GROUP BY doc_id
), word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w
), off AS (SELECT doc_id, unnest(off) AS i, true AS removed FROM gone
), kept AS (SELECT doc_id, count(*) AS n_words, count(removed) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (removed IS NULL) AS t FROM word LEFT JOIN off USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op6_substrings": op6_substrings}
ORACLES = {"op6_substrings": SQL}
