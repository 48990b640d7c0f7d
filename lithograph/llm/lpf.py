"""Operator 12, dedup of byte strings by suffix arrays and longest-previous-factor arrays.

Every place where `window` bytes of a text begin is a window, and windows are filed by an anchor: the run of `gram` bytes
with the least hash in it, so that equal windows are filed together, at the same distance from it.  Neighbouring windows with one
anchor are one run, which travels as the bytes that they cover.  An anchor that has one run's content in the whole corpus goes no
further.  The runs of an anchor are one group; a group with more than `group_windows` windows is split by the bytes around the
anchor: windows are parted by their distance from it, and the more parts, the longer the stretch that all windows of a part share and are
filed by, up to all their bytes.

A group's runs get a suffix array with the lengths of common beginnings.  In suffix order, a suffix's longest previous factor is
the longer of its common beginnings with the nearest suffixes on both sides that begin earlier in the corpus.  Where it reaches
`window`, the window is a later copy and its bytes go.  Runs with all the same bytes are told apart before: the
earliest of them speaks for all, first in each chunk of texts, then in the group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm import words as W
from lithograph.llm.common import table
from lithograph.llm.substrings import _by_level, _chunks, _dealt, _gathered, _in, _replies, _sliding

_U = np.uint64
_PACKET = "bucket long, chunk long, data binary"
_REPLY = "chunk long, level int, data binary"
_COUNT = np.dtype([("hash", "<u8"), ("n", "<u4")])
#: A finer group of a chunk: the anchor it belongs to, its windows, and into how many parts (by place in PARTS) windows were parted.
_FINER = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("n", "<u4"), ("step", "<u4")])
#: A run: its group, its number in the chunk, the windows before it in that one, its windows and bytes, its text's key and hash, and where it begins there.
_RUN = np.dtype([("group", "<u8"), ("at", "<u4"), ("skip", "<u2"), ("windows", "<u2"), ("bytes", "<u4"), ("key", "<i8"), ("text", "<i8"), ("start", "<i8")])
#: Windows of a run that are later copies: the run's number, the first of them, and how many.
_LATER = np.dtype([("at", "<u4"), ("first", "<u2"), ("n", "<u2")])
#: Into how many parts the windows of a large group are parted by their distance from the anchor; the last gives each distance a part.
PARTS = (2, 4, 8, 1 << 15)
#: What a reply says: an anchor whose runs differ or stand elsewhere, one with too many windows, later copies; else an anchor and its parts.
SHARED, HEAVY, LATER = 0, -1, -2
_PIECE = 1 << 17


def anchors(raw: np.ndarray, offset: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, windows, anchor, hash) of each run: neighbouring windows of one text with one anchor; all bytes are texts from offset to offset.

    Of equal hashes in a window the first counts.  Bytes are worked on piece by piece.
    """
    last = np.maximum(offset[1:] - window + 1, offset[:-1])  # behind each text's last window
    out, carried = [], -1
    mask = _U((1 << (_PIECE + window).bit_length()) - 1)  # room for a place in a piece
    row_edges = np.stack([offset[:-1], last], axis=1).reshape(-1)
    for a in range(0, max(0, len(raw) - window + 1), _PIECE):
        part = raw[a : a + _PIECE + window - 1]
        n = len(part) - gram + 1
        at = np.arange(n)
        h = W.mix(W.run_sums(part.astype(_U) + _U(1), at, at + gram, W.WIDE))
        least = _sliding((h & ~mask) | at.astype(_U), window - gram + 1, np.minimum)
        anchor = (least & mask).astype(np.int64)
        starts = a + np.arange(len(anchor))
        # between a text's beginning and the end of its last window's start, an odd number of edges lie at or before
        valid = np.searchsorted(row_edges, starts, side="right") % 2 == 1
        text = np.searchsorted(offset, starts, side="right")
        fresh = valid.copy()
        fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
        if len(anchor) and valid[0] and carried == a + anchor[0] and starts[0] != offset[text[0] - 1]:
            fresh[0] = False
        carried = a + anchor[-1] if len(anchor) and valid[-1] else -1
        head = np.flatnonzero(fresh)
        count = np.add.reduceat(valid, head) if len(head) else np.zeros(0, np.int64)
        before = int(valid[: head[0]].sum() if len(head) else valid.sum())
        if before and out:
            out[-1][1][-1] += before  # the run that the piece's edge cuts
        if len(head):
            out.append((starts[head], count.astype(np.int64), a + anchor[head], h[anchor[head]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(c) for c in zip(*out))


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, n of them."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def same_runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each run of bytes the first one in the same group that has the same bytes; bytes are compared, not only their hashes."""
    if not len(begin):
        return begin
    h = W.mix(W.run_sums(data.astype(_U) + _U(1), begin, begin + size, W.NARROW) + group)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    to = first[back]
    others = np.flatnonzero(to != np.arange(len(to)))
    differ = (size[others] != size[to[others]]) | (group[others] != group[to[others]])
    fit = others[~differ]
    unequal = data[_spread(begin[fit], size[fit])] != data[_spread(begin[to[fit]], size[fit])]
    differ[~differ] = np.add.reduceat(unequal, np.cumsum(size[fit]) - size[fit]) > 0 if len(fit) else False
    to[others[differ]] = others[differ]  # one hash for different bytes: each speaks for itself
    return to


def suffix_array(data: np.ndarray, group: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of the suffixes that begin at each byte and end at stop, by doubling from seven bytes on.

    order sorts them by their group and their first bytes, as far as depth or further; common has for each but the first how many first bytes
    it shares with the one before it, exact up to that many; those of different groups share none.
    """
    n, at = len(data), np.arange(len(data))
    seven = np.zeros(n, np.int64)
    for i in range(7):
        inside = at + i < stop
        seven[inside] += (data[at[inside] + i].astype(np.int64) + 1) << (9 * (6 - i))
    _, rank = np.unique(seven, return_inverse=True)
    _, of = np.unique(group, return_inverse=True)
    ranks, span = [np.unique(of * (n + 1) + rank, return_inverse=True)[1] + 1], 7
    while span < depth:
        after = np.zeros(n, np.int64)
        inside = at + span < stop
        after[inside] = ranks[-1][at[inside] + span]
        _, rank = np.unique(ranks[-1] * (n + 2) + after, return_inverse=True)
        ranks.append(rank + 1)
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    left, right = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), np.int64)
    alike = of[left] == of[right]
    for level in range(len(ranks) - 1, -1, -1):
        step = 7 << level
        some = np.flatnonzero(alike & (left + common + step <= stop[left]) & (right + common + step <= stop[right]))
        same = some[ranks[level][left[some] + common[some]] == ranks[level][right[some] + common[some]]]
        common[same] += step
    more = np.flatnonzero(alike)
    for _ in range(6):
        more = more[(left[more] + common[more] < stop[left[more]]) & (right[more] + common[more] < stop[right[more]])]
        more = more[data[left[more] + common[more]] == data[right[more] + common[more]]]
        common[more] += 1
    return order, common


def longest_previous(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, all in suffix order: place is where each begins, common its common beginning with the next.

    The nearest suffix before and the nearest behind with a smaller place are found by steps that halve, over tables of the
    least place and the least common length of 1, 2, 4, ... neighbours.
    """
    n = len(place)
    if n < 2:
        return np.zeros(n, np.int64)
    least, shared = [place], [np.append(common, 0)]
    while 2 << (len(least) - 1) <= n:
        step = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-step], least[-1][step:]))
        shared.append(np.minimum(shared[-1][:-step], shared[-1][step:]))
    at = np.arange(n)
    out = np.zeros(n, np.int64)
    # before: cur is the first of the neighbours known to begin later; low the least common length from it to the suffix
    cur, low = at.copy(), np.full(n, np.iinfo(np.int64).max)
    for level in range(len(least) - 1, -1, -1):
        step = 1 << level
        some = np.flatnonzero(cur >= step)
        some = some[least[level][cur[some] - step] > place[some]]
        low[some] = np.minimum(low[some], shared[level][cur[some] - step])
        cur[some] -= step
    found = cur > 0
    out[found] = np.minimum(low[found], common[cur[found] - 1])
    # behind: cur is the last of the neighbours known to begin later
    cur, low = at.copy(), np.full(n, np.iinfo(np.int64).max)
    for level in range(len(least) - 1, -1, -1):
        step = 1 << level
        some = np.flatnonzero(cur + step < n)
        some = some[least[level][cur[some] + 1] > place[some]]
        low[some] = np.minimum(low[some], shared[level][cur[some]])
        cur[some] += step
    found = cur < n - 1
    out[found] = np.maximum(out[found], np.minimum(low[found], common[cur[found]]))
    return out


class Chunk:
    """A chunk's texts in the order of their keys and their texts' hashes, with the runs of their windows."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        rows = rows.take(pc.sort_indices(rows, [("k", "ascending"), ("h", "ascending")], null_placement="at_start"))
        key = rows.column("k").combine_chunks()
        self.null_key = np.asarray(key.is_null())
        self.key = np.asarray(key.fill_null(0), dtype=np.int64)
        # a null key counts as before every other
        self.rank = np.where(self.null_key, np.iinfo(np.int64).min, self.key)
        self.hash = np.asarray(rows.column("h").combine_chunks(), dtype=np.int64)
        text = rows.column("t").combine_chunks()
        self.raw, self.offset = W.raw_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        self.window, self.gram = window, gram
        self.first, self.windows, self.anchor, self.group = anchors(self.raw, self.offset, window, gram)
        self.size = self.windows + window - 1
        self.to = same_runs(self.raw, self.first, self.size, self.group)
        self.own = self.to == np.arange(len(self.to))

    def finer(self, some: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run, skip, windows, group) of some runs, parted into `parts` ranges of the distance from window to anchor.

        A part's group is its anchor, its range, and the stretch of bytes that all windows of the range hold.
        """
        places = self.window - self.gram + 1
        width = -(-places // min(parts, places))
        far = self.anchor[some] - self.first[some]  # the distance of a run's first window; its last has the least
        near = far - self.windows[some] + 1
        n = far // width - near // width + 1
        run = np.repeat(some, n)
        part = _spread(near // width, n)
        top = np.minimum(np.repeat(far, n), (part + 1) * width - 1)
        low = np.maximum(np.repeat(near, n), part * width)
        # windows at distances from part * width to (part + 1) * width - 1 all hold the bytes between these two
        begin = self.anchor[run] - part * width
        end = self.anchor[run] - np.minimum((part + 1) * width, places) + 1 + self.window
        stretch = W.run_sums(self.raw.astype(_U) + _U(1), begin, end, W.WIDE)
        return run, np.repeat(far, n) - top, top - low + 1, W.mix(self.group[run] + W.mix(stretch + W.mix(part.astype(_U) + _U(1))))

    def sent(self, replies: dict[int, list[bytes]]) -> tuple[np.ndarray, ...]:
        """(run, skip, windows, group) of all runs to send: the earliest of equal ones, if others of the anchor differ or stand elsewhere."""
        shared = np.unique(np.concatenate([np.zeros(0, _U), *(np.frombuffer(r, "<u8") for r in replies.get(SHARED, []))]))
        some = np.flatnonzero(self.own & _in(self.group, shared))
        out = []
        for parts in PARTS:
            if parts in replies:
                large = _in(self.group[some], np.unique(np.concatenate([np.frombuffer(r, "<u8") for r in replies[parts]])))
                out.append(self.finer(some[large], parts))
                some = some[~large]
        out.append((some, np.zeros(len(some), np.int64), self.windows[some], self.group[some]))
        return tuple(np.concatenate(c) for c in zip(*out))


def _packed(c: Chunk, runs: tuple[np.ndarray, ...], chunk: int, buckets: int) -> pa.Table:
    """Rows of _PACKET: the runs by bucket of their group; a packet has the number of runs, their heads, then their bytes."""
    run, skip, windows, group = runs
    bucket = ((group >> _U(20)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    row = np.searchsorted(c.offset, c.first[run], side="right") - 1
    names, data = [], []
    for a, b in zip(cuts, cuts[1:]):
        mine = order[a:b]
        head = np.empty(b - a, _RUN)
        of, begin = run[mine], c.first[run[mine]] + skip[mine]
        head["group"], head["at"], head["skip"], head["windows"], head["bytes"] = group[mine], of, skip[mine], windows[mine], windows[mine] + c.window - 1
        head["key"], head["text"], head["start"] = c.rank[row[mine]], c.hash[row[mine]], begin - c.offset[row[mine]]
        names.append(int(bucket[mine[0]]))
        data.append(np.array([b - a], "<u8").tobytes() + head.tobytes() + c.raw[_spread(begin, head["bytes"].astype(np.int64))].tobytes())
    return pa.table([pa.array(names, pa.int64()), pa.array([chunk] * len(data), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "chunk", "data"])


def later_windows(chunk: np.ndarray, head: np.ndarray, data: np.ndarray, window: int, most_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, entries of _LATER) of whole groups' runs, whose bytes stand one after the other in data.

    Suffix arrays are built for about most_bytes bytes at a time, or for a group that is larger alone.
    """
    size = head["bytes"].astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.lexsort((head["start"], head["text"], head["key"], head["group"]))
    # the first of equal runs is the earliest, as runs come in the order of their beginnings
    to = order[same_runs(data, begin[order], size[order], head["group"][order])]
    copies = order[to != order]
    whole = np.zeros(len(copies), _LATER)
    whole["at"], whole["first"], whole["n"] = head["at"][copies], head["skip"][copies], head["windows"][copies]
    out = [(chunk[copies], whole)]
    left = order[to == order]
    group = head["group"][left]
    # a run's own windows all differ, as they lie at different distances from the anchor: a group of one run has no copies
    alone = np.ones(len(left), bool)
    alone[1:] &= group[1:] != group[:-1]
    alone[:-1] &= group[1:] != group[:-1]
    left = left[~alone]
    if len(left):
        group = head["group"][left]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        before = (np.cumsum(size[left]) - size[left])[starts]
        for mine in np.split(left, starts[np.flatnonzero(np.diff(before // most_bytes)) + 1]):
            out.append(_later(chunk[mine], head[mine], data[_spread(begin[mine], size[mine])], window))
    return np.concatenate([c for c, _ in out]), np.concatenate([e for _, e in out])


def _later(chunk: np.ndarray, head: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """later_windows of one slice, whose runs come in the order of their beginnings within each group and differ."""
    size, n = head["bytes"].astype(np.int64), head["windows"].astype(np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(head)), size)
    order, common = suffix_array(data, head["group"][owner], end[owner], window)
    # only suffixes with a neighbour that shares a window with them can have a previous factor of that length
    near = np.zeros(len(order), bool)
    near[1:] |= common >= window
    near[:-1] |= common >= window
    kept = np.flatnonzero(near)
    between = common[np.minimum(kept[:-1], len(common) - 1)] if len(kept) else common[:0]
    between = np.where(np.diff(kept) == 1, between, 0)
    # a slice's bytes stand in the order of beginnings, so that a byte's place there is the suffix's place within its group
    factor = longest_previous(order[kept], between)
    place = np.sort(order[kept[factor >= window]])
    run = owner[place]
    number = place - (end - size)[run]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(fresh)
    out = np.empty(len(first), _LATER)
    out["at"], out["first"] = head["at"][run[first]], head["skip"][run[first]] + number[first]
    out["n"] = np.diff(np.append(first, len(place)))
    return chunk[run[first]], out


def _unpacked(packets: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, head, bytes) of all runs of the packets."""
    heads, data = [], []
    for b in packets.column("data").to_pylist():
        n = int(np.frombuffer(b, "<u8", 1)[0])
        heads.append(np.frombuffer(b, _RUN, n, 8))
        data.append(np.frombuffer(b, np.uint8, offset=8 + n * _RUN.itemsize))
    chunk = np.repeat(np.asarray(packets.column("chunk"), dtype=np.int64), [len(h) for h in heads])
    return chunk, np.concatenate(heads), np.concatenate(data)


def later_copies(
    docs: DataFrame, window: int = 100, text: str = "text", key: str = "doc_id", gram: int | None = None, chunk_bytes: int = 3 << 20, group_windows: int = 400_000
) -> DataFrame:
    """Find the bytes covered by a string of `window` bytes that also starts earlier, and take them out.

    Earlier means a smaller key, or the same text and an earlier start; a null key comes before all others, and
    rows that share a key are in the order of their texts' hashes.  Returns key, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256, kept (the bytes that stay, which may cut a character) and spans (start and end in bytes), one
    row per row of docs.  A null text is empty; an empty table gives no rows; other columns are not looked at.
    """
    gram = gram or max(1, window // 3)
    bare = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t"))
    size = bare.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = _chunks(bare, chunks)

    def counts(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = Chunk(rows, window, gram)
        own, first, back = np.unique(c.group[c.own], return_index=True, return_inverse=True)
        out = np.empty(len(own), _COUNT)
        out["hash"], out["n"] = own, np.bincount(back, weights=c.windows[c.own], minlength=len(own))
        lone = np.bincount(back, minlength=len(own)) == 1
        # a chunk that holds different runs of an anchor says so by an entry more, of no windows
        more = out[~lone].copy()
        more["n"] = 0
        every = np.concatenate([out, more])
        return _dealt(every["hash"], name[0].as_py(), chunks, every)

    def shared(packets: pa.Table) -> pa.Table:
        """Which anchors have runs to compare, and which have too many windows for one group."""
        chunk, e = _gathered(packets, _COUNT)
        _, back, entries = np.unique(e["hash"], return_inverse=True, return_counts=True)
        told = e["n"] > 0
        more = told & (entries[back] > 1)
        heavy = told & (np.bincount(back, weights=e["n"], minlength=len(entries))[back] > group_windows)
        level = np.repeat([SHARED, HEAVY], [more.sum(), heavy.sum()])
        return _replies(np.concatenate([chunk[more], chunk[heavy]]), np.concatenate([e["hash"][more], e["hash"][heavy]]), level)

    def finer_counts(name: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        """Of the heavy anchors, how many windows the chunk files under each finer group."""
        found = _by_level(replies)
        every = np.zeros(0, _FINER)
        if rows.num_rows and HEAVY in found:
            c = Chunk(rows, window, gram)
            some = np.flatnonzero(c.own & _in(c.group, np.unique(np.concatenate([np.frombuffer(r, "<u8") for r in found[HEAVY]]))))
            parts = []
            for i, n in enumerate(PARTS[:-1]):
                run, _, windows, group = c.finer(some, n)
                h, first, back = np.unique(group, return_index=True, return_inverse=True)
                out = np.empty(len(h), _FINER)
                out["anchor"], out["hash"], out["n"], out["step"] = c.group[run[first]], h, np.bincount(back, weights=windows, minlength=len(h)), i
                parts.append(out)
            every = np.concatenate(parts)
        return _dealt(every["anchor"], name[0].as_py(), chunks, every)

    def chosen(packets: pa.Table) -> pa.Table:
        """For each heavy anchor the fewest parts whose groups all fit, as a reply of that level to the chunks that hold it."""
        chunk, e = _gathered(packets, _FINER)
        names, back = np.unique(e["anchor"], return_inverse=True)
        best = np.full(len(names), len(PARTS) - 1)
        for i in range(len(PARTS) - 2, -1, -1):
            mine = np.flatnonzero(e["step"] == i)
            _, h = np.unique(e["hash"][mine], return_inverse=True)
            over = np.bincount(h, weights=e["n"][mine])[h] > group_windows if len(mine) else np.zeros(0, bool)
            fits = np.ones(len(best), bool)
            fits[back[mine[over]]] = False
            best[fits] = i
        who = np.unique(np.stack([chunk, back]), axis=1) if len(back) else np.zeros((2, 0), np.int64)
        return _replies(who[0], names[who[1]], np.array(PARTS)[best[who[1]]])

    def runs(name: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return _dealt(np.zeros(0, _U), 0, chunks, np.zeros(0, _COUNT))
        c = Chunk(rows, window, gram)
        return _packed(c, c.sent(_by_level(replies)), name[0].as_py(), chunks)

    def compared(packets: pa.Table) -> pa.Table:
        chunk, later = later_windows(*_unpacked(packets), window)
        return _replies(chunk, later, np.full(len(later), LATER))

    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    shape = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        c = Chunk(rows, window, gram)
        told = [np.frombuffer(d, _LATER) for d in _by_level(replies).get(LATER, [])]
        later = np.concatenate([np.zeros(0, _LATER), *told])
        # what is later in a run is later in the equal runs of the chunk, which are all later by themselves
        copies = np.flatnonzero(~c.own)
        begin = np.concatenate([c.first[later["at"]] + later["first"], c.first[copies]]).astype(np.int64)
        end = begin + np.concatenate([later["n"].astype(np.int64), c.windows[copies]]) + window - 1
        n = len(c.raw) + 1
        gone = np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0
        out: list[list] = [[] for _ in names]
        for i in range(rows.num_rows):
            a, b = c.offset[i], c.offset[i + 1]
            off, body = gone[a:b], c.raw[a:b]
            removed = int(off.sum())
            spans = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8))).reshape(-1, 2) if removed else []
            kept = (body[~off] if removed else body).tobytes()
            row = (None if c.null_key[i] else int(c.key[i]), int(b - a), removed, len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": int(x), "end": int(y)} for x, y in spans])
            for col, v in zip(out, row):
                col.append(v)
        return pa.table([pa.array(v, t) for v, t in zip(out, types)], names=names)

    first = dealt.groupBy("chunk").applyInArrow(counts, _PACKET).groupBy("bucket").applyInArrow(shared, _REPLY)
    both = lambda replies: dealt.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    finer = both(first.where(F.col("level") == HEAVY)).applyInArrow(finer_counts, _PACKET).groupBy("bucket").applyInArrow(chosen, _REPLY)
    found = both(first.where(F.col("level") == SHARED).union(finer)).applyInArrow(runs, _PACKET).groupBy("bucket").applyInArrow(compared, _REPLY)
    return both(found).applyInArrow(finish, shape).withColumnRenamed("k", key)


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return later_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same in SQL, with a row for each byte: for small tables.  Bytes are pairs of hexadecimal digits.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), w AS (SELECT doc_id, unnest(range(0, strlen(x) // 2 - 99)) AS i, unnest([md5_number(substring(x, 2 * j + 1, 200)) FOR j IN range(0, strlen(x) // 2 - 99)]) AS h FROM d
), later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later)
), span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM island GROUP BY ALL
), kept AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM span
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(strlen(x)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id
), body AS (SELECT doc_id, string_agg(substring(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, strlen(x) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN body USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM span GROUP BY doc_id) USING (doc_id)
"""

QUERIES = {"op12_suffix_array": op12_suffix_array}
ORACLES = {"op12_suffix_array": SQL}
