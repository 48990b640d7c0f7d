import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lithograph.llm.substrings import _RUN, _chunks, deep_nodes, later_suffixes, repeats, slices, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(key, words, removed flags, kept hash) of each row, rows sorted by key."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: r[0]):
        ws = WORD.findall(text or "")
        off = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            run = tuple(ws[i : i + window])
            if run in seen:
                off[i : i + window] = [True] * window
            seen.add(run)
        out.append((key, len(ws), sum(off), hashlib.sha256(" ".join(w for w, o in zip(ws, off) if not o).encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, window, chunk_bytes, group_suffixes=20_000):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as chunk", "3 as t")
    got = repeats(docs, window, chunk_bytes=chunk_bytes, group_suffixes=group_suffixes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, window)
    return got


def test_against_brute_force(spark):
    draw = random.Random(5)
    words = ["a", "b", "é", "Dd", "e,"]
    passages = [" ".join(draw.choice(words) for _ in range(n)) for n in (8, 15, 40)]
    rows = []
    for i in range(60):
        parts = [" ".join(draw.choice(words) + str(draw.randrange(40)) for _ in range(draw.randrange(0, 30)))]
        parts += [draw.choice(passages) for _ in range(draw.randrange(3))]
        draw.shuffle(parts)
        rows.append((i * 3, draw.choice([" ", "\n", " \t\x0b"]).join(parts)))
    rows += [(1, None), (2, ""), (4, "x " * 500), (5, rows[3][1]), (1000, rows[9][1]), (1001, " ".join(["solo"] * 8))]
    for chunk_bytes in (1 << 20, 400):
        check(spark, rows, 8, chunk_bytes)
        check(spark, rows, 20, chunk_bytes)


def test_repeated_rows_spans_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted(repeats(spark.createDataFrame([(7, text), (7, text)], "doc_id long, text string"), 20).collect(), key=lambda r: r.n_removed)
    assert [r.n_removed for r in got] == [0, 30]
    assert got[1].kept == "" and [(s.start, s.end) for s in got[1].spans] == [(0, 30)] and got[0].kept == text
    assert repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    null = repeats(spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in null} == {None: 0, 1: 30}


def test_rows_of_one_key_are_dealt_out(spark):
    draw = random.Random(8)
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join(f"{draw.choice('abc')}{draw.randrange(30)}" for _ in range(20)) + " " + " ".join(passage[draw.randrange(4) :]) for _ in range(40)]
    for key in (None, 7):
        docs = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string")
        bare = docs.selectExpr("doc_id as k", "text as t")
        assert _chunks(bare, 8).select("chunk").distinct().count() > 4
        order = [r.t for r in _chunks(bare, 8).orderBy("h").select("t").collect()]
        want = [(n, gone, kept) for _, n, gone, kept in brute(list(enumerate(order)), 8)]
        got = repeats(docs, 8, chunk_bytes=400).collect()
        assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
        assert {r.doc_id for r in got} == {key}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=8), st.integers(1, 8))
def test_suffix_array_and_nodes(texts, depth):
    words = np.array([w for t in texts for w in t])
    stop = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    order, common = suffix_array(words, stop, depth)
    part = lambda i, n=10**6: words[i : min(stop[i], i + n)].tolist()
    assert sorted(order.tolist()) == list(range(len(words)))
    for (a, b), c in zip(zip(order, order[1:]), common):
        assert part(a, depth) <= part(b, depth)
        same = next((i for i, (x, y) in enumerate(zip(part(a), part(b))) if x != y), min(len(part(a)), len(part(b))))
        assert c == same or c >= depth <= same
    node = deep_nodes(order, common, depth)
    for i in range(len(words)):
        for j in range(i):
            deep = len(part(i, depth)) == depth and part(i, depth) == part(j, depth)
            assert (node[i] == node[j]) == deep


def test_heavy_prefixes_are_split(spark):
    draw = random.Random(21)
    phrase = " ".join(f"p{i}" for i in range(6))
    rows = []
    for i in range(60):
        words = [" ".join(f"{draw.choice('abc')}{draw.randrange(6)}" for _ in range(draw.randrange(3, 14))) for _ in range(6)]
        rows.append((i, f" {phrase} ".join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    for limit in (1, 7, 40, 10**6):
        check(spark, rows, 8, 500, limit)


def test_a_hash_that_two_windows_share_removes_nothing(spark, monkeypatch):
    from lithograph.llm import substrings

    whole = substrings.W.runs
    monkeypatch.setattr(substrings.W, "runs", lambda w, k: (whole(w, k)[0], whole(w, k)[1] % np.uint64(3)))
    import pyarrow as pa

    rows = pa.table({"k": pa.array([1, 2], pa.int64()), "h": pa.array([5, 6], pa.int64()), "t": ["a b c d e f g h", "a b c d x y e f"]})
    chunk = substrings.Chunk(rows, 3)
    some = np.arange(len(chunk.at))
    to = chunk.same(some)
    words = [tuple(t.split()[i : i + 3]) for t in rows.column("t").to_pylist() for i in range(6)]
    assert all(words[i] == words[j] for i, j in enumerate(to)) and to[6] == 0


def test_very_long_text(spark):
    draw = random.Random(2)
    words = [f"w{draw.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[20_000:50_000])), (3, "x" * 300_000)]
    got = {r.doc_id: r for r in check(spark, rows, 20, 1 << 20)}
    assert got[2].n_removed == 30_000 and got[1].n_removed == 0


def test_slices_hold_whole_groups_and_change_nothing():
    draw = np.random.default_rng(3)
    head = np.zeros(60, _RUN)
    head["group"], head["windows"], head["at"] = draw.integers(0, 9, 60), 3, np.arange(60) * 3
    head["words"], head["key"] = head["windows"] + 3, draw.integers(0, 5, 60)
    words, chunk = draw.integers(0, 3, 360).astype(np.uint64), draw.integers(0, 4, 60)
    found = [sorted(zip(*(x.tolist() for x in later_suffixes(chunk, head, words, 4, most)))) for most in (1, 50, 1 << 18)]
    assert found[0] == found[1] == found[2] and found[0]
    parts = [set(head["group"][p].tolist()) for p in slices(head, 50)]
    assert len(parts) > 1 and sum(map(len, parts)) == len(set.union(*parts))
    assert all(len(x) == 0 for x in later_suffixes(chunk[:0], head[:0], words[:0], 4))
