import hashlib
import random

import numpy as np
import pytest

from lithograph.llm import lpf

SHAPE = "doc_id long, text string, k string, t string, h string, kept string"


def brute(rows, window):
    """rows in the order of their keys; keys are distinct."""
    seen, out = set(), []
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            if s in seen:
                gone[i : i + window] = [True] * window
            seen.add(s)
        edges = [i for i in range(len(raw) + 1) if (i > 0 and gone[i - 1]) != (i < len(raw) and gone[i])]
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((key, len(raw), sum(gone), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept, list(zip(edges[::2], edges[1::2]))))
    return out


def got(spark, rows, window, **how):
    df = lpf.later_copies(spark.createDataFrame(rows, SHAPE), window=window, **how)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept), [tuple(s) for s in r.spans]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def corpus(draw):
    """Texts of few letters that share passages, copies with changes, stretches of one letter and characters of several bytes."""
    shared = ["".join(draw.choice("ab") for _ in range(80)), "é日本" * 9 + "x", "z" * 50, "".join(draw.choice("abcdefgh ") for _ in range(300))]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(draw.randrange(0, 6)):
            p = draw.choice(shared)
            a = draw.randrange(len(p))
            parts += [p[a : a + draw.randrange(1, 120)], "".join(draw.choice("abcdefgh é") for _ in range(draw.randrange(0, 25)))]
        rows.append((i * 3 - 40, "".join(parts), "x", "y", "z", "w"))
    rows += [(1000 + i, shared[3][:i] + "#" + shared[3][i:], None, None, None, None) for i in range(0, 200, 7)]
    return rows + [(None, shared[3], "", "", "", ""), (5001, None, "", "", "", ""), (5002, "", "", "", "", "")]


@pytest.mark.parametrize("window, how", [(20, {"chunk_bytes": 700}), (20, {"chunk_bytes": 1500, "group_windows": 40}), (33, {"chunk_bytes": 300, "group_windows": 3, "gram": 4}), (100, {"chunk_bytes": 900}), (1, {"chunk_bytes": 5000})])
def test_against_brute_force(spark, window, how):
    rows = corpus(random.Random(window))
    want = brute(rows, window)
    assert got(spark, rows, window, **how) == want and sum(r[2] for r in want) > 500


def test_empty_and_repeated_rows(spark):
    assert got(spark, [], 5) == []
    rows = [(1, "abcdefgh", "", "", "", "")] * 3 + [(1, "abcdefgX", "", "", "", "")]
    out = got(spark, rows, 8)
    assert sorted(r[2] for r in out) == [0, 0, 8, 8]  # one of the equal rows stays whole


def test_long_text(spark):
    rows = [(1, "ab" * 150_000, "", "", "", ""), (2, "ab" * 60 + "!", "", "", "", "")]
    out = got(spark, rows, 100)
    assert out[0][2] == 300_000 - 2 and out[0][3] == 1 and out[1][1:4] == (121, 120, 1)


def test_anchors_are_those_of_the_window(monkeypatch):
    draw = random.Random(5)
    texts = [bytes(draw.choice(b"ab") for _ in range(n)) for n in (0, 3, 700, 9, 10, 250, 0)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offset = np.cumsum([0, *map(len, texts)])
    whole = lpf.anchors(raw, offset, 10, 4)
    want = [o + i for o, t in zip(offset, texts) for i in range(len(t) - 9)]
    assert sorted(x for a, n in zip(whole[0], whole[1]) for x in range(a, a + n)) == want
    monkeypatch.setattr(lpf, "_PIECE", 37)
    pieces = lpf.anchors(raw, offset, 10, 4)
    assert [a.tolist() for a in pieces[:3]] == [a.tolist() for a in whole[:3]]
    seen = {}
    for first, n, anchor, _ in zip(*whole):
        for i in range(first, first + n):
            assert 0 <= anchor - i <= 6
            assert seen.setdefault(raw[i : i + 10].tobytes(), anchor - i) == anchor - i  # equal windows, equal distances


def test_suffix_array_and_factors():
    draw = random.Random(9)
    for _ in range(30):
        parts = [bytes(draw.choice(b"ab\x00") for _ in range(draw.randrange(1, 60))) for _ in range(draw.randrange(1, 8))]
        groups = sorted(draw.randrange(3) for _ in parts)
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        stop = np.repeat(np.cumsum(size), size)
        group = np.repeat(np.array(groups, np.uint64), size)
        order, common = lpf.suffix_array(data, group, stop, 30)
        suffix = [(int(g), data[i:s].tobytes()) for i, (g, s) in enumerate(zip(group, stop))]
        assert [(suffix[i][0], suffix[i][1][:30]) for i in order] == sorted((g, s[:30]) for g, s in suffix)

        def lcp(i, j):
            if suffix[i][0] != suffix[j][0]:
                return 0
            a, b = suffix[i][1], suffix[j][1]
            return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

        assert all(min(c, 30) == min(lcp(i, j), 30) for c, i, j in zip(common, order, order[1:]))
        factor = lpf.longest_previous(order, common)
        want = [max((lcp(i, j) for j in range(i)), default=0) for i in range(len(data))]
        assert all(min(f, 30) == min(want[i], 30) for f, i in zip(factor, order))


def test_equal_hashes_are_compared(monkeypatch):
    data = np.frombuffer(b"abcabdabc", np.uint8)
    monkeypatch.setattr(lpf.W, "mix", lambda h: h * np.uint64(0))
    to = lpf.same_runs(data, np.array([0, 3, 6]), np.array([3, 3, 3]), np.zeros(3, np.uint64))
    assert to.tolist() == [0, 1, 0]
