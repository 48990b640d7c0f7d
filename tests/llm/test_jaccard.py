import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lithograph.llm.jaccard import filed, join, trie_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngrams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(sets, percent):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), max_size=9), st.integers(30, 100))
def test_trie_against_all_pairs(sets, percent):
    sets = [np.array(sorted(s), np.uint64) for s in {tuple(sorted(s)) for s in sets}]
    links, _ = trie_join(sets, percent)
    assert len(links) < max(1, len(sets))
    root = list(range(len(sets)))
    for a, b in links:
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        assert 100 * len(x & y) >= percent * len(x | y)
        root = [root[a] if r == root[b] else r for r in root]
    assert same_partition(root, groups([set(s.tolist()) for s in sets], percent))


def _rows():
    draw = random.Random(3)
    vocabulary = [f"W{i}é" for i in range(300)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(40):
        words = [draw.choice(vocabulary) for _ in range(draw.randrange(3, 150))]
        if i % 3 == 0:
            words += passage.split()
        rows.append(" ".join(words))
        for _ in range(draw.randrange(4)):
            near = list(words)
            for _ in range(draw.randrange(0, 4)):
                near[draw.randrange(len(near))] = draw.choice(vocabulary)
            rows.append("\t".join(near).lower())
    rows += [passage + f" tail{i}" for i in range(6)]
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)] + [(1, None), (2, ""), (3, "  "), (4, "One Two"), (5, "one two"), (6, "one"), (7, "x " * 30_000)]


def test_against_all_pairs(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as size", "3 as c")
    for n, percent, sets in ((4, 85, 1500), (5, 80, 1500), (4, 85, 3)):
        got = {r.doc_id: r for r in join(docs, n, percent, block_sets=sets).collect()}
        want = [ngrams(t, n) for _, t in rows]
        assert all(got[k].n_shingles == len(s) for (k, _), s in zip(rows, want))
        found = groups(want, percent)
        least = {g: min(k for (k, _), x in zip(rows, found) if x == g) for g in found}
        assert all(got[k].component_id == least[g] for (k, _), g in zip(rows, found))
        assert all((got[k].class_id is None) == (not s) for (k, _), s in zip(rows, want))


def test_repeated_keys_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (0, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in join(docs, 4, 85).collect())
    assert got == [(False, 0, 0), (False, 1, 0), (False, 1, 1), (False, 1, 1), (True, 0, 1)]
    assert join(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), max_size=12), st.integers(30, 100), st.booleans(), st.randoms())
def test_counts_against_all_pairs(sets, percent, sides, draw):
    sets = sorted({tuple(sorted(s)) for s in sets})
    weight, side = [draw.randrange(1, 5) for _ in sets], [draw.randrange(2) for _ in sets]
    links, got = trie_join([np.array(s, np.uint64) for s in sets], percent, np.array(weight, np.int64), np.array(side, np.int64) if sides else None)
    near = lambda i, j: 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))
    every = range(len(sets))
    assert got.tolist() == [sum(weight[j] for j in every if j != i and (side[i] != side[j] or not sides) and near(i, j)) for i in every]
    assert all(near(i, j) and (side[i] != side[j] or not sides) for i, j in links)
    root = list(every)
    for pairs in (links, [(i, j) for i in every for j in every if near(i, j) and (side[i] != side[j] or not sides)]):
        before = list(root)
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
    assert root == before  # what the links connect is all that the pairs connect


@settings(max_examples=400, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=300), st.randoms(), st.integers(1, 100))
def test_filed_ngrams_lose_no_pair(one, draw, percent):
    from collections import Counter

    other = set(one)
    for x in draw.sample(sorted(one), draw.randrange(len(one) + 1)):
        other.discard(x)
        if draw.random() < 0.5:
            other.add(draw.randrange(10**6))
    if not other or 100 * len(one & other) < percent * len(one | other):
        return
    pair = [sorted(s)[: filed(len(s), percent)[0]] for s in (one, other)]
    often = Counter(x for s in pair for x in s)
    often.update({x: draw.randrange(5) for x in often})  # what other sets file
    first = [set(sorted(p, key=lambda x: (often[x], x))[: filed(len(s), percent)[1]]) for p, s in zip(pair, (one, other))]
    assert first[0] & first[1]


def test_small_percents_lose_no_link(spark):
    draw = random.Random(12)
    rows = []
    for i in range(40):
        words = [f"v{draw.randrange(10**6)}" for _ in range(120)]
        for part in (1.0, 0.9, 0.8, 0.65, 0.5, 0.35):
            rows.append((len(rows), " ".join(words[: int(120 * part)] + [f"z{draw.randrange(10**6)}" for _ in range(120 - int(120 * part))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [ngrams(t, 3) for _, t in rows]
    for percent in (30, 50, 70, 100):
        got = {r.doc_id: r for r in join(docs, 3, percent).collect()}
        for i, s in enumerate(sets):
            assert got[i].n_links == sum(100 * len(s & x) >= percent * len(s | x) for x in sets) - 1


def test_words_that_one_polynomial_confuses():
    import pyarrow as pa

    from lithograph.llm.words import split

    one, other = "a", "b"
    for _ in range(11):
        one, other = one + other, other + one
    w = split(pa.array([f"{one} {other} {one}"]))
    assert w.hash[0] == w.hash[2] != w.hash[1]


def test_every_link_is_counted(spark):
    rows = _rows() + [(2001, None), (2002, "one TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [ngrams(t, 4) for _, t in rows]
    for sets in (1500, 3):
        got = {r.doc_id: r.n_links for r in join(docs, 4, 85, block_sets=sets).collect()}
        for (k, _), s in zip(rows, want):
            assert got[k] == (sum(bool(x) and 100 * len(x & s) >= 85 * len(x | s) for x in want) - 1 if s else 0)


def test_a_key_that_many_rows_share_brings_only_its_class(spark):
    from lithograph.llm.jaccard import _class_texts

    bare = spark.createDataFrame([(None, f"text {i}") for i in range(50)] * 2, "k long, t string").selectExpr("*", "xxhash64(t) as th")
    rows = bare.where("t = 'text 7'").limit(1).selectExpr("1L as c", "k as rep", "th")
    assert [(r.c, r.t) for r in _class_texts(bare, rows).collect()] == [(1, "text 7")]
