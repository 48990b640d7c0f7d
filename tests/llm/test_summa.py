import math
import random

import numpy as np
import pytest

from lithograph.llm import summa

SHAPE = "vec_id long, embedding array<double>, label int, i string, data string"


def brute(rows, positives=5, negatives=5):
    kept = []
    for id, vec, label, *_ in rows:
        if id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((id, label, tuple(math.floor(256 * x) for x in vec)))
    kept = sorted(set(kept))
    out = []
    for a in (r for r in kept if r[0] % 10 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b[0] != a[0])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            window = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a[0], p, rank, id, -s, -n) for rank, (n, id, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SHAPE)
    return sorted(tuple(r) for r in summa.mine(df, "vec_id % 10 = 0", **how).collect())


@pytest.mark.parametrize("how", [{}, {"width": 3, "anchor_block": 3, "row_block": 17}, {"width": 1, "anchor_block": 1, "row_block": 400}])
def test_against_brute_force(spark, how):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0.1, 1) for _ in range(draw.choice([7, 7, 7, 4]))], draw.choice([0, 0, 0, 1, 2]), "x", "y") for i in range(240)]
    rows += [(1000 + i, [draw.choice([0.0, 0.5, 1.0]) for _ in range(7)], i % 3, None, None) for i in range(120)]  # many ties
    rows += [(2000, None, 1, "", ""), (2010, [1.0] * 7, None, "", ""), (2020, [1.0, None] + [1.0] * 5, 1, "", ""), (2030, [float("inf")] * 7, 1, "", ""), (2040, [float("nan")] * 7, 1, "", "")]
    rows += [(2050, [], 1, "", ""), (None, [9.0] * 7, 1, "", ""), (0, [0.3] * 7, 1, "", ""), rows[10], rows[10]]  # empty, no id, a shared id, repeated rows
    want = brute(rows)
    assert got(spark, rows, **how) == want and len(want) > 100


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 0, "", "")]) == []
    assert got(spark, [(10, [1.0], 0, "", "")]) == []


def test_large_numbers():
    a = np.array([[1 << 30, -5], [3, 1 << 29]])
    assert (summa.product(a, a) == a.astype(object) @ a.T.astype(object)).all()
    assert (summa.unpacked(summa.packed(a)) == a).all() and summa.unpacked(summa.packed(np.zeros((0, 4), np.int64))).shape == (0, 4)
    assert summa.integers([[1e300, -1e300, 0.999, -0.001]], 256)[0].tolist() == [summa.MOST, -summa.MOST, 255, -1]


def test_best_keeps_ties():
    scores = np.array([[5, 7, 7, 7, 1], [0, 0, 0, 0, 0]])
    ids = np.array([9, 8, 3, 5, 1])
    allowed = np.array([[True, True, True, True, True], [False, True, False, True, False]])
    row, col = summa.best(scores, ids, allowed, 2)
    assert list(zip(row, ids[col])) == [(0, 3), (0, 5), (1, 5), (1, 8)]
