import itertools

import numpy as np

from lithograph.llm.hilbert import hilbert_index, nearest


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        at = hilbert_index(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if q % 20 == 0:
            found = sorted(((-float(np.einsum("j,j->", y, x)), i) for i, y in ok if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_table(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # more equal vectors than places
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as q", "3 as curve")
    want = brute(rows, 5)
    whole = {"k": 5, "curves": 1}
    for more in ({}, {"least": 50, "ranges": 6, "reach": 6}, {"least": 50, "ranges": 6, "reach": 6, "block": 32, "query_block": 4}):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(frame, frame.where("vec_id % 20 = 0"), **whole, **more).collect())
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    few = frame.where("vec_id in (0, 1, 2)")
    assert nearest(few, few.where("vec_id = 0"), k=5).count() == 2
    assert nearest(frame.limit(0), frame.limit(0)).count() == 0


def recall(got, right):
    return len({(r.query_id, r.vec_id) for r in got} & right) / len(right)


def test_windows_find_the_nearest(spark):
    """The query's own shares of the rows, on directions without any structure, where curves have the least to go by."""
    draw = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(6000, 64)).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    right = set()
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        right |= {(q, int(i)) for i in np.argsort(-s)[:20]}
    got = nearest(frame, frame.where("vec_id % 20 = 0"), least=180).collect()
    assert len(got) == 300 * 20
    assert recall(got, right) > 0.9
    share = 5 / 32  # of the rows, which is what windows at random places would find
    assert share < recall(nearest(frame, frame.where("vec_id % 20 = 0"), curves=1, least=180).collect(), right) < 0.9


def test_windows_cross_edges_and_find_close_vectors(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(100, 16))
    rows = [(i, (centres[i // 10] + 0.02 * draw.normal(size=16)).tolist()) for i in range(1000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    right = {(q, i) for q, _, i, _ in brute(rows, 9)}
    assert recall(nearest(frame, frame.where("vec_id % 20 = 0"), k=9, least=30, reach=1).collect(), right) > 0.95


def test_hot_vector_and_repeated_rows(spark):
    draw = np.random.default_rng(7)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(draw.normal(size=(300, 4)))]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    rows += [rows[5]] * 30 + [(5, rows[7][1])]  # one row thirty times more, and its key with another vector
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(frame, frame.where("vec_id = 0"), k=20, least=20, block=16, query_block=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1000, 1020))  # ties to the smaller key, however a hot range is dealt
    got = nearest(frame, frame.where("vec_id = 7"), k=600, curves=1, reach=32).collect()
    assert sorted(r.vec_id for r in got) == sorted([i for i in range(300) if i != 7] + [5] + list(range(1000, 1200)))
