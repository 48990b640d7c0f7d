import numpy as np

from lithograph.llm.lattice import Tables, connecting, e8_decode, e8_roots, near_duplicates


def test_decoder():
    draw = np.random.default_rng(1)
    roots = e8_roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    x = draw.normal(size=(500, 8)) * 2
    p = e8_decode(x)
    double = (2 * p).astype(int)
    assert ((double % 2 == double[:, :1] % 2).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    # no neighbour is nearer, so that it is the nearest point: E8's cells are bounded by these neighbours
    own = ((x - p) ** 2).sum(axis=1)
    others = (((x - p)[:, None] - roots[None]) ** 2).sum(axis=2)
    assert (others.min(axis=1) >= own - 1e-9).all()


def test_recall_at_the_threshold():
    draw = np.random.default_rng(2)
    a = draw.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.normal(size=(2000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    hashing, seed = Tables(64, 6, 3, 0.5), np.zeros(2000, np.uint64)
    for cosine, floor in ((0.931, 0.9), (0.96, 0.98), (0.985, 0.999)):
        c = cosine * a + np.sqrt(1 - cosine**2) * b
        x, y = hashing.cells(a, seed), hashing.cells(c, seed)
        met = (x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))
        assert met.mean() >= floor, (cosine, met.mean())


def brute(rows, least):
    n = len(rows)
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and l is not None for _, v, l in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    near = [[j for j in range(n) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        top = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), top, rows[i][0] == top))
    return sorted(out)


def test_table(spark):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(120):
        centre = draw.normal(size=16)
        for _ in range(draw.integers(1, 6)):
            rows.append((1000 - len(rows), (centre + 0.08 * draw.normal(size=16)).astype(np.float32).tolist(), int(draw.integers(0, 2))))
    hot = draw.normal(size=16)
    rows += [(2000 + i, (hot + 0.1 * draw.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(60)]
    rows += [(3000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] + [1.0] * 15, 0), (4, [None] + [1.0] * 15, 0), (5, rows[0][1], None), (6, [float("inf")] + [1.0] * 15, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as k", "2 as c", "3 as cell")
    for block in (4096, 8):
        got = near_duplicates(frame, block=block, tables=10, probes=6).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows, 0.93)
    assert near_duplicates(frame.limit(0)).count() == 0


def test_connecting():
    unit = np.array([[1, 0], [0, 1], [np.cos(0.3), np.sin(0.3)], [np.cos(0.6), np.sin(0.6)], [1, 0]])
    assert {frozenset(x) for x in connecting(unit, 0.93)} == {frozenset(x) for x in [(0, 2), (0, 4), (2, 3)]}


def test_none_below_the_threshold():
    from lithograph.llm.lattice import _linked

    draw = np.random.default_rng(7)
    a = draw.normal(size=(300, 24))
    a /= np.linalg.norm(a, axis=1)[:, None]
    for i in range(0, 300, 7):
        exact = float(np.cumsum(a[i] * a[i + 1])[-1]) if i < 299 else 1.0
        assert _linked(a[i : i + 1], a[i + 1 : i + 2], exact).all()
        assert not _linked(a[i : i + 1], a[i + 1 : i + 2], np.nextafter(exact, 2)).any()


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 2 else [0.0, 2.0, 0.0, 0.0], 1) for i in range(10)] + [(3, [1.0, 0.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted([(False, i, 6 if i % 2 else 4, i % 2) for i in range(10)] + [(False, 3, 6, 1), (True, 0, 6, 1)])
