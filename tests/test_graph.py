"""Calls put to methods, and walks over a kept adjacency, against plain Python."""

import random

import pytest

from lithograph.operators import adjacency, graph


def _name(fqn):
    return fqn.split("(")[0].split(".")[-1]


def _plain(calls, methods):
    out = []
    for i, source, target in calls:
        if not target.startswith("~"):
            out.append((i, source, target))
        elif "." in target[1:]:
            scope, name = target[1:].rsplit(".", 1)
            named = sorted(m for m in set(methods) if _name(m) == name)
            held = [m for m in named if scope.lower() in m.lower()]
            if named:
                out.append((i, source, held[0] if held and scope else named[0]))
    return sorted(out)


def _resolved(spark, calls, methods):
    rows = graph.resolve_calls(spark.createDataFrame(calls, "id int, source string, target string"), spark.createDataFrame([(m,) for m in methods], "fqn string"))
    return sorted(tuple(r) for r in rows.collect())


def test_calls_find_the_first_method_that_holds_the_scope(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abAB") for _ in range(draw.randrange(1, 7)))
    methods = [f"{word()}.{word()}.{draw.choice(['get', 'set', 'run'])}({word()})" for _ in range(400)] * 2
    targets = [f"~{word()}.{draw.choice(['get', 'set', 'run', 'none'])}" for _ in range(600)] + ["~.get", "~get", "plain.get", "~a.b.get", "~.none", "~", "~abababababababababab.get"]
    calls = [(i, "s", t) for i, t in enumerate(targets)]
    assert _resolved(spark, calls, methods) == _plain(calls, methods)


def test_scopes_whose_grams_are_held_apart(spark):
    """All grams of the scope are held, but by the earlier methods not in one run."""
    methods = ["a.abcx.bcd.get()", "b.bcdabc.get()", "c.xabcd.get()", "d.abcd.get()"]
    calls = [(1, "s", "~abcd.get"), (2, "s", "~ABCD.get"), (3, "s", "~abcde.get"), (4, "s", "~zz.get")]
    assert _resolved(spark, calls, methods) == [(1, "s", "c.xabcd.get()"), (2, "s", "c.xabcd.get()"), (3, "s", "a.abcx.bcd.get()"), (4, "s", "a.abcx.bcd.get()")]


def test_a_common_name_with_many_scopes(spark):
    methods = spark.range(4000).selectExpr("concat('shop.t', id, 'x.get()') AS fqn")
    named = methods.selectExpr("fqn", "'get' AS name")
    hints = spark.range(2000).selectExpr("'get' AS name", "concat('t', id * 2, 'x') AS scope")
    got = graph.hinted(hints, named).collect()
    assert len(got) == 2000 and all(r.hinted == f"shop.{r.scope}.get()" for r in got)


def _walk(edges, root, depth):
    seen, front = {root: 0}, {root}
    for level in range(1, depth + 1):
        front = {t for s, t in edges if s in front} - set(seen)
        seen |= dict.fromkeys(front, level)
    return {k: v for k, v in seen.items() if v}


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    draw = random.Random(3)
    edges = sorted({(draw.randrange(300), draw.randrange(300)) for _ in range(900)})
    path = f"{tmp_path_factory.mktemp('adjacency')}/g"
    adjacency.write(spark.createDataFrame(edges, "source int, target int"), path, bucket_edges=200)
    return edges, path


def test_kept_edges_walk_as_edges_do(spark, kept):
    edges, path = kept
    both = adjacency.read(spark, path)
    assert sorted(map(tuple, both.out.collect())) == sorted(map(tuple, both.into.collect())) == edges
    down, up = _walk(edges, 7, 4), _walk([(t, s) for s, t in edges], 7, 4)
    assert {r.fqn: r.depth for r in graph.callees(both, 7, 4).collect()} == down
    assert {r.fqn: r.depth for r in graph.callers(both, 7, 4).collect()} == up
    nodes, inside = graph.call_hierarchy(both, 7, 2)
    plain_nodes, plain_inside = graph.call_hierarchy(spark.createDataFrame(edges, "source int, target int"), 7, 2)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, plain_nodes.collect()))
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, plain_inside.collect()))


@pytest.mark.parametrize("side", ["out", "into"])
def test_a_step_moves_no_edges(spark, kept, side):
    """Between the scan of the edges and the join there is no exchange, whatever the frontier's size; other sessions learn the buckets from the folder."""
    _, path = kept
    spark.sql(f"DROP TABLE {adjacency._table(path, side)}")
    edges = getattr(adjacency.read(spark, path), side)
    key = "source" if side == "out" else "target"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        step = edges.join(spark.range(50).selectExpr(f"cast(id AS int) AS {key}"), key)
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert step.count() == sum(1 for e in kept[0] if e[side == "into"] < 50)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_kept_edges_without_rows(spark, tmp_path):
    adjacency.write(spark.createDataFrame([], "source string, target string"), f"{tmp_path}/g")
    assert graph.callees(adjacency.read(spark, f"{tmp_path}/g"), "a", 3).collect() == []
