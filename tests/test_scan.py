"""A scan from files and a repository to the model's tables, and what is asked of it."""

import os
import subprocess

import pytest

from lithograph.functions import model
from lithograph.operators import graph, history, impact, search
from lithograph.plans import scan
from lithograph.sources import git
from lithograph.streaming.ingest import ingest

DESK = """package shop;
class Desk {
  int total;
  void add(int n) { this.total = n; note(n); }
  void note(int n) { log.write(total); }
}
"""
LOG = """package shop;
class Log {
  void write(int x) { }
  void write(int x, int y) { }
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    who = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x"}
    env = os.environ | who
    run = lambda *a, **e: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=env | e)
    run("init", "-q")
    (root / "Desk.java").write_text(DESK)
    run("add", ".")
    run("commit", "-qm", "First\n\nmore", GIT_AUTHOR_DATE="2020-01-01T00:00:00Z", GIT_COMMITTER_DATE="2020-01-01T00:00:00Z")
    (root / "Desk.java").write_text(DESK.replace("log.write(total)", "log.write(total, n)"))
    (root / "Log.java").write_text(LOG)
    (root / "Bad.java").write_text("class Bad { void f( { }")
    run("add", ".")
    run("commit", "-qm", "Second", GIT_AUTHOR_NAME="Bo", GIT_AUTHOR_DATE="2021-01-01T00:00:00Z", GIT_COMMITTER_DATE="2021-01-01T00:00:00Z")
    return str(root)


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("store"))
    with pytest.raises(ValueError):
        scan.load(spark, at, "types")
    assert scan.scan(spark, tree, at) == {"total": 3, "parsed": 2, "failed": 1}
    return at


def test_tables(spark, store):
    for name in model.SCAN_TABLES:
        assert scan.load(spark, store, name).schema.names == model.TABLES[name].names
    assert {r.fqn for r in scan.load(spark, store, "types").collect()} == {"shop.Desk", "shop.Log"}
    reports = scan.load(spark, store, "inconsistencies").collect()
    assert [(r.kind, r.reason) for r in reports] == [("DIVERGENT_SIGNATURE", "Method 'write' has divergent signature: param count (1 vs 2)")]


def test_calls_impact_and_search(spark, store):
    edges = scan.call_edges(spark, store)
    assert {(r.source, r.target) for r in edges.collect()} == {("shop.Desk.add(int)", "shop.Desk.note"), ("shop.Desk.note(int)", "shop.Log.write(int)")}
    assert [r.fqn for r in graph.callees(edges, "shop.Desk.note(int)", 4).collect()] == ["shop.Log.write(int)"]
    assert [r.fqn for r in graph.callers(scan.call_graph(spark, store), "shop.Log.write(int)", 4).collect()] == ["shop.Desk.note(int)"]
    found = impact.impact(scan.load(spark, store, "relationships"), "shop.Desk.total").collect()
    assert {(r.method_fqn, r.role) for r in found} == {("shop.Desk.add(int)", "writer"), ("shop.Desk.note(int)", "reader"), ("shop.Desk.note(int)", "propagator")}
    hits = search.search(scan.load(spark, store, "search"), "writ").collect()
    assert {h.fqn for h in hits} >= {"shop.Log.write(int)", "shop.Log.write(int,int)"}
    assert [tuple(h) for h in scan.find(spark, store, "writ").collect()] == [tuple(h) for h in hits]
    assert [r.fqn for r in scan.find_types(spark, store, "P.%ES_").collect()] == ["shop.Desk"] and [r.fqn for r in scan.find_types(spark, store, " ").collect()] == ["shop.Desk", "shop.Log"]
    assert [(r.kind, r.entity2_fqn) for r in scan.first_reports(spark, store).collect()] == [("DIVERGENT_SIGNATURE", "shop.Log.write(int,int)")]
    assert {r.table_name: r.n for r in scan.statistics(spark, store).collect()} == {"packages": 1, "types": 2, "fields": 1, "methods": 4, "relationships": 4, "inconsistencies": 1}


def test_history(spark, store, tree):
    meta = {r.entity_fqn: r for r in scan.load(spark, store, "git_meta").collect()}
    assert (meta["shop.Desk.add(int)"].last_author_name, meta["shop.Desk.add(int)"].last_commit_msg, meta["shop.Desk.add(int)"].commit_count) == ("Ann", "First", 2)
    assert meta["shop.Desk.note(int)"].last_author_name == "Bo" and meta["shop.Desk"].last_author_name == "Bo" and meta["shop.Log"].commit_count == 1
    assert history.top_authors(scan.load(spark, store, "git_meta")).first()["name"] == "Bo"
    none = spark.createDataFrame([("gone.java",), (None,)], "file string")
    assert git.blame_lines(none, tree).count() == 0 and git.file_commits(none, tree).count() == 0
    assert git.repository_root(tree) == tree and git.repository_root("/proc") is None


def test_stream(spark, tmp_path):
    """Files that come later join what is there; a file that comes again replaces its rows; no files, no snapshot."""
    src, at = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "Log.java").write_text(LOG)
    ingest(spark, str(src), at, f"{tmp_path}/cp").awaitTermination()
    assert {r.fqn for r in scan.load(spark, at, "methods").collect()} == {"shop.Log.write(int)", "shop.Log.write(int,int)"}
    (src / "Desk.java").write_text(DESK)
    (src / "sub").mkdir()
    (src / "sub" / "Bare.java").write_text("class Bare { }")
    ingest(spark, str(src), at, f"{tmp_path}/cp").awaitTermination()
    assert {r.fqn for r in scan.load(spark, at, "types").collect()} == {"shop.Desk", "shop.Log", "Bare"}
    before = spark.read.parquet(f"{at}/snapshots").count()
    ingest(spark, str(src), at, f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{at}/snapshots").count() == before


def test_a_changed_file_alone_is_parsed(spark, tmp_path, monkeypatch):
    """A refresh gives what a scan of all files gives, and parses what changed: names go, come and appear from behind a later file's."""
    from lithograph.sources import java

    first = {"/s/shop/Desk.java": DESK, "/s/shop/Log.java": LOG, "/s/shop/Z.java": "package shop; class Log { void write(long x) { } int totals; }", "/s/Bad.java": "class Bad { void f( { }"}
    change = {"/s/shop/Z.java": "package shop; class Zed { void writes(int x) { Log.write(x); } String total; }", "/s/Bad.java": "class Bad { }"}
    df = lambda files: spark.createDataFrame(list(files.items()), "path string, content string")
    one, all_ = f"{tmp_path}/one", f"{tmp_path}/all"
    assert scan.publish(spark, df(first), one) == {"total": 4, "parsed": 3, "failed": 1}
    parsed = []
    extract = java.extract
    monkeypatch.setattr(java, "extract", lambda files: (parsed.append(files.count()), extract(files))[1])
    gone = spark.createDataFrame([("/s/shop/Desk.java",)], "path string")
    assert scan.refresh(spark, df(change), one, removed=gone) == {"total": 3, "parsed": 3, "failed": 0}
    assert parsed == [2]
    left = {k: v for k, v in (first | change).items() if k != "/s/shop/Desk.java"}
    scan.publish(spark, df(left), all_)
    for name in ("packages", "types", "fields", "methods", "relationships", "inconsistencies", "search"):
        rows = [sorted(map(str, scan.load(spark, s, name).collect())) for s in (one, all_)]
        assert rows[0] == rows[1] and rows[0], name


def test_notes_clears_and_old_snapshots(spark, tmp_path):
    """Notes survive clears; snapshots that are not kept go, with the rows that only they count, while a kept one is being read."""
    from lithograph.plans import notes

    at = str(tmp_path)
    assert notes.load(spark, at).count() == 0 and not notes.delete(spark, at, "x")
    one = notes.write(spark, at, "shop.Desk", "look", 5)
    notes.write(spark, at, "shop.Log", "first", 6, "n")
    notes.write(spark, at, "shop.Log", "second", 6, "n")
    df = lambda *files: spark.createDataFrame(list(files), "path string, content string")
    scan.publish(spark, df(("/Log.java", LOG), ("/Desk.java", DESK)), at)
    scan.refresh(spark, df(("/Desk.java", "package shop; class Desk { }")), at)
    scan.clear(spark, at)
    assert scan.load(spark, at, "types").count() == 0
    scan.publish(spark, df(("/Log.java", LOG)), at)
    reader = scan.load(spark, at, "methods")
    scan.refresh(spark, df(("/Bare.java", "class Bare { int f() { return 1; } }")), at)
    kept_edges = lambda: sum(t.name.startswith("edges_") for t in spark.catalog.listTables())
    before = kept_edges()
    removed = scan.expire(spark, at)
    assert kept_edges() == before - 6
    assert len([r for r in removed if "/raw/" not in r]) == 3 and scan.expire(spark, at) == []
    assert reader.count() == 2 and scan.load(spark, at, "methods").count() == 3 and scan.load(spark, at, "inconsistencies").count() == 1
    assert {tuple(r) for r in notes.load(spark, at).collect()} == {(one, "shop.Desk", "look", 5, 5), ("n", "shop.Log", "second", 6, 6)}
    assert notes.delete(spark, at, one) and [r.id for r in notes.load(spark, at).collect()] == ["n"] and notes.load(spark, at, "shop.Desk").count() == 0
