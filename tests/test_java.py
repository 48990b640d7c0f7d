"""Extraction from original small sources."""

import pytest

from lithograph.sources.java import extract, member_rows, read_sources, type_header

SHOP = '''
package org.shop.core;

import java.util.*;

/* a class { with braces in a comment */
@Deprecated
public final class Till extends Desk<Coin> implements Closeable, java.util.Queue<String> {
    private int early() { return late + count; } // late is not known here, nor is count
    private int count = 0, spare[];
    static final String NOTE = "a } \\" brace";
    private Map<String, List<Integer>> index = new HashMap<>();
    protected int[] sizes = {1, 2, 3};
    public int late;

    public Till(int count, String... names) {
        this.count = count;
        index.put(NOTE, null);
        super.open();
    }

    public <T> Map<String, T> fill(final Map<String, T> rows, int[] marks) throws Exception {
        for (int i = 0; i < marks.length; i++) {
            if (marks[i] > late && count > 0 || i == 3) { late += marks[i]; }
        }
        do { count++; } while (count < 3);
        switch (late) { case 1: case 2: break; default: step(); }
        helper.desk().close(early());
        new Till(1).early();
        Runnable r = () -> { late = 2; };
        return late > 1 ? rows : this.fill(rows, marks);
    }

    abstract void none();

    static class Inner { int own; int twice() { return own + own; } }

    enum Kind implements Runnable { A, B(1) { int f() { return 1; } }, C; Kind() {} int n = 2; }
}

interface Shape extends Round, Flat { double area(); }
'''


@pytest.fixture(scope="module")
def model(spark):
    files = [("/src/org/shop/core/Till.java", SHOP), ("/src/org/shop/core/Broken.java", "package org.shop.core; class Broken { void f( { }"), ("/src/Bare.java", "class Bare { int f() { return 1; } }"), ("/src/Empty.java", ""), ("/src/Null.java", None)]
    return {k: v.cache() for k, v in extract(spark.createDataFrame(files, "path string, content string")).items()}


def test_files_and_packages(model):
    assert {r.path.rsplit("/", 1)[1]: r.ok for r in model["files"].collect()} == {"Till.java": True, "Broken.java": False, "Bare.java": True, "Empty.java": True, "Null.java": True}
    (p,) = model["packages"].collect()
    assert (p.fqn, p.name, p.parent_fqn, p.type_count, p.file_count) == ("org.shop.core", "core", "org.shop", 4, 2)


def test_types(model):
    got = {r.fqn: r for r in model["types"].collect()}
    assert set(got) == {"org.shop.core.Till", "org.shop.core.Inner", "org.shop.core.Kind", "org.shop.core.Shape", "Bare"}
    till = got["org.shop.core.Till"]
    assert (till.kind, till.modifiers, till.super_class, till.interfaces) == ("CLASS", "public final", "Desk", ["Closeable", "Queue"])
    assert (till.start_line, till.end_line, till.line_count) == (7, 39, 33)
    assert (got["org.shop.core.Kind"].kind, got["org.shop.core.Kind"].interfaces) == ("ENUM", [])
    assert (got["org.shop.core.Shape"].kind, got["org.shop.core.Shape"].super_class) == ("INTERFACE", "Round")


def test_fields(model):
    got = {r.fqn.removeprefix("org.shop.core."): (r.field_type, r.modifiers, r.initializer) for r in model["fields"].collect()}
    assert got["Till.count"] == ("int", "private", "0") and got["Till.spare"] == ("int", "private", None)
    assert got["Till.NOTE"] == ("String", "static final", '"a } \\" brace"')
    assert got["Till.index"][:2] == ("Map<String, List<Integer>>", "private")
    assert got["Till.sizes"][:2] == ("int", "protected") and got["Till.late"] == ("int", "public", None)
    assert {"Inner.own", "Kind.n"} < set(got) and len(got) == 8


def test_methods(model):
    got = {r.fqn.removeprefix("org.shop.core."): r for r in model["methods"].collect()}
    assert set(got) == {"Till.early()", "Till.<init>(int,String)", "Till.fill(Map<String, T>,int[])", "Till.none()", "Inner.twice()", "Kind.<init>()", "Shape.area()", "Bare.f()"}
    fill = got["Till.fill(Map<String, T>,int[])"]
    assert (fill.return_type, fill.cyclomatic_complexity, fill.modifiers) == ("Map<String, T>", 1 + 1 + 3 + 1 + 3 + 1, "public")
    assert [tuple(p) for p in fill.parameters] == [("Map<String, T>", "rows"), ("int[]", "marks")]
    assert got["Till.<init>(int,String)"].return_type == "void"
    assert got["Till.none()"].body_hash is None and len(fill.body_hash) == 16


def test_relationships(model):
    rows = model["relationships"].collect()
    of = lambda kind, method: sorted(r.to_entity_fqn.replace("org.shop.core.", "") for r in rows if r.kind == kind and r.from_entity_fqn == f"org.shop.core.Till.{method}")
    fill = "fill(Map<String, T>,int[])"
    assert of("CALLS", fill) == sorted(["Till.step", "~helper.desk().close", "~helper.desk", "Till.early", "~new Till(1).early", "Till.fill"])
    assert of("CALLS", "<init>(int,String)") == sorted(["~index.put", "Till.open"])
    assert of("WRITES_FIELD", "<init>(int,String)") == ["Till.count"]
    assert of("READS_FIELD", "<init>(int,String)") == sorted(["Till.NOTE", "Till.count", "Till.index"])  # the parameter counts as the field
    assert of("WRITES_FIELD", fill) == ["Till.late", "Till.late"]
    assert of("READS_FIELD", fill) == sorted(["Till.late"] * 5 + ["Till.count"] * 3)
    assert of("READS_FIELD", "early()") == []
    kinds = {(r.from_entity_fqn.rsplit(".", 1)[1], r.kind, r.to_entity_fqn) for r in rows if r.kind in ("EXTENDS", "IMPLEMENTS")}
    assert kinds == {("Till", "EXTENDS", "Desk"), ("Till", "IMPLEMENTS", "Closeable"), ("Till", "IMPLEMENTS", "Queue"), ("Shape", "EXTENDS", "Round")}
    assert len({r.id for r in rows}) == len(rows)


def test_headers_and_reading(spark, tmp_path):
    assert type_header("record R ( int a )".split()) is None and type_header("@ interface Mark".split()) is None
    assert list(member_rows(["A", ",", "B", ";"], [1] * 4, "E", "p.E")) == []
    with pytest.raises(ValueError):
        read_sources(spark, f"{tmp_path}/none")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_text("class X {}")
    (tmp_path / "a" / "x.txt").write_text("no")
    assert [r.path for r in read_sources(spark, str(tmp_path)).collect()] == [f"{tmp_path}/a/X.java"]


def test_a_literal_of_many_escapes(spark):
    from lithograph.sources.java import tokens

    long = "\\n" * 100_000
    rows = [("/A.java", f'class A {{ String s = "{long}"; char c = \'\\u0041\'; /* {"* " * 50_000} */ }}')]
    found = [r.tok for r in tokens(spark.createDataFrame(rows, "path string, content string")).collect()]
    assert f'"{long}"' in found and "'\\u0041'" in found and found[-1] == "}"


def test_many_fields_in_a_type(spark):
    """A method finds its fields among 20,000 before it by a join, and none behind it."""
    n = 20_000
    text = "class Wide {\n" + "".join(f"int f{i};\n" for i in range(n)) + f"void g() {{ f0 = f{n - 1}; late = f1; }}\nint late;\n}}"
    found = extract(spark.createDataFrame([("/Wide.java", text)], "path string, content string"))
    assert sorted((r.kind, r.to_entity_fqn) for r in found["relationships"].collect()) == [("READS_FIELD", "Wide.f0"), ("READS_FIELD", "Wide.f1"), ("READS_FIELD", f"Wide.f{n - 1}"), ("WRITES_FIELD", "Wide.f0")]
    assert found["fields"].count() == n + 1
