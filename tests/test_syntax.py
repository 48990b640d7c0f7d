"""Which files count as parsed."""

import random

import pytest

from lithograph.sources import java, syntax

GOOD = [
    "",
    "package a.b;\nimport java.util.*;\nimport static a.B.c;\npublic final class A<T extends B & C> extends D<T[]> implements E, F<? super T> { }",
    "@interface M { int value() default 3; String[] names() default {}; Class<?>[] of() default { A.class, int[].class }; }",
    "@M({1, 2}) @a.b.N(x = {@O, @P(q = \"s\")}) class A { @X int @Y [] a = new int @Z [] {1, 2,}; int[][] b = {{1}, {2, 3}, {}}; }",
    "enum E { A, B(1) { int f() { return 1; } }, C, ; E(int... x) { } } enum F { A, B } enum G { A(1) } enum H { } enum I { A, }",
    "record R(int a, String b) implements S { R { if (a < 0) throw new X(); } static int z = -1; }",
    "sealed interface S permits A, B { } non-sealed class A implements S { } final class B implements S { }",
    "class A { void f() { for (;;) { break; } for (int i = 0, j = -1; i < j; i++, --j) ; for (final var x : xs) { } do { i++; } while (i < 3); } }",
    "class A { int f(int x) { return switch (x) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new B(); }; } }",
    "class A { void f() { switch (x) { case 1: case 2: g(); break; default: } lab: while (true) { continue lab; } } }",
    "class A { Runnable r = () -> { }; F<A, B> f = (a, b) -> a + b; F g = A::new, h = int[]::new, i = this::<T>f; Object o = (Runnable & X) () -> 5; }",
    "class A { boolean b = x instanceof String s && !s.isEmpty() || y instanceof final B c; int c = a ? b ? 1 : 2 : -~3; long d = 1L >>> 2 << 3; }",
    "class A { String s = \"a\\\"b\" + 'c' + '\\'' + \"\"\"\n text \" } ( \n\"\"\".length(); char c = '{'; int i = \"x\".length(), j = 0x1F, k = 1_000; double d = .5e-3, e = 1.5f; }",
    "class A { static { g(); } { h(); } A() { super(1); this.x = 2; } <T> A(T t) throws X, Y { this(); } abstract void n(); ; }",
    "class A { void f() throws E { try (var r = a(); B b = c()) { } catch (X | Y e) { } finally { } synchronized (this) { } if (a) b(); else if (c) { } else d(); assert x > 0 : \"m\"; return; } }",
    "class A { Object o = new B() {{ put(1, 2); }}; int x = new int[]{1, 2}[0]; List<List<A>> l = new ArrayList<>(); int v = ((int) 5) + (a) - (b); A a = b.new C(), d = (String) \"x\"; boolean z = Foo.class == o.getClass(); }",
    "class A { int record = 1, var = 2, when; void to(int with) { record += with; yield(); } int[] f()[] { return null; } void g(A this, final int... x) { } }",
    "module m { requires transitive a.b; exports c.d to e, f; opens g; uses h.I; provides j.K with l.M; }",
    "class A { void f() { int a = b < c ? d : e; if (a < b && c > d) { } x = y = z; a[i]++; b[j] += -1; f(a -> b, (c) -> { }); g(c ? d : e); h(x, y).i().j[0] = null; } }",
    "class A { void f() { if (o instanceof P(int x, Q(var y)) && x > 1) { } String s = switch (o) { case P(int x, var y) when x > 0 -> \"a\"; case null, default -> \"b\"; }; } }",
    "class A { /* { */ // (\n int x; /** ' */ }",
]
BAD = [
    "class A extends 5 { int x; }", "class A { int x = ; }", "class A { int x = 5 }", "class A { void f() { g() } }", "class A { void f( { } }", "class A { int x = (1; }", "class A { int[] a = {1, 2; }", "class { }", "class A implements { }",
    "class A { void f() { if x { } } }", "class A { void f() { else { } } }", "class A { String s = \"a; }", "class A { int x = 1 + ; }", "class A { int x = * 2; }", "class A { int x y; }", "class A { void f() { return 1 2; } }", "class A { f(a,); }",
    "class A { int a[] = new ; }", "import ; class A { }", "class A { void f() { x.; } }", "class A ] [ { }", "class A { } }", "class A { ", "class A { int # x; }", "class A { void f() { try } }", "class A { int goto = 1; }", "class A { int x = a && ; }",
    "class A { void f() { for int i; } }", "class A { void f() { g(1 x); } }", "class A { void f() { throw ; } }", "class A { @ int x; }", "class A { Foo bar baz; }", "class A { int = 3; }", "class A { char c = '; }", "class A { void f() { i++ } }", "class A { int x = 5 int y; }",
]


def _status(spark, sources):
    files = spark.createDataFrame([(f"/{i}.java", s) for i, s in enumerate(sources)], "path string, content string")
    return {int(r.path[1:-5]): r.ok for r in syntax.parsed(files, java.tokens(files)).collect()}


def test_valid_files_pass(spark):
    got = _status(spark, GOOD)
    assert [GOOD[i] for i, ok in got.items() if not ok] == [] and len(got) == len(GOOD)


def test_invalid_files_fail(spark):
    got = _status(spark, BAD)
    assert [BAD[i] for i, ok in got.items() if ok] == [] and len(got) == len(BAD)


def test_findings_have_lines(spark):
    files = spark.createDataFrame([("/a", "class A {\n\n int x = ;\n}")], "path string, content string")
    (r,) = syntax.errors(java.tokens(files)).collect()
    assert (r.path, r.line, r.reason) == ("/a", 3, "can't follow what stands before it")


def test_deep_nesting(spark):
    deep = "{" * 100_000 + "}" * 100_000
    files = [("/ok", f"class A {{ void f() {deep} int g = {'(' * 50_000}1{')' * 50_000}; }}"), ("/bad", f"class A {{ void f() {deep[1:]} }}")]
    df = spark.createDataFrame(files, "path string, content string")
    assert {r.path: r.ok for r in syntax.parsed(df, java.tokens(df)).collect()} == {"/ok": True, "/bad": False}


@pytest.mark.parametrize("seed", [1])
def test_garbage_never_ends_a_scan(spark, seed):
    """Files of random tokens, and broken copies of good ones, are counted and skipped; the good one beside them is read."""
    draw = random.Random(seed)
    words = "class interface enum extends implements permits A b 5 \"s\" { } ( ) [ ] < > , ; = . @ -> new int void static if ? : & | x".split()
    junk = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))) for _ in range(40)]
    for s in GOOD[1:]:
        cut = draw.randrange(len(s))
        junk.append(s[:cut] + s[cut + draw.randrange(1, 9) :])
    junk += ["class A extends 5 { int x; }", "class A extends < { }", "class A implements , { }", "interface", "enum {", "class A extends"]
    files = [(f"/j/{i}.java", s) for i, s in enumerate(junk)] + [("/src/Good.java", "class Good { int x; int f() { return x; } }")]
    found = java.extract(spark.createDataFrame(files, "path string, content string"))
    assert found["files"].count() == len(files)
    assert "Good" in {r.fqn for r in found["types"].collect()} and "Good.f()" in {r.fqn for r in found["methods"].collect()}
    assert found["fields"].where("fqn = 'Good.x'").count() == 1 and found["relationships"].where("from_entity_fqn = 'Good.f()'").count() == 1
