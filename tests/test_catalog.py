"""Files of packages against a plain reading of paths."""

import random

from lithograph.operators import catalog


def _plain(declared, files):
    return {
        fqn: max(declared.count(fqn) - 1, 0 if fqn is None else sum(fqn.replace(".", "/") + "/" in (f or "").replace("\\", "/") for f in files)) for fqn in set(declared)
    }


def _counts(spark, declared, files):
    got = catalog.package_file_counts(spark.createDataFrame([(d,) for d in declared], "fqn string"), spark.createDataFrame([(f,) for f in files], "path string"))
    return {r.fqn: r.file_count for r in got.collect()}


def test_files_of_packages_by_hand(spark):
    files = ["src/com/shop/A.java", "src/com/shop/web/B.java", "old.com/shop/C.java", "C:\\w\\com\\shop\\D.java", "x/com/shop/y/com/shop/E.java", "F.java", "/com/G.java", "a//b/H.java", "src/com/shop", None]
    declared = ["com.shop", "com", "com.shop.web", "shop", "a..b", "", None, "none.here", "none.here", "none.here", "p", "shop.y.com", "com.shop.", ".com"]
    got = _counts(spark, declared, files)
    assert got == _plain(declared, files)
    assert got["com.shop"] == 5 and got["none.here"] == 2 and got[None] == 0


def test_files_of_packages_at_random(spark):
    draw = random.Random(5)
    name = lambda: draw.choice(["a", "b", "aa", "ab", "ba", "", "a b"])
    files = ["/".join(name() for _ in range(draw.randrange(1, 7))) for _ in range(300)]
    declared = [".".join(name() for _ in range(draw.randrange(1, 5))) for _ in range(150)]
    assert _counts(spark, declared, files) == _plain(declared, files)


def test_files_of_packages_without_rows(spark):
    assert _counts(spark, [], ["a/b.java"]) == {} and _counts(spark, ["a", "a"], []) == {"a": 1}
