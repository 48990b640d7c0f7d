"""Reports as groups, and names that are alike, against plain loops over all pairs."""

import random

import pytest

from lithograph.operators import inconsistency, reports

METHODS = "fqn string, simple_name string, declaring_type_fqn string, return_type string, parameter_count int, body_hash string, ord int"
FIELDS = "fqn string, simple_name string, field_type string, ord int"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    d = edits(a, b)
    s = 1 - d / max(len(a), len(b), 1)
    return (d, s) if d <= 2 and s >= 0.75 else None


def pairs(methods, fields):
    """(score, kind, fqn1, fqn2, reason) of every pair."""
    out = []
    for i, a in enumerate(methods):
        for b in methods[i + 1 :]:
            if a[1] is not None and a[1] == b[1] and (a[3], a[4]) != (b[3], b[4]):
                text = f"return type ({a[3] or 'null'} vs {b[3] or 'null'}) " if a[3] != b[3] else ""
                text += f"param count ({a[4]} vs {b[4]})" if a[4] != b[4] else ""
                out.append((1.0, "DIVERGENT_SIGNATURE", a[0], b[0], f"Method '{a[1]}' has divergent signature: {text}".rstrip()))
            if a[1] is not None and b[1] is not None and a[1] != b[1] and a[5] != b[5] and (s := alike(a[1], b[1])):
                out.append((s[1], "SIMILAR_NAME", a[0], b[0], f"Names differ by {s[0]} edit(s); bodies diverge"))
            if a[5] is not None and a[2] is not None and (a[2], a[5]) == (b[2], b[5]) and a[1] != b[1] and None not in (a[1], b[1]):
                out.append((0.95, "SIMILAR_BODY", a[0], b[0], inconsistency.SAME_BODY))
    for i, a in enumerate(fields):
        for b in fields[i + 1 :]:
            if None not in (a[1], b[1]) and a[2] != b[2] and (s := alike(a[1], b[1])):
                out.append((s[1], "SIMILAR_NAME", a[0], b[0], f"Field names similar (dist={s[0]}) but types differ: {a[2] or 'null'} vs {b[2] or 'null'}"))
    return sorted(out, key=lambda r: (-r[0], *r[1:]))


def model(seed, n):
    draw = random.Random(seed)
    names = ["get", "set", "value", "values", "valve", "total", "totals", "totalSum", "totalSums", "totolSun", "getAccount", "getAccounts", "getAcount", None]
    methods = [(f"t{draw.randrange(9)}.m{draw.randrange(n)}", draw.choice(names), f"t{draw.randrange(3)}", draw.choice(["int", "void", None]), draw.randrange(2), draw.choice(["h1", "h2", "h3", None]), i) for i in range(n)]
    fields = [(f"t.f{draw.randrange(n)}", draw.choice(names), draw.choice(["int", "long", None]), i) for i in range(n)]
    return methods, fields


def test_groups_stand_for_all_pairs(spark, tmp_path):
    methods, fields = model(1, 45)
    want = pairs(methods, fields)
    rows = reports.members(spark.createDataFrame(methods, METHODS), spark.createDataFrame(fields, FIELDS))
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    reports.groups(rows).coalesce(1).write.parquet(f"{tmp_path}/groups")
    found = spark.read.parquet(f"{tmp_path}/groups")
    shape = lambda df: [(r.similarity_score, r.kind, r.entity1_fqn, r.entity2_fqn, r.reason) for r in df.collect()]
    assert sorted(shape(reports.expand(found, rows))) == sorted(want) and len(want) > 100
    assert {r.kind: r.pairs for r in reports.count(found).collect()} == {k: sum(w[1] == k for w in want) for k in {w[1] for w in want}}
    assert set(shape(found)) <= set(want)
    for limit in (7, 250):
        assert shape(reports.first(found, rows, limit)) == want[:limit]
    assert shape(reports.first(found, rows, 25, "SIMILAR_NAME")) == [w for w in want if w[1] == "SIMILAR_NAME"][:25]


def test_no_entities(spark):
    rows = reports.members(spark.createDataFrame([], METHODS), spark.createDataFrame([], FIELDS))
    found = reports.groups(rows)
    assert found.count() == 0 and reports.first(found, rows).count() == 0


@pytest.mark.parametrize("most", [10_000, 3])
def test_similar_names_against_all_pairs(spark, most):
    draw = random.Random(4)
    names = {"".join(draw.choice("ab") for _ in range(draw.randrange(0, 11))) for _ in range(160)} | {"", "é", "éa", "aéaé", "aaé", "getName", "getNames", "setName", "ma", "max"}
    for base in ["computeTotalAmount", "x" * 300, "readUntilEnd"]:
        for _ in range(12):
            s = list(base)
            for _ in range(draw.randrange(0, 4)):
                i = draw.randrange(len(s))
                s[i : i + draw.randrange(0, 2)] = draw.choice(["", "q", "z"])
            names.add("".join(s))
    rows = [(n,) for n in names] + [(None,), ("getName",)]
    got = {(r.name1, r.name2): (r.distance, r.similarity) for r in inconsistency.similar_names(spark.createDataFrame(rows, "simple_name string"), most_probes=most).collect()}
    want = {(a, b): s for a in names for b in names if a < b and (s := alike(a, b))}
    assert got == want and len(want) > 300


def test_keys_do_not_grow_with_a_name(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a" * 1000,), ("ab" * 10,)], "name string")
    keys = df.select(F.size(F.concat(inconsistency._probes(F.col("name"), 2), inconsistency._probes(F.col("name"), 1))).alias("n"))
    assert all(r.n <= 30 for r in keys.collect())
