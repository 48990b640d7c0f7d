"""Ranked search: against plain scoring, and what it sends."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lithograph.operators import index, search


@pytest.mark.parametrize("most", [200_000, 1])
def test_scores_are_added_up_where_the_document_is(spark, monkeypatch, capsys, most):
    monkeypatch.setattr(search, "MOST_SENT", most)
    draw = random.Random(6)
    texts = {i: " ".join(draw.choice(["the", "of", "a.b", "_x", *(f"W{j}" for j in range(30))]) for _ in range(draw.choice([1, 5, 60]))) for i in range(80)} | {80: "", 81: None, 82: ". .. -"}
    asked = {1: "the a.b", 2: "w3 w3 of", 3: "nowhere", 4: "", 5: None}
    docs, queries = spark.createDataFrame(list(texts.items()), "doc_id int, text string"), spark.createDataFrame(list(asked.items()), "query_id int, text string")
    words = {i: Counter((t or "").lower().replace("-", " ").replace(". .. ", " ").split()) for i, t in texts.items()}
    sizes = {i: sum(c.values()) for i, c in words.items()}
    mean = sum(n for i, n in sizes.items() if texts[i] is not None) / (len(texts) - 1)
    df = Counter(t for c in words.values() for t in c)
    want = {}
    for q, text in asked.items():
        for i, c in words.items():
            met = [t for t in set((text or "").split()) if t in c]
            if met:
                want[q, i] = sum(math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sizes[i] / mean)) for t in met)
    found = search.bm25(docs, queries)
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    if most > 1:
        found.explain()
        assert "Exchange hashpartitioning(query_id" not in capsys.readouterr().out


def test_an_index_of_many_tasks(spark, monkeypatch, tmp_path, capsys):
    """The same hits from an index that many tasks write; a shard's scores are added up where its lists are, and no word is kept by itself."""
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice(["the", "of", *(f"w{j}" for j in range(40))]) for _ in range(draw.choice([2, 30, 90])))) for i in range(200)] + [(200, None), (201, "")]
    docs, queries = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(1, "the w3"), (2, "w5 of w9")], "query_id int, text string")
    monkeypatch.setattr(index, "_WORDS", 500, raising=False)
    monkeypatch.setattr(index, "_WRITTEN", 2_000, raising=False)
    index.write_texts(docs, str(tmp_path), shard_docs=50, parts=2)
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    assert blocks.select(F.input_file_name()).distinct().count() > 2 and blocks.groupBy("token", "shard").count().where("count > 1").count() == 0
    want = sorted((r.query_id, r.doc_id, round(r.score, 6)) for r in search.bm25(docs, queries).collect())
    got = index.search_texts(spark, str(tmp_path), queries, 1_000, digits=6)
    assert sorted((r.query_id, r.doc_id, r.score) for r in got.collect()) == want and want
    capsys.readouterr()
    shards = index.text_bounds(spark, str(tmp_path), queries).select("query_id", "shard")
    index._text_scores(spark, str(tmp_path), queries, shards, 1.2, 0.75).explain()
    assert not [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in line and "query_id" in line and "doc_id" in line]
