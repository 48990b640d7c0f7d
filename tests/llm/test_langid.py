import os
import random

import pytest

from lithograph.llm.langid import Sizer, classify, fit, held_out, op4_language

WORDS = {"en": "the of and to in that was with be by on this are from".split(), "de": "der die und in den von zu das mit sich des auf für ist".split()}


def _text(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


def test_table(spark):
    rows = [(i, _text(("en", "de")[i % 2], 5 + i, i), ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 --", "de"), (103, _text("de", 40_000, 1), None), (5, rows[5][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as k", "2 as score")
    got = {r.doc_id: r for r in classify(docs, fit(docs.where(~held_out()))).collect()}
    assert len(got) == 64 and classify(docs, fit(docs)).count() == 65
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(60))
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[103].lang_pred == "de"
    assert all(got[i].rejected and got[i].score == 0 for i in (100, 101, 102))
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert fit(empty) == {} and classify(empty, {}).count() == 0
    assert {r.lang_pred for r in classify(docs, {}).collect()} == {"und"}


def test_too_many_languages(spark):
    docs = spark.createDataFrame([(i, "a", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        fit(docs, most_languages=8)


def test_whole_texts_count():
    sizer = Sizer({k: _text(k, 400, 3).encode() for k in WORDS}, 256)
    text = _text("en", 30, 1) + " " + _text("de", 400, 2)
    assert sizer.best(text)[0] == "de"


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = op4_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
