import random
import re

import public_tokenizers
import pyarrow as pa

import corpus_pipeline as P
from lithograph.llm.packing import token_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the of and to in that was with be by on this are from have had which one".split()
DE = "der die und in den von zu das mit sich des auf für ist nicht ein eine als".split()


def _docs():
    draw = random.Random(8)
    word = lambda lang: draw.choice(lang) + draw.choice(["", "", draw.choice(lang)])
    passage = " ".join(word(EN) for _ in range(60))
    rows = []
    for i in range(60):
        lang = EN if i % 2 else DE
        text = " ".join(word(lang) for _ in range(draw.randrange(80, 200)))
        if i % 10 == 1:
            text += "\n" + passage
        if i % 7 == 0:
            text += " token = abcdef0123456789"
        rows.append((i, text, "en" if i % 2 else "de"))
    rows += [(100 + i, t + " end", lang) for i, t, lang in rows[:5]]  # near copies
    rows += [(200, None, "en"), (201, "", None), (202, "123 456 789", "de"), (203, rows[3][1], "en")]
    return [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t, lang in rows]


def _ngrams(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_against_plain_python(spark, tmp_path):
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", P.F.lit("x"))
    texts = {r[0]: r[1] for r in rows}

    kept = P.language(spark, docs, "")
    assert kept.columns == P.COLUMNS
    first = {r.doc_id: r.text for r in kept.collect()}
    assert set(first) == set(texts) - {200, 201, 202}  # clean documents stay, those without letters go
    assert all(texts[i] == t for i, t in first.items())

    second = {r.doc_id: r.text for r in P.near_duplicates(spark, kept, "").collect()}
    root = {}
    for i in sorted(first):
        near = [j for j in sorted(first) if j < i and len(_ngrams(first[i]) & _ngrams(first[j])) * 10 >= 8 * len(_ngrams(first[i]) | _ngrams(first[j]))]
        root[i] = min([root[j] for j in near], default=i)
    assert set(second) == {i for i in root if root[i] == i}

    frame = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in second.items()], docs.drop("extra").schema)
    seen, third = set(), {}
    for i in sorted(second):
        w = WORD.findall(second[i])
        off = [False] * len(w)
        for j in range(len(w) - 19):
            run = tuple(w[j : j + 20])
            if run in seen:
                off[j : j + 20] = [True] * 20
            seen.add(run)
        if not all(off):
            third[i] = [x for x, o in zip(w, off) if not o]
    got = {r.doc_id: (r.text, r.n_chars) for r in P.repeated_passages(spark, frame, "").collect()}
    assert {i: WORD.findall(t) for i, (t, _) in got.items()} == third
    assert all(n == len(t) for t, n in got.values())
    assert any(len(third[i]) < len(WORD.findall(second[i])) for i in third)

    frame = spark.createDataFrame([(i, t, None, None, n) for i, (t, n) in got.items()] + [(900, None, None, None, None)], docs.drop("extra").schema)
    masked = {r.doc_id: r.text for r in P.secrets(spark, frame, "").collect()}
    assert set(masked) == {*got, 900} and masked[900] is None
    assert all(re.sub(r"token = abcdef0123456789", "[assign]", t) == masked[i] for i, (t, _) in got.items())

    pieces = P.sequences(spark, frame, "").collect()
    length = {}
    for r in pieces:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert length == {i: len(token_ids(t, ranks)) + 1 for i, t in [*((i, t) for i, (t, _) in got.items()), (900, None)]}


def test_run(spark, tmp_path):
    rows = _docs()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns
    assert [len(P.STAGES)] == [5]


def test_stages_send_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('word ', 1000) text", "'en' lang", "'a' source", "5000L n_chars")
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        P.secrets(spark, docs, "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < P.BATCH_BYTES + 100_000
        spark.conf.set(limit, "3000000")
        P.secrets(spark, docs, "")
        assert spark.conf.get(limit) == "3000000"
    finally:
        spark.conf.unset(limit)
