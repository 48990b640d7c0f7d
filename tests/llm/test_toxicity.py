import os
import random

import pytest

from lithograph.llm.toxicity import INSULT, NEGATION, OTHER, REACH, REPORT, TARGET, THREAT, Scorer, clause_score, fit, held_out, op1_toxicity, score


def test_grammar():
    plain = clause_score([(INSULT, 8.0)])
    assert plain == 8
    assert clause_score([(TARGET, 0), (OTHER, 0), (INSULT, 8.0)]) > plain
    assert clause_score([(NEGATION, 0), (OTHER, 0), (INSULT, 8.0)]) < plain
    assert clause_score([(NEGATION, 0)] + [(OTHER, 0)] * 5 + [(INSULT, 8.0)]) == plain
    assert clause_score([(REPORT, 0), (OTHER, 0), (INSULT, 8.0)]) < plain
    assert clause_score([(THREAT, 2.0)]) < 1 < clause_score([(TARGET, 0), (THREAT, 2.0)])
    assert plain < clause_score([(INSULT, 8.0)] * 2) < 2 * plain


def test_scorer_reads_whole_texts():
    s = Scorer({"=moron": 8.0, "zlop": 7.0})
    assert s.score("word " * 50_000 + "moron") > 0.9 and s.score("Zlopping about") > 0.9
    assert s.score("oxymoronic xzlop") < 0.1
    assert s.score(None) == s.score("") < 0.1


def test_table(spark):
    docs = spark.createDataFrame([(i, f"some words {i} here and" + (" zlopper." if i % 4 == 0 else "")) for i in range(200)] + [(300, None), (301, ""), (8, "again zlop")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as k", "9 as score")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (300, None)], "doc_id long, toxic int")
    weights = fit(docs, labels)
    assert set(weights) == {"=zlopper", "zlop", "zlopp", "zloppe"}
    got = score(docs, weights).collect()
    assert len(got) == 203 and {r.doc_id for r in got if r.predicted} == set(range(0, 200, 4))
    assert fit(docs.limit(0), labels) == {} and score(docs.limit(0), {}).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op1_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.8 and hit / sum(r.predicted for r in rows) > 0.8  # the tables label some 2 % of rows at random


def test_a_target_after_the_verb():
    before, after = [(TARGET, 0), (THREAT, 2.0)], [(THREAT, 2.0), (TARGET, 0)]
    assert clause_score(after) == pytest.approx(clause_score(before))
    assert clause_score([(INSULT, 8.0), (OTHER, 0), (TARGET, 0)]) == pytest.approx(clause_score([(TARGET, 0), (INSULT, 8.0)]))
    assert clause_score([(THREAT, 2.0)] + [(OTHER, 0)] * 6 + [(TARGET, 0)]) < 1
    assert clause_score([(TARGET, 0), (THREAT, 2.0), (TARGET, 0)]) == pytest.approx(clause_score(before))
    assert clause_score([(NEGATION, 0)] + after) == pytest.approx(0.45 * clause_score(after))
    s = Scorer({})
    verbs_first = ("i will kill you", "wir werden töten dich", "je vais tuer ton frère", "voy a matar a ustedes")
    assert all(s.raw(t) == pytest.approx(3.2) and s.score(t) > 0.3 for t in verbs_first)


def test_same_rows_same_weights(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=10)) for _ in range(900)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(6)) + (" grobwort" if i % 3 == 0 else "")) for i in range(300)] + [(7, "another text of one key"), (None, "no key")]
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    found = []
    for parts in (1, 5, 7):
        draw.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append(fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(parts)))
    assert found[0] and found[0] == found[1] == found[2]


def test_composed_machine_against_the_transducers_run_apart():
    """The score of a clause worked out rule by rule, from each word's neighbours, without any state."""

    def plain(clause):
        total, insults = 0.0, 0
        for i, (c, w) in enumerate(clause):
            classes = [x for x, _ in clause]
            near = TARGET in classes[max(0, i - REACH) : i] or TARGET in classes[i + 1 : i + REACH + 1]
            if c == INSULT:
                w = w / (1 + min(3, insults)) * (1.4 if near else 1.0)
                insults += 1
            elif c == THREAT:
                w *= 1.6 if near else 0.1
            else:
                continue
            total += w * (0.45 if NEGATION in classes[max(0, i - 3) : i] else 1) * (0.6 if REPORT in classes[max(0, i - 12) : i] else 1)
        return total

    draw = random.Random(9)
    for _ in range(3000):
        clause = [(c, draw.choice([2.0, 5.0]) if c in (INSULT, THREAT) else 0.0) for c in (draw.choice([OTHER, OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]) for _ in range(draw.randrange(1, 25)))]
        assert clause_score(clause) == pytest.approx(plain(clause))


def test_many_clauses_take_linear_time():
    import time

    scorer = Scorer({"=idiot": 3.0})
    began = time.process_time()
    assert scorer.raw("idiot. " * 100_000) > 1000 and scorer.raw("idiot\n" + "word " * 300_000) > 0
    assert time.process_time() - began < 20
