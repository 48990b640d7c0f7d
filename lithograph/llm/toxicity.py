"""Operator 1, toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause's words as classes: insult, threat, target, negation and reported speech.  Each passes
the classes on and scales the weight of an insult or threat by the state it is in; their composition is one
machine over the product of the states.  A clause's score is the sum of the scaled weights along its path, so a
word counts for what its clause makes of it.  The weights of insults and threats are learned from labelled rows;
the grammar's own word lists are fixed.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import small_batches, table

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: The grammar's closed classes, in English, German, French and Spanish.
CLOSED = {
    TARGET: "you your yours yourself u ur they them their he she him her his du dich dir dein deine ihr euch euer sie tu te toi ton ta vous votre vos tú ti usted ustedes tus".split(),
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't nobody none nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split(),
    REPORT: "said says say called calls wrote writes quoted quote claimed reported alleged sagte sagt schrieb zitierte nannte dit disait écrit cité dijo dice escribió citó".split(),
    THREAT: "kill murder hurt destroy beat burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split(),
}
#: What a threat weighs that no label speaks of: it takes a target near it to count.
THREAT_WEIGHT = 2.0


@dataclass(frozen=True)
class Transducer:
    """From start, step(state, class) gives the next state and the factor for that class's weight."""

    start: int
    states: int
    step: object


def _scope(opens: int, length: int, scaled: tuple[int, ...], factor: float, before: float = 1.0) -> Transducer:
    """For `length` words after a word of class opens, words of the scaled classes have the factor; else `before`."""

    def step(state: int, c: int) -> tuple[int, float]:
        scale = (factor if state else before) if c in scaled else 1.0
        return (length if c == opens else max(0, state - 1)), scale

    return Transducer(0, length + 1, step)


def _repeats() -> Transducer:
    """The second and later insults of a clause add less each: they are one outburst."""

    def step(state: int, c: int) -> tuple[int, float]:
        return (min(3, state + 1), 1 / (1 + state)) if c == INSULT else (state, 1.0)

    return Transducer(0, 4, step)


#: How many words a target and what is aimed at it may be apart, and the factors of a threat and an insult without and with one.
REACH = 6
AIMED = {THREAT: (0.1, 1.6), INSULT: (1.0, 1.4)}
#: The grammar: what each transducer does to a weight.
GRAMMAR = (
    _repeats(),  # insult
    _scope(TARGET, REACH, (THREAT,), AIMED[THREAT][1], before=AIMED[THREAT][0]),  # threat: mostly with someone to aim it at
    _scope(TARGET, REACH, (INSULT,), AIMED[INSULT][1]),  # target
    _scope(NEGATION, 3, (INSULT, THREAT), 0.45),  # negation
    _scope(REPORT, 12, (INSULT, THREAT), 0.6),  # reported speech
)


@lru_cache(1)
def composed() -> tuple[list[list[tuple[int, float]]], int]:
    """(table[state][class] = (next state, factor), start): the transducers run side by side, factors multiplied; reachable states only."""
    start = tuple(t.start for t in GRAMMAR)
    number, todo, rows = {start: 0}, [start], {}
    while todo:
        at = todo.pop()
        row = []
        for c in range(6):
            moves = [t.step(s, c) for t, s in zip(GRAMMAR, at)]
            to = tuple(m[0] for m in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append((number[to], math.prod(m[1] for m in moves)))
        rows[number[at]] = row
    return [rows[i] for i in range(len(rows))], 0


def clause_score(classes: list[tuple[int, float]]) -> float:
    """The sum of the weights along the composed machine's path over (class, weight) of a clause's words.

    A threat or insult without a target in the words before it is held, with what its other states make of it; a target
    within the next `REACH` words gives it the target's factor.
    """
    machine, state = composed()
    total = 0.0
    held: list[tuple[int, float]] = []  # (last place for a target, what the target adds)
    since = REACH  # words since the last target
    for i, (c, w) in enumerate(classes):
        state, factor = machine[state][c]
        total += w * factor
        if c == TARGET:
            since = 0
            total += sum(more for last, more in held if i <= last)
            held = []
            continue
        if c in AIMED and w and since >= REACH:
            without, aimed = AIMED[c]
            held.append((i + REACH, w * factor * (aimed / without - 1)))
        since += 1
    return total


STEMS = range(4, 9)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’_]+")
_CLAUSE_END = regex.compile(r"[.!?;:\n]")


def features(word: str) -> tuple[str, ...]:
    """A word's ways to be known: itself, and the stems of four to eight letters that it begins with."""
    return (f"={word}",) + tuple(word[:n] for n in STEMS if len(word) > n)


class Scorer:
    """Scores texts with learned weights of words (`=word`) and stems."""

    def __init__(self, weights: dict[str, float], bias: float = -3.0):
        self.weights, self.bias = weights, bias
        self.closed = {w: c for c, ws in CLOSED.items() for w in ws}
        self.finder = ahocorasick.Automaton()
        for f in weights:
            self.finder.add_word(f.removeprefix("="), True)
        for w in CLOSED[THREAT]:
            self.finder.add_word(w, True)
        self.finder.make_automaton()

    def known(self, word: str) -> tuple[int, float]:
        weight = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        if weight:
            return INSULT, weight
        c = self.closed.get(word, OTHER)
        return c, THREAT_WEIGHT if c == THREAT else 0.0

    def clauses(self, low: str) -> Iterator[str]:
        """The clauses, of the whole text, that hold an insult or threat; the others score nothing."""
        done, ends = -1, None
        for end, _ in self.finder.iter(low):
            if end > done:
                if ends is None:
                    ends = [m.start() for m in _CLAUSE_END.finditer(low)]
                i = bisect_left(ends, end)
                a, b = ends[i - 1] + 1 if i else 0, ends[i] if i < len(ends) else len(low)
                done = b
                yield low[a:b]

    def raw(self, text: str | None) -> float:
        total = 0.0
        for clause in self.clauses(text.lower()) if text else ():
            total += clause_score([self.known(w) for w in _WORD.findall(clause)])
        return total

    def score(self, text: str | None) -> float:
        """0 to 1; a null or empty text, and one without a matched clause, has the score of no evidence."""
        return 1 / (1 + math.exp(-min(50.0, self.bias + self.raw(text))))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows_per_label: int = 4096, most_features: int = 4000, least_odds: float = 4.0, least_evidence: float = 14.0) -> dict[str, float]:
    """Weights of words and stems: the log odds of the label given that a text has them.

    It is a bounded sample: the first labelled row by hash in each of rows_per_label hash ranges, for each of the two
    labels, copies and near copies once.  A feature needs five positive texts, log odds of least_odds at least and a
    log likelihood ratio, against chance, of least_evidence at least; the most_features best are kept.  The same rows give the
    same weights, however they are partitioned.  Without positive rows there are no weights.
    """
    known = labels.select(labels[key].alias("k"), labels[label].alias("y")).where("k is not null and y in (0, 1)")
    h = F.xxhash64("k")
    chosen = known.groupBy("y", F.pmod(h, F.lit(rows_per_label)).alias("r")).agg(F.min_by("k", h).alias("k")).select("k", "y")
    sample = (
        docs.select(docs[key].alias("k"), docs[text].alias("t"))
        .where("t is not null")
        .join(F.broadcast(chosen), "k")
        .groupBy("k", "y")
        .agg(F.min("t").alias("t"))  # of rows that share a key one counts, the same one always
        .withColumn("w", F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{M}\p{N}'’_]+)"))))
    )
    # near copies once: they share the long words whose hashes are the least and the greatest
    marks = F.transform(F.filter("w", lambda w: F.length(w) > 8), lambda w: F.xxhash64(w))
    for end in (F.array_min(marks), F.array_max(marks)):
        one = F.min_by(F.struct("k", "t", "w"), F.struct(F.xxhash64("k"), F.col("k"))).alias("one")
        sample = sample.withColumn("m", F.coalesce(end, F.xxhash64("t"))).groupBy("y", "m").agg(one).select("y", "one.*")
    sample = sample.select("k", "y", "w")
    words = sample.select("k", "y", F.explode("w").alias("w"))
    stems = F.array_distinct(F.array(F.concat(F.lit("="), "w"), *(F.when(F.length("w") > n, F.substring("w", 1, n)) for n in STEMS)))
    counts = (
        words.select("k", "y", F.explode(stems).alias("f"))
        .where("f is not null")
        .distinct()
        .groupBy("f")
        .agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    )
    totals = sample.agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).first()
    if not totals.n1 or not totals.n0:
        return {}
    odds = F.log(((F.col("n1") + 0.5) / (totals.n1 + 1)) / ((F.col("n0") + 0.5) / (totals.n0 + 1)))
    n1, n0, share = F.col("n1"), F.col("n0"), totals.n1 / (totals.n1 + totals.n0)
    evidence = n1 * F.log(n1 / ((n1 + n0) * share)) + F.when(n0 > 0, n0 * F.log(n0 / ((n1 + n0) * (1 - share)))).otherwise(0.0)
    found = counts.withColumn("odds", odds).where((n1 >= 5) & (F.col("odds") >= least_odds) & (evidence >= least_evidence)).orderBy(F.desc("odds"), "f").limit(most_features)
    return {r.f: r.odds for r in found.collect()}


def score(docs: DataFrame, weights: dict[str, float], text: str = "text", key: str = "doc_id", cut_at: float = 0.3) -> DataFrame:
    """(key, score, predicted) of every whole text: one row per row of docs; other columns are not looked at.

    Null and empty texts score as texts without evidence.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in small_batches(batches, "t"):
            scores = [scorer.score(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(scores, pa.float64()), pa.array([int(s >= cut_at) for s in scores], pa.int32())], names=["k", "score", "predicted"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, score double, predicted int").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    """The fold that nothing is learned from: crc32 of the key as text, modulo 4, is 2; a null key is not in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
