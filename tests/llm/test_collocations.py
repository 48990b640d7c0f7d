import random
import re
from collections import Counter

import numpy as np
import pytest

from lithograph.llm import collocations

SHAPE = "doc_id long, text string, lang string, words string, chunk string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=4, nested=80):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in cand.items():
        if any(g == lang and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v))) and 100 * b >= nested * a for (g, v), b in cand.items()):
            continue
        score, k = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("least, chunk_bytes, top", [(2, 300, 2000), (3, 5000, 40), (5, 1 << 20, 7)])
def test_against_brute_force(spark, least, chunk_bytes, top):
    draw = random.Random(chunk_bytes)
    words = ["the", "The", "red", "Fox", "élan", "École", " x", "a-b", "naïve", "日本", "o'clock", "1", "x" * 400]
    gap = [" ", " ", " ", " ", "\t", ". ", ",", "\n", "  ", ";\r\n", "\x0b", "\xa0"]
    rows = [(i, "".join(draw.choice(words) + draw.choice(gap) for _ in range(draw.randrange(0, 60))), draw.choice(["en", "fr", None, "und", ""]), "w", "c") for i in range(90)]
    rows += [(7, "one two one two one two one two", "en", None, None)] * 5 + [(None, "one two three", None, "", ""), (91, None, "en", "", ""), (92, "", "fr", "", ""), (93, " \t.,!", "xx", "", "")]
    rows += [(100 + i, "copied words stand here again, and here", "de", "", "") for i in range(30)]
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SHAPE), least=least, top=top, chunk_bytes=chunk_bytes).collect())
    assert got == brute(rows, least, top) and got


def test_empty(spark):
    for rows in ([], [(1, None, None, "", "")], [(1, "a b", "en", "", "")]):
        assert collocations.collocations(spark.createDataFrame(rows, SHAPE)).collect() == []


def test_packets_round_trip():
    e = np.array([(3, 4, 1, 2), (-5, 1 << 60, 7, 8)], collocations._PHRASE)
    back, rest = collocations.loosened(collocations.squeezed(e, b"tail"), collocations._PHRASE)
    assert (back == e).all() and rest == b"tail"
    assert collocations._read(collocations._key("") + b"w") == ("", "w")


def test_products_pass_64_bits(spark):
    """2,000,000 times a frequency near 2**62 does not overflow."""
    got = spark.sql("select (cast(4611686018427387904 as decimal(19, 0)) * 2000000) div cast(4611686018427387904 as decimal(19, 0)) as s").first().s
    assert got == 2000000
