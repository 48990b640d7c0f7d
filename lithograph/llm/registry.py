"""The training-data queries, by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from lithograph.llm import bpe, collocations, hilbert, jaccard, langid, lattice, lpf, packing, secrets_scan, substrings, summa, toxicity, urls

MODULES = (bpe, collocations, hilbert, jaccard, langid, lattice, lpf, packing, secrets_scan, substrings, summa, toxicity, urls)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
