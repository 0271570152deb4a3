"""The queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from tessera.llm import op01_mixing, op02_toxicity, op03_html, op04_jaccard, op05_decontaminate, op06_bpe, op07_pii, op08_langid, op09_secrets, op10_exact_dedup, op11_whitening, op12_codes, op13_simhash

MODULES = (op01_mixing, op02_toxicity, op03_html, op04_jaccard, op05_decontaminate, op06_bpe, op07_pii, op08_langid, op09_secrets, op10_exact_dedup, op11_whitening, op12_codes, op13_simhash)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
