"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, embedding_dedup, exact_dedup, hard_negatives, language_id, minhash_dedup, mixing, phrases, pii, secrets, sentencepiece_fst, sharding, toxicity

MODULES = (pii, chat_format, mixing, embedding_dedup, sentencepiece_fst, toxicity, secrets, minhash_dedup, sharding, exact_dedup, language_id, hard_negatives, phrases)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
