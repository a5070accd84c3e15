"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from histospark.llm import (bpe, exact_dedup, language_id, lm_scoring, mixing, ngram_join, pii, quality_classifier,
                            quality_rules, simhash_index, target_resampling, token_alignment, token_rollup)

_MODULES = (mixing, language_id, lm_scoring, bpe, pii, quality_classifier, exact_dedup, ngram_join, token_rollup,
            quality_rules, simhash_index, token_alignment, target_resampling)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
