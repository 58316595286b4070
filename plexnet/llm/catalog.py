"""Registered queries of this subpackage and their DuckDB SQL.

Operators without SQL (trained models, tokenizers, MinHash classes, packing)
are tested in tests/llm against brute-force versions.
"""

from __future__ import annotations

from plexnet.llm import (bpe, chat, collocations, ctw, embedding_dedup, exact_dedup, ngram_join, packing, quality_classifier,
                         quality_rules, toxicity, url_filter, whitening)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_bpe": bpe.op4_bpe,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_packing": packing.op8_packing,
    "op9_lm_scoring": ctw.op9_lm_scoring,
    "op10_chat": chat.op10_chat,
    "op11_whitening": whitening.op11_whitening,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_quality_rules": quality_rules.op1_sql(),
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op12_embedding_dedup": embedding_dedup.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
