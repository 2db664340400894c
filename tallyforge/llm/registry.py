"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyforge.llm import (
    queries_ann,
    queries_classifiers,
    queries_cover_tree,
    queries_decontamination,
    queries_divergence,
    queries_filter_audit,
    queries_line_dedup,
    queries_near_dedup,
    queries_sharding,
    queries_tokens,
    queries_warc,
)

QUERIES = {
    "op1_bpe": queries_tokens.op1_bpe,
    "op2_language": queries_classifiers.op2_language,
    "op3_token_files": queries_tokens.op3_token_files,
    "op4_line_dedup": queries_line_dedup.op4_line_dedup,
    "op5_toxicity": queries_classifiers.op5_toxicity,
    "op6_decontamination": queries_decontamination.op6_decontamination,
    "op7_warc": queries_warc.op7_warc,
    "op8_near_dedup": queries_near_dedup.op8_near_dedup,
    "op9_sharding": queries_sharding.op9_sharding,
    "op10_neighbours": queries_ann.op10_neighbours,
    "op11_embedding_dedup": queries_cover_tree.op11_embedding_dedup,
    "op12_filter_audit": queries_filter_audit.op12_filter_audit,
    "op13_divergence": queries_divergence.op13_divergence,
}
ORACLE_SQL: dict[str, str] = {
    name: sql
    for module in (queries_line_dedup, queries_warc, queries_near_dedup, queries_cover_tree, queries_filter_audit, queries_divergence)
    for name, sql in module.ORACLE_SQL.items()
}
