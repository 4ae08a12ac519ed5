"""The queries of this subpackage, one per operator, and the SQL that some of them equal."""

from __future__ import annotations

from fiscalis.llm import chat_format, decontaminate, merkle, pieces, quality_knn, quality_rules, secret_scan, simhash, suffix_dedup, superkmers, token_counts, training_order, vector_codes


def queries() -> dict:
    found = (
        token_counts.op1_token_counts, quality_rules.op2_quality_rules, quality_knn.op3_quality_knn, secret_scan.op4_secret_scan, pieces.op5_sentencepiece,
        decontaminate.op6_decontaminate, suffix_dedup.op7_suffix_dedup, simhash.op8_simhash, training_order.op9_training_order, chat_format.op10_chat_format,
        vector_codes.op11_vector_codes, merkle.op12_merkle_manifest, superkmers.op13_superkmer_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_secret_scan": secret_scan.oracle(), "op6_decontaminate": decontaminate.oracle(), "op10_chat_format": chat_format.oracle()}
