"""Registered queries of the subpackage, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from ratinglab.llm import align, chat, jaccard, mixing, pieces, pii, quality, resample, tiling, topk, unigram, warc, webtext


def queries() -> dict:
    return {
        "op1_context_mixing": mixing.query,
        "op2_token_counts": unigram.query,
        "op3_sentencepiece": pieces.query,
        "op4_pii_surrogates": pii.query,
        "op5_quality_rules": quality.query,
        "op6_warc_index": warc.query,
        "op7_jaccard_join": jaccard.query,
        "op8_decontaminate": tiling.query,
        "op9_main_text": webtext.query,
        "op10_chat_format": chat.query,
        "op11_token_alignment": align.query,
        "op12_importance_resample": resample.query,
        "op13_exact_topk": topk.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": quality.ORACLE,
        "op6_warc_index": warc.ORACLE,
        "op10_chat_format": chat.ORACLE,
        "op12_importance_resample": resample.ORACLE,
        "op13_exact_topk": topk.ORACLE,
    }
