"""Queries and SQL of this subpackage."""

from . import chat, decontam, embeddings, jaccard, langid, lines, packing, resample, rollup, tokens


def queries() -> dict:
    return {f.__name__: f for f in (lines.op1_line_dedup, tokens.op2_token_ids, resample.op3_importance_resampling, rollup.op4_token_rollups, jaccard.op5_ngram_jaccard_join, langid.op6_language_id, embeddings.op7_embedding_near_dedup, decontam.op8_benchmark_decontamination, packing.op9_best_fit_packing, chat.op10_chat_formatting)}


def oracle_sql() -> dict:
    return {"op1_line_dedup": lines.ORACLE, "op5_ngram_jaccard_join": jaccard.ORACLE, "op8_benchmark_decontamination": decontam.ORACLE, "op10_chat_formatting": chat.ORACLE}
