"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from slatewise.llm import (
    alignment, bpe, html_text, line_dedup, mixing, ngram_join, quality, resampling, substring_dedup, suffix_dedup, token_counts, topk, toxicity,
)


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_topk": topk.op4_topk,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_quality": quality.op7_quality,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_html": html_text.op9_html,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_resampling": resampling.op11_resampling,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op4_topk": topk.OP4_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "op11_resampling": resampling.OP11_SQL,
    }
