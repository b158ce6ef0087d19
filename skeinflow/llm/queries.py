"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from skeinflow.llm import bpe, collocations, decontaminate, exact_dedup, html_text, ngram_join, quality, secret_scan, sharding, simhash, substring_dedup, token_counts, vector_codes


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_sharding": sharding.op6_sharding,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_quality": quality.op9_quality,
        "op10_html_text": html_text.op10_html_text,
        "op11_collocations": collocations.op11_collocations,
        "op12_simhash": simhash.op12_simhash,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op5_secret_scan": secret_scan.OP5_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op8_decontaminate": decontaminate.OP8_SQL,
        "op10_html_text": html_text.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
