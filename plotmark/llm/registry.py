"""The queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from plotmark.llm import ann, bpe, exact_dedup, html_text, language_id, licenses, line_dedup, merkle, ngram_join, packing, pii, whitening, window_packing


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_licenses": licenses.op2_licenses,
        "op3_packing": packing.op3_packing,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_language_id": language_id.op5_language_id,
        "op6_bpe": bpe.op6_bpe,
        "op7_ann": ann.op7_ann,
        "op8_html_text": html_text.op8_html_text,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_pii": pii.op10_pii,
        "op11_window_packing": window_packing.op11_window_packing,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": licenses.OP2_SQL,
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
    }
