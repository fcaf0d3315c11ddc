"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from entitylink.llm import divergence, exact_dedup, importance, language_id, lm_score, minhash_dedup, mixing, quality, secret_scan, substring_dedup, tokenize_sp, topk, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_url_filter": url_filter.query,
        "op3_language_id": language_id.query,
        "op4_lm_score": lm_score.query,
        "op5_quality": quality.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_minhash_dedup": minhash_dedup.query,
        "op8_sentencepiece": tokenize_sp.query,
        "op9_topk": topk.query,
        "op10_mixing": mixing.query,
        "op11_divergence": divergence.query,
        "op12_importance": importance.query,
        "op13_secret_scan": secret_scan.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op9_topk": topk.ORACLE, "op10_mixing": mixing.oracle(), "op11_divergence": divergence.ORACLE, "op12_importance": importance.ORACLE}
