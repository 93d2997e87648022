"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import decontaminate, fingerprints, langid, licenses, line_dedup, lm_score, mixing, near_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_language": langid.op1_language,
        "op2_fingerprint": fingerprints.op2_fingerprint,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_lm_score": lm_score.op4_lm_score,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_mix": mixing.op10_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fingerprint": fingerprints.SQL,
        "op3_license_scan": licenses.SQL,
        "op5_url_filter": url_filter.SQL,
        "op6_line_dedup": line_dedup.SQL,
        "op7_decontaminate": decontaminate.SQL,
        "op9_near_dedup": near_dedup.SQL,
        "op10_mix": mixing.SQL,
    }
