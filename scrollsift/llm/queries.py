"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from scrollsift.llm import bpe_count, doc_prints, language, mixing, nbest, near_dup, pii, quality, secret_ledger, toxicity

QUERIES = {
    "op1_secret_scan": secret_ledger.op1_secret_scan,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op9_fingerprints": doc_prints.op9_fingerprints,
    "op10_language": language.op10_language,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_near_duplicates": near_dup.op6_near_duplicates,
    "op7_token_counts": bpe_count.op7_token_counts,
    "op8_nbest_segmentation": nbest.op8_nbest_segmentation,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": secret_ledger.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_pii": pii.OP5_SQL,
}
