"""Registered queries of the operators and their SQL oracles."""

from __future__ import annotations

from foliograph.llm import (
    bpe, decontaminate, fingerprints, hard_negatives, jaccard, licenses, line_dedup, periodic_runs, quality, substrings, token_counts,
    toxicity, warc,
)

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_toxicity": toxicity.query,
    "op3_line_dedup": line_dedup.query,
    "op4_jaccard": jaccard.query,
    "op5_bpe": bpe.query,
    "op6_substrings": substrings.query,
    "op7_quality": quality.query,
    "op8_token_counts": token_counts.query,
    "op9_warc": warc.query,
    "op10_decontaminate": decontaminate.query,
    "op10_proximity": decontaminate.near_query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_licenses": licenses.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
