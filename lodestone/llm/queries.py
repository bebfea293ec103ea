"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import contamination, fingerprints, language, licenses, near_dedup, passages, pieces, secrets, suffixes, toxicity

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_language_id": language.op3_language_id,
    "op4_decontamination": contamination.op4_decontamination,
    "op5_substring_dedup": passages.op5_substring_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}
SQL = {
    "op1_license_scans": licenses.SQL,
    "op5_substring_dedup": passages.SQL,
    "op9_near_dedup": near_dedup.SQL,
}
