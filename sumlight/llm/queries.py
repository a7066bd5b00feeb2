"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from . import decontamination, media, mixing, ngram_join, pii, quality, scoring, secrets, substrings, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_lm_scoring": scoring.op2_lm_scoring,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_media_columns": media.op7_media_columns,
    "op8_mixing": mixing.op8_mixing,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_pii": pii.op10_pii,
}
SQL = {
    "op1_ngram_join": ngram_join.SQL,
    "op3_secret_scans": secrets.SQL,
    "op4_decontamination": decontamination.SQL,
    "op8_mixing": mixing.SQL,
    "op9_substring_dedup": substrings.SQL,
}
