"""Operators of a training-data pipeline over documents and pages, with their queries and DuckDB twins."""

from __future__ import annotations

from . import alignment, decontaminate, exact, licenses, lines, mixing, neardup, quality, secrets, spelling, tokens, toxicity, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_files": tokens.op3_token_files,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_near_dedup": neardup.op6_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_licenses": licenses.op9_licenses,
    "op10_warc": warc.op10_warc,
    "op11_exact_dedup": exact.op11_exact_dedup,
    "op12_spelling": spelling.op12_spelling,
    "op13_alignment": alignment.op13_alignment,
}
# Scoring by a trained model (op2) and tokenization (op3, op13) have no SQL form; tests hold them against brute force.
ORACLE = {
    "op1_secrets": secrets.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op5_line_dedup": lines.SQL,
    "op6_near_dedup": neardup.SQL,
    "op7_quality": quality.SQL,
    "op8_mixing": mixing.SQL,
    "op9_licenses": licenses.SQL,
    "op10_warc": warc.SQL,
    "op11_exact_dedup": exact.SQL,
    "op12_spelling": spelling.SQL,
}
