"""Queries of this subpackage by name, with their DuckDB equivalents."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, line_dedup, pieces, pii, quality, simhash, token_output, toxicity
from .common import table

QUERIES = {
    "op1_html_extract": lambda spark, sf_dir: html_extract.main_text(table(spark, sf_dir, "pages")),
    "op2_toxicity": lambda spark, sf_dir: toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_pieces": lambda spark, sf_dir: pieces.piece_digest(table(spark, sf_dir, "documents")),
    "op4_quality": lambda spark, sf_dir: quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_pii": lambda spark, sf_dir: pii.pii_digest(table(spark, sf_dir, "documents")),
    "op6_simhash": lambda spark, sf_dir: simhash.simhash_digest(table(spark, sf_dir, "documents")),
    "op7_exact_dedup": lambda spark, sf_dir: exact_dedup.exact_dedup(table(spark, sf_dir, "documents")),
    "op8_line_dedup": lambda spark, sf_dir: line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")),
    "op9_token_output": lambda spark, sf_dir: token_output.stored(table(spark, sf_dir, "documents")),
    "op10_decontaminate": lambda spark, sf_dir: decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

ORACLES = {
    "op5_pii": pii.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
