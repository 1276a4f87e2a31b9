"""Queries over the tables of documents and pages, and their SQL where SQL can express them."""

from __future__ import annotations

from .classifier import op9_quality_classifier
from .html_extract import op3_html_extraction
from .line_dedup import op1_line_dedup
from .minhash import op6_minhash_near_dedup
from .mixing import OP4_SQL, op4_mixing
from .order_minhash import op8_order_minhash
from .packing import op2_best_fit_packing
from .quality_rules import op7_quality_rules
from .secrets import op10_secret_scans
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_order_minhash": op8_order_minhash,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scans": op10_secret_scans,
}

ORACLE_SQL = {"op4_mixing": OP4_SQL, "op5_warc": OP5_SQL}
