"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .byte_bpe import op4_byte_bpe
from .decontaminate import op7_decontaminate
from .html_extract import op13_html_extract
from .language_model import op8_language_model
from .license_scan import op6_license_scan
from .line_quality import op1_line_frequency
from .minhash import op3_minhash
from .oracle import ORACLE
from .periodic_runs import op12_periodic_runs
from .pii import op9_pii
from .quality_bayes import op2_quality_bayes
from .substring_dedup import op10_substring_dedup
from .token_files import op5_token_files
from .whitening import op11_whitening


def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_line_frequency": op1_line_frequency,
    "op2_quality_bayes": op2_quality_bayes,
    "op3_minhash": op3_minhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_files": op5_token_files,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_model": op8_language_model,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_html_extract": op13_html_extract,
}

__all__ = ["ORACLE", "QUERIES"]
