"""The registered queries of the corpus operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_byte_bpe
from .embeddings import op9_embeddings
from .lines import op8_line_templates
from .media import op6_media
from .packing import op2_packing
from .pii import op1_pii
from .quality import op11_quality_rules
from .runs import op13_runs
from .simhash import op7_simhash
from .substring import op4_substrings
from .token_files import op5_token_files
from .toxicity import op10_toxicity
from .whitening import op12_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_pii": op1_pii,
        "op2_packing": op2_packing,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_substrings": op4_substrings,
        "op5_token_files": op5_token_files,
        "op6_media": op6_media,
        "op7_simhash": op7_simhash,
        "op8_line_templates": op8_line_templates,
        "op9_embeddings": op9_embeddings,
        "op10_toxicity": op10_toxicity,
        "op11_quality_rules": op11_quality_rules,
        "op12_whitening": op12_whitening,
        "op13_runs": op13_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {}
