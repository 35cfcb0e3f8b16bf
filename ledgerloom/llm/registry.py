"""Queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .counts import op5_token_counts
from .fingerprints import op1_fingerprints
from .huffman import op9_token_files
from .mixing import op8_mixing
from .packing import op2_packing
from .pii import op6_pii
from .quality import op10_quality_rules
from .repeats import op3_repeats
from .simhash import op4_simhash
from .urls import OP7_SQL, op7_url_filter

_QUERIES = (
    op1_fingerprints,
    op2_packing,
    op3_repeats,
    op4_simhash,
    op5_token_counts,
    op6_pii,
    op7_url_filter,
    op8_mixing,
    op9_token_files,
    op10_quality_rules,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f.__name__: f for f in _QUERIES}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL}
