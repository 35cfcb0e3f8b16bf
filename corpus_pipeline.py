"""The corpus pipeline: each stage's result is written to the shared folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import documents, forgotten, saved
from ledgerloom.llm.mixing import mixing_stage
from ledgerloom.llm.neardup import near_duplicate_stage
from ledgerloom.llm.packing import packing_stage
from ledgerloom.llm.pii import pii_stage
from ledgerloom.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the hashes nor the tokenizer. The rows of each stage are tested against plain versions on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forgotten(before)
        before = docs
    return docs
