"""From raw documents to token ids: quality, near copies, benchmark passages, mix, token store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undertext.llm import decontam, jaccard, mixing, quality, tokenstore
from undertext.llm.common import shared_folder, stored, table

STAGES = [
    ("quality_rules", quality.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontaminate", decontam.stage),
    ("mix_sources", mixing.stage),
    ("token_store", tokenstore.stage),
]

#: Cutoffs, seeded mixing and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again as the next one's documents."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
