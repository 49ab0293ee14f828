"""A corpus pipeline over ``documents``: language identification, near duplicates, secrets, mixing, packing.

Each stage takes what its predecessor kept, as a written table, and returns a DataFrame; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import jaccard, langid, mixing, packing, secrets
from locusframe.llm.common import table, written

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", jaccard.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The network and the column generation have no SQL form; tests/llm/test_pipeline.py checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
