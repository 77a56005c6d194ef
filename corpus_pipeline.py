"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

Every stage works on all that the one before it kept. All but the last return the columns of documents; the last adds
what the mix takes of each document. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparktab.llm import decontaminate, linededup, mixing, neardup, toxicity
from sparktab.llm.common import documents, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity.toxicity_stage),
    ("line_dedup", linededup.linededup_stage),
    ("near_dedup", neardup.neardup_stage),
    ("decontamination", decontaminate.decontaminate_stage),
    ("mixing", mixing.mix_stage),
]

#: SQL can't express the toxicity model; tests hold run() against a brute-force version of the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
