"""A corpus pipeline of five stages, each one operator over all that the stage before kept.

Quality rules, SimHash near-duplicates, benchmark decontamination, personal data, best-fit packing. Every stage
but the last returns the columns of documents; each result is written as Parquet and read as the next input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from findery.llm import decontaminate, near_copies, packing, pii, quality, simhash
from findery.llm.common import stored_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do the over-frequent lines of the others."""
    return quality.without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: equal but for two bits of their fingerprints,
    or with four fifths of their five-word shingles in common."""
    return simhash.keep_one(docs, similarity=near_copies.SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark text is cut out; documents that are mostly benchmark text go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its class, terms that reveal it are generalised or removed."""
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and the sequence that each goes to."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, components and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    base = f"{stored_dir(spark)}/pipeline-{uuid.uuid4().hex}"  # goes with common.discard_stored
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}_{name}")
    return docs
