"""From raw documents to packed token sequences: five stages, each written as Parquet and read again.

Every stage takes the columns it needs by name and passes all columns on, also those whose names clash
with its own; the last returns the pieces. Null and empty texts have no words and fail the first stage;
given to a later one they are kept as they are (one of them by near_dedup, which takes repeated rows
and texts as copies). Ids may be null or repeat. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, packing, pii, quality, simhash
from millrace.llm.common import shared_folder, table
from millrace.llm.queries import prepared

#: Near-duplicates: three-word shingles, fingerprints that differ in at most so many bits.
SHINGLE, BITS = 3, 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule and whose host is not rejected."""
    prepared(spark)
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates: the row with the smallest doc_id."""
    prepared(spark)
    return simhash.one_of_each(docs, SHINGLE, BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    prepared(spark)
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    prepared(spark)
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("packing", packed),
]

# Tokenizers and boosted trees are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
