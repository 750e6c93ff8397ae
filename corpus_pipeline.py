"""The corpus pipeline: quality rules, exact dedup, near-dedup, personal data, packing.

Each stage takes the rows that its predecessor kept, all but the last return the
columns of ``documents``. The near-dedup stage joins documents whose five-word
shingles have a Jaccard similarity of 0.8 or more. Null texts, empty and very long
texts, ties, repeated rows, empty tables and further columns go through every stage:
null and empty texts fail the quality rules, of equal texts the smallest doc_id stays
(null last), of near copies too, and further columns pass as they came, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sloscope.llm import exact_dedup, near_dedup, packing, pii, quality
from sloscope.llm.common import reach_workers, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the count rules and the fitted model let pass."""
    reach_workers(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    reach_workers(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    reach_workers(spark)
    return near_dedup.keep_heads(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind."""
    reach_workers(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' ids as pieces of training windows."""
    reach_workers(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("simhash", near), ("pii", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)


#: The fitted model and the near-duplicates' components can't be expressed in SQL.
ORACLE_SQL = None
