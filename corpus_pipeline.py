"""From raw documents to packed batches of training text.

Quality filter, exact dedup, near dedup, benchmark decontamination, packing.
Each stage works on all rows that the stage before kept, and all but the last
return the columns of ``documents``; the last returns every row's place in the
batches beside its text.  Rows with a null doc_id pass the stages that match
documents with each other or with the benchmark.  Each stage's result is written
before the next reads it, and what the stage staged on the way is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanloom.llm.common import ARROW_BYTES, release, settled, small_batches, table
from scanloom.llm.decontaminate import decontaminate
from scanloom.llm.exact_dedup import exact_dedup
from scanloom.llm.near_dedup import near_dedup
from scanloom.llm.packing import pack
from scanloom.llm.quality import fit_quality, keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled rows, doesn't reject.

    Whole rows pass through Python here, so the session's batches are made small.
    """
    small_batches(spark)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 of five-word shingles."""
    return near_dedup(docs, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, verbatim or with other slots."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch, slot and text of every row that is left."""
    return pack(docs, keep=("text",))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]

#: The quality and near-dup stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written before the next reads it."""
    docs, folder = table(spark, sf_dir, "documents"), None
    batches = spark.conf.get(ARROW_BYTES)
    try:
        for _, stage in STAGES[:-1]:
            before = folder
            docs, folder = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
            if before:
                release(spark, before)
    finally:
        spark.conf.set(ARROW_BYTES, batches)
    return STAGES[-1][1](spark, docs, sf_dir)
