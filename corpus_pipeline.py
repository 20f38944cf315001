"""From raw documents to token ids: language ID, line dedup, near-dedup, decontamination, encoding.

Each stage is a function of (spark, docs, sf_dir). Its rows are stored as Parquet in the shared
folder and read again as the next one's documents, so a lost executor never takes more than the
stage it works on. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyscan.llm.common import stored, table
from tallyscan.llm.decontaminate import drop_contaminated
from tallyscan.llm.langid import drop_rejected
from tallyscan.llm.linededup import dedup_lines
from tallyscan.llm.pieces import given_vocabulary, round_trip
from tallyscan.llm.simhash import one_of_each_group


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those too far from every known language."""
    return drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines; documents that are deleted whole go."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group: shingles of three words, links at three or fewer differing bits."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digest of what they decode to."""
    return round_trip(docs, given_vocabulary())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

# Language ID is a trained model, which SQL can't express: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
