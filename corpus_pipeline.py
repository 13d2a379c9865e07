"""Corpus pipeline over ``documents``: quality rules, line dedup, near duplicates,
benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept; its result is written as a table and read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetspark.llm.common import scratch_path
from sheetspark.llm.curvepack import pack_along_curve
from sheetspark.llm.decontam import decontaminate
from sheetspark.llm.jaccard import jaccard_components
from sheetspark.llm.linealign import dedup_lines
from sheetspark.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, text=None) -> DataFrame:
    """The columns of ``documents``, with another text where one is given."""
    if text is None:
        return df.select(*COLUMNS)
    return df.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that are too frequent."""
    judged = quality_rules(docs.select(*COLUMNS))
    return _documents(judged.where("kept"), F.col("clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents that
    lose every line go."""
    cut = dedup_lines(docs.select(*COLUMNS))
    left = cut.where("n_removed_lines = 0 OR n_removed_lines < n_lines")
    return _documents(left, F.col("clean_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles (five words, 0.8 or more):
    that with the smallest id, or the first in order where ids are missing or repeat."""
    named = jaccard_components(docs.select(*COLUMNS), words=5, percent=80)
    return _documents(named.where("is_first"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs.select(*COLUMNS), benchmark, offsets=False)
    return _documents(found.where("NOT contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed along the curve."""
    pieces = pack_along_curve(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokens cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
