"""Cleaning a corpus for training, stage by stage: quality, repeated lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and gives the rows that go on.  All but the last return the columns of ``documents``:

- ``quality`` drops rows that a classifier, learned from ``labels`` on the rows at hand, scores below its threshold;
- ``lines`` drops repeated lines from texts, and sets ``n_chars`` anew;
- ``near_duplicates`` links near-copies by SimHash through BK-trees and by MinHash bands, verifies links (five-word shingles, Jaccard similarity 0.8),
  and keeps of each group the row with the smallest id;
- ``decontamination`` drops rows that hold a near-copy of a ``benchmark`` item;
- ``tokens`` gives each row's ids, their number, and whether decoding them gives the text again.

Null texts are read as empty and pass as null; rows of equal ids are judged each; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import bpe, decontamination, lines, neardup, quality
from stockflow.llm.frames import read, saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text")))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("tokens", tokens_stage),
]

#: A learned classifier has no SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
