"""Labelled rows to learn from, and the folds that tell them from held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, y, part) of at most ``rows`` labelled keys outside the held-out fold, dealt by a hash of the key.

    Several labels of one key count as their mean, rounded; null labels and keys teach nothing.  ``part`` (0 to 99) is a hash to
    set rows aside with.  The bound is on keys: the list of ``rows`` keys is what is broadcast.
    """
    known = labels.select(labels[f"`{key}`"].alias("key"), labels[f"`{label}`"].alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("key").agg(F.round(F.avg("label")).cast("int").alias("y")).filter(fold(F.col("key"), folds) != held)
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    texts = docs.select(docs[f"`{key}`"].alias("key"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "key").select("text", "y", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(100)).cast("int").alias("part"))
