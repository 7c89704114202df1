"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of the hashes of its s-mers is at its first or last place.  Whether it is depends on
the k-mer alone, so two texts that share a passage choose the same k-mers in it, wherever it stands: syncmers are anchors for
positional matching.  ``anchors`` lists them with their places, ``passages`` matches two tables by anchors that keep their distance.

A fingerprint folds all anchors of the text into ``BINS`` bins by hash and keeps the least 16 bits of each bin ("ffff": none), as
hexadecimal digits.  The likeness of two fingerprints is the share of equal bins among those that either fills (an estimate of the
share of anchors in common); it is 1 for two empty fingerprints.  A text without syncmers (shorter than a k-mer, say) has one anchor,
the hash of the whole text, and an empty text has none.

Defined cases: null texts are read as empty; rows of equal ids follow one another by text; null ids come before all others; an empty table
gives an empty result; columns beside id and text are ignored; long texts are hashed in blocks that overlap by k - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


K, S, BINS = 16, 6, 128
EMPTY = 0xFFFF
#: Code points hashed at a time, and bytes of text that one bucket of neighbouring ids aims at.
BLOCK, BUCKET = 1 << 20, 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` code points."""
    out, base = codes[: len(codes) - size + 1].astype(np.uint64), np.uint64(0x100000001B3)
    for i in range(1, size):
        out *= base
        out += codes[i : len(codes) - size + 1 + i]
    return _mix(out)


def syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers among code points."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner, width = _rolling(codes, s), k - s + 1
    # The least of each ``width`` neighbouring hashes, by doubling.
    least, span = inner, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    # A k-mer's hash joins those of inner substrings that cover it.
    hashes = np.zeros(len(at), np.uint64)
    for offset in [*range(0, k - s, s), k - s]:
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + inner[at + offset]
    return at, _mix(hashes)


def text_syncmers(text: str, k: int = K, s: int = S) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of a whole text, block by block; one anchor for a text without syncmers."""
    found = False
    for start in range(0, max(len(text) - k + 1, 0), BLOCK):
        codes = np.frombuffer(text[start : start + BLOCK + k - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        at, hashes = syncmers(codes, k, s)
        if len(at):
            found = True
            yield at + start, hashes
    if text and not found:
        yield np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)


def fingerprint(text: str) -> np.ndarray:
    bins = np.full(BINS, EMPTY, np.uint16)
    for _, hashes in text_syncmers(text):
        np.minimum.at(bins, (hashes % np.uint64(BINS)).astype(np.int64), (hashes >> np.uint64(40)).astype(np.uint16) % np.uint16(EMPTY))
    return bins


def digits(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def with_fingerprint(df: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of ``text`` (a column of that name is replaced)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([digits(fingerprint(t.as_py() or "")) for t in batch], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, F.arrow_udf(run, "string")(df[f"`{text}`"]))


def anchors(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(key, place, hash) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch["text"]):
                for at, hashes in text_syncmers(t.as_py() or "", k, s):
                    yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(np.full(len(at), i))), pa.array(at), pa.array(hashes.view(np.int64))], ["key", "place", "hash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text")).mapInArrow(run, f"key {kind}, place long, hash long").withColumnRenamed("key", key)


def passages(left: DataFrame, right: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Passages of the texts behind ``left`` anchors that ``right`` anchors match at a constant shift, with at least ``least`` anchors.

    (left key, right key, shift, first, last, anchors).  ``right`` is meant for a set of known passages: each anchor found in several
    of them gives a row for each.
    """
    a = left.select(F.col(key).alias("left_key"), F.col("place"), "hash")
    b = right.select(F.col(key).alias("right_key"), F.col("place").alias("other"), "hash")
    met = a.join(b, "hash").groupBy("left_key", "right_key", (F.col("place") - F.col("other")).alias("shift"))
    return met.agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("anchors")).filter(F.col("anchors") >= least)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, halo, id, text): rows dealt to buckets of neighbouring ids, each bucket followed by the first row of the next one.

    Bucket limits are ids of the table, taken from a sketch, so the first id of each bucket is known; the row(s) with that id are
    dealt to the bucket before as well (``halo``).  The last bucket is followed by the first row of all.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    stats = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.sum(F.col("id").isNull().cast("int")).alias("nulls")).first()
    buckets = int(max(1, min((stats["size"] or 0) // BUCKET, (stats["n"] or 0) // 2)))
    limits: list[int] = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = rows.agg(F.percentile_approx("id", shares, max(10_000, 20 * buckets))).first()[0] or []
        limits = sorted({x for x in found if x > stats["least"] or stats["nulls"]})
    edges = np.array(limits, np.int64)

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = batch.fill_null(np.iinfo(np.int64).min).to_numpy()
            bucket = np.searchsorted(edges, ids, side="right").astype(np.int32)
            first = ids == np.concatenate([[np.iinfo(np.int64).min if stats["nulls"] else stats["least"] or 0], edges])[bucket]
            yield pa.StructArray.from_arrays([pa.array(bucket), pa.array(first)], ["bucket", "first"])

    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    stats = stats.asDict()
    rows = rows.withColumn("place", F.arrow_udf(place, "bucket int, first boolean")("id"))
    own = F.struct(F.col("place.bucket").alias("bucket"), F.lit(False).alias("halo"))
    before = F.struct(F.pmod(F.col("place.bucket") - 1, F.lit(len(limits) + 1)).alias("bucket"), F.lit(True).alias("halo"))
    return rows.withColumn("to", F.explode(F.when(F.col("place.first"), F.array(own, before)).otherwise(F.array(own)))).select("to.bucket", "to.halo", "id", "text")


def query_rows(docs: DataFrame) -> DataFrame:
    """Of each document: its own and its edited text's fingerprint, and the likeness to the edited text and to the next document."""
    rows = neighbours(docs.select("doc_id", "text"))
    parts = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting, met = None, None

        def row(one: tuple, other: tuple) -> tuple:
            (key, text, own), (_, next_text, next_own) = one, other
            n = len(text) // 2
            edited = text[: len(text) - n] + next_text[:n]
            new = own if edited == text else fingerprint(edited)
            return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(new), likeness(own, new), likeness(own, next_own)

        for batch in batches:
            out = []
            for bucket, halo, key, text in zip(*(batch[c].to_pylist() for c in ("bucket", "halo", "id", "text"))):
                if halo and met == bucket:
                    continue
                this = (key, text, fingerprint(text))
                if waiting is not None:
                    out.append(row(waiting, this))
                waiting = None if halo else this
                met = bucket if halo else met
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
