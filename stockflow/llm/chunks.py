"""Substring deduplication by content-defined chunking.

A gear hash rolls over the text's code points: each step shifts the hash by one bit and adds a code point's random number (the last
``MEMORY`` count).  A chunk ends where the hash is greater than at the ``REACH`` places before and not less than at those after,
so chunks have over ``REACH`` code points and an end depends on those around it alone: a shared passage has the same ends in all texts
from its first ``MEMORY + REACH`` code points on, whatever was inserted before it.  Only where no place is greatest for ``MOST`` code
points (a run of one letter) a chunk ends there.

Chunks are compared by 128-bit BLAKE2b digests.  A chunk is repeated if two documents hold it.  Adjacent repeated chunks of a document
make a passage; one of at least ``WORDS`` words is reported (a passage loses up to a chunk or two at its ends, so this finds shared
passages of over 50 words).  In scripts that put no spaces between words (``UNSPACED``) two code points count as a word.  Of the chunks in reported passages the first copy, by id and place, stays and the others can be dropped.

Defined cases: ids are integers; null and empty texts have no chunks; rows of equal ids are one document, whose texts are cut each, and null ids
are one id before all others; repeats inside one document only are no repeats; an empty table gives an empty result; columns of the
input stay in ``dedup``, with ``text`` replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.frames import aligned, saved, slices

REACH, MOST, MEMORY = 20, 256, 16
WORDS = 25
#: Scripts without spaces between words: Thai and Lao, Myanmar, Khmer, kana and Chinese characters.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Code points hashed at a time, bytes of text that one batch of results is made of, and what stands for a null id.
BLOCK, SLICE, NO_ID = 1 << 22, 1 << 21, -(2**63)
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def gear_numbers(points: np.ndarray) -> np.ndarray:
    """The random number of each code point: a table's for one byte, a mix of three of them for the others."""
    low = GEAR[points & 255]
    return low if points.dtype == np.uint8 else np.where(points < 256, low, low ^ GEAR[points >> 8 & 255] * np.uint32(0x9E3779B1) ^ GEAR[points >> 16] * np.uint32(0x85EBCA77))


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """The gear hash after each code point, over the last ``MEMORY``: sums over 1, 2, 4 ... of them are joined by doubling."""
    h, span = gear_numbers(points), 1
    while span < MEMORY:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    return h


def _greatest(h: np.ndarray, width: int) -> np.ndarray:
    """The greatest of each ``width`` neighbouring values."""
    span = 1
    while span < width:
        step = min(span, width - span)
        h = np.maximum(h[:-step], h[step:])
        span += step
    return h


def _peaks(data: np.ndarray) -> np.ndarray:
    """Places after bytes whose hash is greater than at ``REACH`` places before and at least that of ``REACH`` places after."""
    found = []
    for start in range(0, len(data), BLOCK):
        back = min(start, REACH + MEMORY)
        h = gear_hashes(data[start - back : start + BLOCK + REACH])
        edge = np.zeros(REACH, np.uint32)
        around = _greatest(np.concatenate([edge, h, edge]), REACH)
        before, after = around[: len(h)], around[REACH + 1 : REACH + 1 + len(h)]
        at = np.flatnonzero((h > before) & (h >= after))
        at = at[(at >= back) & (at < back + BLOCK)] + start - back + 1
        found.append(at)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    return ends[ends < len(data)]


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, in code points."""
    out, start = [], 0
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for end in [*_peaks(points).tolist(), len(text)]:
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end > start:
            out.append(end)
            start = end
    return out


def n_words(piece: str) -> int:
    """Words of a piece: those that spaces part, and half the code points of scripts without spaces."""
    if piece.isascii():
        return len(piece.split())
    rest, unspaced = UNSPACED.subn(" ", piece)
    return len(rest.split()) + unspaced // 2


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, place, hi, lo) of each chunk; ``mark`` is the hash of the text, ``place`` packs start, size (bytes) and words (``unpacked``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            places: list[int] = []
            digests: list[bytes] = []

            def made() -> pa.RecordBatch:
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                row = pa.array(rows, pa.int64())
                arrays = [batch["doc_id"].take(row), batch["mark"].take(row), pa.array(places, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
                for c in (rows, places, digests):
                    c.clear()
                return pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "place", "hi", "lo"])

            for i, t in enumerate(batch["text"]):
                words, start, at = t.as_py() or "", 0, 0
                for end in cuts(words):
                    piece = words[start:end]
                    coded = piece.encode()
                    rows.append(i)
                    places.append(at << 22 | len(coded) << 11 | n_words(piece))
                    digests.append(hashlib.blake2b(coded, digest_size=16).digest())
                    start, at = end, at + len(coded)
                    if len(digests) == 1 << 15:
                        yield made()
            if digests:
                yield made()

    rows = docs.select(F.coalesce(docs[f"`{key}`"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("mark"), docs[f"`{text}`"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, place long, hi long, lo long")


def unpacked(rows: DataFrame) -> DataFrame:
    """Chunks with start, size (in bytes) and words instead of their packed place."""
    place = F.col("place")
    parts = {"start": F.shiftright(place, 22), "size": F.shiftright(place, 11).bitwiseAND(2047), "words": place.bitwiseAND(2047)}
    return rows.withColumns(parts).drop("place")


def repeated(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """The chunks inside reported passages: (doc_id, mark, passage, start, size, words, first_doc, stays).

    ``passage`` numbers the passages of a text; ``stays`` tells the first copy of a chunk.
    """
    held = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # Written first: a join with the aggregate itself would stand on its exchange, and a hot digest would not be split.
    shared = saved(held.filter("first_doc <> last_doc").select("hi", "lo", "first_doc"), "digests")
    # Documents are dealt once; all windows below run inside a document.
    met = unpacked(rows.join(shared, ["hi", "lo"])).repartition("doc_id")
    order = Window.partitionBy("doc_id", "mark").orderBy("start")
    copies = Window.partitionBy("doc_id", "hi", "lo").orderBy("mark", "start")
    # Equal rows give the same chunks twice: one is enough.
    met = met.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "mark", "start").orderBy("size"))).filter("twin = 1")
    met = met.withColumn("stays", (F.col("doc_id") == F.col("first_doc")) & (F.row_number().over(copies) == 1))
    before = F.lag(F.col("start") + F.col("size")).over(order)
    met = met.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("passage", F.sum("new").over(order))
    met = met.withColumn("total", F.sum("words").over(Window.partitionBy("doc_id", "mark", "passage"))).filter(F.col("total") >= words)
    known = [F.nullif(F.col(c), F.lit(NO_ID)).alias(c) for c in ("doc_id", "first_doc")]
    return met.select(known[0], "mark", "passage", "start", "size", "words", known[1], "stays")


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Reported passages: (doc_id, mark, start, end, words, n_chunks, n_dropped, dropped, first_docs), places in bytes."""
    found = repeated(chunks(docs, key, text), words)
    dropped = F.when(~F.col("stays"), F.struct("start", "size"))
    return found.groupBy("doc_id", "mark", "passage").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("size")).alias("end"),
        F.sum("words").alias("words"),
        F.count("*").alias("n_chunks"),
        F.sum((~F.col("stays")).cast("long")).alias("n_dropped"),
        F.sort_array(F.collect_list(dropped)).alias("dropped"),
        F.sort_array(F.collect_set("first_doc")).alias("first_docs"),
    )


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with the chunks of reported passages dropped from ``text`` but for their first copies."""
    drops = passages(docs, words=words).filter("n_dropped > 0").groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("dropped")).alias("__drops"))
    drops = saved(drops.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__drops"), "drops")

    def run(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part, drops in ((p, d) for batch, all_drops in texts for p, d in zip(slices(batch, SLICE), aligned(batch, all_drops, SLICE))):
            out = []
            for t, d in zip(part.to_pylist(), drops.to_pylist()):
                if d:
                    data, at, kept = t.encode(), 0, []
                    for start, size in sorted((x["start"], x["size"]) for x in d):
                        kept.append(data[at:start])
                        at = start + size
                    t = b"".join([*kept, data[at:]]).decode()
                out.append(t)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"texts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__mark")), "left")
    return joined.withColumn("text", F.arrow_udf(run, "string")(docs["text"], "__drops")).drop("__id", "__mark", "__drops")


def query_rows(docs: DataFrame) -> DataFrame:
    """Of each document that holds repeated passages: their number, extent, dropped chunks, and the documents with the first copies."""
    found = passages(docs.select("doc_id", "text"))
    spans = F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    by = found.groupBy("doc_id", "mark").agg(F.count("*").alias("n_passages"), F.sum("words").alias("n_words"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_dropped").alias("n_dropped"), spans, F.sort_array(F.array_distinct(F.flatten(F.collect_list("first_docs")))).alias("first_docs"))
    return by.drop("mark")
