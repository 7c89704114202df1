"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased.  A key of at least ``LENGTH`` code points found
in at least ``DOCUMENTS`` rows loses its lines everywhere but in the largest id that holds it.

An index has three tables.  ``postings`` holds (key, id) for each row and key; ``counts`` holds each key's exact number of rows and
largest id; ``filters`` holds, by shard of the key, a cuckoo filter of the frequent keys.  Inserting and deleting documents changes postings and
counts of their own keys only; keys that become frequent are added to their shard's filter, and keys that cease to be are deleted
from it, so a deletion undoes an insertion.  Texts are never changed in the index: what is dropped follows from the counts of the day.

Deduplication reads each text twice.  The first pass asks the filters which lines may be frequent (a filter never misses a
frequent key), so that only those go to the exact table, which decides; the second drops the lines decided on.  Filters are
shipped to tasks if their counted keys stay within ``SHIPPED``; beyond it all long lines go to the exact table, with the same result.

Keys are 128-bit BLAKE2b digests.  Defined cases: each row is a document; rows of equal ids count each, and all rows with the largest id keep the
line; a null id is smaller than any; null and empty texts are one empty line; a text all of whose lines go becomes empty; an empty
table has an empty index; columns of the input stay, and those named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.frames import aligned, saved, slices

LENGTH, DOCUMENTS = 20, 3
#: Keys of one shard aimed at when an index is built, and frequent keys up to which filters are shipped to tasks (3 bytes a key).
SHARD, SHIPPED = 1 << 16, 1 << 23
SLOTS, ROUNDS = 4, 400
#: Bytes of text that one batch of results is made of.
SLICE = 1 << 21
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key; nothing for short keys."""
    key = line.strip(_BLANK).lower()
    if len(key) < LENGTH or (len(key) < 4 * LENGTH and len(key.decode("utf-8", "replace")) < LENGTH):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def text_keys(text: str | None) -> np.ndarray:
    """The different keys of a text, as rows of two 64-bit numbers."""
    keys = {k for line in (text or "").encode().split(b"\n") if (k := line_key(line))}
    return np.frombuffer(b"".join(sorted(keys)), np.int64).reshape(-1, 2)


class Cuckoo:
    """Cuckoo filters of several shards side by side: buckets of ``SLOTS`` 16-bit fingerprints, each key in one of two buckets.

    ``sizes`` are powers of two, the buckets of each shard.  Methods work on arrays of keys (two 64-bit columns) with their shards.
    """

    def __init__(self, sizes: np.ndarray, slots: np.ndarray | None = None):
        self.sizes = sizes.astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.slots = np.zeros((int(self.sizes.sum()), SLOTS), np.uint16) if slots is None else slots
        self.rng = np.random.default_rng(0)

    def _places(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = keys[:, 1].view(np.uint64)
        mark = (low & np.uint64(0xFFFF)).astype(np.int64)
        return (low >> np.uint64(16)).astype(np.int64) & (self.sizes[shard] - 1), np.where(mark == 0, 1, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray, shard: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.sizes[shard] - 1))

    def contains(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        bucket, mark = self._places(keys, shard)
        here = (self.slots[self.start[shard] + bucket] == mark[:, None]).any(1)
        return here | (self.slots[self.start[shard] + self._other(bucket, mark, shard)] == mark[:, None]).any(1)

    def add(self, keys: np.ndarray, shard: np.ndarray) -> bool:
        """Whether all keys found room; after a failure the filter must be built anew with more buckets."""
        bucket, mark = self._places(keys, shard)
        for turn in range(ROUNDS):
            # Keys of one bucket take its free slots in order; the others try their second bucket, then push someone out.
            order = np.argsort(self.start[shard] + bucket, kind="stable")
            bucket, mark, shard = bucket[order], mark[order], shard[order]
            at = self.start[shard] + bucket
            first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            taken = self.slots[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            free = np.argsort(taken, axis=1, kind="stable")
            self.slots[at[fits], free[fits, rank[fits]]] = mark[fits]
            bucket, mark, shard, first, at = bucket[~fits], mark[~fits], shard[~fits], first[~fits], at[~fits]
            if not len(at):
                return True
            if turn:
                head = np.concatenate([[True], at[1:] != at[:-1]])
                slot = self.rng.integers(0, SLOTS, len(at))
                pushed = self.slots[at[head], slot[head]].astype(np.int64)
                self.slots[at[head], slot[head]] = mark[head]
                mark[head] = pushed
            bucket = self._other(bucket, mark, shard)
        return False

    def remove(self, keys: np.ndarray, shard: np.ndarray) -> None:
        """Delete one copy of each key; only keys that were added may be given."""
        bucket, mark = self._places(keys, shard)
        for place in (bucket, self._other(bucket, mark, shard)):
            todo = np.arange(len(mark))
            while len(todo):
                at = self.start[shard[todo]] + place[todo]
                match = self.slots[at] == mark[todo][:, None]
                todo, at, slot = todo[match.any(1)], at[match.any(1)], match[match.any(1)].argmax(1)
                _, one = np.unique(at * SLOTS + slot, return_index=True)
                self.slots[at[one], slot[one]] = 0
                mark[todo[one]] = -1
                todo = np.delete(todo, one)


def _capacity(keys: int) -> int:
    """Buckets for a number of keys: a power of two, loaded to at most 84 %."""
    return 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.84)))))


def built(keys: np.ndarray) -> np.ndarray:
    """The slots of one shard's filter over its keys."""
    size = _capacity(len(keys))
    while True:
        cuckoo = Cuckoo(np.array([size]))
        if cuckoo.add(keys, np.zeros(len(keys), np.int64)):
            return cuckoo.slots
        size *= 2


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    bits: int

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("n") >= DOCUMENTS)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, id), once for each row and different long line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [text_keys(t.as_py()) for t in batch["text"]]
            if keys:
                each = np.concatenate(keys)
                ids = batch["id"].take(pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])))
                for i in range(0, len(each), 1 << 16):
                    part = each[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), ids.slice(i, len(part))], ["hi", "lo", "id"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("text")).mapInArrow(run, f"hi long, lo long, id {kind}")


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("id").alias("keep"))


def _shard(bits: int):
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


def _filters(frequent: DataFrame, bits: int) -> DataFrame:
    """(shard, slots): the cuckoo filter of each shard that has frequent keys."""

    def run(group: pa.Table) -> pa.Table:
        keys = np.stack([group["hi"].to_numpy(), group["lo"].to_numpy()], axis=1)
        return pa.table({"shard": group["shard"].slice(0, 1), "slots": pa.array([built(keys).tobytes()], pa.binary())})

    return frequent.select(_shard(bits).alias("shard"), "hi", "lo").groupBy("shard").applyInArrow(run, "shard int, slots binary")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_postings: bool = True) -> LineIndex:
    """The index of ``docs``.  Without postings (a one-time deduplication) only frequent keys are kept, and nothing can be deleted."""
    rows = postings(docs, key, text)
    rows = saved(rows, "postings") if keep_postings else rows
    counts = _counted(rows)
    counts = saved(counts if keep_postings else counts.filter(F.col("n") >= DOCUMENTS), "counts")
    bits = max(0, int(np.ceil(np.log2(max(counts.count(), 1) / SHARD))))
    return LineIndex(rows, counts, saved(_filters(counts.filter(F.col("n") >= DOCUMENTS), bits), "filters"), bits)


def _changed(index: LineIndex, rows: DataFrame, keys: DataFrame) -> LineIndex:
    """The index over the postings ``rows``, given the keys whose counts may differ."""
    rows = saved(rows, "postings")
    keys = saved(keys.distinct(), "keys")
    fresh = _counted(rows.join(keys, ["hi", "lo"], "left_semi"))
    old = index.counts.join(keys, ["hi", "lo"], "left_semi").select("hi", "lo", F.col("n").alias("before"))
    moved = old.join(fresh, ["hi", "lo"], "full").select("hi", "lo", (F.coalesce("before", F.lit(0)) >= DOCUMENTS).alias("was"), (F.coalesce("n", F.lit(0)) >= DOCUMENTS).alias("now"))
    counts = saved(index.counts.join(keys, ["hi", "lo"], "left_anti").union(fresh), "counts")
    moved = moved.filter("was <> now").select(_shard(index.bits).alias("shard"), "hi", "lo", "now")

    def run(filters: pa.Table, changes: pa.Table) -> pa.Table:
        shard = (filters if len(filters) else changes)["shard"].slice(0, 1)
        keys = np.stack([changes["hi"].to_numpy(), changes["lo"].to_numpy()], axis=1).astype(np.int64)
        now = changes["now"].to_numpy().astype(bool)
        old = np.frombuffer(filters["slots"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy() if len(filters) else np.zeros((4, SLOTS), np.uint16)
        cuckoo = Cuckoo(np.array([len(old)]), old)
        cuckoo.remove(keys[~now], np.zeros((~now).sum(), np.int64))
        done = cuckoo.add(keys[now], np.zeros(now.sum(), np.int64))
        return pa.table({"shard": shard, "slots": pa.array([cuckoo.slots.tobytes() if done else None], pa.binary())})

    filters = saved(index.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(run, "shard int, slots binary"), "filters")
    # A filter that ran out of room is built anew, larger, from the exact table.
    full = counts.filter(F.col("n") >= DOCUMENTS).withColumn("shard", _shard(index.bits)).join(filters.filter("slots IS NULL"), "shard", "left_semi")
    filters = saved(filters.filter("slots IS NOT NULL").union(_filters(full, index.bits)), "filters")
    return LineIndex(rows, counts, filters, index.bits)


def insert(index: LineIndex, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with further rows."""
    new = saved(postings(docs, key, text), "postings")
    return _changed(index, index.postings.union(new), new.select("hi", "lo"))


def delete(index: LineIndex, ids: DataFrame, key: str = "doc_id") -> LineIndex:
    """The index without the rows of the given ids (null-safe)."""
    gone = ids.select(ids[f"`{key}`"].alias("gone")).distinct()
    match = index.postings["id"].eqNullSafe(gone["gone"])
    return _changed(index, index.postings.join(gone, match, "left_anti"), index.postings.join(gone, match, "left_semi").select("hi", "lo"))


def _screened(docs: DataFrame, index: LineIndex, frequent: int, key: str, text: str) -> DataFrame:
    """Postings of ``docs`` that may be frequent, according to the filters."""
    rows = postings(docs, key, text)
    if frequent > SHIPPED:
        return rows
    parts = {r["shard"]: r["slots"] for r in index.filters.toLocalIterator()}
    sizes = np.array([len(parts.get(s, b"")) // (2 * SLOTS) or 1 for s in range(1 << index.bits)])
    empty = np.zeros(SLOTS, np.uint16).tobytes()
    shared = docs.sparkSession.sparkContext.broadcast((sizes, b"".join(parts.get(s) or empty for s in range(1 << index.bits))))
    bits = index.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, slots = shared.value
        cuckoo = Cuckoo(sizes, np.frombuffer(slots, np.uint16).reshape(-1, SLOTS))
        for batch in batches:
            hi = batch["hi"].to_numpy()
            keys = np.stack([hi, batch["lo"].to_numpy()], axis=1)
            shard = (hi.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hi), np.int64)
            yield batch.filter(pa.array(cuckoo.contains(keys, shard)))

    return rows.mapInArrow(run, rows.schema)


def dedup(docs: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the lines decided against dropped from ``text``, and with ``n_lines`` (before) and ``n_dropped``."""
    frequent = index.frequent()
    rows = _screened(docs, index, frequent.count(), key, text).join(frequent.select("hi", "lo", "keep"), ["hi", "lo"]).filter(~F.col("id").eqNullSafe(F.col("keep")))
    drops = rows.groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("__drops")).withColumnRenamed("id", "__id")

    def run(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part, drops in ((p, d) for batch, all_drops in texts for p, d in zip(slices(batch, SLICE), aligned(batch, all_drops, SLICE))):
            kept, lines_before, dropped = [], [], []
            for t, d in zip(part.to_pylist(), drops.to_pylist()):
                lines = (t or "").encode().split(b"\n")
                gone = {np.array([x["hi"], x["lo"]], np.int64).tobytes() for x in d or ()}
                rest = [x for x in lines if line_key(x) not in gone] if gone else lines
                kept.append(b"\n".join(rest).decode() if gone or t is None else t)
                lines_before.append(len(lines))
                dropped.append(len(lines) - len(rest))
            yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines_before, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    run.__annotations__ = {"texts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    done = docs.join(drops, docs[f"`{key}`"].eqNullSafe(F.col("__id")), "left")
    done = done.withColumn("__done", F.arrow_udf(run, "text string, n_lines long, n_dropped long")(docs[f"`{text}`"], "__drops")).drop("__id", "__drops")
    done = done.withColumns({text: F.col("__done.text"), "n_lines": F.col("__done.n_lines"), "n_dropped": F.col("__done.n_dropped")})
    return done.drop("__done")


def query_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    docs = docs.select("doc_id", "text")
    return dedup(docs, build(docs, keep_postings=False)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines dropped from their texts; a null text stays null."""
    done = dedup(docs.withColumn("__null", F.col("text").isNull()), build(docs, keep_postings=False))
    return done.withColumn("text", F.when(~F.col("__null"), F.col("text"))).select(*[done[f"`{c}`"] if c != "text" else F.col("text") for c in docs.columns])
