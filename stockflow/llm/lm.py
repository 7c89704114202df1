"""Language-model scores of documents: a bigram model with stupid backoff over counts of the whole corpus.

Words are runs of letters and digits, lower-cased, and known by their place in a hashed vocabulary of fixed size ``VOCABULARY``.  A
bigram is seen if another row has it; its score is (its count in other rows) / (the count of its first word); an unseen one backs off to ``BACKOFF``
times (the count of its second word) / (the number of words).  A document's score is the sum of the scores' logarithms.

The word counts are a table of at most ``VOCABULARY`` rows, and the counts of bigrams of the ``FREQUENT`` most frequent words one of at most
FREQUENT ** 2; both sizes are fixed, so these tables are shipped to tasks, which score such bigrams on the spot.  (A pair that a third of all
rows hold is one of frequent words.  Any other bigram has a word outside that list and at most 1 / FREQUENT of the words.)  All other bigrams of a
document are exploded with their frequency in it and dealt by hash to partitions, in lists that hold a batch of documents; counted there over
all rows; joined with those counts; and summed for the documents of each batch.  The number of partitions follows the number of words, so a
partition's size does not grow with the corpus, and a batch's size is fixed.

Defined cases: null texts are read as empty; texts of less than two words have score 0 and no bigrams; each row is a document, whatever its
id, and copies of a row see each other's bigrams; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.frames import slices

VOCABULARY, FREQUENT, BACKOFF = 1 << 20, 1024, 0.4
#: Words to a hash partition, words remembered by a task and looked at at a time, bytes of text whose bigrams are dealt together.
PARTITION, MEMORY, BLOCK, SLICE = 3_000_000, 500_000, 1 << 18, 16 << 20
_WORD = re.compile(r"[^\W_]+")


class Words(dict):
    """Vocabulary places by word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = place = xxhash.xxh64_intdigest(word) & (VOCABULARY - 1)
        return place

    def places(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        words = iter(_WORD.findall(text)) if len(text) < 1 << 22 else (m.group() for m in _WORD.finditer(text))
        blocks = []
        while block := list(islice(words, BLOCK)):
            blocks.append(np.fromiter(map(self.__getitem__, block), np.int32, len(block)))
        return np.concatenate(blocks) if blocks else np.zeros(0, np.int32)


def _summed(texts: DataFrame, size: int, count) -> np.ndarray:
    """The sum over all rows of a vector of fixed ``size`` that ``count(words, text, vector)`` adds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch["text"], SLICE):
                for t in part:
                    count(words, t.as_py(), total)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    found = texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def word_counts(texts: DataFrame) -> np.ndarray:
    """How often each place of the vocabulary occurs; at most ``VOCABULARY`` rows reach the driver."""

    def count(words: Words, text: str | None, total: np.ndarray) -> None:
        places, n = np.unique(words.places(text), return_counts=True)
        total[places] += n

    return _summed(texts, VOCABULARY, count)


def frequent_words(counts: np.ndarray) -> np.ndarray:
    """The number (from 0) of each of the most frequent places, -1 for others; ties go by place."""
    top = np.argsort(-counts, kind="stable")[:FREQUENT]
    rank = np.full(len(counts), -1, np.int32)
    rank[top[counts[top] > 0]] = np.arange((counts[top] > 0).sum(), dtype=np.int32)
    return rank


def frequent_pairs(texts: DataFrame, rank: np.ndarray) -> np.ndarray:
    """How often each pair of frequent words occurs; at most ``FREQUENT`` ** 2 rows reach the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(rank)

    def count(words: Words, text: str | None, total: np.ndarray) -> None:
        r = shared.value[words.places(text)]
        both = (r[:-1] >= 0) & (r[1:] >= 0)
        pairs, n = np.unique(r[:-1][both] * FREQUENT + r[1:][both], return_counts=True)
        total[pairs] += n

    return _summed(texts, FREQUENT**2, count)


def one_list(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_seen, log_score): seen bigrams (repeats included) and the sum of log scores of each row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    texts = rows.select("text")
    counts = word_counts(texts)
    rank, total = frequent_words(counts), int(counts.sum())
    parts = max(1, total // PARTITION)
    spark = docs.sparkSession
    # Logarithms of a word's count, and the counts of pairs of frequent words.
    shared = spark.sparkContext.broadcast((np.log(np.maximum(counts, 1)).astype(np.float64), rank, frequent_pairs(texts, rank)))
    unseen = float(np.log(BACKOFF) - np.log(max(total, 1)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, rank, pairs = shared.value
        words = Words()
        for batch in batches:
            done = 0
            for piece in slices(batch["text"], SLICE):
                some = batch.slice(done, len(piece))
                done += len(piece)
                yield from dealt(some, [words.places(t.as_py()) for t in piece], logs, rank, pairs)

    def dealt(batch: pa.RecordBatch, texts: list[np.ndarray], logs: np.ndarray, rank: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams, often, docs_, base, seen = [], [], [], np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, w in enumerate(texts):
            g, n = np.unique(w[:-1].astype(np.int64) << 20 | w[1:], return_counts=True)
            first, second = g >> 20, g & (VOCABULARY - 1)
            base[i] = (n * (unseen + logs[second])).sum()
            common = (rank[first] >= 0) & (rank[second] >= 0)
            elsewhere = pairs[rank[first[common]] * FREQUENT + rank[second[common]]] - n[common]
            met = elsewhere > 0
            a, b, m = first[common][met], second[common][met], n[common][met]
            base[i] += (m * (np.log(elsewhere[met]) - logs[a] - unseen - logs[b])).sum()
            seen[i] = m.sum()
            grams.append(g[~common])
            often.append(n[~common])
            docs_.append(np.full((~common).sum(), i, np.int32))
        gram, n, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, often, docs_))
        part = (_mix(gram) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((doc, part))
        gram, n, doc, part = gram[order], n[order], doc[order], part[order]
        ends = np.searchsorted(part, np.arange(parts + 1))
        # What each document has whatever the other rows hold travels with one of the lists.
        own = int(batch["row"][0].as_py()) % parts
        row, key_, lengths = batch["row"], batch["doc_id"], np.array([len(w) for w in texts], np.int64)
        for p in range(parts):
            a, b = ends[p], ends[p + 1]
            if a == b and p != own:
                continue
            which, many = np.unique(doc[a:b], return_counts=True)
            mine = p == own
            lists = [
                pa.array(which.astype(np.int32)),
                pa.array(many.astype(np.int32)),
                pa.array((gram[a:b] & 0xFFFFFFFF).astype(np.uint32).view(np.int32)),
                pa.array((gram[a:b] >> 32).astype(np.uint8).view(np.int8)),
                pa.array(n[a:b].astype(np.int32)),
                key_ if mine else key_.slice(0, 0),
                pa.array(lengths if mine else lengths[:0]),
                pa.array(seen if mine else seen[:0]),
                pa.array(base if mine else base[:0]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), row.slice(0, 1), *map(one_list, lists)], names)

    names = ["part", "batch", "docs", "many", "low", "high", "n", "own_ids", "own_words", "own_seen", "own_base"]
    own = f"own_ids array<{kind}>, own_words array<long>, own_seen array<long>, own_base array<double>"
    schema = f"part int, batch long, docs array<int>, many array<int>, low array<int>, high array<tinyint>, n array<int>, {own}"

    def count(group: pa.Table) -> pa.Table:
        """The count table of a hash partition, joined back to its lists: of each list, what its documents gain."""
        logs = shared.value[0]
        flat = {c: group[c].combine_chunks().flatten().to_numpy() for c in ("docs", "many", "low", "high", "n")}
        doc = np.repeat(flat["docs"], flat["many"])
        gram = flat["high"].view(np.uint8).astype(np.int64) << 32 | flat["low"].view(np.uint32)
        n = flat["n"].astype(np.int64)
        ends = np.cumsum([0, *(len(x) for x in group["n"].combine_chunks())])
        _, which = np.unique(gram, return_inverse=True)
        elsewhere = np.bincount(which, n).astype(np.int64)[which] - n if len(n) else n
        gain = np.where(elsewhere > 0, n * (np.log(np.maximum(elsewhere, 1)) - logs[gram >> 20] - unseen - logs[gram & (VOCABULARY - 1)]), 0.0)
        met = np.where(elsewhere > 0, n, 0)
        lists: list[list] = [[], [], []]
        for a, b in zip(ends[:-1], ends[1:]):
            hit = np.flatnonzero(met[a:b]) + a  # documents without a seen bigram here gain nothing
            docs_, place = np.unique(doc[hit], return_inverse=True)
            for into, values in zip(lists, (docs_, np.bincount(place, met[hit], len(docs_)).astype(np.int32), np.bincount(place, gain[hit], len(docs_)))):
                into.append(values)
        arrays = [pa.array(x, pa.list_(k)) for x, k in zip(lists, (pa.int32(), pa.int32(), pa.float64()))]
        return pa.table([group["batch"], *arrays, *(group[c] for c in names[-4:])], names=["batch", "docs", "seen", "gain", *names[-4:]])

    def total(group: pa.Table) -> pa.Table:
        """The sums of the documents of one batch over its lists."""
        flat = {c: group[c].combine_chunks().flatten() for c in group.column_names[1:]}
        docs_, n = flat["docs"].to_numpy(), len(flat["own_ids"])
        seen = np.bincount(docs_, flat["seen"].to_numpy(), n).astype(np.int64) + flat["own_seen"].to_numpy()
        score = np.bincount(docs_, flat["gain"].to_numpy(), n) + flat["own_base"].to_numpy()
        return pa.table([flat["own_ids"], flat["own_words"], pa.array(seen), pa.array(score)], names=["doc_id", "n_words", "n_seen", "log_score"])

    lists = rows.mapInArrow(explode, schema)
    counted = lists.groupBy("part").applyInArrow(count, f"batch long, docs array<int>, seen array<int>, gain array<double>, {own}")
    return counted.groupBy("batch").applyInArrow(total, f"doc_id {kind}, n_words long, n_seen long, log_score double")


def query_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_seen, log_score, mean_log_score) of each document, rounded to nine places."""
    found = scores(docs.select("doc_id", "text"))
    mean = F.when(F.col("n_words") > 1, F.col("log_score") / (F.col("n_words") - 1)).otherwise(F.lit(0.0))
    return found.select("doc_id", "n_words", "n_seen", F.round("log_score", 6).alias("log_score"), F.round(mean, 9).alias("mean_log_score"))
