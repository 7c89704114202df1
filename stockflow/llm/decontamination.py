"""Benchmark decontamination in DataFrame functions only: documents that hold a near-copy of a benchmark item.

Words are runs of letters and digits, lower-cased; a shingle is ``SHINGLE`` words (an item of fewer words has one, its whole
sequence).  A document is looked at through windows of an item's number of words.  A window similar to an item shares a
shingle with it, so windows are laid where a shingle of some item occurs, aligned on it; no other window can match.

Each different window has a 128-bit SimHash of its shingles, each occurrence a feature that votes with the root of the shingle's weight.  Windows and items whose fingerprints differ in at most
``RADIUS`` bits are found through ``BLOCKS`` blocks of bits: were each block to differ in more than RADIUS // BLOCKS bits, the whole would
differ in more than RADIUS, so some block of the item, with up to that many bits flipped, equals the window's.  The items' flipped
blocks are joined to the windows' plain ones; nothing within the radius is missed.  With such votes a
weighted Jaccard similarity s bounds the cosine: it is at least 2 s / (1 + s), 0.889 at 0.8, whatever the weights and lengths.  There the
mean distance is 128 arccos(0.889) / pi = 19.4 bits with a deviation of 4.1, by the normal approximation; RADIUS lies 2.9 deviations above.

Candidates are verified exactly: the weighted Jaccard similarity of the two multisets of shingles, a shingle's weight being
1 + ln(items / items that hold it), is at least ``SIMILARITY``.

Defined cases: null texts and texts without words match nothing, nor do items without words; a document shorter than an item is one window; items of equal words
match alike; rows of equal ids and texts are one; a null id is an id; an empty table on either side gives an empty result; columns beside id and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm.frames import saved, shipped

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 128, 8, 31
#: Rows up to which a counted table is broadcast (at most some 40 bytes a row).
SHIPPED = 1 << 18
_WIDTH = BITS // BLOCKS


def words(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def shingles(words: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words; none if there are fewer."""
    parts = ", ".join(f"element_at({words}, i + {j})" for j in range(size))
    return F.expr(f"if(size({words}) < {size}, array(), transform(sequence(1, greatest(size({words}) - {size - 1}, 1)), i -> xxhash64({size}, {parts})))").cast("array<bigint>")


def simhash(bag: str) -> Column:
    """Two 64-bit halves, bit by bit, of a weighted majority over a sorted bag (h, n, weight).

    Each of a shingle's n occurrences has a hash of its own and votes with the root of the weight, so the cosine of two bags is
    sum(weight * min(n)) / sqrt(sum(weight * n) * sum(weight * n)).
    """
    halves = []
    for half in range(BITS // 64):
        votes = f"flatten(transform({bag}, s -> transform(sequence(1L, s.n), j -> named_struct('x', xxhash64({half}, s.h, j), 'v', sqrt(s.weight)))))"
        sums = f"aggregate(v, 0D, (n, s) -> n + if(shiftrightunsigned(s.x, b) & 1L = 1L, s.v, -s.v))"
        halves.append(F.expr(f"transform(array({votes}), v -> aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if({sums} > 0, 1L, 0L), b)))[0]"))
    return F.array(*halves)


def _printed(windows: DataFrame, weights: DataFrame, n_weights: int, rare: float) -> DataFrame:
    """(sh, print, total weight) of each different window; shingles of no item vote with the weight ``rare``, as they are verified."""
    different = saved(windows.select("sh").distinct().withColumn("id", F.monotonically_increasing_id()), "different")
    counted = different.select("id", F.explode("sh").alias("h")).groupBy("id", "h").agg(F.count("*").alias("n"))
    counted = counted.join(shipped(weights, n_weights, SHIPPED), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(rare)))
    bags = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("h", "n", "weight"))).alias("bag"))
    total = F.expr("aggregate(bag, 0D, (t, s) -> t + s.n * s.weight)")
    return different.join(bags, "id").select("sh", simhash("bag").alias("print"), total.alias("total"))


def _blocks(print_: str) -> Column:
    """(block, value) of each block of a fingerprint."""
    each = 64 // _WIDTH
    mask = (1 << _WIDTH) - 1
    return F.array(*[F.struct(F.lit(b).alias("block"), F.expr(f"cast(shiftrightunsigned({print_}[{b // each}], {b % each * _WIDTH}) & {mask}L AS int)").alias("value")) for b in range(BLOCKS)])


def _items(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Items with words, and of each different shingle list: length, fingerprint, distinct shingles with counts and weights."""
    rows = benchmark.select(benchmark[f"`{key}`"].alias("item_id"), words(benchmark[f"`{text}`"]).alias("w")).filter("size(w) > 0")
    listed = F.when(F.size("w") >= SHINGLE, shingles("w", SHINGLE))
    for n in range(1, SHINGLE):
        listed = listed.when(F.size("w") == n, shingles("w", n))
    rows = saved(rows.select("item_id", F.size("w").alias("n"), listed.alias("sh")), "items")
    kinds = rows.select("n", "sh").distinct().withColumn("kind", F.xxhash64("n", "sh"))
    total = kinds.count()
    spread = kinds.select("kind", F.posexplode("sh").alias("place", "h"))
    weights = spread.groupBy("h").agg((1 + F.log(F.lit(float(max(total, 1))) / F.countDistinct("kind"))).alias("weight"))
    counted = spread.groupBy("kind", "h").agg(F.count("*").alias("n")).join(weights, "h")
    counted = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("h", "n", "weight"))).alias("bag"))
    kinds = kinds.join(counted, "kind").withColumn("print", simhash("bag"))
    return rows.withColumn("kind", F.xxhash64("n", "sh")).select("item_id", "kind"), saved(kinds, "kinds")


def _log(n: int) -> float:
    import math

    return math.log(max(n, 1))


def _windows(docs: DataFrame, kinds: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, mark, sh): the shingles of each window that shares a shingle with an item, at that shingle's place."""
    # Where items have a shingle: its offset from their start, and their number of words.
    laid = kinds.select("n", F.posexplode("sh").alias("offset", "h")).distinct()
    laid = saved(laid, "offsets")
    laid = shipped(laid, laid.count(), SHIPPED)
    read = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    met = None
    for size in sizes:
        rows = read.select("doc_id", "mark", F.size("w").alias("length"), F.posexplode(shingles("w", size)).alias("place", "h")).join(laid, "h")
        met = rows if met is None else met.union(rows)
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("offset"), F.col("length") - F.col("n")))
    spots = met.select("doc_id", "mark", start.alias("start"), "n").distinct()
    spots = saved(spots.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spots")), "windows")
    spots = shipped(spots.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "spots"), spots.agg(F.sum(F.size("spots"))).first()[0] or 0, SHIPPED)
    marked = docs.withColumn("mark", F.xxhash64("text"))
    again = marked.join(spots, marked["doc_id"].eqNullSafe(F.col("_id")) & (marked["mark"] == F.col("_mark")))
    again = again.select("doc_id", "mark", words(F.col("text")).alias("w"), "spots")
    out = None
    for size in sizes:
        # Windows of fewer words than a shingle belong to short items, of as many words.
        rows = again.select("doc_id", "mark", F.explode("spots").alias("spot"), shingles("w", size).alias("all"), F.size("w").alias("length"))
        n = F.least(F.col("spot.n"), F.col("length"))
        rows = rows.filter(n >= SHINGLE if size == SHINGLE else F.col("spot.n") == size)
        rows = rows.select("doc_id", "mark", F.col("spot.start").alias("start"), n.alias("n_words"), F.slice("all", F.col("spot.start") + 1, n - (size - 1)).alias("sh"))
        out = rows if out is None else out.union(rows)
    return out


def similarity(window: str = "sh", bag: str = "bag", total: str = "total") -> Column:
    """Weighted Jaccard similarity of a window's shingles, of weight ``total`` together, and an item's bag."""
    held = f"transform({bag}, s -> named_struct('n', s.n, 'weight', s.weight, 'm', size(filter({window}, x -> x = s.h))))"
    sums = (
        f"aggregate({held}, named_struct('both', 0D, 'item', 0D), (a, s) -> named_struct("
        "'both', a.both + s.weight * least(s.n, s.m), 'item', a.item + s.weight * s.n))"
    )
    return F.expr(f"transform(array({sums}), a -> a.both / (a.item + {total} - a.both))[0]")


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, mark, item_id, similarity, start_word, n_words): the best window of each document and item that match.

    ``mark`` is the hash of the text, which tells rows of equal ids apart.
    """
    docs = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))
    items, kinds = _items(benchmark, item, item_text)
    sizes = sorted({min(r["n"], SHINGLE) for r in kinds.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect()}) or [SHINGLE]
    windows = saved(_windows(docs, kinds, sizes), "windows")
    # Copies of a window are fingerprinted and verified once.
    weights = saved(kinds.select(F.explode("bag").alias("s")).select("s.h", "s.weight").distinct(), "weights")
    different = saved(_printed(windows, weights, weights.count(), 1 + _log(kinds.count())), "prints")
    flips = F.expr(f"filter(sequence(0, {(1 << _WIDTH) - 1}), x -> bit_count(x) <= {RADIUS // BLOCKS})")
    keys = kinds.select("kind", F.col("print").alias("item_print"), F.explode(_blocks("print")).alias("b"))
    keys = keys.select("kind", "item_print", "b.block", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("b.value")))).alias("value"))
    probes = different.select("sh", "print", "total", F.explode(_blocks("print")).alias("b")).select("sh", "print", "total", "b.block", "b.value")
    distance = sum((F.bit_count(F.col("print")[i].bitwiseXOR(F.col("item_print")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col("print")[0].bitwiseXOR(F.col("item_print")[0])))
    # The flipped blocks are many times the items: never broadcast on the items' estimated size.
    near = probes.join(keys.hint("merge"), ["block", "value"]).filter(distance <= RADIUS).select("sh", "kind", "total").distinct()
    verified = near.join(kinds.select("kind", "bag"), "kind").withColumn("similarity", similarity()).filter(F.col("similarity") >= SIMILARITY)
    verified = saved(verified.select("sh", "kind", "similarity"), "verified")
    found = windows.join(verified, "sh").groupBy("doc_id", "mark", "kind").agg(F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start"))).alias("best"))
    found = found.select("doc_id", "mark", "kind", F.col("best.similarity").alias("similarity"), F.col("best.start").alias("start_word"), F.col("best.n_words").alias("n_words"))
    return found.join(items, "kind").drop("kind").select("doc_id", "mark", "item_id", "similarity", "start_word", "n_words")


def query_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of every document and item that match."""
    found = matches(docs, benchmark).groupBy("doc_id", "item_id")
    best = found.agg(F.max_by(F.struct("similarity", "start_word", "n_words"), F.struct("similarity", -F.col("start_word"))).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), "b.start_word", "b.n_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a near-copy of a benchmark item."""
    found = saved(matches(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__mark")), "left_anti")
