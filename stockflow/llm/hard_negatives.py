"""Hard negatives for contrastive training: rows of another label that score close to, but below, an anchor's positives.

Vectors are quantised to whole numbers, and a row's score is its inner product with the anchor, so every comparison is exact.  An
anchor's positives are its ``POSITIVES`` best rows of the same label.  The negatives of a positive with score p are the ``NEGATIVES``
best rows of other labels whose score lies in the window ``LEAST`` * p to ``MOST`` * p (in hundredths).  Higher scores come first, ties
by smaller id (null last).

Both searches are Fagin's threshold algorithm.  Rows are dealt into blocks of some ``BLOCK`` rows; a block holds a sorted list of its rows
for each dimension.  A list is read from its top where the anchor's component is positive, from its bottom where it is negative; each row
met is scored whole by random access.  No unread row can score more than the threshold, the anchor's product with the values last
read.  Reading stops once the threshold lies strictly below the k-th score found (of each window: or below the window), so ties are complete.

Anchors are dealt into stripes of at most ``STRIPE`` and meet each block in a cell of their own: a cell's memory is bounded at every size,
and what leaves it is a few rows for each anchor.  For positives the blocks are cut label by label, a frequent label into many.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a vector shorter than others is filled
up with zeros; equal rows and rows of equal ids are rows of their own, and only the anchor's own row is not its positive; a null id is
no anchor; an anchor without positives or without negatives has no rows; an empty table gives an empty result; other columns
are not looked at; scores that could pass 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm.frames import saved

SCALE, ANCHORS, FLIPS, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A window of scores, in hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Rows of a block, anchors of a stripe, and the number of rows read from each list at first (it doubles).
BLOCK, STRIPE, FIRST = 4096, 4096, 16


class Lists:
    """The sorted lists of one block: rows in order of each component."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(values.T, self.order, 1)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows met anew, their scores, threshold), reading deeper each time, until all rows are met."""
        n = len(self.values)
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(down) and not len(up):
            down = np.zeros(1, np.int64)  # every score is zero: any list leads to all rows
        met, depth, step = np.zeros(n, bool), 0, FIRST
        while depth < n:
            to = min(depth + step, n)
            now = np.zeros(n, bool)
            now[self.order[down, n - to : n - depth]] = True
            now[self.order[up, depth:to]] = True
            rows = np.flatnonzero(now & ~met)
            met |= now
            threshold = anchor[down] @ self.sorted[down, n - to] + anchor[up] @ self.sorted[up, to - 1]
            yield rows, self.values[rows] @ anchor, int(threshold)
            depth, step = to, 2 * step


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first by descending score, then by id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the ``k`` first among the ``allowed``."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, lists.values.dtype)
    for new, found, threshold in lists.read(anchor):
        ok = allowed[new]
        rows, scores = np.concatenate([rows, new[ok]]), np.concatenate([scores, found[ok]])
        if np.count_nonzero(scores > threshold) >= k:
            break
    at = best(scores, ids[rows], k)
    return rows[at], scores[at]


def window(positive: int) -> tuple[int, int]:
    """The least and the largest whole score of a positive's window (empty if the first is larger)."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def top_of_windows(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, ids: np.ndarray, windows: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, scores) of the ``k`` first of each window among the ``allowed``."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0, lists.values.dtype)
    for new, found, threshold in lists.read(anchor):
        ok = allowed[new]
        rows, scores = np.concatenate([rows, new[ok]]), np.concatenate([scores, found[ok]])
        sure = scores[scores > threshold]
        if all(a > b or threshold < a or np.count_nonzero((sure >= a) & (sure <= b)) >= k for a, b in windows):
            break
    out = []
    for a, b in windows:
        inside = np.flatnonzero((scores >= a) & (scores <= b))
        at = inside[best(scores[inside], ids[rows[inside]], k)]
        out.append((rows[at], scores[at]))
    return out


def _matrix(vectors: pa.ChunkedArray, dims: int, kind: str) -> np.ndarray:
    """The lists as rows of one matrix, short ones filled up with zeros."""
    array = vectors.combine_chunks()
    lengths = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(array), dims), kind)
    out[np.arange(dims) < lengths[:, None]] = array.flatten().to_numpy(zero_copy_only=False)
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers that order null last (an id of 2 ** 63 - 1 ties with it)."""
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, v) of the rows that take part; every ``FLIPS``-th id has the next label.  ``row`` tells equal rows apart once it is written."""
    x = df.select(df[f"`{key}`"].cast("long").alias("id"), df[f"`{label}`"].cast("long").alias("label"), df[f"`{vector}`"].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    moved = F.when(F.col("id") % FLIPS == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    v = F.transform("x", lambda c: F.floor(c * SCALE).cast("long"))
    return x.filter("label IS NOT NULL AND x IS NOT NULL").filter(fine).select(F.monotonically_increasing_id().alias("row"), "id", moved.alias("label"), v.alias("v"))


def _cells(left: DataFrame, right: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _spread(df: DataFrame, parts, name: str) -> DataFrame:
    """A copy of each row for each of ``parts`` cells."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), parts - 1)))


def _part(parts) -> F.Column:
    return F.pmod(F.xxhash64("row"), parts).cast("int")


def positives(rows: DataFrame, anchors: DataFrame, dims: int, kind: str, k: int = POSITIVES, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """(row, positive_row, positive_id, positive_score) of the ``k`` best other rows of each anchor's label."""
    is_anchor = (F.col("id") % ANCHORS == 0).cast("long")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(is_anchor).alias("m"))
    cut = [F.ceil(F.col("n") / block).cast("int").alias("parts"), F.ceil(F.col("m") / stripe).cast("int").alias("stripes")]
    sizes = saved(counts.filter("m > 0").select("label", *cut), "labels")
    left = _spread(rows.join(sizes, "label").withColumn("part", _part(F.col("parts"))), F.col("stripes"), "stripe").select("label", "part", "stripe", "row", "id", "v")
    right = _spread(anchors.join(sizes, "label").withColumn("stripe", _part(F.col("stripes"))), F.col("parts"), "part").select("label", "part", "stripe", "row", "v")

    def run(here: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(here) and len(asked):
            lists, ids, own = Lists(_matrix(here["v"], dims, kind)), _ids(here["id"]), here["row"].to_numpy()
            names = here["id"].to_pylist()
            for row, anchor in zip(asked["row"].to_pylist(), _matrix(asked["v"], dims, kind)):
                at, scores = top(lists, anchor, own != row, ids, k)
                for column, values in zip(out, ([row] * len(at), own[at].tolist(), [names[i] for i in at], [int(s) for s in scores])):
                    column.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["row", "positive_row", "positive_id", "positive_score"])

    found = _cells(left, right, ["label", "part", "stripe"], run, "row long, positive_row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to ``NEGATIVES`` rows for each anchor and positive."""
    rows = saved(quantised(df, key, vector, label), "vectors")
    largest = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    total, m, dims, most = rows.agg(F.count("*"), F.count_if(F.col("id") % ANCHORS == 0), F.max(F.size("v")), F.max(largest)).first()
    dims, most = max(dims or 0, 1), most or 0
    if dims * most * most >= 1 << 63:
        raise ValueError("components are too large: scores would pass 64 bits")
    # Doubles hold whole numbers up to 2 ** 53 exactly, and their products run on faster routines.
    kind = "float64" if dims * most * most < 1 << 53 else "int64"
    anchors = rows.filter(F.col("id") % ANCHORS == 0)
    known = saved(positives(rows, anchors, dims, kind, POSITIVES, block, stripe), "positives")
    listed = known.groupBy("row").agg(F.collect_list(F.struct("positive_row", "positive_id", "positive_score")).alias("known"))
    parts, stripes = (F.lit(max(1, -(-n // size))) for n, size in ((total, block), (m, stripe)))
    left = _spread(rows.withColumn("part", _part(parts)), stripes, "stripe").select("part", "stripe", "row", "id", "label", "v")
    asked = anchors.join(listed, "row").withColumn("stripe", _part(stripes)).withColumnRenamed("id", "anchor_id")
    right = _spread(asked, parts, "part").select("part", "stripe", "row", "anchor_id", "label", "v", "known")
    names = ["row", "anchor_id", "positive_row", "positive_id", "positive_score", "negative_row", "negative_id", "negative_score"]

    def run(here: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if len(here) and len(asked):
            lists, ids, own = Lists(_matrix(here["v"], dims, kind)), _ids(here["id"]), here["row"].to_numpy()
            labels, shown = here["label"].to_numpy(), here["id"].to_pylist()
            for anchor, vector in zip(asked.drop_columns(["v"]).to_pylist(), _matrix(asked["v"], dims, kind)):
                of = anchor["known"]
                windows = [window(p["positive_score"]) for p in of]
                for p, (at, scores) in zip(of, top_of_windows(lists, vector, labels != anchor["label"], ids, windows, NEGATIVES)):
                    for i, s in zip(at.tolist(), scores.tolist()):
                        values = (anchor["row"], anchor["anchor_id"], p["positive_row"], p["positive_id"], p["positive_score"], int(own[i]), shown[i], int(s))
                        for column, value in zip(out, values):
                            column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names)

    found = _cells(left, right, ["part", "stripe"], run, ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("row", "positive_row").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
