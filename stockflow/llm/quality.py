"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a calibrated temperature.

A word (a run without white space) has two forms, each a row of a table of fixed size: a lexical form (shape, first and last
letters) and an outer form (shape, the marks around it, and whether it repeats the word before).  Each row has a fixed sparse
random index vector; its context vector is the sum of the index vectors met within ``REACH`` words over the training rows, and its
word vector is both, normalised.  A document is the mean of its word vectors, whatever its length.  The network (one hidden
layer, then a logistic unit) learns on the training rows but for a tenth, on which a temperature is then fitted, so that
scores are probabilities.

Bound on learning: ``ROWS`` labelled rows, dealt by a hash of their key.  Scores use the text alone and are made for every row.

Defined cases: null and empty texts have a zero vector and a score all the same; without training rows, or with one label only, every
score is the share of label 1 among them, smoothed (0.5 for none); repeated rows have equal scores; columns of the input stay, and those named like the
outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.frames import saved
from stockflow.llm.labelled import fold, sample

ROWS, FOLDS, HELD, THRESHOLD = 8000, 5, 0, 0.3
#: Rows of the table of forms (the first OUTER of them for outer forms), dimensions, signs of an index vector, words of context.
FORMS, OUTER, DIMENSIONS, SIGNS, REACH = 1 << 14, 1 << 11, 64, 6, 2
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 60, 128, 3e-3, 11
#: Words pooled at a time, and words whose forms a task remembers.
BLOCK, MEMORY = 1 << 15, 500_000
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def word_forms(word: str) -> int:
    """The two forms and a hash of a word, packed: 14 bits lexical, 11 bits outer (even), 30 bits hash."""
    before, core, after = _EDGE.match(word).groups()
    shape = "U" if core.isupper() and len(core) > 1 else "t" if core[:1].isupper() else "l" if core.islower() else "d" if core.isdigit() else "m" if core else "0"
    low = core.lower()
    lexical = xxhash.xxh32_intdigest(f"{shape} {low[:2]} {low[-2:]} {min(len(low), 9)}") % (FORMS - OUTER) + OUTER
    outer = xxhash.xxh32_intdigest(f"{shape} {before[:3]} {after[:3]} {min(len(low), 3)}") % (OUTER // 2) * 2
    return lexical | outer << 14 | (xxhash.xxh32_intdigest(word) & 0x3FFFFFFF) << 25


class Forms(dict):
    """Packed forms by word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = packed = word_forms(word)
        return packed

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """Rows of the table of forms, two for each word, a block of words at a time."""
        words = iter(text.split()) if len(text) < 1 << 22 else (m.group() for m in _WORD.finditer(text))
        last = -1
        while block := list(islice(words, BLOCK)):
            packed = np.fromiter(map(self.__getitem__, block), np.int64, len(block))
            same = np.concatenate([[last], packed[:-1]]) == packed
            last = packed[-1]
            yield np.stack([packed & 0x3FFF, (packed >> 14 & 0x7FF) | same], axis=1)


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of each form, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((FORMS, DIMENSIONS), np.float32)
    for _ in range(SIGNS):
        out[np.arange(FORMS), rng.integers(0, DIMENSIONS, FORMS)] += rng.choice([-1, 1], FORMS).astype(np.float32)
    return out


def context_sums(blocks: Iterator[np.ndarray]) -> np.ndarray:
    """Of each form, the sum of the index vectors of the forms within ``REACH`` words."""
    index, out = index_vectors(), np.zeros((FORMS, DIMENSIONS), np.float32)
    for rows in blocks:
        near = index[rows[:, 0]] + index[rows[:, 1]]
        context = np.zeros_like(near)
        for d in range(1, REACH + 1):
            context[d:] += near[:-d]
            context[:-d] += near[d:]
        for forms in rows.T:
            order = np.argsort(forms, kind="stable")
            at, first = np.unique(forms[order], return_index=True)
            out[at] += np.add.reduceat(context[order], first, axis=0)
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)

    return (unit(index_vectors()) + unit(context)).astype(np.float32)


def pooled(forms: Forms, text: str | None, table: np.ndarray) -> np.ndarray:
    """The mean of the rows of ``table`` over all words of a text; zeros for no words."""
    total, n = np.zeros(table.shape[1]), 0
    for rows in forms.blocks(text or ""):
        total += table[rows.ravel()].sum(0, dtype=np.float64)
        n += rows.size
    return total / max(n, 1)


@dataclass(frozen=True)
class Model:
    """First layer folded into the table of word vectors (``table`` rows are a form's share of the hidden units)."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def score(self, hidden: np.ndarray) -> float:
        z = (np.tanh(hidden + self.bias) @ self.out + self.out_bias) / self.temperature
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> tuple:
    """Weights of the two layers (Adam on the log loss) over standardised inputs, and the temperature for the rows set aside."""
    rng = np.random.default_rng(SEED)
    mean, scale = x[~aside].mean(0), x[~aside].std(0) + 1e-6
    z = (x - mean) / scale
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moments, squares, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    rows = np.flatnonzero(~aside)
    for epoch in range(EPOCHS):
        rng.shuffle(rows)
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            h = np.tanh(z[part] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -500, 500))) - y[part]) / len(part)
            back = np.outer(error, w[2]) * (1 - h * h)
            grads = [z[part].T @ back + 1e-4 * w[0], back.sum(0), h.T @ error + 1e-4 * w[2], np.array([error.sum()])]
            step += 1
            for j, g in enumerate(grads):
                moments[j] = 0.9 * moments[j] + 0.1 * g
                squares[j] = 0.999 * squares[j] + 0.001 * g * g
                w[j] -= RATE * (1 - epoch / EPOCHS) * (moments[j] / (1 - 0.9**step)) / (np.sqrt(squares[j] / (1 - 0.999**step)) + 1e-8)
    check = aside if aside.any() else ~aside
    logits = np.tanh(z[check] @ w[0] + w[1]) @ w[2] + w[3]
    # Smoothed targets: rows that are told apart without error do not call for certainty.
    ones = y[check].sum()
    goal = np.where(y[check] == 1, (ones + 1) / (ones + 2), 1 / (len(y[check]) - ones + 2))
    tries = np.geomspace(0.25, 16, 73)
    losses = [(goal * np.logaddexp(0, -logits / t) + (1 - goal) * np.logaddexp(0, logits / t)).mean() for t in tries]
    return mean, scale, *w, float(tries[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``rows`` labelled rows.  The driver gets the table of forms and one pooled vector for each of those rows."""
    taught = saved(sample(docs, labels, "quality", FOLDS, HELD, rows, key, text).repartition(8), "quality")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, sums = Forms(), np.zeros((FORMS, DIMENSIONS), np.float32)
        for batch in batches:
            sums += context_sums(rows for t in batch["text"] for rows in forms.blocks(t.as_py()))
        for part in range(0, FORMS, 1024):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([sums[part : part + 1024].tobytes()], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b.as_py(), np.float32) for b in group["sums"])
        return pa.table({"part": group["part"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    parts = taught.mapInArrow(contexts, "part int, sums binary").groupBy("part").applyInArrow(total, "part int, sums binary").orderBy("part").collect()
    vectors = word_vectors(np.frombuffer(b"".join(r["sums"] for r in parts), np.float32).reshape(FORMS, DIMENSIONS))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms()
        for batch in batches:
            means = [pooled(forms, t.as_py(), shared.value).tolist() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.list_(pa.float64())), batch["y"], batch["part"]], ["x", "y", "part"])

    known = sorted((tuple(r["x"]), r["y"], r["part"]) for r in taught.mapInArrow(pool, "x array<double>, y int, part int").collect())
    ones = sum(y for _, y, _ in known)
    if not 0 < ones < len(known):
        share = (ones + 1) / (len(known) + 2)
        return Model(np.zeros((FORMS, 1), np.float32), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    x, y, part = (np.array(c) for c in zip(*known))
    mean, scale, w1, b1, w2, b2, temperature = train(x, y.astype(float), part < 10 if len(known) >= 200 else np.zeros(len(known), bool))
    return Model((vectors @ (w1 / scale[:, None])).astype(np.float32), b1 - (mean / scale) @ w1, w2, float(b2[0]), temperature)


def with_score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for every row."""
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.bias, model.out, model.out_bias, model.temperature))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forms, own = Forms(), Model(*shared.value)
        for batch in batches:
            yield pa.array([own.score(pooled(forms, t.as_py(), own.table)) for t in batch], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, F.arrow_udf(run, "double")(df[f"`{text}`"]))


def query_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that a classifier learned on them scores below the threshold."""
    scored = with_score(docs, fit(docs, labels), output="__quality_score")
    return scored.filter(F.col("__quality_score") >= THRESHOLD).select(*[docs[f"`{c}`"] for c in docs.columns])
