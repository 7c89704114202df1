"""Toxicity: weighted finite-state transducers over the words of a clause, composed and scored by matched clause.

Words are read as symbols: insults (two strengths, learned from labelled rows), threat verbs, targets, negations, words of reported
speech, and others; a clause ends at ``. ! ? ; :`` or a line break.  Four transducers rewrite the symbols one after another:
reported speech marks what is quoted, negation what is denied just before, target what is aimed at someone, and threat joins a
verb with its target.  They are composed into one machine that runs over clauses holding an insult or a threat verb.  What it
puts out (plain, aimed, denied, quoted insults; threats) is counted by clause, and a logistic unit learned on the same
labelled rows turns the counts of a document into a probability.

Insults are learned as word beginnings of 3 to 6 letters and as whole words.  Their support is the number of different
neighbours they are found between, not the number of rows, so that copies of one toxic text teach one fact; a beginning counts if several toxic words have it.

Bounds on learning: ``ROWS`` labelled rows, dealt by a hash of their key, and the ``ENTRIES`` best entries.  Scores use the text
alone and are made for every row.

Defined cases: null and empty texts have no clause and the score of a text without matches; without training rows, or with one
label only, every score is the smoothed share of label 1 (0.5 for none); repeated rows have equal scores; columns of the input stay, and
one named like the output is replaced.
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

ROWS, FOLDS, HELD, THRESHOLD = 12_000, 4, 2, 0.3
#: Most entries of the learned lexicon, least support of one, and the odds from which an insult is weak or strong.
ENTRIES, SUPPORT, WEAK, STRONG = 4000, 4, 4.0, 12.0
BLOCK, MEMORY = 1 << 16, 500_000

#: Closed word classes of the four languages.
THREAT = "kill hurt destroy beat burn shoot stab strangle töten schlagen vernichten umbringen matar golpear destruir quemar tuer frapper détruire brûler".split()
TARGET = "you your yours yourself u he she they him her them du dich dir dein deine ihr euch sie usted ustedes tú ti tus vosotros tu toi vous votre vos ton".split()
NEGATION = "not no never nobody nothing without nor nicht kein keine nie niemals ohne nunca jamás sin tampoco ne pas jamais sans ni".split()
REPORT = "said says say told called wrote writes quoted claimed sagte sagt nannte schrieb dijo dice llamó escribió dit disait appelé écrit".split()

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”«»]")
_OTHER, _END, _WEAK, _STRONG, _THREAT, _TARGET, _NEGATION, _REPORT, _QUOTE = b".|wsTtnrq"
#: What the composed machine puts out, beside nothing.
OUTPUTS = ["weak", "strong", "aimed weak", "aimed strong", "denied", "quoted", "threat"]


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``arcs[state, symbol]`` is (state, symbol put out); other symbols pass and lead to ``rest``.

    State 0 is the first; ``rest[state]`` is where symbols without an arc lead.
    """

    arcs: dict
    rest: dict

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (self.rest[state], symbol))


def compose(machines: list[Transducer], symbols: str) -> tuple[np.ndarray, np.ndarray]:
    """The machine that feeds each one's output to the next, over the states that can be reached: (next state, output)."""
    number, queue, moves = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    while queue:
        states = queue.pop(0)
        row = []
        for symbol in symbols:
            after = []
            for machine, state in zip(machines, states):
                to, symbol = machine.step(state, symbol)
                after.append(to)
            if (key := tuple(after)) not in number:
                number[key] = len(number)
                queue.append(key)
            row.append((number[key], ord(symbol)))
        moves.append(row)
    table = np.array(moves)
    return table[:, :, 0], table[:, :, 1]


SYMBOLS = ".wsTtnrq"


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """Reported speech, negation, target and threat, composed.

    Within a clause: after a word of report and a quotation mark, insults are quoted until the next mark; up to two words after a negation they are denied;
    up to four words after a target they are aimed; a threat verb within four words of a target, either way, is a threat.
    """
    insults = "ws"
    report = Transducer(
        {(0, "r"): (1, "."), (0, "q"): (0, "."), (1, "q"): (2, "."), (2, "q"): (0, "."), (2, "T"): (2, "."), **{(2, i): (2, "Q") for i in insults}},
        {0: 0, 1: 1, 2: 2},
    )
    deny = Transducer({(s, "n"): (2, ".") for s in (0, 1, 2)} | {(s, i): (0, "D") for s in (1, 2) for i in insults}, {0: 0, 1: 0, 2: 1})
    aim = Transducer({(s, "t"): (4, "t") for s in range(5)} | {(s, i): (s - 1, {"w": "W", "s": "S"}[i]) for s in range(1, 5) for i in insults}, {s: max(s - 1, 0) for s in range(5)})
    # States: how near the last target (1 to 4) or the last threat verb (5 to 8) is.
    threat = Transducer(
        {(s, "t"): (4, "." if s < 5 else "H") for s in range(9)} | {(s, "T"): (8, ".") for s in (0, 5, 6, 7, 8)} | {(s, "T"): (0, "H") for s in range(1, 5)},
        {0: 0, **{s: s - 1 for s in range(1, 5)}, 5: 0, **{s: s - 1 for s in range(6, 9)}},
    )
    return compose([report, deny, aim, threat], SYMBOLS)


class Reader:
    """Reads texts as symbols and counts what the grammar puts out, in one task."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.to, self.out = (t.tolist() for t in grammar())
        self.fixed = {w: c for words, c in ((REPORT, _REPORT), (NEGATION, _NEGATION), (TARGET, _TARGET), (THREAT, _THREAT)) for w in words}
        self.fixed |= dict.fromkeys(".!?;:\n", _END) | dict.fromkeys('"“”«»', _QUOTE)
        self.known: dict[str, int] = {}
        self.hit = re.compile(rb"[^|]*[wsT][^|]*")
        self.place = {ord(s): i for i, s in enumerate(SYMBOLS)}
        self.column = {ord(c): i for i, c in enumerate("wsWSDQH")}

    def symbol(self, word: str) -> int:
        low = word.lower()
        if (c := self.fixed.get(low)) is not None:
            return c
        best = max((self.lexicon.get(x, 0) for x in [*(low[:k] for k in range(3, min(len(low), 6) + 1)), low + "$"]), default=0)
        return (_OTHER, _WEAK, _STRONG)[best]

    def symbols(self, text: str) -> Iterator[bytes]:
        words = iter(_TOKEN.findall(text)) if len(text) < 1 << 22 else (m.group() for m in _TOKEN.finditer(text))
        known = self.known
        while block := list(islice(words, BLOCK)):
            if len(known) > MEMORY:
                known.clear()
            for w in set(block).difference(known):
                known[w] = self.symbol(w)
            yield bytes(map(known.__getitem__, block))

    def counts(self, text: str | None) -> np.ndarray:
        """Matched clauses by output, then words; a clause that a block's end cuts is carried over to the next block."""
        out, words, rest = np.zeros(len(OUTPUTS) + 1), 0, b""
        for block in self.symbols(text or ""):
            words += len(block)
            block = rest + block
            cut = block.rfind(b"|") + 1
            rest, block = (block[cut:], block[:cut]) if len(block) - cut < BLOCK else (b"", block)
            self._clauses(block, out)
        self._clauses(rest, out)
        out[-1] = words
        return out

    def _clauses(self, symbols: bytes, out: np.ndarray) -> None:
        for clause in self.hit.findall(symbols):
            state, found = 0, set()
            for symbol in clause:
                at = self.place[symbol]
                if (column := self.column.get(self.out[state][at])) is not None:
                    found.add(column)
                state = self.to[state][at]
            for column in found:
                out[column] += 1


def inputs(counts: np.ndarray) -> np.ndarray:
    """Of each row: whether, and how many, clauses of each kind match, and their share of the words."""
    kinds, words = counts[:, :-1], np.maximum(counts[:, -1:], 1)
    return np.concatenate([kinds > 0, np.log1p(kinds), np.minimum(10 * kinds / words, 1)], axis=1).astype(float)


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(a.shape[1]), np.full(a.shape[1], 0.3)
    ridge[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + step * min(1, 4 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])


def lexicon(taught: DataFrame) -> dict[str, int]:
    """Strength (1 or 2) of at most ``ENTRIES`` word beginnings and words ("word$") that tell toxic rows from others.

    An entry's support among toxic rows is the number of different neighbours it is found between there.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                seen: set = set()
                words = [w for w in _TOKEN.findall(text.as_py().lower()) if w[0].isalpha()]
                for i, w in enumerate(words):
                    near = hash_pair(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
                    own = hash_pair(w, "")
                    seen.update((w[:k], near, own) for k in range(3, min(len(w), 6) + 1))
                    seen.add((w + "$", near, own))
                rows = sorted(seen)
                for i in range(0, len(rows), BLOCK):
                    entry, near, word = zip(*rows[i : i + BLOCK])
                    arrays = [pa.array(entry, pa.string()), pa.array(near, pa.int64()), pa.array(word, pa.int64()), pa.array([y.as_py()] * len(entry), pa.int32())]
                    yield pa.RecordBatch.from_arrays(arrays, ["entry", "near", "word", "y"])

    # A place (entry between two neighbours) counts once for each label, however many copies hold it.
    places = taught.select("text", "y").mapInArrow(entries, "entry string, near long, word long, y int").groupBy("entry", "near").agg(F.max("y").alias("toxic"), F.min("y").alias("least"), F.min("word").alias("word"))
    totals = taught.agg(F.sum("y").alias("toxic"), F.count("*").alias("rows")).first()
    toxic = totals["toxic"] or 0
    ratio = (totals["rows"] - toxic + 1) / (toxic + 1)
    odds = (F.col("toxic") + 0.1) / (F.col("clean") + 0.1) * F.lit(float(ratio))
    word = F.when(F.col("least") == 1, F.col("word"))  # of places that only toxic rows have
    found = places.groupBy("entry").agg(
        F.sum("toxic").cast("double").alias("toxic"), F.sum(1 - F.col("least")).cast("double").alias("clean"), (F.min(word) < F.max(word)).alias("many")
    )
    # A beginning that only one word has says no more than the word.
    found = found.filter("many OR endswith(entry, '$')").withColumn("odds", odds).filter((F.col("toxic") >= SUPPORT) & (F.col("odds") >= WEAK * ratio))
    best = found.orderBy(F.desc(F.col("toxic") * F.log("odds")), "entry").limit(ENTRIES).collect()
    return {r["entry"]: 2 if r["odds"] >= STRONG * ratio and r["toxic"] >= 2 * SUPPORT else 1 for r in best}


def hash_pair(a: str, b: str) -> int:
    return xxhash.xxh64_intdigest(f"{a} {b}") >> 1


@dataclass(frozen=True)
class Model:
    entries: dict
    weights: np.ndarray
    bias: float


def _counted(df: DataFrame, entries: dict, text: str, output: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.array([reader.counts(t.as_py()).tolist() for t in batch], pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, F.arrow_udf(run, "array<double>")(df[f"`{text}`"]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``rows`` labelled rows.  The driver gets the lexicon and the counts of those rows.

    The lexicon comes from half of the rows and the weights from the other half, whose matches the lexicon has not seen.
    """
    taught = saved(sample(docs, labels, "toxic", FOLDS, HELD, rows, key, text).repartition(8), "toxic")
    entries = lexicon(taught.filter("part < 60"))
    known = sorted((r["y"], tuple(r["counts"])) for r in _counted(taught.filter("part >= 60").select("text", "y"), entries, "text", "counts").select("y", "counts").collect())
    y = np.array([k for k, _ in known], float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return Model({}, np.zeros(3 * len(OUTPUTS)), float(np.log(share / (1 - share))))
    weights, bias = train(inputs(np.array([c for _, c in known])), y)
    return Model(entries, weights, bias)


def with_score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 for every row."""
    counted = _counted(df, model.entries, text, output)
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = batch.values.to_numpy().reshape(-1, len(OUTPUTS) + 1)
            yield pa.array(1 / (1 + np.exp(-np.clip(inputs(counts) @ weights + bias, -500, 500))), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return counted.withColumn(output, F.arrow_udf(run, "double")(output))


def query_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
