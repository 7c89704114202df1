"""Packing token sequences of a fixed size: whole documents side by side, as few sequences as can be.

A document is its ids from a published vocabulary file and an id that ends it.  Only documents longer than a sequence are cut, into pieces
of ``SIZE`` ids and a last one of what is left.  Pieces are laid into sequences by bounded-space best-fit: a packer takes one piece
at a time and puts it into the open sequence whose free space it fills best.  Open sequences are kept in a bitset keyed by free space
(bit f is set if one with f ids free is open), so the best one is the lowest set bit from the piece's length on.  If there is none a new
sequence is opened; beyond ``OPEN`` open sequences the fullest is closed.

Pieces are dealt to packers by a hash of their row, some ``PIECES`` to each, so their number grows with the corpus and no group of equal
rows meets in one.  A packer takes its pieces longest first: on the test tables that leaves 0.01 to 0.03 % more sequences than
the total of ids needs at least, and 0.4 % in order of arrival.

Texts are tokenised by the library, one run at a time: its pattern never spans ASCII white space and drops it, so the ids of a text are
those of its runs without white space.  In a run of plain letters and closing marks no match holds both, so the two are put together, and
plain letters go to the library's model at once, past its rules for other characters.  A task remembers the ids of runs it has met.

Defined cases: a null or empty text is the end id alone, one piece; equal rows and rows of equal ids are packed each; a null id stays null; a
long text is cut into blocks at white space and never held as one list of runs; an empty table gives an empty result; columns
beside id and text are not looked at.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.frames import saved

VOCABULARY, END, SIZE = "word_bpe_49k.json", 1, 4096
#: Open sequences of a packer, and the pieces it is dealt on average.
OPEN, PIECES = 4096, 1 << 15
#: Runs remembered by a task, the longest one remembered, and bytes of a text that are cut into runs at a time.
MEMORY, LONG, BLOCK = 600_000, 64, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Letters of ASCII and Latin-1, which stay one character each when texts are normalised, as UTF-8; marks that may close a run of them.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?$#&%*]*)")


def _byte_letters() -> str:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(visible)))}
    return "".join(hidden.get(b, chr(b)) for b in range(256))


class Tokens:
    """Ids of texts in one task, by the library's tokenizer."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        if word not in self.known:
            letters = word.decode().lower().encode().decode("latin-1").translate(self.letters)
            self.known[word] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        return self.known[word]

    def _others(self, runs: list[bytes]) -> None:
        found = self.tokenizer.encode_batch([r.decode() for r in runs], add_special_tokens=False)
        self.known.update((r, array("I", e.ids).tobytes()) for r, e in zip(runs, found))

    def _learn(self, runs: set[bytes]) -> None:
        others = []
        for run in runs:
            if not (plain := _PLAIN.fullmatch(run)):
                others.append(run)
            elif marks := plain[2]:
                if marks not in self.known:
                    self._others([marks])
                self.known[run] = self._word(plain[1]) + self.known[marks]
            else:
                self._word(run)
        self._others(others)

    def _block(self, block: bytes) -> bytes:
        # The library lowers letters itself; a special string in other letters is not special, so that texts with one stay as they are.
        runs = (block if b"<|" in block else block.lower()).split()
        new = set(runs).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known, new = {}, set(runs)
        self._learn(new)
        out = b"".join(map(self.known.__getitem__, runs))
        for run in new:
            if len(run) > LONG:
                self.known.pop(run, None)
        return out

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if len(text) <= BLOCK:
            return self._block(text)
        parts, start = [], 0
        while start < len(text):
            cut = _SPACE.search(text, start + BLOCK)
            end = cut.start() if cut else len(text)
            parts.append(self._block(text[start:end]))
            start = end
        return b"".join(parts)


def vocabulary_spec(name: str = VOCABULARY) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: str | None = None, size: int = SIZE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of each document's pieces; the vocabulary (some MB) is shipped once."""
    shared = docs.sparkSession.sparkContext.broadcast(spec or vocabulary_spec())
    kind = docs.schema[key].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in batches:
            rows, numbers, lengths, sums, ids = [], [], [], [], []
            for row, doc in enumerate(batch["text"]):
                whole = tokens.encode(doc.as_py() or b"") + last
                for piece, at in enumerate(range(0, len(whole), 4 * size)):
                    part = whole[at : at + 4 * size]
                    rows.append(row)
                    numbers.append(piece)
                    lengths.append(len(part) // 4)
                    sums.append(crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            piece = np.array(numbers, np.int32)
            columns = {
                "key": batch["key"].take(pa.array(rows, pa.int64())),
                "piece": pa.array(piece),
                "start": pa.array(piece.astype(np.int64) * size),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].cast("binary").alias("text"))
    return texts.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class BestFit:
    """Bounded-space best-fit over sequences of ``size`` ids; ``put`` gives (sequence, offset) of a piece."""

    def __init__(self, size: int = SIZE, limit: int = OPEN):
        self.size, self.limit, self.bits, self.open, self.made = size, limit, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        sequence = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.size, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return sequence, self.size - free


def placed(parts: DataFrame, size: int = SIZE, limit: int = OPEN, share: int = PIECES) -> DataFrame:
    """``parts`` (a written table with ``row`` and ``length``) with ``sequence_id`` and ``offset``."""
    packers = max(1, -(-parts.count() // share))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row", "ascending")])
        packer, fit = group["packer"][0].as_py(), BestFit(size, limit)
        spots = [fit.put(n) for n in group["length"].to_pylist()]
        sequences, offsets = np.array(spots, np.int64).reshape(-1, 2).T
        group = group.drop_columns(["packer"])
        return group.append_column("sequence_id", pa.array(sequences + (packer << 40))).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    dealt = parts.withColumn("packer", F.pmod(F.xxhash64("row"), F.lit(packers)))
    return dealt.groupBy("packer").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(row, key, piece, start, length, ids_crc32, sequence_id, offset) of each piece; ``row`` tells pieces of equal rows apart."""
    cut = pieces(docs, key, text, spec, size, end)
    return placed(saved(cut.withColumn("row", F.monotonically_increasing_id()), "pieces"), size)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, spans), a span being (key, piece, offset, length), in order of offset."""
    cut = saved(pieces(docs, key, text, spec, size, end, keep_ids=True).withColumn("row", F.monotonically_increasing_id()), "pieces")
    where = placed(cut.drop("ids"), size).select("row", "sequence_id", "offset")
    # At most ``size`` ids and spans a sequence, as every piece has an id at least.
    held = cut.join(where, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "row", "key", "piece", "length", "ids"))).alias("held"))
    spans = F.transform("held", lambda h: F.struct(h["key"].alias("key"), h["piece"].alias("piece"), h["offset"].alias("offset"), h["length"].alias("length")))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda h: h["ids"])).alias("ids"), spans.alias("spans"))


def query_rows(docs: DataFrame) -> DataFrame:
    return pack(docs).select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
