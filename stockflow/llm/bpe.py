"""Byte-pair encoding and decoding with a published vocabulary file.

``encode`` gives the ids that the *tokenizers* library gives for the same file without special-token templates, truncation
or padding; ``decode`` gives its text for ids, special tokens kept.

Merging follows the contiguous rank array: a short word is one row of two matrices, the tokens between its boundaries and the
ranks of adjacent pairs.  The least rank is looked for again and again, one boundary is deleted, and the two ranks beside it
are looked up anew.  Words of one length are merged together as rows of one matrix.  Long words (a run of thousands of letters)
use a heap over the same ranks, since a repeated scan would cost the square of their length.

Defined cases: a null text is read as an empty one and has no ids; null ids decode to an empty text; ids outside the vocabulary
are an error; equal texts have equal ids, whatever their rows; columns of the input stay, and one that has the output's name
is replaced.  Texts are split lazily, so a long text costs its ids and no list of its words.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from stockflow.llm.frames import slices

VOCABULARY, PATTERN = "byte_bpe_50k.json", public_tokenizers.PATTERN
#: Words of at most this many bytes are merged in matrices.
SHORT = 64
#: Words remembered by a task, and words of a text handled at a time.
MEMORY, BLOCK = 250_000, 1 << 18
#: Bytes of text, or ids, that one batch of results is made of.
SLICE = 1 << 21
NONE = np.int32(2**31 - 1)

#: Code points that are letters or numbers in newer Unicode versions only, and "other" for the vocabulary's library.
NEWER = (
    "0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
    "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 "
    "1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead "
    "323b0-33479 3d000-3fc3f"
)


def _class(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need: bytes of each id, ids of single bytes, merges as sorted pair keys with rank and result, special strings."""

    tokens: list
    single: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    special: dict

    def plain(self) -> tuple:
        """The parts without this class, which executors need not be able to import."""
        return tuple(getattr(self, f.name) for f in fields(self))


def load(path: str) -> Vocabulary:
    """Read a byte-level BPE file (JSON).  Its size bounds what tasks receive: a few bytes for each token and merge."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    byte_of = {c: b for b, c in letters.items()}
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens: list = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        tokens[i] = bytes(byte_of[c] for c in text)
    for text, i in special.items():
        tokens[i] = text.encode()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
    order = np.argsort(keys, kind="stable")
    return Vocabulary(
        tokens,
        np.array([vocab[letters[b]] for b in range(256)], np.int32),
        keys[order],
        np.arange(len(merges), dtype=np.int32)[order],
        np.array([vocab[a + b] for a, b in merges], np.int32)[order],
        special,
    )


class Encoder:
    """Encodes texts in one task; remembers words it has merged."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        rare = _class(NEWER)
        rest = r"|\s+(?!\S)|\s+"
        self.pattern = regex.compile(PATTERN)
        self.strict = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{rare}]]+| ?[\p{{N}}--[{rare}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{rare}]]+{rest}", regex.V1)
        self.rare = re.compile(f"[{rare}]")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.known = self._fresh()

    def _fresh(self) -> dict:
        """Ids, as bytes, by word; special strings stand as their ids."""
        return {i: np.int32(i).tobytes() for i in self.v.special.values()}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        found = self.v.keys[at] == key
        return np.where(found, self.v.ranks[at], NONE), self.v.results[at]

    def _merge_rows(self, parts: np.ndarray) -> list[bytes]:
        """Merge words of one length; ``parts`` has a row of ids for each."""
        out: list = [None] * len(parts)
        rows = np.arange(len(parts))
        ranks, results = self._lookup(parts[:, :-1], parts[:, 1:])
        while len(rows):
            width = parts.shape[1]
            least = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            live = ranks[np.arange(len(rows)), least] != NONE if width > 1 else np.zeros(len(rows), bool)
            if not live.all():
                done = ~live
                for i, ids in zip(rows[done].tolist(), parts[done]):
                    out[i] = ids.tobytes()
                rows, parts, ranks, results, least = rows[live], parts[live], ranks[live], results[live], least[live]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            parts[at, least] = results[at, least]
            keep = np.arange(width - 1) + (np.arange(width - 1) > least[:, None])
            parts = np.take_along_axis(parts, keep, 1)
            if width > 2:
                # The pair that was merged goes; the pairs on its two sides have a new member.
                keep = np.arange(width - 2) + (np.arange(width - 2) >= least[:, None])
                ranks, results = np.take_along_axis(ranks, keep, 1), np.take_along_axis(results, keep, 1)
                for side in (least - 1, least):
                    ok = (side >= 0) & (side < width - 2)
                    r, s = at[ok], side[ok]
                    ranks[r, s], results[r, s] = self._lookup(parts[r, s], parts[r, s + 1])
            else:
                ranks, results = ranks[:, :0], results[:, :0]
        return out

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.v.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], bytearray(n)
        first, result = self._lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        at = np.flatnonzero(first != NONE)
        heap = list(zip(first[at].tolist(), at.tolist(), [ids[i] for i in at], [ids[i + 1] for i in at], result[at].tolist()))
        heapq.heapify(heap)
        pairs = self._pairs()
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = new, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (hit := pairs.get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (hit[0], x, ids[x], ids[y], hit[1]))
        return np.array([x for x, g in zip(ids, gone) if not g], np.int32).tobytes()

    def _pairs(self) -> dict:
        if "pairs" not in self.__dict__:
            self.pairs = dict(zip(self.v.keys.tolist(), zip(self.v.ranks.tolist(), self.v.results.tolist())))
        return self.pairs

    def _learn(self, words: set) -> None:
        by_length: dict[int, list] = {}
        for w in words:
            by_length.setdefault(len(b := w.encode()), []).append((w, b))
        for n, group in by_length.items():
            if n > SHORT:
                self.known.update((w, self._merge_long(b)) for w, b in group)
            else:
                parts = self.v.single[np.frombuffer(b"".join(b for _, b in group), np.uint8)].reshape(-1, n)
                self.known.update(zip((w for w, _ in group), self._merge_rows(parts)))

    def _parts(self, text: str) -> Iterator[Iterable[str | int]]:
        """The words of a text in order, found lazily; a special string is given as its id."""
        for part in self.cut.split(text) if self.cut else [text]:
            if (i := self.v.special.get(part)) is not None:
                yield (i,)
            elif part:
                pattern = self.pattern if part.isascii() or not self.rare.search(part) else self.strict
                yield (m.group() for m in pattern.finditer(part)) if len(part) > BLOCK else pattern.findall(part)

    def _ids(self, words: list) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)

    def _remember(self, words: set) -> None:
        if len(self.known) > MEMORY:
            self.known = self._fresh()
        if new := words.difference(self.known):
            self._learn(new)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text, block by block: beside the ids no more than a block of words is held."""
        blocks, words = [], chain.from_iterable(self._parts(text or ""))
        while block := list(islice(words, BLOCK)):
            self._remember(set(block))
            blocks.append(self._ids(block))
        return np.concatenate(blocks) if blocks else np.zeros(0, np.int32)

    def encode_all(self, texts: list) -> list[np.ndarray]:
        """The ids of many texts; new words of neighbouring short texts are merged together."""
        out, group, chars = [], [], 0

        def flush() -> None:
            self._remember(set().union(*group))
            out.extend(map(self._ids, group))
            group.clear()

        for text in texts:
            text = text or ""
            if chars + len(text) > 4 * BLOCK:
                flush()
                chars = 0
            if len(text) > 4 * BLOCK:
                out.append(self.encode(text))
            else:
                group.append([*chain.from_iterable(self._parts(text))])
                chars += len(text)
        flush()
        return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the array column ``ids`` of the whole ``text``; the vocabulary file is read on the driver and shipped once."""
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary or vocabulary_path()).plain())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            for part in slices(batch, SLICE):
                yield _lists(encoder.encode_all(part.to_pylist()))

    return df.withColumn(ids, F.arrow_udf(_typed(run), ArrayType(IntegerType()))(df[f"`{text}`"]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the column ``text`` that the ids stand for; broken UTF-8 becomes replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary or vocabulary_path()).plain())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = Vocabulary(*shared.value).tokens.__getitem__
        for part in (p for batch in batches for p in slices(batch, SLICE)):
            values, ends = part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy()
            yield pa.array([b"".join(map(get, values[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())

    return df.withColumn(text, F.arrow_udf(_typed(run), StringType())(F.coalesce(df[f"`{ids}`"], F.array().cast("array<int>"))))


def _typed(run):
    """The types that make a function an Arrow UDF over batches, as objects rather than names."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def digests(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Of each document: its number of tokens, and SHA-256 of its ids and of the text decoded from them."""
    both = decode(encode(df.select("doc_id", "text"), "text", "ids", vocabulary), "ids", "decoded", vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
