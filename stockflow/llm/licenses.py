"""Licence scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words are runs of letters and digits, lower-cased.  Of each ``WINDOW`` neighbouring hashes of ``GRAM`` words the least is a fingerprint, in
templates and in documents, so a run of ``GRAM + WINDOW - 1`` words that both have shares one.  An inverted index leads from a
fingerprint to its places in templates.  Fingerprints of a document that lead to one template at nearly the same shift make a
candidate; the template is aligned with the words around it within a band about that shift (match 1, mismatch and gap -1), and a candidate whose aligned
equal words cover at least ``COVERAGE`` of the template is reported with its span in the text.  Of reports that overlap by half
the one with more equal words stays, so a notice is not reported as the shorter one it contains.

The templates are a parameter of known size; each task gets them and builds the index.  Defined cases: null and empty texts match nothing; rows of
equal ids are scanned each; a template of fewer than ``GRAM`` words has one fingerprint, of all its words, and is found where a document
has it between any words; an empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from stockflow.llm.license_texts import TEMPLATES

GRAM, WINDOW, COVERAGE = 3, 3, 0.8
#: Words of a document looked at together, beside the overlap, and hashes of words remembered.
BLOCK, MEMORY = 1 << 18, 500_000
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """64-bit hashes of lower-cased words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.lower())
        return h


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)]
    return out


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the hashes that are the least of some window of neighbours."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.zeros(0, np.int64)
    least = hashes
    for i in range(1, window):
        least = np.minimum(least[: len(hashes) - i], hashes[i:])
    chosen = np.zeros(len(hashes), bool)
    for i in range(window):
        chosen[i : i + len(least)] |= hashes[i : i + len(least)] == least
    return np.flatnonzero(chosen)


def align(template: list, words: list, shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment within ``band`` of the diagonal place = template place + shift: (equal words, first, last + 1 in ``words``).

    Each cell holds the score, the equal words and the start of its best alignment, so no table is kept for a way back.
    """
    best, before = (0, 0, 0, 0), {}
    for i, t in enumerate(template):
        row, left = {}, (0, 0, 0)
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            score, equal, start = before.get(j - 1, (0, 0, j))
            if words[j] == t:
                cell = (score + 1, equal + 1, start if score else j)
            else:
                up = before.get(j, (0, 0, 0))
                cell = max((score - 1, equal, start), (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]))
                if cell[0] <= 0:
                    cell = (0, 0, j + 1)
            row[j] = left = cell
            if (cell[1], cell[0]) > best[:2]:
                best = (cell[1], cell[0], cell[2], j + 1)
        before = row
    return best[0], best[2], best[3]


class Scanner:
    """The inverted index over templates, and the search, in one task."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage, self.hashes = coverage, _Hashes()
        self.names = list(templates)
        self.words = [np.array([self.hashes[w] for w in _WORD.findall(t)], np.uint64) for t in templates.values()]
        rows = []
        self.sizes = sorted({min(len(w), GRAM) for w in self.words if len(w)})
        for i, w in enumerate(self.words):
            size = min(len(w), GRAM)
            h = grams(w, size) if size else np.zeros(0, np.uint64)
            rows += [(size, int(h[p]), i, int(p)) for p in winnowed(h)]
        # By run length: sorted fingerprints, and the templates and places they lead to.
        self.index = {s: tuple(np.array(c, k) for c, k in zip(zip(*sorted(r[1:] for r in rows if r[0] == s)), (np.uint64, np.int64, np.int64))) for s in self.sizes}

    def _candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least shift, greatest shift) of groups of hits."""
        hits = []
        for size, (prints, templates, places) in self.index.items():
            h = grams(words, size)
            at = winnowed(h) if size == GRAM else np.arange(len(h))
            low, high = np.searchsorted(prints, h[at]), np.searchsorted(prints, h[at], side="right")
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                hits += [(t, p - q) for t, q in zip(templates[a:b].tolist(), places[a:b].tolist())]
        out: list[list[int]] = []
        for t, shift in sorted(hits):
            if out and out[-1][0] == t and shift - out[-1][2] <= self._band(t):
                out[-1][2] = shift
            else:
                out.append([t, shift, shift])
        return [tuple(x) for x in out]

    def _band(self, template: int) -> int:
        return max(3, len(self.words[template]) // 8)

    def _block(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(equal words, template, first, last + 1) of the reports in a block of words."""
        found = []
        for t, low, high in self._candidates(words):
            own, band = self.words[t], self._band(t)
            start = max(0, low - band)
            part = words[start : high + len(own) + band].tolist()
            equal, first, last = align(own.tolist(), part, (low + high) // 2 - start, band + (high - low + 1) // 2)
            if equal >= self.coverage * len(own):
                found.append((equal, t, start + first, start + last))
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, equal words, first and last + 1 code point) of the reports in a whole text, in order."""
        text, done = text or "", set()
        if len(text) <= BLOCK:
            words = _WORD.findall(text)
            if found := self._block(np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))):
                spans = [m.span() for m in _WORD.finditer(text)]
                done.update((e, t, spans[a][0], spans[b - 1][1]) for e, t, a, b in found)
        else:
            # Blocks of words overlap by more than any report is long.
            longest = max((len(w) + 2 * self._band(i) for i, w in enumerate(self.words)), default=0) + 1
            spans, hashed = [], []
            for m in chain(_WORD.finditer(text), [None]):
                if m:
                    spans.append(m.span())
                    hashed.append(self.hashes[m.group()])
                if m is None or len(spans) == BLOCK:
                    done.update((e, t, spans[a][0], spans[b - 1][1]) for e, t, a, b in self._block(np.array(hashed, np.uint64)))
                    del spans[:-longest], hashed[:-longest]
        return self._best(done)

    def _best(self, found: list[tuple[int, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
        kept: list[tuple] = []
        reach: dict[int, list[tuple]] = {}
        for e, t, a, b in sorted(found, key=lambda x: (-x[0], -x[0] / len(self.words[x[1]]), x[2], x[1])):
            # Reports that stay are listed by stretches of text, so each is held against those near it only.
            near = {k for s in range(a >> 10, (b >> 10) + 1) for k in reach.get(s, ())}
            if all(2 * (min(b, y) - max(a, x)) < min(b - a, y - x) for _, _, x, y in near):
                kept.append((e, t, a, b))
                for s in range(a >> 10, (b >> 10) + 1):
                    reach.setdefault(s, []).append((e, t, a, b))
        return [(self.names[t], e / len(self.words[t]), e, a, b) for e, t, a, b in sorted(kept, key=lambda x: (x[2], x[1]))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, n_words, start, end) of each report, places in code points."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        names, kinds = ["license", "coverage", "n_words", "start", "end"], [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch["text"]):
                for report in scanner.scan(t.as_py()):
                    rows.append(i)
                    found.append(report)
            if rows:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows)), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], ["doc_id", *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text")).mapInArrow(run, f"doc_id {kind}, license string, coverage double, n_words long, start long, end long")


def query_rows(docs: DataFrame) -> DataFrame:
    return scan(docs)
