import random
from zlib import crc32

import numpy as np
import pytest
from helpers import ODD, prose, rows
from tokenizers import Tokenizer

from stockflow.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(packing.vocabulary_spec())


def test_ids_equal_the_library_on_random_strings(library, monkeypatch):
    pieces = ["a", "The", " ", "  ", "\n", "é", "é", "́", "Σ", "ΑΣ", "İ", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "Word", "É", "ÿ", "×", "÷", "œ", ".", ",", "$#", "*", '"', "'", "<", "̸", "=", "😀", "\x1c", "\x85", "\xa0", "　", "12", "'s", "....", "漢字", "z" * 70, "ab" * 300]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for block, memory in ((1 << 20, 500_000), (10, 12), (10, 0)):
        monkeypatch.setattr(packing, "BLOCK", block)
        monkeypatch.setattr(packing, "MEMORY", memory)
        tokens = packing.Tokens(packing.vocabulary_spec())
        for t in texts:
            assert np.frombuffer(tokens.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def _expected(library, data, size):
    out = []
    for doc_id, text, *_ in data:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            out.append((doc_id, i, at, len(part), crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def _check_layout(found, size):
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by_sequence.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


def test_query_packs_whole_documents(spark, library):
    found = packing.query_rows(rows(spark)).collect()
    assert sorted([tuple(r)[:5] for r in found], key=repr) == _expected(library, ODD, packing.SIZE)
    _check_layout(found, packing.SIZE)
    assert {r.length for r in found if r.doc_id in (3, 4, 5)} == {1}
    assert packing.query_rows(rows(spark).filter("false")).count() == 0


def test_sequences_hold_the_documents(spark, library):
    data = ODD + [(100 + i, t, "en") for i, t in enumerate(prose(7, 60, words=80))]
    found = packing.sequences(rows(spark, data), size=128).collect()
    ids = {}
    for r in found:
        assert len(r.ids) <= 128 and len(r.ids) == sum(s.length for s in r.spans)
        for s in r.spans:
            ids.setdefault((s.key, s.piece), []).append(r.ids[s.offset : s.offset + s.length])
    for doc_id, text, _ in data:
        whole = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece in range(-(-len(whole) // 128)):
            assert whole[piece * 128 : piece * 128 + 128] in ids[doc_id, piece]


def _brute(lengths, size, limit):
    """Best fit over a plain list of open sequences, oldest first among equals taken last in, first out."""
    free, out, made = [], [], 0
    for n in lengths:
        fits = [(f, -i) for i, (f, _) in enumerate(free) if f >= n]
        if fits:
            f, sequence = free.pop(-min(fits)[1])
        else:
            f, sequence = size, made
            made += 1
        out.append((sequence, size - f))
        if f > n:
            free.append((f - n, sequence))
            if len(free) > limit:
                free.pop(-min((f, -i) for i, (f, _) in enumerate(free))[1])
    return out


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_best_fit_equals_a_plain_search(limit):
    rng = random.Random(limit)
    for lengths in ([rng.randint(1, 64) for _ in range(800)], sorted((rng.randint(1, 64) for _ in range(800)), reverse=True)):
        fit = packing.BestFit(64, limit)
        assert [fit.put(n) for n in lengths] == _brute(lengths, 64, limit)
        assert fit.open <= limit


def test_few_sequences_more_than_the_least(spark):
    rng = random.Random(2)
    parts = spark.createDataFrame([(i, rng.choice([4096, rng.randint(1, 4096), rng.randint(1, 900)])) for i in range(20_000)], "row long, length long")
    found = packing.placed(parts, share=5000).collect()
    least = -(-sum(r.length for r in found) // packing.SIZE)
    assert _check_layout(found, packing.SIZE) <= 1.003 * least and len(found) == 20_000
