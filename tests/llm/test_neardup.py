import random

import numpy as np
import pytest
from helpers import ODD, prose, rows

import corpus_pipeline
from stockflow.llm import neardup


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def _brute(docs):
    """The smallest id of each component of exact Jaccard similarity 0.8."""
    sets = [_shingles(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 2**70), 2**69 if k is None else k)
    return sorted(least.values())


def _data():
    rng, docs = random.Random(8), []
    for i, t in enumerate(prose(81, 60, words=200, vocabulary=5000)):
        words = t.split()
        docs.append((100 + 10 * i, t, "en"))
        # Copies, and copies of copies, with one to four words changed: similarity from under 0.5 to 0.98.
        for j in range(1, 5):
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
            docs.append((100 + 10 * i + j, " ".join(words), "en"))
    return docs + ODD


def _kept(df):
    return sorted(2**69 if r.doc_id is None else r.doc_id for r in df.collect())


def test_stage_equals_brute_force_jaccard(spark):
    docs = _data()
    df = rows(spark, docs)
    kept = corpus_pipeline.near_duplicates_stage(spark, df, "")
    assert kept.columns == df.columns
    expected = _brute(docs)
    assert 80 < len(expected) < len(docs) - 80 and _kept(kept) == expected


@pytest.mark.parametrize("seed,cell", [(1, neardup.CELL), (2, 3000)])
def test_chains_through_failed_links_are_found(spark, monkeypatch, seed, cell):
    # One wide bucket: similar sets must meet though neither is similar to the bucket's least one.
    monkeypatch.setattr(neardup, "bands", lambda s: (s[:1] & 0).view("int64"))
    monkeypatch.setattr(neardup, "SHIPPED", 0)
    monkeypatch.setattr(neardup, "CELL", cell)
    docs = random.Random(seed).sample(_data()[: -len(ODD)], 60)
    assert _kept(neardup.keep_one(rows(spark, docs))) == _brute(docs)


def test_candidates_at_the_limit():
    rng, missed = random.Random(3), 0
    for _ in range(300):
        common, *own = (np.array([rng.getrandbits(64) for _ in range(n)], np.uint64) for n in (80, 10, 10))
        a, b = (np.concatenate([common, x]) for x in own)
        missed += not set(neardup.bands(a)) & set(neardup.bands(b))
    assert missed == 0


def _groups(sets, root, sides=None):
    """Groups after all links of similarity 4/5, by brute force."""
    root = list(root)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (sides is None or sides[i] != sides[j]) and 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_a_bucket_of_thousands_of_variants():
    rng = random.Random(4)
    text = [rng.randrange(2**40) for _ in range(120)]
    sets = []
    for _ in range(1500):
        # Shingles changed in 2 to 30 of 120 places, some of them the same ones in several variants.
        own = list(text)
        for place in rng.sample(range(120), rng.randint(2, 30)):
            own[place] = 2**50 + place if rng.random() < 0.3 else rng.randrange(2**60, 2**61)
        sets.append(frozenset(own))
    start = [0 if len(s & set(text)) > 108 else i + 1 for i, s in enumerate(sets)]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([np.array(sorted(s)) for s in sets])
    for sides in (None, np.arange(len(sets)) % 2):
        found = neardup.ties(sizes, flat, np.array(start), sides)
        tied = list(start)
        for x, y in found:
            old, new = tied[x], tied[y]
            assert old != new
            tied = [new if r == old else r for r in tied]
        expected = _groups(sets, start, sides)
        assert len({(a, b) for a, b in zip(tied, expected)}) == len(set(tied)) == len(set(expected))
        assert 1 < len(set(expected)) < 1200 and len(found) < len(sets)


def test_links_come_from_the_trees_of_simhash(spark):
    # Without bands: long near copies whose fingerprints differ in a few bits, and an own text.
    words = prose(83, 1, words=800, vocabulary=5000)[0].split()
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(words[1:]), prose(84, 1, words=300)[0]]
    sets = {i + 1: neardup.shingle_set(t) for i, t in enumerate(texts)}
    data = [(i, len(s), [], neardup.print_of(s)) for i, s in sets.items()]
    assert len({r[3] for r in data}) > 2
    different = spark.createDataFrame(data, "bag long, size long, bands array<long>, fingerprint long")
    held = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in sets.items()], "bag long, shingles array<long>")
    found = {frozenset(p) for p in neardup.links(different, lambda bags: held.join(bags, "bag")).collect()}
    assert found and set().union(*found) == {1, 2, 3}
