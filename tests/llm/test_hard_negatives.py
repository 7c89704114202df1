import random

import numpy as np
import pytest

from stockflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int, part string, rank int"


def _brute(data):
    held = []
    for vec_id, x, label in data:
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        held.append((vec_id, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    out = []
    for a, (anchor, label, v) in enumerate(held):
        if anchor is None or anchor % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), 2**63 if i is None else i, own) for b, (i, own, w) in enumerate(held) if b != a)
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            found = [(n, j) for n, j, own in scored if own != label and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(anchor, None if i == 2**63 else i, r, None if j == 2**63 else j, -s, -n) for r, (n, j) in enumerate(found[:3], 1)]
    return sorted(out, key=repr)


def _data(seed, n=400, dims=6, labels=4):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims)).round(1).tolist()
    data = [(i, v, int(rng.integers(labels))) for i, v in enumerate(vectors)]
    # A vector that a third of all rows have, rows told twice, and zeros.
    data[: n // 3] = [(i, vectors[0], label) for i, _, label in data[: n // 3]]
    data += [(100, vectors[100], 1), (100, vectors[100], 1), (150, [0.0] * dims, 2), (3, vectors[3], 0), (None, vectors[9], 1)]
    data += [(50, None, 1), (51, [1.0] * dims, None), (52, [None] + [1.0] * (dims - 1), 1), (53, [float("nan")] * dims, 1), (54, [float("-inf")] * dims, 1), (55, [], 2), (200, [1.0, 2.0], 2)]
    random.Random(seed).shuffle(data)
    return data


def _table(spark, data):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in data], SCHEMA)


@pytest.mark.parametrize("seed,block,stripe", [(1, 4096, 4096), (2, 30, 3)])
def test_equals_brute_force(spark, seed, block, stripe):
    data = _data(seed)
    found = sorted(map(tuple, hn.mine(_table(spark, data), block=block, stripe=stripe).collect()), key=repr)
    assert len(found) > 50 and found == _brute(data)


def test_large_whole_numbers_are_exact(spark):
    data = [(i, [float(2**21 + (i * 37) % 101), float(-(2**20) + i)], i % 2) for i in range(101)]
    found = sorted(map(tuple, hn.mine(_table(spark, data)).collect()), key=repr)
    assert found == _brute(data) and max(map(lambda r: r[4], found), default=2**60) > 2**53
    with pytest.raises(ValueError, match="64 bits"):
        hn.mine(_table(spark, [(0, [1e30], 1)]))


def test_empty_tables(spark):
    assert hn.mine(_table(spark, []).limit(0)).count() == 0
    assert hn.mine(_table(spark, [(50, None, 1)])).count() == 0


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(3)
    values = rng.integers(-50, 50, size=(4000, 3)).astype(float)
    values[7] = (300, -300, 300)
    lists, anchor = hn.Lists(values), np.array([2.0, -1.0, 1.0])
    (rows, _, threshold), *_ = lists.read(anchor)
    assert 7 in rows and len(rows) <= 3 * hn.FIRST and threshold < 2 * 300 + 300 + 300
    assert hn.top(lists, anchor, np.ones(4000, bool), np.arange(4000), 1)[0].tolist() == [7]
