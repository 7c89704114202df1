import re

import numpy as np
import xxhash
from helpers import ODD, prose, rows

from stockflow.llm import simhash
from stockflow.llm.components import components


def _brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def _brute_components(keys, prints, radius=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(prints))]


def _near_copies():
    texts = prose(5, 60, words=300)
    for n, t in enumerate(texts[:25]):
        words = t.split()
        for j in range(n % 6):
            words[len(words) * j // 6] = f"edit{j}"
        texts.append(" ".join(words))
    return [(i * 7 % 101 + 100, t, "en") for i, t in enumerate(texts)] + ODD


def test_rows_equal_brute_force(spark):
    data = _near_copies()
    prints = [_brute_fingerprint(t) for _, t, _ in data]
    expected = list(zip([k for k, _, _ in data], [f"{p:016x}" for p in prints], _brute_components([k for k, _, _ in data], prints)))
    got = [tuple(r) for r in simhash.query_rows(rows(spark, data)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert len({c for _, _, c in expected}) < len(expected)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = prose(2, 1, words=4000)[0]
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole and whole & (1 << 64) - 1 == _brute_fingerprint(text)


def test_large_shards_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUNDLE", 16)
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 3)
    values = sorted({int(centre[i % 3] ^ np.bitwise_or.reduce(1 << rng.integers(0, 63, 5))) for i in range(300)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "key long, fingerprint long")
    expected = _brute_components(range(len(values)), values)
    for tree in (8, 4096):
        monkeypatch.setattr(simhash.links, "__defaults__", (4, tree))
        assert [r.component_id for r in simhash.labelled(df).orderBy("key").collect()] == expected


def test_trees_follow_edges_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    shard = (values % np.uint64(3)).astype(np.int64)
    trees = simhash.BKTrees(values, shard)
    found = {(int(q), int(n)) for a, b in trees.search(values, shard, 2) for q, n in zip(a, b)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= 2}


def test_chain_of_links(spark):
    chain = spark.range(1, 400).selectExpr("id AS a", "id - 1 AS b")
    assert [r.root for r in components(chain.union(spark.createDataFrame([(900, 905), (None, 3)], "a long, b long"))).groupBy("root").count().orderBy("root").collect()] == [0, 900]


def test_keep_one_row_of_each_group(spark):
    data = _near_copies()
    kept = simhash.keep_one(rows(spark, data))
    assert kept.columns == rows(spark, data).columns
    groups = simhash.query_rows(rows(spark, data)).select("component_id").distinct().count()
    assert kept.count() == groups
    assert simhash.keep_one(rows(spark).filter("false")).count() == 0
