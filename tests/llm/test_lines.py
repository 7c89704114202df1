import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from helpers import ODD, rows

from stockflow.llm import lines


def _data(seed=1, n=80):
    rng = random.Random(seed)
    common = [f"a line of boilerplate number {i} that many documents share" for i in range(12)] + ["short line", "naïve ß lïne wïth 20", "éééééééééé"]
    out = []
    for i in range(n):
        body = [rng.choice([rng.choice(common), rng.choice(common).upper(), "  " + rng.choice(common) + "\t\r", f"only line of row {i} and {rng.random()}", ""]) for _ in range(rng.randint(0, 9))]
        out.append((i + 100, "\n".join(body), "en"))
    return out + ODD


def _key(line):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    return key if len(key) >= 20 else None


def _brute(data):
    count, largest = Counter(), {}
    for i, t, _ in data:
        for k in {_key(x) for x in (t or "").split("\n")} - {None}:
            count[k] += 1
            largest[k] = i if k not in largest else max([x for x in (largest[k], i) if x is not None], default=None)
    out = []
    for i, t, _ in data:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not ((k := _key(x)) and count[k] >= 3 and largest[k] != i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_rows_equal_brute_force(spark):
    data = _data()
    assert sorted(map(tuple, lines.query_rows(rows(spark, data)).collect()), key=repr) == _brute(data)


def test_beyond_the_shipping_bound_the_result_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHIPPED", 0)
    data = _data(2)
    assert sorted(map(tuple, lines.query_rows(rows(spark, data)).collect()), key=repr) == _brute(data)


def _dedup(spark, index, data):
    df = lines.dedup(rows(spark, data), index)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=repr)


def test_insertion_and_deletion_are_exact_and_undo_each_other(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 4)
    data = _data(3, 60)
    first, more = data[:40], data[40:60]
    start = lines.build(rows(spark, first))
    both = lines.insert(start, rows(spark, more))
    assert _dedup(spark, both, first + more) == _brute(first + more)
    back = lines.delete(both, rows(spark, more).select("doc_id"))
    assert _dedup(spark, back, first) == _brute(first)
    assert sorted(map(tuple, back.counts.collect()), key=repr) == sorted(map(tuple, start.counts.collect()), key=repr)


def test_cuckoo_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, (20_000, 2))
    shard = np.arange(len(keys)) % 3
    cuckoo = lines.Cuckoo(np.array([lines._capacity(7000)] * 3))
    assert cuckoo.add(keys, shard) and cuckoo.contains(keys, shard).all()
    other = rng.integers(-(2**63), 2**63, (20_000, 2))
    assert cuckoo.contains(other, shard).mean() < 0.002
    cuckoo.remove(keys[:9000], shard[:9000])
    assert cuckoo.contains(keys[9000:], shard[9000:]).all() and cuckoo.contains(keys[:9000], shard[:9000]).mean() < 0.01
    cuckoo.remove(keys[9000:], shard[9000:])
    assert not cuckoo.slots.any()
    assert not lines.Cuckoo(np.array([4])).add(keys[:100], np.zeros(100, np.int64)) and len(lines.built(keys[:100]))


def test_columns_empty_table_and_null_texts(spark):
    df = rows(spark)
    out = lines.drop_lines(df)
    assert out.columns == df.columns and out.filter("text IS NULL").count() == df.filter("text IS NULL").count()
    assert lines.query_rows(df.filter("false")).count() == 0
    assert defaultdict(int, {r.doc_id: r.n_lines for r in lines.query_rows(df).collect()})[3] == 1
