import math
import random
import re
from collections import Counter

import pytest
from helpers import ODD, prose, rows

from stockflow.llm import decontamination as d


def _words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def _bag(w, size):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def _brute(docs, items):
    """Best similarity over all windows of an item's size, for documents and items whose best is at least 0.8."""
    known = {i: _words(t) for i, t in items if _words(t)}
    kinds = {tuple(w) for w in known.values()}
    df = Counter(s for w in kinds for s in _bag(list(w), min(5, len(w))))
    out = {}
    for i, t, _ in docs:
        w = _words(t)
        for item, v in known.items():
            size = min(5, len(v))
            n = min(len(v), len(w))
            if n < size:
                continue
            weight = lambda s: 1 + math.log(len(kinds) / df.get(s, 1)) if s in df else 1 + math.log(len(kinds))
            best = 0
            for start in range(len(w) - n + 1):
                a, b = _bag(w[start : start + n], size), _bag(v, size)
                both = sum(weight(s) * min(a[s], b[s]) for s in a)
                if both:
                    best = max(best, both / (sum(weight(s) * a[s] for s in a) + sum(weight(s) * b[s] for s in b) - both))
            if best >= 0.8:
                out[i, item] = max(out.get((i, item), 0), round(best, 6))
    return out


def _data():
    rng = random.Random(5)
    items = [(i, t) for i, t in enumerate(prose(21, 12, words=60)) if len(t.split()) > 14]
    items += [(100, items[0][1].upper()), (101, "four words in all"), (102, None), (103, "... !"), (104, "a b a b a b a b a b a b a b a b")]
    docs = []
    for i, t in enumerate(prose(22, 50, words=150)):
        words = t.split()
        if i % 2 and (passage := (items[rng.randrange(len(items))][1] or "").split()):
            if i % 6 == 1:
                passage[rng.randrange(len(passage))] = "changed"
            if i % 6 == 3:
                passage = passage[1:]
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((200 + i, " ".join(words), "en"))
    return docs + ODD + [(300, "here are Four, words; in (all)!", "en"), (301, "a b " * 40, "en")], items


def test_matches_equal_brute_force(spark):
    docs, items = _data()
    expected = _brute(docs, items)
    found = {(r.doc_id, r.item_id): r.similarity for r in d.query_rows(rows(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # Windows at the similarity limit may lie beyond the fingerprint radius; none of these do.
    assert len(expected) > 15 and found == pytest.approx(expected)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, items = _data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = sorted(map(tuple, d.query_rows(rows(spark, docs), bench).collect()))
    monkeypatch.setattr(d, "SHIPPED", 0)
    assert sorted(map(tuple, d.query_rows(rows(spark, docs), bench).collect())) == before


def test_no_python_on_the_main_path(spark):
    docs, items = _data()
    plan = d.query_rows(rows(spark, docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_clean_rows_stay(spark):
    docs, items = _data()
    df = rows(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {k[0] for k in _brute(docs, items)}
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _, _ in docs if i not in bad)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert d.query_rows(rows(spark).filter("false"), bench).count() == 0
    assert d.query_rows(rows(spark), bench.filter("false")).count() == 0
    assert d.keep_clean(rows(spark), bench.filter("false")).count() == len(ODD)
