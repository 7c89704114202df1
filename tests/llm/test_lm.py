import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import ODD, prose, rows

from stockflow.llm import lm


def _data():
    return [(100 + i, t, "en") for i, t in enumerate(prose(61, 60, words=200, vocabulary=300))] + ODD


def _brute(data, vocabulary=None):
    vocabulary = vocabulary or lm.VOCABULARY
    texts = [[xxhash.xxh64_intdigest(w) & (vocabulary - 1) for w in re.findall(r"[^\W_]+", (t or "").lower())] for _, t, _ in data]
    words, pairs = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(words.values()), []
    for (i, _, _), t in zip(data, texts):
        own, seen, score = Counter(zip(t, t[1:])), 0, 0.0
        for (a, b), n in own.items():
            elsewhere = pairs[a, b] - n
            seen += n * (elsewhere > 0)
            score += n * math.log(elsewhere / words[a] if elsewhere else lm.BACKOFF * words[b] / total)
        out.append((i, len(t), seen, score))
    return out


@pytest.mark.parametrize("partition, frequent, size", [(2_000_000, 1024, 16 << 20), (500, 20, 2000), (3000, 0, 16 << 20)])
def test_rows_equal_brute_force(spark, monkeypatch, partition, frequent, size):
    monkeypatch.setattr(lm, "PARTITION", partition)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SLICE", size)
    data = _data()
    got = sorted(((r.doc_id, r.n_words, r.n_seen, r.log_score) for r in lm.scores(rows(spark, data)).collect()), key=repr)
    expected = sorted(_brute(data), key=repr)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert np.allclose([r[3] for r in got], [r[3] for r in expected], rtol=1e-9)


def test_words_of_long_texts_are_read_in_blocks(monkeypatch):
    text = prose(62, 1, words=500)[0]
    whole = lm.Words().places(text)
    monkeypatch.setattr(lm, "BLOCK", 7)
    monkeypatch.setattr(lm, "MEMORY", 5)
    assert lm.Words().places(text).tolist() == whole.tolist()


def test_copies_score_higher_than_noise(spark):
    data = [(i, t, "en") for i, t in enumerate(prose(63, 20, words=300, vocabulary=500))]
    noise = " ".join(f"q{i}x" for i in range(200))
    data += [(100, data[0][1], "en"), (101, noise, "en")]
    mean = {r.doc_id: r.mean_log_score for r in lm.query_rows(rows(spark, data)).collect()}
    assert mean[100] == mean[0] > mean[1] > mean[101]


def test_empty_and_wordless_tables(spark):
    assert lm.query_rows(rows(spark).filter("false")).count() == 0
    found = lm.query_rows(spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "!")], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_seen, r.log_score, r.mean_log_score) for r in found) == [(0, 0, 0, 0)] * 3 + [(1, 0, 0, 0)]
    assert len(ODD) == lm.query_rows(rows(spark)).count()
