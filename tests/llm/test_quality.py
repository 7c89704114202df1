import random

import numpy as np
import pytest
from helpers import ODD, prose, rows

from stockflow.llm import quality
from stockflow.llm.labelled import fold, sample


def _data(n=400):
    rng, out, labels = random.Random(7), [], []
    for i, t in enumerate(prose(71, n, words=90)):
        bad = i % 5 == 0
        if bad:
            words = t.split()
            kind = rng.randrange(4)
            t = {
                0: lambda: " ".join(w.upper() + "!!" for w in words),
                1: lambda: " | ".join(words),
                2: lambda: " ".join(w + "***" for w in words),
                3: lambda: " ".join(w for w in words[:5] for _ in range(12)),
            }[kind]()
        out.append((100 + i, t, "en"))
        labels.append((100 + i, int(not bad), 0))
    return out, labels


@pytest.fixture(scope="module")
def scored(spark):
    data, labels = _data()
    known = spark.createDataFrame(labels + [(None, 1, 1), (100, 0, None), (101, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    df = rows(spark, data + ODD)
    return quality.query_rows(df, known).cache(), dict((i, q) for i, q, _ in labels), df, known


def test_held_out_rows_are_told_apart(scored):
    found, labels, _, _ = scored
    held = [(labels[r.doc_id], r.predicted) for r in found.collect() if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([y == p for y, p in held]) >= 0.97


def test_every_row_has_a_score_and_folds_follow_the_key(spark, scored):
    found, _, df, _ = scored
    got = found.collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1


def test_learning_repeats(scored):
    found, _, df, known = scored
    again = quality.query_rows(df.repartition(5), known)
    assert sorted((repr(r.doc_id), round(r.score, 3)) for r in again.collect()) == sorted((repr(r.doc_id), round(r.score, 3)) for r in found.collect())


def test_held_out_labels_are_never_read(spark, scored):
    found, _, df, known = scored
    from pyspark.sql import functions as F

    other = known.withColumn("quality", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sample(df, other, "quality", 5, 0, 10_000).exceptAll(sample(df, known, "quality", 5, 0, 10_000)).count() == 0
    assert sample(df, known, "quality", 5, 0, 50).count() <= 50


@pytest.mark.parametrize("labels", [[], [(100, 1)], [(101, 0), (102, 0)]])
def test_without_both_labels_scores_are_the_smoothed_share(spark, labels):
    data, _ = _data(10)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    ones, n = sum(q for _, q in labels), len(labels)
    scores = {r.score for r in quality.query_rows(rows(spark, data + ODD), known).collect()}
    assert len(scores) == 1 and scores.pop() in [pytest.approx((o + 1) / (m + 2)) for o, m in ((ones, n), (0, 0), (ones, n - 1))]


def test_pooling_does_not_depend_on_blocks(monkeypatch):
    table = np.random.default_rng(1).normal(size=(quality.FORMS, 4)).astype(np.float32)
    text = " ".join(prose(72, 1, words=300)[0].split() + ["again", "again", "again"])
    whole = quality.pooled(quality.Forms(), text, table)
    monkeypatch.setattr(quality, "BLOCK", 3)
    monkeypatch.setattr(quality, "MEMORY", 4)
    assert np.allclose(quality.pooled(quality.Forms(), text, table), whole)


def test_context_vectors_equal_a_plain_sum():
    index = quality.index_vectors()
    text = "One two, three two one! TWO two"
    (block,) = quality.Forms().blocks(text)
    expected = np.zeros((quality.FORMS, quality.DIMENSIONS))
    for i, own in enumerate(block):
        for j in range(max(0, i - quality.REACH), min(len(block), i + quality.REACH + 1)):
            if i != j:
                for a in own:
                    expected[a] += index[block[j]].sum(0)
    assert np.allclose(quality.context_sums(iter([block])), expected)


def test_columns_stay_and_empty_table(spark, scored):
    _, _, df, known = scored
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert quality.query_rows(df.filter("false"), known).count() == 0
