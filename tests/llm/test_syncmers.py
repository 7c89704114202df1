import hashlib

import numpy as np
import pytest
from helpers import ODD, prose, rows

from stockflow.llm import syncmers


def _data():
    return [(1000 - 3 * i, t, "en") for i, t in enumerate(prose(4, 70, words=120))] + ODD


@pytest.mark.parametrize("bucket", [600, 1 << 30])
def test_rows_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(syncmers, "BUCKET", bucket)
    data = _data()
    order = sorted(((i, t or "") for i, t, _ in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        n = len(t) // 2
        edited = t[: len(t) - n] + after[:n]
        a, b, c = map(syncmers.fingerprint, (t, edited, after))
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.digits(a), syncmers.digits(b), syncmers.likeness(a, b), syncmers.likeness(a, c)))
    got = [tuple(r) for r in syncmers.query_rows(rows(spark, data)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_syncmers_are_chosen_by_their_definition():
    codes = np.frombuffer(prose(6, 1, words=500)[0].encode("utf-32-le"), np.uint32)
    at, _ = syncmers.syncmers(codes, 9, 4)
    inner = [int(syncmers._rolling(codes[i : i + 4], 4)[0]) for i in range(len(codes) - 3)]
    expected = [i for i in range(len(codes) - 8) if min(inner[i : i + 6]) in (inner[i], inner[i + 5])]
    assert at.tolist() == expected


def test_context_free_anchors_survive_insertions_and_blocks(monkeypatch):
    text = prose(7, 1, words=900)[0]
    whole = [(int(a), int(h)) for at, hs in syncmers.text_syncmers(text) for a, h in zip(at, hs)]
    moved = {(int(a) - 5, int(h)) for at, hs in syncmers.text_syncmers("12345" + text) for a, h in zip(at, hs)}
    assert set(whole) <= moved
    monkeypatch.setattr(syncmers, "BLOCK", 37)
    assert [(int(a), int(h)) for at, hs in syncmers.text_syncmers(text) for a, h in zip(at, hs)] == whole


def test_likeness_follows_the_share_of_text():
    a, b = prose(8, 2, words=1)[0], "x"
    long_a, long_b = " ".join(prose(9, 30)), " ".join(prose(10, 30, vocabulary=601))
    print_a, half = syncmers.fingerprint(long_a), syncmers.fingerprint(long_a[: len(long_a) // 2] + long_b[: len(long_a) // 2])
    assert 0.15 < syncmers.likeness(print_a, half) < 0.55 and syncmers.likeness(print_a, syncmers.fingerprint(long_b)) < 0.1
    assert syncmers.likeness(print_a, print_a) == 1 and syncmers.likeness(syncmers.fingerprint(""), syncmers.fingerprint("")) == 1
    assert syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) == 0


def test_anchors_match_passages_at_their_place(spark):
    passage = prose(11, 1, words=200)[0] + " and a fixed end of this passage"
    docs = spark.createDataFrame([(1, "zz " * 50 + passage + " after it"), (2, "nothing in common"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([(7, passage)], "doc_id long, text string")
    found = syncmers.passages(syncmers.anchors(docs), syncmers.anchors(known)).collect()
    assert [(r.left_key, r.right_key, r["shift"]) for r in found] == [(1, 7, 150)]


def test_empty_table_and_single_row(spark):
    assert syncmers.query_rows(rows(spark).filter("false")).count() == 0
    one = syncmers.query_rows(rows(spark).filter("doc_id = 8")).first()
    assert one.near_next == 1 and one.n_chars == 5000
    assert syncmers.with_fingerprint(rows(spark)).columns == rows(spark).columns
