import random
import re
import zlib

import numpy as np
import pytest
from helpers import ODD, prose, rows

from stockflow.llm import toxicity

BAD = ["grobvit", "snarlok", "moltepp"]


def _data(n=500):
    rng, out, labels = random.Random(9), [], []
    for i, t in enumerate(prose(81, n, words=90)):
        words, bad = t.split(), i % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD) + rng.choice(["", "ed", "s", "ing"]))
        out.append((100 + i, " ".join(words) + ".", "en"))
        labels.append((100 + i, int(bad)))
    copies = [(10_000 + i, out[0][1], "en") for i in range(40)]
    return out + copies, labels + [(i, 1) for i, _, _ in copies]


@pytest.fixture(scope="module")
def scored(spark):
    data, labels = _data()
    known = spark.createDataFrame(labels + [(None, 1), (101, None)], "doc_id long, toxic int")
    df = rows(spark, data + ODD)
    return toxicity.query_rows(df, known).cache(), dict(labels), df, known


def test_held_out_rows_are_told_apart(scored):
    found, labels, _, _ = scored
    held = [(labels[r.doc_id], r.predicted, r.score) for r in found.collect() if r.held_out and 100 <= (r.doc_id or 0) < 10_000]
    assert len(held) > 80 and np.mean([y == p for y, p, _ in held]) >= 0.97


def test_every_row_has_a_score(scored):
    found, _, df, _ = scored
    got = found.collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1


def test_lexicon_learns_stems_and_not_the_words_of_copies(spark):
    data, labels = _data()
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    entries = toxicity.fit(rows(spark, data), known).entries
    reader = toxicity.Reader(entries)
    assert all(chr(reader.symbol(w + "xyz")) in "ws" for w in BAD)
    prose_words = {w for t in prose(81, 500, words=90) for w in t.split()}
    assert np.mean([chr(reader.symbol(w)) in "ws" for w in prose_words]) < 0.02


def _rules(symbols):
    """What the grammar should put out, from its description, symbol by symbol."""
    out, quoted, report, deny, aim, threat = [], False, False, 0, 0, (None, 0)
    for s in symbols:
        if s == "r":
            if not quoted:
                report = True
            s = "." if not quoted else "r"
        elif s == "q" and (report or quoted):
            quoted, report, s = not quoted, False, "."
        elif s == "q":
            s = "."
        elif quoted and s in "wsT":
            s = "Q" if s in "ws" else "."
        if s == "n":
            deny, s = 2, "."
        elif s in "ws" and deny:
            deny, s = 0, "D"
        else:
            deny = max(deny - 1, 0)
        if s == "t":
            aim = 4
        elif s in "ws" and aim:
            aim, s = aim - 1, s.upper()
        else:
            aim = max(aim - 1, 0)
        kind, left = threat
        if s == "t":
            s, threat = ("H" if kind == "T" else "."), ("t", 4)
        elif s == "T":
            s, threat = ("H", (None, 0)) if kind == "t" else (".", ("T", 4))
        else:
            threat = (kind, left - 1) if left > 1 else (None, 0)
        out.append(s)
    return out


def test_composed_machine_follows_the_rules():
    to, out = toxicity.grammar()
    rng = random.Random(4)
    for _ in range(3000):
        symbols = [rng.choice("..wsTtnrqq") for _ in range(rng.randint(1, 14))]
        state, got = 0, []
        for s in symbols:
            i = toxicity.SYMBOLS.index(s)
            got.append(chr(out[state][i]))
            state = to[state][i]
        assert [x if x in "wsWSDQH" else "." for x in got] == [x if x in "wsWSDQH" else "." for x in _rules(symbols)], symbols


def test_clauses_not_words_are_counted():
    reader = toxicity.Reader({"grobvit$": 2})
    kinds = dict(zip([*toxicity.OUTPUTS, "words"], range(99)))

    def counts(text):
        return {k: int(reader.counts(text)[i]) for k, i in kinds.items() if k != "words" and reader.counts(text)[i]}

    assert counts("the grobvit and grobvit here. another grobvit") == {"strong": 2}
    assert counts("you are a grobvit") == {"aimed strong": 1}
    assert counts("it is not a grobvit") == {"denied": 1}
    assert counts('someone said "a grobvit" there') == {"quoted": 1}
    assert counts("kill all of them") == {"threat": 1}
    assert counts("GROBVITS and nothing else") == {}


def test_blocks_do_not_cut_clauses(monkeypatch):
    reader = toxicity.Reader({"grobvit$": 2})
    text = " ".join(f"you are one grobvit {w}." if i % 3 else w for i, w in enumerate(prose(82, 1, words=400)[0].split()))
    whole = reader.counts(text).tolist()
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    monkeypatch.setattr(toxicity, "MEMORY", 10)
    assert toxicity.Reader({"grobvit$": 2}).counts(text).tolist() == whole
    assert re.search("grobvit", text)


@pytest.mark.parametrize("labels", [[], [(100, 1)], [(101, 0), (102, 0)]])
def test_without_both_labels_every_score_is_the_same(spark, labels):
    data, _ = _data(10)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r.score for r in toxicity.query_rows(rows(spark, data + ODD), known).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1


def test_empty_table(spark, scored):
    _, _, df, known = scored
    assert toxicity.query_rows(df.filter("false"), known).count() == 0
    assert toxicity.with_score(df, toxicity.Model({}, np.zeros(3 * len(toxicity.OUTPUTS)), 0.0)).columns == df.columns
