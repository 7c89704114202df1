import random
from collections import defaultdict

import numpy as np
from helpers import ODD, prose, rows

from stockflow.llm import chunks


def _pieces(text):
    text, start, at, out = text or "", 0, 0, []
    for end in chunks.cuts(text):
        out.append((at, text[start:end].encode()))
        start, at = end, at + len(out[-1][1])
    return out


def _data():
    rng = random.Random(4)
    shared = [" ".join(t.split()[:60]) for t in prose(31, 40, words=200) if len(t.split()) >= 60][:6]
    out = []
    for i, t in enumerate(prose(32, 60, words=300, vocabulary=4000)):
        if i % 2:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + " " + rng.choice(shared) + " " + t[at:]
        out.append((100 + i, t, "en"))
    return out + ODD, shared


def _brute(data):
    """Spans of each document by (id, text), from sets of pieces."""
    docs = {(i, t or "") for i, t, _ in data}
    holders = defaultdict(set)
    for d in docs:
        for _, p in _pieces(d[1]):
            holders[p].add(d[0])
    spans = defaultdict(list)
    for d in docs:
        run = []
        for start, p in [*_pieces(d[1]), (None, b"")]:
            if start is not None and len(holders[p]) > 1:
                run.append((start, p))
                continue
            if sum(chunks.n_words(x.decode()) for _, x in run) >= chunks.WORDS:
                spans[d[0]].append((run[0][0], run[-1][0] + len(run[-1][1])))
            run = []
    return {k: sorted(v) for k, v in spans.items()}


def test_rows_equal_brute_force_and_passages_are_found(spark):
    data, shared = _data()
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in chunks.query_rows(rows(spark, data)).collect()}
    assert got == _brute(data)
    held = [[i for i, t, _ in data if s in (t or "")] for s in shared]
    expected = {i for group in held if len(group) > 1 for i in group}
    assert expected and expected <= set(got) and not {i for i in got if i is not None and i >= 100} - expected


def test_dropping_keeps_one_copy_and_round_trips(spark):
    data, shared = _data()
    df = rows(spark, data)
    out = chunks.dedup(df)
    assert out.columns == df.columns and out.count() == len(data)
    texts = [r.text or "" for r in out.collect()]
    for s in shared:
        middle = s[len(s) // 2 - 40 : len(s) // 2]
        assert sum(middle in t for t in texts) == min(1, sum(s in (t or "") for _, t, _ in data))
    clean = {r.doc_id for r in chunks.query_rows(df).collect()}
    before = sorted(((i, t) for i, t, _ in data if i not in clean), key=repr)
    assert sorted(((r.doc_id, r.text) for r in out.collect() if r.doc_id not in clean), key=repr) == before


def test_cuts_cover_the_text_and_do_not_depend_on_blocks(monkeypatch):
    texts = prose(33, 20) + ["é漢😀 ß" * 400, "x" * 3000, "😀" * 700, "", "short"]
    whole = [chunks.cuts(t) for t in texts]
    for t, ends in zip(texts, whole):
        assert (ends[-1] if ends else 0) == len(t) and ends == sorted(set(ends))
        assert all(b - a <= chunks.MOST for a, b in zip([0, *ends], ends))
    monkeypatch.setattr(chunks, "BLOCK", 97)
    assert [chunks.cuts(t) for t in texts] == whole


def test_gear_hash_rolls(monkeypatch):
    data = np.frombuffer(prose(34, 1)[0].encode()[:200], np.uint8)
    monkeypatch.setattr(chunks, "MEMORY", 32)
    h, out = 0, []
    for b in data:
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    assert chunks.gear_hashes(data).tolist() == out


def test_insertions_shift_no_more_than_nearby_chunks():
    text = " ".join(prose(35, 8, vocabulary=3000))
    a, b = ({p for _, p in _pieces(t)} for t in (text, text[:700] + "inserted words" + text[700:]))
    assert len(a - b) <= 3


def _found(letters, sizes, amount, gap, seed=7):
    """Share of passages, each in two texts of their own, whose runs of shared pieces reach the limit."""
    rng = random.Random(seed)

    def text(n):
        return gap.join("".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n))

    found = 0
    for _ in range(200):
        passage = text(amount)
        a, b = (_pieces(text(amount) + gap + passage + gap + text(amount)) for _ in "ab")
        common, run, best = {p for _, p in a} & {p for _, p in b}, 0, 0
        for _, p in a:
            run = run + chunks.n_words(p.decode()) if p in common else 0
            best = max(best, run)
        found += best >= chunks.WORDS
    return found / 200


def test_passages_are_found_in_every_script():
    latin, chinese = "etaoinshrdlucmfw", [chr(0x4E00 + 7 * i) for i in range(900)]
    assert _found(latin, range(2, 10), 51, " ") >= 0.99
    assert _found([chr(0x430 + i) for i in range(32)], range(2, 10), 51, " ") >= 0.99
    assert _found(chinese, [1], 200, "") >= 0.99
    assert _found([chr(0xE01 + i) for i in range(46)], [1], 250, "") >= 0.99
    assert 0.8 <= _found(latin, range(2, 6), 51, " ")  # short words: the ends lost weigh more


def test_texts_without_spaces(spark):
    rng = random.Random(8)
    shared = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(200))
    texts = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(300)) for _ in range(6)]
    texts[1], texts[4] = texts[1] + shared + texts[2], shared + texts[5] + "。"
    data = [(i, t, "zh") for i, t in enumerate(texts)]
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in chunks.query_rows(rows(spark, data)).collect()}
    assert got == _brute(data) and {1, 4} <= set(got)


def test_empty_table(spark):
    assert chunks.query_rows(rows(spark).filter("false")).count() == 0
    assert chunks.dedup(rows(spark)).count() == len(ODD)
