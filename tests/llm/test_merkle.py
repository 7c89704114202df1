import random
from hashlib import sha256
from zlib import crc32

import pytest
from helpers import ODD, prose

from stockflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    fields = (doc_id, source, lang, n_chars + more if n_chars is not None else None, text)
    return _h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def _siblings(levels, i):
    return [(i >> k & 1, level[i >> k ^ 1]) if i >> k ^ 1 < len(level) else None for k, level in enumerate(levels[:-1])]


def _brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, _leaf(row), row))
    names = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    levels = {lang: _levels([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in names}
    top, out = _levels([levels[lang][-1][0] for lang in names]), []
    for t, lang in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(trees[lang], key=lambda x: x[:3])):
            steps = _siblings(levels[lang], i) + _siblings(top, t)
            hit = row[0] is not None and row[3] is not None and crc32(str(row[0]).encode()) % 7 == 0
            node = _leaf(row, 1) if hit else leaf
            for step in steps:
                node = _h(node) if step is None else _h(step[1], node) if step[0] else _h(node, step[1])
            proof = _h(*[s[1] for s in steps if s])
            out.append((row[0], leaf, levels[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(11)
    out = [(k, rng.choice(["web", None, "ß:1"]), rng.choice(["en", "en", "en", None, "", "é", "zz"]), None if text is None else len(text), text) for k, text, _ in ODD]
    out += [(i, "s", rng.choice(["en", "de"]), rng.choice([None, 2**63 - 1, i]), t) for i, t in enumerate(prose(4, 90, words=20))]
    return out + [(5, "s", "only one", 1, "x"), out[-1], out[-1], (7, "a", "en", 1, "x"), (7, "b", "en", 1, "x")]


@pytest.mark.parametrize("bits", [1, 3, merkle.BITS])
def test_equals_brute_force(spark, monkeypatch, bits):
    plain = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda docs: plain(docs, bits=bits))
    rows = _rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, merkle.query_rows(df).collect()), key=repr)
    assert got == _brute(rows) and {r[-1] for r in got} == {True, False}


def test_a_single_row_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, None, None, None, None, "", 0)], SCHEMA)
    assert [tuple(r) for r in merkle.query_rows(df).collect()] == _brute([(1, None, None, None, None)])
    assert merkle.query_rows(df.filter("false")).count() == 0


def test_positions_of_every_size():
    for n in range(1, 70):
        nodes = [str(i) for i in range(n)]
        log, levels = merkle.append(nodes, merkle.height(n)), _levels(nodes)
        assert len(log) == sum(map(len, levels)) and log[-1] == levels[-1][0]
        for k, level in enumerate(levels):
            assert [log[merkle.position(k, i, n)] for i in range(len(level))] == level
        for i in (0, n // 2, n - 1):
            assert merkle.fold(nodes[i], merkle.path(log, i, n, merkle.height(n))) == log[-1]


def test_builders_lie_next_to_each_other_in_the_log(spark):
    leaves = spark.createDataFrame([("t", i, 21, f"{i:064x}") for i in range(21)], "tree string, rank long, n long, leaf string")
    first, *more = merkle.logs(leaves, 2)
    whole = merkle.append([f"{i:064x}" for i in range(21)], merkle.height(21))
    for row in first.collect():
        assert whole[row.start : row.start + len(row.log)] == row.log
    assert more[-1].collect()[0].log[-1] == whole[-1]
