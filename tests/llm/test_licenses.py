import random
import re

from helpers import ODD, prose, rows

from stockflow.llm import licenses
from stockflow.llm.license_texts import TEMPLATES


def _lcs(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
        before = row
    return before[-1]


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _data():
    rng, names = random.Random(3), list(TEMPLATES)
    out, planted = [], {}
    for i, t in enumerate(prose(41, 60, words=150)):
        if i % 2:
            name = names[rng.randrange(len(names))]
            notice = TEMPLATES[name].upper() if i % 4 == 1 else TEMPLATES[name].replace(" ", "\n * ")
            words = t.split()
            words.insert(rng.randrange(len(words) + 1), notice)
            t = " ".join(words)
            planted[100 + i] = name
        out.append((100 + i, t, "en"))
    return out + ODD, planted


def test_planted_notices_are_found_whole(spark):
    data, planted = _data()
    found = {(r.doc_id, r.license): r for r in licenses.query_rows(rows(spark, data)).collect()}
    texts = {i: t for i, t, _ in data}
    assert set(found) == set(planted.items())
    for (i, name), r in found.items():
        assert r.coverage == 1 and _words(texts[i][r.start : r.end]) == _words(TEMPLATES[name])


def test_edited_notices_keep_the_coverage_of_a_full_alignment():
    rng, scanner = random.Random(8), licenses.Scanner(TEMPLATES)
    for name in ("MIT", "Apache-2.0", "BSD"):
        words = TEMPLATES[name].split()
        for _ in range(6):
            edited = list(words)
            for _ in range(4):
                at = rng.randrange(5, len(edited) - 5)
                edited[at : at + 1] = rng.choice([[], ["changed"], [edited[at], "added"]])
            text = " ".join(prose(9, 1)[0].split() + edited + prose(10, 1)[0].split())
            best = {r[0]: r for r in scanner.scan(text)}[name]
            full = _lcs(_words(TEMPLATES[name]), _words(" ".join(edited)))
            assert full - 3 <= best[2] <= full and best[1] >= 0.8


def test_winnowing_guarantee():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        run = rng.integers(0, 50, licenses.GRAM + licenses.WINDOW - 1).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 50, 20).astype(np.uint64), run, rng.integers(0, 50, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 50, 7).astype(np.uint64), run, rng.integers(0, 50, 30).astype(np.uint64)])
        x, y = (set(h[licenses.winnowed(h)].tolist()) for h in (licenses.grams(a, 3), licenses.grams(b, 3)))
        assert x & y


def test_long_texts_are_scanned_in_blocks(monkeypatch):
    scanner = licenses.Scanner(TEMPLATES)
    text = " ".join(f"{p} {TEMPLATES[n]}" for p, n in zip(prose(42, 12, words=60), TEMPLATES))
    whole = scanner.scan(text)
    monkeypatch.setattr(licenses, "BLOCK", 700)
    assert scanner.scan(text) == whole and len(whole) == 12


def test_short_template_empty_table_and_no_templates(spark):
    df = spark.createDataFrame([(1, "it is Public Domain here"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.start, r.end) for r in licenses.scan(df, {"PD": "public domain"}).collect()] == [(1, "PD", 6, 19)]
    assert licenses.scan(df, {}).count() == 0
    assert licenses.query_rows(rows(spark).filter("false")).count() == 0 and licenses.query_rows(rows(spark, ODD)).count() == 0
