import random

import pytest
from helpers import prose, rows
from test_decontamination import _brute

from stockflow.llm import decontamination as d


def test_swapped_boilerplate_is_found(spark):
    # Two templates over own words; the documents hold an item's own words under the other template.
    rng = random.Random(4)
    heads = [" ".join(prose(s, 9, words=90)).split()[:20] for s in (31, 32)]
    items, docs = [], []
    for i in range(100):
        own = [f"own{rng.randrange(10**9)}" for _ in range(85)]
        items.append((i, " ".join(heads[i % 2] + own)))
        docs.append((1000 + i, " ".join(heads[1 - i % 2] + own), "en"))
    docs = docs[:60]
    expected = _brute(docs, items)
    found = {(r.doc_id, r.item_id): r.similarity for r in d.query_rows(rows(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(expected) == 60 and found == pytest.approx(expected)
