import pytest
import test_decontamination
import test_lines
import test_neardup
from helpers import ODD, prose
from tokenizers import Tokenizer

import corpus_pipeline
from stockflow.llm import bpe, quality
from stockflow.llm.frames import saved


@pytest.fixture
def tables(spark, tmp_path):
    texts = prose(51, 240, words=120)
    item = " ".join(prose(52, 1, words=60)[0].split()[:40] + ["an", "ending", "of", "its", "own"])
    docs = []
    for i, t in enumerate(texts):
        if i % 6 == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif i % 6 == 1:
            t = t + "\nthis line of boilerplate is in many of the rows\nown line"
        elif i % 12 == 2:
            t = f"{t} {item}"
        elif i % 12 == 5:
            t = texts[i - 1].upper()
        docs.append((i + 100, t, "en", "src", len(t)))
    docs += [(i, t, lang, None, None) for i, t, lang in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i + 100, int(i % 6 > 0), None) for i in range(len(texts))] + [(None, 1, 1), (105, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, item


def _stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), "stage")
        yield before, docs


def test_stages_equal_plain_python(spark, tables):
    sf_dir, docs, item = tables
    out = list(_stages(spark, sf_dir))
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    rows = [sorted(map(tuple, df.select("doc_id", "text").collect()), key=repr) for _, df in out[:-1]]
    assert all(df.columns == columns for _, df in out[:-1])

    # Quality: what the classifier of the operator rejects goes; junk goes and prose stays.
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in quality.query_rows(out[0][0], labels).collect() if r.doc_id is not None and r.doc_id >= 100}
    kept = {i for i, _ in rows[0] if i is not None and i >= 100}
    assert kept == {i for i, p in scored.items() if p} == {i for i in scored if (i - 100) % 6}

    # Lines.
    expected = {(r[0], r[3]) for r in test_lines._brute([(i, t, None) for i, t in rows[0]])}
    import hashlib

    assert {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows[1]} == expected
    assert all(r.n_chars == len(r.text) for r in out[1][1].filter("text IS NOT NULL").collect())

    # Near-duplicates: the smallest id of each component of exact similarity 0.8 stays.
    assert sorted(2**69 if i is None else i for i, _ in rows[2]) == test_neardup._brute([(i, t, None) for i, t in rows[1]])
    assert len(rows[2]) < len(rows[1])

    # Decontamination.
    bad = {i for i, _ in test_decontamination._brute([(i, t, None) for i, t in rows[2]], [(1, item), (2, None)])}
    assert bad and [r for r in rows[2] if r[0] not in bad] == rows[3]

    # Tokens.
    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = {r.doc_id: (r.ids, r.n_tokens, r.round_trip) for r in out[4][1].collect()}
    assert got == {i: (ids := library.encode(t or "", add_special_tokens=False).ids, len(ids), True) for i, t in rows[3]}


def test_run_is_the_chain_of_stages(spark, tables):
    sf_dir, _, _ = tables
    chained = list(_stages(spark, sf_dir))[-1][1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=repr) == sorted(map(tuple, chained.collect()), key=repr)
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_empty_documents(spark, tables, tmp_path):
    sf_dir, _, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
