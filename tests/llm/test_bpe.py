import hashlib
import random

from helpers import ODD, prose, rows
from tokenizers import Tokenizer

from stockflow.llm import bpe


def _reference():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_ids_equal_the_library_on_random_strings():
    encoder, library, rng = bpe.Encoder(bpe.load(bpe.vocabulary_path())), _reference(), random.Random(3)
    pieces = ["a", "the", " ", "  ", "\n", "é", "ß", "<|endoftext|>", "😀", "՘", "\x1c", "12", "'s", "'ll", "....", "漢字", "<|", "z" * 70, "ab" * 300]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode_all(texts)] == expected
    assert [encoder.encode(t).tolist() for t in texts] == expected


def test_long_text_is_read_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "MEMORY", 20)
    encoder, text = bpe.Encoder(bpe.load(bpe.vocabulary_path())), " ".join(prose(1, 5))
    assert encoder.encode_all([text, None, "", "a b"])[0].tolist() == _reference().encode(text, add_special_tokens=False).ids


def test_digests_and_round_trip(spark):
    library = _reference()
    got = sorted(map(tuple, bpe.digests(rows(spark)).collect()), key=repr)
    expected = []
    for doc_id, text, _ in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        assert decoded == (text or "")
    assert got == sorted(expected, key=repr)


def test_clashing_columns_are_replaced_and_others_stay(spark):
    out = bpe.encode(rows(spark))
    assert out.columns == rows(spark).columns and out.schema["ids"].dataType.simpleString() == "array<int>"


def test_broken_bytes_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([([50256, 64],), ([447],), (None,), ([],)], "ids array<int>")
    library = _reference()
    assert [r.decoded for r in bpe.decode(df).collect()] == ["<|endoftext|>" + library.decode([64]), library.decode([447]), "", ""]
    assert bpe.digests(rows(spark).filter("false")).count() == 0
