import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from papyrine.llm import bpe

TEXTS = ["", None, "Hello world's  end\n\n x", "a" * 5000 + "   b", "<|endoftext|> x <|endoftext|>", "naïve 漢字 😀🏽 \t\tx  \n", "Hello world's  end\n\n x", "   ", "x\u0085y᠎z", "don't I'LL we'll 123abc"]


@pytest.mark.parametrize("most", [None, 3, 0])
def test_as_the_library(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(bpe, "MAX_WORDS", most)
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string")
    rows = {r.doc_id: r for r in bpe.encode_decode(df, keep=True).collect()}
    t = Tokenizer.from_file(bpe.vocabulary_path())
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].ids == ids, text
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        out = t.decode(ids, skip_special_tokens=False)
        assert rows[i].decoded == out
        assert rows[i].decoded_sha256 == hashlib.sha256(out.encode()).hexdigest()
    again = spark.createDataFrame([(i, r.ids) for i, r in rows.items()] + [(99, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(again).collect()} == {i: r.decoded for i, r in rows.items()} | {99: None}


def test_each_word_once(spark):
    words = spark.createDataFrame([(["a", " b", "a"],), ([],), (["a", "<|endoftext|>"],)], "words array<string>")
    table = {r.word: (r.n, r.ids) for r in bpe.word_table(words, bpe.vocabulary_path()).collect()}
    assert {w: n for w, (n, _) in table.items()} == {"a": 3, " b": 1, "<|endoftext|>": 1} and table["<|endoftext|>"][1] == [50256]
    made = bpe.word_table(words, bpe.vocabulary_path())
    assert [r.word for r in bpe.frequent(made, 1).collect()] == ["a"] and bpe.frequent(made, 9).count() == 3
    assert {r.word: bytes(r.raw) for r in bpe.spelled(made, bpe.vocabulary_path()).collect()} == {w: w.encode() for w in table}


def test_empty(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
