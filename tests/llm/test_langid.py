import collections
import math
import zlib

import numpy as np
import pytest

from papyrine.llm import langid

N = langid.ORDER


def stream(text):
    out, word = [" "], False
    for c in text or "":
        if c.isalpha():
            out.append(c.lower())
        elif out[-1] != " ":
            out.append(" ")
    if out[-1] != " ":
        out.append(" ")
    return [" "] * (N - 2) + out


def brute(texts):
    """The same model, from its definition: a function of a gram."""
    grams = collections.Counter(tuple(s[k : k + N]) for s in map(stream, texts) for k in range(len(s) - N + 1))
    levels = {N: grams}
    for k in range(N - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    alphabet = len({c for g in grams for c in g}) + 1

    def p(g):
        if not g:
            return 1 / alphabet
        n = levels[len(g)]
        ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        own = {h: v for h, v in n.items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        return p(g[1:]) if not total else max(0, own.get(g, 0) - d if g in own else 0) / total + d * len(own) / total * p(g[1:])

    return p


def test_model_is_kneser_ney():
    texts = ["The cat sat on the mat.", "a cat, a hat; THE END", "é é 12 ça"]
    columns, _ = langid.windows(*langid.normalised(texts))
    rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    table = langid.kneser_ney(rows, n, len(np.unique(rows)) + 1)
    p = brute(texts)
    for text in ["the cat", "zebra", "q", "ça end"]:
        s = stream(text)
        want = sum(math.log(p(tuple(s[k : k + N]))) for k in range(len(s) - N + 1)) / (len(s) - N + 1)
        got = langid.Scorer(langid.Model(["x"], [table]))(["other", text])[1, 0]
        assert got == pytest.approx(want)
    whole = [p(("t", "h", "e", c)) for c in {c for g in map(stream, texts) for c in g}]
    assert sum(whole) <= 1.0001


WORDS = {"a": ["la", "maison", "est", "très", "belle"], "b": ["das", "haus", "ist", "sehr", "schön"], "c": ["the", "house", "is", "very", "nice"]}


def data(spark, n=240):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        lang = "abc"[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang], 12)), lang if i % 7 else None, 0.5))
    rows += [(1000, None, "a", 0.5), (1001, "12 34!", "a", 0.5), (1002, "", None, 0.5), (None, "la maison est belle", "c", 0.5), (1003, "é", None, 0.5), (1004, "Haus " * 40000, None, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_predictions(spark):
    docs = data(spark)
    model = langid.train(docs)
    assert model.langs == ["a", "b", "c"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == 246
    for i in range(240):
        assert got[i].lang_pred == "abc"[i % 3] and 0.5 < got[i].score <= 1
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[None].lang_pred == "a" and got[1004].lang_pred == "b"
    assert got[1003].lang_pred in "abc"


def test_training_rows(spark):
    docs = data(spark)
    rows = langid.sample(docs).collect()
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 4 != 2 and i % 7 > 0 for i in range(240)) + sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1001,))
    assert len(langid.sample(docs, 10).collect()) < 70


def test_nothing_learnt(spark):
    docs = data(spark)
    model = langid.train(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_rare_languages_are_learnt(spark):
    docs = spark.createDataFrame([(i, "l%d" % i, "some words of it") for i in range(60)], "doc_id long, lang string, text string")
    rows = langid.sample(docs).collect()
    assert len(rows) > 30 and not any(r.held_back for r in rows)
    docs = spark.createDataFrame([(i, "one", "some words of it") for i in range(300)], "doc_id long, lang string, text string")
    assert any(r.held_back for r in langid.sample(docs).collect())
