import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from papyrine.llm import bpe, mixing, quality
from papyrine.llm.simhash import shingle_set
from tests.llm.test_simhash import brute_components, brute_fp
from tests.llm.test_substrings import brute

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(160):
        t = " ".join(word() for _ in range(rng.integers(40, 90)))
        texts.append(t + ". " + passage + " end" if i % 20 == 3 else t + ".")
    texts += [" ".join(t.upper() + "!!" for t in x.split()) for x in texts[:40]]
    texts += texts[10:20] + [texts[10] + "\n"]
    rows = [(i, t, "en", "a" if i % 3 else "bc"[i % 2], len(t)) for i, t in enumerate(texts)]
    labels = [(i, 0 if 160 <= i < 200 else 1, 0) for i in range(200)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_against_brute_force(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = STAGE["quality"](spark, docs, path)
    assert good.columns == COLUMNS
    x, y = quality.training_rows(docs, spark.read.parquet(f"{path}/labels.parquet"))
    model = quality.fit(x, y)
    own = sorted(tuple(r) for r in good.collect())
    assert own == [r for r in rows if model.score(quality.features([r[1]]))[0] >= 0.3]
    assert {r[0] for r in own} == set(range(160)) | set(range(200, 211))
    one = STAGE["near_duplicates"](spark, good, path)
    assert one.columns == COLUMNS
    fps = {r[0]: brute_fp(r[1], 5) for r in own}
    sets = {r[0]: set(shingle_set(r[1], 5).tolist()) for r in own}
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and near(a, b)])
    kept = sorted(tuple(r) for r in one.collect())
    assert kept == [r for r in own if comp[r[0]] == r[0]]
    cut = STAGE["substrings"](spark, one, path)
    assert cut.columns == COLUMNS
    units = [r[1].split() for r in kept]
    gone = brute(units, 35)
    want = []
    for r, u, g in zip(kept, units, gone):
        t = " ".join(w for k, w in enumerate(u) if k not in g) if g else r[1]
        if len(g) < len(u):
            want.append((r[0], t, *r[2:4], len(t)))
    assert sorted(tuple(r) for r in cut.collect()) == want
    assert sum(map(bool, gone)) == 8
    mixed = STAGE["mixing"](spark, cut, path)
    assert mixed.columns == COLUMNS
    made, _, _ = mixing.plan(cut, passes=corpus_pipeline.PASSES, whole=True)
    passes = {r._source: r.passes for r in made.collect()}
    n = {}
    for r in mixed.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert set(n) == {w[0] for w in want}
    for w in want:
        assert int(passes[w[3]]) <= n[w[0]] <= int(passes[w[3]]) + 1
    assert max(passes.values()) <= corpus_pipeline.PASSES + 1e-6 and min(passes.values()) >= 1
    t = Tokenizer.from_file(bpe.vocabulary_path())
    text = {w[0]: w[1] for w in want}
    for r in STAGE["tokens"](spark, mixed, path).collect():
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 150
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
