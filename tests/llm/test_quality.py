import zlib

import numpy as np

from papyrine.llm import quality


def brute_pairs(text):
    raw = (text or "").encode()
    out = np.zeros(quality._N**2)
    k = [quality._TABLE[b] for b in raw + b"\n"] if raw else []
    for a, b in zip(k, k[1:]):
        out[a * quality._N + b] += 1
    return np.sqrt(out / max(1, len(raw)))


def test_features_do_not_depend_on_neighbours():
    texts = ["", "Hello, world!\nHello, world!\n", None, "é😀 x | y", "A" * 3000, " ", "\n\n", "a b a b"]
    x = quality.features(texts)
    for k, t in enumerate(texts):
        assert np.allclose(x[k], quality.features([t])[0])
        assert np.allclose(x[k, : quality._N**2], brute_pairs(t), atol=1e-6)
    assert np.allclose(x[7, -8:][[4]], [0.5]) and np.allclose(x[1, -8:][[5]], [0.5])


def data(spark, n=300):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(60)]
        rows.append((i, " ".join(words) + "." if good else "!! ".join(w.upper() for w in words), "x"))
        labels.append((i, int(good), 0))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "some text", "x"), (5, rows[5][1], "x")]
    labels += [(3, 1, 0), (None, 0, 0), (7, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = data(spark)
    x, y = quality.training_rows(docs, labels)
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [*range(300), 5])
    model = quality.fit(x, y, pairs=3000)
    got = quality.classify(docs, model, ["doc_id"]).collect()
    assert len(got) == 304
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.predicted == (r.doc_id % 4 > 0)


def test_degenerate(spark):
    docs, labels = data(spark, 12)
    for rows in (labels.where("false"), labels.where("quality = 1")):
        model = quality.fit(*quality.training_rows(docs, rows), pairs=10)
        assert len({r.score for r in quality.classify(docs, model, ["doc_id"]).collect()}) == 1
    assert quality.classify(docs.where("false"), model, ["doc_id"]).count() == 0


def test_bound(spark):
    docs, labels = data(spark)
    x, y = quality.training_rows(docs, labels, max_rows=60)
    assert 20 < len(y) < 120


def test_preferences_are_learnt():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = (x[:, 0] - 2 * x[:, 1] > 0.5).astype(int)
    m = quality.fit(x, y, pairs=4000, penalty=1.0)
    assert ((m.score(x) >= quality.CUT) == (y == 1)).mean() > 0.97
    assert m.weights[0] > 0 > m.weights[1] and abs(m.weights[2]) < 0.3 * m.weights[0]


def test_fit_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    x, y = rng.random((6000, quality.WIDTH), np.float32), np.arange(6000) % 2
    x[:, 0] += y
    tracemalloc.start()
    model = quality.fit(x, y, pairs=12_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * x.nbytes + (30 << 20)
    assert ((model.raw(x) >= model.cut) == y).mean() > 0.9
    whole = np.clip((x - model.mean) / model.scale, -8, 8).astype(np.float64) @ model.weights
    assert np.abs(model.raw(x) - whole).max() < 1e-9
