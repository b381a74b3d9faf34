import numpy as np
import pytest

from papyrine.llm import embeddings
from tests.llm.test_simhash import brute_components


def data(seed=11):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 16))
    near = [base[k % 20] + rng.normal(size=16) * 0.12 for k in range(120)]
    crowd = [base[140] + rng.normal(size=16) * s for s in (0.05, 0.25) for _ in range(60)]
    x = [*base, *near, *crowd, base[3], base[3], base[3] * 2.0]
    return [v.astype(np.float32) for v in x]


@pytest.mark.parametrize("run,block", [(64, 512), (16, 25)])
def test_against_brute_force(spark, tmp_path, monkeypatch, run, block):
    x = data()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0], [0.0] * 16]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(None, x[5].tolist(), 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    d, groups, n, recall = embeddings.near_duplicates(df, run=run, block=block)
    assert recall >= 0.99 and n == len({v.tobytes() for v in x})
    all_ = np.array([*x, x[5], x[7]], np.float64)
    u = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    comp = brute_components(range(len(u)), np.argwhere(s).tolist())
    got = {}
    for r in d.join(groups, "node").collect():
        got[r.vec_id] = (r.n_links, r.component)
    for i in range(len(x)):
        assert got[i] == (s[i].sum(), comp[i]), i
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = embeddings.op6_embeddings(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id is not None and r.vec_id >= 1000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        elif r.vec_id is not None:
            assert r.kept == (comp[r.vec_id] == r.vec_id) and r.n_links == s[r.vec_id].sum()
    assert [type(f.dataType).__name__ for f in embeddings.op6_embeddings(spark, str(tmp_path)).schema] == ["LongType"] * 3 + ["BooleanType"]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    rows, groups, n, recall = embeddings.near_duplicates(df)
    assert rows.count() == groups.count() == n == 0


def test_bounds_prove_pairs():
    rng = np.random.default_rng(1)
    x = embeddings.unit([r.tobytes() for r in rng.normal(size=(50, 8))])
    assert (embeddings.linked(x, x) == (x @ x.T >= 0.95)).all()


def test_audit_counts_small_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(101, 64))
    x = [base[100] + rng.normal(size=64) * 0.02 for _ in range(300)] + [base[k // 2] + rng.normal(size=64) * 0.02 for k in range(200)]
    v = spark.createDataFrame([(i, bytearray(r.tobytes()), 1, i) for i, r in enumerate(x)], "node long, vec binary, copies long, rep long")
    found = spark.createDataFrame([(i, 300) for i in range(300)], "node long, n long")  # none of the pairs
    assert embeddings.audit(v, len(x), found) < 0.1
    found = found.union(spark.createDataFrame([(i, 2) for i in range(300, 500)], "node long, n long"))
    assert embeddings.audit(v, len(x), found) == pytest.approx(1)


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "audit", lambda *_: 0.5)
    monkeypatch.setattr(embeddings, "TRIES", 1)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    with pytest.raises(RuntimeError, match="0.5"):
        embeddings.near_duplicates(df)


def test_each_length_on_its_own(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.1, 0.0])]
    d, groups, n, _ = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r.vec_id: (r.n_links, r.component) for r in d.join(groups, "node").collect()}
    assert n == 5 and got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}
