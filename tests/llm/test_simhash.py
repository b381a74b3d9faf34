import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from papyrine.llm import simhash
from papyrine.llm.components import connected_components


def brute_components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == brute_components(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fp(text, width=3):
    w = text.encode().lower().split() if text else []
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("cell", [64, 3])
def test_against_brute_force(spark, cell):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 300)) for _ in range(12)]
    texts = ["", None, "one", "ONE", "one two", " one\ttwo ", "É é É É", *base]
    for t in base[:6]:
        for _ in range(12):
            w = t.split()
            w[rng.integers(0, 300)] = "changed"
            texts.append(" ".join(w))
    texts += texts[:10]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "ONE", 1), (None, "nobody else has this", 1)], "doc_id long, text string, fp int")
    marked, groups, n = simhash.near_duplicates(df, cell=cell)
    fps = {r.doc_id: r.fp % (1 << 64) for r in marked.where("doc_id is not null").collect()}
    assert fps == {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(range(len(texts)), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: r.component for r in marked.join(groups, "fp").where("doc_id is not null").collect()}
    assert got == want
    assert len(set(want.values())) < len(set(fps.values()))
    assert marked.count() == len(texts) + 2


def test_hash_is_sparks(spark):
    assert simhash.shingle_hashes("A b c", 3) == [spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    marked, groups, _ = simhash.near_duplicates(df)
    assert marked.count() == groups.count() == 0


def test_keep_one(spark):
    rng = np.random.default_rng(21)
    word = lambda: "w%d" % rng.integers(0, 3000)
    passage = [word() for _ in range(60)]
    texts, group = [], []
    for g in range(12):
        base = [word() for _ in range(250)]
        for k in range(6):
            w = list(base)
            for _ in range(k and 3):
                w[rng.integers(0, len(w))] = word()
            texts.append(" ".join(w))
            group.append(g)
    for g in range(12, 40):  # these share a passage only
        texts.append(" ".join([*(word() for _ in range(100)), *passage, *(word() for _ in range(100))]))
        group.append(g)
    texts += [None, "", "short one", "short one"]
    group += [40, 40, 41, 41]
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = brute_components(range(len(texts)), [*links, (100, 101)])
    assert all(comp[a] == comp[b] for a in range(72) for b in range(72) if group[a] == group[b])
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, fp string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(k for k in range(len(texts)) if group[k] == g) for g in group})


def kept_and_groups(spark, texts):
    """Ids that keep_one keeps, and the smallest ids of the groups by brute force, in sets and fingerprints."""
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    fps = [brute_fp(t, 5) for t in texts]
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    comp = brute_components(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if near(a, b)])
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return sorted(r.doc_id for r in kept.collect()), sorted(set(comp.values()))


def test_keep_one_short_texts(spark):
    rng = np.random.default_rng(31)
    texts = []
    for n in (14, 20, 30, 50, 60, 80):
        for _ in range(20):
            w = ["w%d" % x for x in rng.integers(0, 5000, n)]
            other = list(w)
            other[n // 2 if n >= 50 else -1] = "changed"
            texts += [" ".join(w), " ".join(other)]
    got, want = kept_and_groups(spark, texts)
    assert got == want and len(want) <= 140


def test_keep_one_chains(spark):
    rng = np.random.default_rng(32)
    texts, w = [], ["w%d" % x for x in rng.integers(0, 5000, 120)]
    for _ in range(120):  # each version is like the one before it, few are like a fixed one
        texts.append(" ".join(w))
        for _ in range(2):
            w[rng.integers(0, len(w))] = "v%d" % rng.integers(0, 5000)
    base = ["u%d" % x for x in rng.integers(0, 5000, 250)]
    for _ in range(120):
        v = list(base)
        for at in rng.integers(0, len(v), 3):
            v[at] = "t%d" % rng.integers(0, 5000)
        texts.append(" ".join(v))
    got, want = kept_and_groups(spark, texts)
    assert got == want and len(want) < 20


def test_keep_one_repeated_lines(spark):
    rng = np.random.default_rng(33)
    texts = []
    for _ in range(15):
        w = ["w%d" % x for x in rng.integers(0, 5000, 300)]
        line = ["l%d" % x for x in rng.integers(0, 5000, 8)]
        texts += [" ".join(w), " ".join(w + line * 100)]
    assert sum((brute_fp(a, 5) ^ brute_fp(b, 5)).bit_count() > 20 for a, b in zip(texts[::2], texts[1::2])) > 5
    got, want = kept_and_groups(spark, texts)
    assert got == want == list(range(0, 30, 2))


def test_keep_one_ids(spark):
    rng = np.random.default_rng(34)
    text = lambda: " ".join("w%d" % x for x in rng.integers(0, 5000, 60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (7, c, "x"), (7, d, "x"), (7, d, "x"), (8, d, "x"), (None, e, "x"), (9, e, "x"), (9, e + " ", "y")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted(((r.doc_id, r.text.strip()) for r in kept.collect()), key=str)
    assert got == sorted([(None, a), (None, b), (7, c), (7, d), (9, e)], key=str)


def test_keep_one_in_parts(spark, monkeypatch):
    """Texts are not shuffled, also where what is joined to them is too large for one broadcast."""
    monkeypatch.setattr(simhash.runtime, "BROADCAST_BYTES", 200)
    rng = np.random.default_rng(35)
    texts = [" ".join("w%d" % x for x in rng.integers(0, 5000, 60)) for _ in range(100)]
    texts += [t + " more" for t in texts[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(df)
        assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_rule_out_pairs():
    rng = np.random.default_rng(36)
    ruled_out = 0
    for _ in range(2000):
        own = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 600))).astype(np.uint64))
        new = rng.integers(0, 1 << 62, int(rng.integers(0, 60))).astype(np.uint64)
        other = np.unique(np.concatenate([own[int(rng.integers(0, len(own))) :], new]))
        both = len(np.intersect1d(own, other))
        similar = 5 * both >= 4 * (len(own) + len(other) - both)
        found = simhash.possible(simhash.sketch(own), simhash.sketch(other), len(own) + len(other))
        assert found or not similar
        ruled_out += not found
    assert ruled_out > 1000


def test_fingerprints_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(37)
    hashes = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in [0, 1, 2, 3] + [3000] * 120 + [50_000, 0, 7]]
    tracemalloc.start()
    got = simhash.fingerprints(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place = np.arange(64, dtype=np.uint64)
    want = [sum(1 << k for k in np.flatnonzero((h[:, None] >> place & np.uint64(1)).sum(0) * 2 > len(h)).tolist()) for h in hashes]
    assert got.tolist() == want
    assert peak < 8 << 20
