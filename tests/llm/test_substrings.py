import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.llm import anchors, fmindex, registry, suffixes
from papyrine.llm.anchors import Bytes, Words


def brute(units, length):
    """units: a list of sequences. The covered places of each."""
    where = {}
    for d, u in enumerate(units):
        for k in range(len(u) - length + 1):
            where.setdefault(tuple(u[k : k + length]), []).append((d, k))
    out = [set() for _ in units]
    for places in where.values():
        if len(places) > 1:
            for d, k in places:
                out[d].update(range(k, k + length))
    return out


def texts(seed=9, many=False):
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 40)
    passage = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 90, 70)]
    out = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.integers(1, 60)))]
        for _ in range(rng.integers(0, 3)):
            parts += [passage[rng.integers(0, 5)], " ".join(word() for _ in range(rng.integers(1, 40)))]
        out.append(" ".join(parts))
    edited = out[0].split()
    if len(edited) > 20:
        edited[len(edited) // 2] = "other"
    out += [" ".join(edited), out[3], out[3].replace(" ", " \t\n"), "", None, "x", "same " * 200, "same " * 90 + "end", "é😀 " * 150, "é😀 " * 130]
    out += [passage[3] + " " + passage[3], "b" * 900, "b" * 399]
    if many:
        out += ["u%d v%d " % (k, k) + passage[3] + " t%d" % k for k in range(80)]
    return out


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 37, 1000)
    w = fmindex.WaveletMatrix(v, 37)
    at = rng.integers(0, 1001, 500)
    c = rng.integers(0, 37, 500)
    assert (w.rank(c, at) == [np.sum(v[:a] == x) for a, x in zip(at, c)]).all()


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    s = [rng.integers(1, 4, n) for n in (50, 3, 0, 70, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in s])])
    weights = np.array([1, 2, 1, 1, 5])
    index = fmindex.FMIndex(np.concatenate(s), bounds, weights)
    for _ in range(100):
        p = rng.integers(1, 4, rng.integers(1, 6))
        low, high = np.array([0]), np.array([index.rows])
        for c in p[::-1]:
            low, high = index.extend(low, high, np.array([c]))
        want = sum(w * sum((x[k : k + len(p)] == p).all() for k in range(len(x) - len(p) + 1)) for x, w in zip(s, weights))
        assert index.occurrences(low, high)[0] == want


def test_suffix_array():
    rng = np.random.default_rng(3)
    bodies = [bytes(rng.integers(97, 99, n).tolist()) for n in (300, 5, 0, 90, 90)] + [b"ab" * 200, b"ab" * 150, b"\x00\xff" * 30]
    a = suffixes.SuffixArray(bodies)
    data, ends = b"".join(bodies), np.repeat(a.bounds[1:], np.diff(a.bounds))
    own = [data[k : ends[k]] for k in range(len(data))]
    assert a.order.tolist() == sorted(range(len(data)), key=lambda k: (own[k], k))
    pre = a.prefixes()
    for r in range(1, len(data)):
        x, y = own[a.order[r - 1]], own[a.order[r]]
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert pre[r] == n


def test_windows_are_dealt_once():
    t = texts()
    for kind in (Words, Bytes):
        for units, bounds, pieces in anchors.blocks(kind, t):
            s = anchors.segments(units, bounds, kind.length, kind.gram)
            got = sorted((int(f) + k) for f, c in zip(s.first, s.count) for k in range(c))
            assert got == [k for a, b in zip(bounds[:-1], bounds[1:]) for k in range(a, b - kind.length + 1)]


@pytest.mark.parametrize("crowd,limit", [(2000, None), (3, 0)])
def test_words(spark, monkeypatch, crowd, limit):
    if limit is not None:
        monkeypatch.setattr("papyrine.llm.runtime.BROADCAST_BYTES", limit)
    t = texts(many=True)
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate(t)], "doc_id long, text string, key string")
    got = {r.doc_id: r.s for r in anchors.with_spans(df, Words, fmindex.judge, 5000, "s", crowd).collect()}
    want = brute([(x or "").encode().split() for x in t], 35)
    for i in range(len(t)):
        assert {k for a, b in anchors.unpack(got[i]).tolist() for k in range(a, b)} == want[i], i
    assert sum(map(bool, want)) > 20


@pytest.mark.parametrize("shard", [1500, 1 << 20])
def test_bytes(spark, shard):
    t = [x and x.replace("w", "wxyz") for x in texts(10, many=True)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    judge = lambda b, c, r: suffixes.judge(b, c, r, shard)
    got = {r.doc_id: r.s for r in anchors.with_spans(df, Bytes, judge, 20_000, "s").collect()}
    want = brute([(x or "").encode() for x in t], 400)
    for i in range(len(t)):
        assert {k for a, b in anchors.unpack(got[i]).tolist() for k in range(a, b)} == want[i], i
    assert sum(map(bool, want)) > 10


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK", 100)
    t = texts()
    n = 0
    for units, bounds, pieces in anchors.blocks(Words, t):
        s = anchors.segments(units, bounds, 35, 8)
        n += int(s.count.sum())
        assert len(units) <= 134 or len(pieces) == 1
    assert n == sum(max(0, len((x or "").split()) - 34) for x in t)


def test_queries(spark, tmp_path):
    t = texts()
    rows = [(i, x, "s") for i, x in enumerate(t)] + [(2, t[2], "s"), (None, t[7], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for f, split, join, length in ((fmindex.op8_substrings, bytes.split, b" ".join, 35), (suffixes.op9_suffixes, lambda b: [b[k : k + 1] for k in range(len(b))], b"".join, 400)):
        units = [split((r[1] or "").encode()) for r in rows]
        gone = brute(units, length)
        want = sorted(((r[0], len(u), len(g), hashlib.sha256(join([x for k, x in enumerate(u) if k not in g])).hexdigest()) for r, u, g in zip(rows, units, gone)), key=str)
        assert sorted(((r[0], r[1], r[2], r.kept_sha256) for r in f(spark, str(tmp_path)).collect()), key=str) == want
    kept = fmindex.dedup(df).collect()
    assert all(r.n_words == "s" for r in kept)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert fmindex.op8_substrings(spark, f"{tmp_path}/empty").count() == suffixes.op9_suffixes(spark, f"{tmp_path}/empty").count() == 0
    assert fmindex.dedup(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("name", ["op8_substrings", "op9_suffixes"])
def test_sql(spark, tmp_path, name):
    wide = "".join(chr(0x3B1 + k % 24) + chr(0x4E00 + k * k % 997) for k in range(200))  # no white space, 2 and 3 bytes
    t = [*texts(), None, "", wide, "x" + wide[:150], wide[3:] + "y", "a" * 400, "a" * 401]
    spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = registry.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(tuple(r) for r in rows) == sorted(want.fetchall())


@pytest.mark.parametrize("limit", [0, 150, 1 << 20])
def test_counted_join(spark, monkeypatch, limit):
    monkeypatch.setattr("papyrine.llm.runtime.BROADCAST_BYTES", limit)
    big = spark.createDataFrame([(k % 7 if k < 60 else 9, k) for k in range(100)], "a long, b long")
    small = big.groupBy("a").agg(F.count("*").alias("copies")).where("a != 3").withColumn("x", F.col("a") * 2)
    from papyrine.llm.runtime import attach_counted

    got = attach_counted(big, small, ["a"], 7, 100, often=20)
    assert sorted(tuple(r) for r in got.select("a", "b", "x").collect()) == sorted((a, b, 2 * a) for a, b in ((k % 7 if k < 60 else 9, k) for k in range(100)) if a != 3)


def test_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(anchors.runtime, "BROADCAST_BYTES", 1000)
    rows = list(enumerate(texts(21)[:40]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(t or "").split() for _, t in rows], 35)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = anchors.with_spans(df, Words, fmindex.judge, 5000, "s")
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.doc_id: {k for a, b in anchors.unpack(r.s).tolist() for k in range(a, b)} for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == dict(enumerate(want)) and any(want)


def test_contents_are_dealt_once(spark, monkeypatch):
    """Each content with all its copies and a body, though most rows have none, after a single exchange."""
    monkeypatch.setattr(anchors, "ROWS", 7)
    rng = np.random.default_rng(22)
    rows = [(int(r), int(r * 10 + c), b"%d" % c if k % 5 == 0 else None) for k, (r, c) in enumerate(rng.integers(0, 6, (300, 2)))]
    rows += [(r, c, b"%d" % (c % 10)) for r, c in {x[:2] for x in rows}]
    found = spark.createDataFrame(rows, "route long, content long, body binary").repartition(3)
    out = anchors.contents_of(found)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.route, r.content): (r.copies, bytes(r.body)) for r in out.collect()}
    assert got == {(r, c): (sum(x[:2] == (r, c) for x in rows), b"%d" % (c % 10)) for r, c, _ in rows}
    assert out.rdd.glom().map(lambda p: {x.route for x in p}).map(len).sum() == len({x[0] for x in rows})
