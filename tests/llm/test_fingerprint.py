import hashlib

import numpy as np
import xxhash

from papyrine.llm import fingerprint as fp


def test_peeling_is_the_set_difference():
    rng = np.random.default_rng(3)
    a, b = [], []
    for n, m, shared in [(0, 0, 0), (1, 0, 0), (5, 5, 5), (300, 2, 100), (40, 60, 7), (1000, 900, 0), (3, 3, 2000)]:
        s, x, y = (rng.integers(0, 1 << 63, k, np.uint64) for k in (shared, n, m))
        a.append(np.concatenate([s, x]))
        b.append(np.concatenate([s, y]))
    want = [1.0 if not len(x) + len(y) else len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(a, b)]
    a, b = [np.unique(x & fp._DIGEST) for x in a], [np.unique(x & fp._DIGEST) for x in b]
    (fa, ca), (fb, cb) = fp.fingerprints(a), fp.fingerprints(b)
    assert np.allclose(fp.likeness(a, b, ca, cb), want)
    assert np.allclose([fp.likeness_of(x, y) for x, y in zip(fa, fb)], want)
    for x, f, c in zip(a, fa, ca):
        assert (fp.decode(f) == x).all() and c >= 1.5 * len(x)


def test_paragraphs():
    assert len(fp.digests(b"x\nx\nx\ny")) == 4
    assert len(fp.digests(b"")) == 0 and fp.ends(b"").tolist() == []
    text = np.random.default_rng(5).integers(97, 123, 20_000).astype(np.uint8).tobytes()
    stop = fp.ends(text)
    assert 150 < len(stop) < 500 and stop[-1] == len(text) and (np.diff(stop) > 0).all()
    edited = text[:9000] + b"something else" + text[9500:]
    assert len(np.intersect1d(fp.digests(text), fp.digests(edited))) > 0.9 * len(stop)
    one = fp.fingerprints([fp.digests(b"a b"), fp.digests(b"a b"), fp.digests(b"a c")])[0]
    assert one[0] == one[1] != one[2]


def test_paragraphs_of_slices(monkeypatch):
    text = np.random.default_rng(6).integers(0, 256, 3000).astype(np.uint8).tobytes()
    whole = fp.ends(text).tolist()
    for size in (7, 8, 100, 1000):
        monkeypatch.setattr(fp, "SLICE", size)
        assert fp.ends(text).tolist() == whole


def place(text):
    """As Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], place(r[1] or "")))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        like = lambda x, y: 1.0 if not len(x) + len(y) else len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        d = [fp.digests(x.encode()) for x in (t, e, n)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(d[0], d[1]), 9), round(like(d[0], d[2]), 9)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "\n".join("s%d. t%d é😀" % tuple(rng.integers(0, 9, 2)) for _ in range(rng.integers(0, 30)))) for i in rng.permutation(300)]
    rows += [(5, "again"), (5, "again"), (None, None), (400, None), (401, ""), (402, "x " * 50000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, edge string, part int")
    got = fp.with_next(df)
    rows_got = sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()], key=str)
    assert rows_got == brute(rows)
    assert all(r.near_edited == 1.0 for r in got.collect() if r.fingerprint == r.edited_fingerprint and r.n_chars < 2)
    one = fp.with_next(df.where("doc_id = 400")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.with_next(df.where("false")).count() == 0
    same = spark.createDataFrame([(7, f"t{k % 3}") for k in range(50)] + [(8, "z")], "doc_id long, text string").repartition(3)
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.with_next(same).collect()], key=str) == brute([tuple(r) for r in same.collect()])
