"""Quality classifier: Bradley-Terry scores learnt from preference pairs.

Each pair prefers a document of label 1 over one of label 0; the logistic loss on the difference of their features gives a
linear score. The score's threshold is the quantile of training scores at the share of label 0. Features are of style
only, language-neutral: frequencies of byte classes that follow each other, word lengths, repetition, and hashed word
shapes. The fit takes a bounded sample of labelled rows (MAX_ROWS, by hash of the id); scoring reads every whole text.

Defined results: a null text is the empty text and gets the score of its (zero) features; labels that repeat for one
document count as their mean; null labels and ids are no training rows; without both labels the score is the same for all;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import runtime

#: Labelled rows of the fit, preference pairs drawn from them, strength of the penalty, predicted = score >= CUT.
MAX_ROWS, PAIRS, PENALTY, CUT = 20_000, 100_000, 30.0, 0.3
SHAPES = 128
#: Rows or pairs of the fit that are computed at a time; the driver has little memory.
ROWS = 2000
CLASSES = ["aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",;:", "!", "?", "\"'`", "()[]{}<>", "|\\/_", "-+=", "#$%&*@^~"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)  # the rest: bytes of other letters, control characters
    for k, chars in enumerate(CLASSES):
        for c in chars:
            table[ord(c)] = k
    return table


_TABLE, _N = _class_table(), len(CLASSES) + 1
WIDTH = _N * _N + SHAPES + 8


def features(texts: list[str | None]) -> np.ndarray:
    """One row of WIDTH features for each text."""
    raw = [t.encode() if t else b"" for t in texts]
    n = len(raw)
    out = np.zeros((n, WIDTH), np.float32)
    at = 0
    while at < n:  # a MB at a time: each byte takes some 80 of arrays
        to, size = at, 0
        while to < n and (to == at or size + len(raw[to]) < 1 << 20):
            size += len(raw[to])
            to += 1
        out[at:to] = _block(raw[at:to])
        at = to
    return out


def _block(raw: list[bytes]) -> np.ndarray:
    n = len(raw)
    out = np.zeros((n, WIDTH), np.float32)
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)  # a newline ends each text
    size = np.fromiter(map(len, raw), np.int64, n)
    owner = np.repeat(np.arange(n), size + 1)
    kind = _TABLE[joined].astype(np.int64)
    two = owner[:-1] * (_N * _N) + kind[:-1] * _N + kind[1:]
    inside = np.ones(len(two), bool)
    ends = np.cumsum(size + 1) - 1
    inside[ends[:-1]] = False  # the pair of a text's end and the next text's start
    pairs = np.bincount(two[inside], minlength=n * _N * _N).reshape(n, -1)
    out[:, : _N * _N] = np.sqrt(pairs / np.maximum(1, size)[:, None])
    gap = (kind == 4) | (kind == 5)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    stops = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    own = owner[starts]
    words = np.bincount(own, minlength=n)
    some = np.maximum(1, words)
    length = stops - starts
    # a word's shape: classes of its first, second-last and last byte, and whether it is short
    first, last, before = kind[starts], kind[stops - 1], kind[np.maximum(starts, stops - 2)]
    shape = (((first * 31 + last) * 31 + before) * 31 + np.minimum(length, 12) // 3) * 2654435761 % (1 << 32) >> 25
    out[:, _N * _N : _N * _N + SHAPES] = np.sqrt(np.bincount(own * SHAPES + shape % SHAPES, minlength=n * SHAPES).reshape(n, SHAPES) / some[:, None])
    # words alike (by a hash of their bytes), lines alike
    power = np.cumprod(np.full(len(joined), 0x9E3779B97F4A7C15 | 1, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
    inverse = np.cumprod(np.full(len(joined), back, np.uint64))

    def distinct(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
        h = (sums[b] - sums[a]) * inverse[a] + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        return np.bincount(of[order][new], minlength=n)

    breaks = np.flatnonzero(joined == 10)
    heads = np.concatenate([[0], breaks[:-1] + 1])
    full = breaks > heads
    of = owner[heads[full]]
    lines = np.bincount(of, minlength=n)
    extra = out[:, _N * _N + SHAPES :]
    mean = np.bincount(own, weights=length, minlength=n) / some
    extra[:, 0] = np.log1p(size) / 10
    extra[:, 1] = np.log1p(words) / 10
    extra[:, 2] = mean / 10
    extra[:, 3] = np.sqrt(np.maximum(0, np.bincount(own, weights=length.astype(float) ** 2, minlength=n) / some - mean**2)) / 10
    extra[:, 4] = distinct(starts, stops, own) / some
    extra[:, 5] = distinct(heads[full], breaks[full], of) / np.maximum(1, lines)
    extra[:, 6] = np.log1p(lines) / np.log1p(np.maximum(1, words))
    extra[:, 7] = size == 0
    return out


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = x - mean
    z /= scale
    return np.clip(z, -8, 8, out=z)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k in range(0, len(x), ROWS):  # at a time, since it takes four times the memory of x
            out[k : k + ROWS] = _scaled(x[k : k + ROWS], self.mean, self.scale).astype(np.float64) @ self.weights
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, seed: int = 7) -> Model:
    """x: features, y: 1 or 0. Newton's method on the pairs' logistic loss."""
    mean = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(WIDTH, np.float32)
    model = Model(mean, scale, np.zeros(x.shape[1] if len(x) else WIDTH), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        model.cut = 0.0 if len(good) or not len(bad) else 1.0
        return model
    z = _scaled(x, mean, scale)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = model.weights
    for _ in range(12):
        slope, curve = penalty * w, penalty * np.eye(len(w))
        for k in range(0, pairs, ROWS):
            d = (z[a[k : k + ROWS]] - z[b[k : k + ROWS]]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            slope -= d.T @ (1 - p)
            curve += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    model.weights = w
    del z
    s = model.raw(x)
    order = np.sort(s)
    model.cut = float(order[len(bad) - 1] + order[len(bad)]) / 2  # the quantile at the share of label 0
    base = np.log(CUT / (1 - CUT))

    def loss(k: float) -> float:
        m = np.clip(k * (s - model.cut) + base, -500, 500)
        return float(np.logaddexp(0, np.where(y == 1, -m, m)).mean())

    model.slope = min(np.geomspace(0.05, 20, 60), key=loss)
    return model


def _hashed(column: str, mod: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about max_rows labelled documents, whose ids have crc32 mod 5 other than 0."""
    own = labels.where("doc_id is not null and quality is not null").where(_hashed("doc_id", 5) != 0)
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    picked = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # bounded by max_rows
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = picked.mapInArrow(runtime.trimmed(blocks), schema).toArrow().sort_by("doc_id")
    x = np.zeros((rows.num_rows, WIDTH), np.float32)
    for k, own in enumerate(rows["x"]):
        x[k] = np.frombuffer(own.as_buffer(), np.float16)
    return x, rows["label"].to_numpy()


def classify(docs: DataFrame, model: Model, columns: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns named, the score and the prediction (in columns `names`) of every document."""
    runtime.prepare(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[*columns, *names])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(runtime.trimmed(blocks), schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    runtime.prepare(spark)
    docs = runtime.table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, runtime.table(spark, sf_dir, "labels")))
    out = classify(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(_hashed("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
