"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A paragraph ends after a line feed or where the eight bytes before hash to one of 64 values, so that an edit changes the
paragraphs near it only. Each paragraph's digest (with a running number for repeats) goes to HASHES cells of a sketch: a
count, the XOR of the digests and the XOR of their checks. A fingerprint is a sketch with at least 1.5 cells for each
paragraph that peels down to nothing, so that all its digests can be recovered from it; where peeling does not finish, the
next larger size is taken. The fingerprints of two versions subtract cell by cell and peeling the difference recovers the
digests that only one of them has. Where that does not finish, or sizes differ, both are peeled and made anew with more
cells. likeness = shared / all distinct digests, 1 for two empty texts: it takes the two fingerprints and nothing else.

Defined results: a null text is the empty text, with the smallest sketch; equal texts have equal fingerprints; rows with
the same id follow each other by a hash of their texts, equal rows anyhow; a null id comes first; the only row of a table
is its own next document; no rows, no results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import runtime

#: Cells of a digest; rounds of peeling, after which it has failed: what passes for one digest and is none could come and
#: go for ever.
HASHES, ROUNDS = 3, 300
#: Bytes of a cell in a fingerprint: a count, a digest, a check.
CELL = (1, 5, 3)
#: A place is a paragraph's end for one in so many hashes; bytes that are looked at together.
MEAN, REACH, SLICE = 64, 8, 1 << 20
#: Ranges of ids for each shuffle partition, and keys that the driver sees for each range.
RANGES, KEYS = 4, 8
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(HASHES)]
_DIGEST, _CHECK = (np.uint64((1 << 8 * width) - 1) for width in CELL[1:])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def ends(text: bytes) -> np.ndarray:
    """Where paragraphs end, the text's end among them."""
    data, found = np.frombuffer(text, np.uint8), []
    for a in range(0, len(data), SLICE):
        start = max(0, a - REACH + 1)
        own = data[start : a + SLICE]
        last = own == 10
        if len(own) >= REACH:
            seen, width = own.astype(np.uint64), 1
            while width < REACH:  # the bytes from each place on
                seen, width = (seen[:-width] << np.uint64(8 * width)) | seen[width:], 2 * width
            last[REACH - 1 :] |= mix(seen * _M[0]) % np.uint64(MEAN) == 0
        last[: a - start] = False
        found.append(np.flatnonzero(last) + start + 1)
    stop = np.concatenate([np.zeros(0, np.int64), *found])
    return stop if not len(data) or len(stop) and stop[-1] == len(data) else np.append(stop, len(data))


def digests(text: bytes) -> np.ndarray:
    """Distinct digests, one for each paragraph; the k-th repeat of a paragraph has a digest of its own."""
    from xxhash import xxh64_intdigest as xx

    stop = ends(text).tolist()
    own = np.array([xx(text[a:b], 0) for a, b in zip([0, *stop], stop, strict=False)], np.uint64)
    s = np.sort(own)
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    repeat = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return _distinct(np.where(repeat > 0, mix(s + repeat.astype(np.uint64) * _M[0]), s) & _DIGEST)


class Sketches:
    """Sketches of many texts side by side: cells[k] of them each, for text k."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, cells: np.ndarray):
        self.cells, self.base = cells, np.cumsum(cells) - cells
        size = int(cells.sum())
        self.count, self.key, self.check = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.add(keys, owner, np.ones(len(keys), np.int64))

    def places(self, keys: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """HASHES cells for each key, one from each third of its owner's cells, so they differ."""
        third = (self.cells[owner] // HASHES).astype(np.uint64)
        for j in range(HASHES):
            yield (self.base[owner] + j * third.astype(np.int64)) + (mix(keys + _STEP[j]) % third).astype(np.int64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        checks = mix(keys ^ _M[2]) & _CHECK
        for at in self.places(keys, owner):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, checks)

    def copy(self) -> Sketches:
        return self.minus(None)

    def minus(self, other: Sketches | None) -> Sketches:
        out = object.__new__(Sketches)
        out.cells, out.base = self.cells, self.base
        out.count, out.key, out.check = (self.count.copy(), self.key.copy(), self.check.copy()) if other is None else (self.count - other.count, self.key ^ other.key, self.check ^ other.check)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The digests that are left, whose they are, and for each text whether peeling came to its end."""
        n = len(self.cells)
        of = np.repeat(np.arange(n), self.cells)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        look = np.flatnonzero(np.abs(self.count) == 1)
        for _ in range(ROUNDS):
            pure = look[(np.abs(self.count[look]) == 1) & (mix(self.key[look] ^ _M[2]) & _CHECK == self.check[look])]
            if not len(pure):
                break
            first = np.unique(mix(self.key[pure] ^ mix(of[pure].astype(np.uint64) + _M[0])), return_index=True)[1]
            pure = pure[first]
            owner, key, sign = of[pure], self.key[pure], self.count[pure]
            keys.append(key)
            owners.append(owner)
            touched = np.concatenate(list(self.places(key, owner)))
            self.add(key, owner, -sign)
            look = _distinct(touched)
        left = np.zeros(n, bool)
        left[of[(self.count != 0) | (self.key != 0) | (self.check != 0)]] = True
        return np.concatenate(keys), np.concatenate(owners), ~left

    def strings(self) -> list[str]:
        """Each text's cells in base 64."""
        rows = np.zeros((len(self.count), sum(CELL)), np.uint8)
        rows[:, 0] = self.count & 255
        rows[:, 1 : 1 + CELL[1]] = self.key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, -CELL[1] :]
        rows[:, 1 + CELL[1] :] = self.check.astype(">u8").view(np.uint8).reshape(-1, 8)[:, -CELL[2] :]
        return [base64.b64encode(rows[a : a + c].tobytes()).decode() for a, c in zip(self.base.tolist(), self.cells.tolist(), strict=True)]


def larger(cells: np.ndarray) -> np.ndarray:
    """The next size: three times a power of two, or that and a half."""
    third = cells // HASHES
    power = 1 << (np.frexp(third.astype(np.float64))[1] - 1).astype(np.int64)
    return HASHES * np.where(third == power, np.maximum(third + 1, third * 3 // 2), power * 2)


def _smallest(n: np.ndarray) -> np.ndarray:
    cells = np.full(len(n), HASHES * 4, np.int64)
    while (small := cells < n + n // 2 + 6).any():
        cells = np.where(small, larger(cells), cells)
    return cells


def _together(sets: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in which)]), np.repeat(np.arange(len(which)), np.fromiter((len(sets[k]) for k in which), np.int64, len(which)))


def fingerprints(sets: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The fingerprint of each set of digests and its number of cells: the smallest that peels."""
    cells = _smallest(np.fromiter(map(len, sets), np.int64, len(sets)))
    out, todo = [""] * len(sets), np.arange(len(sets))
    while len(todo):
        made = Sketches(*_together(sets, todo), cells[todo])
        _, _, done = made.copy().peel()
        for k, text, good in zip(todo.tolist(), made.strings(), done.tolist(), strict=True):
            if good:
                out[k] = text
        todo = todo[~done]
        cells[todo] = larger(cells[todo])
    return out, cells


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells_a: np.ndarray, cells_b: np.ndarray) -> np.ndarray:
    """Of each fingerprint of a to that of b, given the digests that they peel to and their sizes: at the larger of the two
    sizes they are subtracted and peeled, where that fails at twice the size."""
    n = len(a)
    na, nb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    differ, cells = np.zeros(n, np.int64), np.maximum(cells_a, cells_b)
    todo = np.flatnonzero((na > 0) | (nb > 0))
    while len(todo):
        left = Sketches(*_together(a, todo), cells[todo]).minus(Sketches(*_together(b, todo), cells[todo]))
        _, owner, done = left.peel()
        found = np.bincount(owner, minlength=len(todo))
        differ[todo[done]] = found[done]
        todo = todo[~done]
        cells[todo] *= 2
    shared = (na + nb - differ) // 2
    return np.where(na + nb == 0, 1.0, shared / np.maximum(1, shared + differ))


def decode(fingerprint: str) -> np.ndarray:
    """The digests that a fingerprint was made of."""
    rows = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, sum(CELL))
    wide = lambda x: np.concatenate([np.zeros((len(x), 8 - x.shape[1]), np.uint8), x], 1).view(">u8")[:, 0].astype(np.uint64)
    s = Sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array([len(rows)]))
    s.count, s.key, s.check = rows[:, 0].astype(np.int8).astype(np.int64), wide(rows[:, 1 : 1 + CELL[1]]), wide(rows[:, 1 + CELL[1] :])
    keys, _, done = s.peel()
    if not done[0]:
        raise ValueError("not a fingerprint")
    return np.sort(keys)


def likeness_of(a: str, b: str) -> float:
    """Of two fingerprints, from these alone."""
    cells = [np.array([len(base64.b64decode(x)) // sum(CELL)]) for x in (a, b)]
    return float(likeness([decode(a)], [decode(b)], *cells)[0])


def edited(text: str, after: str) -> str:
    """The last half of the code points of text replaced by as many of the next text's first, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(texts: list[str], guard: list[bool]) -> dict:
    """The result's columns for each text but guards and the last, with the text that follows it."""
    own = [digests(t.encode()) for t in texts]
    made, cells = fingerprints(own)
    at = np.flatnonzero(~np.array(guard[:-1], bool))
    new = [edited(texts[k], texts[k + 1]) for k in at]
    raw = [t.encode() for t in new]
    own_new = [digests(t) for t in raw]
    made_new, cells_new = fingerprints(own_new)
    first = [own[k] for k in at]
    return {
        "n_chars": pa.array([len(texts[k]) for k in at], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
        "fingerprint": pa.array([made[k] for k in at], pa.string()),
        "edited_fingerprint": pa.array(made_new, pa.string()),
        "near_edited": pa.array(likeness(first, own_new, cells[at], cells_new), pa.float64()),
        "near_next": pa.array(likeness(first, [own[k + 1] for k in at], cells[at], cells[at + 1]), pa.float64()),
    }


def _ranged(rows: DataFrame, ranges: int) -> DataFrame:
    """rows (some, id, h, r) with `part`: which range of (some, id, h, r) a row is in. The ranges come from a sample of keys,
    so that rows with one id, or equal rows, are split as well."""
    n = rows.count()
    key = ["some", "id", "h", "r"]
    part = int((1 << 30) * min(1.0, KEYS * ranges / max(1, n)))
    keys = sorted(tuple(x) for x in rows.where(F.pmod(F.xxhash64("r", F.lit(11)), F.lit(1 << 30)) < part).select(*key).collect())
    bounds = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)} if keys else set())
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(some: pd.Series, own: pd.Series, h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(shared.value, x) for x in zip(some.tolist(), own.tolist(), h.tolist(), r.tolist(), strict=True)], dtype="int32")

    return rows.withColumn("part", place(*key))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document, ascending id, compared with its edited text and with the next document.

    Rows are dealt to ranges of the id. The first text of each range goes to the range before it as well, as a guard at
    its end, so that a task finds every next document in its own sorted rows.
    """
    spark = runtime.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    none = "" if isinstance(kind, T.StringType) else 0
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next"))])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).isNotNull().alias("some"), F.coalesce(F.col(id_col), F.lit(none)).cast(kind).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("r"), text.alias("text"))
    rows = _ranged(rows, RANGES * parts)
    first = rows.groupBy("part").agg(F.min(F.struct("some", "id", "h", "r")).alias("x")).select("part", "x.r").collect()  # one number a range
    if not first:
        return spark.createDataFrame([], out)
    order = sorted(r.part for r in first)
    heads = spark.createDataFrame([tuple(r) for r in first], "part int, r long")
    before = spark.createDataFrame(list(zip(order, [order[-1], *order[:-1]], strict=True)), "part int, before int")
    own = rows.withColumn("guard", F.lit(False))
    guards = rows.join(F.broadcast(heads), ["part", "r"]).join(F.broadcast(before), "part").withColumn("part", F.col("before")).drop("before").withColumn("guard", F.lit(True))
    dealt = own.unionByName(guards).repartition(parts, "part").sortWithinPartitions("part", "guard", "some", "id", "h", "r")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            held = rows.slice(len(rows) - 1).to_batches()[0]
            if len(rows) > 1:
                guard = rows["guard"].to_pylist()
                keep = pa.array([not g for g in guard[:-1]])
                ids, some = rows["id"].combine_chunks().slice(0, len(rows) - 1), rows["some"].combine_chunks().slice(0, len(rows) - 1)
                ids = pa.compute.if_else(some, ids, pa.scalar(None, ids.type)).filter(keep)
                cols = compare(rows["text"].to_pylist(), guard)
                yield pa.RecordBatch.from_arrays([ids, *cols.values()], names=out.names)

    return dealt.select("id", "some", "guard", "text").mapInArrow(runtime.trimmed(blocks), out)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(runtime.table(spark, sf_dir, "documents"))
