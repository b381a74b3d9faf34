"""Suffix-array dedup: bytes that lie in a string of 400 bytes which occurs elsewhere.

Candidates come from papyrine.llm.anchors. Each shard of them gets a suffix array by Larsson and Sadakane's refinement
(only suffixes whose order is still open are sorted again, by the rank of the suffix that follows twice as far) and common
prefixes with neighbours by Kasai's rule, in many lanes at once. A suffix whose common prefix with a neighbour reaches 400
is repeated. Shards hold whole groups of candidates; where one group spans several, each shard's windows are searched for
in the others' suffix arrays by bisection.

Defined results: a null text is empty; strings never cross documents; a repeated row is an occurrence elsewhere; texts
under 400 bytes keep all; what is left of a text need not be valid UTF-8 and is hashed as bytes; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papyrine.llm import runtime
from papyrine.llm.anchors import Bytes, unpack, with_spans

#: Bytes that reach a task's judge at once, and bytes of one suffix array.
TASK, SHARD = 3 << 20, 1 << 20
WINDOW = Bytes.length
LANE = 64


def _sorted(major: np.ndarray, width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """places by (major, place), and where major changes. major has `width` bits; with the place it mostly fits into one
    word, and sorting words is several times faster than sorting their order."""
    bits = int(places.max()).bit_length() if len(places) else 1
    if width + bits <= 64:
        packed = (major << np.uint64(bits)) | places.astype(np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << bits) - 1)).astype(places.dtype)
        major = packed >> np.uint64(bits)
    else:
        by = np.lexsort((places, major))
        order, major = places[by], major[by]
    new = np.ones(len(order), bool)
    new[1:] = major[1:] != major[:-1]
    return order, new


class SuffixArray:
    """Of segments; a suffix ends with its segment, and equal suffixes are in the order of their places."""

    def __init__(self, bodies: list[bytes]):
        size = np.array([len(b) for b in bodies], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        self.n = n = len(data)
        self.left = (np.repeat(self.bounds[1:], size) - np.arange(n)).astype(np.int32)  # bytes to the end of the segment
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.zeros(n, np.uint64)  # the eight bytes from each place, the first one highest
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : n + k]
        self.order, self.rank = self._refine()

    def _refine(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups of suffixes whose first `depth` bytes are equal are ordered by the rank of what follows these, and
        depth doubles, until every group has one member."""
        n, depth = self.n, 5
        count = np.minimum(self.left, depth).astype(np.uint64)
        keep = np.uint64(64) - np.uint64(8) * count
        key = ((self.words >> keep << keep) >> np.uint64(24)) << np.uint64(3) | count  # five bytes and how many count
        order, new = _sorted(key, 43, np.arange(n, dtype=np.int32))
        new[1:] |= self.left[order[1:]] < depth  # equal suffixes that end: by their places
        rank = np.empty(n, np.int32)
        at, own, bits = np.arange(n, dtype=np.int32), order, n.bit_length()  # at: places in the order that are still open
        while True:
            head = np.maximum.accumulate(np.where(new, at, 0))
            order[at] = own
            rank[own] = head
            alone = new & np.append(new[1:], True)
            at, own, head = at[~alone], own[~alone], head[~alone]
            if not len(at):
                return order, rank
            after = np.where(self.left[own] > depth, rank[np.minimum(own + depth, n - 1)] + 1, 0)
            own, new = _sorted(head.astype(np.uint64) << np.uint64(bits) | after.astype(np.uint64), 2 * bits, own)
            new[1:] |= self.left[own[1:]] <= depth
            depth *= 2

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray, most: int = 1 << 30) -> np.ndarray:
        """Common prefix, `most` at most, of the suffixes at a and b, of which `known` bytes are equal."""
        limit = np.minimum(np.minimum(self.left[a], self.left[b]), most)
        out = known.copy()
        go = np.flatnonzero(out < limit)
        while len(go):
            x, y = a[go] + out[go], b[go] + out[go]
            differ = self.words[x] ^ self.words[y]
            same = differ == 0
            out[go] = np.minimum(limit[go], out[go] + np.where(same, 8, _leading_bytes(differ)))
            go = go[same & (out[go] < limit[go])]
        return out

    def prefixes(self, least: int = 1) -> np.ndarray:
        """For each rank the common prefix with the suffix before it; where `least` is over 1, only whether it reaches
        `least` has to be right. Lanes of LANE places each go left to right: a place's common prefix is at least that of
        the place before it, less one (Kasai's rule). Suffixes under `least` bytes are left out."""
        n, most = self.n, least if least > 1 else 1 << 30
        out = np.zeros(n, np.int32)
        before = np.full(n, -1, np.int32)
        before[self.order[1:]] = self.order[:-1]
        places = np.flatnonzero(self.left >= least)
        follows = np.concatenate([[False], places[1:] == places[:-1] + 1]) if len(places) else np.zeros(0, bool)
        lanes = np.arange(0, len(places), LANE)
        known = np.zeros(len(lanes), np.int32)
        for k in range(LANE):
            live = lanes + k < len(places)
            lanes, known = lanes[live], known[live]
            at = places[lanes + k]
            prev = before[at]
            known = np.where(follows[lanes + k], known, 0)
            some = np.flatnonzero((prev >= 0) & (self.left[np.maximum(prev, 0)] >= least))
            now = np.zeros(len(at), np.int32)
            a, b = at[some], prev[some]
            now[some] = self.common(a, b, np.minimum(known[some], np.minimum(self.left[a], self.left[b])), most)
            out[self.rank[at]] = now
            known = np.maximum(now - 1, 0)
        return out

    def holds(self, other: SuffixArray, at: np.ndarray) -> np.ndarray:
        """Whether the window at each place of `other` occurs here, by bisection."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        while (go := low < high).any():
            mid = (low + high) // 2
            less = np.zeros(len(at), bool)
            less[go] = self._compare(other, at[go], self.order[mid[go]]) < 0
            low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
        out = np.zeros(len(at), bool)
        some = low < self.n
        out[some] = self._compare(other, at[some], self.order[low[some]]) == 0
        return out

    def _compare(self, other: SuffixArray, at: np.ndarray, here: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix here against the window of `other`, by their first WINDOW bytes."""
        out = np.zeros(len(at), np.int64)
        go, k = np.arange(len(at)), 0
        while len(go) and k < WINDOW:
            left = self.left[here[go]] - k
            x, y = self.words[np.minimum(here[go] + k, self.n - 1)], other.words[at[go] + k]
            differ = x ^ y
            lead = np.where(differ == 0, 8, _leading_bytes(differ))
            ends = left <= np.minimum(lead, WINDOW - k - 1)  # the suffix ends before it differs
            out[go] = np.where(ends, -1, np.where(differ == 0, 0, np.where(x < y, -1, 1)))
            go = go[~ends & (differ == 0)]
            k += 8
        return out


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the highest bytes are zero."""
    high = x >> np.uint64(32)
    length = np.frexp(np.where(high > 0, high, x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]  # in bits
    return np.where(high > 0, 4, 8) - ((length + 7) >> 3)


def shards_of(size: np.ndarray, routes: np.ndarray, shard: int) -> Iterator[list[tuple[int, int]]]:
    """Ranges of bodies, one list for each suffix array's worth of whole routes; a route beyond that has several."""
    ends = np.flatnonzero(np.append(routes[1:] != routes[:-1], True)) + 1
    total = np.concatenate([[0], np.cumsum(size)])
    first, last = 0, 0
    for end in ends.tolist():
        if last > first and total[end] - total[first] > shard:
            yield [(first, last)]
            first = last
        last = end
        if total[last] - total[first] > shard:  # one route
            cut = [first]
            for k in range(first + 1, last):
                if total[k + 1] - total[cut[-1]] > shard:
                    cut.append(k)
            yield list(zip(cut, [*cut[1:], last], strict=True))
            first = last
    if last > first:
        yield [(first, last)]


def judge(bodies: list[bytes], copies: np.ndarray, routes: np.ndarray, shard: int = SHARD) -> list[np.ndarray]:
    """Which windows of each body repeat. Only bodies of one route can share a window; rows of a route follow each other."""
    size = np.array([len(b) for b in bodies], np.int64)
    marks: list[np.ndarray] = []
    for parts in shards_of(size, routes, shard):
        made = []
        for a, b in parts:
            array = SuffixArray(bodies[a:b])
            reach = np.append(array.prefixes(WINDOW) >= WINDOW, False)
            own = (reach[:-1] | reach[1:])[array.rank]
            made.append((array, (own | np.repeat(copies[a:b] > 1, size[a:b])) & (array.left >= WINDOW)))
        for i, (array, hit) in enumerate(made):  # a route that spans shards: windows are searched for in the others
            for j, (other, _) in enumerate(made):
                if i != j:
                    at = np.flatnonzero(~hit & (array.left >= WINDOW))
                    hit[at] |= other.holds(array, at)
        for array, hit in made:
            for x, y in zip(array.bounds[:-1].tolist(), array.bounds[1:].tolist(), strict=True):
                marks.append(hit[x : max(x, y - WINDOW + 1)])
    return marks


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = with_spans(docs, Bytes, judge, TASK, "_spans")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, digest = [], [], [], []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw = t.encode() if t else b""
                spans, h, last = unpack(s).tolist(), hashlib.sha256(), 0
                for a, b in spans:
                    h.update(raw[last:a])
                    last = b
                h.update(raw[last:])
                n.append(len(raw))
                removed.append(sum(b - a for a, b in spans))
                count.append(len(spans))
                digest.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(digest, pa.string())], names=schema.names)

    return marked.mapInArrow(runtime.trimmed(run), schema)


#: The same rows in DuckDB. Texts are in hex, cut into pieces that hold 400 windows each, so that a window costs its piece.
OP9_SQL = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
chunks AS (SELECT doc_id, k, len(x) // 2 AS n, x[800 * k + 1 : 800 * k + 1600] AS c FROM (SELECT doc_id, x, unnest(range(0, len(x) // 800)) AS k FROM texts)),
windows AS (SELECT doc_id, 400 * k + j AS i, md5(c[2 * j + 1 : 2 * j + 800]) AS h FROM (SELECT doc_id, k, c, unnest(range(0, least(400, n - 399 - 400 * k))) AS j FROM chunks)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS first FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(first) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
cut AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS last, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) AS head FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT texts.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || x[2 * coalesce(last, 0) + 1 :])) AS kept_sha256 FROM texts LEFT JOIN cut ON texts.doc_id = cut.doc_id
"""
