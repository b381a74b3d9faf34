"""Substring dedup: words that lie in a window of 35 words which occurs elsewhere.

Candidates come from papyrine.llm.anchors. Each shard of them is indexed by a compressed FM-index over its words: the
Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts. Every segment streams through the index by
backward search from its last word on; at each word where its interval falls to one occurrence the matching statistic of
that end is known, and all windows that matched so far are marked. A segment that occurs n times is indexed once and
counts n times.

Defined results: a null text has no words; windows never cross documents; a repeated row is an occurrence elsewhere;
texts under 35 words keep all; an empty table gives no rows; other columns stay as they are in dedup().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papyrine.llm import runtime
from papyrine.llm.anchors import Words, unpack, with_spans

#: Bytes of words in one FM-index.
SHARD = 2 << 20
WINDOW = Words.length


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. Symbols that end segments have to differ from each other."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        s = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = s[1:] != s[:-1]
        new = np.cumsum(new)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """Rank of any symbol before any place of a sequence, in one bit a symbol and level plus the counts."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        start = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        v = values.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level) & 1
            packed = np.zeros((len(v) >> 6) + 1, np.uint64)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.bits.append(packed)
            self.ones.append(ones)
            self.zeros.append(int(len(v) - bit.sum()))
            start = self._step(len(self.bits) - 1, (symbols >> level) & 1, start)
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        self.start = start

    def _step(self, k: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & low)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            at = self._step(k, (symbol >> (self.levels - 1 - k)) & 1, at)
        return at - self.start[symbol]


class FMIndex:
    """Over segments of symbols 1 and up; each occurrence in segment k weighs weights[k]."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, weights: np.ndarray):
        m, n = len(bounds) - 1, len(symbols)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(m), size)
        text = np.empty(n + m, np.int64)
        self.place = np.arange(n) + owner  # of each symbol in the text with its ends
        text[self.place] = symbols + m - 1
        ends = bounds[1:] + np.arange(m)
        text[ends] = np.arange(m)
        order = suffix_array(text)
        before = text[order - 1]
        self.sigma = int(symbols.max()) + 1 if n else 1
        bwt = np.where(before < m, 0, before - m + 1)
        self.wavelet = WaveletMatrix(bwt, self.sigma)
        counts = np.bincount(symbols, minlength=self.sigma) if n else np.zeros(1, np.int64)
        self.before = m + np.cumsum(counts) - counts  # suffixes that start with a smaller symbol
        of = np.empty(n + m, np.int64)
        of[self.place] = owner
        of[ends] = np.arange(m)
        self.weight = np.concatenate([[0], np.cumsum(weights[of[order]])])
        self.rows = n + m

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + pattern for each interval of a pattern."""
        both = self.before[np.concatenate([symbol, symbol])] + self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[: len(low)], both[len(low) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_windows(symbols: np.ndarray, bounds: np.ndarray, weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur at least twice in all segments, counting weights."""
    index = FMIndex(symbols, bounds, weights)
    start, size = bounds[:-1], np.diff(bounds)
    change = [np.zeros(max(0, s - window + 1) + 1, np.int64) for s in size.tolist()]
    own = np.flatnonzero(size >= window)
    end = size[own] - 1  # the last word of the pattern
    at = end.copy()  # the word that comes next
    low, high = np.zeros(len(own), np.int64), np.full(len(own), index.rows)
    back = np.full(len(own), -1)  # in a probe: the end to go on from if the probe is repeated
    stop = np.zeros(len(own), np.int64)  # a probe's first word, else 0
    while len(own):
        low, high = index.extend(low, high, symbols[start[own] + at])
        ok = index.occurrences(low, high) >= 2
        through = ok & (at == stop)
        at = np.where(ok, at - 1, at)
        probe = back >= 0
        # a pattern that matched down to the segment's first word, or broke at word `at`
        for k in np.flatnonzero((through | ~ok) & ~probe).tolist():
            a, b = (0 if through[k] else int(at[k]) + 1), int(end[k]) - window + 1
            if a <= b:
                change[own[k]][a] += 1
                change[own[k]][b + 1] -= 1
        broke = ~ok & ~probe
        nxt = np.where(at + window <= end, at + window - 1, end - 1)  # the next end that is left to judge
        look = broke & (nxt >= window - 1) & (nxt > at + 2)
        passed, failed = probe & through, probe & ~ok
        again = (broke & ~look) | passed | failed
        # a failed probe at..at + 2 means that no window over it is repeated
        target = np.where(passed, back, np.where(failed, np.minimum(back, end - 1), nxt))
        gone = (through & ~probe) | (again & (target < window - 1))
        end = np.where(again, target, np.where(look, at + 2, end))
        back = np.where(again, -1, np.where(look, nxt, back))
        stop = np.where(again, 0, np.where(look, at, stop))
        new = again | look
        at = np.where(new, end, at)
        low, high = np.where(new, 0, low), np.where(new, index.rows, high)
        if gone.any():
            own, end, at, low, high, back, stop = (x[~gone] for x in (own, end, at, low, high, back, stop))
    return [np.cumsum(c[:-1]) > 0 for c in change]


def judge(bodies: list[bytes], copies: np.ndarray, routes: np.ndarray) -> list[np.ndarray]:
    words = pa.array(b" ".join(bodies).split(b" "), pa.binary()).dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum([b.count(b" ") + 1 for b in bodies])])
    return repeated_windows(words.indices.to_numpy().astype(np.int64) + 1, bounds, copies, WINDOW)


def _kept(docs: DataFrame, schema: T.StructType, row) -> DataFrame:
    """row(texts, words, keeps) makes the columns after those of docs (without text and spans if they are not in schema)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
            kept = []
            for w, s in zip(words, batch.column("_spans").to_pylist(), strict=True):
                if s:
                    out, last = [], 0
                    for a, b in unpack(s).tolist():
                        out += w[last:a]
                        last = b
                    kept.append(out + w[last:])
                else:
                    kept.append(w)
            yield pa.RecordBatch.from_arrays(row(batch, words, kept), names=schema.names)

    return docs.mapInArrow(runtime.trimmed(run), schema)


def spans_of(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    return with_spans(docs, Words, judge, shard, "_spans")


def dedup(docs: DataFrame, least: int = 1) -> DataFrame:
    """docs with the repeated words cut out of text (kept words joined by one space); texts that lose no word stay as
    they are. Documents that lose words and keep fewer than `least` go. n_chars, if there, follows the text."""
    schema = T.StructType(docs.schema.fields)

    def row(batch: pa.RecordBatch, words: list[list[bytes]], kept: list[list[bytes]]) -> list[pa.Array]:
        old = batch.column("text").to_pylist()
        texts = [o if len(w) == len(k) else (b" ".join(k).decode() if len(k) >= least else None) for o, w, k in zip(old, words, kept, strict=True)]
        gone = pa.array([len(w) != len(k) and len(k) < least for w, k in zip(words, kept, strict=True)])
        cut = pa.array([len(w) != len(k) for w, k in zip(words, kept, strict=True)])
        cols = []
        for f in schema.fields:
            c = batch.column(f.name)
            if f.name == "text":
                c = pa.array(texts, pa.string())
            elif f.name == "n_chars":
                c = pa.compute.if_else(cut, pa.array([len(t or "") for t in texts], c.type), c)
            cols.append(c.filter(pa.compute.invert(gone)))
        return cols

    return _kept(spans_of(docs), schema, row)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def row(batch: pa.RecordBatch, words: list[list[bytes]], kept: list[list[bytes]]) -> list[pa.Array]:
        n = [len(w) for w in words]
        gone = [len(w) - len(k) for w, k in zip(words, kept, strict=True)]
        return [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())]

    return _kept(spans_of(docs), schema, row)


#: The same rows by every window's words, for DuckDB.
OP8_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(l[i : i + 34], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS i FROM texts)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM repeated),
words AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS w FROM texts),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY words.k) AS t FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.k = covered.k WHERE covered.k IS NULL GROUP BY words.doc_id)
SELECT texts.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM texts LEFT JOIN kept ON texts.doc_id = kept.doc_id
"""
