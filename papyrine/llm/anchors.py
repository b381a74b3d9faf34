"""Which windows of a text can occur elsewhere, and where to compare them: content-chosen anchors.

A window is `length` units (words or bytes) of one document. Of the grams in a window, the one with the smallest hash (the
leftmost of equals) is the window's anchor. Equal windows have equal anchors, at equal places in them, so all occurrences
of a window meet at the anchor's hash. Consecutive windows with one anchor form a segment; every window is in exactly
one. Segments are counted by (anchor, content); only anchors with at least two occurrences go on. Their segments are
dealt by anchor, each distinct content once with its count, to an index that judges every window. Anchors with very many
distinct contents have their windows dealt one by one, by the window's own hash, so that no group grows with the table.

The set of anchors that occur twice is sent to the tasks as a bitmap of at most MAX_BITS bits; where it is too small for
a table it lets through more candidates, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm import runtime
from papyrine.llm.runtime import attach_counted, attach_parts, materialize, release

#: Units that are hashed at a time; a longer text is taken in overlapping pieces, cut between windows.
BLOCK = 1 << 20
MAX_BITS, CHUNKS = 1 << 29, 1024
#: An anchor is crowded if it has more distinct contents than CROWD. Their list goes to the tasks, MAX_CROWDED at most:
#: with over CROWD * MAX_CROWDED contents the limit rises so that no more can reach it.
CROWD, MAX_CROWDED = 2000, 4_000_000
#: Contents that a task remembers as sent; rows and bytes of candidates that a task gathers before it counts contents.
SENT, ROWS, GATHERED = 200_000, 200_000, 8 << 20
_B = 0x9E3779B97F4A7C15
_BACK = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hashes' base and of its inverse modulo 2^64, as far as they have been needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, base in (("up", _B), ("down", _BACK)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


class Rolling:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = Powers.to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


@dataclass
class Segments:
    """Of one block: first window and number of windows (in units of the text), text, anchor and content hashes."""

    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    rolling: Rolling
    offset: np.ndarray


def segments(units: np.ndarray, starts: np.ndarray, length: int, gram: int) -> Segments:
    """units: hashes of all units of a block's texts; starts: where each text starts, and the end."""
    n = len(units)
    rolling = Rolling(units)
    grams = rolling.hash(slice(0, n - gram + 1), slice(gram, n + 1)) if n >= gram else np.zeros(0, np.uint64)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, done = length - gram + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:]) if len(least) > done else least[:0]
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :]) if len(least) > width - done else least[:0]
    at = (least & low).astype(np.int64)
    # a window has to lie in one text
    size = np.diff(starts)
    windows = np.maximum(0, size - length + 1)
    text = np.repeat(np.arange(len(size)), windows)
    place = np.repeat(starts[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    at = at[place]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    first, text = place[head], text[head]
    content = rolling.hash(first, first + count + length - 1) + count.astype(np.uint64) * np.uint64(_B)
    return Segments(first, count, text, grams[at[head]], mix(content), rolling, starts)


class Words:
    """Units are words, separated by white space of ASCII."""

    length, gram = 35, 8

    @staticmethod
    def units(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words joined by single spaces, where each word starts and ends."""
        line = b" ".join(text.encode().split()) if text else b""
        if not line:
            return line, np.zeros(0, np.int64), np.zeros(0, np.int64)
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        return line, np.append(0, gaps + 1), np.append(gaps, len(line))

    @classmethod
    def windows(cls, body: bytes) -> int:
        return body.count(b" ") + 2 - cls.length

    @staticmethod
    def hashes(line: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        r = Rolling(np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1))
        return r.hash(starts, ends)


class Bytes:
    """Units are bytes of the UTF-8 text."""

    length, gram = 400, 32
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B))

    @staticmethod
    def units(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
        line = text.encode() if text else b""
        at = np.arange(len(line))
        return line, at, at + 1

    @classmethod
    def windows(cls, body: bytes) -> int:
        return len(body) + 1 - cls.length

    @classmethod
    def hashes(cls, line: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return cls.table[np.frombuffer(line, np.uint8)]


def blocks(kind, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """Unit hashes, text bounds and (row, first unit, line, word starts, word ends) of each text or piece, in blocks."""
    held, size, pieces = [], 0, []

    def flush():
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
        return np.concatenate([np.zeros(0, np.uint64), *held]), bounds, pieces

    for row, text in enumerate(texts):
        line, starts, ends = kind.units(text)
        if len(starts) < kind.length:
            continue
        own = kind.hashes(line, starts, ends)
        for a in range(0, len(own) - kind.length + 1, BLOCK):
            piece = own[a : a + BLOCK + kind.length - 1]
            if size and size + len(piece) > BLOCK:
                yield flush()
                held, size, pieces = [], 0, []
            held.append(piece)
            pieces.append((row, a, line, starts, ends))
            size += len(piece)
    if held:
        yield flush()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(docs: DataFrame, kind) -> DataFrame:
    """anchor, content of every segment of docs (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units, bounds, _ in blocks(kind, batch.column("text").to_pylist()):
                s = segments(units, bounds, kind.length, kind.gram)
                yield pa.RecordBatch.from_arrays([_signed(s.anchor), _signed(s.content)], names=["anchor", "content"])

    return docs.select("text").mapInArrow(runtime.trimmed(run), "anchor long, content long")


def bitmap(repeated: DataFrame, n: int) -> np.ndarray:
    """A bit for each anchor, at its hash; the driver gets the bitmap only, at most MAX_BITS bits."""
    bits = 1 << 16
    while bits < min(MAX_BITS, 16 * n):
        bits *= 2
    part = bits // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = (batch.column("anchor").to_numpy().view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            for chunk in np.unique(slot // part).tolist():
                own = held.setdefault(chunk, np.zeros(part // 8, np.uint8))
                at = slot[slot // part == chunk] % part
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(held), pa.int32()), "bits": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    dealt = repeated.select("anchor", F.shiftrightunsigned(F.col("anchor").bitwiseAND(F.lit(bits - 1)), part.bit_length() - 1).alias("chunk")).repartition("chunk")
    out = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(runtime.trimmed(run), "chunk int, bits binary").toLocalIterator():
        out[r.chunk * (part // 8) : (r.chunk + 1) * (part // 8)] |= np.frombuffer(r.bits, np.uint8)
    return out


def candidates(docs: DataFrame, kind, shared) -> DataFrame:
    """Segments whose anchors occur twice: key, first, count, route, content, body (null but once for each in a task, or
    a few times if it has over SENT).

    A crowded anchor's windows come one by one, routed by their own hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, crowded = shared.value
        mask = np.uint64(len(bits) * 8 - 1)
        sent: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for units, bounds, pieces in blocks(kind, batch.column("text").to_pylist()):
                s = segments(units, bounds, kind.length, kind.gram)
                slot = (s.anchor & mask).astype(np.int64)
                keep = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                first, count, text, route, content = (x[keep] for x in (s.first, s.count, s.text, s.anchor, s.content))
                if len(crowded) and (many := crowded[np.minimum(np.searchsorted(crowded, route), len(crowded) - 1)] == route).any():
                    each = np.repeat(np.flatnonzero(many), count[many])
                    at = np.arange(len(each)) - np.repeat(np.cumsum(count[many]) - count[many], count[many])
                    one = first[each] + at
                    own = s.rolling.hash(one, one + kind.length)
                    join = lambda a, b: np.concatenate([a[~many], b])
                    first, count, text, route, content = join(first, one), join(count, np.ones(len(one), np.int64)), join(text, text[each]), join(route, own), join(content, mix(own ^ np.uint64(_B)))
                if not len(first):
                    continue
                _, lead = np.unique(content, return_index=True)
                bodies = [None] * len(first)
                row, unit = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
                place = first - bounds[text] + unit[text]
                if len(sent) > SENT:
                    sent.clear()
                for k, own in zip(lead.tolist(), content[lead].tolist(), strict=True):
                    if own in sent:
                        continue
                    sent.add(own)
                    _, _, line, starts, ends = pieces[text[k]]
                    bodies[k] = line[starts[place[k]] : ends[place[k] + count[k] + kind.length - 2]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[row[text]]), pa.array(place), pa.array(count.astype(np.int32)), _signed(route), _signed(content), pa.array(bodies, pa.binary())], names=["key", "first", "count", "route", "content", "body"]
                )

    return docs.select("key", "text").mapInArrow(runtime.trimmed(run), "key long, first long, count int, route long, content long, body binary")


def contents_of(found: DataFrame) -> DataFrame:
    """route, content, copies, body of the candidates, dealt by route. Contents are counted within tasks first, and the
    bodies are moved once."""

    def count(rows: pa.Table) -> pa.RecordBatch:
        route, content = rows["route"].to_numpy(), rows["content"].to_numpy()
        order = np.lexsort((content, route))
        route, content = route[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (route[1:] != route[:-1]) | (content[1:] != content[:-1])
        head = np.flatnonzero(new)
        body = rows["body"].combine_chunks()
        none = len(order)
        first = np.minimum.reduceat(np.where(body.is_valid().to_numpy(zero_copy_only=False)[order], order, none), head)
        bodies = body.take(pa.array(first, pa.int64(), mask=first == none))
        copies = np.diff(np.append(head, none))
        return pa.RecordBatch.from_arrays([pa.array(route[head]), pa.array(content[head]), pa.array(copies, pa.int64()), bodies], names=["route", "content", "copies", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            size += batch.column("body").nbytes
            if rows >= ROWS or size >= GATHERED:
                yield count(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if rows:
            yield count(pa.Table.from_batches(held))

    own = found.select("route", "content", "body").mapInArrow(runtime.trimmed(run), "route long, content long, copies long, body binary")
    return own.repartition("route").groupBy("route", "content").agg(F.sum("copies").alias("copies"), F.first("body", ignorenulls=True).alias("body"))


#: judge(bodies, counts): for each body (of one task's routes, whole routes together), which of its windows repeat.
Judge = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


def verdicts(contents: DataFrame, kind, judge: Judge, shard: int) -> DataFrame:
    """route, content, copies, marks (a bit for each window, packed) of contents (dealt by route) with repeated windows."""

    def finish(routes: np.ndarray, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        content, copies, bodies = (list(x) for x in zip(*rows, strict=True))
        copies = np.array(copies)
        _, group, members = np.unique(routes, return_inverse=True, return_counts=True)
        # a content that occurs twice repeats in all its windows; one alone on its route has nothing to be equal to
        once = np.bincount(group, weights=copies == 1)[group] > 0
        own = np.flatnonzero((members[group] > 1) & once)
        marks = judge([bodies[k] for k in own], copies[own], routes[own]) if len(own) else []
        some = [(k, m) for k, m in zip(own.tolist(), marks, strict=True) if m.any()]
        some += [(k, np.ones(kind.windows(bodies[k]), bool)) for k in np.flatnonzero((copies > 1) & ~((members[group] > 1) & once)).tolist()]
        if some:
            at = [k for k, _ in some]
            yield pa.RecordBatch.from_arrays([pa.array(routes[at]), pa.array([content[k] for k in at]), pa.array(copies[at]), pa.array([np.packbits(m, bitorder="little").tobytes() for _, m in some], pa.binary())], names=["route", "content", "copies", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, routes, size = [], [], 0
        for batch in batches:
            route = batch.column("route").to_pylist()
            for r, *row in zip(route, *(batch.column(c).to_pylist() for c in ("content", "copies", "body")), strict=True):
                if size >= shard and r != routes[-1]:
                    yield from finish(np.array(routes), rows)
                    rows, routes, size = [], [], 0
                rows.append(tuple(row))
                routes.append(r)
                size += len(row[2])
        if rows:
            yield from finish(np.array(routes), rows)

    return contents.sortWithinPartitions("route", "content").mapInArrow(runtime.trimmed(run), "route long, content long, copies long, marks binary")


def spans(found: DataFrame, length: int) -> DataFrame:
    """key, spans: the covered units of each document as merged (from, to) pairs of 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for firsts, marks in zip(batch.column("firsts").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                at = np.concatenate([f + np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")) for f, m in zip(firsts, marks, strict=True)])
                at = np.unique(at)
                new = np.flatnonzero(np.concatenate([[True], at[1:] - at[:-1] > length]))
                last = np.append(new[1:] - 1, len(at) - 1)
                out.append(np.stack([at[new], at[last] + length], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "spans"])

    rows = found.groupBy("key").agg(F.collect_list(F.struct("first", "marks")).alias("rows"))  # of one document
    return rows.select("key", F.col("rows.first").alias("firsts"), F.col("rows.marks").alias("marks")).mapInArrow(runtime.trimmed(run), "key long, spans binary")


def repeated_spans(docs: DataFrame, kind, judge: Judge, shard: int, crowd: int = CROWD) -> tuple[DataFrame, int, int]:
    """key, spans for each key of docs (key, text) with repeated windows; their number and the bytes of a row."""
    spark = runtime.prepare(docs.sparkSession)
    seen = anchors(docs, kind).groupBy("anchor", "content").agg(F.count("*").alias("n"))
    seen = seen.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("contents")).where("n > 1")
    seen = materialize(seen, "anchors")
    n, most = seen.agg(F.count("*"), F.sum("contents")).first()
    crowded = seen.where(F.col("contents") > max(crowd, (most or 0) // MAX_CROWDED)).select("anchor").toArrow()["anchor"].to_numpy()
    shared = spark.sparkContext.broadcast((bitmap(seen, n), np.sort(crowded.view(np.uint64))))
    found = materialize(candidates(docs, kind, shared), "candidates")
    marks = materialize(verdicts(contents_of(found), kind, judge, shard), "marks")
    size, width = marks.agg(F.count("*"), F.avg(F.length("marks"))).first()
    own = attach_counted(found.drop("body", "count"), marks, ["route", "content"], size, 60 + int(width or 0))
    out = materialize(spans(own.select("key", "first", "marks"), kind.length), "spans")
    size, width = out.agg(F.count("*"), F.avg(F.length("spans"))).first()
    release(seen, found, marks)
    return out, size, 60 + int(width or 0)


def with_spans(docs: DataFrame, kind, judge: Judge, shard: int, name: str, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text and others) with a column `name`: null, or pairs of (from, to) units in repeated windows."""
    key = F.xxhash64("doc_id", "text")
    out, n, width = repeated_spans(docs.select(key.alias("key"), "text"), kind, judge, shard, crowd)
    out = out.select(F.col("key").alias("_key"), F.col("spans").alias(name))
    return attach_parts(docs.withColumn("_key", key), out, "_key", n, width).drop("_key")


def unpack(spans: bytes | None) -> np.ndarray:
    return np.frombuffer(spans, "<i8").reshape(-1, 2) if spans else np.zeros((0, 2), np.int64)
