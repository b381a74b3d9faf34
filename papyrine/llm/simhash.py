"""SimHash near-duplicates through segment bit counts.

A 64-bit fingerprint maps to the bit counts of its 16 four-bit segments. Two fingerprints that differ in d bits differ by
at most d in the Manhattan distance of these counts, so all links at MAX_BITS = 2 lie within distance 2 on that grid. Two
grid points within distance 2 share a point within distance 1 of both; each distinct fingerprint is dealt to its own cell
and the 32 cells next to it, and a cell's members are compared exactly. Members of a cell with more than CELL
fingerprints are not compared in pairs: they meet at the 65 values within one bit of each, which is exact as well.

Defined results: null and empty texts have fingerprint zero and link like any other; equal texts always share a component;
repeated rows give repeated rows; a null id takes part, and a component of null ids only has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import runtime
from papyrine.llm.components import connected_components
from papyrine.llm.runtime import attach, attach_parts, materialize, release

MAX_BITS = 2
#: Hashes whose bits are counted at a time, and documents that are hashed at a time.
PIECE, DOCS = 1 << 14, 100
#: Fingerprints of a cell that are compared with each other; larger cells go another, exact way.
CELL = 64
SEED = 42
#: keep_one: similarity that links, in fifths; documents whose shingles are counted and shingles known as frequent.
FIFTHS, SAMPLE, FREQUENT = 4, 30_000, 200_000
#: Distances, in the order of sizes, at which the members of a shingle are compared, one round for each.
ROUNDS = [(1, 2), (3, 64), (65, 1 << 40)]


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each run of `width` words, A-Z lower-cased, repeats included; of the whole if there are fewer words."""
    from xxhash import xxh64_intdigest as xx

    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return []
    line = b" ".join(words)
    if n <= width:
        return [xx(line, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    del words
    ends = np.cumsum(sizes + 1)
    starts = (ends[: n - width + 1] - sizes[: n - width + 1] - 1).tolist()
    return [xx(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingle hashes of a text."""
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    total = np.cumsum(counts[full])
    at = 0
    while at < len(full):  # PIECE hashes at a time, some 400 bytes each; a longer text by itself
        to = max(at + 1, int(np.searchsorted(total, total[at] - counts[full[at]] + PIECE, side="right")))
        own = full[at:to]
        if to == at + 1:
            h = np.asarray(hashes[own[0]], np.uint64)
            ones = sum(_bits(h[k : k + PIECE]).sum(axis=0, dtype=np.int64) for k in range(0, len(h), PIECE))[None, :]
        else:
            bits = _bits(np.concatenate([np.asarray(hashes[k], np.uint64) for k in own]))
            ones = np.add.reduceat(bits, np.cumsum(counts[own]) - counts[own], axis=0, dtype=np.uint32)
        out[own] = _majority(ones, counts[own])
        at = to
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def prefix(own: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a sorted set, the rarest first: two sets that are similar have one of these in common.

    A set of n shares at least 4/5 n with a similar one, so it misses n // 5 at most, in any order that all sets agree on.
    """
    known, counts = often
    rank = np.zeros(len(own), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        rank = np.where(known[at] == own, counts[at], 0)
    return own[np.argsort(rank, kind="stable")[: len(own) - (FIFTHS * len(own) + 4) // 5 + 1]]


def sketch(own: np.ndarray) -> bytes:
    """For each of 2^k bins, one at least for each member of a set, whether an odd number of members fall into it."""
    bins = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible(a: bytes, b: bytes, total: int) -> bool:
    """Whether two sets of `total` members together can be similar: each bin in which their sketches differ has a member
    that only one of them has, and similar sets have total / 9 of these at most."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):  # bins of the larger one that fall together
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return 9 * int(np.bitwise_count(x ^ y).sum()) <= total


def with_fingerprint(docs: DataFrame, width: int, text_col: str = "text", columns: list[str] | None = None, name: str = "fp", often: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The columns named (all by default) and the fingerprint as a long with the same bits; with often, also a digest of
    the set of shingles (node), its size, its prefix and its sketch."""
    runtime.prepare(docs.sparkSession)
    columns = docs.columns if columns is None else columns
    more = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(name, T.LongType())] + more * (often is not None))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xx

        for batch in runtime.sliced(batches, DOCS):
            hashes = [np.array(shingle_hashes(t.as_py(), width), np.uint64) for t in batch.column(text_col)]
            fp, parts = fingerprints(hashes), []
            if often is not None:
                sets = [np.unique(h) for h in hashes]
                node = np.array([xx(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                first = [prefix(x, often).view(np.int64) if len(x) else x.view(np.int64) for x in sets]
                parts = [pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fp.view(np.int64)), *parts], names=schema.names)

    return docs.select(*dict.fromkeys([*columns, text_col])).mapInArrow(runtime.trimmed(blocks), schema)


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur most often in a sample of about SAMPLE documents, sorted, and their numbers. Which ones they
    are decides only how many pairs are compared, not which are found."""
    runtime.prepare(docs.sparkSession)
    part = int((1 << 30) * min(1.0, SAMPLE / max(1, docs.count())))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.sliced(batches, DOCS):
            sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    own = docs.where(F.pmod(F.xxhash64("text", F.lit(91)), F.lit(1 << 30)) < part).select("text")
    top = own.mapInArrow(runtime.trimmed(blocks), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    known = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], top["n"].to_numpy()[order]


def cells_of(fps: np.ndarray) -> np.ndarray:
    """One row of 33 cells for each fingerprint (uint64). A cell packs the 16 counts, each plus 1, in four bits each."""
    pairs = fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    counts = (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))
    own = counts + np.uint64(0x1111111111111111)
    step = np.uint64(1) << (np.uint64(4) * np.arange(16, dtype=np.uint64))
    return np.concatenate([own[:, None], own[:, None] + step, own[:, None] - step], axis=1)


@runtime.trimmed
def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        cells = cells_of(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().view(np.int64)), pa.array(np.repeat(fp, 33))], names=["cell", "fp"])


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: links within each cell, verified; members of cells of over `most` with a null partner."""
    cell, fp, open_large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def runs(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        length = np.diff(np.append(start, len(cell)))
        each = np.repeat(length, length)
        large = fp[each > most]
        left = np.repeat(start + length, length) - np.arange(len(cell))  # members from here to the end of the run
        at = np.flatnonzero((each <= most) & (left > 1))
        a, b, k = [], [], 1
        while len(at):
            x, y = fp[at], fp[at + k]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= MAX_BITS
            a.append(x[near])
            b.append(y[near])
            k += 1
            at = at[left[at] > k]
        return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]), large

    def out(a: np.ndarray, b: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(large), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([links[:, 0], large])), pa.concat_arrays([pa.array(links[:, 1]), none])], names=["a", "b"])

    for batch in batches:
        c, f = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
        if open_large is not None:
            same = c == open_large
            if same.any():
                yield out(*[np.zeros(0, np.int64)] * 2, f[same])
                c, f = c[~same], f[~same]
            if not len(c):
                continue
            open_large = None
        cell, fp = np.concatenate([cell, c]), np.concatenate([fp, f])
        last = int(np.searchsorted(cell, cell[-1]))
        if last:
            yield out(*runs(cell[:last], fp[:last]))
            cell, fp = cell[last:], fp[last:]
        if len(cell) > most:
            open_large = cell[-1]
            yield out(*[np.zeros(0, np.int64)] * 2, fp)
            cell, fp = cell[:0], fp[:0]
    if len(cell):
        yield out(*runs(cell, fp))


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp) that link; of a dense crowd, enough of them to connect it."""
    dealt = distinct.select("fp").mapInArrow(_deal, "cell long, fp long")
    found = materialize(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _compare(it, cell), "a long, b long"), "links")
    crowd = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    near = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])).alias("at"))
    met = near.groupBy("at").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")  # 65 members at most
    met = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b")
    return found.where("b is not null").union(met).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, columns: list[str] | None = None, often: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(id_col, fp) of every row, with the columns named and, with often, the prefix of its set; (fp, component, first) for each distinct fingerprint, and their number.

    component is the smallest id that links reach, first the smallest fingerprint among them.
    """
    marked = materialize(with_fingerprint(docs, width, text_col, [id_col, *(columns or [])], often=often), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("rep")), "distinct")
    n = distinct.count()
    label = connected_components(links(distinct, cell)).withColumnRenamed("node", "fp")
    linked = label.count()
    least = label.join(distinct, "fp").groupBy("label").agg(F.min("rep").alias("component"))
    least = materialize(least, "least")
    of = materialize(attach(label, least, "label", linked, 40), "components")
    groups = attach(distinct, of, "fp", linked, 40)
    groups = materialize(groups.select("fp", F.coalesce("component", "rep").alias("component"), F.coalesce("label", "fp").alias("first")), "groups")
    release(distinct, label, least, of)
    return marked, groups, n


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by sig: its columns, whole runs of a sig at a time, and the bounds of the runs of two rows and more."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> dict[str, np.ndarray]:
        x = {c: rows[c].to_numpy() for c in rows.column_names}
        start = np.flatnonzero(np.concatenate([[True], x["sig"][1:] != x["sig"][:-1]]))
        length = np.diff(np.append(start, len(x["sig"])))
        return x | {"length": np.repeat(length, length), "left": np.repeat(start + length, length) - np.arange(len(x["sig"])), "start": np.repeat(start, length)}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 100_000 or held[0]["sig"][0] == batch["sig"][-1]:
            continue
        rows = pa.Table.from_batches(held)
        sig = rows["sig"].to_numpy()
        last = int(np.searchsorted(sig, sig[-1]))
        yield out(rows.slice(0, last))
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield out(pa.Table.from_batches(held))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose sig another row has, and how many rows have it."""
    for x in _runs(batches):
        keep = x["length"] > 1
        x["copies"] = x["length"]
        names = ["sig", "node", "size", "pos", "copies"]
        yield pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in names], names=names)


def _candidates(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sig, size and node: pairs of a sig, `least` to `most` rows apart, in different groups, that sizes and
    places let be similar. A pair passes at the first sig that it shares, where what follows bounds what it can share."""
    names = ["a", "b", "first_a", "first_b"]
    for x in _runs(batches):
        node, size, pos, root, left = x["node"], x["size"].astype(np.int64), x["pos"].astype(np.int64), x["root"], x["left"]
        other = np.zeros(len(node) + 1, np.int64)  # changes of root within runs, to leave out runs of one group
        change = (root[1:] != root[:-1]) & (x["start"][1:] == x["start"][:-1])
        other[2:] = np.cumsum(change) if len(node) > 1 else 0
        ends = x["start"] + x["length"]
        mixed = other[ends] - other[np.minimum(x["start"] + 1, len(node))] > 0
        at, k, held, n = np.flatnonzero(mixed & (left > least)), least, [], 0

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *held]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, j]) for j in range(4)], names=names)

        while len(at) and k <= most:
            to = at + k
            alike = 5 * size[at] >= FIFTHS * size[to]
            at, to = at[alike], to[alike]  # sizes only grow from here
            both = np.minimum(size[at] - pos[at], size[to] - pos[to])  # this sig and what follows it
            good = ((5 + FIFTHS) * both >= FIFTHS * (size[at] + size[to])) & (root[at] != root[to])
            i, j = at[good], to[good]
            swap = node[i] > node[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            held.append(np.stack([node[i], node[j], x["first"][i], x["first"][j]], 1))
            n += len(i)
            if n > 500_000:
                yield out(held)
                held, n = [], 0
            k += 1
            at = at[left[at] > k]
        yield out(held)


def plausible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs that the sketches of their sets let be similar: some 150 bytes a pair instead of both sets."""
    ends = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), "ends")
    own = attach(marked.select("node", "size", "sketch"), ends, "node", ends.count(), 24, "inner", salts=1)
    own = materialize(own.dropDuplicates(["node"]), "sketches")
    m, width = own.agg(F.count("*"), F.avg(F.length("sketch"))).first()
    both = pairs
    for c in ("a", "b"):
        side = own.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        both = attach(both, side, c, m, 32 + int(width or 0), "inner", salts=1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = pc.add(batch.column("size_a"), batch.column("size_b")).to_pylist()
            keep = [possible(a, b, n) for a, b, n in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), total, strict=True)]
            yield batch.select(["a", "b", "first_a", "first_b"]).filter(pa.array(keep, pa.bool_()))

    out = materialize(both.mapInArrow(runtime.trimmed(judge), "a long, b long, first_a long, first_b long"), "plausible")
    release(ends, own)
    return out


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, width: int, repeats: bool = True) -> DataFrame:
    """first_a, first_b of the pairs whose sets of shingles are similar. rows has a row's key, _row, for each node; repeats:
    whether docs can have a _row twice."""
    needed = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(rows, "node"), "needed")
    m = needed.count()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runtime.sliced(batches, DOCS):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t.as_py(), width).tobytes() for t in batch.column("text")], pa.binary())], names=["node", "shingles"])

    own = attach_parts(docs.select("_row", "text"), needed, "_row", m, 32, "inner")
    own = own.dropDuplicates(["node"]) if repeats else own
    own = materialize(own.mapInArrow(runtime.trimmed(sets), "node long, shingles binary"), "sets")
    often = materialize(pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / 100).cast("int").alias("salts")), "often")
    dealt = attach(pairs, often, "b", m, 24, "inner").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    members = dealt.select("b", "salt", F.col("a").alias("node"), "first_a", "first_b")
    heads = often.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("b").alias("node"), F.lit(None).cast("long").alias("first_a"), F.lit(None).cast("long").alias("first_b"))
    sides = members.union(heads).join(own, "node").select("b", "salt", (F.col("node") != F.col("b")).alias("member"), "first_a", "first_b", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = np.zeros(0, np.uint64), None
        for batch in batches:
            a, b = [], []
            for rep, salt, member, first_a, first_b, raw in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not member:
                    head, at = own, (rep, salt)
                elif at == (rep, salt):
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if 5 * both >= FIFTHS * (len(own) + len(head) - both):
                        a.append(first_a)
                        b.append(first_b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["first_a", "first_b"])

    out = sides.repartition("b", "salt").sortWithinPartitions("b", "salt", "member").mapInArrow(runtime.trimmed(compare), "first_a long, first_b long")
    out = materialize(out.distinct(), "similar")
    release(needed, own, often)
    return out


def similar(docs: DataFrame, marked: DataFrame, groups: DataFrame, n: int, width: int, repeats: bool = True) -> DataFrame:
    """node, label: components of the groups' smallest fingerprints (first) by the links of all their documents whose
    sets of shingles have a Jaccard similarity of 0.8.

    Sets that share a shingle of their prefixes are candidates, so that none is missed. A shingle's sets are sorted by size
    and compared in rounds, the nearest first; pairs that earlier rounds have joined are left out, all others are compared,
    first by their sketches, then by their sets.
    """
    tagged = attach(marked.select("node", "size", "prefix", "fp", "_row"), groups.select("fp", "first"), "fp", n, 40).where("size > 0")
    nodes = materialize(tagged.groupBy("node").agg(F.min("_row").alias("_row"), F.min("first").alias("first")), "nodes")
    m = nodes.count()
    spread = tagged.dropDuplicates(["node"]).select("node", "size", F.posexplode("prefix").alias("pos", "sig"))
    met = spread.repartition("sig").sortWithinPartitions("sig").mapInArrow(runtime.trimmed(_shared), "sig long, node long, size int, pos int, copies long")
    met = materialize(met, "met")
    # documents of one set whose shingles repeat differently, so that their fingerprints differ
    same = attach(tagged.select("node", F.col("first").alias("first_a")).distinct(), nodes.select("node", F.col("first").alias("first_b")), "node", m, 24, "inner", salts=1)
    edges = materialize(same.where("first_a != first_b").select("first_a", "first_b").distinct(), "same")
    label, before = connected_components(edges.toDF("a", "b")), None
    for least, most in ROUNDS:
        linked = label.count()
        root = attach(nodes.select("node", "first"), label.select(F.col("node").alias("first"), "label"), "first", linked, 40)
        root = materialize(root.select("node", "first", F.coalesce("label", "first").alias("root")), "roots")
        rows = attach(met.where(F.col("copies") > least).drop("copies"), root, "node", m, 40, "inner", salts=1).repartition("sig").sortWithinPartitions("sig", "size", "node")
        pairs = rows.mapInArrow(runtime.trimmed(lambda it, x=least, y=most: _candidates(it, x, y)), "a long, b long, first_a long, first_b long").distinct()
        pairs = materialize(pairs if before is None else pairs.join(before.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        release(root)
        if pairs.limit(1).count():
            left = plausible(pairs, marked)
            found = verified(left, docs, nodes.select("node", "_row"), width, repeats)
            release(left)
            edges = edges.union(found)
            label = connected_components(edges.toDF("a", "b"))
        before = pairs if before is None else before.union(pairs)
    release(nodes, met)
    return label


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs less all but one document of each group of near-duplicates: fingerprints that link, and sets of shingles that
    are similar. The smallest id of a group stays, an id before none; of equal ids, one by a hash of the whole row."""
    columns = docs.columns
    rows = docs.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns]))
    marked, groups, n = near_duplicates(rows, width, columns=["_row"], often=frequent(docs, width))
    copies = marked.groupBy("_row").count()
    total, whole = copies.agg(F.sum("count"), F.count("*")).first()
    repeats = total != whole  # rows that are equal in all columns
    more = similar(rows, marked, groups, n, width, repeats)
    groups = attach(groups.select("fp", "first"), more.select(F.col("node").alias("first"), "label"), "first", more.count(), 40)
    groups = materialize(groups.select("fp", F.coalesce("label", "first").alias("group")), "kept")
    placed = attach(marked.select("doc_id", "_row", "fp"), groups, "fp", n, 40)
    best = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best"))
    best = materialize(best.select("best._row").distinct(), "best")
    m = best.count()
    if m <= whole - m:
        kept = attach_parts(rows, best, "_row", m, 24, "inner")
    else:  # what goes is less
        gone = materialize(marked.select("_row").distinct().join(best, "_row", "left_anti"), "gone")
        kept = attach_parts(rows, gone, "_row", whole - m, 24, "left_anti")
    if repeats:
        twice = copies.where("count > 1").select("_row")
        w = twice.count()
        kept = attach_parts(kept, twice, "_row", w, 24, "left_anti").union(attach_parts(kept, twice, "_row", w, 24, "inner").dropDuplicates(["_row"]).select(kept.columns))
    return kept.select(*[F.col(f"`{c}`") for c in columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    marked, groups, n = near_duplicates(docs)
    rows = attach(marked, groups.select("fp", "component"), "fp", n, 40)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
