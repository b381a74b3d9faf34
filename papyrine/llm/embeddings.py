"""Embedding near-duplicates by NN-descent.

Vectors that are equal are one node with a count. Neighbour lists start from random-hyperplane codes: for each of TABLES
codes, nodes are sorted by code and compared within overlapping runs of RUN. Rounds of NN-descent then compare the
neighbours of each node (both ways) with each other and keep each list's best. A list in which every entry links is
saturated and doubles, up to MOST. Of a run's entries under FLOOR, twice the link's angle away, each node's WEAK best are
kept as well: two vectors that link can share a neighbour far from both. Links, and the links seen in any run, give
components. The number of links of a node is then counted exactly within its component, in blocks of about BLOCK on the
same sides of hyperplanes: two blocks whose centres and radii prove that all or none of their pairs link are not
multiplied. An audit compares AUDIT vectors with all vectors; each one's part of links found is averaged so that a group
counts as one, whatever its size. While the average is under RECALL, more tables are added; after TRIES times it is an
error. Each length of vectors is handled on its own.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing (also not with their
equals); vectors link within their length only; equal vectors link; repeated rows are vectors of their own; a null
vec_id is counted as a partner and is not kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm import runtime
from papyrine.llm.components import connected_components
from papyrine.llm.runtime import attach, materialize, release

LINK = 0.95
FLOOR = 2 * LINK**2 - 1
TABLES, RUN, START, MOST, ROUNDS = 12, 256, 8, 64, 4
WEAK, BLOCK, AUDIT, RECALL, TRIES, PARTS = 2, 512, 1024, 0.995, 8, 16
#: Cosines this near the threshold are computed one by one.
SLACK = 1e-9


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length, in double precision."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node or null) of every row, and (node, vec, copies, rep) of every distinct vector that may link."""
    e = F.col("embedding")
    sizes = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = e.isNotNull() & F.size(e).isin([r.d for r in sizes]) & F.forall(e, fine) & F.exists(e, lambda x: x != 0)
    wide = F.transform(e, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select("vec_id", F.when(F.coalesce(ok, F.lit(False)), wide).alias("wide"))
    rows = rows.select("vec_id", "wide", F.when(F.col("wide").isNotNull(), F.xxhash64("wide")).alias("node"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(r.values, np.float64).tobytes() for r in batch.column("wide")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(x, pa.binary()), batch.column("copies"), batch.column("rep")], names=["node", "vec", "copies", "rep"])

    distinct = rows.where("node is not null").groupBy("node", "wide").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    distinct = distinct.mapInArrow(pack, "node long, vec binary, copies long, rep long")
    return rows.select("vec_id", "node"), materialize(distinct, "nodes")


def seeds(v: DataFrame, n: int, d: int, tables: int, first: int, run: int = RUN) -> DataFrame:
    """u, v, sim: the best START neighbours of each node in each run, and with a null sim links that connect the run."""
    width = int(np.clip(np.ceil(np.log2(max(2, n) / 16)), 4, 40))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("vec").to_pylist())
            for t in range(first, first + tables):
                planes = np.random.default_rng(1000 + t).normal(size=(x.shape[1], width + 1))
                y = x @ planes
                code = (y[:, :width] > 0) @ (1 << np.arange(width, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), pa.array(y[:, width]), batch.column("node"), batch.column("vec")], names=["t", "code", "at", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            own = np.array([r[0] for r in rows], np.int64)
            x = unit([r[1] for r in rows])
            s = x @ x.T
            s[own[:, None] == own[None, :]] = -2
            k = min(START, len(own))
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if len(own) > k else np.tile(np.arange(len(own)), (len(own), 1))
            sim = np.take_along_axis(s, best, 1)
            order = np.argsort(-sim, axis=1)
            best, sim = np.take_along_axis(best, order, 1), np.take_along_axis(sim, order, 1)
            keep = ((sim >= FLOOR) | (np.arange(k) < WEAK)) & (sim > -1.5)
            u, w, sim = np.repeat(own, keep.sum(1)), own[best[keep]], sim[keep]
            near = s >= LINK
            label = np.arange(len(own))
            while True:
                new = np.minimum(label, np.where(near, label[None, :], len(own)).min(1))
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            at = np.flatnonzero(label != np.arange(len(own)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, own[at]])), pa.array(np.concatenate([w, own[label[at]]])), pa.array(np.concatenate([sim, np.full(len(at), np.nan)]), from_pandas=True)], names=["u", "v", "sim"])

        for batch in batches:
            held += zip(batch.column("node").to_pylist(), batch.column("vec").to_pylist(), strict=True)
            while len(held) >= run:
                yield out(held[:run])
                held = held[run // 2 :]
        if len(held) > 1:
            yield out(held)

    dealt = v.mapInArrow(deal, "t int, code long, at double, node long, vec binary").repartitionByRange("t", "code").sortWithinPartitions("t", "code", "at")
    return dealt.mapInArrow(compare, "u long, v long, sim double")


def best(entries: DataFrame) -> DataFrame:
    """u, v, sim, k: each list's k best entries; a full list whose every entry links gets twice the k."""
    one = entries.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("k").alias("k"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    whole = Window.partitionBy("u")
    one = one.withColumn("k", F.max("k").over(whole)).withColumn("r", F.row_number().over(order)).where("r <= k")
    full = (F.count("*").over(whole) >= F.col("k")) & (F.min("sim").over(whole) >= LINK)
    return one.select("u", "v", "sim", F.when(full, F.least(F.col("k") * 2, F.lit(MOST))).otherwise(F.col("k")).alias("k"))


def descend(lists: DataFrame, v: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins, until under a hundredth of the entries is new."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            own = np.array([r[1] for r in rows], np.int64)
            worst = np.array([r[3] for r in rows])
            x = unit([r[2] for r in rows])
            s = x @ x.T
            i, j = np.nonzero((s > worst[:, None]) & (own[:, None] != own[None, :]))
            return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(own[j]), pa.array(s[i, j])], names=["u", "v", "sim"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("centre", "v", "vec", "worst")), strict=True):
                if held and row[0] != held[0][0]:
                    if len(held) > 1:
                        yield out(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield out(held)

    lists = materialize(best(lists.withColumn("k", F.lit(START))), "lists")
    for _ in range(rounds):
        back = lists.select(F.col("v").alias("centre"), F.col("u").alias("v"), "sim")
        # a hub is neighbour to very many: first the best of each of its parts, then the best of these
        back = back.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
        for keys in (["centre", "part"], ["centre"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("sim"), "v")
            back = back.withColumn("r", F.row_number().over(order)).where(f"r <= {2 * START}")
        back = back.select("centre", "v")
        members = lists.select(F.col("u").alias("centre"), "v").union(back).union(lists.select("u", F.col("u").alias("v")).distinct()).distinct()
        # an entry has to beat the worst of a full list
        worst = lists.groupBy(F.col("u").alias("v")).agg(F.when(F.count("*") >= F.max("k"), F.min("sim")).otherwise(-2.0).alias("worst"))
        full = members.join(worst, "v", "left").join(v.select(F.col("node").alias("v"), "vec"), "v")
        found = full.select("centre", "v", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst")).repartition("centre").sortWithinPartitions("centre").mapInArrow(join, "u long, v long, sim double")
        new = materialize(best(lists.union(found.distinct().withColumn("k", F.lit(START)))), "lists")
        n, fresh = new.count(), new.join(lists, ["u", "v"], "left_anti").count()
        release(lists)
        lists = new
        if fresh <= 0.01 * n:
            break
    return lists


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Rows sorted by keys: the columns of each key's rows, as lists."""
    held, key = None, None
    for batch in batches:
        rows = batch.to_pydict()
        ids = list(zip(*(rows[k] for k in keys), strict=True))
        cut = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            part = {c: x[a:b] for c, x in rows.items()}
            if held and key == ids[a]:
                for c in held:
                    held[c] += part[c]
            else:
                if held:
                    yield held
                held, key = part, ids[a]
    if held:
        yield held


def blocked(v: DataFrame, label: DataFrame, block: int) -> DataFrame:
    """node, vec, copies, label, blocks, block: members of components; those of over `block` members are dealt to blocks by
    the sides of random hyperplanes that they are on, so that blocks are narrow, and crowded sides by a hash."""
    sizes = label.groupBy("label").agg(F.count("*").alias("size"))
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("size") / block)), "sizes")
    own = attach(label, sizes.select("label", "blocks"), "label", sizes.count(), 40)
    own = own.join(v.select("node", "vec", "copies"), "node").select("node", "vec", "copies", "label", "blocks")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            bits = np.ceil(np.log2(np.maximum(1, batch.column("blocks").to_numpy()))).astype(np.int64)
            large = np.flatnonzero(bits)
            if len(large):
                x = unit(batch.column("vec").take(pa.array(large)).to_pylist())
                planes = np.random.default_rng(7).normal(size=(x.shape[1], int(bits.max())))
                out[large] = ((x @ planes > 0) & (np.arange(planes.shape[1]) < bits[large, None])) @ (1 << np.arange(planes.shape[1], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "code"])

    coded = materialize(own.mapInArrow(code, "node long, vec binary, copies long, label long, blocks long, code long"), "members")
    crowds = coded.where("blocks > 1").groupBy("label", "code").agg(F.ceil(F.count("*") / block).alias("parts"))
    crowds = materialize(crowds.where("parts > 1"), "crowds")
    out = attach(coded, crowds, ["label", "code"], crowds.count(), 40)
    place = F.col("code") * (1 << 24) + F.pmod(F.xxhash64("node", F.lit(5)), F.coalesce("parts", F.lit(1)))
    out = materialize(out.select("node", "vec", "copies", "label", "blocks", place.alias("block")), "members")
    release(sizes, coded, crowds)
    return out


def count_links(v: DataFrame, label: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, n: for each node of a component (node, label), how many vectors of the component link to it, itself among
    them. Blocks are one row each and compared in pairs; only pairs that bounds leave open are multiplied."""
    own = blocked(v, label, block)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["label", "block"]):
            x = unit(g["vec"])
            c = x.sum(0)
            c = c / max(np.sqrt((c * c).sum()), 1e-300)
            radius = float(np.arccos(np.clip(x @ c, -1, 1)).max())
            cols = {"label": pa.array([g["label"][0]]), "block": pa.array([g["block"][0]]), "centre": pa.array([c.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "copies": pa.array([sum(g["copies"])])}
            yield pa.RecordBatch.from_pydict(cols | {"nodes": pa.array([np.array(g["node"], np.int64).tobytes()], pa.binary()), "vecs": pa.array([x.tobytes()], pa.binary()), "counts": pa.array([np.array(g["copies"], np.int64).tobytes()], pa.binary())})

    many = own.where("blocks > 1").repartition("label", "block").sortWithinPartitions("label", "block")
    ball = materialize(many.mapInArrow(pack, "label long, block long, centre array<double>, radius double, copies long, nodes binary, vecs binary, counts binary"), "balls")
    bounds = ball.select("label", "block", "centre", "radius", "copies")
    a, b = bounds.alias("a"), bounds.alias("b")
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    most, least = angle + F.col("a.radius") + F.col("b.radius"), angle - F.col("a.radius") - F.col("b.radius")
    theta = float(np.arccos(LINK))
    pairs = a.join(b, F.col("a.label") == F.col("b.label")).select(F.col("a.label").alias("label"), F.col("a.block").alias("i"), F.col("b.block").alias("j"), F.col("b.copies").alias("copies"), F.when(most < theta - 1e-6, "all").when(least > theta + 1e-6, "none").otherwise("open").alias("what"))
    pairs = materialize(pairs.where("what != 'none'"), "pairs")
    sure = pairs.where("what = 'all'").groupBy("label", "i").agg(F.sum("copies").alias("n")).withColumnRenamed("i", "block")
    sure = own.where("blocks > 1").join(sure, ["label", "block"]).select("node", "n")
    side = lambda s, x: ball.select("label", F.col("block").alias(s), *(F.col(c).alias(f"{c}_{x}") for c in ("nodes", "vecs", "counts")))
    open_ = pairs.where("what = 'open' and i <= j").select("label", "i", "j").join(side("i", "a"), ["label", "i"]).join(side("j", "b"), ["label", "j"])
    open_ = open_.select((F.col("i") == F.col("j")).alias("same"), "nodes_a", "vecs_a", "counts_a", "nodes_b", "vecs_b", "counts_b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids_a, a, n_a, ids_b, b, n_b = (np.frombuffer(x, np.float64 if k % 3 == 1 else np.int64) for k, x in enumerate(raw))
                a, b = a.reshape(len(ids_a), -1), b.reshape(len(ids_b), -1)
                near = linked(a, b)
                yield counts(ids_a, near @ n_b)
                if not same:
                    yield counts(ids_b, near.T @ n_a)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["label"]):
            x = unit(g["vec"])
            yield counts(np.array(g["node"]), linked(x, x) @ np.array(g["copies"]))

    def counts(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["node", "n"])

    alone = own.where("blocks = 1").select("label", "node", "vec", "copies").repartition("label").sortWithinPartitions("label")
    done = alone.mapInArrow(small, "node long, n long").union(open_.mapInArrow(multiply, "node long, n long")).union(sure).groupBy("node").agg(F.sum("n").alias("n"))
    out = materialize(done, "counts")
    release(own, ball, pairs)
    return out


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a @ b.T
    near = np.abs(s - LINK) < SLACK
    if near.any():  # the order of a matrix product's sums is not fixed
        i, j = np.nonzero(near)
        s[i, j] = (a[i] * b[j]).sum(1)
    return s >= LINK


def audit(v: DataFrame, total: int, counted: DataFrame, size: int = AUDIT) -> float:
    """Part of a vector's links that is counted, of about `size` vectors compared with all, in blocks. Each vector weighs
    one over its links, so that a large group does not outweigh the small ones."""
    part = F.pmod(F.xxhash64("node", F.lit(77)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / max(1, total)))
    asked = v.where(part).select("node", "vec").toArrow()
    if not asked.num_rows:
        return 1.0
    ids = asked["node"].to_numpy()
    shared = v.sparkSession.sparkContext.broadcast((ids, unit(asked["vec"].to_pylist())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += linked(q, unit(batch.column("vec").to_pylist())) @ batch.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["node", "there"])

    there = v.mapInArrow(ask, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    own = there.join(v.select("node", "copies"), "node").join(counted, "node", "left")
    part = (F.coalesce("n", "copies") - 1) / (F.col("there") - 1)
    got = own.where("there > 1").agg(F.sum(part / F.col("there")), F.sum(1 / F.col("there"))).first()
    shared.destroy()
    return 1.0 if not got[1] else got[0] / got[1]


def _of_one_length(v: DataFrame, n: int, d: int, tables: int, run: int, block: int) -> tuple[DataFrame, float]:
    known, label, counted = None, None, None
    for t in range(TRIES):
        found = materialize(seeds(v, n, d, tables, t * tables, run), "seeds")
        lists = descend(found.where("sim is not null"), v)
        links = found.where("sim is null").select(F.col("u").alias("a"), F.col("v").alias("b")).union(lists.where(F.col("sim") >= LINK).select("u", "v")).distinct()
        if known is not None:
            links = links.union(known.select(F.col("node").alias("a"), F.col("label").alias("b")))
        label = connected_components(links)
        counted = count_links(v, label, block)
        recall = audit(v, n, counted)
        known = label
        release(found, lists)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"{TRIES * tables} tables find {recall:.4f} of the links of vectors of length {d}, under {RECALL}")
    least = label.join(v, "node").groupBy("label").agg(F.min("rep").alias("component"))
    of = attach(label, materialize(least, "least"), "label", label.count(), 40)
    out = v.select("node", "copies", "rep").join(counted, "node", "left").join(of, "node", "left")
    out = out.select("node", (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return materialize(out, "results"), recall


def near_duplicates(vectors: DataFrame, tables: int = TABLES, run: int = RUN, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int, float]:
    """(vec_id, node) rows; (node, n_links, component) of each distinct vector; their number; the least audited recall."""
    runtime.prepare(vectors.sparkSession)
    rows, v = nodes(vectors.select("vec_id", "embedding"))
    width = (F.length("vec") / 8).cast("int")
    lengths = sorted((r.d, r.n) for r in v.groupBy(width.alias("d")).agg(F.count("*").alias("n")).collect())
    out, recall = v.select("node", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component")).limit(0), 1.0
    for d, n in lengths:
        one, found = _of_one_length(v if len(lengths) == 1 else materialize(v.where(width == d), "length"), n, d, tables, run, block)
        out, recall = one if len(lengths) == 1 else out.union(one), min(recall, found)
    return rows, out, sum(n for _, n in lengths), recall


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, groups, n, _ = near_duplicates(runtime.table(spark, sf_dir, "embeddings"))
    out = attach(rows, groups, "node", n, 48)
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
