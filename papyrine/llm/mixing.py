"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power `a`, normalised. `a` is bisected until the weights' entropy meets a
target (a part of the largest possible), or until the most repeated source stays at a limit of passes over it. The
weights are realised to a token budget: each source is dealt to blocks by a hash of its documents, every pass takes the
blocks in a permutation of its own, whole passes take all, and the last takes blocks until its budget is used, then
documents of one block, in the order of their hash. One rule decides each document: the number of its copies.

Only sums for each (source, block) and, of one block for each source, for each hash are gathered; a document's text never moves.
A token is a word between white space.

Defined results: a null source counts as the source ''; null and empty texts have no tokens and are kept once for each
whole pass; documents with equal id and text have equal hashes and one decision; an empty table gives no rows; other
columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import runtime
from papyrine.llm.runtime import attach, materialize, release

#: Part of the largest entropy that the weights shall have; passes over a source at most; blocks of a source.
ENTROPY, PASSES, BLOCKS = 0.98, 4.0, 4096
SEED = 20_240_607


def tokens(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _name(column):
    return F.coalesce(column, F.lit(""))


def _hash():
    """A document's place in the permutations: 0 to 2^62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 2)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_source": _name(F.col("source")), "_hash": _hash()}).withColumn("_block", F.pmod("_hash", F.lit(BLOCKS)).cast("int"))


def bisect_exponent(sources: DataFrame, low: float, high: float, entropy: float | None, budget: float | None, passes: float, rounds: int = 4, grid: int = 32) -> float:
    """The largest exponent (the least flattening) whose entropy reaches the target, but one that keeps the limit.

    Each round narrows a grid of exponents by one pass over the sources' sums; the driver sees one row an exponent.
    """

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        rows = sources.where("tokens > 0").withColumn("a", F.explode(F.array(*[F.lit(x) for x in exponents])))
        p = F.pow(F.col("share"), F.col("a"))
        out = rows.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.col("a") * F.log("share")).alias("e"), F.max(p / F.col("tokens")).alias("top"))
        got = {r.a: (math.log(r.z) - r.e / r.z, r.top / r.z) for r in out.collect()}
        return [got[x] for x in exponents if x in got]

    fits = lambda m: (entropy is None or m[0] >= entropy - 1e-12)
    within = lambda m: budget is None or m[1] * budget <= passes * (1 + 1e-12)
    # entropy falls and repetition falls as the exponent rises: the entropy bounds it from above, the limit from below
    least, most = low, high
    for test, up in ((fits, False), (within, True)):
        a, b = low, high
        ends = measure([a, b])
        if not ends:
            return 1.0
        good = [test(m) for m in ends]
        if not up and good[1]:
            continue  # even proportional weights are flat enough
        if up and good[0]:
            continue  # even equal weights keep the limit
        for _ in range(rounds):
            steps = [a + (b - a) * k / (grid - 1) for k in range(grid)]
            flags = [test(m) for m in measure(steps)]
            at = max((k for k, g in enumerate(flags) if g), default=0) if not up else min((k for k, g in enumerate(flags) if g), default=grid - 1)
            a, b = (steps[at], steps[min(at + 1, grid - 1)]) if not up else (steps[max(at - 1, 0)], steps[at])
        if up:
            least = b
        else:
            most = a
    return max(least, most)


def plan(docs: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame, float]:
    """(sources, cuts, exponent). sources: source, tokens, weight, passes over it. cuts: source, block, the hash below
    which a document of this block is in the last pass (null rows: none of the block).

    budget: tokens in all, the table's own by default. whole: the budget is instead as large as it has to be for every
    source to be passed over once at least, so that no document goes.
    """
    marked = _marked(docs.select("doc_id", "text", "source"))
    sums = materialize(marked.groupBy("_source", "_block").agg(F.sum(tokens(F.col("text"))).alias("tokens"), F.count("*").alias("docs")), "blocks")
    own = sums.groupBy("_source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    own = materialize(own, "sources")
    total, n, some = own.agg(F.sum("tokens"), F.count("*"), F.count_if(F.col("tokens") > 0)).first()
    total, some = float(total or 0), int(some or 0)
    share = own.withColumn("share", F.col("tokens") / F.lit(max(total, 1.0)))
    target = entropy * math.log(some) if some > 1 else None
    spend = float(total if budget is None else budget)

    def weights(a: float) -> DataFrame:
        p = F.when(F.col("tokens") > 0, F.pow(F.col("share"), F.lit(a))).otherwise(F.lit(0.0))
        z = share.agg(F.sum(p)).first()[0] or 1.0
        return share.withColumn("weight", p / F.lit(z))

    if whole:
        # with equal passes as the unit, the least passed-over source gets one: budget = max(tokens / weight)
        a, grow = bisect_exponent(share, 0.0, 1.0, target, None, passes), 0
        while True:
            spread = weights(a).where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight")), F.max(F.col("weight") / F.col("tokens"))).first()
            spend = float(spread[0] or 0)
            if spend * float(spread[1] or 0) <= passes * (1 + 1e-9) or grow > 40:
                break
            a, grow = a + (1 - a) / 8, grow + 1
    else:
        a = bisect_exponent(share, 0.0, 1.0, target, spend, passes)
    made = weights(a).withColumn("passes", F.when(F.col("tokens") > 0, F.least(F.lit(float(passes)), F.col("weight") * F.lit(spend) / F.col("tokens"))).otherwise(F.lit(1.0)))
    near = F.abs(F.col("passes") - F.round("passes")) < 1e-9
    made = made.withColumn("passes", F.when(near, F.round("passes")).otherwise(F.col("passes")))
    made = materialize(made.select("_source", "tokens", "weight", "passes", F.floor("passes").cast("int").alias("full")), "weights")
    cuts = _cuts(marked, sums, made, n)
    release(own)
    return made, cuts, a


def _cuts(marked: DataFrame, sums: DataFrame, made: DataFrame, n: int) -> DataFrame:
    """_source, _block, cut: documents of the block with a hash below the cut are in the source's last pass."""
    from pyspark.sql import Window

    rest = made.select("_source", "full", ((F.col("passes") - F.col("full")) * F.col("tokens")).alias("rest")).where("rest > 0")
    blocks = attach(sums, rest, "_source", n, 80, "inner")
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(SEED), "full", "_block"), "_block")
    blocks = blocks.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = materialize(blocks.where(F.col("upto") - F.col("tokens") < F.col("rest")).select("_source", "_block", "rest", (F.col("upto") - F.col("tokens")).alias("before"), "upto"), "taken")
    last = materialize(blocks.where("upto > rest").select("_source", "_block", (F.col("rest") - F.col("before")).alias("room")), "last")
    # documents of the one block of each source that the budget cuts through
    parts = attach(marked.select("_source", "_block", "_hash", "text"), last, ["_source", "_block"], n, 80, "inner")
    parts = parts.groupBy("_source", "_block", "_hash").agg(F.sum(tokens(F.col("text"))).alias("own"), F.first("room").alias("room"))
    inside = Window.partitionBy("_source", "_block").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("own").over(inside)).where("upto - own < room").groupBy("_source", "_block").agg((F.max("_hash") + 1).alias("cut"))
    every = F.lit(1 << 62).cast("long")
    taken = blocks.where("upto <= rest").select("_source", "_block", every.alias("cut")).union(parts)
    return materialize(taken, "cuts")


def mix(docs: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, budget: float | None = None, whole: bool = False) -> DataFrame:
    """docs with copies (how often the mixture takes the document) and its source's weight, in place of columns of
    these names; documents that it does not take are left out."""
    made, cuts, _ = plan(docs, entropy, passes, budget, whole)
    n, m = made.count(), cuts.count()
    rows = attach(_marked(docs), made.select("_source", F.col("full").alias("_full"), F.col("weight").alias("_weight")), "_source", n, 80)
    rows = attach(rows, cuts.withColumnRenamed("cut", "_cut"), ["_source", "_block"], m, 80)
    copies = F.col("_full") + F.when(F.col("_hash") < F.col("_cut"), 1).otherwise(0)
    rows = rows.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("copies", "weight")]
    return rows.select(*own, F.col("_copies").alias("copies"), F.col("_weight").alias("weight"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), "weight", "copies")
