"""URL filter: rules on host and path, and trust that spreads over the links between hosts.

Pages that a rule fits take its verdict. The others take their host's: personalised PageRank carries trust from hosts
with allowed pages along links, and distrust from hosts with blocked pages against links, to the hosts that link to them.
A host's seed is its number of allowed (blocked) pages; a host without links that way keeps its mass. A host is blocked if
distrust less trust exceeds MARGIN times its number of pages: without any link between hosts, that is if over MARGIN of
its pages are blocked by rules, less those allowed. Rounds go on until no host's score changes by more than TOLERANCE times
its number of pages; not to settle within ROUNDS is an error. Only DataFrame and SQL functions run.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; hosts are
lower-cased in A-Z only; html may be null or empty; relative links, links within a host and links without a host carry
nothing; linked hosts without a page carry scores on; repeated pages count as often as they occur; a null page_id is an id
like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import runtime
from papyrine.llm.runtime import attach, materialize, release

#: (verdict, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING, ROUNDS, TOLERANCE, MARGIN = 0.85, 300, 1e-4, 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of each absolute link in a page; links within the page's own host carry nothing between hosts.
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""


def host_path(url):
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule and ruled (its verdict); the longest rule that fits wins, the first of equals."""
    host, path = host_path(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target, n: links between different hosts, from pages with host and html."""
    found = F.filter(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda h: F.translate(F.regexp_replace(h, r"^.*@|:\d*$", ""), _UPPER, _LOWER)), lambda h: (h != F.col("host")) & (h != ""))
    rows = pages.where("host != '' and html is not null").select(F.col("host").alias("source"), F.explode(found).alias("target"))
    return rows.groupBy("source", "target").agg(F.count("*").alias("n"))


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, pages, allowed, blocked) and edges (source, target, n).

    Both flows are one frame with a column `flow`: trust goes from source to target, distrust from target to source.
    """
    edges = materialize(edges, "edges")
    seeds = materialize(seeds, "seeds")
    many_seeds = seeds.count()
    both = edges.select(F.lit("t").alias("flow"), F.col("source").alias("from"), F.col("target").alias("to"), "n")
    both = both.union(edges.select(F.lit("d"), "target", "source", "n"))
    out = both.groupBy("flow", "from").agg(F.sum("n").alias("all"))
    many = out.count()
    start = seeds.select("host", F.lit("t").alias("flow"), F.col("allowed").cast("double").alias("seed")).union(seeds.select("host", F.lit("d"), F.col("blocked").cast("double")))
    start = start.where("seed > 0")
    if not many:
        now = start.select("flow", "host", F.col("seed").alias("score"))
    else:
        key = lambda a, b: F.concat_ws("\n", a, b)
        share = attach(both.withColumn("key", key("flow", "from")), out.select(key("flow", "from").alias("key"), "all"), "key", many, 120, "inner")
        share = materialize(share.select("flow", "key", F.col("to"), (F.col("n") / F.col("all")).alias("w")), "shares")
        holds = materialize(out.select(key("flow", "from").alias("key")), "holds")
        now = materialize(start.select("flow", "host", F.col("seed").alias("score")), "scores")
        for _ in range(rounds):
            hosts = now.count()
            held = now.withColumn("key", key("flow", "host"))
            moved = attach(share, held.select("key", "score"), "key", hosts, 120, "inner").select("flow", F.col("to").alias("host"), (damping * F.col("w") * F.col("score")).alias("x"))
            rest = attach(held, holds.withColumn("linked", F.lit(True)), "key", many, 120).where("linked is null").select("flow", "host", (damping * F.col("score")).alias("x"))
            jump = start.select("flow", "host", ((1 - damping) * F.col("seed")).alias("x"))
            after = materialize(moved.union(rest).union(jump).groupBy("flow", "host").agg(F.sum("x").alias("score")), "scores")
            change = after.union(now.select("flow", "host", -F.col("score"))).groupBy("flow", "host").agg(F.abs(F.sum("score")).alias("x"))
            change = attach(change, seeds.select("host", "pages"), "host", many_seeds, 120)
            most = change.agg(F.max(F.col("x") / F.coalesce("pages", F.lit(1)))).first()[0] or 0.0
            release(now)
            now = after
            if most <= tolerance:
                break
        else:
            raise RuntimeError(f"scores still change by {most} of a host's pages after {rounds} rounds")
    total = lambda f: F.coalesce(F.sum(F.when(F.col("flow") == f, F.col("score"))), F.lit(0.0))
    return now.groupBy("host").agg(total("t").alias("trust"), total("d").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host for each page."""
    ruled = with_rule(pages.select("page_id", "url", "html"), rules)
    counts = ruled.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    counts = materialize(counts, "hosts")
    scores = host_scores(counts, host_edges(ruled))
    hosts = counts.join(scores, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"), "pages")
    hosts = materialize(hosts.withColumn("bad", F.col("distrust") - F.col("trust") > margin * F.col("pages")), "hosts")
    pages_of = ruled.select("page_id", "host", "path", "rule", "ruled")
    rows = attach(pages_of, hosts.drop("pages"), "host", hosts.count(), 160)
    verdict = F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(runtime.table(spark, sf_dir, "pages"))
