"""URL filters: written rules, and link-graph propagation for hosts that no rule covers.

Trust starts at hosts with pages that a rule allows and flows along host edges as personalised PageRank; distrust starts
at hosts with blocked pages and flows backwards, from a host to those that link to it. Host edges come from the absolute
links in the pages, and from each host to its parent domain and back, as aliases and subdomains share an owner. A host
is blocked if its distrust, weighted, exceeds its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

#: (verdict, host, path): a rule covers the host and its subdomains, for paths that begin with its own.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DAMPING, DISTRUST_WEIGHT = 0.85, 1.0
#: Scores, which sum to 1 each, move until they change by no more than this in one round; written down after so many rounds.
TOLERANCE, CUT_EVERY, MOST_ROUNDS = 1e-5, 6, 300
#: Edges that one task takes in a round.
MOVES_A_TASK = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. Rules as long as another are taken as listed."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(by_length):
        out = F.when(fits(h, p), F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def links_of(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted; absolute ones and those that leave out the protocol."""
    link = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(link), F.lit(1))).alias("to"))
    dst = host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to")))
    linked = links.select(F.col("host").alias("src"), dst.alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def host_edges(own: DataFrame, counted: DataFrame) -> DataFrame:
    """(src, dst, weight): the counted links, and edges between a host and its parent domain, for all hosts of either table."""
    hosts = own.select("host").union(counted.select("dst")).distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    kin = hosts.select("host", parent.alias("parent")).where("parent <> ''")
    # A deep subdomain reaches its registered domain step by step: each step is an edge of its own.
    parts = F.split("host", r"\.")
    from_ = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))), lambda i: F.struct(from_(i).alias("a"), from_(i + 1).alias("b")))
    steps = kin.select(F.explode(chain).alias("e")).select("e.*").distinct()
    both = steps.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(steps.select("b", "a")).withColumn("weight", F.lit(1.0))
    return counted.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, good, bad), each of them summing to 1 or 0, to the fixed point."""
    forward = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("all")), "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("w"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("weight").alias("all")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("all")).alias("w"))
    moves = scratch.cut(forward.select("src", "dst", F.col("w").alias("f"), F.lit(0.0).alias("r")).unionByName(back.select("src", "dst", F.lit(0.0).alias("f"), F.col("w").alias("r"))).groupBy("src", "dst").agg(F.sum("f").alias("f"), F.sum("r").alias("r")))
    start = scratch.cut(seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust")))
    now, tasks = start, moves.count() // MOVES_A_TASK + 1  # so that few hosts do not travel in many small files

    def moved(state: DataFrame) -> DataFrame:
        out = moves.join(state, moves["src"] == state["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("f") * damping).alias("trust"), (F.col("distrust") * F.col("r") * damping).alias("distrust"))
        return out.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).coalesce(tasks)

    # From the start, scores only rise, and what a round adds is what their sums gain.
    sums = lambda df: df.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0.0
    total = sums(now)
    for _ in range(0, MOST_ROUNDS, CUT_EVERY):
        last = now
        for _ in range(CUT_EVERY):
            now = moved(now)
        now = scratch.cut(now)
        if last is not start:
            scratch.drop(last)
        total, before = sums(now), total
        if total - before <= tolerance:
            return now
    raise RuntimeError("scores did not settle")


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; one row for each page.

    A page with a rule gets that rule's verdict, another one its host's: block where distrust exceeds trust, else allow,
    so hosts that nothing reaches, and pages without a host, are allowed. A null or empty html has no links; very long
    ones are read whole. Rows that repeat count each and are judged alike; an empty table gives no rows; further columns
    are not read, whatever their names.
    """
    parsed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    count = lambda v: F.sum(F.when(F.col("hit.verdict") == v, 1).otherwise(0)).cast("double")
    with Scratch(pages.sparkSession) as scratch:
        hosts = scratch.cut(ruled.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad")))
        good, bad = (float(x or 0) or 1.0 for x in hosts.agg(F.sum("good"), F.sum("bad")).first())
        seeds = hosts.select("host", (F.col("good") / good).alias("good"), (F.col("bad") / bad).alias("bad"))
        edges = scratch.cut(host_edges(hosts, scratch.cut(links_of(parsed))))
        scores = cut(propagate(edges, seeds, scratch))  # a table of its own, so that the join can split a host of many pages
    told = ruled.select("page_id", "host", "path", "hit").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust * DISTRUST_WEIGHT > trust + F.lit(1e-12), "block").otherwise("allow")
    return told.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust"))
