"""URL filters: rules, and trust and distrust passed along the links between hosts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import forget, without, written

# The rules of the query, as (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
OUT = ["host", "path", "rule", "verdict", "trust", "distrust"]
DAMPING, DIGITS, BLOCK_AT = 0.85, 9, 0.5
#: What is still on its way after the last round, as a share of all that the seeds give.
TOLERANCE = 1e-6
#: The rounds after which that holds for any links: each passes on at most 0.85 of the one before.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The (verdict, rule) with the longest text that fits; the first of equals."""
    out = F.lit(None)
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from the pages of a host to other hosts, counted."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)
    links = pages.select(F.col("_host").alias("src"), F.explode(found).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src != '' and src != dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from the seeds (host, good, bad), trust along `links`
    (src, dst, n) and distrust against them.

    A host keeps 0.15 of its seed and of what it gets, and passes 0.85 on by numbers of links; what a host without
    links would pass on is gone. Both scores are summed as a series: each round passes on what the one before
    brought. It ends when nothing is on its way, or after the `ROUNDS` that leave at most `TOLERANCE` of it, a bound
    that holds for any links. Sums are added up before their shuffle; tables of finished rounds are dropped.
    """
    total = lambda c: links.groupBy(c).agg(F.sum("n").alias("all"))
    part = (F.col("n") / F.col("all")).alias("part")
    forth = links.join(total("src"), "src").select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), part)
    back = links.join(total("dst"), "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), part)
    edges = written(forth.union(back), "host-links")
    first = F.lit(1 - DAMPING) * F.col("seed")
    state = seeds.select("host", F.expr("stack(2, 'trust', good, 'distrust', bad) as (kind, seed)"))
    state = written(state.select("kind", "host", first.alias("score"), first.alias("term")), "host-scores")
    if not edges.isEmpty():
        for _ in range(ROUNDS):
            moving = state.where("term > 0").select("kind", F.col("host").alias("a"), "term")
            if moving.isEmpty():
                break
            got = (
                edges.join(moving, ["kind", "a"])
                .groupBy("kind", F.col("b").alias("host"))
                .agg((F.lit(DAMPING) * F.sum(F.col("part") * F.col("term"))).alias("got"))
            )
            new = F.coalesce("got", F.lit(0.0))
            after = state.join(got, ["kind", "host"], "left").select("kind", "host", (F.col("score") + new).alias("score"), new.alias("term"))
            after = written(after, "host-scores")
            forget(state)
            state = after
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score"))).alias(kind)
    return state.groupBy("host").agg(one("trust"), one("distrust"))


def filter_pages(
    pages: DataFrame, rules: list[tuple[str, str]] | None = None, block_at: float = BLOCK_AT
) -> DataFrame:
    """Adds `host`, `path`, `rule`, `verdict`, `trust` and `distrust`; input columns of these names give way, and
    `html` is left out.

    A page takes the verdict of the longest rule that fits. Other pages take the verdict of their host. Trust starts as
    the share of a host's pages that rules allow and follows links; distrust starts as the share they block and follows
    links backwards, to the hosts that link to it. Neither scale is the other's or another host's, as both shrink
    with the number of links; so a host is judged by its share, distrust / (trust + distrust), where a seed counts as
    itself. `block` where that is at least `block_at` and as much of the host's pages are blocked by rules or
    of its links lead to hosts with such a share; else `allow`. Links are the absolute ones in the html.

    A null url, or one without ://, has an empty host and path, and no links; null html has no links; rows
    that repeat count once each; an empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    pages = without(pages, OUT)
    keep = [c for c in pages.columns if c != "html"]
    rows = pages.withColumn("_host", host_of(F.col("url"))).withColumn("_path", path_of(F.col("url")))
    rows = rows.withColumn("_rule", longest_rule(F.col("_host"), F.col("_path"), rules))
    share = lambda verdict: F.count(F.when(F.col("_rule.verdict") == verdict, 1)) / F.count(F.lit(1))
    seeds = rows.groupBy(F.col("_host").alias("host")).agg(share("allow").alias("good"), share("block").alias("bad"))
    if "html" in pages.columns:  # hosts that are only linked to carry scores on
        links = written(host_links(rows), "page-links")
        others = links.select(F.col("dst").alias("host")).distinct().join(seeds, "host", "left_anti")
        seeds = seeds.unionByName(others.selectExpr("host", "0d as good", "0d as bad"))
    else:
        links = seeds.selectExpr("host as src", "host as dst", "1L as n").limit(0)
    seeds = written(seeds, "hosts")
    for_it, against = F.greatest("trust", "good"), F.greatest("distrust", "bad")
    ranked = seeds.join(propagated(links, seeds), "host").withColumn(
        "share", F.when(against > 0, F.round(against / (for_it + against), 6)).otherwise(0.0)
    )
    ranked = written(ranked, "host-shares")
    far = ranked.select(F.col("host").alias("dst"), (F.col("share") >= block_at).alias("suspect"))
    led = (
        links.join(far, "dst")
        .groupBy(F.col("src").alias("host"))
        .agg((F.sum(F.when(F.col("suspect"), F.col("n")).otherwise(0)) / F.sum("n")).alias("led"))
    )
    ranked = ranked.join(led, "host", "left").select(
        F.col("host").alias("_h"), "trust", "distrust",
        ((F.col("share") >= block_at) & (F.greatest("bad", F.coalesce("led", F.lit(0.0))) >= block_at)).alias("_bad"),
    )
    out = rows.drop("html").join(ranked, F.col("_host") == F.col("_h"), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("trust", DIGITS).alias("trust"),
        F.round("distrust", DIGITS).alias("distrust"),
    )
