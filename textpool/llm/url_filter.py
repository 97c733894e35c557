"""URL filters (DataFrame functions only): allow and block rules, then link-graph propagation.

Urls that no rule fits are judged by their host: trust flows from hosts with
allowed pages along the links, distrust flows from hosts with blocked pages
against them (personalised PageRank both ways), and a host whose distrust
outweighs its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpool.functions.arrays import explode_values
from textpool.llm.common import materialise

#: (host, path start, verdict). A rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: Rounds go on until the mass that still moves is at most this share of the seeds'.
RESIDUAL = 1e-8
#: Rounds between sums of what has arrived, which keep the lineage short.
FOLD_EVERY = 8
#: A host is blocked when its distrust exceeds this many times its trust.
THRESHOLD = 1.0
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _CAPITALS, _CAPITALS.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null (equal lengths: the first in text order)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), *[-ord(c) for c in r[0] + r[1]])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: Attributes that link to another page, absolute or without a scheme. A base element moves the page's own relative links there.
_LINK = (r"(?i)<(?:a|area|link|iframe|frame|base)\s(?:[^>]*?\s)?(?:href|src)\s*=\s*[\"']?\s*"
         r"((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)")


def host_edges(pages: DataFrame, families: bool = False) -> DataFrame:
    """(src, dst, weight): links between hosts, one count per page.

    Links are those of ``a``, ``area``, ``link``, ``iframe`` and ``frame``
    elements and of ``base``; relative ones stay on their host and add
    nothing. A host pair is summed before its rows meet. ``families`` adds
    both ways between a host and its parent domain, for corpora in which that
    is known to be one site; it is no link and may be a public suffix.
    """
    links = explode_values(
        pages.select(url_host(F.col("url")).alias("src"), F.array_distinct(F.transform(
            F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)),
            lambda u: url_host(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))).alias("to")),
        ["src"], F.col("to"), "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if families:
        hosts = pages.select(url_host(F.col("url")).alias("host")).distinct()
        parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
        family = hosts.select(F.col("host").alias("src"), parent.alias("dst")).filter("dst <> ''").withColumn("weight", F.lit(1.0))
        links = links.union(family).union(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return links.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_scores(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust) from ``seeds(kind, host, share)``; kind is trust or distrust.

    Trust follows the edges, distrust their reverse. A node's mass is split
    over its edges by weight; mass that reaches a node without edges ends
    there. A round moves what the last one brought, until no more than
    ``RESIDUAL`` is on its way; only that sum comes to the driver.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = ways.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    ways = materialise(spark, ways.join(total, ["kind", "src"]).select(
        "kind", "src", "dst", (F.col("weight") / F.col("total")).alias("part")), "host-ways")
    base = seeds.select("kind", "host", (F.col("share") * (1 - DAMPING)).alias("score"))
    moving = scores = materialise(spark, base, "host-seeds")
    rounds = 0
    while True:
        sent = ways.join(moving.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("part") * DAMPING).alias("score"))
        moving = materialise(spark, sent.groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-moving")
        # a node passes on DAMPING of what arrives, so all later rounds bring less than this
        left = (moving.agg(F.sum("score")).first()[0] or 0.0) / (1 - DAMPING)
        scores, rounds = scores.union(moving), rounds + 1
        if left <= RESIDUAL:
            break
        if rounds % FOLD_EVERY == 0:
            scores = materialise(spark, scores.groupBy("kind", "host").agg(F.sum("score").alias("score")), "host-scores")
    return scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
               threshold: float = THRESHOLD, families: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of ``pages(page_id, url, html)``.

    ``rules`` is a short list, applied within the row. A null url or one
    without ``://`` has an empty host and path, fits no rule, takes no part in
    the graph and is allowed, as is every host that neither trust nor distrust
    reaches. Without links between hosts, a host is judged by its own ruled pages. A null html has no links. Repeated rows are judged alike and
    count as often as they come. An empty table gives an empty result.
    """
    own = pages.select("page_id", "url", "html")
    judged = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))
    judged = materialise(spark, judged, "urls-ruled")
    counts = judged.filter("ruled IS NOT NULL AND host <> ''").groupBy("ruled", "host").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("ruled").agg(F.sum("n").alias("all"))
    seeds = counts.join(sums, "ruled").select(
        F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host",
        (F.col("n") / F.col("all")).alias("share"))
    scores = materialise(spark, host_scores(spark, host_edges(own, families), seeds).select(
        "host", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust")), "host-verdicts")
    out = judged.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust > trust * threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
