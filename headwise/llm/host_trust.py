"""URL filter with link-graph propagation: personalised PageRank of trust and of distrust over host edges.

An allow/block rule decides every url it fits (longest rule wins). Other urls get the verdict of their host: trust spreads
from hosts with allowed urls along links, distrust from hosts with blocked urls against the direction of links (a host
that links to bad hosts is suspect); the host a rule names is a seed like a host with one such page. The threshold of a host is
its own trust: it is blocked when its distrust is larger (by more than ``margin``).

The walks end when less than ``REMAINDER`` of all trust and distrust is still to be passed on: a round passes on 85 % of what the
round before has passed on, so the number of rounds follows from the damping alone, whatever the graph.

Edges between hosts are the absolute links of its pages (also those that leave out the scheme) and, since a subdomain is run by whoever owns the domain above it,
one edge in each direction between a host and its parent domain (two labels at least). Copies of a link count once per
page. Shares are whole numbers (``SCALE`` units for all seeds together, divisions rounded down), so the result does not
depend on the order of additions, on partitioning or on a recomputed task.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; null html has
no links; repeated rows are judged each, and a host seen more often is a seed of proportionate weight; an empty table gives
an empty result; extra columns are ignored. Everything here is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwise.sources.staging import stage

RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
SCALE = 1_000_000_000_000
DAMPING_PERCENT = 85
REMAINDER = 0.001
ROUNDS = math.ceil(math.log(REMAINDER) / math.log(DAMPING_PERCENT / 100))
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """ASCII lower-cased host: from behind the first ``://`` to ``/``, ``?``, ``#`` or the end; null gives empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null gives empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict (null where no rule fits)."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of src that link to dst (each link once a page), and the edges to and from parent domains."""
    linked = pages.select(host_of(F.col("url")).alias("src"), F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)),
        lambda link: host_of(F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link)).otherwise(link)))).alias("out"))
    links = linked.where(F.size("out") > 0).select("src", F.explode("out").alias("dst")).where(
        (F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.struct(
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("child"),
        F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("parent")))
    above = hosts.where(F.size(labels) >= 3).select(F.explode(F.filter(
        chain, lambda c: F.contains(c["parent"], F.lit(".")))).alias("c")).select("c.child", "c.parent").distinct()
    up = above.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(1).cast("long").alias("n"))
    down = above.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1).cast("long").alias("n"))
    return links.unionByName(up).unionByName(down).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def seeds_from(judged: DataFrame, rules=RULES) -> DataFrame:
    """host, trusted and distrusted seed shares: pages with an allowing and a blocking rule and the rules' own hosts, in
    proportion to all such."""
    counted = judged.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("bad"))
    if rules:
        named = F.array(*[F.struct(F.lit(host).alias("host"), F.lit(int(verdict == "allow")).cast("long").alias("good"),
                                   F.lit(int(verdict == "block")).cast("long").alias("bad")) for verdict, host, _ in rules])
        own = judged.sparkSession.range(1, numPartitions=1).select(F.explode(named).alias("r")).select("r.*")
        counted = counted.unionByName(own).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    totals = counted.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    return counted.join(F.broadcast(totals), F.lit(True)).select(  # one row of totals
        "host", *[F.coalesce(F.expr(f"cast({n} * {SCALE}BD / nullif(all_{n}, 0) as bigint)"), F.lit(0)).alias(s)
                  for n, s in (("good", "trust_seed"), ("bad", "distrust_seed"))])


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust after ``rounds`` steps of personalised PageRank, trust along the edges, distrust against
    them. Both walks share one pass over the edges per round; what a host without edges in a direction would pass on stays
    out. Ranks are cut from their lineage by a written table every second round."""
    shares = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    weighted = stage(edges.join(shares, "src").join(back, "dst").select("src", "dst", "n", "out_n", "in_n"), "host-edges")
    moves = weighted.select(F.explode(F.array(
        F.struct(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("n"), F.col("out_n").alias("of"), F.lit(True).alias("good")),
        F.struct(F.col("dst").alias("host"), F.col("src").alias("to"), F.col("n"), F.col("in_n").alias("of"), F.lit(False).alias("good")),
    )).alias("m")).select("m.*")
    everyone = weighted.select(F.col("src").alias("host")).union(weighted.select("dst")).union(
        seeds.select("host")).distinct()
    start = stage(everyone.join(seeds, "host", "left").select(
        "host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("trust_seed", "distrust_seed")]), "host-seeds")
    ranks = start.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    for done in range(1, rounds + 1):
        amount = F.when(F.col("good"), F.col("trust")).otherwise(F.col("distrust"))
        passed = F.floor(amount.cast("decimal(20,0)") * F.col("n") * DAMPING_PERCENT / (F.col("of") * 100)).cast("long")
        arrived = moves.join(ranks, "host").groupBy("to").agg(
            F.sum(F.when(F.col("good"), passed)).alias("trust_in"), F.sum(F.when(~F.col("good"), passed)).alias("distrust_in"))
        ranks = start.join(arrived, start["host"] == arrived["to"], "left").select(
            "host", *[(F.floor(F.col(f"{c}_seed").cast("decimal(20,0)") * (100 - DAMPING_PERCENT) / 100).cast("long")
                       + F.coalesce(f"{c}_in", F.lit(0))).alias(c) for c in ("trust", "distrust")])
        if done % 2 == 0 or done == rounds:
            ranks = stage(ranks, "host-ranks")
    return ranks


def judge(pages: DataFrame, rules=RULES, margin: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust. A host is blocked when distrust > trust + ``margin``."""
    judged = judged_urls(pages, rules)
    ranks = propagate(host_edges(pages), seeds_from(judged, rules), rounds)
    blocked = F.coalesce(F.col("distrust") > F.col("trust") + margin, F.lit(False))
    return judged.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")

