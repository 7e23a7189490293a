"""Judge urls by host rules and by trust that spreads over the link graph.

Hosts are nodes, links between pages of different hosts are edges; a host also points to the host it is a
subdomain of, where pages of that host exist. Trust starts at hosts with pages that a rule allows and follows the
links; distrust starts at hosts with pages that a rule blocks and follows them backwards. Both are personalised
PageRanks, computed in one iteration over edges tagged with their direction until the mass still in transit is below
``TOLERANCE`` of the seeds. ``trust`` and ``distrust`` are in units of seed pages. For the verdict each seed vector is
scaled to sum 1 and compared in units of its average seed host, so neither more pages per host nor more copies of a
graph change it: a host is blocked when its distrust exceeds its trust by ``THRESHOLD``; hosts that neither reaches
are allowed.

Everything is DataFrame functions. Edges are counted per host pair before they are shuffled, a hot host's pages
meet its one verdict row in a plain equi-join (adaptive execution splits it), ranks are written and the mass in
transit is summed every ``CUT`` iterations.

Defined results: a null url or one without ``://`` has empty host and path, belongs to no host of the graph and is
allowed unless a rule fits; null html has no links; repeated pages count again; an empty table gives no rows; of
two fitting rules of one length the earlier in the list wins. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanchart.llm.common import ascii_lower, table
from fanchart.sources.materialize import materialized

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
#: Share of the seeds' mass that may be in transit at the end.
TOLERANCE = 1e-12
#: No graph needs more: each iteration leaves at most ``DAMPING`` of the mass in transit.
ITERATIONS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
CUT = 4
#: Distrust above trust that blocks a host, in units of an average seed host of each.
THRESHOLD = 0.1
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = "(?is)\\bhref\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between hosts; ``pages`` has host and html. Relative links stay on their host and drop out."""
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1)))
    links = pages.where("host <> '' AND html IS NOT NULL").select(F.col("host").alias("src"), link.alias("link"))
    far = links.where(F.col("link").rlike("(?i)^(https?:)?//"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    far = far.select("src", dst.alias("dst")).where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parent = hosts.select(F.col("host").alias("src"), F.expr("substring(host, locate('.', host) + 1)").alias("dst")).where("dst <> src")
    up = parent.join(hosts, parent["dst"] == hosts["host"], "left_semi").select("src", "dst", F.lit(1.0).alias("n"))
    return far.unionByName(up).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank over several graphs at once, to a summed change below ``tolerance`` of each graph's seeds.

    ``edges`` (kind, src, dst, share of src's mass), ``seeds`` (kind, host, seed) -> (kind, host, rank). Mass that a
    host without links holds leaves the graph, so ranks stay in units of seeds.
    """
    e = materialized(edges.select(F.col("kind").alias("k"), "src", "dst", "share"), "link-edges")
    total = {r.kind: r.mass for r in seeds.groupBy("kind").agg(F.sum("seed").alias("mass")).collect()}
    # what came in the last iteration moves on; a rank is the sum of all that came
    ranks = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), (F.col("seed") * (1 - damping)).alias("fresh"))
    going = bool(total)
    while going:
        for _ in range(CUT):
            part = F.col("fresh") * F.col("share") * damping
            moved = ranks.where("fresh > 0").join(e, (F.col("kind") == F.col("k")) & (F.col("host") == F.col("src"))).select("kind", F.col("dst").alias("host"), part.alias("rank"), part.alias("fresh"))
            ranks = ranks.withColumn("fresh", F.lit(0.0)).unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("fresh").alias("fresh"))
        ranks = materialized(ranks, "link-ranks")
        # all that can still come of the fresh mass
        left = ranks.groupBy("kind").agg((F.sum("fresh") * damping / (1 - damping)).alias("left")).collect()
        going = any(r.left > tolerance * total[r.kind] for r in left)
    return ranks.select("kind", "host", "rank")


def host_scores(pages: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, excess of distrust in average seed hosts); ``pages`` has host, html and the ruled action."""
    edges = materialized(host_edges(pages), "link-hosts")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all")).select(F.col("kind").alias("k"), F.col("src").alias("s"), "all")
    shares = both.join(out, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("s"))).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    kind = F.when(F.col("action") == "allow", "trust").otherwise("distrust")
    seeds = pages.where("host <> '' AND action IS NOT NULL").select("host", kind.alias("kind")).groupBy("kind", "host").agg(F.count("*").cast("double").alias("seed"))
    seeds = materialized(seeds, "link-seeds")
    ranks = spread(shares, seeds, damping, tolerance)
    unit = {r.kind: r.unit for r in seeds.groupBy("kind").agg(F.avg("seed").alias("unit")).collect()}
    mass = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    excess = F.col("distrust") / unit.get("distrust", 1.0) - F.col("trust") / unit.get("trust", 1.0)
    return ranks.groupBy("host").agg(mass("trust"), mass("distrust")).withColumn("excess", excess)


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    p = p.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    p = p.select("page_id", "host", "path", "html", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"))
    scores = host_scores(p, damping, tolerance).withColumnRenamed("host", "of")
    out = p.drop("html").join(scores, F.col("host") == F.col("of"), "left")
    bad = F.coalesce(F.col("excess") > threshold, F.lit(False))
    verdict = F.coalesce("action", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
