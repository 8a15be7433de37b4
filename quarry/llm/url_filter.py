"""URL rules, and for URLs that no rule decides, trust spread over the host graph.

Hosts are linked by the absolute links of their pages (a relative link stays on its
host).  Trust starts at hosts with allowed pages and follows links; distrust starts
at hosts with blocked pages and follows links backwards, since who links to a bad
host is suspect.  Both are personalised PageRanks, computed together, in whole
numbers so that the result doesn't depend on the order of sums.  A host is blocked
if its distrust is over ``RATIO`` percent of its trust; without either it's allowed.

Pages are counted by host, and links by pair of hosts, before any shuffle, so a host
with a third of all pages is one row of the graph.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no
rule, and takes part in no link; null html has no links; repeated rows count as
often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, unpack

#: Host, path and verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UNIT, DAMPING, ROUNDS, RATIO = 1_000_000_000, 85, 10, 100
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | F.Column) -> F.Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(c, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``_ruling``: the longest rule that fits, else null."""
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruling = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return out.withColumns({"rule": rule, "_ruling": ruling})


def host_graph(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): pages' links between different hosts, counted."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("link"))
    to = F.translate(F.regexp_extract("link", r"//([^/?#]*)", 1), UPPER, LOWER)
    return links.select("src", to.alias("dst")).where("dst <> '' AND dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """seeds (host, kind, seed), edges (kind, src, dst, n) -> (host, kind, mass), in whole numbers."""
    total = edges.groupBy("kind", F.col("src").alias("host")).agg(F.sum("n").alias("total"))
    edges = materialize(edges.join(total.withColumnRenamed("host", "src"), ["kind", "src"]), "host-edges")
    seeds = materialize(seeds, "host-seeds")
    mass = seeds.select("host", "kind", F.col("seed").alias("mass"))
    if edges.limit(1).count() == 0:
        return mass
    for _ in range(rounds):
        moved = mass.withColumnRenamed("host", "src").join(edges, ["kind", "src"])
        moved = moved.select(F.col("dst").alias("host"), "kind", F.expr(f"mass * {DAMPING} div 100 * n div total").alias("mass"))
        mass = materialize(moved.unionByName(seeds.select("host", "kind", F.col("seed").alias("mass"))).groupBy("host", "kind").agg(F.sum("mass").alias("mass")), "host-mass")
    return mass


def judged(pages: DataFrame, url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` without the html, with ``host``, ``path``, ``rule`` and ``verdict``."""
    out = ruled(pack(pages, None, _url=F.col(url), _html=F.col(html)), "_url", rules)
    links = host_graph(out, "_html")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    counts = out.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("_ruling") == "allow").alias("allow"), F.count_if(F.col("_ruling") == "block").alias("block"))
    seeds = counts.select("host", F.explode(F.create_map(F.lit("trust"), F.expr(f"{UNIT} * allow div n"), F.lit("distrust"), F.expr(f"{UNIT} * block div n"))).alias("kind", "seed")).where("seed > 0")
    mass = spread(seeds, materialize(both, "host-links"))
    sums = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("t"), F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("d"))
    bad = materialize(sums.where(f"100 * coalesce(d, 0) > {RATIO} * coalesce(t, 0)").select("host", F.lit("block").alias("_method")), "blocked-hosts")
    out = out.drop("_html").join(bad, "host", "left").withColumn("verdict", F.coalesce("_ruling", "_method", F.lit("allow")))
    return unpack(out, pages.columns, None, False, ["host", "path", "rule", "verdict"]).drop(html)
