"""What a rule file depends on: its route over links, as a table, and the folders that a change on the route governs.

A rule file may be a link, lie behind linked folders, or both, and links lead to links.  Links are an edge table
(path, target).  A route is followed a link at a time, for all rule files at once: the first part of a path that is a link
is replaced by its target, and the rest is kept.  Every place on the way counts, since whatever is replaced there changes
the rules.  A route ends at a path without links, at a state that it has been in, or after ``HOPS`` links.

Defined cases: a relative target is taken from the link's folder; ``.`` and ``..`` are resolved in the text of a path; a path
with two links takes the smaller target; links that lead nowhere count as places; null paths are left out; rules that repeat
are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import landed

#: Fixed value: links that are followed for one file.
HOPS = 40


def normal(path: Column) -> Column:
    """Without empty parts, ``.`` and ``..``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")
    out = F.aggregate(parts, none, lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(out, "/"))


def prefixes(path: Column) -> Column:
    """The path's own parts from the top, as paths, the whole one last."""
    parts = F.split(path, "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.filter(each, lambda x: x != "")


def routes(rules: DataFrame, links: DataFrame, hops: int = HOPS) -> DataFrame:
    """rules (folder, path), links (path, target) -> (folder, path, hop): the places on each rule file's route."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    target = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, F.when(folder != "", "/").otherwise(""), F.col("target")))
    edges = links.where("path IS NOT NULL AND target IS NOT NULL").select(normal(F.col("path")).alias("link"), normal(target).alias("to")).groupBy("link").agg(F.min("to").alias("to"))
    edges = landed(edges, "links")
    at = landed(rules.where("path IS NOT NULL").select("folder", normal(F.col("path")).alias("now")).distinct().withColumns({"start": F.col("now"), "been": F.array("now")}), "routes")
    places = []
    for hop in range(hops + 1):
        parts = at.select("folder", "start", "now", "been", F.posexplode(prefixes(F.col("now"))).alias("k", "link"))
        found = parts.join(edges, "link").groupBy("folder", "start").agg(F.min_by(F.struct("link", "to"), "k").alias("hit"))
        step = at.join(found, ["folder", "start"], "left").withColumn("place", F.coalesce("hit.link", "now"))
        rest = F.substring(F.col("now"), F.length("hit.link") + 1, F.length("now"))
        step = landed(step.withColumn("then", F.when(F.col("hit").isNotNull(), normal(F.concat(F.col("hit.to"), rest)))), "routes")
        places.append(step.select("folder", F.col("place").alias("path"), F.lit(hop).alias("hop")))
        at = step.where(F.col("then").isNotNull() & ~F.array_contains("been", F.col("then")))
        at = at.select("folder", "start", F.col("then").alias("now"), F.concat("been", F.array("then")).alias("been"))
        if at.isEmpty():
            break
    out = places[0]
    for x in places[1:]:
        out = out.unionByName(x)
    return out.groupBy("folder", "path").agg(F.min("hop").alias("hop"))


def governed(changed: DataFrame, on_routes: DataFrame) -> DataFrame:
    """The folders whose rules may have changed: a changed path (path) is a place on a route, or lies above one."""
    above = on_routes.select("folder", F.explode(prefixes(F.col("path"))).alias("path"))
    return above.join(changed.select(normal(F.col("path")).alias("path")).distinct(), "path", "left_semi").select("folder").distinct()
