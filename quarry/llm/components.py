"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp is the smallest node reachable.

    Each round takes the smallest label among neighbours (counted before the
    shuffle, so that a hub with very many edges is no hot group), then jumps to
    the label's own label.  A round's labels are written to the shared folder.
    An empty edge table gives an empty result; loops and repeated edges are harmless.
    """
    both = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct(), "edges")
    label = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("comp").alias("m"))
        low = label.join(near, label.node == near.u, "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("low"))
        low = materialize(low, "lower")
        own = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = materialize(low.join(own, "low", "left").select("node", "comp", F.least("low", F.coalesce("next", "low")).alias("new")), "labels")
        moved = new.where("new <> comp").limit(1).count()
        label = new.select("node", F.col("new").alias("comp"))
        if not moved:
            return label
