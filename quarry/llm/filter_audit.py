"""How filters of a corpus interact: what each removes, alone, after others and over all orders.

Every document has a mask of the filters that it fails.  One aggregation counts the
documents of each part by mask (at most 32 counts a part); a subset-zeta transform, one
addition for each filter and mask, turns these into the documents whose mask lies within
each set, and so into the survivors of every subset of filters.  Whatever an order does is
a difference of neighbouring subsets: a step removes the survivors of the filters before it
less those of the filters up to it, for all documents as for those of a label.

A copy is found without comparing texts: the smallest id of each text's SHA-256 is found by
an aggregation that combines before its shuffle, and comes back by a join on text and id
together, so that a text with very many copies is no hot key there.

Everything is a column expression; nothing leaves the JVM.  A text is held with its words as
an array while it is looked at, some 60 bytes for each byte of text that is short words.

Defined cases: a null text is the empty text and its copy; a null or empty source is the part
``''``; a row without an id is no copy and has no copies; rows that share id and text don't
make each other copies; an id's labels are the largest of its label rows, and null labels
count as 0; an empty table has no parts and no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SPACES, SYMBOLS, UPPER = r"[\x20\x09-\x0D]+", r"[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def steps() -> list[dict]:
    """Each order's steps, with the sets of filters before, up to and other than the step's."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            out.append({"o": "".join(order), "k": k + 1, "f": FILTERS.index(name), "b": before, "a": before | bit(name), "own": bit(name), "rest": ALL ^ bit(name)})
            before |= bit(name)
    return out


def shares() -> list[dict]:
    """For each filter and set of others, in how many orders exactly that set goes before it."""
    n = len(FILTERS)
    return [{"f": k, "b": s, "a": s | 1 << k, "w": factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())} for k in range(n) for s in range(ALL + 1) if not s >> k & 1]


def table(rows: list[dict]) -> Column:
    """Fixed rows as an array of structs."""
    kinds = ",".join(f"{k}:{'string' if isinstance(v, str) else 'int'}" for k, v in rows[0].items())
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kinds}>>")


def marked(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """Row by row: id, part, name of the text, and the mask of A to D."""
    given = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    given = given.withColumn("w", F.array_remove(F.split("t", SPACES), ""))
    given = given.select("id", "part", "t", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("m"), F.length("t").alias("chars"), F.length(F.translate("t", UPPER, "")).alias("others"))
    fails = {"A": F.col("n") < LEAST_WORDS, "B": F.col("m") * 100 < F.col("n") * LEAST_DISTINCT, "C": (F.col("chars") - F.col("others")) * 100 > F.col("chars") * MOST_CAPITALS, "D": F.col("t").rlike(SYMBOLS)}
    mask = sum((F.when(x, bit(k)).otherwise(0) for k, x in fails.items()), F.lit(0))
    return given.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("key"), mask.alias("mask"))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters that they fail."""
    rows = materialize(marked(docs, doc_id, text, part), "masks")
    first = rows.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).withColumn("lead", F.lit(True))
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = rows.join(first, ["key", "id"], "left").join(known, "id", "left")
    copy = F.col("id").isNotNull() & F.col("lead").isNull()
    rows = rows.withColumn("mask", F.col("mask") + F.when(copy, bit("E")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def by_mask(c: str) -> Column:
    """The counts of all masks in order, from a map of those that occur."""
    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.coalesce(F.col("m")[s][c], F.lit(0).cast("long")))


def within(counts: Column) -> Column:
    """The subset-zeta transform: filter by filter, each set that holds it is given the count of the set without it."""
    bits = F.array(*(F.lit(1 << k) for k in range(len(FILTERS))))
    return F.aggregate(bits, counts, lambda f, low: F.transform(f, lambda x, s: x + F.when(s.bitwiseAND(low) != 0, F.get(f, s - low)).otherwise(F.lit(0).cast("long"))))


def audited(counts: DataFrame) -> DataFrame:
    """The report of every part, order and step from counts by mask."""
    measures = ["n", "good", "toxic"]
    own = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("m"))
    own = materialize(own.select("part", *(within(by_mask(c)).alias(c) for c in measures)), "within")

    def left(c: str, removing: Column) -> Column:
        """Survivors of a set of filters: their masks lie within the others."""
        return F.get(F.col(c), F.lit(ALL) - removing)

    def whole(f: Column) -> Column:
        mine = F.filter(F.col("w"), lambda x: x["f"] == f)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x["w"].cast("long") * (left("n", x["b"]) - left("n", x["a"])))

    own = own.withColumn("w", table(shares()))
    own = own.withColumn("shapley", F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), whole))
    each = own.select("part", *measures, "shapley", F.explode(table(steps())).alias("s"))
    before, after = F.col("s.b"), F.col("s.a")
    removed = left("n", before) - left("n", after)
    return each.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"), left("n", after).alias("kept"), removed.alias("removed"),
        (left("n", F.lit(0)) - left("n", F.col("s.own")) - removed).alias("redundant"), (left("n", F.col("s.rest")) - left("n", F.lit(ALL))).alias("unique_fails"),
        (left("good", before) - left("good", after)).alias("good_lost"), (left("toxic", before) - left("toxic", after)).alias("toxic_lost"), F.get("shapley", F.col("s.f")).alias("shapley"),
    )
