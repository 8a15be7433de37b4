"""Work on one global order without one task for it: ordinals and deep pages, nearest neighbours, chains of windows.

* ``ordered`` deals rows out by ranges of the order and writes them; a row's ordinal is its place in its part plus the
  rows of the parts before.  Only the number of rows of each part comes to the driver.  A deep page reads the parts that
  it lies in.
* ``neighbours`` finds the next row below and above in another table by a merge: both sides are sorted together, and the
  last value seen is carried along; nothing is joined on the key, so equal keys make no product.  A key's rows are dealt
  out in stripes of the order, and what a stripe needs from the ones before it is carried over a summary of stripes.
* ``window_starts`` follows the chain from each window to the first event after it by pointer doubling, in as many
  rounds as the number of windows has binary digits.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Of the order's values, those that lie together in one task.
STRIPE = 4096
#: Rows up to which a page is taken from the top of the order directly.
NEAR = 10_000


def folder(spark: SparkSession, name: str = "index") -> str:
    """A new folder that all executors see and that goes with the application; one of this machine only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="quarry-")
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def given(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    """A few rows that the driver holds, as a local table.  A list of Python objects would be copied by workers of its own on
    all executors, beside those that Arrow batches go to."""
    names = StructType.fromDDL(kinds).names
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names), kinds)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back."""
    path = folder(df.sparkSession, name) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Ordered:
    """Rows in a global order, with ``_part`` and ``_place`` within it."""

    rows: DataFrame
    starts: list[tuple[int, int, int]]  # part, ordinal of its first row, rows

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.starts)

    def numbered(self, name: str = "ordinal", parts: list[tuple[int, int, int]] | None = None) -> DataFrame:
        """All rows, or those of some parts, with their ordinal in the whole order."""
        parts = self.starts if parts is None else parts
        first = given(self.rows.sparkSession, [(p, s) for p, s, _ in parts], "_part int, _first long")
        rows = self.rows if parts is self.starts else self.rows.where(F.col("_part").isin([p for p, _, _ in parts]))
        return rows.join(first, "_part").withColumn(name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")

    def page(self, offset: int, limit: int, name: str = "ordinal") -> DataFrame:
        """The rows from an ordinal on.  Parts outside of the page aren't read: their statistics tell."""
        parts = [(p, s, n) for p, s, n in self.starts if s < offset + limit and s + n > offset]
        return self.numbered(name, parts).where((F.col(name) >= offset) & (F.col(name) < offset + limit))


def ordered(rows: DataFrame, by: list[str | Column]) -> Ordered:
    """Deal rows out by ranges of ``by``.  Rows that are equal in it lie in one part, in any order, so give it a key at its end."""
    at = F.monotonically_increasing_id()
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_k", at)
    out = landed(out.withColumns({"_part": F.shiftright("_k", 33).cast("int"), "_place": F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_k"), "ordered")
    starts, first = [], 0
    for r in sorted(out.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row a part
        starts.append((r._part, first, r.n))
        first += r.n
    return Ordered(out, starts)


def page(rows: DataFrame, by: list[str | Column], limit: int, offset: int = 0, name: str = "ordinal") -> DataFrame:
    """The rows from ``offset`` on in the order, with their ordinal."""
    if offset + limit > NEAR:
        return ordered(rows, by).page(offset, limit, name)
    some = rows.orderBy(*by).offset(offset).limit(limit)  # a bounded number of rows comes here
    return some.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long") - 1 + offset)


def neighbours(left: DataFrame, right: DataFrame, keys: list[str], at: str, stripe: int = STRIPE) -> DataFrame:
    """``left`` with ``below`` and ``above``: of ``right``'s rows with the same keys, that with the greatest ``at`` up to the
    row's own, and that with the least from it on, as structs; null where there is none.  Keys that are null are equal.
    ``right`` has one row for each keys and ``at``."""
    own, found = [F.col(c) for c in keys], F.struct(*right.columns)
    cell = F.expr(f"(`{at}` - pmod(`{at}`, {stripe})) div {stripe}").alias("_cell")
    a = left.select(*own, F.col(at).alias("_at"), cell, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    b = right.select(*own, F.col(at).alias("_at"), cell, F.lit(0).alias("_side"), found.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    held = Window.partitionBy(*own, "_cell").rowsBetween(Window.unboundedPreceding, 0)
    near = {"_below": F.last("_right", True).over(held.orderBy("_at", "_side")), "_above": F.last("_right", True).over(held.orderBy(F.desc("_at"), "_side"))}
    near = both.withColumns(near).where("_side = 1")
    cells = both.groupBy(*own, "_cell").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_at"))).alias("_most"), F.min_by("_right", F.when(F.col("_side") == 0, F.col("_at"))).alias("_least"))
    along = Window.partitionBy(*own).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"_before": F.last("_most", True).over(along.orderBy("_cell")), "_after": F.last("_least", True).over(along.orderBy(F.desc("_cell")))})
    cells = cells.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col("_cell").alias("_c"), "_before", "_after")
    same = F.col("_cell") == F.col("_c")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return near.join(cells, same, "left").select("_left.*", F.coalesce("_below", "_before").alias("below"), F.coalesce("_above", "_after").alias("above"))


def window_starts(events: DataFrame, seconds: int, at: str = "at", keys: list[str] | None = None) -> DataFrame:
    """(keys, at): where windows open.  The first opens at the first event and lasts so many seconds; the next opens at
    the first event that isn't in it.  Keys (such as the feed) have chains of their own."""
    given = keys or []
    keys = given or ["_feed"]
    own = landed(events.select(*(keys if given else [F.lit(0).alias("_feed")]), at).distinct(), "times")
    times = own.select(*keys, F.col(at).alias("_to"))
    probe = own.select(*keys, F.col(at).alias("_from"), (F.col(at) + seconds).alias("_to"))
    jump = landed(neighbours(probe, times, keys, "_to").where("above IS NOT NULL").select(*keys, "_from", F.col("above._to").alias("_next")), "jumps")
    reach, n = landed(own.groupBy(*keys).agg(F.min(at).alias("_from")), "reach"), -1
    while (m := reach.count()) != n:
        n = m
        reach = landed(reach.unionByName(reach.join(jump, [*keys, "_from"]).select(*keys, F.col("_next").alias("_from"))).distinct(), "reach")
        further = jump.select(*keys, F.col("_from").alias("_next"), F.col("_next").alias("_then"))
        jump = landed(jump.join(further, [*keys, "_next"]).select(*keys, "_from", F.col("_then").alias("_next")), "jumps")
    return reach.select(*given, F.col("_from").alias(at))
