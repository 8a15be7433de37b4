"""Byte budgets of many responses at once: how many rows of each fit.

A response is its fixed part and its rows with commas between them.  Two rules cut it: the rows are scaled by how much
the response is over (and again, until it fits or one row is left), or they are taken off one by one.  Both only need the
size with n rows, which is a running sum.  Of a response with very many rows only the first ones are looked at: after the
first step of scaling, no more rows are left than fit at the smallest size of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of either rule.
SCALED, POPPED = 64, 512


def sized(rows: DataFrame, key: str, order: list[str | Column], size: Column, budget: int, least: int) -> DataFrame:
    """(key, rows, bytes, upto): of each key, how many rows, their bytes in all, and the bytes of its first 1, 2, ... rows with
    their commas.  ``least`` is the least size of a row: no more than ``budget / least + 1`` rows can matter."""
    given = rows.withColumn("_size", size.cast("long") + 1)
    along = Window.partitionBy(key).orderBy(*order)
    upto = F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    first = given.withColumns({"_rank": F.row_number().over(along), "_upto": upto}).where(F.col("_rank") <= budget // least + 2)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", "_upto"))).alias("u")).select(key, F.transform("u", lambda x: x["_upto"]).alias("upto"))
    whole = given.groupBy(key).agg(F.count("*").alias("rows"), (F.sum("_size") - 1).alias("bytes"))
    return whole.join(first, key)


def with_rows(n: Column, fixed: Column) -> Column:
    """The size of a response with n rows; of one that is longer than what was looked at, that of all rows."""
    return fixed + F.when(n <= F.size("upto"), F.get(F.col("upto"), (n - 1).cast("int"))).otherwise(F.col("bytes"))


def scaled(responses: DataFrame, fixed: Column, budget: int) -> DataFrame:
    """Adds ``kept`` rows, their ``size`` and whether it ``fits``: n becomes n * budget / size, less by one at least."""

    def step(n: Column, _: Column) -> Column:
        size = with_rows(n, fixed)
        return F.when((size > budget) & (n > 1), F.greatest(F.lit(1).cast("long"), F.least((n * budget - F.pmod(n * budget, size)) / size, n - 1).cast("long"))).otherwise(n)

    # most responses fit as they are and take no steps
    kept = F.when(fixed + F.col("bytes") <= budget, F.col("rows")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(SCALED)), F.col("rows"), step))
    out = responses.withColumn("kept", kept)
    return out.withColumn("size", with_rows(F.col("kept"), fixed)).withColumn("fits", F.col("size") <= budget)


def popped(responses: DataFrame, fixed: Column, budget: int) -> DataFrame:
    """The same with rows taken off one by one, ``POPPED`` at most."""
    least = F.greatest(F.lit(1).cast("long"), F.col("rows") - POPPED)
    upto = F.transform("upto", lambda x, i: F.when((x + fixed <= budget) & (i + 1 >= least), (i + 1).cast("long")).otherwise(least))
    kept = F.when(fixed + F.col("bytes") <= budget, F.col("rows")).otherwise(F.greatest(least, F.array_max(upto)))
    out = responses.withColumn("kept", kept)
    return out.withColumn("size", with_rows(F.col("kept"), fixed)).withColumn("fits", F.col("size") <= budget)
