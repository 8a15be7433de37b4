"""Containment of intervals: enclosing definitions, outlines, qualified names.

Bulk work sweeps files in the order of their rows; the joins carry ``file_id`` as an equality, so
they are hash or sort joins with the range as a residual condition, never a nested loop over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered, sweep

def contains(row: Column, col: Column | None = None, prefix: str = "") -> Column:
    """Rows include the last one; with a column the end is exclusive."""
    c = lambda name: F.col(prefix + name)
    inside = (c("start_row") <= row) & (c("end_row") >= row)
    if col is None:
        return inside
    before = (c("start_row") < row) | (c("start_col") <= col)
    after = (c("end_row") > row) | (c("end_col") > col)
    return inside & (F.isnull(col) | (before & after))


def innermost() -> list[Column]:
    """The order from the innermost symbol outwards."""
    return [F.col("end_row") - F.col("start_row"), F.desc("start_row"), F.desc("start_col"), F.asc("end_row"), F.asc("end_col"), F.asc("symbol_id")]


def enclosing_few(positions: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """As ``enclosing`` for the positions of one request: these are a join's small side."""
    col = F.col("col") if "col" in positions.columns else None
    at = positions.join(symbols, "file_id").where(contains(F.col("row"), col))
    level = F.row_number().over(Window.partitionBy("position_id").orderBy(*innermost()))
    return at.withColumn("level", level.cast("long")).where(F.col("level") <= depth)


def enclosing(positions: DataFrame, symbols: DataFrame, depth: int = 1) -> DataFrame:
    """positions (position_id, file_id, row[, col]) -> the ``depth`` innermost symbols, ``level`` 1 innermost."""
    return sweep.enclosing(positions, symbols, depth)


def outside(positions: DataFrame, symbols: DataFrame) -> DataFrame:
    """Positions that no symbol encloses."""
    found = sweep.enclosing(positions, symbols.select("file_id", "symbol_id", "start_row", "start_col", "end_row", "end_col"), 1, outer=True)
    return found.where("level IS NULL").select(*positions.columns)


def nested(symbols: DataFrame, containers: Column | None = None) -> DataFrame:
    """Adds ``parent_id``, ``depth`` (1 at the top), ``qualified`` and ``root`` (ordinal of the top-level ancestor), by a
    self join and ranks.  ``containers`` tells which symbols may hold others."""
    held = F.lit(True) if containers is None else containers
    a = symbols.where(held).select("file_id", F.col("symbol_id").alias("up"), F.col("name").alias("up_name"), *(F.col(c).alias(f"u_{c}") for c in ("start_row", "start_col", "end_row", "end_col")))
    s = symbols
    before = F.struct("u_start_row", "u_start_col") <= F.struct("start_row", "start_col")
    after = F.struct("u_end_row", "u_end_col") >= F.struct("end_row", "end_col")
    # of equal intervals the one with the smaller id is the outer one
    other = (F.struct("u_start_row", "u_start_col", "u_end_row", "u_end_col") != F.struct("start_row", "start_col", "end_row", "end_col")) | (F.col("up") < F.col("symbol_id"))
    pairs = s.join(a, "file_id").where(before & after & other & (F.col("up") != F.col("symbol_id")))
    order = F.array_sort(F.collect_list(F.struct("u_start_row", "u_start_col", (-F.col("u_end_row")).alias("r"), (-F.col("u_end_col")).alias("c"), "up", "up_name")))
    above = pairs.groupBy("symbol_id").agg(order.alias("above"))
    out = s.drop("qualified").join(above, "symbol_id", "left")
    none = F.coalesce(F.size("above"), F.lit(0))
    chain = F.concat(F.transform("above", lambda x: x.up_name), F.array("name"))
    return out.withColumns({
        "depth": (F.when(F.col("above").isNull(), 0).otherwise(none) + 1).cast("long"),
        "parent_id": F.element_at("above", -1).up,
        "root_id": F.coalesce(F.get("above", F.lit(0)).up, F.col("symbol_id")),
        "qualified": F.when(F.col("above").isNotNull(), F.array_join(chain, ".")),
    }).drop("above")


def nested_by_stack(symbols: DataFrame, skip: tuple[str, ...] = ("import",)) -> DataFrame:
    """The same in linear time by a sweep, which spreads a very large file over tasks: the symbols' places,
    kinds and names with ``parent_id``, ``depth``, ``root_id`` and ``qualified``."""
    return sweep.nested(symbols, skip)


def outline_roots(nested_symbols: DataFrame) -> DataFrame:
    """Adds ``root``: the ordinal (0-based) of the top-level ancestor in its file."""
    top = nested_symbols.where("depth = 1").select("file_id", F.col("symbol_id").alias("root_id"), "start_row", "start_col", "end_row", "end_col")
    top = ordered.ordered(top, ["file_id", "start_row", "start_col", F.desc("end_row"), F.desc("end_col"), "root_id"]).numbered().select("file_id", "root_id", "ordinal")
    first = top.groupBy("file_id").agg(F.min("ordinal").alias("first"))
    return nested_symbols.join(top.join(first, "file_id").select("file_id", "root_id", (F.col("ordinal") - F.col("first")).alias("root")), ["file_id", "root_id"])


def nearest_boundary(heads: DataFrame, last_rows: DataFrame) -> DataFrame:
    """heads (file_id, row, level): adds ``end_row``, the row before the next head of the same or a higher level, else the file's last row."""
    w = Window.partitionBy("file_id").orderBy("row").rowsBetween(1, Window.unboundedFollowing)
    out = heads
    levels = 6
    for level in range(1, levels + 1):
        out = out.withColumn(f"_n{level}", F.min(F.when(F.col("level") <= level, F.col("row"))).over(w))
    following = F.coalesce(*(F.when(F.col("level") == level, F.col(f"_n{level}")) for level in range(1, levels + 1)))
    return out.join(last_rows, "file_id").withColumn("end_row", F.coalesce(following - 1, F.col("last_row"))).drop(*(f"_n{i}" for i in range(1, levels + 1)), "last_row")


def relocated(stale: DataFrame, live: DataFrame) -> DataFrame:
    """Each stale symbol's place in live source: the same name, the same kind if any has it, and the nearest
    middle; none if two are equally near.  The sides are merged by middle, not joined by name: a file in which very
    many symbols share a name costs a sort."""
    mid = (F.col("start_row") + F.col("end_row")).alias("mid")
    a = stale.select("symbol_id", "file_id", "name", "kind", mid)
    each = live.select("file_id", "name", "kind", mid, F.col("symbol_id").alias("live_id"), "start_row", "end_row")

    def nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
        places = each.groupBy(*keys, "mid").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("live_id", "start_row", "end_row")))
        out = ordered.neighbours(rows, places, keys, "mid")
        down, up = F.col("mid") - F.col("below.mid"), F.col("above.mid") - F.col("mid")
        one = F.when(F.col("below").isNull() | (up < down), F.col("above")).when(F.col("above").isNull() | (down < up) | (down == 0), F.col("below"))
        some = F.col("below").isNotNull() | F.col("above").isNotNull()
        place = F.when(some, F.struct(F.when(one["n"] == 1, F.struct(one["live_id"].alias("live_id"), one["start_row"].alias("start_row"), one["end_row"].alias("end_row"))).alias("at")))
        return out.select(*rows.columns, place.alias("own" if "kind" in keys else "any"))

    both = nearest(nearest(a, ["file_id", "name", "kind"]), ["file_id", "name"])
    return both.select("symbol_id", F.coalesce("own", "any")["at"].alias("x")).where("x IS NOT NULL").select("symbol_id", "x.*")


def union_lines(ranges: DataFrame) -> DataFrame:
    """(file_id, start_row, end_row) ranges that may overlap -> (file_id, row), each line once."""
    return ranges.select("file_id", F.explode(F.sequence("start_row", "end_row")).alias("row")).distinct()
