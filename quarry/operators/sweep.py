"""Intervals of files in one sweep: the symbols around each position, and the nesting of symbols.

Rows are dealt out by ranges of (file, row), so a file of any size lies in as many parts as it has
rows for.  A part is swept in its order with the symbols that are still open, which is a short list.
What a part needs from those before it are the symbols that reach over its border: these are
found by comparing ends with the first row of each part, and given to it ahead of its own
rows.  So a symbol is copied once for each border that it reaches over, and all else moves twice: to its range, and to the
task that sweeps it.  Nothing is compared pairwise.

Of crossing symbols (which a parser doesn't give) the sweep for positions finds all that hold the
position; nesting takes the innermost symbol before it that ends no earlier.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def in_parts(rows: DataFrame, by: list[str | Column]) -> DataFrame:
    """rows (file_id, _row, _end; null for what doesn't reach on) in parts: ``_part``, and ``_place`` (-1 for rows that reach
    over the border into the part)."""
    whole = ordered.ordered(rows, by)
    out, n = whole.rows, len(whole.starts)
    if n > 1:
        border = out.groupBy("_part").agg(F.min_by(F.struct("file_id", "_row"), "_place").alias("f")).select(F.col("_part").alias("_into"), F.col("f.file_id").alias("file_id"), F.col("f._row").alias("_first"))
        reach = out.join(border, "file_id").where((F.col("_part") < F.col("_into")) & (F.col("_end") >= F.col("_first")))
        reach = reach.withColumns({"_part": F.col("_into"), "_place": F.lit(-1).cast("long")}).select(*out.columns)
        out = out.unionByName(reach).repartitionByRange(n, "_part")
    return out.sortWithinPartitions("_part", "_place", *by)


def enclosing(positions: DataFrame, symbols: DataFrame, depth: int = 1, outer: bool = False) -> DataFrame:
    """positions (position_id, file_id, row[, col]) with each of the ``depth`` innermost symbols, ``level`` 1 innermost; with
    ``outer``, positions without any have one row of nulls.  Rows include a symbol's last one; with a column its end is
    exclusive."""
    p, s = [c for c in positions.columns if c != "file_id"], [c for c in symbols.columns if c != "file_id"]
    none = F.lit(None)
    at = positions.select("file_id", F.col("row").alias("_row"), none.cast("long").alias("_end"), F.lit(1).alias("_side"), F.struct(*p).alias("_p"), (F.col("col") if "col" in p else none).cast("long").alias("_col"), none.cast("long").alias("_end_col"))
    own = symbols.select("file_id", F.col("start_row").alias("_row"), F.col("end_row").alias("_end"), F.lit(0).alias("_side"), F.struct(*s).alias("_s"), F.col("start_col").cast("long").alias("_col"), F.col("end_col").cast("long").alias("_end_col"))
    rows = in_parts(at.unionByName(own.withColumn("_id", F.col("_s.symbol_id")), allowMissingColumns=True), ["file_id", "_row", "_side"])
    rows = rows.select("_part", "file_id", "_row", "_end", "_side", "_col", "_end_col", "_id", "_p", "_s")

    def holds(x: tuple, row: int, col: int | None) -> bool:
        start, start_col, end, end_col = x[:4]
        return start <= row <= end and (col is None or (start < row or start_col <= col) and (end > row or end_col > col))

    def run(batches):
        open_: list[tuple] = []  # start, its column, end, its column, id, place among the symbols held
        held, last = None, None
        for batch in batches:
            column = batch.column("_s")
            base = 0 if held is None else len(held)
            every = column if held is None else pa.concat_arrays([held, column])
            points, found, levels = [], [], []
            for i, (part, file, row, end, side, col, end_col, id_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_part", "file_id", "_row", "_end", "_side", "_col", "_end_col", "_id")), strict=True)):
                if (part, file) != last:
                    open_, last = [], (part, file)
                if side == 0:
                    open_.append((row, col, end, end_col, id_, base + i))
                    continue
                if open_ and min(x[2] for x in open_) < row:
                    open_ = [x for x in open_ if x[2] >= row]
                inner = heapq.nsmallest(depth, (x for x in open_ if holds(x, row, col)), key=lambda x: (x[2] - x[0], -x[0], -x[1], x[2], x[3], x[4]))
                points += [i] * (len(inner) or outer)
                found += [x[5] for x in inner] or [None] * outer
                levels += list(range(1, len(inner) + 1)) or [None] * outer
            at, which = pa.array(points, pa.int64()), pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(at), batch.column("_p").take(at), every.take(which), pa.array(levels, pa.int64())], ["file_id", "_p", "_s", "level"])
            held = every.take(pa.array([x[5] for x in open_], pa.int64()))
            open_ = [(*x[:5], k) for k, x in enumerate(open_)]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, f"file_id {kinds['file_id']}, _p {kinds['_p']}, _s {kinds['_s']}, level long")
    return out.select("file_id", "_p.*", "_s.*", "level")


def nested(symbols: DataFrame, skip: tuple[str, ...] = ("import",)) -> DataFrame:
    """The symbols' places, kinds and names with ``parent_id``, ``depth`` (1 at the top), ``root_id`` and ``qualified``; symbols of the kinds in
    ``skip`` hold no others."""
    by = ["file_id", "_row", "start_col", F.desc("_end"), F.desc("end_col"), "symbol_id"]
    rows = symbols.select("file_id", "symbol_id", "kind", "name", F.col("start_row").alias("_row"), "start_col", F.col("end_row").alias("_end"), "end_col")
    rows = in_parts(rows, by)

    def run(batches):
        stack: list[tuple] = []
        last = None
        for batch in batches:
            mine, parent, depth, root, qualified = [], [], [], [], []
            for n, (part, place, f, i, kind, name, er, ec) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_part", "_place", "file_id", "symbol_id", "kind", "name", "_end", "end_col")), strict=True)):
                if (part, f) != last:
                    stack, last = [], (part, f)
                while stack and (stack[-1][0], stack[-1][1]) < (er, ec):
                    stack.pop()
                if place >= 0:
                    mine.append(n)
                    parent.append(stack[-1][2] if stack else None)
                    depth.append(len(stack) + 1)
                    root.append(stack[0][2] if stack else i)
                    qualified.append(".".join([x[3] for x in stack] + [name]) if stack else None)
                if kind not in skip:
                    stack.append((er, ec, i, name))
            at = pa.array(mine, pa.int64())
            own = [batch.column(c).take(at) for c in ("file_id", "symbol_id", "kind", "name", "_row", "start_col", "_end", "end_col")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(parent, pa.int64()), pa.array(depth, pa.int64()), pa.array(root, pa.int64()), pa.array(qualified, pa.string())], [x.split()[0] for x in NESTED.split(", ")])

    return rows.mapInArrow(run, NESTED)


NESTED = "file_id long, symbol_id long, kind string, name string, start_row long, start_col long, end_row long, end_col long, parent_id long, depth long, root_id long, qualified string"
