"""Identifier occurrences of plain text, with byte columns, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An identifier, for counts that need neither place nor context.
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[95] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
#: Texts of about so many bytes are looked at together, and longer ones in pieces of about so many.
GROUP = 1 << 18
#: What tasks hold grows with the bytes of an Arrow batch, whose rows alone Spark limits.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def text_bytes(column: pa.Array):
    """Each value's UTF-8 bytes; null is empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else []
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if ok[i] else raw[:0]


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of letters, digits and underscores, without leading digits."""
    edge = np.diff(np.concatenate([[0], WORD[data].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digits = np.flatnonzero(DIGIT[data[start]]) if len(start) else start
    for i in digits:
        while start[i] < end[i] and DIGIT[data[start[i]]]:
            start[i] += 1
    keep = start < end
    return start[keep], end[keep]


CONTEXTS = pa.array(["identifier", "call", "assignment", "declaration", "type-ref"])
DECLARATION, TYPE_REF = 3, 4


def occurrences(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, row, column, context number) of every identifier.

    The context of prose is a fixed rule on neighbours: before ``.`` it is a call,
    before ``,`` an assignment, with a capital letter a declaration if nothing but
    blanks stands before it in its line and else a type-ref, otherwise an identifier.
    """
    start, end = identifiers(data)
    stop = np.flatnonzero(data == 10)
    row = np.searchsorted(stop, start, side="left")
    begin = np.concatenate([[0], stop + 1])[row]
    after = np.where(end < len(data), data[np.minimum(end, max(len(data) - 1, 0))], 0) if len(data) else end
    upper = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.zeros(0, bool)
    blank = np.concatenate([[0], np.cumsum((data != 32) & (data != 9) & (data != 10) & (data != 13))])
    first = blank[start] == blank[begin]
    context = np.select([after == 46, after == 44, upper & first, upper], [1, 2, 3, 4], 0)
    return start, end, row, start - begin, context


def cuts(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``limit`` bytes that part no identifier: each but the last ends with another byte."""
    at = 0
    while at < len(data):
        stop = min(at + limit, len(data))
        while stop < len(data) and WORD[data[stop - 1]]:
            gap = np.flatnonzero(~WORD[data[stop : stop + limit]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + limit, len(data))
        yield at, stop
        at = stop


def occurrences_in_pieces(data: np.ndarray, limit: int = GROUP) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """Pieces of a text, each with its occurrences: start and end within the piece, row, column and context as in the whole text."""
    row, line, blank = 0, 0, True  # of the piece's first byte: its row, where that begins, and whether only blanks stand before
    for at, stop in cuts(data, limit):
        piece = data[at:stop]
        start, end, r, col, context = occurrences(piece)
        first = r == 0
        if not blank:
            context = np.where(first & (context == DECLARATION), TYPE_REF, context)
        yield piece, (start, end, r + row, col + first * (at - line), context)
        if stop < len(data):
            ends = np.flatnonzero(piece == 10)
            if len(ends):
                row, line, blank = row + len(ends), at + int(ends[-1]) + 1, True
            rest = data[max(line, at) : stop]
            blank = blank and bool(((rest == 32) | (rest == 9) | (rest == 13)).all())


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of all the identifiers, one after the other."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] = -1
    return data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]


def strings(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Strings of the given sizes out of ASCII bytes that follow one another."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(data))


def spelled_contexts(context: np.ndarray) -> pa.Array:
    return CONTEXTS.take(pa.array(context))


#: Bytes for each core under which an input is dealt out anew: it may well be one row group, which is one task.
SMALL = 8 << 20


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A small input over all cores before expensive work on its rows; a large one stays as it's read.  Either goes to
    Python workers in small batches, unless the session says otherwise.  If given, ``parts`` is how many it's dealt out to."""
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    if parts is not None:
        return df.repartition(parts)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def named(data: np.ndarray, start: np.ndarray, end: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Which of the identifiers have one of the names."""
    out = []
    for name in names:
        some = np.flatnonzero(end - start == len(name))
        for k, c in enumerate(name):
            some = some[data[start[some] + k] == c]
        out.append(some)
    return np.sort(np.concatenate(out))


def name_counts(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(file_id, name, n): how often each name stands in each text, without leaving the JVM."""
    each = spread(texts.select(key, text)).select(key, F.explode(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)).alias("name"))
    return each.groupBy("name", key).agg(F.count("*").alias("n"))


def with_occurrences(texts: DataFrame, key: str = "file_id", text: str = "text", names: list[str] | None = None) -> DataFrame:
    """(file_id, name, start_row, start_col, end_row, end_col, context) of all identifiers, or of those with the names:
    then texts without any of them stay below the scanner, and other identifiers inside it."""
    wanted = [n.encode() for n in dict.fromkeys(names)] if names is not None else None
    if names is not None:
        holds = F.lit(False)
        for name in names:
            holds = holds | F.col(text).contains(name)
        texts = texts.where(holds)

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            rows, size = [], 0
            for i, data in enumerate(text_bytes(batch.column(1))):
                for piece, (start, end, row, col, context) in occurrences_in_pieces(data):
                    if wanted is not None:
                        some = named(piece, start, end, wanted)
                        start, end, row, col, context = start[some], end[some], row[some], col[some], context[some]
                    rows.append((np.full(len(start), keys[i]), row, col, end - start, context, spelled(piece, start, end)))
                    size += len(piece)
                    if size >= GROUP:
                        out, rows, size = packed(rows), [], 0
                        yield out
            if rows:
                yield packed(rows)

    def packed(rows) -> pa.RecordBatch:
        key_, row, col, n, context, names = (np.concatenate([x[k] for x in rows]) for k in range(6))
        r, c0, c1 = (pa.array(x, pa.int64()) for x in (row, col, col + n))
        columns = [pa.array(key_, pa.int64()), strings(n, names), r, c0, r, c1, spelled_contexts(context)]
        return pa.RecordBatch.from_arrays(columns, ["file_id", "name", "start_row", "start_col", "end_row", "end_col", "context"])

    return spread(texts.select(key, text)).mapInArrow(run, "file_id long, name string, start_row long, start_col long, end_row long, end_col long, context string")


FOUND = pa.struct([("name", pa.string()), ("start_col", pa.int64()), ("end_row", pa.int64()), ("end_col", pa.int64()), ("context", pa.string())])


def occurrences_by_row(texts: DataFrame, key: str = "file_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(file_id, text, found): the same occurrences, beside their text: an array for each row of it.  ``parts`` as in ``spread``."""

    def run(batches):
        for batch in batches:
            rows, size, first = [], 0, 0
            for i, data in enumerate(text_bytes(batch.column(1))):
                start, end, row, col, context = occurrences(data)
                rows.append((row, col, end - start, context, spelled(data, start, end), np.bincount(row, minlength=int((data == 10).sum()) + 1)))
                size += len(data)
                if size >= GROUP:
                    yield packed(batch.slice(first, len(rows)), rows)
                    rows, size, first = [], 0, i + 1
            if rows:
                yield packed(batch.slice(first, len(rows)), rows)

    def packed(batch, rows) -> pa.RecordBatch:
        row, col, size, context, names, n = (np.concatenate([x[k] for x in rows]) for k in range(6))
        ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
        columns = [strings(size, names), *(pa.array(x, pa.int64()) for x in (col, row, col + size)), spelled_contexts(context)]
        each = pa.ListArray.from_arrays(ends(n), pa.StructArray.from_arrays(columns, fields=list(FOUND)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends([len(x[5]) for x in rows]), each)], ["file_id", "text", "found"])

    schema = "file_id long, text string, found array<array<struct<name:string,start_col:long,end_row:long,end_col:long,context:string>>>"
    return spread(texts.select(key, text), parts).mapInArrow(run, schema)
