"""An index of three-byte strings, so that a pattern with required literals doesn't read every source.

Files are taken in shards as they are read.  A shard gives one row for each three-byte string in it: the
string as a number, and the sorted ids of the files that hold it, as differences in variable-length bytes.
The rows are sorted by string, so that a query's strings are looked up by the statistics of the Parquet files.
A literal stands only in files that hold all of its strings: the lists are intersected shard by shard, alternatives united.

Defined cases: null content holds nothing; a literal of fewer than three bytes tells nothing, and an alternative of
such literals only lets every file through; a file in the index twice is one; what the index lets through is a superset,
so the literals themselves are looked for in what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 3
#: (string, file) pairs of a shard.
SHARD = 1 << 22
INDEX = "gram int, shard long, files int, ids binary"


def grams(data: np.ndarray) -> np.ndarray:
    """The distinct three-byte strings, as sorted numbers."""
    if len(data) < SIZE:
        return np.zeros(0, np.int32)
    x = data.astype(np.int32)
    seen = np.zeros(1 << 24, bool) if len(data) > 1 << 20 else None
    every = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    if seen is None:
        return np.unique(every)
    seen[every] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, seven bits a byte, the high bit for more."""
    out = bytearray()
    for d in np.diff(values, prepend=0).tolist():
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = (np.arange(len(raw)) - np.repeat(first, last - first + 1)) * 7
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << shift, first))


def built(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """Rows of INDEX for files (key a whole number from 0, content text or bytes), sorted by string."""
    given = files.select(F.col(key).cast("long").alias("k"), F.col(content).cast("binary").alias("c")).where("k IS NOT NULL AND c IS NOT NULL")

    def shard(held: list[tuple[int, np.ndarray]], name: int) -> Iterator[pa.RecordBatch]:
        gram = np.concatenate([g for _, g in held])
        ids = np.repeat(np.array([k for k, _ in held], np.int64), [len(g) for _, g in held])
        order = np.lexsort((ids, gram))
        gram, ids = gram[order], ids[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1])
        gram, ids = gram[new], ids[new]
        one, first = np.unique(gram, return_index=True)
        ends = np.append(first[1:], len(ids))
        for a in range(0, len(one), 1 << 14):
            lists = [packed(ids[x:y]) for x, y in zip(first[a : a + (1 << 14)], ends[a : a + (1 << 14)], strict=True)]
            n = len(lists)
            yield pa.RecordBatch.from_arrays([pa.array(one[a : a + n], pa.int32()), pa.array(np.full(n, name)), pa.array((ends - first)[a : a + n].astype(np.int32)), pa.array(lists, pa.binary())], ["gram", "shard", "files", "ids"])

    def run(batches):
        from pyspark import TaskContext

        name, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for k, c in zip(batch.column("k").to_pylist(), batch.column("c"), strict=True):
                own = grams(np.frombuffer(c.as_buffer(), np.uint8)) if c.as_buffer() is not None else np.zeros(0, np.int32)
                held.append((k, own))
                size += len(own)
                if size >= SHARD:
                    yield from shard(held, name)
                    name, held, size = name + 1, [], 0
        if size:
            yield from shard(held, name)

    return given.mapInArrow(run, INDEX).repartitionByRange("gram", "shard").sortWithinPartitions("gram", "shard")


def wanted(literals: list[list[str]]) -> list[list[int]] | None:
    """The strings of each alternative; None if one of them has none."""
    out = [sorted({int(g) for x in needles for g in grams(np.frombuffer(x.encode(), np.uint8))}) for needles in literals]
    return out if out and all(out) else None


def candidates(index: DataFrame, literals: list[list[str]], key: str = "file_id") -> DataFrame | None:
    """The files that may hold all literals of an alternative; None if every file may."""
    asked = wanted(literals)
    if asked is None:
        return None
    rows = index.where(F.col("gram").isin(sorted({g for x in asked for g in x})))

    def meet(shard: pa.Table) -> pa.Table:
        lists = {g: unpacked(x.as_py()) for g, x in zip(shard.column("gram").to_pylist(), shard.column("ids"), strict=True)}
        found = []
        for own in asked:
            if all(g in lists for g in own):
                some = sorted((lists[g] for g in own), key=len)
                left = some[0]
                for x in some[1:]:
                    left = left[np.isin(left, x, assume_unique=True)]
                found.append(left)
        ids = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.table({key: pa.array(ids, pa.int64())})

    return rows.groupBy("shard").applyInArrow(meet, f"`{key}` long").distinct()  # a shard has one row for each string asked for
