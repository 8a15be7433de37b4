"""What the operators share: scratch tables, Arrow batches as bytes, hashing.

Scratch tables live in the folder named by ``spark.checkpoint.dir``.  They cut
lineage: what a lost executor held is read again from the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SEED = np.random.default_rng(0x5EED)
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=U64) | U64(1)
BASE = int(_SEED.integers(1, 2**63)) * 2 + 1 & (2**64 - 1)
BASE_INV = pow(BASE, -1, 2**64)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)  # scratch goes with the application
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, BATCH_BYTES)  # texts go to Python workers in small batches
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
    spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files that this table replaces
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables, as ``materialize`` gave them, that nothing reads any more: what came of them is written."""
    for df in tables:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


ROW, TEXT = "_row_in", "_text_in"


def pack(df: DataFrame, text: str | None, **more) -> DataFrame:
    """All columns but the text in one struct, by place, so that no name of theirs can clash with one of ours."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    own = [F.col(f"`{text}`").alias(TEXT)] if text else []
    return df.select(F.struct(*rest, F.lit(0).alias("none")).alias(ROW), *own, *(c.alias(n) for n, c in more.items()))


def unpack(out: DataFrame, columns: list[str], text: str | None, keep_text: bool, added: list[str]) -> DataFrame:
    """The given columns again, then ours; one of ours takes the place of a given one of the same name."""
    given = [F.col(TEXT).alias(c) if c == text else F.col(f"{ROW}.c{i}").alias(c) for i, c in enumerate(columns) if c not in added and (c != text or keep_text)]
    return out.select(*given, *added)


def blobs(column: pa.Array) -> Iterator[np.ndarray]:
    """Each value's UTF-8 bytes as uint8, without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from blobs(chunk)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, first = len(column), column.offset
    if not n:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[first : first + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    missing = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(n):
        yield raw[:0] if missing is not None and missing[i] else raw[at[i] : at[i + 1]]


def groups_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first row, end row, bytes, row offsets).

    A row longer than the limit stands alone.  Bytes of neighbouring rows are
    parted by one space, so a row's bytes are ``[at[i], at[i + 1] - 1)``.
    """
    rows: list[np.ndarray] = []
    first = size = row = 0
    gap = np.full(1, 32, np.uint8)

    def packed() -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in rows], out=at[1:])
        return np.concatenate([y for x in rows for y in (x, gap)]), at

    for row, x in enumerate(blobs(column)):  # noqa: B007
        if rows and size + len(x) > limit:
            yield (first, row, *packed())
            rows, first, size = [], row, 0
        rows.append(x)
        size += len(x) + 1
    if rows:
        yield (first, first + len(rows), *packed())


_POW = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]))
        for k, base in enumerate((BASE, BASE_INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _POW[k] = np.cumprod(x)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of an ordered pair of names."""
    x, y = b >> U64(31), a << U64(17)
    x ^= a
    x *= U64(0x9E3779B97F4A7C15)
    y ^= b
    y *= U64(0xD6E8FEB86659FD93)
    x += y
    np.right_shift(x, U64(32), out=y)
    x ^= y
    x *= U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, U64(29), out=y)
    x ^= y
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[s:e] for each pair of bounds, the same wherever it stands."""
    power, inverse = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * power[:-1], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * inverse[starts] + (ends - starts).astype(U64))


def class_bounds(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of bytes whose class (a table of 256 booleans) is true."""
    edge = np.diff(np.concatenate([[0], inside[data].view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sliding(x: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubled windows."""
    done, y = 1, x
    while done * 2 <= width:
        y = of(y[:-done], y[done:])
        done *= 2
    if done < width:
        rest = width - done
        y = of(y[: len(y) - rest], y[rest:])
    return y


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Names of every n neighbouring word hashes."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = pair(out, words[k : len(words) - n + 1 + k])
    return out


def table_of(values: np.ndarray, bits: int = 20) -> np.ndarray:
    """A table of booleans over low bits, to pass over most misses of a lookup."""
    seen = np.zeros(1 << bits, bool)
    seen[(values & U64((1 << bits) - 1)).astype(np.int64)] = True
    return seen


def found_in(values: np.ndarray, known: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Mask of the values in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    if seen is None:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values
    out = seen[(values & U64(len(seen) - 1)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, values[some]), len(known) - 1)
    out[some] = known[at] == values[some]
    return out


#: Bytes of words parted by white space.
WS = np.ones(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, in order."""
    n = end - begin
    if not len(n):
        return np.zeros(0, np.int64)
    return np.arange(int(n.sum())) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def mask_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans united into maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
