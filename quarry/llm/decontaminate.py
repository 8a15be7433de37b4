"""Benchmark decontamination: a prefix-filtered set join on rare shingles.

Every window of an item (8 words; a shorter item is one window) must be wholly
contained in a document, so one of its 3-word shingles is a sufficient prefix: the
rarest among the windows, counted in Spark.  The index is a table of (shingle, its
offset, window).  Documents are read once for their shingles: a Bloom filter over the
prefixes, the only thing that is sent along (at most 32 MB, whatever the benchmark's
size), passes over nearly all others.  What it lets through is joined to the index
with the words around it; the offset gives the only place where the window can lie,
which must be within the text (positional and length bounds), and there the window's
words are compared.  What is found joins the documents by the 128 bits that name their
texts, so copies are compared once they are equal; Spark broadcasts that table where
it's small.

Defined cases: null texts and items have no words; items whose id is null are
left out; rows that repeat an item id are one item; an item without words has no
window; equal documents give equal results; an empty benchmark contaminates
nothing; other columns are carried unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TEXT, U64, class_bounds, groups_of, mask_spans, materialize, mix, pack, pair, span_hashes, unpack

WINDOW, SHINGLE = 8, 3
#: Bits of the filter: so many for each prefix, within these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 18, 1 << 28
#: Bytes of words: digits, a-z (after lower-casing) and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["_k1", "_k2"]


def words_of(text: str | Column) -> Column:
    """An array of words; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def runs(words: Column, n: int) -> Column:
    """Every n neighbouring words, joined; all of them where there are fewer."""
    last = F.greatest(F.size(words) - n + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))


def shingle_names(words: np.ndarray, n: int) -> np.ndarray:
    """Names of every n neighbouring words."""
    out = words
    for k in range(1, n):
        out = pair(out[: max(0, len(words) - k)], words[k:])
    return out


def named(index: DataFrame) -> DataFrame:
    """With the name of each shingle, as the scan of documents makes it."""

    def run(batches):
        for batch in batches:
            names = np.zeros(batch.num_rows, U64)
            for a, _, data, at in groups_of(batch.column("shingle")):
                starts, ends = class_bounds(data, ALNUM)
                words, cut = span_hashes(data, starts, ends), np.searchsorted(starts, at)
                for i in range(len(at) - 1):
                    own = words[cut[i] : cut[i + 1]]
                    names[a + i] = shingle_names(own, len(own))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names.view(np.int64))], [*batch.schema.names, "name"])

    return index.mapInArrow(run, "shingle string, offset int, window string, size int, name long")


def index_of(windows: DataFrame) -> DataFrame:
    """(shingle, offset, window, size, name): each window's rarest shingle."""
    words = windows.select("window").distinct().withColumn("words", F.split("window", " "))
    each = words.select("window", F.size("words").alias("size"), F.posexplode(runs(F.col("words"), SHINGLE)).alias("offset", "shingle"))
    each = materialize(each, "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    least = each.join(often, "shingle").groupBy("window").agg(F.min(F.struct("often", "shingle", "offset", "size")).alias("x"))
    return materialize(named(least.select("x.shingle", "x.offset", "window", "x.size")), "prefixes")


def places(names: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each name."""
    return names & U64(bits - 1), mix(names) & U64(bits - 1)


def bloom(index: DataFrame) -> np.ndarray:
    """The filter's words.  Its bits are united in Spark; the driver gets MOST_BITS / 64 words at most."""
    names = index.select("name").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * names.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate(places(batch.column("name").to_numpy().view(U64), bits))
            word, one = (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(one.view(np.int64))], ["word", "bits"])

    words = names.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U64)
    return out


def met(docs: DataFrame, filled: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """(key, name, first word, words around, words before it there) of the shingles of the texts that pass the filter."""
    bits = 64 * len(filled)

    def passing(names: np.ndarray) -> np.ndarray:
        one, two = places(names, bits)
        some = np.flatnonzero(filled[(one >> U64(6)).astype(np.int64)] >> (one & U64(63)) & U64(1))
        two = two[some]
        return some[(filled[(two >> U64(6)).astype(np.int64)] >> (two & U64(63)) & U64(1)).astype(bool)]

    def run(batches):
        for batch in batches:
            for first_row, _, data, at in groups_of(batch.column("_t")):
                data = LOWER[data]
                starts, ends = class_bounds(data, ALNUM)
                words, cut = span_hashes(data, starts, ends), np.searchsorted(starts, at)
                found = []
                for size in sizes:
                    spot = passing(shingle_names(words, size))
                    doc = np.searchsorted(cut, spot, side="right") - 1
                    inside = spot + size <= cut[doc + 1]
                    found.append((spot[inside], doc[inside], shingle_names(words, size)[spot[inside]]))
                spot, doc, name = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
                lo, hi = np.maximum(spot - window, cut[doc]), np.minimum(spot + window, cut[doc + 1])
                around = [" ".join(data[s:e].tobytes().decode(errors="replace") for s, e in zip(starts[a:b], ends[a:b], strict=True)) for a, b in zip(lo, hi, strict=True)]
                keys = [batch.column(k).to_numpy()[first_row + doc] for k in KEY]
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(name.view(np.int64)), pa.array(spot - cut[doc]), pa.array(around, pa.string()), pa.array((spot - lo).astype(np.int32))], [*KEY, "name", "at", "around", "before"])

    return docs.mapInArrow(run, "_k1 long, _k2 long, name long, at long, around string, before int")


def counted(packed: DataFrame) -> DataFrame:
    """With ``_n``, the number of words of each text."""

    def run(batches):
        for batch in batches:
            n = [np.zeros(0, np.int64)]
            for _, _, data, at in groups_of(batch.column(TEXT)):
                starts, _ = class_bounds(LOWER[data], ALNUM)
                n.append(np.diff(np.searchsorted(starts, at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(n))], [*batch.schema.names, "_n"])

    return packed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema) + ", _n long")


def united(spans: DataFrame) -> DataFrame:
    """Each text's spans as maximal runs."""

    def run(batches):
        for batch in batches:
            out = [[{"start": a, "end": b} for a, b in mask_spans([(x["start"], x["end"]) for x in own])] for own in batch.column("_hit").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*KEY, "_hit"])

    return spans.mapInArrow(run, "_k1 long, _k2 long, _hit array<struct<start:long,end:long>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """``docs`` with ``_n`` (words), ``_hit`` (runs of hit words), ``_items`` (ids, sorted as strings) and ``_bad``."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    windows = materialize(items.select("item", F.explode(runs(F.col("words"), window)).alias("window")).distinct(), "windows")
    index = index_of(windows)
    sizes = sorted(r.size for r in index.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect())
    keys = {"_k1": F.xxhash64(TEXT), "_k2": F.xxhash64(F.lit(7), F.col(TEXT), F.octet_length(TEXT))}
    packed = pack(docs, text)
    found = met(packed.where(F.col(TEXT) != "").select(*(c.alias(n) for n, c in keys.items()), F.col(TEXT).alias("_t")), bloom(index), sizes, window)
    first = F.col("before") - F.col("offset")
    there = F.slice(F.split("around", " "), F.greatest(first, F.lit(0)) + 1, F.col("size"))
    found = found.join(index.drop("shingle"), "name").where((first >= 0) & (F.array_join(there, " ") == F.col("window")))
    hits = materialize(found.select(*KEY, (F.col("at") - F.col("offset")).alias("start"), (F.col("at") - F.col("offset") + F.col("size")).alias("end"), "window").distinct(), "hits")
    spans = united(hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("_hit")))
    own = hits.select(*KEY, "window").distinct().join(windows, "window").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("_items"))
    result = materialize(spans.join(own, KEY), "contaminated")
    out = counted(packed).withColumns(keys).join(result, KEY, "left")
    out = out.withColumns({
        "_hit": F.coalesce("_hit", F.array().cast("array<struct<start:long,end:long>>")), "_items": F.coalesce("_items", F.array().cast("array<string>")),
    })
    return unpack(out.withColumn("_bad", F.size("_items") >= least_items), docs.columns, text, True, ["_n", "_hit", "_items", "_bad"])
