"""Near-duplicate detection: banded MinHash, odd sketches, exact confirmation.

Texts with equal shingle sets are one class from the start.  A class has 200
MinHash samples: 40 bands of 5 give candidate buckets, and all samples are folded
into a parity bitmap of 1024 bits (an odd sketch).  The number of ones of two
bitmaps' XOR estimates how many samples differ; a pair whose count is six standard
deviations beyond that of the threshold is left out.  A second parity bitmap, of
2048 bits over all shingles of the set, has at most as many ones in the XOR as the
sets have different shingles: a pair with more ones than the threshold allows is
left out with certainty.  All others are confirmed on their full shingle sets.

No bucket is spelled out into pairs.  Its members are first linked to its smallest
member: each class tries its most similar leader, then the other leaders of
components that it isn't in.  Large buckets with several components then go through
rounds: each takes a few leaders by hash, and each member tries the most similar of
those in other components.  What is left of any bucket with several components is
compared in blocks, each member outside the bucket's largest component with all
members of other components: one pass over the sketches finds the members that have a
candidate at all, a second holds their shingle sets and confirms pairs of blocks in the
task, best candidates first, passing over those that its links already join.  So a pair
of blocks gives fewer links than it has members, and no list of pairs leaves a task.
A pair at the threshold shares no band with probability (1 - 0.8**5)**40 < 2e-7.

Defined cases: null and empty texts have empty sets and are linked with nothing;
copies and repeated rows share a class; an empty table gives an empty result;
rows whose id is null take the component of their class (null if it has no id)
and are kept only if no row of it has an id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, TEXT, U64, WS, class_bounds, groups_of, materialize, mix, pack, pair, span_hashes, unpack, window_hashes
from .components import components

BANDS, ROWS, BITS, SET_BITS, BLOCK = 40, 5, 1024, 2048, 256
#: Shingles of a block, so that long texts make smaller blocks; members of a bucket that goes through rounds first; its
#: leaders in each; rounds at most.
HEAVY, LARGE, LEADERS, ROUNDS = 1 << 20, 1 << 12, 2, 5
_R = np.random.default_rng(20240817)
A = _R.integers(1, 2**63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
B = _R.integers(0, 2**63, BANDS * ROWS, dtype=U64)
LANES, SET_LANES = BITS // 64, SET_BITS // 64


def word_lists(column: pa.Array):
    """For each text, the hashes of its words in order (A-Z as a-z)."""
    for _, _, data, at in groups_of(column):
        data = LOWER[data]
        starts, ends = class_bounds(data, WS)
        words = span_hashes(data, starts, ends)
        cut = np.searchsorted(starts, at)
        for i in range(len(at) - 1):
            yield words[cut[i] : cut[i + 1]]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct names of n words; fewer words are one shingle of their own."""
    if len(words) >= n:
        return np.unique(window_hashes(words, n))
    return mix(window_hashes(words, len(words)) + U64(len(words))) if len(words) else words[:0]


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(len(A), 2**64 - 1, U64)
    for k in range(0, len(s), 512):
        low = np.minimum(low, (A[:, None] * s[None, k : k + 512] + B[:, None]).min(axis=1))
    return low


def banded(low: np.ndarray) -> np.ndarray:
    x = low.reshape(BANDS, ROWS)
    out = mix(np.arange(BANDS).astype(U64) + U64(1))
    for k in range(ROWS):
        out = pair(out, x[:, k])
    return out


def parities(names: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the names that fall on each bit, as 64-bit lanes."""
    odd = np.bincount((names % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U64)


def odd_sketch(low: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The lanes of the samples, then those of the whole set."""
    samples = mix(low + mix(np.arange(len(low)).astype(U64)))
    return np.concatenate([parities(samples, BITS), parities(mix(s), SET_BITS)])


def most_ones(threshold: float) -> int:
    """Ones of an XOR beyond which a pair can be left out."""
    k = BANDS * ROWS
    differ = 2 * k * (1 - threshold + 6 * math.sqrt(threshold * (1 - threshold) / k))
    ones = BITS / 2 * (1 - math.exp(-2 * differ / BITS))
    return int(ones + 4 * math.sqrt(ones))


def described(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Row by row: set size, 128 bits that name the set, band keys and odd sketch."""
    given = docs.columns
    keep = [F.col(c) for c in given if c != text]
    source = docs.select(*keep, F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(7), F.col(text), F.octet_length(text)).alias("_k2"), F.col(text).alias("_t"))

    def run(batches):
        for batch in batches:
            size, s1, s2, bands, sketch = [], [], [], [], []
            for words in word_lists(batch.column("_t")):
                s = shingles(words, n)
                size.append(len(s))
                s1.append(int(np.add.reduce(mix(s ^ U64(0x1234567)))) if len(s) else 0)
                s2.append(int(np.add.reduce(mix(s + U64(0x89ABCDEF1)))) if len(s) else 0)
                low = signature(s) if len(s) else None
                bands.append(banded(low).view(np.int64) if len(s) else None)
                sketch.append(odd_sketch(low, s).view(np.int64) if len(s) else None)
            rest = [batch.column(c) for c in batch.schema.names if c != "_t"]
            made = [pa.array(size, pa.int64()), *(pa.array(np.array(x, U64).view(np.int64)) for x in (s1, s2)), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, sketch))]
            yield pa.RecordBatch.from_arrays(rest + made, [*(c for c in batch.schema.names if c != "_t"), "_n", "_s1", "_s2", "_bands", "_sketch"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_t")
    return source.mapInArrow(run, f"{kept}, _n long, _s1 long, _s2 long, _bands array<long>, _sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(word_lists(batch.column("_ta")), word_lists(batch.column("_tb")), strict=True)):
                x, y = shingles(x, n), shingles(y, n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("_t").alias("_ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("_t").alias("_tb")), "b")
    return materialize(two.select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long"), "links")


def candidates(rows: pa.Table, percent: int, limit: int) -> tuple[np.ndarray, ...]:
    """(left row, right row, ones) of pairs of a group in different components that the sketches let through, in the first
    band they share only.  Rows of the left side are compared with those of the right; pairs that stand on both sides once."""
    column = {c: rows.column(c).to_numpy() for c in ("node", "comp", "_n", "left", "minor", "band")}
    grid = {c: np.concatenate([x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in rows.column(c).chunks]).reshape(rows.num_rows, -1).view(U64) for c in ("_sketch", "_bands")}
    a, b = np.flatnonzero(column["left"]), np.flatnonzero(~column["left"])
    n, comp, node = column["_n"], column["comp"], column["node"]
    fits = comp[a][:, None] != comp[b][None, :]
    fits &= 100 * np.minimum(n[a][:, None], n[b][None, :]) >= percent * np.maximum(n[a][:, None], n[b][None, :])
    fits &= ~column["minor"][b][None, :] | (node[a][:, None] < node[b][None, :])
    x, y = np.nonzero(fits)
    out = [np.zeros((3, 0), np.int64)]
    for k in range(0, len(x), 1 << 14):
        i, j = a[x[k : k + (1 << 14)]], b[y[k : k + (1 << 14)]]
        ones = np.bitwise_count(grid["_sketch"][i] ^ grid["_sketch"][j]).astype(np.int64)
        few, surely = ones[:, :LANES].sum(axis=1), ones[:, LANES:].sum(axis=1)
        ok = (surely * (100 + percent) <= (n[i] + n[j]) * (100 - percent)) & (few <= limit)
        i, j, few = i[ok], j[ok], few[ok]
        ok = (grid["_bands"][i] == grid["_bands"][j]).argmax(axis=1) == column["band"][i]
        out.append(np.stack([i[ok], j[ok], few[ok]]))
    i, j, few = np.concatenate(out, axis=1)
    order = np.argsort(few, kind="stable")
    return i[order], j[order], few[order]


GROUP = ["key", "i", "j"]
PLACED = "key long, i int, j int, left boolean, minor boolean, band int, node long, comp long, _n long, _bands array<long>, _sketch array<long>"


def dealt_out(at: DataFrame, top: DataFrame) -> DataFrame:
    """The members of each bucket in pairs of blocks (key, i, j).  They are dealt out by all three: after the join with
    ``top`` the rows of a bucket lie together, which is enough for a grouping by (key, i, j), so that without an exchange
    of its own every pair of blocks of a large bucket would be compared in one task."""
    at = at.join(top, "key").withColumn("minor", F.col("comp") != F.col("top"))
    spot = F.xxhash64(F.lit(3), "node")
    rest = ["minor", "band", "node", "comp", "_n", "_bands", "_sketch"]
    left = at.where("minor").select("key", F.pmod(spot, "few").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(True).alias("left"), *rest)
    right = at.select("key", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.pmod(spot, "all").cast("int").alias("j"), F.lit(False).alias("left"), *rest)
    return left.unionByName(right).repartition(*GROUP)


def settled(at: DataFrame, texts: DataFrame, n: int, percent: int, limit: int) -> DataFrame:
    """Links (a, b) that join all components of each bucket whose members are similar.  at: (band, key, node, comp, _n, _bands,
    _sketch) of buckets with several components."""
    top = at.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("_n").alias("w")).groupBy("key")
    top = top.agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max("m").alias("tm"), F.max_by("w", F.struct("m", "comp")).alias("tw"))
    parts = lambda m, w: F.greatest(F.lit(1), F.ceil(F.col(m) / BLOCK), F.ceil(F.col(w) / HEAVY)).cast("int")
    top = materialize(top.withColumns({"m1": F.col("m") - F.col("tm"), "w1": F.col("w") - F.col("tw")}).select("key", "top", parts("m", "w").alias("all"), parts("m1", "w1").alias("few")), "tops")
    both = dealt_out(at, top)

    def some(group: pa.Table) -> pa.Table:
        i, j, _ = candidates(group, percent, limit)
        return group.take(pa.array(np.unique(np.concatenate([i, j]))))

    some_left = materialize(both.groupBy(*GROUP).applyInArrow(some, PLACED), "candidates")

    def joined(group: pa.Table) -> pa.Table:
        i, j, _ = candidates(group, percent, limit)
        node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
        sets = [shingles(words, n) for chunk in group.column("_t").chunks for words in word_lists(chunk)]
        up = {int(c): int(c) for c in comp}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        links = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            one, two = root(int(comp[x])), root(int(comp[y]))
            if one != two and 100 * (both := len(np.intersect1d(sets[x], sets[y], assume_unique=True))) >= percent * (len(sets[x]) + len(sets[y]) - both):
                up[one] = two
                links.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return materialize(some_left.join(texts, "node").groupBy(*GROUP).applyInArrow(joined, "a long, b long"), "links")


def with_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    out = placed(docs, text, doc_id, n, percent)
    comp = F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("_least.doc"))
    return out.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("_id") == comp, comp.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest id, and of rows that share it one.
    Rows with an empty set all stay.  Equal rows are folded before the shuffle."""
    found = placed(docs, text, doc_id, n, percent)
    chosen = found.where("_n = 0 OR (_id <=> _least.doc AND _s1 = _least._s1 AND _s2 = _least._s2)")
    # written before it's grouped, so that a hot class can be split in the join above and few rows are left
    chosen = materialize(chosen.select("_id", "_s1", "_s2", "_k1", "_k2"), "chosen")
    chosen = materialize(chosen.groupBy("_id", "_s1", "_s2").agg(F.min(F.struct("_k1", "_k2")).alias("k")).select(F.col("_id").alias("_i"), F.col("k._k1").alias("_a"), F.col("k._k2").alias("_b")).distinct(), "chosen")
    own = pack(docs, text, _id=F.col(doc_id), _k1=F.xxhash64(text), _k2=F.xxhash64(F.lit(7), F.col(text), F.octet_length(text)))
    one = own.groupBy("_id", "_k1", "_k2").agg(F.first(ROW).alias(ROW), F.first(TEXT).alias(TEXT))
    one = one.join(chosen, one["_id"].eqNullSafe(F.col("_i")) & (F.col("_k1") == F.col("_a")) & (F.col("_k2") == F.col("_b")), "left_semi")
    return unpack(one, docs.columns, text, True, [])


def placed(docs: DataFrame, text: str, doc_id: str, n: int, percent: int) -> DataFrame:
    """Row by row: id, text key, set size, set names and ``_least``, the component's smallest id and its set."""
    docs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = materialize(described(docs, "_text", n), "sets")
    classes = rows.where("_n > 0").groupBy("_s1", "_s2").agg(*(F.first(c).alias(c) for c in ("_k1", "_k2", "_n", "_bands", "_sketch")), F.min("_id").alias("_doc"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    in_bands = classes.select(F.posexplode("_bands").alias("band", "key"), "node")
    buckets = materialize(in_bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lead")).where("size > 1"), "buckets")
    members = materialize(in_bands.join(buckets, "key").select("band", "key", "node", "size", "lead"), "members")
    sketch = classes.select("node", "_n", *(F.get("_sketch", F.lit(i)).alias(f"_x{i}") for i in range(LANES + SET_LANES)))
    wanted = members.select("node").distinct().join(classes.select("node", "_k1", "_k2"), "node")
    texts = docs.select(F.xxhash64("_text").alias("_k1"), F.xxhash64(F.lit(7), F.col("_text"), F.octet_length("_text")).alias("_k2"), F.col("_text").alias("_t"))
    texts = materialize(texts.join(wanted, ["_k1", "_k2"]).groupBy("node").agg(F.first("_t").alias("_t")), "texts")

    limit = most_ones(percent / 100)

    def side(x: str) -> DataFrame:
        return sketch.select(*(F.col(c).alias(f"{x}{c}") for c in sketch.columns))

    def ones(first: int, end: int) -> F.Column:
        lanes = [F.bit_count(F.col(f"a_x{i}").bitwiseXOR(F.col(f"b_x{i}"))) for i in range(first, end)]
        return sum(lanes[1:], lanes[0])

    def alike() -> F.Column:
        surely = ones(LANES, LANES + SET_LANES) * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
        return surely & (ones(0, LANES) <= limit)

    near_size = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    stars = members.where("node <> lead").select(F.col("node").alias("anode"), F.col("lead").alias("bnode")).distinct()
    stars = stars.join(side("a"), "anode").join(side("b"), "bnode").where(near_size & alike()).select(F.col("anode").alias("a"), F.col("bnode").alias("b"), ones(0, LANES).alias("ones"))
    stars = materialize(stars, "stars")
    first = stars.groupBy("a").agg(F.min_by("b", F.struct("ones", "b")).alias("b"))
    links = confirmed(first, texts, n, percent)
    label = components(links)

    def other(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs between different components."""
        la, lb = (label.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        return pairs.join(la, "a", "left").join(lb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    more = confirmed(other(stars, label).join(first, ["a", "b"], "left_anti"), texts, n, percent)
    links = links.unionByName(more)
    label = components(links)

    def mixed(some: DataFrame, label: DataFrame) -> DataFrame:
        """Members of the buckets that have several components, with these."""
        at = materialize(some.join(label, "node", "left").select("band", "key", "node", F.coalesce("comp", "node").alias("comp")), "members")
        return at.join(at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "key")

    large = members.where(F.col("size") > LARGE)
    for k in range(0 if buckets.where(F.col("size") > LARGE).isEmpty() else ROUNDS):
        at = materialize(mixed(large, label).select("key", "node", "comp"), "large")
        lead = at.groupBy("key", F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(LEADERS)).alias("slice")).agg(F.min_by(F.struct("node", "comp"), F.xxhash64(F.lit(-1 - k), "node")).alias("lead"))
        tried = at.join(lead, "key").where("comp <> lead.comp").select(F.col("node").alias("anode"), F.col("lead.node").alias("bnode")).distinct()
        tried = tried.join(side("a"), "anode").join(side("b"), "bnode").where(near_size & alike())
        tried = tried.groupBy(F.col("anode").alias("a")).agg(F.min_by(F.col("bnode"), F.struct(ones(0, LANES), "bnode")).alias("b"))
        new = confirmed(tried, texts, n, percent)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        label = components(links)

    left = materialize(mixed(members.where("size > 2"), label).join(classes.select("node", "_n", "_bands", "_sketch"), "node"), "blocks")
    label = components(links.unionByName(settled(left, texts, n, percent, limit)))

    named = classes.join(label, "node", "left").select("_s1", "_s2", "_doc", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min(F.struct(F.col("_doc").isNull().alias("none"), F.col("_doc").alias("doc"), "_s1", "_s2")).alias("_least"))
    named = materialize(named.join(least, "comp").select("_s1", "_s2", "_least"), "components")
    return rows.select("_id", "_k1", "_k2", "_n", "_s1", "_s2").join(named, ["_s1", "_s2"], "left")
