"""Removal of long byte strings that occur more than once (suffix-array dedup).

Prefix doubling names every string of 50, 100, 200 and 400 bytes by the pair of
names of its halves, from rolling names of 25 bytes on.  A document's bytes lie in one row, so a doubling is local; Spark
then groups the names to find those that stand at one position only, and their
positions leave.  A full suffix array would move some 16 bytes for every byte of
text at every doubling.  Here the early rounds send one name for each run of
windows that share their smallest name (a minimizer): equal windows have equal
smallest names, so a window whose smallest name is unique is itself unique.

1. Rounds of growing length (100, 200) drop the windows that are unique.
2. What is left is cut into chunks of windows with the same smallest name of 352
   bytes.  A chunk whose whole context occurs twice is repeated throughout.
3. Other chunks, and one chunk of each repeated context with the same smallest
   name, are compared window by window at the full length.

Names are fingerprints instead of sorted ranks: the same classes without a total
order.  Names that decide (steps 2 and 3) have 128 bits.

The symbols of a string are bytes or, with ``unit`` "word", whole words (runs of
anything but ASCII white space); then ``length`` counts words, and a removed run goes
from its first word's first byte to its last word's last.  With ``across``, only
strings that stand in two rows at least are repeated.

Defined cases: a null or empty text, and a text shorter than ``length``, loses
nothing; equal rows are copies and lose everything if they are long enough; a
window that occurs twice within one text counts as repeated (not with ``across``);
overlapping occurrences count; an empty table gives an empty result; columns other
than the text are carried unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, TEXT, U64, WS, class_bounds, discard, found_in, groups_of, materialize, mix, pack, pair, powers, ranges, sliding, span_hashes, unpack

LENGTH = 400
#: Of a passage, in words.
PASSAGE = 50
#: Names, and bytes of kept text, that are given to Spark at once.
FLUSH, FLUSH_BYTES = 1 << 17, 4 << 20
#: Of 400ths of the length, the names of each round.
ROUNDS = (100, 200)
#: Bytes of neighbouring texts that are named together: what this takes stays in a core's cache.
NEAR = {"byte": 1 << 14, "word": 1 << 16}
#: Symbols of the first names.
FIRST = 25
#: Windows that are looked at together, for bounded memory with very long texts.
TILE = 1 << 20
#: Bits that hold a place within a tile.
PLACES = U64((1 << 21) - 1)
CODES = (BYTE_CODE, mix(BYTE_CODE ^ U64(0xA5A5A5A5A5A5A5A5)))
KEY = ["_k1", "_k2"]


def coded(data: np.ndarray, lane: int) -> np.ndarray:
    """64 bits for each byte or word."""
    return CODES[lane][data] if data.dtype == np.uint8 else mix(data ^ U64(0xA5A5A5A5A5A5A5A5)) if lane else data


def names(data: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The name of every ``length`` symbols: rolling names of 25 (or fewer), then pairs of names at growing offsets."""
    if len(data) < length:
        return np.zeros(0, U64)
    done = min(length, FIRST)
    power, inverse = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, U64)
    np.cumsum(coded(data, lane) * power[:-1], out=pre[1:])
    x = pre[done:] - pre[:-done]
    x *= inverse[: len(x)]
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    while 2 * done <= length:
        x, done = pair(x[:-done], x[done:]), 2 * done
    return longer(x, done, length)


def anchors(x: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbouring names, where the smallest stands (by its high bits; the leftmost of equals).
    Equal windows have it at the same place, and the places never go back."""
    y = x & ~PLACES
    y |= np.arange(len(x), dtype=U64)
    y = sliding(y, width)
    y &= PLACES
    return y.view(np.int64)


def heads(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def longer(x: np.ndarray, done: int, length: int) -> np.ndarray:
    """Names of ``length`` bytes from names of at least half as many."""
    return x if done == length else pair(x[: len(x) - (length - done)], x[length - done :])


class Text:
    """One text or neighbouring ones of a batch, as bytes or names of words, one after the other; ``runs`` holds starts and ends, in turn, of
    the windows that are not yet known to be unique.  No window lies in two texts."""

    def __init__(self, data: np.ndarray, length: int, begin: np.ndarray | None = None, end: np.ndarray | None = None, row: int = 0, raw: Iterable[np.ndarray] = ()):
        self.data, self.length, self.row, self.raw = data, length, row, raw
        self.begin, self.end = (np.array([0]), np.array([len(data)])) if begin is None else (begin, end)
        long = self.end - self.begin >= length
        self.runs = np.stack([self.begin[long], self.end[long] - length + 1], 1).ravel()

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which of the texts the places lie in."""
        return np.searchsorted(self.begin, at, side="right") - 1

    def of_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, value) of the arrays that the texts' rows have in a column."""
        some = column.slice(self.row, len(self.begin))
        return pc.list_parent_indices(some).to_numpy(), pc.list_flatten(some).to_numpy()

    def known(self, column: pa.Array) -> np.ndarray:
        """The names in a column, each with its text, sorted."""
        text, name = self.of_rows(column)
        return np.sort(pair(name.view(U64), text.astype(U64)))

    def among(self, at: np.ndarray, name: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Mask of the names, at the given places, that are known of their text."""
        return found_in(pair(name, self.text_of(at).astype(U64)), known)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first window, symbols, mask of the windows that are left): near runs together, TILE windows at most."""
        if not len(self.runs):
            return
        if len(self.runs) == 2 and self.runs[1] - self.runs[0] <= TILE:  # one text alone
            at, stop = int(self.runs[0]), int(self.runs[1])
            yield at, self.data[at : stop + self.length - 1], np.ones(stop - at, bool)
            return
        starts, ends = self.runs[::2], self.runs[1::2]
        cut = np.flatnonzero(starts[1:] > ends[:-1] + self.length) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]), strict=True):
            for at in range(int(starts[a]), int(ends[b - 1]), TILE):
                stop = min(at + TILE, int(ends[b - 1]))
                left = np.zeros(stop - at, bool)
                if b - a < 64:
                    for lo, hi in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True):
                        left[max(lo - at, 0) : max(hi - at, 0)] = True
                else:
                    left[ranges(np.clip(starts[a:b], at, stop) - at, np.clip(ends[a:b], at, stop) - at)] = True
                if left.any():
                    yield at, self.data[at : stop + self.length - 1], left

    def sampled(self, size: int) -> tuple[np.ndarray, ...]:
        """Smallest names of ``size`` symbols of the windows left, at how many positions of one text each stands, and the text."""
        found = [(np.zeros(0, np.int64), np.zeros(0, U64))]
        for at, part, left in self.parts():
            x = names(part, size)
            where = anchors(x, self.length - size + 1)
            head = heads(where)
            where = where[head[np.logical_or.reduceat(left, head)]]
            found.append((self.text_of(at + where), x[where]))
        # a position may lie in two parts: counting it twice only keeps a window longer
        text, name = (np.concatenate([f[j] for f in found]) for j in range(2))
        first, n = counted(text, name)
        return name[first], n, text[first]

    def kept(self, size: int, known: np.ndarray) -> pa.Array:
        """By text, the runs of the windows whose smallest name is known to be repeated."""
        out = [np.zeros(0, np.int64)]
        for at, part, left in self.parts():
            x = names(part, size)
            where = anchors(x, self.length - size + 1)
            head = heads(where)
            left = left & np.repeat(self.among(at + where[head], x[where[head]], known), np.diff(np.concatenate([head, [len(where)]])))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], left.view(np.int8), [0]])))
            out.append(edge + at)
        runs = np.concatenate(out)
        text = self.text_of(runs[::2])
        n = np.bincount(text, minlength=len(self.begin))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * n)]), pa.int32()), pa.array(runs - np.repeat(self.begin[text], 2), pa.int64()))

    def chunks(self, size: int, lanes: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
        """By tile: first and last window and smallest name of each chunk, its context names, and all windows' names."""
        half = (self.length + 1) // 2
        for at, part, left in self.parts():
            own = [names(part, half, lane) for lane in range(lanes)]
            x = longer(own[0], half, size)
            where = anchors(x, self.length - size + 1)
            cut = np.ones(len(where), bool)
            cut[1:] = (where[1:] != where[:-1]) | ~left[:-1]
            begin = np.flatnonzero(cut & left)
            stop = np.ones(len(where), bool)
            stop[:-1] = cut[1:] | ~left[1:]
            last = np.flatnonzero(stop & left)
            full = [longer(w, half, self.length) for w in own]
            size_name = mix((last - begin).astype(U64) + U64(1))
            yield at, begin, last, x[where[begin]], [pair(pair(w[begin], w[last]), size_name) for w in full], full


def texts_of(batch: pa.RecordBatch, unit: str, length: int) -> Iterator[Text]:
    """The texts of a batch, those that are near together, with the runs that they have; all windows before the first round."""
    for row, stop, data, at in groups_of(batch.column("_t"), NEAR[unit]):
        raw, begin, end = data, at[:-1], at[1:] - 1
        if unit == "word":
            starts, ends = class_bounds(data, WS)
            data, cut = span_hashes(data, starts, ends), np.searchsorted(starts, at)
            begin, end = cut[:-1], cut[1:]
        own = Text(data, length, begin, end, row, [raw[a : b - 1] for a, b in zip(at[:-1], at[1:], strict=True)])
        if "_runs" in batch.schema.names:
            text, value = own.of_rows(batch.column("_runs"))
            own.runs = value + begin[text]
        yield own


def counted(text: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair of text and name stands first, by text, and how often."""
    order = np.lexsort((name, text))
    new = np.ones(len(order), bool)
    new[1:] = (name[order[1:]] != name[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.concatenate([at, [len(order)]]))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def flats(batch: pa.RecordBatch, keys: list[str], found: Iterator[tuple[np.ndarray, ...]], labels: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the batch, by number, and what each is given: as batches of about ``FLUSH`` rows, each row with its keys, so that
    many windows in many texts need no more memory."""

    def flat() -> pa.RecordBatch:
        row, *given = (np.concatenate([x[j] for x in held]) for j in range(len(labels) + 1))
        columns = [pa.array(batch.column(k).to_numpy(zero_copy_only=False)[row]) for k in keys]
        return pa.RecordBatch.from_arrays(columns + [as_long(x if x.dtype == U64 else x.astype(np.int64)) for x in given], keys + labels)

    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[0])
        if size >= FLUSH:
            yield flat()
            held, size = [], 0
    if size:
        yield flat()


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """128 bits that name the text, so that equal texts are one."""
    return docs.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(7), F.col(text), F.octet_length(text))})


def survivors(rows: DataFrame, name: list[str], keys: list[str], give: str, label: str, across: bool) -> DataFrame:
    """For each text, the names that stand at two positions or more (with ``across``, in two texts).  A hot name is
    counted before the shuffle; the join's two sides are plain exchanges, so that Spark may split a hot name there."""
    k = keys[0]
    twice = materialize(
        rows.groupBy(*name).agg(F.min(k).alias("a"), F.max(k).alias("b"), F.max("_n").alias("n"))
        .where((F.col("a") != F.col("b")) | (F.lit(not across) & (F.col("n") > 1))).select(*name), "repeated",
    )
    return rows.join(twice, name).groupBy(*keys).agg(F.collect_set(give).alias(label))


def refine(texts: DataFrame, size: int, length: int, unit: str) -> DataFrame:
    """Rows (name, key, positions) of one round."""

    def emit(batches):
        for batch in batches:
            found = ((own, own.sampled(size)) for own in texts_of(batch, unit, length))
            yield from flats(batch, KEY, ((own.row + text, name, n) for own, (name, n, text) in found), ["_name", "_n"])

    return materialize(texts.mapInArrow(emit, "_k1 long, _k2 long, _name long, _n long"), "names")


def narrowed(texts: DataFrame, size: int, length: int, unit: str) -> DataFrame:
    """The texts, with the runs of windows that outlast the round."""

    def run(batches):
        for batch in batches:
            runs = [own.kept(size, own.known(batch.column("_known"))) for own in texts_of(batch, unit, length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEY, "_t")), pa.concat_arrays(runs) if runs else pa.array([], pa.list_(pa.int64()))], [*KEY, "_t", "_runs"])

    return texts.mapInArrow(run, "_k1 long, _k2 long, _t string, _runs array<long>").where(F.size("_runs") > 0)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, unit: str = "byte", across: bool = False) -> DataFrame:
    """For each distinct text that shares a string of ``length`` symbols with another text or with itself:
    its key, the removed runs (array of start and end byte), the words in them (0 for bytes), the bytes kept and their SHA-256."""
    if length < 4:
        raise ValueError("length must be 4 or more")
    rounds, chunk = [length * share // 400 or 1 for share in ROUNDS], max((length + 1) // 2, length * 352 // 400)
    all_texts = keyed(docs.select(F.col(text).alias("_t")), "_t").where(F.octet_length("_t") >= least_bytes(length, unit))
    texts = all_texts
    sizes = list(dict.fromkeys(rounds))
    for k, size in enumerate(sizes):
        seen = refine(texts, size, length, unit)
        hits = survivors(seen, ["_name"], KEY, "_name", "_known", across)
        # copies become one text before they are shuffled
        one = texts if k else texts.groupBy(*KEY).agg(F.first("_t").alias("_t"))
        left = narrowed(one.join(hits, KEY), size, length, unit)
        new = materialize(left.withColumn("_u", F.monotonically_increasing_id()) if size == sizes[-1] else left, "texts")
        discard(seen, *[texts] * (k > 0))
        texts = new

    def contexts(batches):
        def rows(batch):
            for own in texts_of(batch, unit, length):
                found = [(own.text_of(at + begin), cls, c1, c2) for at, begin, _, cls, (c1, c2), _ in own.chunks(chunk)]
                if found:
                    text, cls, c1, c2 = (np.concatenate([f[j] for f in found]) for j in range(4))
                    first, n = counted(text, c1)
                    yield own.row + text[first], cls[first], c1[first], c2[first], n

        for batch in batches:
            yield from flats(batch, ["_u"], rows(batch), ["_class", "_c1", "_c2", "_n"])

    parts = materialize(texts.mapInArrow(contexts, "_u long, _class long, _c1 long, _c2 long, _n long"), "chunks")
    each = parts.groupBy("_class", "_c1", "_c2").agg(F.sum("_n").alias("_n"), F.min("_u").alias("_u"), F.max("_u").alias("_v"))
    each = materialize(each.withColumn("_again", (F.col("_u") != F.col("_v")) | (F.lit(not across) & (F.col("_n") > 1))), "contexts")
    whole = each.where("_again").select("_class", "_c1", "_c2")
    done = parts.join(whole, ["_class", "_c1", "_c2"]).groupBy("_u").agg(F.collect_set("_c1").alias("_whole"))
    unclear = materialize(
        each.groupBy("_class").agg(F.count("*").alias("m"), F.count_if(~F.col("_again")).alias("alone")).where("m > 1 AND alone > 0").select("_class"), "classes",
    )
    # of a repeated context, two texts show that its windows stand in two
    shown = F.array_distinct(F.array("_u", "_v")) if across else F.array("_u")
    look = each.join(unclear, "_class").select(F.explode(shown).alias("_u"), "_c1").groupBy("_u").agg(F.collect_set("_c1").alias("_look"))

    def windows(batches):
        def rows(batch):
            for own in texts_of(batch, unit, length):
                wanted, found = own.known(batch.column("_look")), []
                for at, begin, last, _, (c1, _), (w1, w2) in own.chunks(chunk):
                    some = own.among(at + begin, c1, wanted)
                    place = ranges(begin[some], last[some] + 1)
                    found.append((own.text_of(at + place), w1[place], w2[place]))
                if found:
                    text, w1, w2 = (np.concatenate([f[j] for f in found]) for j in range(3))
                    first, n = counted(text, w1)
                    yield own.row + text[first], w1[first], w2[first], n

        for batch in batches:
            yield from flats(batch, ["_u"], rows(batch), ["_w1", "_w2", "_n"])

    single = materialize(texts.join(look, "_u").mapInArrow(windows, "_u long, _w1 long, _w2 long, _n long"), "windows")
    exact = survivors(single, ["_w1", "_w2"], ["_u"], "_w1", "_exact", across)

    def cut(batches):
        def given(batch, first, out):
            some = batch.slice(first, len(out))
            return pa.RecordBatch.from_arrays(
                [some.column("_k1"), some.column("_k2"), pa.array([x[0] for x in out], SPANS), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.int64())],
                ["_k1", "_k2", "_spans", "_kept", "_sha", "_words"],
            )

        for batch in batches:
            out, first, size = [], 0, 0
            for own in texts_of(batch, unit, length):
                whole_, exact_ = own.known(batch.column("_whole")), own.known(batch.column("_exact"))
                gone = np.zeros(len(own.data) + 1, np.int32)
                for at, begin, last, _, (c1,), (w1,) in own.chunks(chunk, lanes=1):
                    some = own.among(at + begin, c1, whole_)
                    rest = ranges(begin[~some], last[~some] + 1)
                    rest = rest[own.among(at + rest, w1[rest], exact_)]
                    np.add.at(gone, at + begin[some], 1)
                    np.add.at(gone, at + last[some] + length, -1)
                    np.add.at(gone, at + rest, 1)
                    np.add.at(gone, at + rest + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out += [cut_one(raw, gone[a:b], unit) for raw, a, b in zip(own.raw, own.begin, own.end, strict=True)]
                size += len(gone) if unit == "byte" else sum(map(len, own.raw))
                if size >= FLUSH_BYTES:
                    yield given(batch, first, out)
                    first, out, size = first + len(out), [], 0
            if out:
                yield given(batch, first, out)

    found = texts.join(done.join(exact, "_u", "full"), "_u")
    result = found.mapInArrow(cut, "_k1 long, _k2 long, _spans array<struct<start:long,end:long>>, _kept binary, _sha string, _words long")
    result = materialize(result.where(F.size("_spans") > 0), "spans")
    discard(texts, parts, each, unclear, single)
    return result


def shared_words(docs: DataFrame, text: str, length: int = PASSAGE) -> DataFrame:
    """(key, _w, _p): of each distinct text of ``length`` words or more, its words, and how many of them lie in strings of
    ``length`` words that stand in another text too.

    For counting alone, the texts are read twice instead of once a round, and aren't sorted: the first reading gives all
    chunks of windows with the same smallest name of half the length, with their contexts; a context that two texts hold is
    counted from its place.  The second reading is of the texts with chunks whose name two texts hold in other contexts, and
    gives the windows of these chunks."""
    half = (length + 1) // 2
    given = keyed(docs.select(F.col(text).alias("_t")), "_t").where(F.octet_length("_t") >= least_bytes(length, "word"))

    def first(batches):
        def rows(batch):
            for own in texts_of(batch, "word", length):
                # the first row of a text is its size
                n = len(own.begin)
                yield own.row + np.arange(n), np.zeros(n, U64), np.zeros(n, U64), np.full(n, -1), own.end - own.begin
                for at, begin, last, cls, ctx, _ in own.chunks(half, 1):
                    text = own.text_of(at + begin)
                    yield own.row + text, cls, ctx[0], at + begin - own.begin[text], last - begin + 1

        for batch in batches:
            yield from flats(batch, KEY, rows(batch), ["_class", "_c1", "_a", "_m"])

    small = {c: F.col(c).cast("int") for c in ("_a", "_m")}
    every = materialize(given.mapInArrow(first, "_k1 long, _k2 long, _class long, _c1 long, _a long, _m long").withColumns(small), "chunks")
    parts = every.where("_a >= 0")
    each = parts.groupBy("_class", "_c1").agg(F.min("_k1").alias("_x"), F.max("_k1").alias("_y"))
    each = materialize(each.withColumn("_again", F.col("_x") != F.col("_y")), "contexts")
    mixed = each.groupBy("_class").agg(F.count_if(~F.col("_again")).alias("alone"), F.min("_x").alias("x"), F.max("_y").alias("y"), F.count("*").alias("m"))
    mixed = mixed.where("m > 1 AND alone > 0 AND x <> y").select("_class", F.lit(True).alias("_mixed"))
    state = each.join(mixed, "_class", "left").where("_again OR _mixed")
    hit = parts.join(state.withColumn("_mixed", F.coalesce("_mixed", F.lit(False))), ["_class", "_c1"]).select(*KEY, "_a", "_m", "_x", "_y", "_again", "_mixed")
    hit = materialize(hit, "hits")
    sizes = materialize(every.where((F.col("_a") < 0) & (F.col("_m") >= length)).groupBy(*KEY).agg(F.max("_m").cast("long").alias("_w")), "sizes")
    discard(every, each)
    look = hit.where(F.col("_mixed") & (~F.col("_again") | F.col("_k1").isin(F.col("_x"), F.col("_y")))).groupBy(*KEY).agg(F.collect_set("_a").alias("_look"))

    def second(batches):
        def rows(batch):
            for own in texts_of(batch, "word", length):
                text, place = own.of_rows(batch.column("_look"))
                wanted = np.sort(own.begin[text] + place)
                for at, begin, last, _, _, (w1, w2) in own.chunks(half):
                    some = np.isin(at + begin, wanted)
                    place = ranges(begin[some], last[some] + 1)
                    text = own.text_of(at + place)
                    yield own.row + text, w1[place], w2[place], at + place - own.begin[text]

        for batch in batches:
            yield from flats(batch, KEY, rows(batch), ["_w1", "_w2", "_a"])

    single = materialize(given.join(look, KEY).mapInArrow(second, "_k1 long, _k2 long, _w1 long, _w2 long, _a long").withColumn("_a", small["_a"]), "windows")
    twice = single.groupBy("_w1", "_w2").agg(F.min("_k1").alias("x"), F.max("_k1").alias("y")).where("x <> y").select("_w1", "_w2")
    exact = single.join(twice, ["_w1", "_w2"]).select(*KEY, "_a", (F.col("_a") + length).alias("_e"))
    runs = hit.where("_again").select(*KEY, "_a", (F.col("_a") + F.col("_m") + (length - 1)).alias("_e")).unionByName(exact)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("_a", "_e"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc.end, x["_e"]).alias("end"), (acc.n + F.greatest(F.lit(0), x["_e"] - F.greatest(acc.end, x["_a"]))).alias("n")),
    )
    out = materialize(sizes.join(runs.groupBy(*KEY).agg(covered["n"].cast("long").alias("_p")), KEY, "left"), "shared")
    discard(hit, single, sizes)
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def least_bytes(length: int, unit: str) -> int:
    """Of a text that holds so many symbols."""
    return length if unit == "byte" else 2 * length - 1


def cut_one(data: np.ndarray, gone: np.ndarray, unit: str) -> tuple[list[dict], bytes, str, int]:
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = 0
    if unit == "word":
        words = int((end - begin).sum())
        starts, ends = class_bounds(data, WS)
        begin, end = starts[begin], ends[end - 1]
        gone = np.zeros(len(data), bool)
        gone[ranges(begin, end)] = True
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)]
    kept = data[~gone].tobytes()
    return spans, kept, hashlib.sha256(kept).hexdigest(), words


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH, keep_text: bool = True, unit: str = "byte", across: bool = False, passages: bool = False) -> DataFrame:
    """``docs`` with _n_bytes, _n_removed, _n_spans, _sha and, if asked for, _kept (binary) and _n_shared: how many words of
    the input lie in strings of ``PASSAGE`` words that stand in another row too, whatever is removed.

    A text of which there are copies is removed as a whole (with words, from its first to its last).  The rows of
    ``docs`` are joined to the distinct texts through plain exchanges on both sides, so that a hot text can be split."""
    packed = pack(docs, text)
    spans = repeated_spans(packed, TEXT, length, unit, across)
    least = min(least_bytes(length, unit), least_bytes(PASSAGE, "word")) if passages else least_bytes(length, unit)
    copies = keyed(packed.where(F.octet_length(TEXT) >= least).select(TEXT, F.octet_length(TEXT).alias("_l")), TEXT).groupBy(*KEY).agg(F.count("*").alias("n"), F.first("_l").alias("_l"))
    copies = materialize(copies.where("n > 1").select(*KEY, (F.col("_l") >= least_bytes(length, unit)).alias("_all"), F.lit(True).alias("_twice")), "copies")
    cut = spans.select(*KEY, F.size("_spans").cast("long").alias("_s"), F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start).alias("_r"), F.col("_sha").alias("_h"), *([F.col("_kept").alias("_b")] if keep_text else []))
    change = copies.join(cut, KEY, "full")
    if passages:
        change = change.join(shared_words(packed, TEXT), KEY, "full")
    change = materialize(change, "changes")
    size = F.coalesce(F.octet_length(TEXT), F.lit(0)).cast("long")
    full = F.coalesce("_all", F.lit(False))
    left, gone = F.lit(""), F.col("_n_bytes")
    if unit == "word":
        full = full & (F.regexp_count(TEXT, F.lit(WORD)) >= length)
        left = F.regexp_replace(TEXT, rf"(?s)^({SPACE}*).*[^\x20\x09-\x0D]({SPACE}*)$", "$1$2")
        gone = gone - F.octet_length(left)
    out = keyed(packed, TEXT).withColumns({"_n_bytes": size, "_own": F.sha2(F.coalesce(F.col(TEXT), F.lit("")).cast("binary"), 256)})
    if not keep_text and unit == "byte":
        out = out.drop(TEXT)
    out = out.join(change, KEY, "left").withColumns({
        "_n_removed": F.when(full, gone).otherwise(F.coalesce("_r", F.lit(0).cast("long"))),
        "_n_spans": F.when(full, F.lit(1).cast("long")).otherwise(F.coalesce("_s", F.lit(0).cast("long"))),
        "_sha": F.when(full, F.sha2(left.cast("binary"), 256)).otherwise(F.coalesce("_h", "_own")),
    })
    added = ["_n_bytes", "_n_removed", "_n_spans", "_sha"]
    if passages:
        out = out.withColumn("_n_shared", F.coalesce(F.when(F.col("_twice"), F.col("_w")).otherwise(F.col("_p")), F.lit(0).cast("long")))
        added.append("_n_shared")
    if keep_text:
        out = out.withColumn("_kept", F.when(full, left.cast("binary")).otherwise(F.coalesce("_b", F.col(TEXT).cast("binary"))))
        added.append("_kept")
    return unpack(out, docs.columns, text, keep_text, added)


SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
