"""Quality of texts by the votes of labelled neighbours in a latent-semantic space.

A text's features are counts of hashed marks: lower-cased words, the shape of each word (its
case, digits, length), runs of symbols, and words that repeat the one or the two before.  Counts are
square roots, weighted by the inverse of how many of all documents hold the mark.

1. One pass over all documents counts them by mark; each task sends one row for each slot
   (``SLOTS`` at most), so the sums are of bounded size.
2. A sample of labelled rows is drawn for each label by the hash of the id (``SAMPLE`` rows a
   label at most, the documented bound of this classifier).  Its marks come to the driver as a
   sparse matrix, at most ``MARKS`` for each row: those of the largest weights.  A randomised
   singular value decomposition of it gives the latent directions.
3. The labelled vectors and the projection (some 4 MB, whatever the corpus) are broadcast.
   Every document's vector is compared with all labelled vectors by exact cosine products, block
   by block, and the ``NEIGHBOURS`` nearest vote with the power ``SHARP`` of their similarity.

Defined cases: null and empty texts, and those that share no mark with the sample, have no
neighbours and get the share of label 1 among all labelled rows; labels that are null or
neither 0 nor 1, and rows without an id, aren't learned from; of several labels of one id the
largest counts; equal texts get equal scores; of equally near neighbours the votes of a
whole tie aren't split by row order, since copies in the sample with the same vector are one
neighbour with the mean of their labels; with nothing to learn from, every score is
0.5; an empty table gives an empty result; other columns are carried unchanged, whatever
their names.  A text is held with its hashes, some 50 bytes for each byte, while looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TEXT, U64, WS, class_bounds, groups_of, materialize, mix, pack, pair, span_hashes, unpack

SLOTS, SAMPLE, MARKS, DIRECTIONS, NEIGHBOURS, SHARP, BLOCK = 1 << 13, 2048, 2048, 64, 25, 8, 256
LEAST_SCORE = 0.3
#: Bytes of words: digits, letters and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
SYMBOL = WS & ~WORD


def marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every mark of a group of texts."""
    starts, ends = class_bounds(data, WORD)
    lower = LOWER[data]
    words, row = span_hashes(lower, starts, ends), np.searchsorted(at, starts, side="right") - 1

    def any_of(low: int, high: int, begin: np.ndarray) -> np.ndarray:
        n = np.concatenate([[0], np.cumsum((data >= low) & (data <= high))])
        return (n[ends] > n[begin]).astype(np.int64)

    size = ends - starts
    first = np.minimum(starts + 1, ends)
    shape = any_of(65, 90, starts) + 2 * any_of(65, 90, first) + 4 * any_of(97, 122, starts) + 8 * any_of(48, 57, starts) + 16 * np.minimum(size.astype(np.int64).astype(np.float64) ** 0.5, 7).astype(np.int64)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    again, more = np.flatnonzero(same), np.flatnonzero(same[1:] & same[:-1]) + 1
    s, e = class_bounds(data, SYMBOL)
    runs, there = span_hashes(data, s, e), np.searchsorted(at, s, side="right") - 1
    names = np.concatenate([words, mix(shape.astype(U64) + U64(1) << U64(40)), np.full(len(again), 0xA6A1, U64), np.full(len(more), 0x3A6A1, U64), pair(runs, runs)])
    rows = np.concatenate([row, row, row[again], row[more], there])
    return rows, (mix(names) & U64(SLOTS - 1)).astype(np.int64)


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By group of rows: first row, rows, and (row, slot, count) of the marks, by row."""
    for first, end, data, at in groups_of(column):
        row, slot = marks(data, at)
        key, n = np.unique(row * SLOTS + slot, return_counts=True)
        yield first, end - first, key // SLOTS, key % SLOTS, n


def held_by(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """How many documents hold each mark, and how many have any; ``SLOTS`` rows come to the driver."""

    def run(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for _, _, row, slot, _ in counted(batch.column("t")):
                total[:SLOTS] += np.bincount(slot, minlength=SLOTS)
                total[SLOTS] += len(np.unique(row))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    given = docs.select(F.col(f"`{text}`").alias("t")).where("t <> ''")
    found = given.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out[:SLOTS], int(out[SLOTS])


@dataclass
class Space:
    weight: np.ndarray  # of each slot
    basis: np.ndarray  # slots x directions
    vectors: np.ndarray  # labelled rows x directions, of length 1
    votes: np.ndarray  # their labels
    prior: float

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, held: np.ndarray, n: int, prior: float) -> Space:
        """rows: slots and counts of each labelled row."""
        weight = np.log((n + 1) / (held + 1)).astype(np.float32) + np.float32(0.1)
        dense = np.zeros((len(rows), SLOTS), np.float32)
        for x, (slot, count) in zip(dense, rows, strict=True):
            x[slot] = np.sqrt(count) * weight[slot]
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
        q = np.random.default_rng(12).standard_normal((SLOTS, DIRECTIONS + 16)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            q, _ = np.linalg.qr(dense.T @ (dense @ q))
        _, _, right = np.linalg.svd(dense @ q, full_matrices=False)
        basis = np.ascontiguousarray((q @ right.T)[:, :DIRECTIONS], np.float32)
        vectors = dense @ basis
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        # copies are one neighbour, so that a sample full of them still has neighbours of other texts
        one, back = np.unique(np.round(vectors[some] / size[some], 5), axis=0, return_inverse=True)
        back = back.reshape(-1)
        votes = np.bincount(back, labels[some], len(one)) / np.maximum(np.bincount(back, minlength=len(one)), 1)
        return cls(weight, basis, one.astype(np.float32), votes, prior)

    def projected(self, n: int, row: np.ndarray, slot: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The vectors of a group of texts, of length 1 or 0."""
        out = np.zeros((n, self.basis.shape[1]), np.float32)
        own, first = np.unique(row, return_index=True)
        for a in range(0, len(own), BLOCK):
            lo, hi = first[a], first[a + BLOCK] if a + BLOCK < len(own) else len(row)
            x = self.basis[slot[lo:hi]] * (np.sqrt(count[lo:hi]) * self.weight[slot[lo:hi]]).astype(np.float32)[:, None]
            out[own[a : a + BLOCK]] = np.add.reduceat(x, first[a : a + BLOCK] - lo, axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """The weighted votes of the nearest labelled vectors, to six digits."""
        out = np.full(len(vectors), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for a in range(0, len(vectors), BLOCK):
            near = vectors[a : a + BLOCK] @ self.vectors.T
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** SHARP
            total = vote.sum(axis=1)
            some = (total > 1e-12) & vectors[a : a + BLOCK].any(axis=1)
            out[a : a + BLOCK][some] = (vote * self.votes[at]).sum(axis=1)[some] / total[some]
        return np.round(np.clip(out, 0, 1), 6)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None) -> Space:
    """Learn from the rows of ``labels``, those where ``learn`` holds; document counts are of all ``docs``."""
    held, n = held_by(docs, text)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if learn is None else learn))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).where("t <> ''")
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    known = materialize(known, "labelled")
    prior = known.agg(F.avg("label")).first()[0]
    drawn = known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).unionByName(known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    weight = np.log((n + 1) / (held + 1)) + 0.1

    def run(batches):
        for batch in batches:
            ids, labels_ = batch.column("id"), batch.column("label")
            for first, rows, row, slot, count in counted(batch.column("t")):
                own = [slice(*np.searchsorted(row, [i, i + 1])) for i in range(rows)]
                own = [(slot[x], count[x]) for x in own]
                own = [(s[top], c[top]) for s, c in own for top in [np.sort(np.argsort(-np.sqrt(c) * weight[s], kind="stable")[:MARKS])]]
                kinds = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), labels_.slice(first, rows), pa.array([s for s, _ in own], kinds), pa.array([c for _, c in own], kinds)], ["id", "label", "slots", "counts"])

    kind = texts.schema["id"].dataType.simpleString()
    # of rows that share an id, the text of the smallest hash
    chosen = texts.join(drawn, "id").groupBy("id", "label").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.length("t"))).alias("t"))
    found = materialize(chosen.mapInArrow(run, f"id {kind}, label int, slots array<long>, counts array<long>"), "sample").orderBy(F.xxhash64("id"), "id").toArrow()
    rows = [(s.values.to_numpy(), c.values.to_numpy()) for s, c in zip(found.column("slots"), found.column("counts"), strict=True)]
    return Space.of(rows, np.array(found.column("label").to_pylist(), np.float64), held, n, 0.5 if prior is None else float(prior))


def scored(docs: DataFrame, space: Space, text: str = "text") -> DataFrame:
    """``docs`` with ``_score``, from 0 to 1."""
    source = pack(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        space = shared.value
        for batch in batches:
            out = [np.zeros(0)]
            for _, n, row, slot, count in counted(batch.column(TEXT)):
                out.append(space.scores(space.projected(n, row, slot, count)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, "_score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return unpack(source.mapInArrow(run, f"{kept}, _score double"), docs.columns, text, True, ["_score"])


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of ids that nothing is learned from; an id that is null is in neither part."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
