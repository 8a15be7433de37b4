"""License scans: fingerprints find candidates, banded alignment confirms.

A template of at most ``SHORT`` words is indexed by single words: if ``COVERAGE``
percent of its words must be matched, d of them may be missing, so one of any d + 1
stands in every match; the longest ones are taken.  A longer template's 3-word
shingles are winnowed (of every 4 neighbours the smallest name stays).  The index's
size is that of the templates.  All shingles of a text are looked up in it.  A hit
gives a diagonal, the place where the template would start; hits on diagonals
within the band of the first of them are one candidate.  All candidates of a template are aligned together, row by row: the
longest common subsequence of words within the band.  A match is reported if its
share of the template's words is at least ``COVERAGE`` percent and, for a short template, each of its ``TELLING`` words is matched (four words
of "Licensed under the MIT License" stand in the notice of any license); of matches that
overlap, the one with most matched words stays (ties: the fuller coverage, then the
earlier place, then the name).

Defined cases: null and empty texts have no match and give no row; equal rows give
equal rows; a text with several notices gives a row for each; other columns are
carried unchanged; no templates give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, TEXT, U64, class_bounds, found_in, groups_of, pack, ranges, span_hashes, table_of, unpack, window_hashes
from .decontaminate import ALNUM
from .license_texts import whole_texts

SHINGLE, WINNOW, BAND, COVERAGE, SHORT = 3, 4, 8, 80, 64
#: Words that tell one license from others: names, and first numbers of versions.
TELLING = "mit apache gnu lesser library affero mozilla bsd cc creative by sa nc attribution sharealike noncommercial cc0 spdx mpl gpl lgpl agpl isc zlib unlicense 2 3 4"
#: Candidates and cells (of their tables) that are aligned at once, for bounded memory.
ALIGNED, CELLS = 1024, 1 << 22


def hashed(text: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(text.encode() + b" ", np.uint8)]
    return span_hashes(raw, *class_bounds(raw, ALNUM))


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest name (the last of equals) of every ``width`` neighbours."""
    if len(grams) <= width:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.unique(np.arange(len(views)) + width - 1 - np.argmin(views[:, ::-1], axis=1))


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None):
        given = whole_texts() if templates is None else templates
        self.names, self.words, self.telling, rows = [], [], [], []
        telling = hashed(TELLING)
        for name, texts in given.items():
            for text in texts:
                words = hashed(text)
                if not len(words):
                    continue
                if short := len(words) <= SHORT:
                    lengths = np.subtract(*class_bounds(LOWER[np.frombuffer(text.encode() + b" ", np.uint8)], ALNUM)[::-1])
                    spots = np.argsort(-lengths, kind="stable")[: len(words) * (100 - COVERAGE) // 100 + 1]
                    rows += [(int(words[i]), len(self.words), int(i), 1) for i in spots]
                else:
                    grams = window_hashes(words, SHINGLE)
                    rows += [(int(grams[i]), len(self.words), int(i), SHINGLE) for i in winnowed(grams, WINNOW)]
                self.telling.append(np.intersect1d(words, telling) if short else np.zeros(0, U64))
                self.names.append(name)
                self.words.append(words)
        rows.sort()
        columns = list(zip(*rows, strict=True)) or [()] * 4
        self.key = np.array(columns[0], U64)
        self.template, self.offset, self.size = (np.array(c, np.int64) for c in columns[1:])
        self.known = {int(s): np.unique(self.key[self.size == s]) for s in np.unique(self.size)}
        self.bits = {s: table_of(k) for s, k in self.known.items()}

    def band(self, t: int) -> int:
        """Half the template at most, so that a short notice that follows itself is found twice."""
        return min(BAND, max(1, len(self.words[t]) // 2))

    def candidates(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each template, places (of a block's words) where it may start."""
        at, what = [], []
        for size, known in self.known.items():
            grams = window_hashes(words, size)
            spots = np.flatnonzero(found_in(grams, known, self.bits[size]))
            lo, hi = (np.searchsorted(self.key, grams[spots], side=s) for s in ("left", "right"))
            row = ranges(lo, hi)
            at.append(np.repeat(spots, hi - lo) - self.offset[row])
            what.append(self.template[row])
        out = []
        if at:
            place, template = np.concatenate(at), np.concatenate(what)
            for t in np.unique(template).tolist():
                own = np.unique(place[template == t])
                band = self.band(t)
                new = np.ones(len(own), bool)
                new[1:] = np.diff(own) > band
                # a run of close hits may be long: it is parted where it leaves the band
                part = (own - own[new][np.cumsum(new) - 1]) // (band + 1)
                new[1:] |= np.diff(part) != 0
                out.append((t, own[new]))
        return out

    def possible(self, t: int, words: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Candidates that can have enough coverage: no more words are matched than lie in the text and within the
        band, nor more than stand on some diagonal of the band at their place."""
        own, band = self.words[t], self.band(t)
        m = len(own)
        room = np.minimum(hi, start + m + 2 * band) - np.maximum(lo, start - band)
        fits = np.flatnonzero(100 * room >= COVERAGE * m)
        if m <= SHORT:
            return fits
        keep = []
        for c in fits.tolist():
            same = np.zeros(m, bool)
            for shift in range(-band, 2 * band + 1):
                a = int(start[c]) + shift
                i, j = max(0, int(lo[c]) - a), min(m, int(hi[c]) - a)
                if i < j:
                    same[i:j] |= words[a + i : a + j] == own[i:j]
            if 100 * int(same.sum()) >= COVERAGE * m:
                keep.append(c)
        return np.array(keep, np.int64)

    def aligned(self, t: int, words: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(matched words, first word, last word, candidate) of the candidates with enough coverage;
        lo and hi bound the text of each candidate."""
        own = self.words[t]
        band = self.band(t)
        m, width = len(own), 3 * band + 1
        base = start - band
        rows = np.zeros((m + 1, len(start), width), np.int16)
        same = np.zeros((m, len(start), width), bool)
        for i in range(m):
            at = base[:, None] + i + np.arange(width)
            inside = (at >= lo[:, None]) & (at < hi[:, None])
            same[i] = inside & (words[np.clip(at, 0, len(words) - 1)] == own[i])
            up = np.zeros_like(rows[i])
            up[:, :-1] = rows[i][:, 1:]
            diagonal = rows[i] + same[i]
            rows[i + 1] = np.maximum.accumulate(np.maximum(diagonal, up), axis=1)
        out = []
        for c in np.flatnonzero(100 * rows[m].max(axis=1).astype(np.int64) >= COVERAGE * m).tolist():
            j, i, spots = int(rows[m, c].argmax()), m, []
            while i > 0 and rows[i, c, j] > 0:
                if j and rows[i, c, j - 1] == rows[i, c, j]:
                    j -= 1
                elif same[i - 1, c, j] and rows[i - 1, c, j] + 1 == rows[i, c, j]:
                    spots.append(int(base[c]) + i - 1 + j)
                    i -= 1
                else:
                    i, j = i - 1, j + 1
            if np.isin(self.telling[t], words[spots]).all():
                out.append((len(spots), spots[-1], spots[0], c))
        return out


def scan(texts: Templates, data: np.ndarray, at: np.ndarray) -> list[list[dict]]:
    """The matches of each text of a block."""
    data = LOWER[data]
    starts, ends = class_bounds(data, ALNUM)
    found: list[list[tuple]] = [[] for _ in range(len(at) - 1)]
    words = span_hashes(data, starts, ends)
    if not len(words):
        return [[] for _ in found]
    cut = np.searchsorted(starts, at)
    for t, place in texts.candidates(words):
        # the candidate's text is that of its middle, which lies inside any match
        doc = np.clip(np.searchsorted(cut, np.clip(place + len(texts.words[t]) // 2, 0, len(words) - 1), side="right") - 1, 0, len(found) - 1)
        fits = texts.possible(t, words, place, cut[doc], cut[doc + 1])
        place, doc = place[fits], doc[fits]
        step = max(1, min(ALIGNED, CELLS // (len(texts.words[t]) * (3 * texts.band(t) + 1))))
        for k in range(0, len(place), step):
            some = slice(k, k + step)
            for matched, first, last, c in texts.aligned(t, words, place[some], cut[doc[some]], cut[doc[some] + 1]):
                found[doc[k + c]].append((-matched, len(texts.words[t]) - matched, first, last, texts.names[t]))
    out = []
    for i, own in enumerate(found):
        kept: list[tuple] = []
        for x in sorted(set(own)):
            if all(x[3] < y[2] or x[2] > y[3] for y in kept):
                kept.append(x)
        out.append([
            {"license": name, "matched": -n, "template_words": missing - n, "first_word": int(a - cut[i]), "last_word": int(b - cut[i]), "start": int(starts[a] - at[i]), "end": int(ends[b] - at[i])}
            for n, missing, a, b, name in sorted(kept, key=lambda x: x[2:])
        ])
    return out


FIELDS = ["matched", "template_words", "first_word", "last_word", "start", "end"]


def matches(docs: DataFrame, text: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``docs`` without the text, a row for each match: license, matched and all words of the template,
    the span in words (inclusive) and in bytes (end exclusive), coverage in percent."""
    source = pack(docs, text)
    kind = pa.list_(pa.struct([("license", pa.string()), *((f, pa.int64()) for f in FIELDS)]))
    known = Templates(templates)

    def run(batches):
        for batch in batches:
            found = [x for _, _, data, at in groups_of(batch.column(TEXT)) for x in scan(known, data, at)]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(found, kind)], [ROW, "_found"])

    out = source.mapInArrow(run, f"{ROW} {source.schema[ROW].dataType.simpleString()}, _found array<struct<license:string,{','.join(f'{f}:long' for f in FIELDS)}>>")
    out = out.withColumn("_m", F.explode("_found"))
    out = out.select(ROW, *(F.col(f"_m.{f}").alias(f"_{f}") for f in ("license", *FIELDS))).withColumn("_coverage", F.expr("100 * _matched div _template_words"))
    return unpack(out, docs.columns, text, False, [f"_{f}" for f in ("license", *FIELDS, "coverage")])
