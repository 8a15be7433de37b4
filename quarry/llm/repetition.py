"""Quality rules by repetition coverage.

Rolling names of word n-grams of several lengths, computed in numpy over blocks of
whole texts: the characters inside n-grams that equal an earlier n-gram of the text,
and the characters of lines equal to an earlier line, as shares of all word
characters.  (The base figure counts the first of equal windows too; the shares
don't, as a text that says one thing twice has one copy too many, not two.)  A document is kept if it passes the base rules and no share is over
its limit.  Limits are those published for large web corpora (5 to 10 words:
15 % down to 10 %; lines: 20 %), as whole percents so that they are exact; each
takes effect only on texts with at least ``FLOOR`` words.

Defined cases: a null or empty text has no words and fails the base rules; equal
rows give equal results; other columns are carried unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, TEXT, U64, WS, class_bounds, groups_of, mix, pack, pair, span_hashes, unpack

#: N-gram length in words and the largest share in percent.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
BASE_WINDOW, BASE_SHARE, FLOOR = 8, 30, 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def twice(keys: np.ndarray) -> np.ndarray:
    """Mask of the values that stand at two positions or more."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Mask of the values that equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return out


def measured(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of each text of a block."""
    n = len(at) - 1
    starts, ends = class_bounds(data, WS)
    doc = np.searchsorted(at, starts, side="right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    words = span_hashes(data, starts, ends)
    total = lambda of, w=None: np.bincount(of, w, minlength=n).astype(np.int64)
    own = mix(doc.astype(U64) + U64(1))
    covered, repeated = {}, np.zeros(len(words), bool)
    name = words
    for k in range(2, max(LIMITS) + 1):
        if len(words) < k:
            covered |= {j: np.zeros(len(words), bool) for j in LIMITS if j >= k}
            break
        name = pair(name[: len(words) - k + 1], words[k - 1 :])
        if k not in LIMITS:
            continue
        whole = np.flatnonzero(doc[: len(words) - k + 1] == doc[k - 1 :])
        key = name ^ own[: len(name)]
        every = whole[twice(key[whole])]
        covered[k] = inside(every[later(key[every])], k, len(words))
        if k == BASE_WINDOW:
            repeated = inside(every, k, len(words))
    out = {"n_words": total(doc), "word_chars": total(doc, chars), "n_repeat_words": total(doc[repeated])}
    out |= {f"chars_{k}": total(doc[covered[k]], chars[covered[k]]) for k in LIMITS}
    sign = np.flatnonzero(SYMBOLS[data])
    out["n_symbols"] = total(np.searchsorted(at, sign, side="right") - 1)
    stop = data == 10
    stop[at[1:] - 1] = True
    line_end = np.flatnonzero(stop)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_doc = np.searchsorted(at, line_start, side="right") - 1
    word_at = np.concatenate([[0], np.cumsum(mask_of(starts, len(data)))])
    some = word_at[line_end] > word_at[line_start]
    line_start, line_end, line_doc = line_start[some], line_end[some], line_doc[some]
    again = later(span_hashes(data, line_start, line_end) ^ mix(line_doc.astype(U64) + U64(1)))
    out["n_dup_lines"] = total(line_doc[again])
    in_words = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & WS[data])])
    out["chars_lines"] = total(line_doc[again], (in_words[line_end] - in_words[line_start])[again])
    return out


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n words that lie in one of the windows of k words."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + k, -1)
    return np.cumsum(edge[:-1]) > 0


def mask_of(spots: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[spots] = True
    return out


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_{k}" for k in LIMITS), "chars_lines"]


def with_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The packed rows of ``docs`` with ``_rep``: a struct of FIGURES."""
    source = pack(docs, text)

    def run(batches):
        for batch in batches:
            parts = [measured(data, at) for _, _, data, at in groups_of(batch.column(TEXT))]
            made = pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in FIGURES], FIGURES)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), made], [ROW, "_rep"])

    return source.mapInArrow(run, f"{ROW} {source.schema[ROW].dataType.simpleString()}, _rep struct<{', '.join(f'{c}: long' for c in FIGURES)}>")


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the base figures, ``base_failed`` and ``kept``."""
    r = lambda c: F.col(f"_rep.{c}")
    base = (r("n_words") < 20) | (100 * r("n_repeat_words") > BASE_SHARE * r("n_words"))
    over = 100 * r("chars_lines") > LINE_LIMIT * r("word_chars")
    for k, share in LIMITS.items():
        over = over | (100 * r(f"chars_{k}") > share * r("word_chars"))
    out = with_figures(docs, text).withColumns({c: r(c) for c in FIGURES[:5]} | {"base_failed": base, "kept": ~base & ~(over & (r("n_words") >= FLOOR))})
    return unpack(out, docs.columns, text, False, [*FIGURES[:5], "base_failed", "kept"])
