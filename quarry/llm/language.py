"""Language identification of mixed-language text.

Script ranges narrow each word's candidate languages.  Every candidate gets the
log-likelihood of the word's character trigrams, and Viterbi with a switching
penalty labels the words, so that short stretches don't change the language.  The
text's language is the one with most letters; the score is its share of letters.

The model counts hashed trigrams and scripts for each language over all training
rows, in one pass and one small aggregation.  Its size is bounded by ``MAX_LANGS`` times 2**BITS,
whatever the number of rows: with more languages, slots that share their high bits are counted
together, so that each language has fewer.

Defined cases: null, empty and letterless texts are ``und`` with score 0; rows
whose language or text is null aren't learned from; ties go to the language that
is first in order; with nothing to learn from, every text is ``und``; equal texts
give equal results; other columns are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT, U64, mix, pack, unpack

BITS, MAX_LANGS, PENALTY, GROUP = 15, 512, 10.0, 1 << 20
#: First and last code point of the main blocks of a script.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
OTHER = len(SCRIPTS)
#: A script belongs to a language if this share of its training letters is written in it.
SCRIPT_SHARE = 0.01

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and which script."""
    if not _tables:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        script = np.full(0x110000, OTHER, np.int8)
        for k, spans in enumerate(SCRIPTS.values()):
            for a, b in spans:
                script[a : b + 1] = k
        _tables.extend([letter, script])
    return _tables[0], _tables[1]


@dataclass
class Words:
    """The words (runs of letters) of a block of texts."""

    doc: np.ndarray  # the text of each word
    size: np.ndarray  # letters of each word
    gram: np.ndarray  # hashed trigrams, word by word
    cut: np.ndarray  # the first trigram of each word
    script: np.ndarray  # the script of each word's first letter


def words_of(texts: list[str]) -> Words:
    letter, script = tables()
    joined = "\n".join(texts)
    code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    edge = np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.concatenate([[0], np.cumsum([len(t.lower()) + 1 for t in texts])])
    doc = np.searchsorted(line, start, side="right") - 1
    # trigrams of the word with one space before and after it: as many as letters
    known = np.where(is_letter, code, 32).astype(U64)
    before, after = np.concatenate([[U64(32)], known[:-1]]), np.concatenate([known[1:], [U64(32)]])
    gram = (mix((before << U64(42)) ^ (known << U64(21)) ^ after) >> U64(64 - BITS)).astype(np.int32)
    spots = np.flatnonzero(is_letter)
    return Words(doc, end - start, gram[spots], np.searchsorted(spots, start), script[code[start]] if len(start) else np.zeros(0, np.int8))


def grouped(column: pa.Array) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if group and size + len(text) > GROUP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def folded(langs: int) -> int:
    """Low bits of a slot that are left out, so that the model of so many languages stays within its bound."""
    shift = 0
    while langs << (BITS - shift) > MAX_LANGS << BITS and shift < BITS - 1:
        shift += 1
    return shift


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # slots x languages
    allowed: np.ndarray  # scripts x languages
    shift: int = 0  # of a slot, the low bits that are left out

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]]) -> Model:
        """From rows (language, slot, count); slots from 2**BITS on count scripts."""
        langs = sorted({r[0] for r in rows})
        shift = folded(len(langs))
        at = {x: i for i, x in enumerate(langs)}
        count, script = np.zeros(((1 << BITS) >> shift, len(langs))), np.zeros((OTHER + 1, len(langs)))
        for lang, slot, n in rows:
            if slot < 1 << BITS:
                count[slot >> shift, at[lang]] += n
            else:
                script[slot - (1 << BITS), at[lang]] = n
        gram = count + 0.5
        score = np.log(gram / gram.sum(axis=0)).astype(np.float32)
        allowed = script > SCRIPT_SHARE * np.maximum(script.sum(axis=0), 1)
        allowed[~allowed.any(axis=1)] = True
        return cls(langs, score, allowed, shift)

    def words(self, w: Words) -> np.ndarray:
        """Log-likelihood of each word in each language, from the word's best."""
        if not len(w.size):
            return np.zeros((0, len(self.langs)), np.float32)
        s = np.add.reduceat(self.score[w.gram >> self.shift], w.cut, axis=0)
        s[~self.allowed[w.script]] = -1e6
        return s - s.max(axis=1, keepdims=True)

    def labels(self, w: Words, n: int) -> np.ndarray:
        """The language of each word: the best path, all texts of the block at once."""
        score, k = self.words(w), len(self.langs)
        first = np.searchsorted(w.doc, np.arange(n + 1))
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        first, size = first[:-1][order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0] if n else 0), side="left")
        kind = np.int16 if k < 1 << 15 else np.int32
        back = np.zeros((len(w.doc), k), kind)
        best = np.zeros((n, k), np.float32)
        own = np.arange(k, dtype=kind)
        for t, m in enumerate(active):
            at = first[:m] + t
            v = best[:m]
            if t:
                top = v.argmax(axis=1)
                other = v[np.arange(m), top] - PENALTY
                move = other[:, None] > v
                back[at] = np.where(move, top[:, None], own)
                v = np.where(move, other[:, None], v)
            best[:m] = v + score[at]
        label = np.zeros(len(w.doc), kind)
        state = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = first[:m] + t
            label[at] = state[:m]
            state[:m] = back[at, state[:m]]
        return label

    def judged(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, score and spans (language, first word, words) of each text."""
        w, n = words_of(texts), len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n), [[]] * n
        label = self.labels(w, n)
        share = np.bincount(w.doc * len(self.langs) + label, w.size, n * len(self.langs)).reshape(n, -1)
        total = share.sum(axis=1)
        top = share.argmax(axis=1)
        score = share[np.arange(n), top] / np.maximum(total, 1)
        new = np.ones(len(label), bool)
        new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.concatenate([begin, [len(label)]]))
        first = np.searchsorted(w.doc, np.arange(n))
        spans: list[list[dict]] = [[] for _ in texts]
        for b, size in zip(begin.tolist(), length.tolist(), strict=True):
            spans[w.doc[b]].append({"lang": self.langs[label[b]], "first": int(b - first[w.doc[b]]), "words": size})
        return [self.langs[t] if s else "und" for t, s in zip(top, total, strict=True)], score, spans


def trained(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the labelled rows; what comes to the driver is bounded by languages and slots."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        width = (1 << BITS) + OTHER + 1
        for batch in batches:
            labels = batch.column("_lang").to_pylist()
            row = 0
            for texts in grouped(batch.column("_text")):
                w = words_of(texts)
                for x in set(labels[row : row + len(texts)]):
                    own = np.array([y == x for y in labels[row : row + len(texts)]])[w.doc]
                    total = sums.setdefault(x, np.zeros(width, np.int64))
                    total[: 1 << BITS] += np.bincount(w.gram[np.repeat(own, w.size)], minlength=1 << BITS)
                    total[1 << BITS :] += np.bincount(w.script[own], w.size[own], OTHER + 1).astype(np.int64)
                row += len(texts)
        for x, total in sums.items():
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(slot), pa.string()), pa.array(slot), pa.array(total[slot])], ["lang", "slot", "n"])

    known = rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    shift = folded(known.select("_lang").distinct().count())
    found = known.mapInArrow(count, "lang string, slot long, n long")
    if shift:
        found = found.withColumn("slot", F.when(F.col("slot") < 1 << BITS, F.shiftleft(F.shiftright("slot", shift), shift)).otherwise(F.col("slot")))
    found = found.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return Model.of([tuple(r) for r in found.toArrow().to_pandas().itertuples(index=False)])


def identified(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` and, if asked for, ``_spans``."""
    source = pack(docs, text)
    names = source.columns

    def run(batches):
        for batch in batches:
            langs, scores, runs = [], [], []
            for texts in grouped(batch.column(names.index(TEXT))):
                a, b, c = model.judged(texts)
                langs += a
                scores.append(b)
                runs += c if spans else []
            made = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            made += [pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])))] if spans else []
            yield pa.RecordBatch.from_arrays(batch.columns + made, [*names, "_lang", "_score", "_spans"][: len(names) + len(made)])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    out = source.mapInArrow(run, f"{kept}, _lang string, _score double" + ", _spans array<struct<lang:string,first:long,words:long>>" * spans)
    return unpack(out, docs.columns, text, True, ["_lang", "_score", *["_spans"] * spans])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for the quarter of ids that nothing is learned from; an id that is null is in neither part."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
