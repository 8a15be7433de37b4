"""SentencePiece merges with seeded dropout, and lossless decoding.

A text is cut into words where a space mark follows another character (no piece of
the vocabulary may reach across; this is checked).  The words of a block that have
as many characters are rows of one table: each round takes every row's best candidate,
the one with the highest score, leftmost first, and merges it.  Words of more than 48
characters have an agenda of their own, so that texts without spaces take n log n
steps.  A candidate
whose keyed hash falls under the dropout rate is skipped; it is identified by the
seed, the whole hash of the text's key, the word, the byte where it begins in the
text, and its place and length in the word, so every occurrence draws on its own and
the choice is the same on every machine and on every run.  Equal words of a block
are encoded once without dropout; occurrences that skip none of the candidates met
there share that, the others are encoded one by one.  At rate 0 the pieces are those
of the library.

What no piece spells becomes byte pieces, also the space mark itself where a text
holds it, so decoding returns the text exactly.

Defined cases: a null text gives null ids, an empty text gives none; equal texts with
equal keys are segmented alike; a null key hashes to 0; long texts are encoded
in blocks of words, one block at a time; other columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, TEXT, U64, groups_of, mix, pack, pair, ranges, span_hashes, unpack

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 20240817
MARK = 0x2581
NONE = np.int64(1) << np.int64(62)
SLOTS = 21
#: Bytes of a text beyond which it's encoded in pieces.
LONG = 1 << 22
#: Occurrences whose candidates are drawn at once, for bounded memory.
DRAWN = 1 << 16
#: Characters of a word beyond which it has an agenda of its own; words that are merged together.
LONGEST, ROWS = 48, 1 << 15


def spots_of(a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The name of a candidate in its word: where its two symbols begin, and where it ends."""
    return (a.astype(U64) << U64(32)) ^ (b.astype(U64) << U64(16)) ^ end.astype(U64)


_ALL = 2**64 - 1


def hashed(a: int, b: int) -> int:
    """mix(pair(a, b)) of single numbers."""
    b_ = b & _ALL
    x = ((a ^ b_ >> 31) * 0x9E3779B97F4A7C15 + (b_ ^ a << 17 & _ALL) * 0xD6E8FEB86659FD93) & _ALL
    x ^= x >> 32
    x = x * 0xBF58476D1CE4E5B9 & _ALL
    x ^= x >> 29
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _ALL
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _ALL
    return x ^ x >> 33


@dataclass(frozen=True)
class Vocabulary:
    """What the driver reads from the model file and sends along: bounded by the vocabulary."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: bytes  # 0 ordinary, 1 byte, 2 control or unknown

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path or os.environ.get("PIECE_MODEL", MODEL))
        n = m.get_piece_size()
        kinds = bytes(1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0 for i in range(n))
        out = cls(tuple(m.id_to_piece(i) for i in range(n)), tuple(m.get_score(i) for i in range(n)), kinds)
        mark = chr(MARK)
        if any(a != mark and b == mark for p, k in zip(out.pieces, kinds, strict=True) if not k for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece reaches across a space mark")
        if bytes(kinds).count(1) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        return out


_made: dict[int, Merges] = {}


class Merges:
    """Tables for lookups in numpy, made once in each worker."""

    @classmethod
    def of(cls, v: Vocabulary) -> Merges:
        key = hash((v.pieces, v.scores))
        if key not in _made:
            _made.clear()
            _made[key] = cls(v)
        return _made[key]

    def __init__(self, v: Vocabulary):
        own = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if not k}
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in own.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.byte = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if k == 1:
                self.byte[int(p[3:5], 16)] = i
        rank = {i: r for r, i in enumerate(sorted(own.values(), key=lambda i: -v.scores[i]))}
        keys, made = [], []
        for p, i in own.items():
            for cut in range(1, len(p)):
                a, b = own.get(p[:cut]), own.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    made.append(rank[i] << 20 | i)
        self.known = dict(zip(keys, made, strict=True))
        keys_, made_ = np.array(keys, np.int64), np.array(made, np.int64)
        slot = self.slot(keys_)
        _, first = np.unique(slot, return_index=True)
        self.key, self.value = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, NONE, np.int64)
        self.key[slot[first]], self.value[slot[first]] = keys_[first], made_[first]
        rest = np.ones(len(keys_), bool)
        rest[first] = False
        order = np.argsort(keys_[rest])
        self.more_key, self.more_value = keys_[rest][order], made_[rest][order]
        self.crowded = np.zeros(1 << SLOTS, bool)
        self.crowded[slot[rest]] = True
        raw = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(chr(MARK), " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - SLOTS)).astype(np.int64)

    def candidate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | id of the piece that a pair of symbols makes; NONE if none."""
        keys = a.astype(np.int64) << 20 | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slot = self.slot(keys)
        out = np.where(self.key[slot] == keys, self.value[slot], NONE)
        again = np.flatnonzero(self.crowded[slot] & (out == NONE))
        if len(again) and len(self.more_key):
            at = np.minimum(np.searchsorted(self.more_key, keys[again]), len(self.more_key) - 1)
            out[again] = np.where(self.more_key[at] == keys[again], self.more_value[at], NONE)
        return out

    def words(self, symbols: np.ndarray, first: np.ndarray, own: np.ndarray, rate: float, met: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge all words.  first: bounds of the words among the symbols; own: each word's key;
        met: gets (word, name in the word) of the candidates.
        Gives the symbols that are left, their first characters, and their bounds."""
        size = np.diff(first)
        symbol, alive = symbols.astype(np.int64), np.ones(len(symbols), bool)
        order = np.argsort(np.minimum(size, LONGEST + 1), kind="stable")
        cut = np.searchsorted(size[order], np.arange(2, LONGEST + 2))
        for width, lo, hi in zip(range(2, LONGEST + 1), cut[:-1], cut[1:], strict=True):
            for k in range(lo, hi, ROWS):
                self.merge_rows(symbol, alive, first, order[k : min(hi, k + ROWS)], width, own, rate, met)
        for w in order[cut[-1] :]:
            self.merge_one(symbol, alive, int(first[w]), int(size[w]), int(w), int(own[w]), rate, met)
        place = np.arange(len(symbols)) - np.repeat(first[:-1], size)
        return symbol[alive], place[alive], np.concatenate([[0], np.cumsum(alive)])[first]

    def merge_rows(self, symbol: np.ndarray, alive: np.ndarray, first: np.ndarray, which: np.ndarray, width: int, own: np.ndarray, rate: float, met: list | None) -> None:
        """Merge words of one width, a row for each: every round takes each row's best candidate."""
        limit = U64(min(int(rate * 2**64), 2**64 - 1))
        at = first[which][:, None] + np.arange(width)
        sym = symbol[at].ravel()
        left = np.ones(len(sym), bool)
        nxt = np.tile(np.arange(1, width + 1), len(which))
        prv = np.tile(np.arange(-1, width - 1), len(which))
        key = own[which]

        def drawn(row: np.ndarray, a: np.ndarray) -> np.ndarray:
            """Values of the candidates that begin at places ``a`` of the rows."""
            base = row * width
            b = nxt[base + a]
            out = self.candidate(sym[base + a], sym[base + b])
            if rate or met is not None:
                real = np.flatnonzero(out != NONE)
                a, b, row, base = a[real], b[real], row[real], base[real]
                spot = spots_of(a, b, nxt[base + b])
                if met is not None:
                    met.append((which[row], spot))
                if rate:
                    out[real[mix(pair(key[row], spot)) < limit]] = NONE
            return out

        value = np.full((len(which), width), NONE)
        rows = np.arange(len(which))
        value[:, :-1] = drawn(np.repeat(rows, width - 1), np.tile(np.arange(width - 1), len(which))).reshape(len(which), -1)
        live = rows  # the row of each line of ``value``
        while True:
            a = value.argmin(axis=1)
            best = value[np.arange(len(live)), a]
            go = np.flatnonzero(best != NONE)
            if not len(go):
                break
            if len(go) < 0.7 * len(live):
                value, live, a, best = value[go], live[go], a[go], best[go]
                go = np.arange(len(live))
            else:
                a, best = a[go], best[go]
            row = live[go]
            base = row * width
            b = nxt[base + a]
            end = nxt[base + b]
            sym[base + a] = best & ((1 << 20) - 1)
            left[base + b] = False
            nxt[base + a] = end
            value[go, a] = value[go, b] = NONE
            # the merged symbol's two neighbours make new candidates
            some = np.flatnonzero(end < width)
            prv[base[some] + end[some]] = a[some]
            before = prv[base + a]
            more = np.flatnonzero(before >= 0)
            value[go[more], before[more]] = NONE
            line, place = np.concatenate([go[some], go[more]]), np.concatenate([a[some], before[more]])
            value[line, place] = drawn(live[line], place)
        symbol[at] = sym.reshape(at.shape)
        alive[at] = left.reshape(at.shape)

    def merge_one(self, symbol: np.ndarray, alive: np.ndarray, first: int, size: int, which: int, own: int, rate: float, met: list | None) -> None:
        """Merge a long word by an agenda of its candidates, in n log n steps."""
        limit = min(int(rate * 2**64), 2**64 - 1) if rate else 0
        sym = symbol[first : first + size].tolist()
        found = self.candidate(symbol[first : first + size - 1], symbol[first + 1 : first + size])
        real = np.flatnonzero(found != NONE)
        spot = spots_of(real, real + 1, real + 2)
        spots = [spot]
        if rate:
            real = real[mix(pair(np.full(len(spot), own, U64), spot)) >= U64(limit)]
        agenda = list(zip(found[real].tolist(), real.tolist(), (real + 1).tolist(), (real + 2).tolist(), strict=True))
        heapq.heapify(agenda)
        nxt, prv = list(range(1, size + 1)), list(range(-1, size - 1))
        left, more, known = [True] * size, [], self.known

        def offer(a: int) -> None:
            b = nxt[a]
            value = known.get(sym[a] << 20 | sym[b]) if sym[a] >= 0 and sym[b] >= 0 else None
            if value is not None:
                name = a << 32 ^ b << 16 ^ nxt[b]
                if met is not None:
                    more.append(name)
                if not rate or hashed(own, name) >= limit:
                    heapq.heappush(agenda, (value, a, b, nxt[b]))

        while agenda:
            value, a, b, end = heapq.heappop(agenda)
            if not left[a] or nxt[a] != b or nxt[b] != end:  # not the two symbols that were offered
                continue
            sym[a], left[b], nxt[a] = value & ((1 << 20) - 1), False, end
            if end < size:
                prv[end] = a
                offer(a)
            if prv[a] >= 0:
                offer(prv[a])
        if met is not None:
            spots.append(np.array(more, U64))
            met.append((np.full(sum(map(len, spots)), which), np.concatenate(spots)))
        symbol[first : first + size], alive[first : first + size] = sym, left

    def touched(self, own: np.ndarray, back: np.ndarray, word: np.ndarray, spot: np.ndarray, rate: float) -> np.ndarray:
        """The occurrences (own: their keys, back: their words) that skip one of their word's candidates at least."""
        order = np.argsort(word, kind="stable")
        spot, at = spot[order], np.searchsorted(word[order], np.arange(int(back.max(initial=-1)) + 2))
        limit = U64(min(int(rate * 2**64), 2**64 - 1))
        out = [np.zeros(0, np.int64)]
        for k in range(0, len(own), DRAWN):
            lo, hi = at[back[k : k + DRAWN]], at[back[k : k + DRAWN] + 1]
            which = np.repeat(np.arange(k, k + len(lo)), hi - lo)
            out.append(np.unique(which[mix(pair(own[which], spot[ranges(lo, hi)])) < limit]))
        return np.concatenate(out)

    def block(self, data: np.ndarray, at: np.ndarray, row: np.ndarray, rate: float, seed: int, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds by text) of a block of texts, given as by groups_of.  row: the hash of each text's key;
        before: bytes of the text that stand before the block."""
        n = len(at) - 1
        # each text with a space before it and without the one after it
        body = np.concatenate([[np.uint8(32)], data])[:-1]
        lead = np.zeros(len(body), bool)
        lead[at[:-1]] = True
        empty = np.zeros(n, bool)
        empty[np.diff(at) == 1] = True
        head = (body & 0xC0) != 0x80
        begin = np.flatnonzero(head)
        code = codes(body, begin)
        space = body[begin] == 32
        cut = np.ones(len(begin), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut |= lead[begin]
        if empty.any():  # an empty text has no space mark of its own
            drop = np.isin(begin, at[:-1][empty])
            begin, code, space, cut = begin[~drop], code[~drop], space[~drop], cut[~drop]
        symbol = self.char[np.where(space, MARK, np.where(code == MARK, 0, code))]
        word = np.flatnonzero(cut)
        bounds = np.concatenate([word, [len(begin)]])
        text_of = np.searchsorted(at, begin[word], side="right") - 1
        byte_end = np.minimum(np.concatenate([begin[word[1:]], [len(body)]]), at[text_of + 1]) if len(word) else np.zeros(0, np.int64)
        spelled = span_hashes(body, begin[word], byte_end) if len(word) else np.zeros(0, U64)
        distinct, pick, back = np.unique(spelled, return_index=True, return_inverse=True)
        size = np.diff(bounds)[pick]
        spots = ranges(bounds[pick], bounds[pick] + size)
        first = np.concatenate([[0], np.cumsum(size)])
        met: list[tuple[np.ndarray, np.ndarray]] = []
        merged, place, left = self.words(symbol[spots], first, distinct, 0.0, met if rate else None)
        if met:
            salt = mix(row.astype(U64) + mix(np.array([seed], U64)))
            own = pair(pair(spelled, salt[text_of]), (begin[word] - at[text_of] + before).astype(U64))
            other = self.touched(own, back, *(np.concatenate(x) for x in zip(*met, strict=True)), rate)
            # these follow the shared words
            size = np.diff(bounds)[other]
            more = ranges(bounds[other], bounds[other] + size)
            again = np.concatenate([[0], np.cumsum(size)])
            merged_, place_, left_ = self.words(symbol[more], again, own[other], rate)
            back[other] = len(pick) + np.arange(len(other))
            spots, first = np.concatenate([spots, more]), np.concatenate([first, first[-1] + again[1:]])
            merged, place, left = np.concatenate([merged, merged_]), np.concatenate([place, place_]), np.concatenate([left, left[-1] + left_[1:]])
        # symbols without a piece are spelled in bytes
        width = np.diff(left)
        source = spots[np.repeat(first[:-1], width) + place] if len(merged) else np.zeros(0, np.int64)
        ends = np.concatenate([begin[1:], [len(body)]])
        count = np.where(merged < 0, ends[source] - begin[source], 1) if len(merged) else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        ids = np.repeat(merged, count)
        odd = np.flatnonzero(merged < 0)
        if len(odd):
            into = ranges(start[odd], start[odd] + count[odd])
            ids[into] = self.byte[body[ranges(begin[source[odd]], ends[source[odd]])]]
        lo, hi = start[left[:-1]], start[left[1:]]
        out = ids[ranges(lo[back], hi[back])]
        total = np.concatenate([[0], np.cumsum((hi - lo)[back])]).astype(np.int64)
        return out.astype(np.int32), total[np.searchsorted(text_of, np.arange(n + 1))]

    def long(self, data: np.ndarray, row: int, rate: float, seed: int) -> tuple[np.ndarray, bool]:
        """(ids, lossless) of one long text, piece after piece: cut at single spaces, where words begin anyway, so the
        ids are those of the whole.  The space that begins a piece is the one that a text's first word gets."""
        single = np.flatnonzero((data[1:-1] == 32) & (data[:-2] != 32) & (data[2:] != 32)) + 1
        out, ok, start = [], True, 0
        while start < len(data):
            k = np.searchsorted(single, start + LONG)
            stop = int(single[k]) if k < len(single) else len(data)
            part = np.concatenate([data[start:stop], np.full(1, 32, np.uint8)])
            ids, bounds = self.block(part, np.array([0, len(part)]), np.array([row]), rate, seed, start)
            raw, _ = self.decoded(ids, bounds)
            ok = ok and np.array_equal(raw, part[:-1])
            out.append(ids)
            start = stop + 1
        return np.concatenate(out), ok

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds by text): what the pieces spell, without the leading space of each text."""
        lo, hi = self.raw_at[ids], self.raw_at[ids + 1]
        raw = self.raw[ranges(lo, hi)]
        at = np.concatenate([[0], np.cumsum(hi - lo)])[bounds]
        keep = np.ones(len(raw), bool)
        keep[at[:-1][np.diff(at) > 0]] = False
        return raw[keep], at - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


def codes(body: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 from the first byte of each character."""
    one = body[begin].astype(np.int64)
    padded = np.concatenate([body, np.zeros(3, np.uint8)]).astype(np.int64)
    b1, b2, b3 = (padded[begin + k] & 0x3F for k in (1, 2, 3))
    two, three, four = (one & 0x1F) << 6 | b1, (one & 0x0F) << 12 | b1 << 6 | b2, (one & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
    return np.where(one < 0x80, one, np.where(one < 0xE0, two, np.where(one < 0xF0, three, np.minimum(four, 0x10FFFF))))


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", rate: float = RATE, seed: int = SEED, ids: bool = True) -> DataFrame:
    """``docs`` without the text, with ``_n`` (ids), ``_sha`` (of their little-endian 32-bit values), ``_lossless``
    (decoding gives the text's bytes again) and, if asked for, ``_ids``."""
    own = F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), F.col(key))) if key else F.lit(0)
    source = pack(docs, text, _key=own.cast("long"))

    def run(batches):
        m = Merges.of(vocabulary)
        for batch in batches:
            texts, rows = batch.column(TEXT), batch.column("_key").to_numpy(zero_copy_only=False)
            count, sha, same, lists = [], [], [], []
            for a, b, data, at in groups_of(texts, 1 << 20):
                if len(data) > LONG:
                    out, ok = m.long(data[:-1], rows[a], rate, seed)
                    count.append(np.array([len(out)]))
                    same.append(np.array([ok]))
                    sha.append(hashlib.sha256(out.astype("<i4").tobytes()).hexdigest())
                    if ids:
                        lists.append(pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out)))
                    continue
                out, bounds = m.block(data, at, rows[a:b], rate, seed)
                raw, where = m.decoded(out, bounds)
                count.append(np.diff(bounds))
                plain = np.delete(data, at[1:] - 1)
                size = np.diff(at) - 1
                if len(plain) == len(raw) and (np.diff(where) == size).all():
                    wrong = np.concatenate([[0], np.cumsum(plain != raw)])[where]
                    same.append(np.diff(wrong) == 0)
                else:
                    same.append(np.array([raw[where[i] : where[i + 1]].tobytes() == data[at[i] : at[i + 1] - 1].tobytes() for i in range(b - a)]))
                view = out.astype("<i4").tobytes()
                sha += [hashlib.sha256(view[4 * bounds[i] : 4 * bounds[i + 1]]).hexdigest() for i in range(b - a)]
                if ids:
                    lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out)))
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            count_ = np.concatenate(count) if count else np.zeros(0, np.int64)
            made = [pa.array(count_, mask=missing), pa.array(sha, pa.string()), pa.array(np.concatenate(same) if same else np.zeros(0, bool))]
            if ids:
                whole = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
                made.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), *made], [ROW, *added])

    added = ["_n", "_sha", "_lossless", *["_ids"] * ids]
    out = source.mapInArrow(run, f"{ROW} {source.schema[ROW].dataType.simpleString()}, _n long, _sha string, _lossless boolean" + ", _ids array<int>" * ids)
    return unpack(out, docs.columns, text, False, added)


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of a list of ids."""
    m = Merges.of(vocabulary)
    raw, _ = m.decoded(np.array(ids, np.int32), np.array([0, len(ids)]))
    return raw.tobytes().decode()
