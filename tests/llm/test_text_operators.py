"""Dealt operators on texts, against brute force: edge cases in one fixture for all."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

R = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _n long, row int"


def prose(n, words=WORDS):
    return " ".join(R.choice(words) for _ in range(n))


def near(text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[R.randrange(len(words))] = f"edit{R.randrange(10**6)}"
    return " ".join(words)


PASSAGE = prose(120)
BASE = prose(200)


@pytest.fixture(scope="module")
def texts():
    """Null, empty, blank and short texts, copies, near copies, shared passages, a text that repeats itself, a very
    long text, bytes of several characters, NUL, and equal rows."""
    long = prose(60_000)
    out = [None, "", "   \n\t ", "one", "Two words", "é" * 300, "a" * 900, BASE, BASE, BASE.upper(), near(BASE, 3), near(BASE, 4), near(BASE, 12), prose(30) + " " + PASSAGE, PASSAGE + "\n" + prose(40), long, long[:200_000] + " tail", "x\0y " * 150]
    out += [near(BASE, R.randrange(1, 9)) for _ in range(12)] + [prose(5) + " " + PASSAGE + " " + prose(R.randrange(5, 60)) for _ in range(6)] + ["日本語テキスト " * 90, "line one here\n" * 12 + prose(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", None, "own", 5, 1) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s", None, "own", 5, 1), (None, texts[10], "en", "s", None, "own", 5, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def removed(texts, length):
    """By the definition, over all rows."""
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_array(docs, length):
    from quarry.llm.suffix_array import deduplicated

    rows = [r for r in docs.collect() if r.text is None or len(r.text) < 50_000]
    small = docs.where("text IS NULL OR length(text) < 50000")
    want = Counter(zip([r.doc_id for r in rows], removed([(r.text or "").encode() for r in rows], length), strict=True))
    found = deduplicated(small, length=length).collect()
    assert Counter((r.doc_id, (r._n_bytes, r._n_removed, r._n_spans, r._sha)) for r in found) == want
    assert all(r._k1 == "own" and r._n == 5 and hashlib.sha256(bytes(r._kept or b"")).hexdigest() == r._sha for r in found)


def removed_words(texts, length, across):
    return [(n, gone, spans, hashlib.sha256(kept).hexdigest()) for n, gone, spans, kept in kept_words(texts, length, across)]


def kept_words(texts, length, across):
    """Without the runs of words in windows that stand elsewhere too (with across: in another row)."""
    split = [[m.span() for m in re.finditer(b"[^\x20\x09-\x0d]+", b)] for b in texts]
    windows = [[tuple(b[x:y] for x, y in w[p : p + length]) for p in range(len(w) - length + 1)] for b, w in zip(texts, split, strict=True)]
    seen = Counter(x for own in windows for x in (set(own) if across else own))
    out = []
    for b, w, own in zip(texts, split, windows, strict=True):
        gone = {q for p, x in enumerate(own) if seen[x] > 1 for q in range(p, p + length)}
        spans = [(w[q][0], w[q][1] if q + 1 not in gone else w[q + 1][0]) for q in sorted(gone)]
        cut = bytearray(len(b))
        for x, y in spans:
            cut[x:y] = b"\1" * (y - x)
        kept = bytes(x for x, g in zip(b, cut, strict=True) if not g)
        out.append((len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), kept))
    return out


@pytest.mark.parametrize(("length", "across"), [(50, True), (50, False), (7, True), (7, False)])
def test_suffix_array_of_words(spark, length, across):
    from quarry.llm.suffix_array import deduplicated

    passages = [prose(n) for n in (7, 49, 50, 53, 80)]
    texts = [None, "", " \n", "one", " \n" + " ".join("abcdefg" * 8) + "\t\n", prose(90) + "\n" + passages[4], *[prose(R.randrange(60)) + " " + p + "\n\n" + prose(R.randrange(60)) for p in passages for _ in range(3)]]
    texts += [passages[3] + " " + passages[3], "x y z " * 40, prose(60), "  " + texts[5] + " ", texts[4], texts[4], passages[2], "Ünïcödé wörds " * 30, prose(40) + " " + passages[2].replace(" ", "\n")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, _words string").repartition(3)
    found = {r.doc_id: r for r in deduplicated(docs, length=length, unit="word", across=across).collect()}
    want = removed_words([(t or "").encode() for t in texts], length, across)
    assert {i: (r._n_bytes, r._n_removed, r._n_spans, r._sha) for i, r in found.items()} == dict(enumerate(want))
    assert all(r._words == "own" and hashlib.sha256(bytes(r._kept or b"")).hexdigest() == r._sha for r in found.values())
    assert any(w[1] for w in want)


def test_suffix_array_on_tiles(monkeypatch):
    """Long texts are looked at in tiles; the places of tiles make no difference."""
    import numpy as np

    import quarry.llm.suffix_array as s

    data = np.frombuffer((prose(3000) + PASSAGE + prose(500) + PASSAGE).encode(), np.uint8)
    whole = s.Text(data, 400).sampled(100)[0]
    monkeypatch.setattr(s, "TILE", 700)
    assert set(whole) <= set(s.Text(data, 400).sampled(100)[0])
    covered = [at + b for at, begin, last, *_ in s.Text(data, 400).chunks(352) for a, e in zip(begin, last, strict=True) for b in range(a, e + 1)]
    assert sorted(covered) == list(range(len(data) - 399))


def test_neighbouring_texts_are_named_together():
    """Short texts are looked at in groups, with the results of each text alone, at a small part of its calls."""
    from unittest import mock

    import numpy as np
    import pyarrow as pa

    import quarry.llm.suffix_array as s

    texts = [None, "", "a", PASSAGE + PASSAGE, *[prose(R.randrange(200)) for _ in range(120)], " \n", PASSAGE]
    for unit, length, size in (("byte", 400, 100), ("byte", 60, 25), ("word", 50, 25), ("word", 7, 3)):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["_t"])
        with mock.patch.object(s, "names", wraps=s.names) as calls:
            groups = list(s.texts_of(batch, unit, length))
            together = [(own.row + int(t), int(x), int(n)) for own in groups for x, n, t in zip(*own.sampled(size), strict=True)]
            assert calls.call_count <= len(texts) // 4
        chunks = [(own.row + int(own.text_of(at + a)), int(at + a - own.begin[own.text_of(at + a)]), int(z - a), int(c)) for own in groups for at, begin, last, cls, *_ in own.chunks(size * 2 if size * 2 < length else size, 1) for a, z, c in zip(begin, last, cls, strict=True)]
        alone, alone_chunks = [], []
        for i in range(len(texts)):
            for own in s.texts_of(batch.slice(i, 1), unit, length):
                alone += [(i, int(x), int(n)) for x, n, _ in zip(*own.sampled(size), strict=True)]
                alone_chunks += [(i, int(at + a - own.begin[0]), int(z - a), int(c)) for at, begin, last, cls, *_ in own.chunks(size * 2 if size * 2 < length else size, 1) for a, z, c in zip(begin, last, cls, strict=True)]
        assert together and sorted(together) == sorted(alone) and sorted(chunks) == sorted(alone_chunks)
        known = pa.array([[np.int64(np.uint64(x).view(np.int64)) for j, x, _ in alone if j == i] for i in range(len(texts))], pa.list_(pa.int64()))
        kept = [r for own in groups for r in own.kept(size, own.known(known)).to_pylist()]
        assert kept == [r for i in range(len(texts)) for own in s.texts_of(batch.slice(i, 1), unit, length) for r in own.kept(size, own.known(known.slice(i, 1))).to_pylist()]
        assert all(r == [] or r[0] == 0 for r in kept) and len(kept) == len(texts)


def sets_of(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("n", [4, 5])
def test_minhash(docs, n):
    from quarry.llm.minhash import deduplicated, with_components

    rows = docs.collect()
    sets = [sets_of(r.text, n) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(r.doc_id, least.get(root(i), r.doc_id))
    want = Counter((r.doc_id, len(sets[i]), least.get(root(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows))
    found = with_components(docs, n=n).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = deduplicated(docs, n=n).collect()
    groups = {root(i) for i in range(len(rows)) if sets[i]}
    assert len([r for r in kept if sets_of(r.text, n)]) == len(groups) and all(r._k1 == "own" and r.source == "s" for r in kept)


def test_minhash_groups_without_a_centre(spark):
    """Chains, and many texts that share a passage but aren't similar: nothing that is linked is lost in large buckets."""
    from quarry.llm.minhash import with_components

    chain = [BASE]
    for _ in range(10):
        chain.append(near(chain[-1], 5))
    shared = [PASSAGE + " " + prose(100) for _ in range(300)]
    near_shared = [near(x, 2) for x in shared[:40]]
    texts = chain + shared + near_shared
    sets = [sets_of(t, 5) for t in texts]
    comp = {i: {i} for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] is not comp[j]:
                both = comp[i] | comp[j]
                for k in both:
                    comp[k] = both
    found = with_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: min(comp[i]) for i in comp}


def test_minhash_large_buckets(spark, monkeypatch):
    """Groups whose members are near the threshold to each other, in buckets of many blocks: rounds and blocks lose no link,
    and give fewer links than a pair of blocks has members."""
    import quarry.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK", 8)
    monkeypatch.setattr(m, "LARGE", 16)
    monkeypatch.setattr(m, "HEAVY", 3000)
    found_links = []
    settled = m.settled
    monkeypatch.setattr(m, "settled", lambda *a: found_links.append(settled(*a)) or found_links[-1])
    texts = [near(BASE, R.randrange(2, 5)) for _ in range(150)] + [near(PASSAGE + " " + BASE, R.randrange(3, 6)) for _ in range(60)] + [BASE + " " + prose(150) for _ in range(40)] + [None, "", "one"]
    sets = [sets_of(t, 5) for t in texts]
    comp = {i: {i} for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] is not comp[j]:
                both = comp[i] | comp[j]
                for k in both:
                    comp[k] = both
    for rounds in (0, 2):
        monkeypatch.setattr(m, "ROUNDS", rounds)
        found = m.with_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in found} == {i: min(comp[i]) for i in comp}
    assert found_links[0].count() > found_links[1].count() and found_links[0].distinct().count() < 10 * len(texts)


def test_language(spark, docs):
    from quarry.llm.language import Model, held_out, identified, trained

    samples = {"en": "the cat and the dog were running through the old house when they thought of what she said", "fr": "le chat et le chien étaient dans la maison quand elle pensait à ce que nous avions dit hier", "ru": "кошка и собака бежали через старый дом когда они думали о том что она сказала"}
    rows = [(i, " ".join(R.sample(t.split(), 12)), lang) for i, (lang, t) in enumerate(list(samples.items()) * 40)]
    train = spark.createDataFrame(rows + [(900, None, "en"), (901, "no label", None)], "doc_id long, text string, lang string")
    model = trained(train)
    assert model.langs == ["en", "fr", "ru"]
    mixed = samples["en"] + " " + samples["fr"] + " " + samples["fr"]
    given = [(1, samples["en"]), (2, samples["fr"].upper()), (3, samples["ru"]), (4, None), (5, ""), (6, "123 !?"), (7, mixed), (8, samples["en"] + " la " + samples["en"])]
    found = {r.doc_id: r for r in identified(spark.createDataFrame(given, "doc_id long, text string"), model, spans=True).collect()}
    assert [found[i]._lang for i in range(1, 9)] == ["en", "fr", "ru", "und", "und", "und", "fr", "en"]
    assert found[4]._score == 0 and 0.5 < found[7]._score < 0.8 and [s.lang for s in found[7]._spans] == ["en", "fr"] and len(found[8]._spans) == 1
    nothing = trained(train.where("false"))
    assert {r._lang for r in identified(docs, nothing).collect()} == {"und"}
    assert train.select(held_out().alias("h")).where("h").count() > 10
    # Viterbi finds the best of all paths
    import itertools

    import numpy as np

    from quarry.llm.language import PENALTY, words_of

    model = Model(["a", "b"], np.random.default_rng(1).normal(0, 2, (1 << 15, 2)).astype("float32"), np.ones((20, 2), bool))
    texts = [prose(n).replace("1", "q").replace("2", "z") for n in (1, 4, 7)]
    w = words_of(texts)
    label, score = model.labels(w, 3), model.words(w)
    for d in range(3):
        s, own = score[w.doc == d], label[w.doc == d]
        value = lambda p, s=s: sum(s[i][x] for i, x in enumerate(p)) - PENALTY * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(own) == pytest.approx(max(value(p) for p in itertools.product(range(2), repeat=len(s))), abs=1e-3)


def test_held_out_accuracy(spark):
    from quarry.llm.queries import op5_language, table

    d = "/root/testdata/sf0.01"
    found = op5_language(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


def test_decontamination(spark, docs, texts):
    from quarry.llm.decontaminate import contaminated

    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    items = [("b", " ".join(BASE.split(" ")[20:45])), ("a", "Two, WORDS!"), ("c", None), ("d", "..."), ("a", " ".join(PASSAGE.split(" ")[:9])), (None, BASE), ("10", "日本語テキスト 日本語テキスト 日本語テキスト")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        if item is not None:
            for i in range(max(1, len(w) - 7) if w else 0):
                windows[tuple(w[i : i + 8])].add(item)
    want = []
    for r in docs.collect():
        w, hit, own = split(r.text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    own |= windows[x]
        want.append((r.doc_id, len(w), len(hit), tuple(sorted(own)), len(own) >= 2))
    got = [(r.doc_id, r._n, sum(x.end - x.start for x in r._hit), tuple(r._items), r._bad) for r in contaminated(docs.drop("_n"), bench).collect()]
    assert Counter(got) == Counter(want)
    none = contaminated(docs, bench.where("false")).collect()
    assert len(none) == docs.count() and not any(r._bad or r._items for r in none)


def test_decontamination_with_a_full_filter(spark, docs, monkeypatch):
    """A filter whose bits are all set loses nothing and adds nothing."""
    import quarry.llm.decontaminate as d

    items = [(i, " ".join(BASE.split(" ")[i : i + 12])) for i in range(0, 120, 10)] + [(900, "one"), (901, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = docs.where("text IS NULL OR length(text) < 3000")
    key = lambda df: sorted((str(r.doc_id), r._hit, r._items) for r in df.collect())
    one = key(d.contaminated(small, bench))
    assert any(items for _, _, items in one)
    monkeypatch.setattr(d, "bloom", lambda index: np.full(1, 2**64 - 1, np.uint64))
    assert key(d.contaminated(small, bench)) == one


def test_repetition(docs):
    from quarry.llm.repetition import LIMITS, judged

    for r in judged(docs.withColumnRenamed("_k1", "extra")).collect():
        assert r.extra == "own"
    for r in docs.where("text IS NULL OR length(text) < 50000").collect():
        text = r.text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        covered, repeated = {}, set()
        for k in LIMITS:
            seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
            first = {}
            for i in range(len(words) - k + 1):
                first.setdefault(tuple(words[i : i + k]), i)
            covered[k] = {j for i in range(len(words) - k + 1) if first[tuple(words[i : i + k])] < i for j in range(i, i + k)}
            if k == 8:
                repeated = {j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
        lines, dup, dup_chars = set(), 0, 0
        for line in text.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                if line in lines:
                    dup += 1
                    dup_chars += len(re.sub("[\x20\x09-\x0d]", "", line))
                lines.add(line)
        chars = sum(map(len, words))
        base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        over = 100 * dup_chars > 20 * chars or any(100 * sum(len(words[j]) for j in covered[k]) > LIMITS[k] * chars for k in LIMITS)
        row = judged(docs.where(f"doc_id <=> {'NULL' if r.doc_id is None else r.doc_id}")).first() if r.doc_id in (0, 1, 6, 7, 13, 17, 37) else None
        if row is not None:
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed, row.kept) == (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), base, not base and not over)


def agenda(own, parts, skipped=lambda a, b, end: False):
    """The best pair first, leftmost first."""
    while True:
        at = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
        best = max(((own[a + b][0], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in own and not skipped(*at[i : i + 3])), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def merges(vocabulary, text, rate=0.0, seed=0, row=0):
    """Piece after piece by the definition; with a rate, each candidate of each occurrence of a word is drawn by its keyed hash."""
    import numpy as np

    from quarry.llm.common import U64, mix, pair, span_hashes

    own = {p: (s, i) for i, (p, s, k) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)) if not k}
    marked = (" " + text) if text else ""
    salt, parts = mix(np.array([row], np.int64).astype(U64) + mix(np.array([seed], U64))), []
    for word in re.finditer(" *[^ ]+| +$", marked) if rate else [re.match("(?s).*", marked)]:
        raw = np.frombuffer(word[0].encode(), np.uint8)
        name = span_hashes(raw, np.array([0]), np.array([len(raw)])) if rate else None
        key = pair(pair(name, salt), np.array([len(marked[: word.start()].encode())], U64)) if rate else None

        def skipped(a, b, end, key=key):
            spot = np.array([a << 32 ^ b << 16 ^ end], U64)
            return bool(rate) and int(mix(pair(key, spot))[0]) < int(rate * 2**64)

        parts += agenda(own, list(word[0].replace("▁", "\0").replace(" ", "▁")), skipped)
    parts = ["▁" if p == "\0" else p for p in parts] if "▁" not in text else parts
    ids = []
    for p in parts:
        ids += [own[p][1]] if p in own else [vocabulary.pieces.index(f"<0x{b:02X}>") for b in p.encode()]
    return ids


def test_pieces(docs, texts):
    from quarry.llm.pieces import Vocabulary, decode, encoded

    v = Vocabulary.load()
    small = docs.where("text IS NULL OR length(text) < 3000")
    plain = encoded(small, v, rate=0.0).collect()
    by_id = {i: t for i, t in enumerate(texts)}
    for r in plain:
        text = by_id[r.doc_id] if r.doc_id is not None else by_id[10]
        if text is None:
            assert r._n is None and r._ids == []
            continue
        assert r._lossless and r._k1 == "own" and decode(r._ids, v) == text and r._n == len(r._ids)
        assert r._sha == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r._ids)).hexdigest()
    for r in plain[:12]:
        if r.doc_id is not None and by_id[r.doc_id] and len(by_id[r.doc_id]) < 1000:
            assert r._ids == merges(v, by_id[r.doc_id])
    varied, again, other = (encoded(docs, v, seed=s).collect() for s in (1, 1, 2))
    key = lambda rows: sorted((str(r.doc_id), tuple(r._ids)) for r in rows)
    assert key(varied) == key(again) != key(other) and all(r._lossless for r in varied)
    assert sum(len(r._ids) for r in varied) > sum(len(r._ids) for r in encoded(docs, v, rate=0.0).collect())


def test_dropout_follows_the_agenda(spark, monkeypatch):
    """Against the plain agenda with the same draws, in tables of words and with an agenda for each word."""
    from quarry.llm import pieces

    v = pieces.Vocabulary.load()
    texts = ["the wonderful  unbelievable antidisestablishmentarianism of Zürich ", "日本語テキスト und übermäßige Übertreibungen", "aaaaaaaaaaaaaaaaaaaaaa banana", "", " ", "x", "internationalization " * 8, "nospace" * 12, "  two  spaces  "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(7, doc_id) AS k").collect()}
    for longest in (48, 3):
        monkeypatch.setattr(pieces, "LONGEST", longest)
        found = {r.doc_id: r._ids for r in pieces.encoded(docs, v, rate=0.3, seed=7).collect()}
        for i, t in enumerate(texts):
            assert found[i] == merges(v, t, 0.3, 7, rows[i]), (longest, t)


def test_long_words_take_few_steps():
    import time

    import numpy as np

    from quarry.llm import pieces

    m = pieces.Merges.of(pieces.Vocabulary.load())
    for raw in (b"a" * 100_000, bytes(R.choice(b"abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000)), "日本語の文章".encode() * 6000):
        data = np.frombuffer(raw + b" ", np.uint8)
        began = time.process_time()
        ids, bounds = m.block(data, np.array([0, len(data)]), np.array([3]), 0.1, 5)
        assert time.process_time() - began < 20 and m.decoded(ids, bounds)[0].tobytes() == raw


def test_long_texts_are_encoded_in_pieces(docs, texts, monkeypatch):
    import numpy as np

    from quarry.llm import pieces

    m = pieces.Merges.of(pieces.Vocabulary.load())
    data = np.frombuffer((texts[15][:40_000] + "  two  spaces \n end").encode(), np.uint8)
    whole, _ = m.block(np.append(data, np.uint8(32)), np.array([0, len(data) + 1]), np.array([3]), 0.1, 5)
    monkeypatch.setattr(pieces, "LONG", 1000)
    parts, lossless = m.long(data, 3, 0.1, 5)
    assert lossless and np.array_equal(whole, parts)


def test_licenses(spark):
    from quarry.llm.license_texts import TEMPLATES
    from quarry.llm.licenses import matches

    rows = [(i, prose(20) + "\n" + t + "\n" + prose(20), "x") for i, t in enumerate(t for own in TEMPLATES.values() for t in own)]
    names = [name for name, own in TEMPLATES.items() for _ in own]
    words = TEMPLATES["MIT"][3].split(" ")
    rows += [(500, None, "x"), (501, "", "x"), (502, prose(3000), "x"), (503, " ".join(w for i, w in enumerate(words) if i % 15), "x"), (504, " ".join(words[:60]), "x"), (505, "Released under the MIT License.\n" * 2, "x")]
    found = defaultdict(list)
    for r in matches(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect():
        found[r.doc_id].append(r)
        text = dict((a, b) for a, b, _ in rows)[r.doc_id].encode()
        assert r.license == "x" and 0 <= r._start < r._end <= len(text) and r._coverage >= 80
    for i, name in enumerate(names):
        assert name in [r._license for r in found[i]], (i, name)
    assert not found[500] and not found[501] and not found[502] and not found[504]
    assert found[503][0]._license == "MIT" and found[503][0]._coverage < 100 and len(found[505]) == 2


def test_license_alignment():
    """Against the longest chain of equal words within the band, by trying every chain's end."""
    from quarry.llm.licenses import COVERAGE, Templates, hashed

    vocabulary = [f"v{i}" for i in range(14)]
    seen = 0
    for size in (9, 30, 90):
        template = [R.choice(vocabulary) for _ in range(size)]
        t = Templates({"X": (" ".join(template),)})
        band = t.band(0)
        for _ in range(40):
            edited = [y for w in template for y in ([] if R.random() < 0.07 else [R.choice(vocabulary)] if R.random() < 0.07 else [w, R.choice(vocabulary)] if R.random() < 0.07 else [w])]
            before = [R.choice(vocabulary) for _ in range(R.randrange(12))]
            words = hashed(" ".join(before + edited + [R.choice(vocabulary) for _ in range(R.randrange(12))]))
            start, lo, hi = len(before) + R.randrange(-3, 4), R.randrange(3), len(words) - R.randrange(3)
            best = {}
            for i in range(size):
                for p in range(max(lo, start - band + i), min(hi, start + 2 * band + i + 1)):
                    if words[p] == t.words[0][i]:
                        best[i, p] = 1 + max((n for (a, b), n in best.items() if a < i and b < p), default=0)
            most = max(best.values(), default=0)
            found = t.aligned(0, words, np.array([start]), np.array([lo]), np.array([hi]))
            assert bool(found) == (100 * most >= COVERAGE * size)
            if found:
                matched, first, last, _ = found[0]
                chain = {}
                for (i, p), _ in sorted(best.items()):
                    if first <= p <= last:
                        chain[i, p] = 1 + max((n for (a, b), n in chain.items() if a < i and b < p), default=0)
                assert matched == most == max(chain.values()) and lo <= first <= last < hi
                seen += 1
    assert seen > 30


def test_clashing_columns(spark):
    """Given columns with the names of our own: those that we return take their place, all others stay."""
    from quarry.llm import decontaminate, language, pieces, quotes, url_filter

    names = ["_sha", "_lang", "_score", "_n", "_ids", "_hit", "_k1", "_k2", "_text_in", "_row_in", "_key", "host", "_url"]
    frame = spark.createDataFrame([(1, "one two three four five six seven eight nine", *["own"] * len(names))], ["doc_id", "text", *names])
    bench = frame.select(F.lit("a").alias("item_id"), "text")
    own = {
        "decontaminate": (decontaminate.contaminated(frame, bench), {"_n", "_hit"}), "language": (language.identified(frame, language.trained(frame.withColumn("lang", F.lit("en")))), {"_lang", "_score"}),
        "pieces": (pieces.encoded(frame, pieces.Vocabulary.load()), {"_n", "_sha", "_ids"}), "url": (url_filter.judged(frame.withColumns({"url": F.lit("http://a.b/c"), "html": F.lit("")})), {"host"}),
        "quotes": (quotes.linked(frame.withColumns({"conv_id": F.lit(1), "turn": F.lit(0)})), set()),
    }
    for what, (out, ours) in own.items():
        row = out.first().asDict()
        assert all(row[n] == "own" for n in names if n not in ours), what
        assert all(row[n] != "own" for n in ours), what


def test_empty_tables(spark, docs):
    from quarry.llm import decontaminate, language, licenses, minhash, pieces, repetition, suffix_array

    none = docs.where("false")
    v = pieces.Vocabulary.load()
    for out in (suffix_array.deduplicated(none), minhash.with_components(none), minhash.deduplicated(none), language.identified(none, language.trained(none)), repetition.judged(none), pieces.encoded(none, v), licenses.matches(none), decontaminate.contaminated(none, none.select("doc_id", "text"), item_id="doc_id")):
        assert out.count() == 0
