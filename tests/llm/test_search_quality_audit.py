"""Ranked search and the filter audit against brute force; the classifier against exact neighbours and held-out labels."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

R = random.Random(4)
SF = "/root/testdata/sf0.001"


def ranked(docs, items, top=20):
    """The contract, document by document."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    each = [(i, Counter(terms(t))) for i, t in docs]
    each = [(i, c) for i, c in each if c]
    n, total, df = len(each), sum(sum(c.values()) for _, c in each), Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in each:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def test_search(spark, monkeypatch):
    from quarry.llm import search as s

    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "X1", "a"]
    text = lambda n: " ".join(R.choice(words[: R.choice([5, 65])]) + R.choice(["", ",", ".", "_", "`x"]) for _ in range(n))
    docs = [(i, text(R.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, "copy of w1 w2 w3 and w40") for i in range(150)] + [(5, "copy of w1 w2 w3 and w40")] * 3 + [(None, "w1 w2"), (None, None), (400, ""), (401, "?!"), (402, "w7 " * 200_000), (403, "W8" * 100_000)]
    items = [(1, "w1 w2 w3 w40"), (2, "w1 w1 w9, unknown"), (3, None), (4, "..."), (5, text(40)), (5, "über w64 日本 NAÏVE"), (None, "w5"), (7, "zzz"), (8, "w7 w8")] + [(100 + i, text(12)) for i in range(20)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, names string, score int").repartition(5)
    asked = spark.createDataFrame([(*r, 9) for r in items], "item_id long, text string, rank int")
    expected = ranked(docs, items)
    for block, pairs, first in ((64, 1 << 19, 4), (7, 50, 1)):
        monkeypatch.setattr(s, "BLOCK", block)
        monkeypatch.setattr(s, "PAIRS", pairs)
        monkeypatch.setattr(s, "FIRST", first)
        found = sorted((tuple(r) for r in s.search(frame, asked).collect()), key=repr)
        assert found == expected
    assert s.search(frame.where("false"), asked).count() == 0 == s.search(frame, asked.where("false")).count()
    # lengths times counts beyond 64 bits
    assert s.impacts(np.array([3]), np.array([10**12]), 10**11, 10**15).tolist() == [3 * 10**9 // (3000 + 12 * (75 + 25 * 10**12 * 10**11 // 10**15))]


def test_search_passes_over_blocks():
    """Blocks whose bound is below the threshold aren't scored, and nothing is lost by it."""
    import pyarrow as pa

    from quarry.llm import search as s

    rng = np.random.default_rng(3)
    rows = []
    for b in range(400):
        n = 64
        names = np.unique(rng.integers(1, 60, 20)).astype(np.int64)
        sizes = rng.integers(1, n, len(names))
        docs = np.concatenate([np.sort(rng.choice(n, k, replace=False)) for k in sizes]).astype(np.int32)
        own = rng.integers(1, 1000 if b % 20 else 100_000, len(docs))
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        rows.append({"block": b, "least": b * 64, "ids": np.arange(b * 64, b * 64 + 64), "names": names, "maxima": np.maximum.reduceat(own, starts[:-1]), "starts": starts, "docs": docs, "impacts": own})
    kinds = {"block": pa.int64(), "least": pa.int64(), "starts": pa.list_(pa.int32()), "docs": pa.list_(pa.int32())}
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.list_(pa.int64()))) for c in rows[0]], list(rows[0]))
    queries = s.Queries(pa.table({"q": pa.array([7, 9]), "names": pa.array([[3, 50, 8], [1, 2, 59]], pa.list_(pa.int64())), "weights": pa.array([[5, 2, 9], [4, 4, 1]], pa.list_(pa.int64()))}))
    best = s.Best(2, 20)
    best.search(queries, batch)
    assert best.scored < 120
    for k in range(2):
        every = np.concatenate([queries.scores(k, s.Block(batch, i)) for i in range(400)])
        order = np.lexsort((np.arange(len(every)), -every))[:20]
        assert best.rows[k][0].tolist() == every[order].tolist() and best.rows[k][1].tolist() == order.tolist()


def test_filter_audit(spark):
    from quarry.llm.filter_audit import FILTERS, audited, masks

    text = lambda: R.choice(["word " * R.randint(1, 300), " ".join(f"w{i}" for i in range(R.randint(150, 300))), "ABC def " * 130, "a$b\n" * 20, ""])
    docs = [(i, text(), R.choice(["s", "t", None, ""])) for i in range(150)] + [(3, "same", "s"), (3, "same", "t"), (9, "same", "s"), (2, None, "u"), (1, "", "u"), (None, "same", "s"), (500, "x " * 500_000, "u"), (501, "x " * 500_000, "u")]
    labels = [(i, R.choice([0, 1, None]), R.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audited(masks(spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, source string, part int, n int"), spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, mask string"))).collect()}
    lab = {}
    for i, q, t in labels:
        if i is not None:
            old = lab.get(i, (0, 0))
            lab[i] = max(old[0], q or 0), max(old[1], t or 0)
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((part or "", fails, *lab.get(i, (0, 0))))
    parts = {r[0] for r in rows}
    assert len(got) == 600 * len(parts)
    removed = Counter()
    for p in parts:
        for order in permutations(FILTERS):
            left = [r for r in rows if r[0] == p]
            for k, f in enumerate(order):
                fail = [r for r in left if r[1][f]]
                all_ = [r for r in rows if r[0] == p and r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed[p, f] += len(fail)
                assert got[p, "".join(order), k + 1][:6] == (len(left), len(fail), len(all_) - len(fail), sum(sum(r[1].values()) == 1 for r in all_), sum(r[2] == 1 for r in fail), sum(r[3] == 1 for r in fail))
    assert all(v[6] == removed[p, o[k - 1]] for (p, o, k), v in got.items())
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audited(masks(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_neighbour_votes(spark):
    from quarry.llm import quality as q

    clean = lambda: " ".join("".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(R.randint(5, 80)))
    junk = lambda: R.choice([lambda: clean().upper() + "!!", lambda: " ".join(w + "$$$" for w in clean().split()), lambda: "und " * 40])()
    docs = [(i, junk() if i % 5 == 0 else clean()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "a b " * 300_000), (None, "x y"), (3, "other text"), (1003, docs_text := "SHOUT!! " * 30), (1004, docs_text)]
    labels = [(i, int(i % 5 != 0)) for i in range(400)] + [(7, 0), (None, 1), (9, None), (11, 5), (5000, 1)]
    frame = spark.createDataFrame([(*r, "s", 1) for r in docs], "doc_id long, text string, slots string, _score int")
    marked = spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, label int")
    space = q.fitted(frame, marked, learn=~q.held_out())
    rows = q.scored(frame, space).collect()
    assert len(rows) == len(docs) and rows[0].slots == "s"
    got = {r.doc_id: r._score for r in rows if r.doc_id != 3}
    out = {r.doc_id for r in frame.where(q.held_out()).collect() if r.doc_id is not None and r.doc_id < 400}
    assert 40 < len(out) < 140 and np.mean([(got[i] >= q.LEAST_SCORE) == (i % 5 != 0) for i in out - {3}]) > 0.95
    assert got[1000] == got[1001] == round(space.prior, 6) and got[1003] == got[1004] < 0.3 and all(0 <= x <= 1 for x in got.values())
    # nearest neighbours by definition
    import pyarrow as pa

    texts = [t or "" for _, t in docs[:60]]
    for _, n, row, slot, count in q.counted(pa.array(texts)):
        v = space.projected(n, row, slot, count)
        near = v.astype(np.float64) @ space.vectors.T.astype(np.float64)
        top = -np.sort(-near, axis=1)[:, : q.NEIGHBOURS]
        expected = [np.sum([max(x, 0) ** q.SHARP * space.votes[j] for x, j in zip(near[i], range(len(near[i])), strict=True) if x >= top[i, -1]]) / np.sum(np.maximum(top[i], 0) ** q.SHARP) for i in range(n)]
        assert np.allclose(space.scores(v), expected, atol=2e-3)
    none = q.fitted(frame.where("false"), marked.where("false"))
    assert {r._score for r in q.scored(frame, none).collect()} == {0.5} and q.scored(frame.where("false"), none).count() == 0


def test_neighbour_votes_on_given_labels(spark):
    from quarry.llm.queries import QUERIES

    rows = QUERIES["op12_neighbour_votes"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def naive_language(train, texts):
    """Counts, scripts, Viterbi and shares word by word."""
    from quarry.llm import language as g
    from quarry.llm.common import U64, mix

    _, script = g.tables()
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())

    def grams(w):
        c = [32, *map(ord, w), 32]
        return [int(mix(np.array([(c[i] << 42) ^ (c[i + 1] << 21) ^ c[i + 2]], U64))[0] >> U64(64 - g.BITS)) for i in range(len(w))]

    langs = sorted({x for t, x in train if t is not None and x is not None})
    shift = g.folded(len(langs))
    count, seen = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, x in train:
        if t is not None and x is not None:
            for w in words(t):
                count[x].update(v >> shift for v in grams(w))
                seen[x][int(script[ord(w[0])])] += len(w)
    slots = (1 << g.BITS) >> shift
    total = {x: sum(count[x].values()) + 0.5 * slots for x in langs}
    out = []
    for t in texts:
        own = words(t)
        if not own:
            out.append(("und", 0.0))
            continue
        path = None
        for w in own:
            s = int(script[ord(w[0])])
            ok = [x for x in langs if seen[x][s] > g.SCRIPT_SHARE * max(1, sum(seen[x].values()))] or langs
            score = {x: sum(math.log((count[x][v >> shift] + 0.5) / total[x]) for v in grams(w)) if x in ok else -1e6 for x in langs}
            if path is None:
                path = {x: (score[x], [x]) for x in langs}
            else:
                top = max(langs, key=lambda x: (path[x][0], -langs.index(x)))
                path = {x: max(((path[x][0] + score[x], 1, path[x][1] + [x]), (path[top][0] - g.PENALTY + score[x], 0, path[top][1] + [x])), key=lambda y: y[:2])[::2] for x in langs}
        last = max(langs, key=lambda x: (path[x][0], -langs.index(x)))
        share = Counter()
        for w, x in zip(own, path[last][1], strict=True):
            share[x] += len(w)
        best = max(langs, key=lambda x: (share[x], -langs.index(x)))
        out.append((best, share[best] / sum(share.values())))
    return out


def test_languages_by_definition(spark, monkeypatch):
    from quarry.llm import language as g

    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    train = [(t[:600], x) for t, x in rows[:40]] + [("Привет мир и люди", "ru"), (None, "de"), ("x y", None)]
    texts = [t[:250] for t, _ in rows[40:]] + [rows[41][0][:120] + " " + rows[44][0][:150], "Привет the мир", "123 !?", "", None, "Б " + rows[42][0][:90]]
    for most in (512, 3):
        monkeypatch.setattr(g, "MAX_LANGS", most)
        model = g.trained(spark.createDataFrame([(t, x, 1) for t, x in train], "text string, lang string, slot int"))
        assert model.shift == (0 if most == 512 else 1)
        found = {r.i: (r._lang, r._score) for r in g.identified(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
        for i, (lang, score) in enumerate(naive_language(train, texts)):
            assert found[i][0] == lang and abs(found[i][1] - score) < 1e-6, (i, found[i], lang, score)


def test_more_languages_than_the_bound():
    from quarry.llm import language as g

    rows = [(f"l{k:04d}", s, 5) for k in range(1500) for s in (k * 7 % (1 << g.BITS), (1 << g.BITS))]
    model = g.Model.of(rows)
    assert len(model.langs) == 1500 and model.score.size <= g.MAX_LANGS << g.BITS and model.shift == 2
    assert len(model.judged(["ein kurzer Text", "", "zwei"])[0]) == 3
