"""Orders without one task, windows, budgets and needles, against plain loops."""

import json
import random
import time

import pytest

R = random.Random(8)


def test_ordinals_and_pages(spark):
    from pyspark.sql import functions as F

    from quarry.operators import lookup, ordered

    rows = [(R.randint(0, 50), i, R.choice("abc")) for i in range(3000)]
    frame = spark.createDataFrame(rows, "a int, i int, c string").repartition(7)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    by = [F.desc("a"), "i"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part
    try:
        whole = ordered.ordered(frame, by)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert whole.total == 3000 and [tuple(r)[:3] for r in whole.numbered().orderBy("ordinal").collect()] == want and len(whole.starts) > 1
    for offset, limit in ((0, 10), (1490, 25), (2995, 100), (3000, 5)):
        assert [tuple(r)[:3] for r in whole.page(offset, limit).orderBy("ordinal").collect()] == want[offset : offset + limit]
    # a deep page leaves parts of the order unread
    plan = whole.page(0, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "_part" in plan[plan.index("PushedFilters") :]
    near = lookup.lookahead(frame, by, 20, 40).orderBy("position").collect()
    deep = lookup.lookahead(frame, by, 20_000, 2990).orderBy("position").collect()
    assert [r.position for r in near] == list(range(40, 60)) and all(r.more for r in near) and [r.position for r in deep] == list(range(2990, 3000)) and not any(r.more for r in deep)
    assert ordered.ordered(frame.where("false"), by).page(0, 5).count() == 0


def test_neighbours(spark):
    from quarry.operators.ordered import neighbours

    left = [(i, R.choice(["x", "y", None]), R.randint(-300, 300)) for i in range(400)]
    right = sorted({(R.choice(["x", "y", None, "z"]), R.randint(-320, 320)) for _ in range(90)}, key=repr)
    for stripe in (7, 4096):
        found = {r.i: (r.below.at if r.below else None, r.above.at if r.above else None) for r in neighbours(spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "k string, at int"), ["k"], "at", stripe).collect()}
        assert found == {i: (max((a for kk, a in right if kk == k and a <= at), default=None), min((a for kk, a in right if kk == k and a >= at), default=None)) for i, k, at in left}


def test_many_equal_names_in_one_file(spark):
    from quarry.operators.intervals import relocated

    n = 100_000
    stale = spark.range(n).selectExpr("id AS symbol_id", "1L AS file_id", "'same' AS name", "'line' AS kind", "id * 10 AS start_row", "id * 10 + 2 AS end_row")
    live = spark.range(n).selectExpr("id AS symbol_id", "1L AS file_id", "'same' AS name", "'line' AS kind", "id * 10 + 3 AS start_row", "id * 10 + 5 AS end_row")
    began = time.time()
    got = relocated(stale, live)
    assert got.where("live_id = symbol_id").count() == n and time.time() - began < 120
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in plan


def chained(times, seconds):
    """Window by window."""
    out, end = [], None
    for t in sorted(set(times)):
        if end is None or t >= end:
            out.append(t)
            end = t + seconds
    return out


def test_windows_open_at_their_first_event(spark):
    from quarry.operators import maintain, ordered

    events = [(R.choice(["a", "b"]), t) for t in [R.randint(0, 3000) for _ in range(300)] + [9000, 9001, 20_000]]
    frame = spark.createDataFrame(events, "feed string, at long")
    got = sorted(map(tuple, ordered.window_starts(frame, 60, keys=["feed"]).collect()))
    assert got == sorted((f, t) for f in "ab" for t in chained([t for k, t in events if k == f], 60))
    rows = [(t, R.choice(["p", "q", "r"]), R.choice(["modify", "access", "overflow"])) for _, t in events]
    starts = chained([t for t, _, k in rows if k != "access"], 60)
    want = {}
    for t, p, k in rows:
        if k != "access":
            at = (max(s for s in starts if s <= t), p)
            want[at] = want.get(at, False) or k == "overflow"
    assert {(r.window, r.path): r.rescan for r in maintain.changes_of(spark.createDataFrame(rows, "at long, path string, kind string"), 60).collect()} == want
    assert maintain.changes_of(spark.createDataFrame([], "at long, path string, kind string"), 60).count() == 0


def test_stream_of_windows(spark, tmp_path):
    """Late events, an idle time, and windows across batches."""
    from quarry.streaming.feed import events, windowed

    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    files = [
        [(100, "a", "modify"), (101, "b", "modify"), (103, "c", "access")], [(101, "late", "modify"), (102, "d", "overflow"), (104, "e", "modify")],
        [(200, "f", "modify"), (100, "too late", "modify")], [(201, "g", "modify"), (300, "h", "modify")], [(900, "end", "modify")],
    ]
    for i, rows in enumerate(files):
        (source / f"{i}.json").write_text("".join(json.dumps({"at": a, "path": p, "kind": k}) + "\n" for a, p, k in rows))
        time.sleep(0.05)
    feed = spark.readStream.schema("at long, path string, kind string").option("maxFilesPerTrigger", 1).json(str(source))
    assert events(spark, str(source)).isStreaming
    writer = windowed(feed, 2, 2).writeStream.format("json").option("checkpointLocation", str(tmp_path / "check")).option("path", str(out)).trigger(availableNow=True)
    writer.start().awaitTermination(240)
    got = {r.window: (sorted(r.paths), r.rescan) for r in spark.read.schema("window long, paths array<string>, rescan boolean").json(str(out)).collect()}
    assert got[100][0][:3] == ["a", "b", "late"] and got[102] == (["e"], True) or got[102] == ([], True), got
    assert got[200] == (["f", "g"], False) and got[300] == (["h"], False)


@pytest.mark.parametrize("budget_bytes", [60, 300, 2000])
def test_budgets(spark, budget_bytes):
    from pyspark.sql import functions as F

    from quarry.operators import budget
    from quarry.plans import wire

    rows = [(f"k{k}", i, "x" * R.randint(1, 30)) for k in range(12) for i in range(R.choice([1, 2, 40, 200]))]
    frame = spark.createDataFrame(rows, "k string, i int, t string")
    own = budget.sized(frame, "k", ["i"], F.octet_length(F.to_json(F.struct("i", "t"))), max(budget_bytes, 40_000), 15)
    one = {r.k: (r.kept, r.size, r.fits) for r in budget.scaled(budget.sized(frame, "k", ["i"], F.octet_length(F.to_json(F.struct("i", "t"))), budget_bytes, 15), F.lit(9), budget_bytes).collect()}
    two = {r.k: (r.kept, r.size, r.fits) for r in budget.popped(own, F.lit(9), budget_bytes).collect()}
    for k in {r[0] for r in rows}:
        mine = [{"i": i, "t": t} for kk, i, t in sorted(rows) if kk == k]
        size = lambda n, mine=mine: 9 + len(",".join(wire.compact(x) for x in mine[:n]))
        _, n, fits = wire.shrunk(lambda n: {"n": n}, len(mine), budget_bytes, lambda r, size=size: size(r["n"]))
        assert one[k] == (n, size(n), fits)
        n = len(mine)
        while n > 1 and size(n) > budget_bytes:
            n -= 1
        assert two[k] == (n, size(n), size(n) <= budget_bytes)


def test_counts_within_a_budget_are_ranked_once(spark):
    """One window gives ranks and running sums, with its limit below the exchange; counts stay in the JVM."""
    from quarry.plans import catalogue

    found = catalogue.byte_budget_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert found.count("+- Window [") == 1 and found.count("WindowGroupLimit") == 2 and "MapInArrow" not in found and "to_json" not in found


def test_needles(spark):
    from quarry.sources import occurrences

    needles = ["aa", "a", "aba", "é", "b a", "zz"]
    texts = ["".join(R.choice("aab é") for _ in range(R.randint(0, 300))) for _ in range(60)] + ["", None, "a" * 2_000_000]
    frame = spark.createDataFrame([(i, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)] + [(99, bytearray(b"a\xff"))], "file_id long, content binary")
    got = {(r.file_id, r.needle): r.n for r in occurrences.counted(frame, needles).collect()}
    assert got == {(i, x): t.count(x) for i, t in enumerate(texts) if t for x in needles if x in t}
    paths = ["a/b.py", "target/x", "a/.git/x", ".hidden/y", ".quarry/z", "node_modules/q/r", "targets/x", "a/b/.e"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").where(occurrences.searched(__import__("pyspark").sql.functions.col("p"))).collect()
    assert [r.p for r in rows] == ["a/b.py", ".quarry/z", "targets/x"]
    with pytest.raises(ValueError):
        occurrences.counted(frame, [""])


def test_sweep_over_parts(spark):
    """Files that lie in several parts, with symbols that reach over borders, against a plain scan."""
    from pyspark.sql import functions as F

    from quarry.operators import intervals, sweep

    symbols = []

    def put(file, lo, hi, level):
        if hi >= lo and len(symbols) < 4000:
            symbols.append((len(symbols), file, R.choice(["class", "def", "import"]), f"n{len(symbols)}", lo, R.randint(0, 3), hi, R.randint(4, 60)))
            at = lo
            while level < 5 and at < hi:
                end = min(hi, at + R.randint(0, max(1, (hi - lo) // 3)))
                put(file, at, end, level + 1)
                at = end + R.randint(1, 3)

    for file, rows in ((1, 900), (2, 5), (3, 1), (4, 300)):
        put(file, 0, rows, 0)
    positions = [(i, R.randint(1, 5), R.randint(0, 950), R.choice([None, R.randint(0, 70)])) for i in range(1500)]
    s = spark.createDataFrame(symbols, "symbol_id long, file_id long, kind string, name string, start_row long, start_col long, end_row long, end_col long")
    p = spark.createDataFrame(positions, "position_id long, file_id long, row long, col long")

    def around(file, row, col):
        own = [x for x in symbols if x[1] == file and x[4] <= row <= x[6] and (col is None or (x[4] < row or x[5] <= col) and (x[6] > row or x[7] > col))]
        return [x[0] for x in sorted(own, key=lambda x: (x[6] - x[4], -x[4], -x[5], x[6], x[7], x[0]))]

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sweep.in_parts(s.select("file_id", F.col("start_row").alias("_row"), F.col("end_row").alias("_end"), "symbol_id"), ["file_id", "_row", "symbol_id"]).collect()
        assert len({r._part for r in rows if r.file_id == 1}) > 1 and 0 < sum(r._place < 0 for r in rows) < 60  # few copies
        got = {}
        for r in intervals.enclosing(p, s, 3).collect():
            got.setdefault(r.position_id, {})[r.level] = r.symbol_id
        want = {i: {k + 1: x for k, x in enumerate(around(f, row, col)[:3])} for i, f, row, col in positions}
        assert got == {i: x for i, x in want.items() if x}
        assert {r.position_id for r in intervals.outside(p, s).collect()} == {i for i, x in want.items() if not x}
        nest = {r.symbol_id: (r.parent_id, r.depth, r.root_id, r.qualified) for r in intervals.nested_by_stack(s).collect()}
        few = {r.symbol_id: (r.parent_id, r.depth, r.root_id, r.qualified) for r in sweep.nested(s.coalesce(1)).collect()}
        order = sorted(symbols, key=lambda x: (x[1], x[4], x[5], -x[6], -x[7], x[0]))
        plain, stack, last = {}, [], None
        for x in order:
            stack, last = ([], x[1]) if x[1] != last else (stack, last)
            while stack and stack[-1][6:8] < x[6:8]:
                stack.pop()
            plain[x[0]] = (stack[-1][0] if stack else None, len(stack) + 1, stack[0][0] if stack else x[0], ".".join([y[3] for y in stack] + [x[3]]) if stack else None)
            if x[2] != "import":
                stack.append(x)
        assert nest == few == plain
        roots = {r.symbol_id: r.root for r in intervals.outline_roots(intervals.nested_by_stack(s)).collect()}
        tops = {}
        for x in order:
            if plain[x[0]][1] == 1:
                tops.setdefault(x[1], []).append(x[0])
        assert roots == {i: tops[x[1]].index(plain[i][2]) for i, x in ((x[0], x) for x in symbols)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_of_three_byte_strings(spark, monkeypatch):
    import numpy as np

    from quarry.operators.ordered import landed
    from quarry.sources import ngrams, patterns
    from quarry.sources.patterns import captures

    for values in ([], [0], [5, 6, 300, 2**40, 2**62]):
        assert ngrams.unpacked(ngrams.packed(np.array(values, np.int64))).tolist() == values
    monkeypatch.setattr(ngrams, "SHARD", 500)
    texts = [f"def f{i}(x):\n    return {R.choice(['alpha', 'beta', 'gämma', 'x'])}(x, {i})\n" for i in range(300)] + ["", None, "ab", "z" * 2_000_000 + "alpha"]
    files = spark.createDataFrame([(i, None if t is None else bytearray(t.encode())) for i, t in enumerate(texts)] + [(3, bytearray(texts[3].encode()))], "file_id long, content binary").repartition(4)
    index = landed(ngrams.built(files), "grams")
    assert index.select("shard").distinct().count() > 10
    for literals in ([["alpha"]], [["beta", "return"], ["gämma"]], [["nowhere"]], [["f12", "x"]]):
        found = {r.file_id for r in ngrams.candidates(index, literals).collect()}
        need = lambda x: x.encode() if len(x.encode()) > 2 else b""
        strings = [[need(x)[k : k + 3] for x in own for k in range(len(need(x)) - 2)] for own in literals]
        assert found == {i for i, t in enumerate(texts) if t is not None and any(all(s in t.encode() for s in own) for own in strings)}
    assert ngrams.candidates(index, [["alpha"], ["ab"]]) is None
    plan = ngrams.candidates(index, [["alpha"]])._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan[plan.index("PushedFilters") :]
    # a pattern gives the same captures from what the index lets through
    pattern = '((call function: (identifier) @f) (#eq? @f "beta"))'
    needles = patterns.required_literals(patterns.compiled("python", pattern))
    small = files.where("file_id < 300").dropDuplicates(["file_id"])
    some = small.join(ngrams.candidates(index, needles), "file_id", "left_semi")
    key = lambda rows: sorted((r.file_id, r.text, r.start_row) for r in rows.collect())
    assert key(captures(some, "python", pattern)) == key(captures(small, "python", pattern)) != [] and some.count() < 150


def test_routes_over_links(spark):
    """Chains, folders that are links, cycles, growing paths and the limit of hops, against one file at a time."""
    import posixpath

    from quarry.sources import links as ln

    edges = {"a/.ignore": "../b/.ignore", "b": "c", "c/.ignore": "/abs/rules", "/abs": "/real", "x/.ignore": "y", "x/y": "z", "x/z": "y", "g/l": "l/l", "lost/.ignore": "nowhere/at/all"} | {f"n/{i}": f"{i + 1}" for i in range(60)}
    rules = [(f, p) for f, p in (("a", "a/.ignore"), ("b", "./b/.ignore"), ("x", "x/.ignore"), ("g", "g/l/.ignore"), ("n", "n/0"), ("m", "n/30"), ("lost", "lost/.ignore"), ("q", "q/.ignore"), ("none", None))] + [("a", "a/.ignore")]

    def walk(path):
        path, been, out = posixpath.normpath(path), [], []
        for _ in range(41):
            if path in been:
                break
            been.append(path)
            parts = path.split("/")
            hit = next((p for k in range(1, len(parts) + 1) if (p := "/".join(parts[:k])) in edges), None)
            out.append(hit or path)
            if hit is None:
                break
            path = posixpath.normpath(posixpath.join(posixpath.dirname(hit), edges[hit]) + path[len(hit) :])
        return set(out)

    frame = ln.routes(spark.createDataFrame(rules, "folder string, path string"), spark.createDataFrame([*edges.items(), ("b", "d"), (None, "x")], "path string, target string"))
    got = {}
    for r in frame.collect():
        got.setdefault(r.folder, set()).add(r.path)
    assert got == {f: walk(p) for f, p in rules if p}
    assert len(got["n"]) == 41 and "/abs" in got["a"] and "c/.ignore" in got["a"]
    changed = lambda *p: {r.folder for r in ln.governed(spark.createDataFrame([(x,) for x in p], "path string"), frame).collect()}
    assert changed("c") == {"a", "b"} and changed("b/.ignore") == set() and changed("lost/nowhere") == {"lost"} and changed("n/45") == {"m"} and changed("elsewhere", "q") == {"q"}
