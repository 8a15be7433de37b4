"""Operators: text functions, nesting by two ways, plans, ignore rules, votes, overlays, stores, the change feed."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import intervals, lookup, maintain, references, rollups
from tests.conftest import write_tree


def test_lines_and_snippets(spark):
    rows = [(1, "a\r\nb\n"), (2, "a\n\n"), (3, ""), (4, "x\u2028y\x0bz\nw")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", tx.lines(F.col("t")).alias("l"), tx.elided(tx.lines(F.col("t")), 1).alias("e"), tx.first_snippet(tx.lines(F.col("t"))).alias("s")).collect()
    assert [r.l for r in got] == [["a", "b"], ["a", ""], [], ["x\u2028y\x0bz", "w"]]
    assert got[0].e == "… 1 lines elided (2 total) …\nb" and got[2].s == "" and got[0].s == "a"


def test_snippets_are_trimmed(spark):
    rows = [(1, "  a b  \n"), (2, "\n  \n 0x0 \nb"), (3, "00\n11"), (4, "\ta ")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", tx.first_snippet(tx.lines(F.col("t"))).alias("s")).collect()
    assert {r.i: r.s for r in got} == {1: "a b", 2: "0x0", 3: "00", 4: "\ta"}


def test_snippets_beside_their_texts(spark, monkeypatch):
    """The same rows as by the join, without an exchange of texts or occurrences."""
    from quarry.functions import tokens

    monkeypatch.setattr(tokens, "GROUP", 40)
    texts = spark.createDataFrame([(1, "  A b\r\nc, d.\n\n e \n"), (2, ""), (3, None), (4, "\n\n"), (5, "ü x\ny\nz\n\nw 1 _v"), (6, "q " * 50), (7, "\r\n\n9a\r\n")], "file_id long, text string")
    lines = texts.select("file_id", tx.lines(F.col("text")).alias("lines"))
    for n in (1, 2, 3):
        want = references.with_snippets(tokens.with_occurrences(texts), lines, n)
        got = references.found_with_snippets(texts, n)
        assert want.count() == 61 and sorted(map(repr, (r.asDict() for r in got.select(*want.columns).collect()))) == sorted(map(repr, (r.asDict() for r in want.collect())))
        assert got.select(*want.columns).schema.simpleString() == want.schema.simpleString()
    from quarry.plans import catalogue

    for query in (catalogue.ref_snippet_one, catalogue.ref_snippet_block):
        shown = plan(query(spark, "/root/testdata/sf0.001"))
        assert "MapInArrow" in shown and "Join" not in shown and "hashpartitioning" not in shown


@pytest.mark.parametrize("n", [1, 2])
def test_snippets_are_written_once(spark, tmp_path, n):
    """All words of a line have its snippet, but what is written grows with the texts: snippets stay in Parquet's dictionaries."""
    r = random.Random(5)
    texts = [(i, "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(200))) for i in range(300)]
    found = references.found_with_snippets(spark.createDataFrame(texts, "file_id long, text string"), n)
    found.select("file_id", "start_row", "start_col", "snippet").write.option("compression", "none").parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300 * 200 * 20
    written = sum(os.path.getsize(f"{tmp_path}/out/{x}") for x in os.listdir(f"{tmp_path}/out"))
    assert written < 1.5 * (2 * n - 1) * sum(len(t) for _, t in texts)


def test_globs_and_paths(spark):
    yes = [("src/**", "src/a/b.py"), ("src/*.py", "src/a/b.py"), ("**/x.py", "x.py"), ("**/x.py", "a/b/x.py"), ("a?c", "abc"), ("[ab]*.{py,rs}", "b1.rs"), ("[!a]*", "bcd"), ("a/**/b", "a/b"), ("a/**/b", "a/x/y/b"), ("**", "any/thing"), ("src", "src/x")]
    no = [("src/*.py", "lib/a.py"), ("[!a]*", "abc"), ("{a,b}.py", "c.py"), ("src", "src2/x"), ("src/a", "src/A")]
    frame = spark.range(1)
    for pattern, path in yes + no:
        assert frame.select(tx.path_filter(F.lit(path), pattern)).first()[0] is ((pattern, path) in yes), (pattern, path)
    for bad in ("../x", "a/../../b"):
        with pytest.raises(ValueError):
            tx.normal_path(bad)
    assert tx.normal_path("/r/a/./b/", "/r") == "a/b" and tx.normal_path("./a/../c/") == "c"
    with pytest.raises(ValueError):
        tx.glob_regex("a[b")


def random_symbols(n, seed):
    r, out = random.Random(seed), []

    def grow(lo, hi, depth, f):
        at = lo
        while at < hi and len(out) < n:
            size = r.randrange(0, max(1, (hi - at) // 2 + 1))
            out.append((len(out), f, r.choice(["class", "function", "import"]), f"n{len(out)}", None, at, 0, at + size, 9))
            if size > 1 and depth < 4:
                grow(at + 1, at + size - 1, depth + 1, f)
            at += size + 1 + r.randrange(2)

    for f in range(4):
        grow(0, 60, 0, f)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_nesting_by_stack_and_by_join(spark, seed):
    kind = "symbol_id long, file_id long, kind string, name string, qualified string, start_row long, start_col long, end_row long, end_col long"
    rows = random_symbols(60, seed)
    frame = spark.createDataFrame(rows, kind)
    key = lambda df: sorted((r.symbol_id, r.parent_id, r.depth, r.root_id, r.qualified) for r in df.collect())
    by_join = key(intervals.nested(frame, F.col("kind") != "import"))
    assert by_join == key(intervals.nested_by_stack(frame))
    naive = {}
    for s in rows:
        above = sorted([(t[5], -t[7], t[0], t[3]) for t in rows if t[1] == s[1] and t[0] != s[0] and t[2] != "import" and (t[5], t[6]) <= (s[5], s[6]) and (t[7], t[8]) >= (s[7], s[8]) and ((t[5:] != s[5:]) or t[0] < s[0])])
        naive[s[0]] = ".".join([a[3] for a in above] + [s[3]]) if above else None
    assert {r[0]: r[4] for r in by_join} == naive


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    d = "/root/testdata/sf0.001"
    from quarry.plans import catalogue

    e = plan(catalogue.enclosing_trail(spark, d))
    assert "NestedLoop" not in e and "Cartesian" not in e and "MapInArrow" in e  # a sweep, not a join of positions with symbols
    assert "WindowGroupLimit" in plan(catalogue.symbol_fair_quota(spark, d))
    assert "TakeOrderedAndProject" in plan(catalogue.kinds_top12(spark, d))
    files = plan(catalogue.files_catalog(spark, d).select("file_id", "path"))
    assert "sha2" not in files and "ReadSchema: struct<doc_id:bigint,lang:string>" in files
    assert "Cartesian" not in plan(catalogue.overlay_files(spark, d)) and "LeftAnti" in plan(catalogue.overlay_files(spark, d))


def test_filters_reach_the_scan(spark, make_index):
    nav, builder, _ = make_index({"a": {"x.py": "def f():\n    return g()\n"}})
    repos, files, _, refs = nav.tables()
    assert "PushedFilters: [In(name, [f,g])" in plan(lookup.joined(refs, files, repos, ["f", "g"])) or "In(name" in plan(lookup.joined(refs, files, repos, ["f", "g"]))
    assert "docstring" not in plan(references.counts_by_name(lookup.joined(refs, files, repos, ["g"])))


def test_ladder_order(spark):
    kind = "repo_id long, path string, language string, mtime_ns long, byte_size long, readable boolean, binary boolean, sha string"
    walked = spark.createDataFrame([
        (1, "new", "py", 5, 5, True, False, "a"), (1, "gone", "py", 5, 5, False, False, ""), (1, "huge", "py", 5, 3 << 20, True, False, "a"), (1, "same", "py", 5, 5, True, True, "zz"), (1, "time", "py", 6, 5, True, False, "a"),
        (1, "poison", "py", 5, 5, True, False, "a"), (1, "lang", "py", 5, 5, True, False, "a"), (1, "bin", "py", 7, 5, True, True, "b"), (1, "base", "py", 7, 5, True, False, "shared"), (1, "sneaky", "py", 5, 5, True, False, "changed"),
    ], kind)
    stored = spark.createDataFrame([(1, p, "rb" if p == "lang" else "py", -1 if p == "poison" else 5, 5, "a") for p in ("same", "time", "poison", "lang", "bin", "base", "sneaky")], "repo_id long, path string, language string, mtime_ns long, byte_size long, sha string")
    base = spark.createDataFrame([("base", "py", "shared")], "path string, language string, sha string")
    got = {r.path: r.outcome for r in maintain.classified(walked, stored, base).collect()}
    assert got == {"new": "indexed", "gone": "unreadable", "huge": "binary", "same": "unchanged", "time": "touched", "poison": "indexed", "lang": "indexed", "bin": "binary", "base": "reused", "sneaky": "unchanged"}
    forced = {r.path: r.outcome for r in maintain.classified(walked, stored, force=True).collect()}
    assert forced["sneaky"] == "indexed" and forced["same"] == "binary"


def test_relevant_paths(spark):
    rows = ["src/a.py", "a/node_modules/b.js", ".git/HEAD", "x.tsbuildinfo", "d/.DS_Store", "w/.claude/worktrees/q/f.py", ".claude/settings.json", "tmp/x", "template/x", "coverage/i.html"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").where(maintain.relevant(F.col("p"))).collect()
    assert [r.p for r in got] == ["src/a.py", ".claude/settings.json", "template/x"]


def test_owning_repo_and_purge(spark):
    roots = spark.createDataFrame([("/a", "a"), ("/a/b", "b")], "root_path string, name string")
    paths = spark.createDataFrame([("/a/x",), ("/a/b/x",), ("/a/bc/x",), ("/z",)], "path string")
    assert {r.path: r.repo for r in maintain.owning_repo(paths, roots).collect()} == {"/a/x": "a", "/a/b/x": "b", "/a/bc/x": "a"}


def test_paths_below_one_root_are_shared_out(spark):
    """All paths lie below one root: the join's partitions hold about as many rows each."""
    paths = spark.range(20_000).select(F.concat(F.lit("srv/f"), F.col("id").cast("string")).alias("path"))
    roots = spark.createDataFrame([("srv", "top"), ("srv/f7", "seven"), ("other", "other")], "root_path string, name string")
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = maintain.owning_repo(paths, roots)
        assert {r.repo: r.n for r in found.groupBy("repo").agg(F.count("*").alias("n")).collect()} == {"top": 19_999, "seven": 1}
        joined = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(root_path" in joined and "_share" in joined.split("hashpartitioning(root_path")[1].split(")")[0]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ignore_rules(tmp_path):
    from quarry.sources.walk import Workspace, walk

    write_tree(tmp_path, {
        ".gitignore": "*.log\n/build\nsub/**/gen\n!keep.log\n# note\ndir/\n[ab].tmp\n", "a.log": "", "keep.log": "", "build/x": "", "src/build/x": "", "sub/q/gen/y": "", "sub/z": "", "dir/x": "", "src/dir": "", "a.tmp": "", "c.tmp": "", ".hidden": "",
        "deep/.gitignore": "!a.log\nlocal.txt\n", "deep/a.log": "", "deep/local.txt": "", "other/local.txt": "", ".ignore": "ignored.txt\n", "ignored.txt": "", ".git/info/exclude": "excluded\n", "excluded": "", "nested/own.py": "",
    })
    os.symlink(tmp_path / "sub", tmp_path / "link")
    got = walk(Workspace("w", str(tmp_path), foreign=(str(tmp_path / "nested"),)))
    assert got == sorted([".gitignore", ".hidden", ".ignore", "c.tmp", "deep/.gitignore", "deep/a.log", "keep.log", "other/local.txt", "src/build/x", "src/dir", "sub/z"])
    assert walk(Workspace("w", str(tmp_path)), ["src", "nested/own.py", "a.log"]) == ["nested/own.py", "src/build/x", "src/dir"]


def test_language_votes(spark):
    from quarry.sources.manifests import breakdown, votes

    assert breakdown(spark, [("pyproject.toml", "", b""), ("a.py", "python", b""), ("b.js", "javascript", b"")])[0]["language"] == "python"
    assert [x["files"] for x in breakdown(spark, [("x.csproj", "", b"")])] == [0]
    both = [("build.gradle.kts", "", b""), ("A.java", "java", b"")]
    assert ("kotlin", "manifest", 1) not in votes(both) and ("java", "manifest", 1) in votes(both)
    assert {x[0] for x in votes([("CMakeLists.txt", "", b""), ("a.c", "c", b"")])} == {"c"}
    assert ("python", "shebang", 1) in votes([("run", "python", b"#!/usr/bin/env python")]) and breakdown(spark, []) == []


def test_worktrees(tmp_path):
    from quarry.sources.worktrees import discover, named, selected

    write_tree(tmp_path, {"main/.git/HEAD": "x", "main/.git/worktrees/w1/gitdir": str(tmp_path / "alpha/.git"), "main/.git/worktrees/w1/commondir": "../..", "main/.git/worktrees/dead/gitdir": str(tmp_path / "nowhere/.git"), "alpha/.git": f"gitdir: {tmp_path}/main/.git/worktrees/w1\n"})
    for start in ("main", "alpha"):
        assert [c.name for c in discover(str(tmp_path / start))] == ["alpha", "main"]
    assert [c.name for c in named([("/a/x", "x", "1"), ("/b/x", "x", "2"), ("/c/x", "x", "2")])] == ["x", "x@2", "x@2"] or [c.name for c in named([("/a/x", "x", "1"), ("/b/x", "x", "2"), ("/c/x", "x", "2")])][2] != "x@2"
    assert [c.name for c in named([("/a/x", "x", "1"), ("/b/x", "x", "2"), ("/c/x", "x", "2"), ("/d/y", "y", "")])] == ["x@1", "x@2", "x@2@2", "y"]
    assert [c.name for c in named([("/a/x", "x", ""), ("/b/x", "x", "main"), ("/c/x@main", "x@main", "3")])] == ["x@main", "x@main@2", "x@main@3"]
    with pytest.raises(ValueError):
        selected(discover(str(tmp_path / "main")), "nope")
    assert discover(str(tmp_path)) == []


def test_config_and_logs(spark, tmp_path):
    from quarry.model import InvalidArguments, Limits
    from quarry.sources.config import Config, allowed_languages, append_log, read_log

    path = str(tmp_path / "c.toml")
    c = Config.load_or_default(path)
    c.add("a", "/x")
    with pytest.raises(InvalidArguments):
        c.add("a", "/y")
    c.write(path)
    assert Config.load(path) == c and Limits().results(None) == 200 and Limits().results(10**6) == 300 and Limits().results(0) == 1 and Limits().body_lines(None) == 120
    with pytest.raises(InvalidArguments):
        allowed_languages(["cobol"], None, c)
    log = str(tmp_path / "log.jsonl")
    append_log(log, {"repo": "r", "session": "s", "ts": 5, "avoided": 100, "returned": 10, "saved": 90})
    with open(log, "a") as f:
        f.write("{broken\n")
    append_log(log, {"repo": "r", "session": "t", "ts": 9, "calls": 3, "saved": 10})
    row = rollups.savings(read_log(spark, log)).first()
    assert (row.calls, row.saved, row.sessions, row.last_ts) == (4, 100, 2, 9)


def test_overlay_follows_a_sequence(spark, tmp_path):
    """The merged view equals a full index of the checkout after every step."""
    from quarry.plans.build import Builder, Overlay
    from quarry.plans.store import Store
    from quarry.sources.config import Config, Repo

    start = {"shared.py": "def shared():\n    return 1\n", "change.py": "def change():\n    return shared()\n", "remove.py": "def remove():\n    return 2\n"}
    store = lambda n: (os.makedirs(tmp_path / n, exist_ok=True), Store(spark, "file://" + str(tmp_path / n)))[1]
    write_tree(tmp_path / "main", start)
    write_tree(tmp_path / "alpha", start)
    base = store("base")
    Builder(spark, base, Config([Repo("main", str(tmp_path / "main"))])).build()
    config = Config([Repo("alpha", str(tmp_path / "alpha"))])
    over = Overlay(spark, base, store("over"), config)

    def check(publish=True):
        assert over.refresh() is publish
        full = store(f"full-{time.time_ns()}")
        Builder(spark, full, config).build()
        for table, columns in (("files", ["path", "sha", "language"]), ("symbols", ["name", "kind", "start_row"]), ("refs", ["name", "context", "start_row"])):
            key = lambda df, c=columns: sorted(tuple(r) for r in df.select(*c).collect())
            assert key(over.read(table)) == key(full.read(table)), table
        return over.own.read("files").count()

    assert check() == 0
    assert check(publish=False) == 0
    write_tree(tmp_path / "alpha", {"change.py": "def changed():\n    return 3\n", "extra.py": "def extra(): pass\n"})
    os.unlink(tmp_path / "alpha/remove.py")
    assert check() == 2
    assert {r.file_id < 0 for r in over.read("files").where("path = 'shared.py'").collect()} == {True}
    write_tree(tmp_path / "alpha", start | {".gitignore": "shared.py\n"})
    os.unlink(tmp_path / "alpha/extra.py")
    assert check() == 0


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_overlay_directory_and_recovery(spark, tmp_path):
    """Reads with and without the directory agree; a base that is gone, replaced or old makes the checkout stand alone."""
    import shutil

    from quarry.model import InvalidArguments
    from quarry.plans.build import Builder, Overlay
    from quarry.plans.store import Store
    from quarry.sources.config import Config, Repo

    tree = {"a.py": "def one():\n    return 1\n", "b.py": "def two():\n    return one()\n", "c.py": "def three(): pass\n"}
    store = lambda n: (os.makedirs(tmp_path / n, exist_ok=True), Store(spark, "file://" + str(tmp_path / n)))[1]
    columns = {"files": ["path", "sha"], "symbols": ["name", "kind", "start_row"], "refs": ["name", "context", "start_row"]}
    main, alpha = Config([Repo("main", str(tmp_path / "main"))]), Config([Repo("alpha", str(tmp_path / "alpha"))])
    write_tree(tmp_path / "main", tree)
    write_tree(tmp_path / "alpha", tree | {"b.py": "def deux():\n    return one()\n"})

    def derived(name, before):
        base = store("base-" + name)
        Builder(spark, base, main).build()
        over = Overlay(spark, base, store("over-" + name), alpha)
        assert over.refresh()
        seen = {t: rows_of(over.read(t), *c) for t, c in columns.items()}
        if before:
            m = json.loads(over.own._text("CURRENT"))
            over.own._write("CURRENT", json.dumps(m | {"directory": 0}))
            assert over.directory() is None and seen == {t: rows_of(over.read(t), *c) for t, c in columns.items()}
            over.own._write("CURRENT", json.dumps(m))
        return base, over, seen

    def alone(over, seen):
        assert over.refresh() and over.manifest().base == "" and over.read("files").where("file_id < 0").count() == 0
        assert seen == {t: rows_of(over.read(t), *c) for t, c in columns.items()}
        assert not over.refresh() and over.directory() is None

    base, over, seen = derived("gone", True)
    with pytest.raises(InvalidArguments):
        Overlay(spark, base, over.own, Config([Repo("beta", str(tmp_path / "alpha"))])).refresh(prune=False)
    assert over.manifest().base and not over.refresh()
    shutil.rmtree(tmp_path / "base-gone")
    alone(over, seen)

    base, over, seen = derived("replaced", False)
    write_tree(tmp_path / "main", {"d.py": "def four(): pass\n"})
    Builder(spark, base, main).build()
    with pytest.raises(RuntimeError, match="refresh"):
        over.read("files")
    alone(over, seen)

    base, over, seen = derived("old", False)
    base._write("CURRENT", json.dumps(json.loads(base._text("CURRENT")) | {"schema_version": 4}))
    alone(over, seen)


def test_savings_of_folders_and_command_uses(spark, tmp_path):
    from quarry.sources.config import command_uses

    log = spark.createDataFrame([("h_x", 2, "late", 1, 9, 1, 5, 1, 4), ("h_x", 1, "", 1, 3, 1, 5, 1, 4), ("h_x", 3, "x", 2, 4, 2, 0, 0, 0), ("g_y", 1, None, None, 1, 1, 1, 1, 1)], "folder string, seq long, repo string, session long, ts long, calls long, avoided long, returned long, saved long")
    earlier = spark.createDataFrame([("h_x", 20, 10, 1, 1, 1000), ("only_z", 7, 1, 2, 3, 4)], "folder string, ts long, calls long, avoided long, returned long, saved long")
    found = {r.folder: (r.repo, r.calls, r.avoided, r.returned, r.saved, r.last_ts, r.sessions) for r in rollups.savings_by_folder(log, earlier).collect()}
    assert found == {"h_x": ("late", 14, 11, 3, 1008, 20, 2), "g_y": ("y", 1, 1, 1, 1, 1, 0), "only_z": ("z", 1, 2, 3, 4, 7, 0)}
    assert rollups.savings_by_folder(log.limit(0), earlier.limit(0)).count() == 0
    write_tree(tmp_path, {".claude/a.md": "/find $find quarry find find", ".claude/.hidden/x": "/find", ".claude/target/x": "/find", ".quarry/log": '{"command":"find"}', ".quarry/b.bin": b"\xff/find", ".gemini": "$find", "other/x": "/find", "more": "/find"})
    os.symlink(tmp_path / "other", tmp_path / ".codex")
    os.symlink(tmp_path / "other/x", tmp_path / ".claude/link")
    assert command_uses(str(tmp_path), "find") == 5 and command_uses(str(tmp_path), "find", (str(tmp_path / "more"), str(tmp_path / "none"))) == 6


def test_store_and_old_schema(spark, make_index):
    nav, builder, _ = make_index({"a": {"x.py": "def f(): pass\n"}})
    m = json.loads(nav.index._text("CURRENT"))
    m["schema_version"] = 4
    nav.index._write("CURRENT", json.dumps(m))
    assert builder.build().indexed == 1 and nav.index.manifest().schema_version == 5
    m["schema_version"] = 99
    nav.index._write("CURRENT", json.dumps(m))
    with pytest.raises(RuntimeError):
        nav.index.manifest()


def test_change_feed(spark, make_index, tmp_path):
    from quarry.model import SymbolArgs
    from quarry.streaming.feed import events, follow

    nav, builder, roots = make_index({"a": {"x.py": "def f(): pass\n", "y.py": "def g(): pass\n"}})
    feed = tmp_path / "events"
    feed.mkdir()

    def send(name, rows):
        (feed / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        follow(builder, events(spark, str(feed)), str(tmp_path / "checkpoint"), once=True).awaitTermination()

    before = nav.index.manifest().generation
    write_tree(roots["a"], {"x.py": "def f2(): pass\n"})
    send("0.json", [{"at": 1, "path": roots["a"] + "/x.py", "kind": "access"}, {"at": 1, "path": roots["a"] + "/node_modules/z.js", "kind": "modify"}])
    assert nav.index.manifest().generation == before
    send("1.json", [{"at": 2, "path": roots["a"] + "/x.py", "kind": "modify"}] * 3)
    assert nav.index.manifest().generation == before + 1 and nav.get_symbol(SymbolArgs(name="f2"))["total"] == 1
    write_tree(roots["a"], {"y.py": "def g2(): pass\n"})
    send("2.json", [{"at": 3, "path": None, "kind": "overflow"}])
    assert nav.get_symbol(SymbolArgs(name="g2"))["total"] == 1
    send("3.json", [{"at": 4, "path": roots["a"] + "/y.py", "kind": "modify"}])
    assert nav.index.manifest().generation == before + 2


def test_patterns():
    from quarry.sources.extract.trees import tree_of
    from quarry.sources.patterns import PatternError, capture_stream, parsed, required_literals

    def run(text, data=b"import os\ndef f(a, b):\n    return g(a, h(1))\nx = 'lit'\ng(2)\n"):
        t = tree_of("python", data)
        return [(n, t.source.of(node)) for n, node in capture_stream(parsed(text), t)]

    assert run("(call function: (identifier) @f)") == [("f", "g"), ("f", "h"), ("f", "g")]
    assert run('((identifier) @i (#match? @i "^[gh]$") (#not-eq? @i "h"))') == [("i", "g"), ("i", "g")]
    assert run("(argument_list . (_) @first)") == [("first", "a"), ("first", "1"), ("first", "2")]
    assert run("(argument_list (_) @last .)") == [("last", "h(1)"), ("last", "1"), ("last", "2")]
    assert run("(parameters (identifier)* @all)") == [("all", "a"), ("all", "b")]
    assert run("[(string) @s (integer) @n]") == [("n", "1"), ("s", "'lit'"), ("n", "2")]
    assert run('((identifier) @i (#any-of? @i "x" "h"))') == [("i", "h"), ("i", "x")]
    for bad in ("(call", "", "(call) (#eq? @x 'y')", '((call) @c (#eq? @d "x"))', ")"):
        with pytest.raises(PatternError):
            parsed(bad)
    assert required_literals(parsed('((identifier) @i (#eq? @i "a\\"b"))')) == [['a"b']]
    assert required_literals(parsed('((call (identifier)? @i) (#eq? @i "a"))')) == [] and required_literals(parsed('[((identifier) @i) (string)] @x')) == []


SMALL = "/root/testdata/sf0.001"


def test_catalogue_against_sql(spark):
    """All queries with SQL give the same rows, on the smallest tables."""
    import duckdb

    from quarry.plans import catalogue

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    assert set(catalogue.SQL) == set(catalogue.QUERIES)
    for name, query in catalogue.QUERIES.items():
        want = con.sql(catalogue.SQL[name])
        got = query(spark, SMALL)
        assert sorted(got.columns) == sorted(want.columns), name
        assert sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect()) == sorted(map(repr, want.fetchall())), name


def test_snapshots_markers_and_aliases(spark, make_index, tmp_path):
    from quarry.plans.wire import aliased

    nav, builder, roots = make_index({"a": {"x.py": "def f(): pass\n"}})
    assert builder.refresh(60_000).skipped == 1 and builder.refresh(60_000) is None and builder.refresh(0) is not None
    write_tree(roots["a"], {"y.py": "def g(): pass\n"})
    assert builder.refresh(60_000) is None
    assert nav.index.sizes()["files"] > 0
    target = "file://" + str(tmp_path / "base")
    os.makedirs(tmp_path / "base")
    copy = nav.index.snapshot(target)
    assert len(copy.manifest().identity) == 64 and copy.read("symbols").count() == nav.index.read("symbols").count()
    with pytest.raises(FileExistsError):
        nav.index.snapshot(target)
    assert aliased({"repo": "a", "groups": [{"repo": "a", "file": "a"}, {"repo": "b"}]}, {"a": "z"}) == {"repo": "z", "groups": [{"repo": "z", "file": "a"}, {"repo": "b"}]}


def test_long_texts_in_pieces():
    """A text is scanned in pieces: the same occurrences, in memory that doesn't grow with its length."""
    import tracemalloc

    import numpy as np

    from quarry.functions import tokens

    odd = np.frombuffer("Ab, \t Cd9x.\n 9Ef, _g\r\n é Hi\n\n\tJk Lm.".encode(), np.uint8)
    for limit in (1, 2, 5, 100):
        got = list(tokens.occurrences_in_pieces(odd, limit))
        for j, whole in enumerate(tokens.occurrences(odd)):
            if j > 1:
                assert np.concatenate([x[j] for _, x in got]).tolist() == whole.tolist()
        assert b"".join(tokens.spelled(p, x[0], x[1]).tobytes() for p, x in got) == b"AbCd9xEf_gHiJkLm"
    peaks = []
    for n in (100_000, 800_000):
        data = np.frombuffer(b"Some words, " * n, np.uint8)
        tracemalloc.start()
        assert sum(len(x[0]) for _, x in tokens.occurrences_in_pieces(data)) == 2 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] and peaks[1] < 64 << 20
    # no line end for megabytes: what stands before in the line is carried on, not read again
    assert [x[4].tolist() for _, x in tokens.occurrences_in_pieces(np.frombuffer(b" " * 300_000 + b"Abc  Def", np.uint8), 1000) if len(x[0])] == [[3, 4]]


def test_arrow_batches_are_bounded(spark):
    """Texts go to Python in batches of bounded bytes, not of ten thousand rows whatever their size."""
    from quarry.functions import tokens

    before = spark.conf.get(tokens.BATCH, None)
    spark.conf.unset(tokens.BATCH)
    try:
        tokens.with_occurrences(spark.createDataFrame([(1, "a b")], "file_id long, text string"))
        assert spark.conf.get(tokens.BATCH, None) == tokens.BATCH_BYTES
    finally:
        spark.conf.set(tokens.BATCH, before) if before else spark.conf.unset(tokens.BATCH)
