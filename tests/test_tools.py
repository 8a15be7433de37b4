"""Query operators over small repositories that the tests write."""

import os
import time

import pytest

from quarry.model import EnclosingArgs, InvalidArguments, OutlineArgs, QueryArgs, ReferenceArgs, ReplaceArgs, SymbolArgs, from_json
from tests.conftest import write_tree

NESTED = "class Outer:\n    def method_a(self):\n        local = 1\n        return local\n\n    class Inner:\n        def method_b(self):\n            return 2\n\nx = 1\n"
DECORATED = "@dataclass\nclass User:\n    name: str\n\n    @cached\n    @property\n    def status(self):\n        return 1\n"


def test_lookup_outline_and_refs(make_index):
    nav, builder, roots = make_index({"app": {
        "src/login.py": 'class Login:\n    """Logs in."""\n    def check(self, name):\n        return name\n\ndef run():\n    return Login().check("x")\n',
        "tests/test_login.py": "from src.login import Login\n\ndef test_it():\n    assert Login().check(1)\n", "src/nested.py": NESTED, "src/deco.py": DECORATED,
        "src/bad.py": "value = (\nalpha()\n", "notes.txt": "nothing", ".gitignore": "skipped/\n", "skipped/z.py": "def hidden(): pass\n",
    }})
    assert nav.stats.indexed == 5 and nav.stats.failed == 0
    found = nav.get_symbol(SymbolArgs(name="check", include_body=True))
    assert found["total"] == 1 and found["repo"] == "app" and found["matches"][0]["qualified"] == "Login.check" and found["matches"][0]["range"] == [3, 4, 4, 19]
    assert found["matches"][0]["body"] == "    def check(self, name):\n        return name"
    assert nav.get_symbol(SymbolArgs(name="Login"))["matches"][0]["docstring"] == "Logs in."
    assert nav.get_symbol(SymbolArgs(name="hidden"))["total"] == 0
    outline = nav.list_file_outline(OutlineArgs(file="src/nested.py", depth=3))
    assert [s["name"] for s in outline["symbols"]] == ["Outer", "x"] and outline["total"] == 2
    assert [c["name"] for c in outline["symbols"][0]["children"]] == ["method_a", "Inner"]
    assert "children" not in nav.list_file_outline(OutlineArgs(file="src/nested.py", depth=1))["symbols"][0]
    with pytest.raises(LookupError):
        nav.list_file_outline(OutlineArgs(file="none.py"))
    refs = nav.find_references(ReferenceArgs(name="check"))
    assert refs["total"] == 2 and refs["total_files"] == 2 and refs["partial"] is False if "partial" in refs else refs["total"] == 2
    assert nav.find_references(ReferenceArgs(name="check", include_declarations=True))["total"] == 3
    assert nav.find_references(ReferenceArgs(name="check", exclude_tests=True))["total"] == 1
    assert nav.find_references(ReferenceArgs(name="check", scope="src"))["groups"][0]["refs"][0]["snippet"] == 'return Login().check("x")'
    block = nav.find_references(ReferenceArgs(name="check", scope="tests/", snippet_lines=2, group_by_file=False))["refs"][0]
    assert block["snippet_start_row"] == 3 and block["snippet"].split("\n")[0] == "def test_it():"
    counts = nav.find_references(ReferenceArgs(names=["check", "Login"], counts_only=True))
    assert counts["names"] == [{"name": "Login", "count": 3}, {"name": "check", "count": 2}] and counts["total"] == 5
    assert nav.find_references(ReferenceArgs(name="alpha", counts_only=True))["partial"] is True
    # decorators belong to the range
    assert nav.get_symbol(SymbolArgs(name="User"))["matches"][0]["range"][0] == 1
    assert nav.get_symbol(SymbolArgs(name="status"))["matches"][0]["range"][0] == 5
    # enclosing: innermost, trails, points, nothing
    inner = nav.enclosing_symbol(EnclosingArgs(file="src/nested.py", row=8, depth=3))
    assert [m["name"] for m in inner["matches"]] == ["Outer", "Inner", "method_b"]
    assert [m["name"] for m in nav.enclosing_symbol(EnclosingArgs(file="src/nested.py", row=3))["matches"]] == ["local"]
    far = nav.enclosing_symbol(EnclosingArgs(file="src/nested.py", row=10, col=99))
    assert far["matches"][0]["name"] == "x" and far["diagnostics"][0]["code"] == "col_ignored"
    assert nav.enclosing_symbol(EnclosingArgs(file="src/nested.py", row=9))["diagnostics"][0]["code"] == "no_enclosing_symbol"
    batch = nav.enclosing_symbol(EnclosingArgs(file="src/nested.py", rows=[8, 9, 8], limit=2))
    assert batch["total"] == 3 and batch["next_offset"] == 2 and [r["row"] for r in batch["results"]] == [8, 9] and batch["results"][1]["diagnostics"]
    with pytest.raises(ValueError):
        nav.enclosing_symbol(EnclosingArgs(file="src/nested.py", row=0))
    # kinds and filters
    with pytest.raises(InvalidArguments, match="known"):
        nav.get_symbol(SymbolArgs(name="check", kind="nope"))
    lost = nav.get_symbol(SymbolArgs(name="check", kind="class"))
    assert lost["diagnostics"][0]["kinds"] == {"function": 1} and lost["matches"] == []
    assert "diagnostics" not in nav.get_symbol(SymbolArgs(name="absent", kind="class"))
    for scope in ("src", "src/", "./src", "src/**", roots["app"] + "/src", "src/login.py"):
        assert nav.find_references(ReferenceArgs(name="check", scope=scope))["total"] == 1, scope
    assert nav.find_references(ReferenceArgs(name="check", scope="scr"))["diagnostics"][0]["code"] == "filter_matched_no_files"
    with pytest.raises(InvalidArguments):
        nav.find_references(ReferenceArgs(name="check", scope="/nowhere/at/all"))
    with pytest.raises(InvalidArguments):
        from_json(SymbolArgs, {"nam": "x"})
    # stale sources
    path = os.path.join(roots["app"], "src/login.py")
    with open(path) as f:
        text = f.read()
    with open(path, "w") as f:
        f.write("# new first line\n" + text)
    moved = nav.get_symbol(SymbolArgs(name="check", include_body=True))["matches"][0]
    assert moved["stale"] is True and moved["body"].startswith("    def check")
    stale = nav.find_references(ReferenceArgs(name="check", scope="src"))
    assert stale["partial"] is True and "snippet_unavailable" in stale["groups"][0]["refs"][0]
    # incremental: one file changed, the rest is left alone
    assert vars(builder.build()) == {"indexed": 1, "touched": 0, "skipped": 4, "failed": 0}
    assert vars(builder.build()) == {"indexed": 0, "touched": 0, "skipped": 5, "failed": 0}
    generation = nav.index.manifest().generation
    os.utime(path, ns=(time.time_ns() + 10**9, time.time_ns() + 10**9))
    assert builder.build().touched == 1 and nav.index.manifest().generation == generation + 1
    os.unlink(path)
    write_tree(roots["app"], {"src/more.py": "def extra(): return check()\n"})
    assert builder.update([path, os.path.join(roots["app"], "src/more.py")]).indexed == 1
    assert nav.get_symbol(SymbolArgs(name="run"))["total"] == 0 and nav.get_symbol(SymbolArgs(name="extra"))["total"] == 1
    write_tree(roots["app"], {".gitignore": "skipped/\nsrc/more.py\n"})
    builder.update([os.path.join(roots["app"], ".gitignore")])
    assert nav.get_symbol(SymbolArgs(name="extra"))["total"] == 0


def test_paging_walks_have_no_gaps(make_index):
    files = {f"m{i:02}.py": f"from d import target\n\ndef f{i}():\n    return target({i})\n" for i in range(30)}
    nav, _, _ = make_index({"a": files | {"d.py": "def target(n):\n    return n\n"}}, max_response_chars=2500)
    seen, offset = [], 0
    for _ in range(80):
        page = nav.find_references(ReferenceArgs(name="target", offset=offset))
        assert len(__import__("json").dumps(page, separators=(",", ":"))) <= 2500
        seen += [(g["file"], r["range"][0]) for g in page["groups"] for r in g["refs"]]
        assert page["total"] == 60 and page["total_files"] == 30
        if not page["truncated"]:
            assert "warning" not in page
            break
        offset = page["next_offset"]
    assert len(seen) == len(set(seen)) == 60
    names = [f"f{i}" for i in range(30)]
    page = nav.get_symbol(SymbolArgs(names=names[:5], limit=3))
    assert [m["name"] for m in page["matches"]] == names[:5] and not page["truncated"]
    found, offset = 0, 0
    while True:
        q = nav.query(QueryArgs(query="(function_definition) @f", language="python", offset=offset))
        found += len(q["captures"])
        if not q["truncated"]:
            break
        offset = q["next_offset"]
    assert found == 31


def test_patterns_prefilter_and_errors(make_index):
    nav, _, _ = make_index({"w": {"a.ts": "function f() { return target(); }\n", "b.tsx": "target();\n", "c.ts": "other();\n", "p.py": "def target():\n    return 1\n"}})
    q = nav.query(QueryArgs(query='((call_expression function: (identifier) @c) (#eq? @c "target"))', languages=["typescript", "tsx"]))
    assert [(c["file"], c["text"]) for c in q["captures"]] == [("a.ts", "target"), ("b.tsx", "target")]
    assert q["files_scanned"] == 3 and q["files_parsed"] == 2
    broken = nav.query(QueryArgs(query="(call_expression) @c", languages=["typescript", "python"]))
    assert broken["diagnostics"][0]["code"] == "query_compile_failed" and broken["captures"]
    with pytest.raises(InvalidArguments):
        nav.query(QueryArgs(query="(call_expression", language="typescript"))
    alternatives = nav.query(QueryArgs(query='[(function_definition name: (identifier) @n) (call function: (identifier) @n)]', language="python", capture="n"))
    assert [c["text"] for c in alternatives["captures"]] == ["target"]


def test_replace(make_index):
    nav, _, roots = make_index({"r": {"a.py": "def one():\r\n    return 1\r\n\r\ndef two():\r\n    return 2\r\n", "b.py": "class A:\n    def m(self): return 1\nclass B:\n    def m(self): return 2\n"}})
    done = nav.replace_symbol(ReplaceArgs(file="a.py", name="one", new_body="def one():\n    return 11\n"))
    assert done["old_range"][0] == 1 and done["new_range"][2] == 2
    with open(os.path.join(roots["r"], "a.py"), "rb") as f:
        assert f.read() == b"def one():\r\n    return 11\r\n\r\ndef two():\r\n    return 2\r\n"
    with pytest.raises(LookupError, match="not one symbol"):
        nav.replace_symbol(ReplaceArgs(file="b.py", name="m", new_body="    def m(self): return 3"))
    nav.replace_symbol(ReplaceArgs(file="b.py", name="m", qualified="B.m", new_body="    def m(self): return 3"))
    with pytest.raises(ValueError, match="syntax"):
        nav.replace_symbol(ReplaceArgs(file="a.py", name="two", new_body="def two(:\n    return"))
    with pytest.raises(LookupError):
        nav.replace_symbol(ReplaceArgs(file="../x.py", name="two", new_body=""))


def test_several_repos_and_dashboard(make_index):
    nav, builder, roots = make_index({"a": {"x.py": "def same():\n    return 1\n"}, "b": {"x.py": "same()\n", "lib.rs": "fn same() { other() }\n"}})
    assert {m["repo"] for m in nav.get_symbol(SymbolArgs(name="same"))["matches"]} == {"a", "b"}
    assert nav.get_symbol(SymbolArgs(name="same", repo="b"))["language"] == "rust"
    with pytest.raises(LookupError, match="several"):
        nav.list_file_outline(OutlineArgs(file="x.py"))
    board = nav.dashboard()
    assert board["totals"]["files"] == 3 and [r["repo"] for r in board["repos"]] == ["a", "b"]
    builder.config.remove("a")
    builder.build()
    assert nav.get_symbol(SymbolArgs(name="same"))["total"] == 1


def test_few_rows_need_no_python_workers(spark, tmp_path):
    """Rows that the driver holds are a local table, and where no source is live nothing is hashed: neither starts Python
    workers beside the scanner's."""
    from quarry.operators import ordered
    from quarry.plans import catalogue_tools
    from quarry.plans.tools import Navigator

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [("b", 2, None, True), ("a", 1 << 40, "é", False)]
    for some in (rows, []):
        found = catalogue_tools.rows_of(spark, some, "name string, n long, note string, fits boolean")
        assert plan(found).startswith("LocalTableScan") and [tuple(r) for r in found.collect()] == some
        assert found.dtypes == [("name", "string"), ("n", "bigint"), ("note", "string"), ("fits", "boolean")]
    whole = ordered.ordered(spark.range(100), ["id"])
    assert "ExistingRDD" not in plan(whole.numbered()) and [(r.id, r.ordinal) for r in whole.page(40, 3).orderBy("id").collect()] == [(40, 40), (41, 41), (42, 42)]
    # without live sources every file is stale; with them only those that changed or are gone
    (tmp_path / "same").write_bytes(b"x" * 3_000_000)
    (tmp_path / "other").write_bytes(b"y")
    sha = __import__("hashlib").sha256(b"x" * 3_000_000).hexdigest()
    refs = spark.createDataFrame([("r", p, sha) for p in ("same", "other", "gone", "same")] + [("lost", "same", sha)], "repo string, path string, sha string")
    bare, live = Navigator(spark, None, {}), Navigator(spark, None, {"r": str(tmp_path)})
    assert "MapInArrow" not in plan(bare.unverified(refs)) and bare.any_stale(refs)
    assert bare.stale_files(refs, [("r", "same"), ("r", "no")]) == {("r", "same")}
    assert {tuple(r) for r in live.unverified(refs).collect()} == {("r", "other"), ("r", "gone"), ("lost", "same")}
    assert live.any_stale(refs) and not live.any_stale(refs.where("path = 'same' AND repo = 'r'")) and not live.any_stale(refs.where("false"))


def test_patterns_over_a_table_are_whole(spark, tmp_path, monkeypatch):
    """Every source of a table is matched, whatever the time budget, also one whose repository has no name or no number."""
    import duckdb
    from pyspark.sql import functions as F

    from quarry.model import Limits
    from quarry.plans import catalogue, catalogue_tools

    given = f"{tmp_path}/documents.parquet"
    os.symlink("/root/testdata/sf0.001/conversations.parquet", f"{tmp_path}/conversations.parquet")
    odd = F.when(F.col("doc_id") % 7 == 3, F.lit(None)).when(F.col("doc_id") % 7 == 5, "web").otherwise(F.col("source"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", odd).write.parquet(given)
    monkeypatch.setattr(catalogue_tools, "Limits", lambda **k: Limits(**{"query_timeout_ms": 0} | k))
    got = sorted(tuple(r) for r in catalogue_tools.tool_query(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{given}/*.parquet'")
    assert len(got) == 60 and got == sorted(con.execute(catalogue.SQL["tool_query"]).fetchall())


def test_time_budget_is_for_live_sources(spark, make_index):
    """Without time, live sources give an error; a table of the same sources gives its captures, and nothing stays on disk."""
    from quarry.model import Limits
    from quarry.plans.tools import Navigator

    files = {f"p{i}.py": f"def f{i}():\n    return 1\n" for i in range(4)}
    nav, _, roots = make_index({"w": files}, query_timeout_ms=0)
    asked = QueryArgs(query="(function_definition name: (identifier) @n)", language="python", offset=1)
    with pytest.raises(TimeoutError):
        nav.query(asked)
    table = spark.createDataFrame([("w", path, text) for path, text in files.items()], "repo string, path string, content string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = Navigator(spark, nav.index, roots, Limits(query_timeout_ms=0), table).query(asked)
    assert [c["text"] for c in found["captures"]] == ["f1", "f2", "f3"] and not found["truncated"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
