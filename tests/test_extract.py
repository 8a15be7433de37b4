"""Extraction over inline sources: kinds, ranges, qualified names, occurrences and their contexts."""

import pytest

from quarry.sources.extract.symbols import parse, rows_of
from quarry.sources.languages import BY_ID, LANGUAGES, detect, shebang_language


def symbols(language, text):
    found, _, _, source = parse(language, text.encode())
    return [(s.kind, s.name) for s in found]


def refs(language, text):
    return [(r.name, r.context) for r in parse(language, text.encode())[1]]


#: A small program for each language: the name that is defined once and used, the row of its definition, how often it is
#: used, and another name that is only used.
PROGRAMS = {
    "c": ("#include <math.h>\nstatic double area(double r)\n{\n  return 3.0 * pow(r, 2);\n}\ndouble both(double x, double y) { return area(x) + area(y); }\n", "area", 1, 2, "pow"),
    "cpp": ("#include <vector>\nstruct Meter {\n  int level = 0;\n};\nstd::vector<Meter> shelf;\nMeter spare() { return Meter{}; }\n", "Meter", 1, 3, "std"),
    "go": ("package tide\n\nfunc rise(level int) int {\n\treturn level + 1\n}\n\nfunc Flood(days int) int {\n\tfor days > 0 {\n\t\tdays = rise(days)\n\t}\n\treturn rise(0)\n}\n", "rise", 2, 2, "days"),
    "ruby": ("require 'set'\n\nclass Basket\n  def fill(n)\n    Set.new([n])\n  end\nend\n\nBasket.new.fill(2)\nputs Basket\n", "Basket", 2, 2, "Set"),
    "kotlin": ("package lamp\n\nfun dim(by: Int): Int {\n  return by - 1\n}\n\nval evening = dim(dim(9))\n", "dim", 2, 2, "Int"),
    "swift": ("import Foundation\n\nfunc knead(_ hours: Int) -> Int {\n  return hours * 2\n}\n\nlet loaf = knead(3)\n", "knead", 2, 1, "Int"),
    "php": ("<?php\nnamespace Bakery;\n\nfunction price($grams) {\n  return round($grams / 7);\n}\n\necho price(10) + price(20);\n", "price", 3, 2, "round"),
    "javascript": ("const fs = require('fs');\n\nfunction paint(wall) {\n  fs.log(wall);\n}\n\n[1, 2].map(paint);\npaint(0);\n", "paint", 2, 2, "log"),
    "java": ("package harbour;\n\nclass Crane {\n  void lift(int tons) {\n    if (tons > 1) {\n      lift(tons - 1);\n      lift(1);\n    }\n  }\n}\n", "lift", 3, 2, "tons"),
    "python": ("import heapq\n\n\ndef nearest(stops, k):\n    return heapq.nsmallest(k, stops)\n\n\nprint(nearest([3, 1], 1), nearest)\n", "nearest", 3, 2, "nsmallest"),
    "rust": ("use std::fmt;\n\nstruct Kite {\n    line: u32,\n}\n\nfn fly(k: Kite) -> Kite {\n    k\n}\n", "Kite", 2, 2, "u32"),
    "typescript": ("interface Seat {\n  row: number;\n}\n\nfunction free(all: Seat[]): Seat | undefined {\n  return all.pop();\n}\n", "Seat", 0, 2, "pop"),
    "csharp": ("using System;\n\nclass Gauge {\n  int Read(int raw) { return Math.Abs(raw); }\n  int Twice(int raw) { return Read(raw) + Read(0); }\n}\n", "Read", 3, 2, "Abs"),
}


@pytest.mark.parametrize("language", PROGRAMS)
def test_declarations_are_told_from_uses(language):
    text, name, row, uses, other = PROGRAMS[language]
    found, occurrences, partial, source = parse(language, text.encode())
    places = [(r.context == "declaration", source.point(r.start)[0]) for r in occurrences if r.name == name]
    assert not partial and [at for own, at in places if own] == [row] and len(places) == uses + 1
    assert [source.point(s.start)[0] for s in found if s.name == name] == [row]
    assert {r.context for r in occurrences if r.name == other} - {"declaration"} and all(text.encode()[r.start : r.end].decode() == r.name for r in occurrences)


def test_kinds_by_language():
    assert symbols("typescript", "import a from 'b';\nexport class A { m() {} }\nabstract class B {}\nnamespace N { function f() {} }\ninterface I {}\ntype T = string;\nenum E { X }\nconst v = 1;\n") == [
        ("import", "import a from 'b';"), ("class", "A"), ("method", "m"), ("class", "B"), ("namespace", "N"), ("function", "f"), ("interface", "I"), ("type", "T"), ("enum", "E"), ("variable", "v"),
    ]
    assert symbols("rust", "use a::b;\n#[derive(X)]\nstruct S;\nenum E { A }\ntrait T {}\ntype Y = S;\nconst C: i32 = 1;\nstatic D: i32 = 2;\nimpl S { fn new() {} }\n") == [
        ("import", "use a::b;"), ("struct", "S"), ("enum", "E"), ("trait", "T"), ("type", "Y"), ("variable", "C"), ("variable", "D"), ("function", "new"),
    ]
    assert symbols("go", "import (\n\"fmt\"\n)\nfunc (t T) Run() {}\nfunc F() {}\ntype T struct {}\nvar x int\nconst (\n  A = 1\n  B = 2\n)\n")[1:] == [("method", "Run"), ("function", "F"), ("type", "T"), ("variable", "x"), ("variable", "A"), ("variable", "B")]
    assert set(symbols("java", "import x.Y;\npublic class S {\n  @Override\n  public void m() {}\n  private int f = 1;\n}\ninterface I {}\nenum E { A }\nrecord R(int a) {}\n")) == {("import", "import x.Y;"), ("class", "S"), ("method", "m"), ("variable", "f"), ("interface", "I"), ("enum", "E"), ("class", "R")}
    assert symbols("cpp", "#include <x>\nnamespace n {\nclass A { void m(); };\nstruct S {};\nenum E { X };\nunion U {};\n}\nvoid A::m() {}\nint g(int);\nint v = 1;\n") == [
        ("import", "#include <x>"), ("namespace", "n"), ("class", "A"), ("method", "m"), ("struct", "S"), ("enum", "E"), ("union", "U"), ("method", "m"), ("prototype", "g"), ("variable", "v"),
    ]
    assert symbols("sql", "CREATE SCHEMA IF NOT EXISTS s;\nCREATE TABLE s.\"t\" (a INT, b TEXT, PRIMARY KEY (a));\nCREATE INDEX i ON t (a);\nCREATE SEQUENCE q;\nCREATE TYPE y AS ENUM ('x');\nCREATE TRIGGER g BEFORE INSERT ON t;\nCREATE OR REPLACE FUNCTION f() RETURNS INT;\nCREATE DATABASE d;\n") == [
        ("schema", "s"), ("table", '"t"'), ("column", "a"), ("column", "b"), ("index", "i"), ("sequence", "q"), ("type", "y"), ("trigger", "g"), ("function", "f"), ("database", "d"),
    ]
    assert symbols("bash", "#!/bin/sh\nX=1\nfunction a { :; }\nb() {\n  a\n}\n") == [("variable", "X"), ("function", "a"), ("function", "b")]
    assert symbols("make", "include x.mk\nCC := gcc\nall: a b\n\tcc\n") == [("import", "include x.mk"), ("variable", "CC"), ("target", "all")]
    assert symbols("json", '{"a": {"b": 1}, "c": [{"d": 2}]}') == [("key", "a"), ("key", "b"), ("key", "c"), ("key", "d")]
    assert symbols("yaml", "a:\n  b: &x 1\nc: *x\n") == [("key", "a"), ("key", "b"), ("anchor", "x"), ("key", "c")]
    assert symbols("css", "@import 'a';\n.x > #y { color: red }\n@keyframes k { from { top: 0 } }\n")[:3] == [("import", "@import 'a';"), ("selector", ".x > #y"), ("keyframes", "k")]
    assert ("mixin", "m") in symbols("scss", "$v: 1;\n@mixin m { a: b }\n@function f($x) { @return $x; }\n%p { c: d }\n") and ("placeholder", "p") in symbols("scss", "%p { c: d }")
    assert symbols("html", '<div id="main"><script>var a</script></div><style>p{}</style>') == [("id", "main"), ("tag", "script"), ("tag", "style")]


def test_markdown_sections_and_paths():
    found, occurrences, _, source = parse("markdown", b"# A\ntext\n## B\nx\n## C\n\nD\n===\ny\n```\n# no\n```\n")
    assert [(s.name, s.qualified, source.point(s.start)[0], source.point(s.end)[0]) for s in found] == [("A", None, 0, 5), ("B", "A.B", 2, 3), ("C", "A.C", 4, 5), ("D", None, 6, 12)] and not occurrences


def test_python_details():
    text = 'import os\n\n@d1\n@d2(x)\nclass A(B):\n    """Doc\n    more."""\n    x = 1\n    async def m(self, a: int = 2):\n        return os.path.join(a)\n'
    found, occurrences, partial, source = parse("python", text.encode())
    by_name = {s.name: s for s in found}
    assert source.point(by_name["A"].start) == (2, 0) and by_name["A"].docstring.startswith("Doc") and by_name["m"].qualified == "A.m" and not partial
    assert by_name["A"].signature == "class A(B):"
    contexts = {(r.name, r.context) for r in occurrences}
    assert {("os", "import"), ("A", "declaration"), ("m", "declaration"), ("int", "type-ref"), ("x", "assignment"), ("join", "call")} <= contexts
    assert parse("python", b"def f(:\n  x\nalpha()\n")[2] is True and ("alpha", "call") in refs("python", "def f(:\n  x\nalpha()\n")
    spans = rows_of("python", "é = 'ü'; b = é\n".encode())[1]
    assert [(r[0], r[2], r[4]) for r in spans] == [("é", 0, 2), ("b", 11, 12), ("é", 15, 17)]


def test_comments_above_are_documentation():
    assert parse("go", b"package m\n\n// F does it.\n// Twice.\nfunc F() {}\n")[0][0].docstring == "F does it.\nTwice."
    assert parse("javascript", b"/**\n * Adds.\n */\nfunction add() {}\n")[0][0].docstring == "Adds."
    assert parse("bash", b"# Greets.\n\ngreet() { :; }\n")[0][0].docstring == "Greets."


@pytest.mark.parametrize("language", [x.id for x in LANGUAGES])
def test_any_bytes_are_survived(language):
    for data in (b"", b"\n", b"\xff\xfe\x00", b"{[(", b")]}", b"\"'`", "日本 = {é: [ü]}\n".encode(), b"a" * 3000, b"<a <b> 'c", b"class def func {{{"):
        s, r, _ = rows_of(language, data)
        assert all(x[1] for x in s) and all(x[0] for x in r)


def test_detection():
    cases = {
        "a.py": "python", "a.PYI": "python", "x/a.C": "cpp", "x/a.H": "cpp", "a.h": "c", "node_modules/a.js": None, "a/dist/b.go": None, "build.gradle.kts": None, "x.gradle.kts": "kotlin", "Makefile": "make", "sub/GNUmakefile": "make", "README": None, "a.unknown": None, ".bashrc": None, "a.yml": "yaml", "a.tsx": "tsx",
    }
    assert {p: detect(p) for p in cases} == cases
    assert detect("run", b"#!/usr/bin/env python3\n") == "python" and shebang_language(b"#!/bin/zsh") == "bash" and shebang_language(b"#!/usr/bin/perl") is None and detect("run.txt", b"#!/bin/sh") is None
    assert len(LANGUAGES) == 23 and all(x.kinds for x in BY_ID.values())


def test_language_columns_agree(spark):
    from pyspark.sql import functions as F

    from quarry.sources.languages import language_of

    rows = [("a.py", ""), ("lib/a.C", ""), ("x/vendor/a.py", ""), ("settings.gradle.kts", ""), ("run", "#!/bin/ksh\nx"), ("Makefile", ""), ("a.json", ""), ("b", "text"), ("w\\q.rb", "")]
    got = spark.createDataFrame(rows, "p string, h string").select("p", language_of(F.col("p"), F.col("h")).alias("l")).collect()
    assert [r.l for r in got] == [detect(p, h.encode()) for p, h in rows]


def test_table_functions(spark):
    from quarry.functions.udtf import register

    register(spark)
    frame = spark.createDataFrame([("a.py", "python", bytearray(b"def f():\n    return g()\n")), ("b.json", "json", bytearray(b'{"k": 1}')), ("c", None, None)], "path string, language string, content binary")
    frame.createOrReplaceTempView("sources")
    assert [(r.path, r.name, r.kind) for r in spark.sql("SELECT path, s.name, s.kind FROM sources, LATERAL extract_symbols(language, content) s ORDER BY path").collect()] == [("a.py", "f", "function"), ("b.json", "k", "key")]
    assert spark.sql("SELECT s.context FROM sources, LATERAL extract_refs(language, content) s WHERE s.name = 'g'").first()[0] == "call"
    got = spark.sql("SELECT s.text FROM (SELECT * FROM sources WHERE language = 'python') f, LATERAL syntax_query(language, content, '(call function: (identifier) @c)') s").collect()
    assert [r.text for r in got] == ["g"]


def test_sql_names_and_uses():
    text = 'create table "My Items" ("Item No" int, n int);\nselect i."Item No", "text only" from "My Items" i;\ninsert into "My Items" ("Item No", n) values (1, 2);\ncreate index "ix" on "My Items" ("Item No");\ncreate table `t` (`c` int);\nselect `c` from `t`;\n-- t comment\nwith r(u) as (select n from x) select u, \'t\' from r;\n'
    found = symbols("sql", text)
    assert [x for x in found if x[0] in ("table", "index", "cte")] == [("table", '"My Items"'), ("index", '"ix"'), ("table", "`t`"), ("cte", "r")]
    uses = [n for n, c in refs("sql", text) if c != "declaration"]
    assert [uses.count(n) for n in ('"My Items"', '"Item No"', '"ix"', "`t`", "`c`", '"text only"', "r", "t", "select")] == [3, 3, 0, 1, 1, 0, 1, 0, 0]
    ferry = "-- Where boats go.\ncreate table if not exists sea.routes (\n  code text primary key,\n  miles numeric,\n  back text references sea.routes (code)\n);\n\ncreate view sea.long_routes as select code from sea.routes where miles > 90;\n"
    own, _, partial, source = parse("sql", ferry.encode())
    by_name = {s.name: s for s in own}
    assert not partial and by_name["routes"].docstring == "Where boats go." and source.point(by_name["routes"].end)[0] == 5
    assert [s.qualified for s in own if s.kind == "column"] == ["routes.code", "routes.miles", "routes.back"] and "long_routes" in by_name
    assert len([n for n, c in refs("sql", ferry) if n == "miles" and c != "declaration"]) == 1


def test_names_of_values_are_occurrences_too():
    """The place that gives a value its name stays in the occurrences, as what it is there."""
    at = lambda language, text, name: [c for n, c in refs(language, text) if n == name]
    for language, text, name, context in (
        ("java", "class Oven {\n  private int degrees = 180;\n  int hotter() { return degrees + 20; }\n}\n", "degrees", "assignment"), ("rust", "static STEPS: usize = 4;\nfn half() -> usize { STEPS / 2 }\n", "STEPS", "declaration"),
        ("javascript", "let tempo = 90;\nplay(tempo);\n", "tempo", "assignment"), ("kotlin", "val reef = 3\nprintln(reef)\n", "reef", "identifier"), ("python", "depth = 3\nshow(depth)\n", "depth", "assignment"),
        ("php", "<?php\nclass Till {\n  const FLOAT = 50;\n  public $open;\n  function low() { return self::FLOAT; }\n}\n", "FLOAT", "identifier"),
    ):
        found = at(language, text, name)
        assert found[0] == context and len(found) == 2, (language, found)
    pump = "class Pump {\n  Pump(int bar) {}\n  static Pump strong() { return new Pump(9); }\n}\n"
    assert at("java", pump, "Pump").count("declaration") == 2 and len(at("java", pump, "Pump")) == 4


def test_cpp_members_defined_elsewhere():
    """A member's name is the last part, wherever its body stands."""
    text = b"namespace garden {\nclass Pond {\n public:\n  int fish() const;\n  ~Pond();\n};\n}\n\nint garden::Pond::fish() const { return 4; }\n\ngarden::Pond::~Pond() {}\n\ntemplate <typename Item>\nstruct Crate {\n  Item first;\n};\n"
    found, _, _, source = parse("cpp", text)
    rows = {}
    for s in found:
        rows.setdefault((s.kind, s.name), []).append(source.point(s.start)[0])
    assert rows["method", "fish"] == [3, 8] and rows["method", "~Pond"] == [4, 10] and rows["class", "Pond"] == [1] and ("struct", "Crate") in rows
    assert all("::" not in s.name for s in found)


def test_ruby_symbols_have_no_colon():
    text = "class Shed\n  attr_accessor :tools\n\n  def heavy\n    tools.select { |t| t.weight > 5 }\n  end\nend\n"
    names = [n for n, _ in refs("ruby", text)]
    assert not [n for n in names if n.startswith(":")] and "tools" in names and "weight" in names
