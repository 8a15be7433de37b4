"""Registered queries over extraction, stored generations and the public query operators.

The driver's tables hold no source code, so extraction runs on one source for each
document, written from a fixed template with the document's number in its names; what
comes out is known for every document.  The query operators run on generations that
are published from the derived relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EnclosingArgs, Limits, OutlineArgs, ReferenceArgs, SymbolArgs
from ..operators import intervals, lookup, ordered
from ..operators.ordered import folder
from . import derived as D
from .catalogue import NAMES, NESTED, REFS_AT, SYMBOL_NAMES, quoted, register

# --- extraction --------------------------------------------------------------------------------------------------

PYTHON = '''import os
from pkg import thing

@wrap(1)
def f§(x):
    """Doc §.

    More."""
    return g§(x) + os.sep


class C§(Base):
    # the size
    size = 3

    async def m(self, y: int) -> str:
        self.z = call(y)
        return self.z
'''
SCRIPT = """import { a } from "./a";
// adds up
export function add§(x, y) {
  return helper(x) + y;
}
export class K§ extends Base {
  run() { return this.go(); }
}
const f§ = (x) => x;
"""
MARKDOWN = """# Top §

text

## Sub one

more

### Deep

deep text

## Sub two
last
"""
SOURCES = {"python": PYTHON, "javascript": SCRIPT, "markdown": MARKDOWN}
#: By language, what the templates define: kind, name, qualified name, rows and columns, signature, documentation.
DEFINED = {
    "python": [
        ("import", "import os", None, 0, 0, 0, 9, "import os", None), ("import", "from pkg import thing", None, 1, 0, 1, 21, "from pkg import thing", None),
        ("function", "f§", None, 3, 0, 8, 32, "def f§(x):", "Doc §.\n\n    More."), ("class", "C§", None, 11, 0, 17, 21, "class C§(Base):", None),
        ("variable", "size", "C§.size", 13, 4, 13, 12, "size = 3", "the size"), ("function", "m", "C§.m", 15, 4, 17, 21, "async def m(self, y: int) -> str:", None),
    ],
    "javascript": [
        ("import", 'import { a } from "./a";', None, 0, 0, 0, 24, 'import { a } from "./a";', None), ("function", "add§", None, 2, 0, 4, 1, "export function add§(x, y) {", "adds up"),
        ("class", "K§", None, 5, 0, 7, 1, "export class K§ extends Base {", None), ("method", "run", "K§.run", 6, 2, 6, 29, "run() { return this.go(); }", None), ("variable", "f§", None, 8, 0, 8, 27, "const f§ = (x) => x;", None),
    ],
    "markdown": [
        ("heading", "Top §", None, 0, 0, 14, 0, "# Top §", None), ("heading", "Sub one", "Top §.Sub one", 4, 0, 11, 0, "## Sub one", None),
        ("heading", "Deep", "Top §.Sub one.Deep", 8, 0, 11, 0, "### Deep", None), ("heading", "Sub two", "Top §.Sub two", 12, 0, 14, 0, "## Sub two", None),
    ],
}
#: What the Python template mentions: name, row, first and last column, context.
MENTIONED = [
    ("os", 0, 7, 9, "import"), ("pkg", 1, 5, 8, "import"), ("thing", 1, 16, 21, "import"), ("wrap", 3, 1, 5, "call"), ("f§", 4, 4, 13, "declaration"), ("x", 4, 14, 15, "identifier"), ("g§", 8, 11, 20, "call"),
    ("x", 8, 21, 22, "call"), ("os", 8, 26, 28, "identifier"), ("sep", 8, 29, 32, "identifier"), ("C§", 11, 6, 15, "declaration"), ("Base", 11, 16, 20, "identifier"), ("size", 13, 4, 8, "assignment"),
    ("m", 15, 14, 15, "declaration"), ("self", 15, 16, 20, "identifier"), ("y", 15, 22, 23, "type-ref"), ("int", 15, 25, 28, "type-ref"), ("str", 15, 33, 36, "type-ref"), ("self", 16, 8, 12, "assignment"), ("z", 16, 13, 14, "assignment"),
    ("call", 16, 17, 21, "call"), ("y", 16, 22, 23, "call"), ("self", 17, 15, 19, "identifier"), ("z", 17, 20, 21, "identifier"),
]


def values(rows: list[tuple]) -> str:
    spell = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return ", ".join("(" + ", ".join(map(spell, r)) + ")" for r in rows)


def sources(spark: SparkSession, d: str, language: str) -> DataFrame:
    """Source of each document; its number has eight digits, so that columns are fixed."""
    number = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    return D.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit(language).alias("language"), F.replace(F.lit(SOURCES[language]), F.lit("§"), number).cast("binary").alias("content"))


NUMBERED = "n AS (SELECT doc_id AS file_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS num FROM documents)"


def symbols_sql(language: str) -> str:
    put = lambda c: f"replace({c}, '§', num)"
    return f"""WITH {NUMBERED}, t(kind, name, qualified, start_row, start_col, end_row, end_col, signature, docstring) AS (VALUES {values(DEFINED[language])})
SELECT file_id, kind, {put('name')} AS name, {put('qualified')} AS qualified, CAST(start_row AS BIGINT) AS start_row, CAST(start_col AS BIGINT) AS start_col, CAST(end_row AS BIGINT) AS end_row, CAST(end_col AS BIGINT) AS end_col,
  {put('signature')} AS signature, {put('docstring')} AS docstring FROM n, t"""


def extracted_symbols(language: str):
    def query(spark, d):
        from ..sources.extract.symbols import extracted

        return extracted(sources(spark, d, language)).select("file_id", F.inline("symbols"))

    return query


for _language in SOURCES:
    register(f"extract_{_language}", symbols_sql(_language))(extracted_symbols(_language))


@register("extract_refs_python", f"""WITH {NUMBERED}, t(name, row, col, end_col, context) AS (VALUES {values(MENTIONED)})
SELECT file_id, replace(name, '§', num) AS name, CAST(row AS BIGINT) AS start_row, CAST(col AS BIGINT) AS start_col, CAST(end_col AS BIGINT) AS end_col, context FROM n, t""")
def extract_refs_python(spark, d):
    from ..sources.extract.symbols import extracted

    return extracted(sources(spark, d, "python")).select("file_id", F.inline("refs")).select("file_id", "name", "start_row", "start_col", "end_col", "context")


@register("syntax_query_python", "SELECT file_id, seq, text FROM (SELECT doc_id AS file_id, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS num, unnest([0, 1]) AS seq FROM documents), LATERAL (SELECT CASE seq WHEN 0 THEN 'f' || num ELSE 'm' END AS text)")
def syntax_query_python(spark, d):
    from ..sources.patterns import captures

    found = captures(sources(spark, d, "python").select("file_id", "content"), "python", "(function_definition name: (identifier) @name)")
    return found.select("file_id", "seq", "text")


@register("syntax_query_literals", "SELECT doc_id AS file_id, 'C' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS text FROM documents WHERE doc_id BETWEEN 100 AND 199")
def syntax_query_literals(spark, d):
    """The literal that a pattern requires keeps other sources from the parser."""
    from ..sources.patterns import captures

    # a regular expression names the hundred documents, the literals come from the equality of the base class
    own = sources(spark, d, "python").select("file_id", "content")
    found = captures(own, "python", '((class_definition name: (identifier) @name superclasses: (argument_list (identifier) @base)) (#eq? @base "Base") (#match? @name "^C000001[0-9][0-9]$"))')
    return found.where("capture = 'name'").select("file_id", "text")


# --- stored generations ------------------------------------------------------------------------------------------


def chat_store(spark: SparkSession, d: str):
    """Conversations as files, their turns and lines as symbols."""
    from .store import Store

    store, none = Store(spark, folder(spark)), F.lit(None)
    files = D.symbol_files(spark, d).withColumn("mtime_ns", F.lit(1).cast("long"))
    symbols = D.symbols(spark, d).withColumns({"signature": none.cast("string"), "docstring": none.cast("string")})
    refs = D.refs(spark, d, ["absent_name"]).withColumn("ref_id", F.lit(0).cast("long"))
    store.publish({"repos": D.symbol_repos(spark, d).withColumn("root_path", F.concat(F.lit("/srv/"), "name")), "files": files, "symbols": symbols, "refs": refs.where("false")})
    return store


def prose_store(spark: SparkSession, d: str):
    """Documents as files, their identifiers as references."""
    from .store import Store

    store = Store(spark, folder(spark))
    none = D.symbols(spark, d).withColumns({"signature": F.lit(""), "docstring": F.lit("")}).where("false")
    store.publish({"repos": D.repos(spark, d), "files": D.files(spark, d), "symbols": none, "refs": D.refs(spark, d, NAMES).withColumn("ref_id", F.lit(0).cast("long"))})
    return store


def navigator(spark: SparkSession, store, **limits):
    from .tools import Navigator

    return Navigator(spark, store, {}, Limits(**limits))


@register("stored_symbols_of_file", "SELECT symbol_id, kind, name, start_row, end_row FROM symbols JOIN symbol_files USING (file_id) WHERE path = 'src/c3.py'", "symbols", "symbol_files")
def stored_symbols_of_file(spark, d):
    store = chat_store(spark, d)
    file = store.read("files").where("path = 'src/c3.py'").select("file_id")
    return store.read("symbols").join(file, "file_id").select("symbol_id", "kind", "name", "start_row", "end_row")


@register("stored_snapshot", "SELECT kind, count(*) AS n, CAST(sum(end_row) AS BIGINT) AS rows, 1 AS generation, TRUE AS same FROM symbols GROUP BY kind", "symbols")
def stored_snapshot(spark, d):
    """A snapshot holds the rows of the generation it was taken of, and the same rows give it the same identity."""
    store = chat_store(spark, d)
    one, two = store.snapshot(folder(spark)), store.snapshot(folder(spark))
    same = one.manifest().identity == two.manifest().identity != ""
    own = one.read("symbols").groupBy("kind").agg(F.count("*").alias("n"), F.sum("end_row").alias("rows"))
    return own.select("kind", "n", "rows", F.lit(one.manifest().generation).alias("generation"), F.lit(same).alias("same"))


@register("stored_generations", "SELECT kind, count(*) AS n, 2 AS generation FROM symbols WHERE kind <> 'line' GROUP BY kind", "symbols")
def stored_generations(spark, d):
    """The next generation takes the place of the one before; readers follow the pointer."""
    store = chat_store(spark, d)
    tables = {t: store.read(t) for t in ("repos", "files", "symbols", "refs")}
    m = store.publish(tables | {"symbols": tables["symbols"].where("kind <> 'line'")})
    return store.read("symbols").groupBy("kind").agg(F.count("*").alias("n")).withColumn("generation", F.lit(m.generation))


@register("delta_merge", """, own AS (
  SELECT file_id, CASE WHEN file_id % 60 = 0 THEN 'chat3' WHEN file_id % 20 = 1 THEN 'chat2' ELSE 'chat' END AS language,
    CASE WHEN file_id % 60 = 0 THEN 4 WHEN file_id % 20 = 1 THEN 3 WHEN file_id % 15 = 0 THEN 2 ELSE 1 END AS mtime_ns
  FROM symbol_files WHERE (file_id % 30 <> 0 OR file_id % 60 = 0) AND file_id % 40 <> 2),
held AS (
  SELECT file_id, CASE WHEN language = 'chat2' THEN name || '_v2' ELSE name END AS name, end_row FROM symbols JOIN own USING (file_id)
  WHERE language = 'chat' OR language = 'chat2' AND kind <> 'line' OR kind = 'conversation')
SELECT file_id, any_value(language) AS language, CAST(any_value(mtime_ns) AS BIGINT) AS mtime_ns, count(name) AS n_symbols, count(*) FILTER (ends_with(name, '_v2')) AS n_new, max(end_row) AS last_row
FROM own LEFT JOIN held USING (file_id) GROUP BY file_id""", "symbols", "symbol_files")
def delta_merge(spark, d):
    """A sequence of updates (replaced, deleted, touched, added again, compacted, deleted), each a layer, read as one index."""
    store = chat_store(spark, d)
    none, all_rows, entry = store.read("symbols").where("false"), F.lit(True).alias("rows"), F.lit(False).alias("rows")
    refs = store.read("refs").where("false")

    def change(files: DataFrame, symbols: DataFrame, gone: DataFrame) -> None:
        store.publish_delta({"repos": store.read("repos"), "files": files, "symbols": symbols, "refs": refs}, gone)

    some = store.read("files").where("file_id % 20 = 1").withColumns({"language": F.lit("chat2"), "mtime_ns": F.lit(3)})
    change(some, store.read("symbols").where("file_id % 20 = 1 AND kind <> 'line'").withColumn("name", F.concat("name", F.lit("_v2"))), some.select("file_id", all_rows))
    before = store.manifest()
    again = (store._merged(t, [before.folder]) for t in ("files", "symbols"))
    files, symbols = (t.where("file_id % 60 = 0") for t in again)
    change(some.where("false"), none, store.read("files").where("file_id % 30 = 0").select("file_id", all_rows))
    seen = store.read("files").where("file_id % 15 = 0")
    change(seen.withColumn("mtime_ns", F.lit(2)), none, seen.select("file_id", entry))
    change(files.withColumns({"language": F.lit("chat3"), "mtime_ns": F.lit(4)}), symbols.where("kind = 'conversation'"), files.select("file_id", all_rows))
    store.compact()
    change(some.where("false"), none, store.read("files").where("file_id % 40 = 2").select("file_id", all_rows))
    names = store.read("symbols").groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("name").endswith("_v2")).alias("v"), F.max("end_row").alias("last_row"))
    zero = F.lit(0).cast("long")
    return store.read("files").join(names, "file_id", "left").select("file_id", "language", "mtime_ns", F.coalesce("n", zero).alias("n_symbols"), F.coalesce("v", zero).alias("n_new"), "last_row")


# --- the public query operators ----------------------------------------------------------------------------------

RANGES = "start_row + 1 AS first, start_col, end_row + 1 AS last, end_col"


def rows_of(spark: SparkSession, rows: list[tuple], kinds: str) -> DataFrame:
    return ordered.given(spark, rows, kinds)


@register("tool_get_symbol", f""", r AS (
  SELECT name, kind, path, 'chat' || repo_id AS repo, {RANGES}, list_position([{quoted(SYMBOL_NAMES)}], name) AS o, row_number() OVER (PARTITION BY name ORDER BY repo_id, path, start_row, symbol_id) AS rank FROM symbols JOIN symbol_files USING (file_id) WHERE name IN ({quoted(SYMBOL_NAMES)})),
c AS (SELECT CAST(count(*) AS BIGINT) AS total FROM r), s AS (SELECT coalesce(string_agg(name, ',' ORDER BY o), '') AS short FROM (SELECT name, any_value(o) AS o FROM r GROUP BY name HAVING count(*) > 3 + 10))
SELECT name, kind, repo, path, first, start_col, last, end_col, total, short FROM r, c, s WHERE rank > 3 AND rank <= 3 + 10""", "symbols", "symbol_files")
def tool_get_symbol(spark, d):
    found = navigator(spark, chat_store(spark, d), max_response_chars=0).get_symbol(SymbolArgs(names=SYMBOL_NAMES, limit=50, offset=3))
    rows = [(m["name"], m["kind"], m.get("repo", found.get("repo")), m["file"], *m["range"], found["total"], ",".join(found.get("truncated_names", []))) for m in found["matches"]]
    return rows_of(spark, rows, "name string, kind string, repo string, path string, first long, start_col long, last long, end_col long, total long, short string")


@register("tool_kind_filtered_out", "SELECT 'c3' AS name, 'conversation' AS kind, CAST(1 AS BIGINT) AS n, 'kind_filtered_out' AS code, CAST(0 AS BIGINT) AS matches")
def tool_kind_filtered_out(spark, d):
    found = navigator(spark, chat_store(spark, d)).get_symbol(SymbolArgs(name="c3", kind="line"))
    rows = [("c3", kind, n, x["code"], len(found["matches"])) for x in found["diagnostics"] for kind, n in x["kinds"].items()]
    return rows_of(spark, rows, "name string, kind string, n long, code string, matches long")


@register("tool_outline", NESTED + """, own AS (SELECT * FROM nest JOIN symbol_files USING (file_id) WHERE path = 'src/c3.py' AND kind <> 'import')
SELECT name, kind, start_row + 1 AS first, end_row + 1 AS last, depth, (SELECT count(*) FROM own WHERE depth = 1) AS total FROM own WHERE depth <= 2""", "symbols", "symbol_files")
def tool_outline(spark, d):
    found = navigator(spark, chat_store(spark, d), max_response_chars=0).list_file_outline(OutlineArgs(file="src/c3.py", depth=2))
    rows = []

    def walk(nodes: list[dict], depth: int) -> None:
        for x in nodes:
            rows.append((x["name"], x["kind"], x["range"][0], x["range"][2], depth, found["total"]))
            walk(x.get("children", []), depth + 1)

    walk(found["symbols"], 1)
    return rows_of(spark, rows, "name string, kind string, first long, last long, depth long, total long")


@register("tool_enclosing_rows", """, asked AS (SELECT unnest([2, 1, 4, 90000, 3]) AS row, unnest([0, 1, 2, 3, 4]) AS i), r AS (
  SELECT i, asked.row, kind, name, row_number() OVER (PARTITION BY i ORDER BY end_row - start_row, start_row DESC, start_col DESC, end_row, end_col, symbol_id) AS level
  FROM asked JOIN (SELECT * FROM symbols JOIN symbol_files USING (file_id) WHERE path = 'src/c3.py') s ON start_row <= asked.row - 1 AND end_row >= asked.row - 1)
SELECT CAST(asked.row AS BIGINT) AS row, r.name, r.kind, level, 5 AS total, 4 AS next_offset FROM asked LEFT JOIN r ON r.i = asked.i AND level <= 2 WHERE asked.i BETWEEN 1 AND 3""", "symbols", "symbol_files")
def tool_enclosing_rows(spark, d):
    found = navigator(spark, chat_store(spark, d), max_response_chars=0).enclosing_symbol(EnclosingArgs(file="src/c3.py", rows=[2, 1, 4, 90000, 3], depth=2, offset=1, limit=3))
    rows = []
    for hit in found["results"]:
        ms = hit["matches"]
        rows += [(hit["row"], m["name"], m["kind"], len(ms) - i, found["total"], found["next_offset"]) for i, m in enumerate(ms)] or [(hit["row"], None, None, None, found["total"], found["next_offset"])]
    return rows_of(spark, rows, "row long, name string, kind string, level long, total int, next_offset int")


@register("tool_find_references", f", r AS (SELECT * FROM {REFS_AT} AND starts_with(path, 'docs/en/')), t AS (SELECT count(*) AS total, count(DISTINCT path) AS total_files FROM r) SELECT name_1 AS repo, path, name, start_row + 1 AS row, start_col, context, total, total_files FROM (SELECT name AS ref_name, * FROM r), t ORDER BY name, name_1, path, start_row, start_col LIMIT 100 OFFSET 30".replace("SELECT * FROM refs", "SELECT refs.name, repos.name AS name_1, path, start_row, start_col, context FROM refs").replace("SELECT name AS ref_name, * FROM r", "SELECT * FROM r"), "refs", "files", "repos")
def tool_find_references(spark, d):
    found = navigator(spark, prose_store(spark, d), max_response_chars=0).find_references(ReferenceArgs(names=NAMES, scope="docs/en", limit=100, offset=30, group_by_file=False))
    rows = [(x.get("repo", found.get("repo")), x["file"], x["name"], x["range"][0], x["range"][1], x["context"], found["total"], found["total_files"]) for x in found["refs"]]
    return rows_of(spark, rows, "repo string, path string, name string, row long, start_col long, context string, total long, total_files long")


@register("tool_reference_counts", f", r AS (SELECT repos.name AS repo, path, refs.name FROM {REFS_AT}) SELECT 'file' AS part, repo, path AS key, count(*) AS n FROM r GROUP BY repo, path UNION ALL SELECT 'name', '', name, count(*) FROM r GROUP BY name UNION ALL SELECT 'total', '', '', count(*) FROM r UNION ALL SELECT 'files', '', '', count(DISTINCT path) FROM r", "refs", "files", "repos")
def tool_reference_counts(spark, d):
    return navigator(spark, prose_store(spark, d)).reference_counts(ReferenceArgs(names=NAMES))


PATHS_OF = "src AS (SELECT doc_id, coalesce(source, '') AS repo, 'm/f' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.py' AS path, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS num FROM documents)"


def source_table(spark: SparkSession, d: str) -> DataFrame:
    """A Python source of each document, as a walk gives it."""
    number = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    own = D.table(spark, d, "documents").select("doc_id", F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("repo_id"), F.col("source").alias("repo"), F.concat(F.lit("m/f"), number, F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit(1).cast("long").alias("mtime_ns"))
    own = own.withColumn("content", F.replace(F.lit(PYTHON), F.lit("§"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))
    return with_state(own)


def with_state(own: DataFrame) -> DataFrame:
    data = F.col("content").cast("binary")
    return own.withColumns({"byte_size": F.octet_length("content").cast("long"), "readable": F.lit(True), "binary": F.lit(False), "sha": F.sha2(data, 256), "content": data})


@register("build_update", f"""WITH {PATHS_OF}, kept AS (SELECT *, doc_id % 10 = 3 AS changed, doc_id % 10 = 5 AS touched FROM src WHERE doc_id % 10 <> 4)
SELECT path, CASE WHEN changed THEN 3 WHEN touched THEN 2 ELSE 1 END AS mtime_ns, 'C' || CASE WHEN changed THEN 'x' || num ELSE num END AS class, CAST(6 AS BIGINT) AS n_symbols, CAST({len(MENTIONED)} AS BIGINT) AS n_refs FROM kept""")
def build_update(spark, d):
    """A full build over a table of sources, then an update of some: changed, touched and deleted files become a layer."""
    from ..sources.config import Config
    from .build import Builder
    from .store import Store

    store = Store(spark, folder(spark))
    builder, repos = Builder(spark, store, Config([])), D.repos(spark, d)
    walked = source_table(spark, d)
    builder.merge(walked, store.read("files"), store.read("files"), repos, False)
    k = F.col("doc_id") % 10
    some = walked.where(k.isin(3, 5)).withColumn("mtime_ns", F.when(k == 3, 3).otherwise(2).cast("long"))
    some = with_state(some.withColumn("content", F.when(k == 3, F.replace(F.col("content").cast("string"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.concat(F.lit("x"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))).otherwise(F.col("content").cast("string"))))
    files = store.read("files")
    gone = files.join(walked.where(k == 4).select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    builder.merge(some, files, gone, repos, False)
    symbols = store.read("symbols").groupBy("file_id").agg(F.count("*").alias("n_symbols"), F.max(F.when(F.col("kind") == "class", F.col("name"))).alias("class"))
    refs = store.read("refs").groupBy("file_id").agg(F.count("*").alias("n_refs"))
    return store.read("files").join(symbols, "file_id").join(refs, "file_id").select("path", F.col("mtime_ns").cast("int").alias("mtime_ns"), "class", "n_symbols", "n_refs")


@register("tool_query", f"""WITH {PATHS_OF}, n AS (SELECT *, row_number() OVER (ORDER BY repo, path) - 1 AS k FROM src WHERE doc_id BETWEEN 100 AND 199 AND doc_id % 4 <> 1),
c AS (SELECT repo, path, 2 * k + s AS pos, CASE s WHEN 0 THEN 'C' || num ELSE 'Base' END AS text, CASE s WHEN 0 THEN 'name' ELSE 'base' END AS name FROM n, (SELECT unnest([0, 1]) AS s))
SELECT repo, path AS file, name, text, CAST((SELECT count(*) FROM documents) AS BIGINT) AS scanned, CAST((SELECT count(*) FROM documents WHERE doc_id % 4 <> 1) AS BIGINT) AS parsed, (SELECT count(*) FROM c) > 37 + 60 AS truncated FROM c WHERE pos >= 37 AND pos < 37 + 60""")
def tool_query(spark, d):
    """A pattern over a table of sources: the index of three-byte strings leaves the parser those that hold its literals."""
    from ..model import QueryArgs
    from ..sources import ngrams
    from .store import Store
    from .tools import Navigator

    store, text = Store(spark, folder(spark)), F.col("content").cast("string")
    walked = source_table(spark, d).withColumn("repo", F.coalesce("repo", F.lit(""))).withColumn("repo_id", F.xxhash64("repo"))  # any name, also none
    repos = walked.select("repo_id", F.col("repo").alias("name"), F.concat(F.lit("/srv/"), "repo").alias("root_path")).distinct()
    walked = with_state(walked.withColumn("content", F.when(F.col("doc_id") % 4 == 1, F.replace(text, F.lit("Base"), F.lit("Root"))).otherwise(text)))
    none = F.lit(None)
    symbols = D.symbols(spark, d).withColumns({"signature": none.cast("string"), "docstring": none.cast("string")}).where("false")
    refs = D.refs(spark, d, ["absent_name"]).withColumn("ref_id", F.lit(0).cast("long")).where("false")
    store.publish({"repos": repos, "files": walked.withColumns({"file_id": F.col("doc_id"), "partial": F.lit(False)}), "symbols": symbols, "refs": refs})
    grams = ordered.landed(ngrams.built(walked, "doc_id"), "grams")
    roots = {r.name: "" for r in store.read("repos").orderBy("name").collect()}  # the configured repositories
    nav = Navigator(spark, store, roots, Limits(max_response_chars=0), walked, grams)
    pattern = '((class_definition name: (identifier) @name superclasses: (argument_list (identifier) @base)) (#eq? @base "Base") (#match? @name "^C000001[0-9][0-9]$"))'
    found = nav.query(QueryArgs(query=pattern, language="python", limit=60, offset=37))
    rows = [(x["repo"], x["file"], x["name"], x["text"], found["files_scanned"], found["files_parsed"], found["truncated"]) for x in found["captures"]]
    return rows_of(spark, rows, "repo string, file string, name string, text string, scanned long, parsed long, truncated boolean")


@register("tool_byte_budget", "SELECT TRUE AS fits, TRUE AS truncated, TRUE AS warned, TRUE AS follows, TRUE AS pages_join")
def tool_byte_budget(spark, d):
    """A response is cut to its budget, tells where to go on, and the next page begins where it ended."""
    from .wire import size_of

    nav = navigator(spark, prose_store(spark, d), max_response_chars=4000)
    args = {"names": NAMES, "limit": 200, "group_by_file": False, "snippet_lines": 0}
    one = nav.find_references(ReferenceArgs(**args))
    two = nav.find_references(ReferenceArgs(**args, offset=one["next_offset"]))
    place = lambda x: (x["name"], x.get("repo", ""), x["file"], *x["range"])
    seen = [place(x) for x in one["refs"] + two["refs"]]
    row = (size_of(one) <= 4000, one["truncated"], "offset" in one["warning"], one["next_offset"] == len(one["refs"]), len(set(seen)) == len(seen))
    return rows_of(spark, [row], "fits boolean, truncated boolean, warned boolean, follows boolean, pages_join boolean")


@register("outline_without_imports", NESTED.replace("FROM symbols s JOIN symbols a", "FROM symbols s JOIN (SELECT * FROM symbols WHERE name <> 'l0') a").replace("FROM symbols s LEFT JOIN above", "FROM (SELECT * FROM symbols WHERE name <> 'l0') s LEFT JOIN above") + "SELECT symbol_id, depth, qualified FROM nest", "symbols")
def outline_without_imports(spark, d):
    own = D.symbols(spark, d).withColumn("kind", F.when(F.col("name") == "l0", "import").otherwise(F.col("kind")))
    return intervals.nested_by_stack(own.where("kind <> 'import'")).select("symbol_id", "depth", "qualified")


@register("candidate_files", "SELECT row_number() OVER (ORDER BY repo_id, path) - 1 AS ordinal, path, language FROM files WHERE language IN ('de', 'fr')", "files")
def candidate_files(spark, d):
    """Candidates of a raw query: files of the asked languages, in the stream's order."""
    own = D.files(spark, d).where(F.col("language").isin("de", "fr"))
    return ordered.ordered(own, ["repo_id", "path"]).numbered().select("ordinal", "path", "language")
