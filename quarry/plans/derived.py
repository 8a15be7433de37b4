"""The logical index over the driver's tables, in Spark and in SQL.

The tables hold no source code, so the catalogue's queries run the operators on
relations that fixed expressions derive from prose, conversations, pages and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import with_occurrences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repos(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select(F.col("source").alias("name")).distinct()
    return own.select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("repo_id"), "name", F.concat(F.lit("/srv/"), "name").alias("root_path"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        (F.col("doc_id") + 1).alias("file_id"), F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("repo_id"),
        F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("lang").alias("language"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"), (F.col("doc_id") * 1000 + 1).alias("mtime_ns"), F.octet_length("text").cast("long").alias("byte_size"), (F.col("doc_id") % 13 == 0).alias("partial"),
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select((F.col("doc_id") + 1).alias("file_id"), "text")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("file_id", tx.lines(F.col("text")).alias("lines"))


def refs(spark: SparkSession, d: str, names: list[str] | None = None) -> DataFrame:
    return with_occurrences(texts(spark, d), names=names)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """A conversation holds its turns, and a turn its lines: intervals of rows from running line counts.
    file_id is the conversation's id + 1.  A turn's symbol_id leaves 999 places for its lines; later lines have
    negative ids, from the conversation and their row in it."""
    own = table(spark, d, "conversations").select("conv_id", "turn", "role", tx.lines(F.col("text")).alias("lines"))
    before = F.sum(F.size("lines")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumns({"first": F.coalesce(before, F.lit(0)).cast("long"), "n": F.size("lines").cast("long")})
    turn = own.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn") * 1000 + 1000).alias("symbol_id"), (F.col("conv_id") + 1).alias("file_id"), F.col("role").alias("kind"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"),
        F.col("first").alias("start_row"), (F.col("first") + F.col("n") - 1).alias("end_row"), F.octet_length(F.element_at("lines", -1)).cast("long").alias("end_col"),
    )
    whole = turn.groupBy("file_id").agg(F.max(F.struct("end_row", "end_col")).alias("e")).select(((F.col("file_id") - 1) * 1_000_000).alias("symbol_id"), "file_id", F.lit("conversation").alias("kind"), F.concat(F.lit("c"), (F.col("file_id") - 1).cast("string")).alias("name"), F.lit(0).cast("long").alias("start_row"), F.col("e.end_row").alias("end_row"), F.col("e.end_col").alias("end_col"))
    line = own.select("conv_id", "turn", "first", F.posexplode("lines").alias("pos", "line")).select(
        F.when(F.col("pos") < 999, F.col("conv_id") * 1_000_000 + F.col("turn") * 1000 + 1001 + F.col("pos")).otherwise(-(F.col("conv_id") * (1 << 32) + F.col("first") + F.col("pos"))).alias("symbol_id"), (F.col("conv_id") + 1).alias("file_id"), F.lit("line").alias("kind"), F.concat(F.lit("l"), F.col("pos").cast("string")).alias("name"),
        (F.col("first") + F.col("pos")).alias("start_row"), (F.col("first") + F.col("pos")).alias("end_row"), F.octet_length("line").cast("long").alias("end_col"),
    ).where("end_col > 0")
    out = whole.unionByName(turn).unionByName(line)
    return out.select("symbol_id", "file_id", "kind", "name", F.lit(None).cast("string").alias("qualified"), "start_row", F.lit(0).cast("long").alias("start_col"), "end_row", "end_col")


def symbol_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the symbols: one for each conversation, in four repositories."""
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).cast("long").alias("byte_size"))
    return own.select((F.col("conv_id") + 1).alias("file_id"), (F.col("conv_id") % 4).alias("repo_id"), F.concat(F.when(F.col("conv_id") % 5 == 0, "tests/c").otherwise("src/c"), F.col("conv_id").cast("string"), F.lit(".py")).alias("path"), F.lit("chat").alias("language"), F.lit("").alias("sha"), F.col("byte_size"), F.lit(False).alias("partial"))


def symbol_repos(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(4).select(F.col("id").alias("repo_id"), F.concat(F.lit("chat"), F.col("id").cast("string")).alias("name"))


#: The same relations in SQL, as common table expressions.
SQL = {
    "repos": "repos AS (SELECT DISTINCT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS repo_id, source AS name, '/srv/' || source AS root_path FROM documents)",
    "files": "files AS (SELECT doc_id + 1 AS file_id, CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS repo_id, 'docs/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, sha256(text) AS sha, doc_id * 1000 + 1 AS mtime_ns, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size, doc_id % 13 = 0 AS partial FROM documents)",
    "lines": "doc_lines AS (SELECT doc_id + 1 AS file_id, string_split_regex(text, '\\r?\\n') AS a FROM documents),\nlines AS (SELECT file_id, CASE WHEN a[-1] = '' THEN a[1:-2] ELSE a END AS lines FROM doc_lines)",
    "refs": r"""ref_lines AS (SELECT doc_id + 1 AS file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents),
ref_parts AS (SELECT file_id, row, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*') AS toks, string_split_regex(line, '[A-Za-z_][A-Za-z0-9_]*') AS gaps FROM ref_lines),
ref_each AS (SELECT file_id, row, unnest(toks) AS name, unnest(gaps[1:len(toks)]) AS gap, unnest(gaps[2:]) AS after, generate_subscripts(toks, 1) AS k FROM ref_parts),
ref_at AS (
  SELECT *, CAST(sum(octet_length(encode(gap))) OVER w + sum(octet_length(encode(name))) OVER w - octet_length(encode(name)) AS BIGINT) AS col
  FROM ref_each WINDOW w AS (PARTITION BY file_id, row ORDER BY k ROWS UNBOUNDED PRECEDING)),
refs AS (
  SELECT file_id, name, row AS start_row, col AS start_col, row AS end_row, CAST(col + octet_length(encode(name)) AS BIGINT) AS end_col,
    CASE WHEN starts_with(after, '.') THEN 'call' WHEN starts_with(after, ',') THEN 'assignment'
      WHEN regexp_matches(name, '^[A-Z]') AND k = 1 AND regexp_matches(gap, '^[ \t\r]*$') THEN 'declaration' WHEN regexp_matches(name, '^[A-Z]') THEN 'type-ref' ELSE 'identifier' END AS context
  FROM ref_at)""",
    "symbols": r"""conv_split AS (SELECT conv_id, turn, role, string_split_regex(text, '\r?\n') AS a FROM conversations),
conv_lines AS (SELECT conv_id, turn, role, CASE WHEN a[-1] = '' THEN a[1:-2] ELSE a END AS lines FROM conv_split),
conv_rows AS (SELECT *, CAST(coalesce(sum(len(lines)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM conv_lines),
turns AS (SELECT conv_id * 1000000 + turn * 1000 + 1000 AS symbol_id, conv_id + 1 AS file_id, role AS kind, 't' || turn AS name, first AS start_row, first + len(lines) - 1 AS end_row, CAST(octet_length(encode(lines[-1])) AS BIGINT) AS end_col FROM conv_rows),
convs AS (SELECT (file_id - 1) * 1000000 AS symbol_id, file_id, 'conversation' AS kind, 'c' || (file_id - 1) AS name, 0 AS start_row, max(end_row) AS end_row, arg_max(end_col, end_row) AS end_col FROM turns GROUP BY file_id),
line_each AS (SELECT conv_id, turn, first, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM conv_rows),
line_syms AS (SELECT CASE WHEN pos < 999 THEN conv_id * 1000000 + turn * 1000 + 1001 + pos ELSE -(conv_id * 4294967296 + first + pos) END AS symbol_id, conv_id + 1 AS file_id, 'line' AS kind, 'l' || pos AS name, first + pos AS start_row, first + pos AS end_row, CAST(octet_length(encode(line)) AS BIGINT) AS end_col FROM line_each WHERE line <> ''),
symbols AS (SELECT symbol_id, file_id, kind, name, start_row, 0 AS start_col, end_row, end_col FROM (SELECT * FROM convs UNION ALL SELECT * FROM turns UNION ALL SELECT * FROM line_syms))""",
    "symbol_files": "symbol_files AS (SELECT conv_id + 1 AS file_id, conv_id % 4 AS repo_id, CASE WHEN conv_id % 5 = 0 THEN 'tests/c' ELSE 'src/c' END || conv_id || '.py' AS path, CAST(sum(octet_length(encode(text))) AS BIGINT) AS byte_size FROM conversations GROUP BY conv_id)",
}


def sql(*names: str, body: str) -> str:
    """Bodies that begin with a comma go on with the list of expressions; a word after it tells that one refers to itself."""
    recursive = body.startswith(", RECURSIVE ")
    body = body.replace(", RECURSIVE ", ", ", 1) if recursive else body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names) + ("" if body.startswith(",") else "\n") + body
