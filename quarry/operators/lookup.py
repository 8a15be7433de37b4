"""Name lookups, filters and the fair quota for each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ordered

#: The order of symbols and references; ids break ties.
ORDER = ["name", "repo", "path", "start_row", "start_col"]


def distinct_in_order(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))


def first_of_each(rows: DataFrame, value: str, place: str) -> DataFrame:
    """Each value once, with the place where it stands first."""
    return rows.groupBy(value).agg(F.min(place).alias("first"))


def joined(rows: DataFrame, files: DataFrame, repos: DataFrame, names: list[str] | None = None, repo: str | None = None) -> DataFrame:
    """Symbols or references with their file and repository; predicates reach the scans."""
    if names is not None:
        rows = rows.where(F.col("name").isin(names))
    owners = repos.select("repo_id", F.col("name").alias("repo"))
    if repo is not None:
        owners = owners.where(F.col("repo") == repo)
    columns = ["file_id", "repo_id", "path", "language", "sha"] + (["partial"] if "partial" in files.columns else [])
    return rows.join(files.select(*columns).join(owners, "repo_id"), "file_id")


def requested(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``ordinal``, the place of each row's name in the request."""
    order = F.create_map(*[x for i, n in enumerate(distinct_in_order(names)) for x in (F.lit(n), F.lit(i))])
    return rows.withColumn("ordinal", order[F.col("name")])


def ranked(rows: DataFrame, by: list[str | Column] = ORDER, key: str = "name") -> DataFrame:
    """Adds ``rank`` (1-based) inside each name, in the stable order."""
    rest = [c for c in by if c != key]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*rest)).cast("long"))


def quota(limit: int, names: int) -> int:
    """Rows for each name: the limit, raised to the number of names, shared evenly."""
    return max(1, max(limit, names) // max(1, names))


def fair_page(rows: DataFrame, limit: int, names: int, offset: int = 0, by: list[str | Column] = ORDER) -> DataFrame:
    """Each name's rows from the shared offset on, as many as its quota."""
    most = quota(limit, names)
    return ranked(rows, by).where((F.col("rank") > offset) & (F.col("rank") <= offset + most))


def lookahead(rows: DataFrame, by: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a stream with each row's ``position`` in it (0-based) and ``more``: is there a row after the page?  A page
    near the top takes one row beyond it, never the whole stream; a large or deep one comes from distributed ordinals."""
    if offset + limit >= ordered.NEAR:
        whole = ordered.ordered(rows, by)
        return whole.page(offset, limit, "position").withColumn("more", F.lit(whole.total > offset + limit))
    some = ordered.page(rows, by, limit + 1, offset, "position")
    return some.withColumn("more", F.max("position").over(Window.partitionBy()) >= offset + limit).where(F.col("position") < offset + limit)


def truncated_names(rows: DataFrame, limit: int, names: int, offset: int = 0) -> DataFrame:
    """Names with more rows than their page shows, and how many there are."""
    most = quota(limit, names)
    counted = rows.groupBy("name").agg(F.count("*").alias("total"))
    return counted.where(F.col("total") - offset > most)


def kinds(symbols: DataFrame) -> DataFrame:
    return symbols.select("kind").distinct()


def kind_filtered_out(rows: DataFrame, kind: str) -> DataFrame:
    """For names of which the kind leaves nothing: the kinds that were found."""
    found = rows.groupBy("name", "kind").agg(F.count("*").alias("n"))
    names = found.groupBy("name").agg(F.max((F.col("kind") == kind).cast("int")).alias("has"))
    return found.join(names.where("has = 0").select("name"), "name")


def matching(rows: DataFrame, path_filter: Column | None = None, exclude_tests: bool = False, include_declarations: bool = True) -> DataFrame:
    if path_filter is not None:
        rows = rows.where(path_filter)
    if exclude_tests:
        rows = rows.where(~tx.is_test_path(F.col("path")))
    if not include_declarations:
        rows = rows.where(F.col("context") != "declaration")
    return rows


def any_file(files: DataFrame, path_filter: Column) -> bool:
    """Does the filter leave any file?  Stops at the first."""
    return bool(files.where(path_filter).limit(1).count())


def verified(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose content still has the indexed hash (``stale`` false), with the content."""
    live = sources.select("file_id", "content")
    return files.join(live, "file_id", "left").withColumn("stale", ~F.coalesce(F.sha2("content", 256) == F.col("sha"), F.lit(False)))


def readable(sources: DataFrame, literals: list[list[str]] | None = None, most: int = 2 << 20) -> DataFrame:
    """Sources that a pattern may be run on: not too large, no NUL in the first KiB, and,
    if given, with all literals of at least one alternative."""
    out = sources.where((F.octet_length("content") <= most) & (F.instr(F.hex(F.substring("content", 1, 1024)), "00") % 2 != 1) | (F.octet_length("content") == 0))
    if literals:
        text = F.col("content").cast("string")
        fits = F.lit(False)
        for needles in literals:
            own = F.lit(True)
            for needle in needles:
                own = own & text.contains(needle)
            fits = fits | own
        out = out.where(fits)
    return out
