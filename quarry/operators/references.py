"""Reference totals, exact counts, pages and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokens import occurrences_by_row
from . import ordered
from .lookup import ORDER


def totals(refs: DataFrame) -> DataFrame:
    """One row: rows, distinct files (exact) and whether any file is partial."""
    partial = F.bool_or("partial") if "partial" in refs.columns else F.lit(False)
    # distinct files first: partial sums by file leave little for the single last row
    by_file = refs.groupBy("repo", "path").agg(F.count("*").alias("n"), partial.alias("p"))
    return by_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("total_files"), F.coalesce(F.bool_or("p"), F.lit(False)).alias("partial"))


def counts_by_file(refs: DataFrame) -> DataFrame:
    return refs.groupBy("repo", "path").agg(F.count("*").alias("n"))


def counts_by_name(refs: DataFrame) -> DataFrame:
    return refs.groupBy("name").agg(F.count("*").alias("n"))


def tagged(refs: DataFrame, names: DataFrame) -> DataFrame:
    """References that stand where a definition spells its name (file_id, start_row, start_col, end_row, end_col) are declarations."""
    span = ["file_id", "start_row", "start_col", "end_row", "end_col"]
    own = names.select(*span).distinct().withColumn("_own", F.lit(True))
    out = refs.join(own, span, "left")
    return out.withColumn("context", F.when(F.col("_own"), "declaration").otherwise(F.col("context"))).drop("_own")


def page(refs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One window over all names, in the stable order.  A deep page reads the parts of the order that it lies in."""
    return ordered.page(refs, [*ORDER, "end_row", "end_col"], limit, offset).drop("ordinal")


def grouped(rows: DataFrame) -> DataFrame:
    """A page's rows by file; the references in their order."""
    ref = F.struct("name", "start_row", "start_col", "end_row", "end_col", "context")
    return rows.groupBy("repo", "path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(ref)).alias("refs"))


def with_snippets(refs: DataFrame, lines: DataFrame, n: int = 1) -> DataFrame:
    """Adds ``snippet`` and, for several lines, ``snippet_start_row``; ``lines`` has each file's array of lines."""
    n = max(1, min(20, n))
    out = refs.join(lines.select("file_id", "lines"), "file_id", "left")
    around = tx.slice_lines(F.col("lines"), F.col("start_row"), F.col("end_row"), n - 1)
    if n == 1:
        return out.withColumns({"snippet": tx.first_snippet(around), "snippet_start_row": F.lit(None).cast("long")}).drop("lines")
    return out.withColumns({"snippet": F.array_join(around, "\n"), "snippet_start_row": F.greatest(F.col("start_row") - (n - 1), F.lit(0)).cast("long")}).drop("lines")


#: Bytes of different snippets in a part: the dictionary of a Parquet column ends at 1 MB, and each further row spells its snippet out.
DICTIONARY = 3 << 18


def snippet_parts(texts: DataFrame, n: int) -> int:
    """In how many parts each has about ``DICTIONARY`` bytes of different snippets.  A line stands in those of at most 2n - 1 rows."""
    size = F.octet_length("text")
    rows = size - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    held = texts.agg(F.sum(size.cast("long") * F.least(rows, F.lit(2 * n - 1)))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-held // DICTIONARY))


def found_with_snippets(texts: DataFrame, n: int = 1) -> DataFrame:
    """The occurrences in plain texts (file_id, text; an id for each) with snippets, as ``with_snippets`` gives them.  What is
    found stays beside its text and each row is cut once.  All words of a line have its snippet, so that the rows are many
    times the texts: texts, never occurrences, are dealt out to parts so small that a file which is written of one spells
    each snippet once."""
    n = max(1, min(20, n))
    texts = texts.where("file_id IS NOT NULL")
    found = occurrences_by_row(texts, parts=snippet_parts(texts, n)).withColumn("lines", tx.lines(F.col("text")))

    def cut(_, row):
        around = tx.slice_lines(F.col("lines"), row, row, n - 1)
        return tx.first_snippet(around) if n == 1 else F.array_join(around, "\n")

    rows = found.select("file_id", F.arrays_zip(F.transform("lines", cut).alias("snippet"), F.col("found").alias("found")).alias("rows"))
    # an inner one would bring a filter on its size that is computed from the text again, line by line
    rows = rows.select("file_id", F.posexplode_outer("rows").alias("start_row", "at")).select("file_id", F.col("start_row").cast("long").alias("start_row"), F.col("at.snippet").alias("snippet"), F.inline("at.found"))
    first = F.lit(None) if n == 1 else F.greatest(F.col("start_row") - (n - 1), F.lit(0))
    return rows.select("file_id", "name", "start_row", "start_col", "end_row", "end_col", "context", "snippet", first.cast("long").alias("snippet_start_row"))
