"""Copy-on-write overlays: a private delta and masks over an immutable base.

The merged views are plain unions of filtered scans, so name and file predicates
reach the scans of both arms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_base(base_files: DataFrame, private_files: DataFrame, state: DataFrame) -> DataFrame:
    """Base files that no private file shadows and no mask hides; observed times and sizes take the place of the base's."""
    seen = state.select("path", "hidden", F.col("mtime_ns").alias("s_mtime"), F.col("byte_size").alias("s_size"))
    out = base_files.join(private_files.select("path"), "path", "left_anti").join(seen, "path", "left").where(~F.coalesce("hidden", F.lit(False)))
    return out.withColumns({"mtime_ns": F.coalesce("s_mtime", F.lit(0).cast("long")), "byte_size": F.coalesce("s_size", "byte_size")}).drop("hidden", "s_mtime", "s_size")


def merged_files(base_files: DataFrame, private_files: DataFrame, state: DataFrame, repo_id: int | None = None) -> DataFrame:
    """Private files and visible base files; base ids are negative and their repository is the overlay's."""
    base = visible_base(base_files, private_files, state).withColumn("file_id", -F.col("file_id"))
    if repo_id is not None:
        base = base.withColumn("repo_id", F.lit(repo_id).cast("long"))
    return private_files.unionByName(base, allowMissingColumns=True)


def merged_rows(base_rows: DataFrame, private_rows: DataFrame, base_visible: DataFrame, key: str) -> DataFrame:
    """Symbols or references of the merged files; ids of the base are negative."""
    base = base_rows.join(base_visible.select("file_id"), "file_id", "left_semi").withColumns({"file_id": -F.col("file_id"), key: -F.col(key)})
    return private_rows.unionByName(base, allowMissingColumns=True)


def reusable(files: DataFrame, base_files: DataFrame) -> DataFrame:
    """Files whose extraction the base has already: the same path, language and bytes."""
    return files.join(base_files.select("path", "language", "sha", F.col("file_id").alias("base_id")), ["path", "language", "sha"])


def hide(state: DataFrame, paths: DataFrame) -> DataFrame:
    """Mask these paths of the base."""
    new = paths.select("path", F.lit(-2).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("byte_size"), F.lit(True).alias("hidden"))
    return state.join(new.select("path"), "path", "left_anti").unionByName(new)


def observe(state: DataFrame, seen: DataFrame) -> DataFrame:
    """The base's bytes stand at these paths, with these times and sizes."""
    new = seen.select("path", "mtime_ns", "byte_size", F.lit(False).alias("hidden"))
    return state.join(new.select("path"), "path", "left_anti").unionByName(new)


def restore(state: DataFrame, private_files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop masks and private copies of these paths: the base shows again."""
    p = paths.select("path")
    return state.join(p, "path", "left_anti"), private_files.join(p, "path", "left_anti")


def changed_sources(files: DataFrame, live: DataFrame) -> DataFrame:
    """Visible files whose time, size or hash isn't that of the live source; none may be left before publishing."""
    now = live.select("path", F.col("mtime_ns").alias("l_mtime"), F.col("byte_size").alias("l_size"), F.col("sha").alias("l_sha"))
    out = files.join(now, "path", "left")
    same = (F.col("mtime_ns") == F.col("l_mtime")) & (F.col("byte_size") == F.col("l_size")) & (F.col("sha") == F.col("l_sha"))
    return out.where(~F.coalesce(same, F.lit(False))).select(*files.columns)
