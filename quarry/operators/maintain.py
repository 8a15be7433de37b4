"""Incremental builds: what changed, merges by key, purges and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import ordered

MOST_BYTES = 2 << 20
KEY = ["repo_id", "path"]
OUTCOMES = ["indexed", "touched", "skipped", "failed", "binary", "unreadable"]


def classified(walked: DataFrame, stored: DataFrame, base: DataFrame | None = None, force: bool = False) -> DataFrame:
    """What a build does with each walked file (repo_id, path, language, mtime_ns, byte_size, readable, binary, sha).

    The order decides: unreadable, too large, unchanged by time and size, binary, the same bytes (touched if
    only the time differs), the same bytes as the base, else indexed.  A stored time below zero asks for a
    new extraction.
    """
    old = stored.select(*KEY, F.col("language").alias("o_language"), F.col("sha").alias("o_sha"), F.col("mtime_ns").alias("o_mtime"), F.col("byte_size").alias("o_size"))
    out = walked.join(old, KEY, "left")
    same = F.coalesce((F.col("sha") == F.col("o_sha")) & (F.col("language") == F.col("o_language")) & (F.col("o_mtime") >= 0), F.lit(False))
    fast = F.coalesce((F.col("language") == F.col("o_language")) & (F.col("o_mtime") > 0) & (F.col("mtime_ns") == F.col("o_mtime")) & (F.col("byte_size") == F.col("o_size")), F.lit(False))
    reused: Column = F.lit(False)
    if base is not None:
        known = base.select("path", F.col("language").alias("b_language"), F.col("sha").alias("b_sha"))
        out = out.join(known, "path", "left")
        reused = F.coalesce((F.col("sha") == F.col("b_sha")) & (F.col("language") == F.col("b_language")), F.lit(False))
    outcome = F.when(~F.col("readable"), "unreadable").when(F.col("byte_size") > MOST_BYTES, "binary")
    if not force:
        outcome = outcome.when(fast, "unchanged")
    outcome = outcome.when(F.col("binary"), "binary").when(same, F.when(F.col("mtime_ns") != F.col("o_mtime"), "touched").otherwise("unchanged"))
    return out.withColumns({"outcome": outcome.when(reused, "reused").otherwise("indexed")}).drop("o_language", "o_sha", "o_mtime", "o_size", "b_language", "b_sha")


def build_stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def upserted(stored: DataFrame, changed: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of ``changed`` replace those with the same key."""
    return stored.join(changed.select(*key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def replaced_children(rows: DataFrame, changed_files: DataFrame, fresh: DataFrame) -> DataFrame:
    """All rows of a changed file go; the fresh ones come."""
    return rows.join(changed_files.select("file_id"), "file_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def touched(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """New times and sizes; everything else stays."""
    new = seen.select(*KEY, F.col("mtime_ns").alias("n_mtime"), F.col("byte_size").alias("n_size"))
    out = stored.join(new, KEY, "left")
    return out.withColumns({"mtime_ns": F.coalesce("n_mtime", "mtime_ns"), "byte_size": F.coalesce("n_size", "byte_size")}).drop("n_mtime", "n_size")


def without_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Files outside a deleted file or folder."""
    return files.where(~tx.under(F.col("path"), prefix))


def cascade(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Child rows whose file is still there."""
    return rows.join(files.select("file_id"), "file_id", "left_semi")


def purged(stored: DataFrame, present: DataFrame, active: DataFrame, scope: list[str] | None = None, repos: DataFrame | None = None) -> DataFrame:
    """Stored files that stay: their source is there, and they are active or of a language outside the scope.
    Repositories that this build doesn't touch stay as they are."""
    here, own = present.select(*KEY).distinct().withColumn("here", F.lit(True)), active.select(*KEY).distinct().withColumn("active", F.lit(True))
    out = stored.join(here, KEY, "left").join(own, KEY, "left")
    inside = F.lit(True) if scope is None else F.col("language").isin(scope)
    keep = F.col("here").isNotNull() & (F.col("active").isNotNull() | ~inside)
    if repos is not None:
        out = out.join(repos.select("repo_id", F.lit(True).alias("built")), "repo_id", "left")
        keep = keep | F.col("built").isNull()
    return out.where(keep).select(*stored.columns)


def synced_repos(stored: DataFrame, configured: DataFrame, prune: bool = False) -> DataFrame:
    """Configured repositories with their roots; others stay unless pruned."""
    new = configured.select("name", F.col("root_path").alias("n_root"))
    out = stored.join(new, "name", "full").withColumns({"root_path": F.coalesce("n_root", "root_path"), "repo_id": F.coalesce("repo_id", F.xxhash64("name"))})
    if prune:
        out = out.where(F.col("n_root").isNotNull())
    return out.select("repo_id", "name", "root_path")


def vanished(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Stored paths that the walk of changed paths didn't find again."""
    return stored.join(resolved.select(*KEY), KEY, "left_anti")


def below(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Files at or below one of the prefixes (repo_id, prefix; the empty one is the whole repository).  A file is joined to its
    own prefixes, by equality, so that many changed paths are one join and no long condition."""
    parts = F.split("path", "/")
    own = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    hit = files.select("repo_id", "path", F.explode(own).alias("prefix")).join(prefixes.select("repo_id", "prefix").distinct(), ["repo_id", "prefix"]).select("repo_id", "path").distinct()
    return files.join(hit, ["repo_id", "path"], "left_semi")


#: Parts that the paths below one root are joined in.
SHARES = 256


def owning_repo(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """The repository with the deepest root above each path.  A path is joined to its own prefixes, by equality.  Most paths
    share their upper folders: each root stands in ``SHARES`` shares, and a path is joined in the one of its hash."""
    parts = F.split("path", "/")
    share = F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int").alias("_share")
    up = paths.select("path", share, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root_path"))
    roots = repos.select("root_path", F.col("name").alias("repo"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    found = up.join(roots, ["root_path", "_share"])
    return found.groupBy("path").agg(F.max_by("repo", F.struct(F.length("root_path"), "repo")).alias("repo"))


#: Files and folders whose events are not sources.
IGNORED_NAMES = [".DS_Store"]
IGNORED_SUFFIX = ".tsbuildinfo"
CONTROL_FOLDERS = [
    ".cache", ".git", ".logs", ".next", ".nuxt", ".parcel-cache", ".pids", ".playwright-mcp", ".pnpm-store", ".svelte-kit",
    ".sst", ".tmp", ".turbo", ".vercel", ".vite", ".yarn", "coverage", "node_modules", "tmp",
]
IGNORED_PAIR = (".claude", "worktrees")


def relevant(path: Column, database: str = ".quarry") -> Column:
    """Can an event on this path (relative to its repository) change the index?"""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.element_at(parts, -1)
    pair = F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")).contains("/" + "/".join(IGNORED_PAIR) + "/")
    return ~pair & ~name.isin(IGNORED_NAMES) & ~name.endswith(IGNORED_SUFFIX) & ~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in [*CONTROL_FOLDERS, database])))


def changes_of(events: DataFrame, window_seconds: int) -> DataFrame:
    """events (at long seconds, path, kind): the distinct paths of each window and whether all must be scanned again.  A window
    opens at the first event after the one before, so steady writes can't put an update off, and an idle time has none.
    Access isn't a change."""
    real = events.where(F.col("kind") != "access").withColumn("_feed", F.lit(0))
    starts = ordered.window_starts(real, window_seconds, keys=["_feed"])
    times = ordered.neighbours(real.select("_feed", "at").distinct(), starts, ["_feed"], "at").select("at", F.col("below.at").alias("window"))
    return real.join(times, "at").groupBy("window", "path").agg(F.bool_or(F.col("kind") == "overflow").alias("rescan"))
