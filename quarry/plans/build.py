"""Builds: full, incremental and of changed paths, and overlays over a base.

One left join decides what happens to each file; only files that need it reach the
extractor; the result becomes a layer above the generation, in proportion to the change, or a new
generation where there is none or most of it changes.  Nothing is published if nothing changed.
What a build has seen of the sources is written beside the index before it is used.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILES, SCHEMA_VERSION, InvalidArguments
from ..operators import maintain, overlay, rollups
from ..sources import ignore, walk
from ..sources.config import Config, Repo, allowed_languages
from ..sources.extract.symbols import extracted
from ..sources.languages import BY_ID
from ..sources.worktrees import discover
from .store import TABLES, WHOLE_SHARE, Store

FINGERPRINTS = {"files": ["repo_id", "path", "language", "sha", "partial"], "symbols": ["file_id", "kind", "name", "start_row", "start_col", "end_row", "end_col"], "refs": ["file_id", "name", "start_row", "start_col", "context"]}

#: What a generation without a base has in its manifest.
STANDALONE = {"base": "", "base_identity": "", "directory": 0, "fingerprint": {}}


@dataclass
class Stats:
    indexed: int = 0
    touched: int = 0
    skipped: int = 0
    failed: int = 0


def file_id() -> F.Column:
    """Ids follow from repository and path, so they are the same on every run and on every executor; always positive."""
    return F.abs(F.xxhash64("repo_id", "path") % F.lit(1 << 62)) + 1


def repo_id(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())


class Builder:
    def __init__(self, spark: SparkSession, store: Store, config: Config):
        self.spark, self.store, self.config = spark, store, config

    def workspace(self, repo: Repo, languages: list[str]) -> walk.Workspace:
        foreign = [r.root for r in self.config.repos if r.name != repo.name] + [c.path for c in discover(repo.root) if os.path.realpath(repo.root) != c.path]
        return walk.Workspace(repo.name, os.path.realpath(repo.root), tuple(languages), tuple(repo.ignore), tuple(foreign))

    def repos(self, only: str | None = None) -> list[Repo]:
        found = [r for r in self.config.repos if only is None or r.name == only]
        if only is not None and not found:
            raise InvalidArguments(f"unknown repository {only!r}; known: {', '.join(r.name for r in self.config.repos)}")
        return found

    def walked(self, repos: list[Repo], languages: list[str], paths: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
        """(sources that are to be indexed, all paths that are there)."""
        spaces = [(repo_id(r.name), self.workspace(r, allowed_languages(languages, r, self.config))) for r in repos]
        found = self.store.land(walk.paths(self.spark, spaces, paths), "walk")
        return walk.sources(found), found.select("repo_id", "path")

    def build(self, incremental: bool = True, only: str | None = None, languages: list[str] = (), prune: bool = True, whole: bool = False) -> Stats:
        repos = self.repos(only)
        force = not incremental
        files, stored_repos = self.store.read("files"), self.store.read("repos")
        configured = self.spark.createDataFrame([(repo_id(r.name), r.name, os.path.realpath(r.root)) for r in self.config.repos], "repo_id long, name string, root_path string")
        synced = maintain.synced_repos(stored_repos, configured, prune=prune and only is None)
        synced = synced.join(configured.select("name", F.col("repo_id").alias("c_id")), "name", "left").select(F.coalesce("c_id", "repo_id").alias("repo_id"), "name", "root_path")
        sources, there = self.walked(repos, list(languages))
        built = self.spark.createDataFrame([(repo_id(r.name),) for r in repos], "repo_id long")
        scope = list(languages) or None
        owned = files.join(synced.select("repo_id"), "repo_id", "left_semi")
        active = sources.where(~F.col("binary") & (F.col("byte_size") <= maintain.MOST_BYTES) | ~F.col("readable"))
        staying = maintain.purged(owned, there, active, scope, built)
        return self.merge(sources, files, files.join(staying.select("file_id"), "file_id", "left_anti"), synced, force, whole)

    def marker(self) -> dict:
        text = json.dumps(asdict(self.config), sort_keys=True)
        return {"config": hashlib.sha256(text.encode()).hexdigest(), "generation": self.store.manifest().generation}

    def refresh(self, interval_ms: int) -> Stats | None:
        """Build, unless the same configuration saw this generation less than the interval ago (0: always build)."""
        text = self.store._text("REFRESHED")
        seen = json.loads(text) if text else {}
        if interval_ms and {k: seen.get(k) for k in ("config", "generation")} == self.marker() and time.time() * 1000 - seen["at"] < interval_ms:
            return None
        stats = self.build()
        self.store._write("REFRESHED", json.dumps(self.marker() | {"at": int(time.time() * 1000)}))
        return stats

    def update(self, changed: list[str]) -> Stats:
        """Only what lies at or below the changed paths.  A changed rule file stands for its folder."""
        paths: dict[str, list[str]] = {}
        by_depth = sorted(self.config.repos, key=lambda r: -len(os.path.realpath(r.root)))
        for p in changed:
            full = os.path.realpath(p)
            owner = next((r for r in by_depth if full == os.path.realpath(r.root) or full.startswith(os.path.realpath(r.root) + "/")), None)
            if owner is None:
                continue
            relative = os.path.relpath(full, os.path.realpath(owner.root))
            relative = "" if relative == "." else relative
            folder = ignore.governed_folder(relative)
            paths.setdefault(owner.name, []).append(relative if folder is None else folder)
        repos = [r for r in self.config.repos if r.name in paths]
        if not repos:
            return Stats()
        files, stored = self.store.read("files"), self.store.read("repos")
        sources, there = self.walked(repos, [], paths)
        prefixes = self.spark.createDataFrame([(repo_id(r.name), p) for r in repos for p in paths[r.name]], "repo_id long, prefix string")
        return self.merge(sources, files, maintain.vanished(maintain.below(files, prefixes), there), stored, False)

    def merge(self, sources: DataFrame, files: DataFrame, gone: DataFrame, repos: DataFrame, force: bool, whole: bool = False) -> Stats:
        """``gone``: stored files that go.  ``whole``: publish a generation without a base, and only if every source could be
        read and none has changed."""
        store = self.store
        # an older schema asks for a new extraction of everything
        known = files.withColumn("mtime_ns", F.lit(-1).cast("long")) if store.outdated() else files
        try:
            outcome = store.land(maintain.classified(sources, known, force=force), "outcome")
            counts = {r.outcome: r.n for r in maintain.build_stats(outcome).collect()}
            fresh = store.land(extracted(outcome.where("outcome = 'indexed'").withColumn("file_id", file_id())), "fresh")
            lost = store.land(gone.select("file_id", F.lit(True).alias("rows")), "lost")
            failed = fresh.where("failed").count() if counts.get("indexed") else 0
            n_lost, m = lost.count(), store.manifest()
            stats = Stats(counts.get("indexed", 0) - failed, counts.get("touched", 0), counts.get("unchanged", 0), failed + counts.get("unreadable", 0))
            same_repos = repos.exceptAll(store.read("repos")).count() == 0 and store.read("repos").exceptAll(repos).count() == 0
            if whole and stats.failed:
                return stats
            if not whole and not stats.indexed and not stats.touched and not n_lost and same_repos and m.ready and not store.outdated():
                return stats
            good = fresh.where("NOT failed").select("file_id", "partial", "symbols", "refs")
            new = outcome.where("outcome = 'indexed'").withColumn("file_id", file_id()).join(good.select("file_id", "partial"), "file_id").select("file_id", "repo_id", "path", "language", "sha", "mtime_ns", "byte_size", "partial")
            seen = outcome.where("outcome = 'touched'")
            s = good.select("file_id", F.explode("symbols").alias("x")).select("file_id", "x.*").withColumn("symbol_id", F.xxhash64("file_id", "kind", "name", "start_row", "start_col", "end_row", "end_col"))
            r = good.select("file_id", F.explode("refs").alias("x")).select("file_id", "x.*").withColumn("ref_id", F.xxhash64("file_id", "name", "start_row", "start_col", "context"))
            if m.folder and not whole and not store.outdated() and WHOLE_SHARE * (stats.indexed + stats.touched + n_lost) <= store.base_files():
                here = files.join(seen.select(*maintain.KEY), maintain.KEY, "left_semi").join(lost, "file_id", "left_anti")
                replaced = files.join(new.select(*maintain.KEY), maintain.KEY, "left_semi").select("file_id", F.lit(True).alias("rows"))
                hidden = lost.unionByName(replaced).unionByName(here.select("file_id", F.lit(False).alias("rows")))
                store.publish_delta({"repos": repos, "files": maintain.touched(here, seen).unionByName(new), "symbols": s, "refs": r}, hidden)
                return stats
            staying = files.join(lost, "file_id", "left_anti")
            merged = maintain.upserted(maintain.touched(staying, seen), new)
            keep = merged.select("file_id")
            symbols = maintain.replaced_children(store.read("symbols").join(keep, "file_id", "left_semi"), new, s)
            refs = maintain.replaced_children(store.read("refs").join(keep, "file_id", "left_semi"), new, r)
            if whole and (changed := overlay.changed_sources(merged, self.walked(self.config.repos, [])[0]).count()):
                raise RuntimeError(f"{changed} sources changed while the index was built")
            store.publish({"repos": repos, "files": merged, "symbols": symbols, "refs": refs}, **(STANDALONE if whole else {}))
            return stats
        finally:
            store.sweep()


class Overlay:
    """A checkout's own generation over an immutable base: only what differs is extracted and kept."""

    def __init__(self, spark: SparkSession, base: Store, own: Store, config: Config):
        if len(config.repos) != 1:
            raise InvalidArguments("an overlay has one repository")
        self.spark, self.base, self.own, self.config = spark, base, own, config

    def identity(self) -> str:
        m = self.base.manifest()
        return m.identity or f"{m.generation}:{m.folder}"

    def state(self) -> DataFrame:
        m = self.own.manifest()
        if not m.folder:
            return self.spark.createDataFrame([], "path string, mtime_ns long, byte_size long, hidden boolean")
        return self.spark.read.schema("path string, mtime_ns long, byte_size long, hidden boolean").parquet(f"{self.own.root}/{m.folder}-state")

    def usable(self) -> bool:
        """Is the base there, complete, of this schema and without files that wait for extraction?"""
        try:
            m = self.base.manifest()
        except RuntimeError:  # a newer schema
            return False
        if not m.ready or m.schema_version != SCHEMA_VERSION or not all(self.base.holds(t, m) for t in TABLES):
            return False
        return self.base.read("files", m).where("mtime_ns = -1").isEmpty()

    def own_checkout(self) -> bool:
        """Does the published generation belong to the configured repository?"""
        own = self.config.repos[0]
        return [(r.name, r.root_path) for r in self.own.read("repos").limit(2).collect()] == [(own.name, os.path.realpath(own.root))]

    def recover(self) -> Stats:
        """Build the checkout as an index of its own.  What is published stays as it is if a source fails."""
        return Builder(self.spark, self.own, self.config).build(incremental=False, whole=True)

    def refresh(self, prune: bool = True) -> bool:
        """Reconcile with the checkout, by content; publish only if that changes what is seen.  True if it was published.

        A base that is gone, replaced or of another schema can't be derived from any more: the checkout becomes an index
        of its own, and stays one.  So does one that is configured otherwise now; without ``prune`` that is refused, since
        the repository that is published would be lost."""
        m = self.own.manifest()
        if m.folder and not m.base:
            Builder(self.spark, self.own, self.config).build(prune=prune)
            return self.own.manifest().generation != m.generation
        if m.folder and not self.own_checkout():
            if not prune:
                raise InvalidArguments("the overlay holds another repository, which would be lost; choose another folder for the index")
            self.recover()
            return self.own.manifest().generation != m.generation
        if not self.usable() or m.folder and m.base_identity != self.identity():
            self.recover()
            return self.own.manifest().generation != m.generation
        builder = Builder(self.spark, self.own, self.config)
        sources, there = builder.walked(builder.repos(), [])
        base_files = self.base.read("files")
        outcome = maintain.classified(sources.where("readable AND NOT binary"), self.own.read("files") if m.folder else self.spark.createDataFrame([], base_files.schema), base=base_files, force=True)
        try:
            outcome = self.own.land(outcome, "outcome")
            reused = outcome.where("outcome = 'reused'").select("path", "mtime_ns", "byte_size", F.lit(False).alias("hidden"))
            hidden = base_files.join(sources.where("readable AND NOT binary").select("path"), "path", "left_anti").select("path", F.lit(-2).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("byte_size"), F.lit(True).alias("hidden"))
            state = reused.unionByName(hidden)
            fresh = outcome.where("outcome IN ('indexed', 'touched', 'unchanged')").join(base_files.select("path", "language", "sha"), ["path", "language", "sha"], "left_anti").withColumn("file_id", file_id())
            parsed = self.own.land(extracted(fresh), "fresh")
            if not parsed.where("failed").isEmpty():
                return False
            new = fresh.join(parsed.select("file_id", "partial"), "file_id").select("file_id", "repo_id", "path", "language", "sha", "mtime_ns", "byte_size", "partial")
            s = parsed.select("file_id", F.explode("symbols").alias("x")).select("file_id", "x.*").withColumn("symbol_id", F.xxhash64("file_id", "kind", "name", "start_row", "start_col", "end_row", "end_col"))
            r = parsed.select("file_id", F.explode("refs").alias("x")).select("file_id", "x.*").withColumn("ref_id", F.xxhash64("file_id", "name", "start_row", "start_col", "context"))
            prints = {n: [str(v) for v in rollups.fingerprint(t, FINGERPRINTS[n]).first()] for n, t in (("files", new), ("symbols", s), ("refs", r))}
            prints["state"] = [str(v) for v in rollups.fingerprint(state.select("path", "hidden"), ["path", "hidden"]).first()]
            if m.folder and prints == m.fingerprint:
                return False
            if changed := overlay.changed_sources(new, self.live()).count():
                raise RuntimeError(f"{changed} sources changed while the overlay was built")
            name = self.config.repos[0]
            repos = self.spark.createDataFrame([(repo_id(name.name), name.name, os.path.realpath(name.root))], "repo_id long, name string, root_path string")
            # the masks are written first: the pointer is replaced last
            merged = overlay.merged_files(base_files, new, state, repo_id(name.name))
            published = _publish_with_state(self.own, merged, {"repos": repos, "files": new, "symbols": s, "refs": r}, state, base=self.base.root, base_identity=self.identity(), fingerprint=prints)
            return bool(published)
        finally:
            self.own.sweep()

    def live(self) -> DataFrame:
        builder = Builder(self.spark, self.own, self.config)
        return builder.walked(builder.repos(), [])[0]

    def directory(self) -> DataFrame | None:
        """The resolved files, where those of this very generation stand beside it."""
        m = self.own.manifest()
        return self.spark.read.schema(FILES).parquet(f"{self.own.root}/{m.folder}-files") if m.directory == m.generation else None

    def read(self, table: str) -> DataFrame:
        """The merged view: private rows and what shows of the base.  With a directory that is one semi join for symbols
        and references, and none for files; without one, the masks are merged again."""
        m = self.own.manifest()
        if table == "repos" or not m.base:
            return self.own.read(table)
        if m.base_identity != self.identity():
            raise RuntimeError("the base isn't the one that the overlay was built on; refresh it")
        directory = self.directory()
        if table == "files" and directory is not None:
            return directory
        base_files, private = self.base.read("files"), self.own.read("files")
        if table == "files":
            return overlay.merged_files(base_files, private, self.state(), repo_id(self.config.repos[0].name))
        key = "symbol_id" if table == "symbols" else "ref_id"
        shown = overlay.visible_base(base_files, private, self.state()) if directory is None else directory.where("file_id < 0").select((-F.col("file_id")).alias("file_id"))
        return overlay.merged_rows(self.base.read(table), self.own.read(table), shown, key)

    def manifest(self):
        return self.own.manifest()


def _publish_with_state(store: Store, merged: DataFrame, tables: dict[str, DataFrame], state: DataFrame, **more):
    """As Store.publish, with the masks and the resolved files beside the generation."""
    generation = store.manifest().generation + 1
    folder = f"gen-{generation:08d}-{uuid.uuid4().hex[:8]}"
    state.write.parquet(f"{store.root}/{folder}-state")
    merged.select(*(merged[f.name].cast(f.dataType) for f in FILES)).write.parquet(f"{store.root}/{folder}-files")
    return store.publish(tables, folder=folder, directory=generation, **more)


def known_languages() -> list[str]:
    return list(BY_ID)
