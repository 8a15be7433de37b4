"""Workspaces on disk as DataFrames: which files there are, and their contents.

Tasks walk one top-level entry of a workspace each, and other tasks read the files,
a slice of paths each, so sources must lie in storage that all executors see.  The
driver lists top-level entries only.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import ignore
from .languages import detect

MOST_BYTES, BINARY_PROBE = 2 << 20, 1024


@dataclass(frozen=True)
class Workspace:
    name: str
    root: str
    languages: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    foreign: tuple[str, ...] = field(default=())


def walk(workspace: Workspace, only: list[str] | None = None) -> list[str]:
    """Relative paths of files, sorted.  Hidden files count, links aren't followed, other workspaces' roots are
    left out.  ``only`` limits the walk to these paths and what lies below them, under the same rules."""
    root = os.path.realpath(workspace.root)
    foreign = {os.path.realpath(x) for x in workspace.foreign}
    wanted = None if only is None else sorted({p.strip("/") for p in only})
    out: list[str] = []

    def near(path: str, folder: bool) -> bool:
        if wanted is None or "" in wanted:
            return True
        return any(path == w or path.startswith(w + "/") or folder and w.startswith(path + "/") for w in wanted)

    def visit(folder: str, rules: ignore.Rules) -> None:
        rules = ignore.enter(rules, root, folder)
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() or e.name == ".git":
                continue
            inside = e.is_dir(follow_symlinks=False)
            if not near(path, inside) or rules.ignored(path, inside):
                continue
            if inside:
                if os.path.join(root, path) not in foreign:
                    visit(path, rules)
            elif e.is_file(follow_symlinks=False):
                out.append(path)

    visit("", ignore.top_rules(root, list(workspace.ignore)))
    return sorted(out)


def head_of(path: str, size: int = 256) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read(size)
    except OSError:
        return b""


def languages_of(workspace: Workspace, paths: list[str]) -> dict[str, str]:
    """Detected languages of the paths, within the workspace's allow-list if it has one."""
    out = {}
    for p in paths:
        full = os.path.join(workspace.root, p)
        found = detect(p, b"" if "." in p.rsplit("/", 1)[-1] else head_of(full))
        if found and (not workspace.languages or found in workspace.languages):
            out[p] = found
    return out


SOURCES = "repo_id long, path string, language string, mtime_ns long, byte_size long, readable boolean, binary boolean, sha string, content binary"


PATHS = "repo_id long, root string, path string, language string"


def entries(workspace: Workspace, only: list[str] | None = None) -> list[str]:
    """What a walk is dealt out by: the top-level entries, or the asked-for paths below them."""
    try:
        top = sorted(os.listdir(workspace.root))
    except OSError:
        return []
    if only is None or "" in only:
        return top
    return sorted({p.strip("/") for p in only})


def paths(spark: SparkSession, workspaces: list[tuple[int, Workspace]], only: dict[str, list[str]] | None = None) -> DataFrame:
    """PATHS of all files of the workspaces (or of the paths asked for); the language is null where none is known or allowed."""
    rows = [(i, w.name, w.root, list(w.languages), list(w.ignore), list(w.foreign), e) for i, w in workspaces for e in entries(w, None if only is None else only.get(w.name, []))]
    frame = spark.createDataFrame(rows, "repo_id long, name string, root string, languages array<string>, ignore array<string>, foreign array<string>, entry string")
    frame = frame.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    def run(batches):
        for batch in batches:
            found: set[tuple[int, str, str, str | None]] = set()
            for repo, name, root, languages, rules, foreign, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = Workspace(name, root, tuple(languages), tuple(rules), tuple(foreign))
                here = walk(w, [entry])
                known = languages_of(w, here)
                found |= {(repo, root, p, known.get(p)) for p in here}
            columns = list(zip(*sorted(found, key=lambda x: (x[0], x[2])), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["repo_id", "root", "path", "language"])

    return frame.mapInArrow(run, PATHS).distinct()


def sources(found: DataFrame) -> DataFrame:
    """PATHS -> SOURCES: state, hash and content of each file with a language."""
    frame = found.where("language IS NOT NULL").repartition("repo_id", "path")

    def read(batches):
        for batch in batches:
            out = []
            for repo, root, path, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = os.path.join(root, path)
                try:
                    state = os.stat(full)
                    content = b""
                    if state.st_size <= MOST_BYTES:
                        with open(full, "rb") as f:
                            content = f.read()
                    out.append((repo, path, language, state.st_mtime_ns, state.st_size, True, b"\0" in content[:BINARY_PROBE], hashlib.sha256(content).hexdigest(), content))
                except OSError:
                    out.append((repo, path, language, 0, 0, False, False, "", None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 9, kinds, strict=True)], [x.split()[0] for x in SOURCES.split(", ")])

    return frame.mapInArrow(read, SOURCES)
