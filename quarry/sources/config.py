"""Configuration in TOML, repository administration and logs."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import InvalidArguments, Limits
from .languages import BY_ID


@dataclass
class Repo:
    name: str
    root: str
    languages: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)


@dataclass
class Config:
    repos: list[Repo] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        known = {f.name for f in fields(Limits)}
        return cls([Repo(**r) for r in raw.get("repos", [])], raw.get("languages", []), Limits(**{k: v for k, v in raw.get("server", {}).items() if k in known}))

    @classmethod
    def load_or_default(cls, path: str) -> Config:
        return cls.load(path) if os.path.exists(path) else cls()

    def write(self, path: str) -> None:
        q = json.dumps
        lines = [f"languages = {q(self.languages)}", "", "[server]", *(f"{k} = {v}" for k, v in asdict(self.limits).items())]
        for r in self.repos:
            lines += ["", "[[repos]]", f"name = {q(r.name)}", f"root = {q(r.root)}", f"languages = {q(r.languages)}", f"ignore = {q(r.ignore)}"]
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
        os.replace(path + ".new", path)

    def add(self, name: str, root: str) -> None:
        if any(r.name == name or os.path.realpath(r.root) == os.path.realpath(root) for r in self.repos):
            raise InvalidArguments(f"repository {name!r} or its root is there already")
        self.repos.append(Repo(name, root))

    def remove(self, name: str) -> None:
        if not any(r.name == name for r in self.repos):
            raise InvalidArguments(f"unknown repository {name!r}")
        self.repos = [r for r in self.repos if r.name != name]


def allowed_languages(asked: list[str], repo: Repo | None, config: Config) -> list[str]:
    """Those asked for, else the repository's, else the configuration's; empty means all."""
    chosen = asked or (repo.languages if repo else []) or config.languages
    if unknown := [x for x in chosen if x not in BY_ID]:
        raise InvalidArguments(f"unknown language {unknown[0]!r}; known: {', '.join(BY_ID)}")
    return list(chosen)


#: Folders of a root that hold commands and settings of agents, and folders below them that are passed over.
AGENT_FOLDERS = (".claude", ".codex", ".gemini", ".quarry")
PASSED_OVER = ("target", "node_modules", ".git")


def command_uses(root: str, command: str, files: tuple[str, ...] = ()) -> int:
    """How often the agents' folders of a root, and further files, name a command in one of four ways.  Links aren't
    followed, hidden entries (but for our own folder) are passed over, and what can't be read as UTF-8 counts nothing.
    These folders are settings beside the driver, not data."""
    needles = (f"quarry {command}", f"/{command}", f"${command}", f'"command":"{command}"')

    def uses(path: str) -> int:
        try:
            with open(path, encoding="utf-8", newline="") as f:
                text = f.read()
        except (OSError, UnicodeDecodeError):
            return 0
        return sum(text.count(n) for n in needles)

    def wanted(name: str) -> bool:
        return name not in PASSED_OVER and (not name.startswith(".") or name == ".quarry")

    total = sum(uses(f) for f in files)
    for top in (os.path.join(root, name) for name in AGENT_FOLDERS):
        if os.path.islink(top):
            continue
        if os.path.isfile(top):
            total += uses(top)
        for folder, below, names in os.walk(top):
            below[:] = [b for b in below if wanted(b)]
            own = (os.path.join(folder, n) for n in names if wanted(n))
            total += sum(uses(p) for p in own if os.path.isfile(p) and not os.path.islink(p))
    return total


def append_log(path: str, row: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, separators=(",", ":"), ensure_ascii=False) + "\n")


LOG = "repo string, session string, ts long, calls long, avoided long, returned long, saved long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are skipped, and ``calls`` is 1 where it's missing."""
    raw = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("calls", F.coalesce("calls", F.lit(1).cast("long"))).na.fill(0, ["avoided", "returned", "saved"])
