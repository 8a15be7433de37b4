"""Command line: ``python -m quarry.cli --index DIR --config FILE COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .model import EnclosingArgs, InvalidArguments, OutlineArgs, QueryArgs, ReferenceArgs, ReplaceArgs, SymbolArgs, from_json
from .sources.config import Config

TOOLS = {"get_symbol": SymbolArgs, "list_file_outline": OutlineArgs, "enclosing_symbol": EnclosingArgs, "find_references": ReferenceArgs, "query": QueryArgs, "replace_symbol": ReplaceArgs}


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def call(navigator, tool: str, given: dict) -> dict:
    if tool not in TOOLS:
        raise InvalidArguments(f"unknown tool {tool!r}; known: {', '.join(TOOLS)}")
    return getattr(navigator, tool)(from_json(TOOLS[tool], given))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--index", required=True)
    p.add_argument("--config", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("--force", action="store_true")
    build = sub.add_parser("build")
    build.add_argument("--repo")
    build.add_argument("--full", action="store_true")
    build.add_argument("--language", action="append", default=[])
    update = sub.add_parser("update")
    update.add_argument("paths", nargs="+")
    watch = sub.add_parser("watch")
    watch.add_argument("--events", required=True)
    watch.add_argument("--checkpoint", required=True)
    tool = sub.add_parser("call")
    tool.add_argument("tool", choices=TOOLS)
    tool.add_argument("arguments", help="a JSON object")
    repos = sub.add_parser("repos")
    repos.add_argument("action", choices=["list", "add", "remove"])
    repos.add_argument("name", nargs="?")
    repos.add_argument("root", nargs="?")
    languages = sub.add_parser("languages")
    languages.add_argument("--repo")
    languages.add_argument("--min-share", type=float, default=0.02)
    sub.add_parser("worktrees").add_argument("root")
    sub.add_parser("dashboard")
    a = p.parse_args(argv)
    config = Config.load_or_default(a.config)
    out = None
    if a.command == "init":
        if os.path.exists(a.config) and not a.force:
            raise InvalidArguments(f"{a.config} is there already")
        config.write(a.config)
    elif a.command == "repos":
        if a.action == "add":
            config.add(a.name, a.root)
        elif a.action == "remove":
            config.remove(a.name)
        if a.action != "list":
            config.write(a.config)
        out = [{"name": r.name, "root": r.root} for r in config.repos]
    elif a.command == "worktrees":
        from .sources.worktrees import discover

        out = [{"name": c.name, "path": c.path, "indexed": os.path.exists(os.path.join(a.index, "CURRENT"))} for c in discover(a.root)]
    else:
        from .plans.build import Builder
        from .plans.store import Store
        from .plans.tools import Navigator

        spark = session()
        store = Store(spark, a.index)
        builder = Builder(spark, store, config)
        navigator = Navigator(spark, store, {r.name: os.path.realpath(r.root) for r in config.repos}, config.limits)
        if a.command == "build":
            stats = builder.build(not a.full, a.repo, a.language)
            out = vars(stats)
            print(json.dumps(out))
            return 1 if a.full and stats.failed else 0
        if a.command == "update":
            out = vars(builder.update(a.paths))
        elif a.command == "watch":
            from .streaming.feed import events, follow

            follow(builder, events(spark, a.events), a.checkpoint).awaitTermination()
        elif a.command == "call":
            out = call(navigator, a.tool, json.loads(a.arguments))
        elif a.command == "dashboard":
            out = navigator.dashboard()
        elif a.command == "languages":
            from .sources.manifests import breakdown
            from .sources.walk import Workspace, head_of, languages_of, walk

            out = []
            for r in builder.repos(a.repo):
                w = Workspace(r.name, os.path.realpath(r.root))
                paths = walk(w)
                known = languages_of(w, paths)
                rows = [(x, known.get(x, ""), head_of(os.path.join(w.root, x))) for x in paths]
                out.append({"repo": r.name, "root": w.root, "languages": breakdown(spark, rows, a.min_share)})
    if out is not None:
        print(json.dumps(out, separators=(",", ":"), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except (InvalidArguments, LookupError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        sys.exit(2)
