"""The query operators: symbols, outlines, enclosing definitions, references, patterns and replacing.

Each plans DataFrames; only a page of at most a few hundred rows comes to the driver,
where it is cut to the byte budget and shaped.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import EnclosingArgs, InvalidArguments, Limits, OutlineArgs, QueryArgs, ReferenceArgs, ReplaceArgs, SymbolArgs
from ..operators import intervals, lookup, references, rollups
from ..operators.ordered import given
from ..sources import ngrams, patterns
from ..sources.extract.symbols import parse
from ..sources.languages import BY_ID, detect
from . import wire

UNAVAILABLE = "the symbol isn't to be found in the live source; build the index again"
STALE = "the source has changed since it was indexed"


class Navigator:
    """Reads a store or an overlay; ``roots`` tells where live sources lie.  Sources may also be a table (repo, path, content),
    of which ``grams`` is the index of three-byte strings (quarry.sources.ngrams, by the file_id of the store): then
    patterns read only the sources that can hold their literals.  The time budget of patterns holds for live sources, which a
    caller waits for; in a table every source is matched, however long it takes, so that the answer is whole."""

    def __init__(self, spark: SparkSession, index, roots: dict[str, str], limits: Limits | None = None, table: DataFrame | None = None, grams: DataFrame | None = None):
        self.spark, self.index, self.roots, self.limits = spark, index, roots, limits or Limits()
        self.table, self.grams = table, grams

    # --- what all have in common

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        if not self.index.manifest().ready:
            raise RuntimeError("the index isn't ready; build it first")
        return tuple(self.index.read(t) for t in ("repos", "files", "symbols", "refs"))

    def owned(self, repos: DataFrame, files: DataFrame, repo: str | None = None) -> DataFrame:
        names = repos.select("repo_id", F.col("name").alias("repo"), "root_path")
        return files.join(names if repo is None else names.where(F.col("repo") == repo), "repo_id")

    def path_filter(self, pattern: str | None, repo: str | None) -> Column | None:
        """A glob or literal path; an absolute one holds for the repository that it lies in."""
        if not pattern:
            return None
        if not pattern.startswith("/"):
            try:
                return tx.path_filter(F.col("path"), pattern)
            except ValueError as error:
                raise InvalidArguments(str(error)) from error
        out = None
        for name, root in self.roots.items():
            if repo in (None, name):
                try:
                    own = (F.col("repo") == name) & tx.path_filter(F.col("path"), pattern, root)
                except ValueError:
                    continue
                out = own if out is None else out | own
        if out is None:
            raise InvalidArguments(f"{pattern!r} lies outside all repositories")
        return out

    def filter_diagnostics(self, files: DataFrame, pattern: str | None, found: Column | None) -> list[dict]:
        if found is None or lookup.any_file(files, found):
            return []
        return [wire.diagnostic("filter_matched_no_files", f"{pattern!r} matches no indexed file", "Check the path, or leave the filter out.")]

    def one_file(self, file: str, repo: str | None) -> dict:
        repos, files, _, _ = self.tables()
        found = self.owned(repos, files.where(F.col("path") == file), repo).limit(2).collect()
        if not found:
            raise LookupError(f"file {file} isn't in the index")
        if len(found) > 1:
            raise LookupError(f"file {file} is in several repositories; name one")
        return found[0].asDict()

    def live(self, repo: str, path: str) -> bytes | None:
        try:
            with open(os.path.join(self.roots[repo], path), "rb") as f:
                return f.read()
        except (OSError, KeyError):
            return None

    def body(self, row: dict, context: int, most: int | None, cache: dict) -> tuple[str | None, bool]:
        """(text, stale): from the indexed place if the source is the indexed one, else from where the symbol is now."""
        import hashlib

        key = (row["repo"], row["path"])
        if key not in cache:
            data = self.live(*key)
            cache[key] = (data, hashlib.sha256(data).hexdigest() if data is not None else "")
        data, sha = cache[key]
        if data is None:
            return None, True
        start, end, stale = row["start_row"], row["end_row"], sha != row["sha"]
        if stale:
            symbols, _, _, source = parse(row["language"], data)
            spots = [(s.kind != row["kind"], abs(sum((source.span(s.start, s.end)[0], source.span(s.start, s.end)[2])) - start - end), source.span(s.start, s.end)) for s in symbols if s.name == row["name"]]
            spots.sort(key=lambda x: x[:2])
            if not spots or len(spots) > 1 and spots[0][:2] == spots[1][:2]:
                return None, True
            start, _, end, _ = spots[0][2]
        lines = text_lines(data.decode("utf-8", "replace"))
        some = lines[max(0, start - context) : min(len(lines) - 1, end + context) + 1]
        return "\n".join(elide(some, most)), stale

    # --- the operators

    def get_symbol(self, args: SymbolArgs) -> dict:
        repos, files, symbols, _ = self.tables()
        names = lookup.distinct_in_order([x for x in [args.name, *args.names] if x is not None])
        found = self.path_filter(args.file_glob, args.repo)
        if args.kind is not None:
            kinds = sorted(r.kind for r in lookup.kinds(symbols).collect())
            if args.kind not in kinds:
                raise InvalidArguments(f"unknown kind {args.kind!r}; known: {', '.join(kinds)}")
        if not names:
            raise ValueError("a name or a list of names is needed")
        if len(names) > max(1, self.limits.max_result_limit):
            raise ValueError(f"{len(names)} names are more than {max(1, self.limits.max_result_limit)}")
        diagnostics = self.filter_diagnostics(self.owned(repos, files, args.repo), args.file_glob, found)
        rows = lookup.matching(lookup.joined(symbols, files, repos, names, args.repo), found)
        if args.kind is not None:
            lost: dict[str, dict[str, int]] = {}
            for r in lookup.kind_filtered_out(rows, args.kind).collect():
                lost.setdefault(r.name, {})[r.kind] = r.n
            diagnostics += [wire.diagnostic("kind_filtered_out", f"kind {args.kind!r} leaves nothing of {n!r}", "Leave the kind out or take one that was found.", dict(sorted(lost[n].items()))) for n in names if n in lost]
            rows = rows.where(F.col("kind") == args.kind)
        limit = max(self.limits.results(args.limit), len(names))
        each = lookup.quota(limit, len(names))
        counts = {r.name: r.n for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()}
        page = lookup.fair_page(lookup.requested(rows, names), limit, len(names), args.offset, [*lookup.ORDER, "symbol_id"]).orderBy("ordinal", "rank")
        got = [r.asDict() for r in page.collect()]
        most, cache = self.limits.body_lines(args.max_body_lines), {}
        for r in got:
            r["shaped"] = self.shaped(r, args.include_body, args.context_lines, most, cache)
        total = sum(counts.values())

        def build(n: int) -> dict:
            matches = [r["shaped"] for r in got if r["rank"] <= args.offset + n]
            short = [x for x in names if counts.get(x, 0) - args.offset > n]
            shared, matches = wire.hoisted(matches, ("repo", "language"))
            after = args.offset + n if short else None
            return shape({"diagnostics": diagnostics, **shared}, {"matches": matches, "truncated": bool(short), "total": total}, {"next_offset": after, "warning": wire.warning(len(matches), total, after), "truncated_names": short})

        response, _, fits = wire.shrunk(build, each, self.limits.max_response_chars)
        if not fits:
            raise ValueError(f"the response is over {self.limits.max_response_chars} bytes with one match for each name; ask for less")
        return response

    def shaped(self, r: dict, include_body: bool, context: int, most: int, cache: dict) -> dict:
        text, stale = self.body(r, context, most, cache) if include_body else (None, False)
        out = {"repo": r["repo"], "file": r["path"], "language": r["language"], "kind": r["kind"], "name": r["name"], "qualified": r["qualified"], "signature": r["signature"], "range": wire.wire_range(r), "docstring": r["docstring"], "body": text, "stale": stale, "body_unavailable": UNAVAILABLE if stale and text is None else None, "partial": bool(r["partial"])}
        return wire.lean(out)

    def list_file_outline(self, args: OutlineArgs) -> dict:
        file = self.one_file(args.file, args.repo)
        symbols = self.tables()[2].where(F.col("file_id") == F.lit(file["file_id"]))
        if not args.include_imports:
            symbols = symbols.where("kind <> 'import'")
        nest = intervals.nested(symbols)
        nest = intervals.outline_roots(nest.where(F.col("depth") <= max(1, args.depth)))
        top = nest.where("depth = 1").count()
        limit, offset = self.limits.results(args.limit), min(args.offset, top)
        got = [r.asDict() for r in nest.where((F.col("root") >= offset) & (F.col("root") < offset + limit)).orderBy("start_row", "start_col", F.desc("end_row"), F.desc("end_col"), "symbol_id").collect()]
        most, cache = self.limits.body_lines(args.max_body_lines), {}
        wanted, roots, by_id = set(args.include_bodies_for), [], {}
        for r in got:
            node = {"kind": r["kind"], "name": r["name"], "signature": r["signature"] if args.include_signatures else None, "docstring": r["docstring"] if args.include_docstrings else None, "range": wire.wire_range(r)}
            if r["name"] in wanted or r["qualified"] in wanted:
                text, stale = self.body(r | {"repo": file["repo"], "path": file["path"], "sha": file["sha"], "language": file["language"]}, 0, most, cache)
                node |= {"body": text, "body_unavailable": UNAVAILABLE if text is None and stale else None}
            node = wire.lean(node)
            by_id[r["symbol_id"]] = node
            if r["parent_id"] is None:
                roots.append(node)
            elif r["parent_id"] in by_id:
                by_id[r["parent_id"]].setdefault("children", []).append(node)

        def build(n: int) -> dict:
            after = offset + n if offset + n < top else None
            return shape({"repo": file["repo"], "file": file["path"], "language": file["language"]}, {"symbols": roots[:n], "total": top, "truncated": after is not None}, {"next_offset": after, "partial": bool(file["partial"]), "warning": wire.warning(n, top, after)})

        n, budget = len(roots), self.limits.max_response_chars
        while budget and n > 1 and wire.size_of(build(n)) > budget:
            n -= 1
        if budget and n == 1 and wire.size_of(build(n)) > budget:
            raise ValueError(f"one symbol alone is over {budget} bytes; ask for less of it")
        return build(n)

    def enclosing_symbol(self, args: EnclosingArgs) -> dict:
        file = self.one_file(args.file, args.repo)
        asked = list(args.rows) or ([args.row] if args.row is not None else [])
        if not asked:
            raise ValueError("a row or a list of rows is needed")
        if 0 in asked:
            raise ValueError("rows count from 1")
        symbols = self.tables()[2].where(F.col("file_id") == F.lit(file["file_id"]))
        most, cache = self.limits.body_lines(args.max_body_lines), {}

        def look(rows: list[int], col: int | None, depth: int) -> dict[int, list[dict]]:
            """By place in the list, outermost first.  file_id stays a column of both sides, so the join keeps its key."""
            kind = "position_id long, row long" + (", col long" if col is not None else "")
            at = self.spark.createDataFrame([(i, r - 1, *([col] if col is not None else [])) for i, r in enumerate(rows)], kind).withColumn("file_id", F.lit(file["file_id"]) + F.col("position_id") * 0)
            out: dict[int, list[dict]] = {}
            for r in intervals.enclosing_few(at, symbols, depth).orderBy("position_id", F.desc("level")).collect():
                full = r.asDict() | {"repo": file["repo"], "path": file["path"], "language": file["language"], "sha": file["sha"], "partial": file["partial"]}
                shaped = self.shaped(full, args.include_body, args.context_lines, most, cache)
                out.setdefault(r.position_id, []).append({k: v for k, v in shaped.items() if k not in ("repo", "file", "language")})
            return out

        def none(row: int) -> dict:
            return wire.diagnostic("no_enclosing_symbol", f"no indexed symbol encloses row {row}", "The row may lie at the top level.")

        depth, budget = max(1, args.depth), self.limits.max_response_chars
        head = {"repo": file["repo"], "file": file["path"]}
        if args.rows:
            total, offset = len(asked), min(args.offset, len(asked))
            start = min(self.limits.results(args.limit), total - offset)
            found = look(asked[offset : offset + start], None, depth)

            def build(n: int) -> dict:
                hits = [wire.lean({"diagnostics": [] if i in found else [none(asked[offset + i])], "row": asked[offset + i]}) | {"matches": found.get(i, [])} for i in range(n)]
                after = offset + n if offset + n < total else None
                language = file["language"] if found else None
                return shape(head | {"language": language}, {"matches": []}, {"results": hits, "total": total, "truncated": after is not None, "next_offset": after, "warning": wire.warning(n, total, after)})

            return wire.shrunk(build, start, budget)[0]
        diagnostics = []
        found = look(asked, args.col, depth).get(0, [])
        if not found and args.col is not None:
            found = look(asked, None, depth).get(0, [])
            if found:
                diagnostics.append(wire.diagnostic("col_ignored", f"nothing encloses column {args.col}; the row alone was looked up", "Columns count bytes from 0."))
        if not found:
            diagnostics.append(none(asked[0]))

        def single(n: int) -> dict:
            return shape({"diagnostics": diagnostics} | head | {"language": file["language"] if found else None}, {"matches": found[-n:] if n else []}, {})

        n = len(found)
        while budget and n > 1 and wire.size_of(single(n)) > budget:
            n -= 1
        return single(n)

    def reference_rows(self, args: ReferenceArgs) -> tuple[DataFrame, list[str], list[dict]]:
        repos, files, _, refs = self.tables()
        names = lookup.distinct_in_order([x for x in [args.name, *args.names] if x is not None])
        if not names:
            raise ValueError("a name or a list of names is needed")
        found = self.path_filter(args.scope, args.repo)
        diagnostics = self.filter_diagnostics(self.owned(repos, files, args.repo), args.scope, found)
        rows = lookup.joined(refs, files, repos, names, args.repo)
        return lookup.matching(rows, found, args.exclude_tests, args.include_declarations), names, diagnostics

    def find_references(self, args: ReferenceArgs) -> dict:
        rows, _, diagnostics = self.reference_rows(args)
        several = (args.name is not None) + len(args.names) > 1
        sums = references.totals(rows).first()
        if args.counts_only:
            return self.counts(rows, sums, several, diagnostics)
        total = sums.total
        limit, offset = self.limits.results(args.limit), min(args.offset, total)
        got = [r.asDict() for r in references.page(rows, limit, offset).collect()]
        cache: dict = {}
        stale = self.stale_files(rows, sorted({(r["repo"], r["path"]) for r in got}))
        n_lines = max(1, min(20, args.snippet_lines)) if args.snippet_lines else 0
        shaped = [self.reference(r, several, n_lines, (r["repo"], r["path"]) in stale, cache) for r in got]
        partial = bool(sums.partial) or bool(stale) or self.any_stale(rows)

        def build(n: int) -> dict:
            after = offset + n if offset + n < total else None
            some = list(zip(got[:n], shaped[:n], strict=True))
            repos = {r["repo"] for r, _ in some}
            shared = next(iter(repos)) if len(repos) == 1 else None
            groups, flat = [], []
            if args.group_by_file:
                by_file: dict[tuple[str, str], list] = {}
                for r, x in some:
                    by_file.setdefault((r["repo"], r["path"]), []).append(x)
                groups = [wire.lean({"repo": None if shared else k[0], "file": k[1]}) | {"refs": v} for k, v in sorted(by_file.items())]
            else:
                flat = [wire.lean({"name": x.get("name"), "repo": None if shared else r["repo"], "file": r["path"]}) | {k: v for k, v in x.items() if k != "name"} for r, x in some]
            return shape({"diagnostics": diagnostics}, {"total": total, "total_files": sums.total_files, "returned": n, "truncated": after is not None}, {"next_offset": after, "partial": partial, "warning": wire.warning(n, total, after, True), "repo": shared, "groups": groups, "refs": flat})

        return wire.shrunk(build, len(got), self.limits.max_response_chars)[0]

    def stale_files(self, rows: DataFrame, page: list[tuple[str, str]]) -> set[tuple[str, str]]:
        """Files of the page whose live source isn't the indexed one."""
        if not page:
            return set()
        wanted = given(self.spark, page, "repo string, path string")
        return {(r.repo, r.path) for r in self.unverified(rows.join(wanted, ["repo", "path"], "left_semi")).collect()}

    def any_stale(self, rows: DataFrame) -> bool:
        """Is there such a file anywhere in the result?  Stops at the first."""
        return not self.unverified(rows).isEmpty()

    def unverified(self, rows: DataFrame) -> DataFrame:
        """Files whose live source isn't the indexed one; hashed by tasks, in pieces.  Without roots that is every file."""
        import hashlib

        import pyarrow as pa

        files = rows.select("repo", "path", "sha").distinct()
        if not self.roots:
            return files.select("repo", "path")
        roots = dict(self.roots)

        def check(batches):
            for batch in batches:
                bad = []
                for repo, path, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        with open(os.path.join(roots[repo], path), "rb") as f:
                            bad.append(hashlib.file_digest(f, "sha256").hexdigest() != sha)
                    except (OSError, KeyError):
                        bad.append(True)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad)), batch.column(1).filter(pa.array(bad))], ["repo", "path"])

        return files.mapInArrow(check, "repo string, path string")

    def reference(self, r: dict, several: bool, n: int, stale: bool, cache: dict) -> dict:
        out = {"name": r["name"] if several else None, "range": wire.wire_range(r), "context": r["context"]}
        if stale:
            return wire.lean(out | {"snippet_unavailable": STALE})
        if not n:
            return wire.lean(out) | {"snippet": ""}
        key = (r["repo"], r["path"])
        if key not in cache:
            cache[key] = text_lines((self.live(*key) or b"").decode("utf-8", "replace"))
        lines = cache[key]
        first, last = max(0, r["start_row"] - (n - 1)), min(len(lines) - 1, r["end_row"] + n - 1)
        some = lines[first : last + 1]
        if n == 1:
            return wire.lean(out) | {"snippet": next((x.strip() for x in some if x.strip()), "")}
        return wire.lean(out) | {"snippet": "\n".join(some), "snippet_start_row": first + 1}

    def reference_counts(self, args: ReferenceArgs) -> DataFrame:
        """Exact counts as a table (part, repo, key, n), of any number of files and names: parts ``file``, ``name``, and one row
        each of ``total`` and ``files``."""
        rows, _, _ = self.reference_rows(args)
        none, count = F.lit(""), F.count("*").alias("n")
        by_file = rows.groupBy("repo", F.col("path").alias("key")).agg(count).select(F.lit("file").alias("part"), "repo", "key", "n")
        by_name = rows.groupBy(F.col("name").alias("key")).agg(count).select(F.lit("name").alias("part"), none.alias("repo"), "key", "n")
        sums = references.totals(rows).select(F.inline(F.array(F.struct(F.lit("total").alias("part"), F.col("total").alias("n")), F.struct(F.lit("files").alias("part"), F.col("total_files").alias("n")))))
        return by_file.unionByName(by_name).unionByName(sums.select("part", none.alias("repo"), none.alias("key"), "n"))

    def counts(self, rows: DataFrame, sums, several: bool, diagnostics: list[dict]) -> dict:
        """Exact counts; sources aren't verified and paging doesn't apply.  The most frequent files are listed."""
        ordered = references.counts_by_file(rows).orderBy(F.desc("n"), "repo", "path")
        # a file takes 20 bytes at least; without a budget all files were asked for
        by_file = (ordered.limit(max(1, self.limits.max_response_chars // 20)) if self.limits.max_response_chars else ordered).collect()
        names = [{"name": r.name, "count": r.n} for r in references.counts_by_name(rows).orderBy(F.desc("n"), "name").collect()] if several else []

        def build(n: int) -> dict:
            files = [wire.lean({"repo": r.repo, "file": r.path}) | {"count": r.n} for r in by_file[:n]]
            return shape({"diagnostics": diagnostics}, {"total": sums.total, "total_files": sums.total_files, "files": files, "files_returned": len(files)}, {"files_truncated": len(files) < sums.total_files, "partial": bool(sums.partial), "names": names})

        response, _, fits = wire.shrunk(build, len(by_file), self.limits.max_response_chars)
        if not fits:
            raise ValueError("the counts are over the response budget; ask for fewer names")
        return response

    def query(self, args: QueryArgs) -> dict:
        asked = lookup.distinct_in_order([x for x in [args.language, *args.languages] if x])
        if not asked:
            raise InvalidArguments("a language or a list of languages is needed")
        diagnostics, good = [], []
        for language in asked:
            try:
                if language not in BY_ID:
                    raise patterns.PatternError(f"unsupported language {language}")
                patterns.compiled(language, args.query)
                good.append(language)
            except patterns.PatternError as error:
                if not args.languages:
                    raise InvalidArguments(str(error)) from error
                diagnostics.append(wire.diagnostic("query_compile_failed", f"{language}: {error}", "Use a pattern that this language supports."))
        found = self.path_filter(args.file_glob, args.repo)
        head = {"diagnostics": diagnostics, "language": args.language or (asked[0] if len(asked) == 1 else "")}
        limit, offset, cap = self.limits.results(args.limit), args.offset, self.limits.capture_char_limit
        budget = self.limits.query_timeout_ms if self.table is None else None
        files = self.candidates(args.repo, good)
        if self.index.manifest().ready:
            repos, all_files, _, _ = self.tables()
            diagnostics += self.filter_diagnostics(self.owned(repos, all_files, args.repo), args.file_glob, found)
        if found is not None:
            files = files.where(found)
        every = files
        literals = [patterns.required_literals(patterns.compiled(x, args.query)) for x in good]
        if self.grams is not None and literals and all(literals):
            some = ngrams.candidates(self.grams, [own for x in literals for own in x])
            files = files if some is None else files.join(some, "file_id", "left_semi")
        files = self.contents(files).where(F.octet_length("content") <= 2 << 20).persist(StorageLevel.DISK_ONLY)
        held = [files]
        try:
            # with the index, what is left out is counted by its entry
            scanned = files.count() if self.grams is None else every.where(F.col("byte_size") <= 2 << 20).count()
            parts, parsed_files = None, 0
            for language in good:
                needles = patterns.required_literals(patterns.compiled(language, args.query))
                own = files.where(F.col("language") == language)
                parsed_files += lookup.readable(own, needles).count()
                part = patterns.captures(lookup.readable(own).select("ordinal", "repo", "path", "language", "partial", "content"), language, args.query, budget_ms=budget)
                parts = part if parts is None else parts.unionByName(part)
            timed_out = False
            if parts is not None:
                parts = parts.persist(StorageLevel.DISK_ONLY)
                held.append(parts)
                timed_out = bool(parts.where("capture IS NULL").limit(1).count())
                parts = parts.where("capture IS NOT NULL")
                if args.capture:
                    parts = parts.where(F.col("capture") == args.capture)
                rows = parts.orderBy("ordinal", "path", "language", "seq").offset(offset).limit(limit + 1).collect()
            else:
                rows = []
        finally:
            for x in held:
                x.unpersist()
        if timed_out and not rows:
            raise TimeoutError(f"no capture within {self.limits.query_timeout_ms} ms; narrow the pattern or the files")
        more = len(rows) > limit or timed_out
        shaped = []
        for r in rows[:limit]:
            short = bool(cap) and len(r.text) > cap
            shaped.append(wire.lean({"repo": r.repo, "name": r.capture, "text": r.text[: cap - 1] + "…" if short else r.text, "file": r.path, "range": wire.wire_range(r.asDict()), "text_truncated": short}))
        dirty = [bool(r.partial) for r in rows[:limit]]

        def build(n: int) -> dict:
            cut = more or n < len(shaped)
            after = offset + n if cut else None
            return shape(head, {"files_scanned": scanned, "files_parsed": parsed_files, "captures": shaped[:n], "truncated": cut}, {"languages": asked if args.languages else [], "timed_out": timed_out, "next_offset": after, "partial": any(dirty[:n]), "warning": wire.warning(n, None, after)})

        return wire.shrunk(build, len(shaped), self.limits.max_response_chars)[0]

    def candidates(self, repo: str | None, languages: list[str]) -> DataFrame:
        """Indexed files of these languages; a live walk where there is no index."""
        order = {name: i for i, name in enumerate(self.roots)}
        kind = "repo string, path string, language string, partial boolean, ordinal long, file_id long, byte_size long"
        if self.index.manifest().ready:
            repos, files, _, _ = self.tables()
            own = self.owned(repos, files.where(F.col("language").isin(languages)), repo)
            ordinal = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("repo")] if order else F.lit(0)
            return own.select("repo", "path", "language", "partial", ordinal.cast("long").alias("ordinal"), "file_id", "byte_size")
        from ..sources.walk import Workspace, languages_of, walk

        rows = []
        for name, root in self.roots.items():
            if repo in (None, name):
                w = Workspace(name, root)
                rows += [(name, p, x, False, order[name], None, None) for p, x in languages_of(w, walk(w)).items() if x in languages]
        return self.spark.createDataFrame(rows, kind)

    def contents(self, files: DataFrame) -> DataFrame:
        import pyarrow as pa

        if self.table is not None:
            return files.join(self.table.select("repo", "path", F.col("content").cast("binary").alias("content")), ["repo", "path"], "left")

        roots, names = dict(self.roots), files.columns

        def read(batches):
            for batch in batches:
                out = []
                for repo, path in zip(batch.column("repo").to_pylist(), batch.column("path").to_pylist(), strict=True):
                    try:
                        with open(os.path.join(roots[repo], path), "rb") as f:
                            out.append(f.read((2 << 20) + 1))
                    except (OSError, KeyError):
                        out.append(None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "content"])

        return files.mapInArrow(read, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", content binary")

    def replace_symbol(self, args: ReplaceArgs) -> dict:
        if args.repo is not None and args.repo not in self.roots:
            raise LookupError(f"repository {args.repo} isn't configured")
        if args.repo is None and len(self.roots) != 1:
            raise LookupError("there are several repositories; name one")
        repo = args.repo or next(iter(self.roots))
        root = os.path.realpath(self.roots[repo])
        path = os.path.realpath(os.path.join(root, args.file))
        if not os.path.exists(path):
            raise LookupError(f"file {args.file} isn't there")
        if not path.startswith(root + "/"):
            raise LookupError(f"file {args.file} lies outside {repo}")
        with open(path, "rb") as f:
            data = f.read()
        language = detect(os.path.relpath(path, root), data[:256])
        if language is None:
            raise LookupError(f"{args.file} has no supported language")
        old, had_error = self.chosen(language, data, args)
        new = splice(data, old[1], args.new_body)
        symbols, _, error, source = parse(language, new)
        if error and not had_error:
            raise ValueError("the new text would bring a syntax error into the file")
        last = old[1][0] + len(text_lines(args.new_body)) - 1
        spots = [s for s in symbols if s.name == args.name and s.kind == old[0] and old[1][0] <= source.point(s.start)[0] <= last]
        folder, name = os.path.split(path)
        handle, fresh = tempfile.mkstemp(prefix=f".{name}.", dir=folder)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(new)
                f.flush()
                os.fsync(f.fileno())
            os.chmod(fresh, os.stat(path).st_mode)
            os.replace(fresh, path)
        except BaseException:
            os.unlink(fresh)
            raise
        keys = ("start_row", "start_col", "end_row", "end_col")
        place = wire.wire_range(dict(zip(keys, source.span(spots[0].start, spots[0].end), strict=True))) if len(spots) == 1 else None
        return wire.lean({"repo": repo, "file": args.file, "name": args.name, "kind": old[0], "old_range": wire.wire_range(dict(zip(keys, old[1], strict=True))), "new_range": place})

    @staticmethod
    def chosen(language: str, data: bytes, args: ReplaceArgs) -> tuple[tuple[str, tuple[int, int, int, int]], bool]:
        symbols, _, error, source = parse(language, data)
        found = [s for s in symbols if s.name == args.name and args.kind in (None, s.kind) and args.qualified in (None, s.qualified or s.name)]
        if args.row is not None:
            found = [s for s in found if source.point(s.start)[0] == args.row - 1]
        if not found:
            raise LookupError(f"no symbol {args.name!r} as asked for in {args.file}")
        if len(found) > 1:
            raise LookupError(f"{args.name!r} is not one symbol: " + "; ".join(f"{s.kind} {s.qualified or s.name} at line {source.point(s.start)[0] + 1}" for s in found))
        return (found[0].kind, source.span(found[0].start, found[0].end)), error

    def dashboard(self) -> dict:
        repos, files, symbols, refs = self.tables()
        rows = lambda df: [r.asDict() for r in df.collect()]
        sizes = files.agg(F.coalesce(F.sum("byte_size"), F.lit(0)).alias("byte_size"))
        return {
            "totals": rows(rollups.totals(files, symbols, refs))[0], "repos": sorted(rows(rollups.repo_details(repos, files, symbols, refs)), key=lambda r: r["repo"]), "languages": rows(rollups.languages(files, symbols)),
            "kinds": rows(rollups.symbol_kinds(symbols)), "largest": rows(rollups.largest_files(files, symbols)), "economics": rows(rollups.economics(sizes))[0],
        }


def shape(head: dict, always: dict, tail: dict) -> dict:
    """Parts that may be empty are left out; those in the middle are always there."""
    return wire.lean(head) | always | wire.lean(tail)


def text_lines(text: str) -> list[str]:
    """Lines without LF or CRLF; a final end makes no empty line."""
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def elide(lines: list[str], most: int | None) -> list[str]:
    if not most or len(lines) <= most:
        return lines
    head, tail = most // 2, most - most // 2
    return lines[:head] + [f"… {len(lines) - most} lines elided ({len(lines)} total) …"] + lines[len(lines) - tail :]


def splice(data: bytes, place: tuple[int, int, int, int], body: str) -> bytes:
    """Put the body in the place of whole lines; the last line's end stays, and the file's kind of line end is used."""
    row, col, end_row, end_col = place
    lines = data.split(b"\n")
    if lines[row][:col].strip():
        raise ValueError("the symbol shares its first line with other code")
    if lines[end_row][end_col:].strip(b"\r \t"):
        raise ValueError("the symbol shares its last line with other code")
    crlf = sum(x.endswith(b"\r") for x in lines[:-1]) * 2 > len(lines) - 1
    new = "\n".join(text_lines(body)).encode()
    if crlf:
        new = new.replace(b"\n", b"\r\n")
    tail = b"\r" if lines[end_row].endswith(b"\r") else b""
    return b"\n".join(lines[:row] + [new + tail] + lines[end_row + 1 :])
