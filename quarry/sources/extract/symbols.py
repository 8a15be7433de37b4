"""Definitions and occurrences of a source, from its tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..languages import BY_ID
from ..tree import Node, Source, Tree
from .trees import tree_of

_SCRIPT = {
    "class_declaration": "class", "function_declaration": "function", "generator_function_declaration": "function", "method_definition": "method", "lexical_declaration": "variable", "variable_declaration": "variable",
}
_TYPED = {k: v for k, v in _SCRIPT.items() if k != "variable_declaration"} | {"abstract_class_declaration": "class", "internal_module": "namespace", "interface_declaration": "interface", "type_alias_declaration": "type", "enum_declaration": "enum"}
#: Which nodes define which kind of symbol.
DEFINES: dict[str, dict[str, str]] = {
    "python": {"class_definition": "class", "function_definition": "function", "assignment": "variable"},
    "javascript": _SCRIPT, "typescript": _TYPED, "tsx": _TYPED,
    "html": {"element": "id", "script_element": "tag", "style_element": "tag"},
    "css": {"keyframes_statement": "keyframes", "rule_set": "selector"},
    "scss": {"keyframes_statement": "keyframes", "mixin_statement": "mixin", "function_statement": "function", "placeholder": "placeholder", "declaration": "variable", "rule_set": "selector"},
    "rust": {"function_item": "function", "struct_item": "struct", "enum_item": "enum", "trait_item": "trait", "type_item": "type", "const_item": "variable", "static_item": "variable"},
    "go": {"function_declaration": "function", "method_declaration": "method", "type_declaration": "type", "var_declaration": "variable", "const_declaration": "variable"},
    "java": {"class_declaration": "class", "interface_declaration": "interface", "enum_declaration": "enum", "record_declaration": "class", "method_declaration": "method", "constructor_declaration": "method", "field_declaration": "variable"},
    "kotlin": {"package_header": "namespace", "class_declaration": "class", "interface_declaration": "interface", "function_declaration": "function", "object_declaration": "object", "companion_object": "object", "enum_entry": "variable", "type_alias": "type", "property_declaration": "variable"},
    "swift": {"actor_declaration": "actor", "class_declaration": "class", "enum_declaration": "enum", "struct_declaration": "struct", "protocol_declaration": "protocol", "function_declaration": "function", "property_declaration": "variable", "typealias_declaration": "type"},
    "c": {"function_definition": "function", "prototype_declaration": "prototype", "init_declaration": "variable"},
    "csharp": {
        "namespace_declaration": "namespace", "file_scoped_namespace_declaration": "namespace", "class_declaration": "class", "interface_declaration": "interface", "struct_declaration": "struct", "enum_declaration": "enum", "enum_member_declaration": "variable",
        "record_declaration": "class", "delegate_declaration": "delegate", "event_declaration": "event", "method_declaration": "method", "constructor_declaration": "method", "property_declaration": "property", "field_declaration": "variable",
    },
    "cpp": {"namespace_definition": "namespace", "class_specifier": "class", "struct_specifier": "struct", "enum_specifier": "enum", "union_specifier": "union", "function_definition": "function", "method_definition": "method", "prototype_declaration": "prototype", "init_declaration": "variable"},
    "ruby": {"class": "class", "module": "module", "method": "method", "singleton_method": "method", "assignment": "variable"},
    "php": {"namespace_definition": "namespace", "class_declaration": "class", "interface_declaration": "interface", "trait_declaration": "trait", "enum_declaration": "enum", "function_definition": "function", "method_declaration": "method", "property_declaration": "property", "property_promotion_parameter": "property", "const_declaration": "constant", "enum_case": "variable"},
    "bash": {"function_definition": "function", "variable_assignment": "variable"},
    "sql": {"create_database": "database", "create_schema": "schema", "create_table": "table", "column_definition": "column", "create_view": "view", "create_index": "index", "create_function": "function", "create_sequence": "sequence", "create_type": "type", "create_trigger": "trigger", "cte": "cte"},
    "make": {"rule": "target", "variable_assignment": "variable"},
    "json": {"pair": "key"},
    "yaml": {"block_mapping_pair": "key", "flow_pair": "key", "anchor": "anchor"},
    "markdown": {"atx_heading": "heading", "setext_heading": "heading"},
}
#: Nodes that are imports, and leaves that are occurrences.
IMPORTS = {"import_statement", "import_from_statement", "use_declaration", "import_declaration", "import", "using_directive", "preproc_include", "import_call", "namespace_use_declaration", "include_directive", "use_statement", "forward_statement"}
LEAVES = {"identifier", "property_identifier", "type_identifier", "field_identifier", "namespace_identifier", "simple_identifier", "name", "variable_name", "command_name", "word", "constant", "attribute_value", "tag_name", "class_name", "id_name", "property_name", "keyframes_name", "function_name", "plain_value", "variable", "string_scalar", "anchor_name", "alias_name", "tag"}
#: Kinds whose names stay occurrences of the data they name, not declarations.
PLAIN_KINDS = {"variable", "key", "anchor", "target", "property", "constant"}


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    end: int
    signature: str | None
    docstring: str | None
    name_at: tuple[int, int] | None = None
    qualified: str | None = None


@dataclass
class Ref:
    name: str
    start: int
    end: int
    context: str


def names_of(language: str, node: Node, source: Source) -> list[Node]:
    """The nodes that spell a definition's name; several targets of one rule are several symbols."""
    if language == "html":
        start = node.children[0]
        if node.kind != "element":
            return start.children[:1]
        for a in start.children:
            if a.kind == "attribute" and source.of(a.children[0]) == "id" and len(a.children) > 1:
                value = a.children[1]
                return value.children[:1] if value.kind == "quoted_attribute_value" else [value]
        return []
    if node.kind == "assignment":
        left = node.field("left")
        return [left] if left is not None and left.kind == "identifier" else []
    if node.kind in ("rule_set",):
        return node.children[:1]
    if node.kind == "placeholder":
        return node.children[:1]
    if node.kind == "declaration":
        return [c for c in node.children[:1] if c.kind == "variable"]
    if node.kind == "rule":
        return [c for c in node.children[0].children if c.kind == "word"]
    if node.kind in ("pair", "block_mapping_pair", "flow_pair"):
        key = node.field("key")
        inner = next((n for n in (key.walk() if key else []) if n.kind in ("string_content", "string_scalar", "single_quote_scalar", "double_quote_scalar")), None)
        return [inner] if inner else []
    if node.kind == "anchor":
        return node.children[:1]
    if node.kind.endswith("heading"):
        return [n for n in node.walk() if n.kind == "inline"][:1]
    found = node.field("name")
    if found is None and node.children and node.children[0].kind in ("variable_declarator", "declaration_item", "init_declarator"):
        found = node.children[0].field("name")
    return [found] if found is not None else []


def docstring(language: str, node: Node, source: Source, top: int) -> str | None:
    """The text of a Python body's first string; else the run of comment lines above the first line of the range."""
    if language == "python":
        body = node.field("body")
        first = body.children[0] if body and body.children else None
        if first is not None and first.kind == "expression_statement" and first.children and first.children[0].kind == "string":
            content = next((c for c in first.children[0].children if c.kind == "string_content"), None)
            return source.of(content).strip() if content else None
    marks = sorted(BY_ID[language].comments, key=len, reverse=True)
    if not marks:
        return None
    row = source.point(top)[0] - 1
    out: list[str] = []
    while row >= 0:
        line = source.text(source.starts[row], source.starts[row + 1] if row + 1 < len(source.starts) else len(source.data)).strip()
        mark = next((m for m in marks if line.startswith(m)), None)
        if mark is None:
            if line or out:
                break
        else:
            out.append(re.sub(r"\s*(\*/|-->)$", "", line)[len(mark) :].lstrip(mark[-1]).strip())
        row -= 1
    text = "\n".join(reversed(out)).strip()
    return text or None


def span_of(language: str, node: Node) -> tuple[int, int]:
    """The range with the decorators around it."""
    while node.parent is not None and node.parent.kind == "decorated_definition":
        node = node.parent
    return node.start, node.end


def extract_symbols(language: str, tree: Tree) -> list[Symbol]:
    source, out = tree.source, []
    defines = DEFINES[language]
    for node in tree.root.walk():
        if node.kind in IMPORTS and not (language == "python" and tree.root is node):
            text = source.of(node).strip()
            out.append(Symbol("import", text, node.start, node.end, text, None))
        elif kind := defines.get(node.kind):
            for name in names_of(language, node, source):
                text = source.of(name).strip()
                if name.kind in ("single_quote_scalar", "double_quote_scalar"):
                    text = text.strip("'\"")
                if not text:
                    continue
                start, end = span_of(language, node)
                signature = source.of(node).split("\n")[0].strip()
                out.append(Symbol(kind, text, start, end, signature, docstring(language, node, source, start), (name.start, name.end)))
    if language == "markdown":
        sections(out, tree)
    seen: set[tuple] = set()
    out = [s for s in out if (key := (s.kind, s.name, s.start, s.end)) not in seen and not seen.add(key)]
    out.sort(key=lambda s: (s.start, -s.end))
    qualify(out)
    return out


def sections(symbols: list[Symbol], tree: Tree) -> None:
    """A heading reaches to the line before the next heading of its level or a higher one."""
    levels = {n.start: n.level for n in tree.root.children if n.kind.endswith("heading")}
    symbols.sort(key=lambda s: s.start)
    for i, s in enumerate(symbols):
        nxt = next((t for t in symbols[i + 1 :] if levels[t.start] <= levels[s.start]), None)
        s.end = tree.source.starts[tree.source.point(nxt.start)[0]] - 1 if nxt else len(tree.source.data)


def qualify(symbols: list[Symbol]) -> None:
    """Dotted names of the open containers; imports never hold anything, and the top level has none."""
    stack: list[Symbol] = []
    for s in symbols:
        while stack and stack[-1].end < s.end or stack and stack[-1].end <= s.start:
            stack.pop()
        if stack:
            s.qualified = ".".join([x.name for x in stack] + [s.name])
        if s.kind != "import":
            stack.append(s)


def context_of(node: Node) -> str:
    """What an occurrence is for: the name of a declaration, else by the nodes around it, itself first."""
    parent = node.parent
    if parent is not None and node.name == "name" and (re.search("declaration|definition", parent.kind) or parent.kind.endswith(("_item", "_specifier"))):
        return "declaration"
    item: Node | None = node
    while item is not None:
        kind = item.kind
        if "import" in kind or "use_declaration" in kind:
            return "import"
        if "call" in kind or "invocation" in kind or kind == "command":
            return "call"
        if "type" in kind or "annotation" in kind:
            return "type-ref"
        if "assignment" in kind or "declarator" in kind:
            return "assignment"
        item = item.parent
    return "identifier"


def value_context(language: str, node: Node) -> str:
    """Names of variables, properties, constants and keys bind values; only where they are items of their own
    (Rust) or members (C#) do they count as declarations."""
    found = context_of(node)
    if found != "declaration" or language == "rust" or language == "csharp" and node.parent.kind in ("property_declaration", "enum_member_declaration"):
        return found
    return "assignment" if language in ("java", "csharp") else "identifier"


def extract_refs(language: str, tree: Tree, symbols: list[Symbol]) -> list[Ref]:
    if language == "markdown":
        return []
    declared = {s.name_at for s in symbols if s.name_at and s.kind not in PLAIN_KINDS}
    values = {s.name_at for s in symbols if s.name_at and s.kind in PLAIN_KINDS}
    seen: set[tuple[int, int, str]] = set()
    out = []
    for node in tree.root.walk():
        if language == "json":
            wanted = node.kind == "string_content" and node.parent.name == "key"
        else:
            wanted = node.kind in LEAVES and not (language == "html" and node.kind not in ("attribute_value", "tag_name")) and not (language == "bash" and node.kind == "command_name")
        if not wanted:
            continue
        text = tree.source.of(node).strip()
        if not text or (key := (node.start, node.end, text)) in seen:
            continue
        seen.add(key)
        at = (node.start, node.end)
        out.append(Ref(text, *at, "declaration" if at in declared else value_context(language, node) if at in values else context_of(node)))
    out.sort(key=lambda r: (r.start, r.end))
    return out


def parse(language: str, data: bytes) -> tuple[list[Symbol], list[Ref], bool, Source]:
    """Symbols, occurrences and whether the source has errors."""
    tree = tree_of(language, data)
    symbols = extract_symbols(language, tree)
    return symbols, extract_refs(language, tree, symbols), tree.error, tree.source


SYMBOL_FIELDS = "kind string, name string, qualified string, start_row long, start_col long, end_row long, end_col long, signature string, docstring string"
REF_FIELDS = "name string, start_row long, start_col long, end_row long, end_col long, context string"


def rows_of(language: str, data: bytes) -> tuple[list[tuple], list[tuple], bool]:
    symbols, refs, partial, source = parse(language, data)
    return (
        [(s.kind, s.name, s.qualified, *source.span(s.start, s.end), s.signature, s.docstring) for s in symbols],
        [(r.name, *source.span(r.start, r.end), r.context) for r in refs],
        partial,
    )


def extracted(files: DataFrame) -> DataFrame:
    """files (file_id, language, content) -> (file_id, partial, failed, symbols, refs): one pass over each source."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        s_kind = pa.list_(pa.struct([(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in SYMBOL_FIELDS.split(", "))]))
        r_kind = pa.list_(pa.struct([(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in REF_FIELDS.split(", "))]))
        s_names, r_names = [f.name for f in s_kind.value_type], [f.name for f in r_kind.value_type]
        for batch in batches:
            partial, failed, symbols, refs = [], [], [], []
            for language, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    s, r, p = rows_of(language, data or b"")
                    bad = False
                except Exception:  # noqa: BLE001  one file that can't be read must not end the build; it's reported
                    s, r, p, bad = [], [], True, True
                partial.append(p)
                failed.append(bad)
                symbols.append([dict(zip(s_names, x, strict=True)) for x in s])
                refs.append([dict(zip(r_names, x, strict=True)) for x in r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(partial), pa.array(failed), pa.array(symbols, s_kind), pa.array(refs, r_kind)], ["file_id", "partial", "failed", "symbols", "refs"])

    inner = lambda text: ",".join(f"{a}:{b}" for a, b in (f.split() for f in text.split(", ")))
    return files.select("file_id", "language", F.col("content").cast("binary")).mapInArrow(run, f"file_id long, partial boolean, failed boolean, symbols array<struct<{inner(SYMBOL_FIELDS)}>>, refs array<struct<{inner(REF_FIELDS)}>>")
