"""Trees of languages with braces: one tokenizer, statements and blocks, and a table of
declaring words for each language.  Node names are those that grammars of these
languages commonly use, so patterns can be written against them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..tree import Node, Source, Tree

TOKEN = re.compile(
    rb"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<directive>^[ \t]*#[^\n]*)|(?P<string>\"\"\".*?\"\"\"|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<ident>\$?[A-Za-z_\x80-\xff][\w\x80-\xff]*|~[A-Za-z_]\w*(?=\())"
    rb"|(?P<number>\d[\w.]*)|(?P<newline>\n)|(?P<space>[ \t\r\f]+)|(?P<op>=>|->|::|&&|\|\||[=!<>]=|\+\+|--|.)",
    re.S | re.M,
)
OPEN, CLOSE = {b"(": b")", b"[": b"]", b"{": b"}"}, {b")", b"]", b"}"}


@dataclass
class Grammar:
    """What a language declares with which word."""

    words: dict[bytes, str] = field(default_factory=dict)  # word -> node
    imports: dict[bytes, str] = field(default_factory=dict)
    variables: dict[bytes, str] = field(default_factory=dict)
    holders: frozenset = frozenset()  # nodes whose bodies hold methods
    method: str = ""
    function: str = ""
    prototype: str = ""
    fields: str = ""
    newlines: bool = False
    types: bool = False
    leaf: str = "identifier"
    name_kinds: dict[str, str] = field(default_factory=dict)
    enum_entries: dict[str, str] = field(default_factory=dict)
    comment_hash: bool = False


CONTROL = {b"if", b"for", b"while", b"switch", b"catch", b"return", b"else", b"do", b"try", b"finally", b"match", b"loop", b"when", b"guard", b"foreach", b"using", b"lock", b"synchronized", b"throw", b"new", b"await", b"yield", b"case", b"default", b"unsafe", b"go", b"defer", b"select", b"elseif", b"repeat", b"sizeof", b"typeof", b"delete", b"in", b"of", b"super", b"this", b"self"}
MODIFIERS = set(b"public private protected internal static final abstract async export default declare readonly override virtual sealed partial extern inline constexpr const unsafe pub mut open data suspend lateinit operator tailrec infix fileprivate mutating nonisolated lazy weak unowned convenience required indirect synchronized native transient volatile strictfp new explicit friend typename typedef struct enum class".split())

FUNCTIONS = {b"fn", b"func", b"fun", b"function"}
#: Words that are no occurrences.
RESERVED = set(b"extends implements package val companion object throws where impl func fn fun get set let var function import from as is not and or null nil true false None self Self this super pub mut ref dyn void".split())

_JS = dict(words={b"class": "class_declaration", b"function": "function_declaration"}, imports={b"import": "import_statement"}, variables={b"const": "lexical_declaration", b"let": "lexical_declaration", b"var": "variable_declaration"}, holders=frozenset({"class_declaration", "abstract_class_declaration"}), method="method_definition", newlines=True, name_kinds={"method_definition": "property_identifier"})
_TS = _JS | dict(words=_JS["words"] | {b"interface": "interface_declaration", b"type": "type_alias_declaration", b"enum": "enum_declaration", b"namespace": "internal_module", b"module": "internal_module"}, types=True, name_kinds={"class_declaration": "type_identifier", "abstract_class_declaration": "type_identifier", "interface_declaration": "type_identifier", "type_alias_declaration": "type_identifier", "method_definition": "property_identifier"})
GRAMMARS: dict[str, Grammar] = {
    "javascript": Grammar(**_JS),
    "typescript": Grammar(**_TS),
    "tsx": Grammar(**_TS),
    "rust": Grammar(words={b"fn": "function_item", b"struct": "struct_item", b"enum": "enum_item", b"trait": "trait_item", b"type": "type_item", b"mod": "mod_item", b"impl": "impl_item"}, imports={b"use": "use_declaration"}, variables={b"const": "const_item", b"static": "static_item", b"let": "let_declaration"}, types=True, name_kinds={"struct_item": "type_identifier", "enum_item": "type_identifier", "trait_item": "type_identifier", "type_item": "type_identifier"}),
    "go": Grammar(words={b"func": "function_declaration", b"type": "type_declaration"}, imports={b"import": "import_declaration"}, variables={b"var": "var_declaration", b"const": "const_declaration"}, newlines=True, types=True, name_kinds={"method_declaration": "field_identifier", "type_declaration": "type_identifier"}),
    "java": Grammar(words={b"class": "class_declaration", b"interface": "interface_declaration", b"enum": "enum_declaration", b"record": "record_declaration"}, imports={b"import": "import_declaration", b"package": "package_declaration"}, holders=frozenset({"class_declaration", "interface_declaration", "enum_declaration", "record_declaration"}), method="method_declaration", fields="field_declaration", types=True),
    "kotlin": Grammar(words={b"class": "class_declaration", b"interface": "interface_declaration", b"fun": "function_declaration", b"object": "object_declaration", b"typealias": "type_alias"}, imports={b"import": "import", b"package": "package_header"}, variables={b"val": "property_declaration", b"var": "property_declaration"}, newlines=True, enum_entries={"class_declaration": "enum_entry"}),
    "swift": Grammar(words={b"actor": "actor_declaration", b"class": "class_declaration", b"enum": "enum_declaration", b"struct": "struct_declaration", b"protocol": "protocol_declaration", b"func": "function_declaration", b"typealias": "typealias_declaration", b"extension": "extension_declaration"}, imports={b"import": "import_declaration"}, variables={b"let": "property_declaration", b"var": "property_declaration"}, newlines=True, types=True, leaf="simple_identifier"),
    "c": Grammar(words={b"struct": "struct_specifier", b"enum": "enum_specifier", b"union": "union_specifier"}, function="function_definition", prototype="declaration", types=False),
    "cpp": Grammar(words={b"namespace": "namespace_definition", b"class": "class_specifier", b"struct": "struct_specifier", b"enum": "enum_specifier", b"union": "union_specifier"}, imports={b"#include": "preproc_include"}, holders=frozenset({"class_specifier", "struct_specifier", "union_specifier"}), function="function_definition", prototype="declaration", method="method_definition", types=True),
    "csharp": Grammar(words={b"namespace": "namespace_declaration", b"class": "class_declaration", b"interface": "interface_declaration", b"struct": "struct_declaration", b"enum": "enum_declaration", b"record": "record_declaration", b"delegate": "delegate_declaration", b"event": "event_declaration"}, imports={b"using": "using_directive"}, holders=frozenset({"class_declaration", "interface_declaration", "struct_declaration", "record_declaration"}), method="method_declaration", fields="field_declaration", enum_entries={"enum_declaration": "enum_member_declaration"}),
    "php": Grammar(words={b"namespace": "namespace_definition", b"class": "class_declaration", b"interface": "interface_declaration", b"trait": "trait_declaration", b"enum": "enum_declaration", b"function": "function_definition"}, imports={b"use": "namespace_use_declaration"}, variables={b"const": "const_declaration", b"case": "enum_case"}, holders=frozenset({"class_declaration", "interface_declaration", "trait_declaration", "enum_declaration"}), leaf="name", fields="property_declaration"),
}


@dataclass
class Token:
    kind: str
    start: int
    end: int
    text: bytes
    match: int = -1  # the closing bracket of an opening one


class Builder:
    def __init__(self, language: str, data: bytes):
        self.language, self.g, self.data = language, GRAMMARS[language], data
        self.error = False
        self.tokens: list[Token] = []
        for m in TOKEN.finditer(data):
            kind = m.lastgroup
            if kind == "directive":
                if language in ("c", "cpp") or language == "php" or language == "csharp" or language == "rust":
                    text = m[0].strip()
                    if language == "cpp" and text.startswith(b"#include"):
                        self.tokens.append(Token("include", m.start() + m[0].index(b"#"), m.end(), text))
                    elif language == "rust" and text.startswith(b"#["):
                        self.tokens.append(Token("attribute", m.start() + m[0].index(b"#"), m.end(), text))
                continue
            if kind not in ("space", "comment"):
                self.tokens.append(Token(kind, m.start(), m.end(), m[0]))
        if language == "php":
            self.tokens = [t for k, t in enumerate(self.tokens) if not (t.text in (b"<", b"?") or t.text == b"php" and k >= 2 and self.tokens[k - 1].text == b"?")]
        stack: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.text in OPEN and t.kind == "op":
                stack.append(i)
            elif t.text in CLOSE and t.kind == "op":
                if stack and OPEN[self.tokens[stack[-1]].text] == t.text:
                    self.tokens[stack.pop()].match = i
                else:
                    self.error = True
        self.error |= bool(stack)
        for i in stack:
            self.tokens[i].match = len(self.tokens)

    def tree(self) -> Tree:
        root = Node("program", 0, len(self.data))
        self.block(0, len(self.tokens), root)
        return Tree(root, Source(self.data), self.error)

    def leaf(self, parent: Node, i: int, name: str | None = None, kind: str | None = None) -> Node:
        t = self.tokens[i]
        upper = self.g.types and t.text[:1].isupper()
        return parent.add(Node(kind or ("type_identifier" if upper else self.g.leaf), t.start, t.end), name)

    def end_of(self, i: int) -> int:
        return self.tokens[min(i, len(self.tokens)) - 1].end if i else 0

    def statement(self, i: int, hi: int, parent: Node) -> tuple[int, int]:
        """(end, opening brace of the body or -1) of the statement that begins at token i."""
        j = i
        while j < hi:
            t = self.tokens[j]
            if t.text == b";" and t.kind == "op":
                return j + 1, -1
            if t.text == b"," and t.kind == "op" and parent.kind in self.g.enum_entries:
                return j + 1, -1
            if t.text == b"{" and t.kind == "op":
                head = self.tokens[i:j]
                if head and head[0].text in self.g.imports and self.language in ("rust", "javascript", "typescript", "tsx", "php"):
                    j = t.match + 1
                    continue
                if not any(x.text in (b"=", b"=>", b"return", b":=") and x.kind in ("op", "ident") for x in self.outer(i, j)) or not head:
                    return min(t.match + 1, hi), j
                j = t.match + 1
                continue
            if t.text in (b"(", b"[") and t.kind == "op":
                j = t.match + 1
                continue
            if t.kind == "newline" and self.g.newlines and j > i:
                before = self.tokens[j - 1]
                k = j
                while k < hi and self.tokens[k].kind == "newline":
                    k += 1
                after = self.tokens[k] if k < hi else None
                open_end = before.kind == "op" and before.text not in (b")", b"]", b"}", b"++", b"--", b"!", b"?")
                goes_on = after is not None and after.kind == "op" and after.text not in (b"}", b"@", b"[", b"(")
                if not open_end and not goes_on and not (before.kind == "ident" and before.text in MODIFIERS and self.language != "swift"):
                    return j, -1
            if t.text == b"}" and t.kind == "op":
                return j + (j == i), -1
            j += 1
        return hi, -1

    def outer(self, i: int, j: int) -> list[Token]:
        """Tokens from i to j outside brackets."""
        out = []
        while i < j:
            t = self.tokens[i]
            out.append(t)
            i = t.match + 1 if t.match >= 0 else i + 1
        return out

    def block(self, lo: int, hi: int, parent: Node) -> None:
        i = lo
        while i < hi:
            t = self.tokens[i]
            if t.kind == "newline" or t.text in (b";", b"}", b",") and t.kind == "op":
                i += 1
                continue
            if t.kind == "include":
                parent.add(Node("preproc_include", t.start, t.end))
                i += 1
                continue
            if t.kind == "attribute":
                parent.add(Node("attribute_item", t.start, t.end))
                i += 1
                continue
            if t.text == b"{" and t.kind == "op":
                self.block(i + 1, min(t.match, hi), parent)
                i = t.match + 1
                continue
            if self.language == "cpp" and t.text in (b"public", b"private", b"protected") and i + 1 < hi and self.tokens[i + 1].text == b":":
                i += 2
                continue
            end, body = self.statement(i, hi, parent)
            self.declare(i, max(end, i + 1), body, parent)
            i = max(end, i + 1)

    def declare(self, i: int, end: int, body: int, parent: Node) -> None:
        g, toks = self.g, self.tokens
        stop = body if body >= 0 else end
        outer: list[int] = []
        k = i
        while k < stop:
            if toks[k].kind != "newline":
                outer.append(k)
            k = toks[k].match + 1 if toks[k].match >= 0 else k + 1
        if not outer:
            return
        last = end - 1
        while last > i and (toks[last].kind == "newline"):
            last -= 1
        trimmed = last
        start = toks[i].start
        words = [(n, k) for n, k in enumerate(outer) if toks[k].kind == "ident"]
        first = toks[outer[0]].text
        lead = [k for _, k in words if toks[k].text not in MODIFIERS or toks[k].text in g.words or toks[k].text in g.variables or toks[k].text in g.imports]
        if not lead:
            self.expression(i, end, parent)
            return
        key = toks[lead[0]].text
        keys = [k for k in lead[:3] if toks[k].text in g.words and not (body < 0 and self.language in ("c", "cpp") and toks[k].text != b"namespace")]
        if first in g.imports and (first != b"using" or body < 0):
            semi = toks[trimmed].text == b";"
            kind = "trait_use_declaration" if self.language == "php" and parent.kind in g.holders else g.imports[first]
            keep_semi = self.language in ("javascript", "typescript", "tsx", "java", "rust", "csharp", "php")
            node = parent.add(Node(kind, start, toks[trimmed].end if not semi or keep_semi else toks[trimmed - 1].end))
            if kind == "package_header":
                name = parent.children[-1].add(Node("qualified_identifier", toks[outer[1]].start, toks[min(trimmed, outer[-1])].end), "name")
                del name
                return
            self.expression(i + 1, end, node)
            return
        if keys and (toks[keys[0]].text not in (b"type", b"record", b"module", b"object") or lead[0] == keys[0] or self.language == "kotlin"):
            k = keys[0]
            kind = g.words[toks[k].text]
            at = outer.index(k)
            rest = outer[at + 1 :]
            name = next((x for x in rest if toks[x].kind == "ident" and (toks[k].text in FUNCTIONS or toks[x].text not in MODIFIERS | set(g.words))), None)
            if self.language == "go" and kind == "type_declaration" and rest and toks[rest[0]].text == b"(":
                self.group(rest[0], kind, parent, start, toks[trimmed].end)
                return
            if self.language == "rust" and kind == "function_item" and body < 0:
                kind = "function_signature_item"
            if self.language == "go" and kind == "function_declaration" and rest and toks[rest[0]].text == b"(":
                kind = "method_declaration"
                name = next((x for x in rest[1:] if toks[x].kind == "ident"), None)
            if self.language in ("javascript", "typescript", "tsx") and kind == "function_declaration" and rest and toks[rest[0]].text == b"*":
                kind = "generator_function_declaration"
            if self.language in ("typescript", "tsx") and kind == "class_declaration" and any(toks[x].text == b"abstract" for x in outer[:at]):
                kind = "abstract_class_declaration"
            if self.language == "kotlin" and kind == "object_declaration" and any(toks[x].text == b"companion" for x in outer[:at]):
                kind = "companion_object"
            if self.language == "php" and kind == "function_definition" and parent.kind in g.holders:
                kind = "method_declaration"
            if self.language == "csharp" and kind == "delegate_declaration":
                name = next((x for x in rest if toks[x].kind == "ident" and x + 1 < end and toks[x + 1].text == b"("), name)
            if self.language == "csharp" and kind == "event_declaration":
                name = next((x for x in reversed(rest) if toks[x].kind == "ident"), name)
            if self.language == "csharp" and kind == "namespace_declaration" and body < 0:
                kind = "file_scoped_namespace_declaration"
            if kind == "impl_item" or name is not None:
                node = parent.add(Node(kind, start, toks[trimmed].end))
                self.extra(node, start)
                if name is not None and kind != "impl_item":
                    tail = name
                    if kind in ("namespace_declaration", "file_scoped_namespace_declaration", "namespace_definition") and self.language in ("csharp", "php"):
                        while tail + 2 < stop and toks[tail + 1].text in (b".", b"\\") and toks[tail + 2].kind == "ident":
                            tail += 2
                    named = node.add(Node(g.name_kinds.get(kind, "namespace_identifier" if kind == "namespace_definition" and self.language == "cpp" else "namespace_name" if kind == "namespace_definition" else "type_identifier" if g.types and toks[name].text[:1].isupper() and kind not in ("function_declaration", "enum_declaration") else g.leaf), toks[name].start, toks[tail].end), "name")
                    if self.language == "java":
                        named.kind = "identifier"
                    self.expression(tail + 1, stop, node)
                else:
                    self.expression(outer[at] + 1, stop, node)
                if kind == "method_declaration" and self.language == "php" and name is not None:
                    self.promoted(name + 1, node)
                if body >= 0:
                    self.block(body + 1, toks[body].match, node)
                return
        if key in g.variables and lead[0] in outer[:4]:
            kind = g.variables[key]
            at = outer.index(lead[0])
            rest = outer[at + 1 :]
            if rest and toks[rest[0]].text == b"(" and self.language == "go":
                self.group(rest[0], kind, parent, start, toks[trimmed].end)
                return
            name = next((x for x in rest if toks[x].kind == "ident" and toks[x].text not in (b"mut",)), None)
            if name is not None:
                node = parent.add(Node(kind, start, toks[trimmed].end))
                inner = node.add(Node("variable_declarator" if kind in ("lexical_declaration", "variable_declaration") else "declaration_item", toks[name].start, toks[trimmed].end if toks[trimmed].text != b";" else toks[trimmed - 1].end))
                inner.add(Node(g.leaf, toks[name].start, toks[name].end), "name")
                self.expression(name + 1, end, inner)
                if self.language in ("javascript", "typescript", "tsx", "go"):
                    for n, k in enumerate(outer[:-1]):
                        after = outer[n + 1]
                        if toks[k].text == b"," and toks[after].kind == "ident" and (n + 2 == len(outer) or toks[outer[n + 2]].text in (b"=", b",", b";", b":") or self.language == "go") and not (self.language == "go" and any(toks[x].text == b"=" for x in outer[:n])):
                            more = parent.add(Node(kind, node.start, node.end))
                            more.add(Node(inner.kind, toks[after].start, inner.end)).add(Node(g.leaf, toks[after].start, toks[after].end), "name")
                return
        call = next((k for n, k in words if n + 1 < len(outer) and toks[outer[n + 1]].text == b"(" and outer[n + 1] == k + 1 and toks[k].text not in CONTROL), None)
        if call is not None and not any(toks[x].text in (b"=", b".", b"return", b"=>", b"throw", b"await", b"->") for x in outer[: outer.index(call)]):
            self_kind = None
            typed = any(toks[x].kind == "ident" for x in outer[: outer.index(call)])
            inside = parent.kind in g.holders
            if inside and g.method and (body >= 0 or self.language in ("java", "csharp", "cpp", "typescript", "tsx")):
                self_kind = g.method
                if self.language in ("java", "csharp") and not [x for x in outer[: outer.index(call)] if toks[x].kind == "ident" and toks[x].text not in MODIFIERS and toks[x].text[:1] != b"@"]:
                    self_kind = "constructor_declaration"
            elif not inside and g.function and body >= 0:
                self_kind = g.function
                if self.language == "cpp" and call >= 1 and toks[call - 1].text == b"::":
                    self_kind = "method_definition"
            elif not inside and g.prototype and body < 0 and typed and parent.kind in ("program", "namespace_definition"):
                self_kind = "prototype_declaration"
            if self_kind:
                semi = toks[trimmed]
                node = parent.add(Node(self_kind, start, semi.end))
                node.add(Node(g.name_kinds.get(self_kind, g.leaf), toks[call].start, toks[call].end), "name")
                self.expression(i, call, node)
                self.expression(call + 1, stop, node)
                if body >= 0:
                    self.block(body + 1, toks[body].match, node)
                return
        if parent.kind in g.enum_entries and (self.language == "csharp" or any(self.data[parent.start : parent.end].startswith(p) for p in (b"enum", b"public enum", b"internal enum", b"private enum"))) and toks[outer[0]].kind == "ident":
            node = parent.add(Node(g.enum_entries[parent.kind], start, toks[trimmed - (toks[trimmed].text == b",")].end))
            node.add(Node(g.leaf, toks[outer[0]].start, toks[outer[0]].end), "name")
            return
        if g.fields and parent.kind in g.holders and len(words) >= (1 if self.language == "php" else 2):
            flat = self.without_generics(outer)
            named = []
            for n, k in enumerate(flat):
                if toks[k].text in (b"=", b"=>"):
                    break
                ends = n + 1 == len(flat) or toks[flat[n + 1]].text in (b"=", b";", b",", b"{", b"=>")
                typed = n and (toks[flat[n - 1]].kind == "ident" or toks[flat[n - 1]].text in (b"]", b"?", b"[") or toks[flat[n - 1]].text == b"," and named)
                if toks[k].kind == "ident" and (ends and typed or toks[k].text[:1] == b"$"):
                    named.append(k)
            if named:
                kind = "property_declaration" if body >= 0 or any(toks[x].text == b"=>" for x in outer) else g.fields
                node = parent.add(Node(kind, start, toks[trimmed].end))
                name = named[0]
                offset = 1 if toks[name].text[:1] == b"$" else 0
                node.add(Node(g.leaf, toks[name].start + offset, toks[name].end), "name")
                for x in range(i, stop):
                    if x != name:
                        self.expression(x, x + 1, node)
                if body >= 0:
                    self.block(body + 1, toks[body].match, node)
                for other in named[1:]:
                    parent.add(Node(kind, start, toks[trimmed].end)).add(Node(g.leaf, toks[other].start + offset, toks[other].end), "name")
                return
        equal = next((n for n, k in enumerate(outer) if toks[k].text in (b"=", b":=")), None)
        if equal and self.language in ("c", "cpp") and len([k for n, k in words if n < equal]) >= 2 and body < 0:
            name = outer[equal - 1]
            if toks[name].kind != "ident" or toks[name - 1].kind != "ident" and toks[name - 1].text != b">":
                node = parent.add(Node("declaration", start, toks[trimmed].end))
                self.expression(i, end, node.add(Node("init_declarator", start, toks[trimmed].end)))
                return
            node = parent.add(Node("init_declaration", start, toks[trimmed].end))
            inner = node.add(Node("init_declarator", toks[name].start, toks[trimmed].end))
            inner.add(Node("identifier", toks[name].start, toks[name].end), "name")
            self.expression(i, name, node)
            self.expression(name + 1, end, inner)
            return
        if equal:
            node = parent.add(Node("assignment_expression", start, toks[trimmed].end))
            self.expression(i, end, node)
            return
        self.expression(i, stop, parent)
        if body >= 0:
            self.block(body + 1, toks[body].match, parent)

    def promoted(self, opening: int, node: Node) -> None:
        """Parameters of a constructor that declare properties."""
        visible = None
        for t in self.tokens[opening + 1 : self.tokens[opening].match if opening < len(self.tokens) and self.tokens[opening].match > 0 else opening]:
            if t.text in (b"public", b"private", b"protected", b"readonly"):
                visible = visible or t
            elif t.text == b",":
                visible = None
            elif visible and t.kind == "ident" and t.text[:1] == b"$":
                node.add(Node("property_promotion_parameter", visible.start, t.end)).add(Node("name", t.start + 1, t.end), "name")
                visible = None

    def without_generics(self, outer: list[int]) -> list[int]:
        """Tokens outside angle brackets that follow a name."""
        out, depth = [], 0
        for n, k in enumerate(outer):
            text = self.tokens[k].text
            if text == b"<" and n and (depth or self.tokens[outer[n - 1]].kind == "ident"):
                depth += 1
            elif text == b">" and depth:
                depth -= 1
            elif not depth:
                out.append(k)
        return out

    def extra(self, node: Node, start: int) -> None:
        """Attributes above a definition belong to its range."""
        siblings = node.parent.children[:-1]
        while siblings and siblings[-1].kind == "attribute_item":
            node.start = siblings.pop().start

    def group(self, opening: int, kind: str, parent: Node, start: int, stop: int) -> None:
        """A declaration of several names: each has the range of the whole."""
        i, hi = opening + 1, self.tokens[opening].match
        while i < hi:
            if self.tokens[i].kind == "newline":
                i += 1
                continue
            end, _ = self.statement(i, hi, parent)
            if self.tokens[i].kind == "ident":
                node = parent.add(Node(kind, start, stop))
                node.add(Node(self.g.name_kinds.get(kind, self.g.leaf), self.tokens[i].start, self.tokens[i].end), "name")
                self.expression(i + 1, end, node)
            i = max(end, i + 1)

    def expression(self, i: int, end: int, parent: Node) -> None:
        toks = self.tokens
        while i < end:
            t = toks[i]
            if t.kind == "ident" and t.text not in CONTROL and t.text not in MODIFIERS and t.text not in RESERVED:
                if i + 1 < len(toks) and toks[i + 1].text == b"(" and toks[i + 1].kind == "op" and toks[i + 1].start == t.end and i + 1 < end:
                    close = min(toks[i + 1].match, end)
                    kind = {"java": "method_invocation", "csharp": "invocation_expression", "php": "function_call_expression"}.get(self.language, "call_expression")
                    node = parent.add(Node(kind, t.start, toks[min(close, len(toks) - 1)].end))
                    self.leaf(node, i, "name" if self.language == "java" else "function")
                    args = node.add(Node("arguments", toks[i + 1].start, toks[min(close, len(toks) - 1)].end), "arguments")
                    self.expression(i + 2, close, args)
                    i = close + 1
                    continue
                self.leaf(parent, i)
            elif t.kind == "string":
                parent.add(Node("string", t.start, t.end))
            elif t.kind == "number":
                parent.add(Node("number", t.start, t.end))
            elif t.text == b"{" and t.kind == "op" and t.match >= 0:
                self.block(i + 1, min(t.match, end), parent)
                i = t.match + 1
                continue
            i += 1
