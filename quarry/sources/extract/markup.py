"""Trees of JSON, HTML, CSS, SCSS, YAML, Markdown, Make, Bash, Ruby and SQL by small scanners."""

from __future__ import annotations

import re

from ..tree import Node, Source, Tree


def json_tree(data: bytes) -> Tree:
    token = re.compile(rb"\s+|(\"(?:\\.|[^\"\\])*\")|([{}\[\],:])|([^\s{}\[\],:\"]+)")
    root = Node("document", 0, len(data))
    error, at, stack, key, waiting = False, 0, [root], None, False
    while at < len(data):
        m = token.match(data, at)
        if not m:
            error = True
            at += 1
            continue
        at = m.end()
        top = stack[-1]
        if m[1] or m[3]:
            kind = "string" if m[1] else {b"true": "true", b"false": "false", b"null": "null"}.get(m[3], "number")
            error |= kind == "number" and not re.fullmatch(rb"-?\d+(\.\d+)?([eE][+-]?\d+)?", m[3])
            node = Node(kind, m.start(), m.end())
            if m[1] and len(m[1]) > 2:
                node.add(Node("string_content", m.start() + 1, m.end() - 1))
            if top.kind == "object" and not waiting:
                key = top.add(Node("pair", m.start(), m.end()))
                key.add(node, "key")
            elif waiting and key is not None:
                key.add(node, "value")
                key.end, waiting = m.end(), False
            else:
                top.add(node)
        elif m[2] in (b"{", b"["):
            node = Node("object" if m[2] == b"{" else "array", m.start(), len(data))
            (key if waiting and key is not None else top).add(node, "value" if waiting else None)
            waiting = False
            stack.append(node)
        elif m[2] in (b"}", b"]"):
            if len(stack) == 1 or (stack[-1].kind == "object") != (m[2] == b"}"):
                error = True
                continue
            node = stack.pop()
            node.end = m.end()
            if node.parent and node.parent.kind == "pair":
                node.parent.end = m.end()
                key = node.parent
        elif m[2] == b":":
            waiting = stack[-1].kind == "object"
    return Tree(root, Source(data), error or len(stack) > 1)


VOID = set(b"area base br col embed hr img input link meta source track wbr".split())
TAG = re.compile(rb"<!--.*?-->|<![^>]*>|<(/?)([A-Za-z][\w:-]*)((?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*)\s*(/?)>", re.S)
ATTRIBUTE = re.compile(rb"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)


def html_tree(data: bytes) -> Tree:
    root = Node("document", 0, len(data))
    stack, at, error = [root], 0, False
    while m := TAG.search(data, at):
        at = m.end()
        if m[2] is None:
            stack[-1].add(Node("comment" if m[0].startswith(b"<!--") else "doctype", *m.span()))
            continue
        tag = m[2].lower()
        if m[1]:
            names = [n for n in stack[1:] if getattr(n, "tag", None) == tag]
            if not names:
                error = True
                continue
            while stack[-1] is not names[-1]:
                stack.pop().end = m.start()
            done = stack.pop()
            end = done.add(Node("end_tag", *m.span()))
            end.add(Node("tag_name", *m.span(2)))
            done.end = m.end()
            continue
        element = stack[-1].add(Node({b"script": "script_element", b"style": "style_element"}.get(tag, "element"), m.start(), m.end()))
        element.tag = tag
        start = element.add(Node("self_closing_tag" if m[4] else "start_tag", *m.span()))
        start.add(Node("tag_name", *m.span(2)))
        for a in ATTRIBUTE.finditer(data, *m.span(3)):
            attribute = start.add(Node("attribute", *a.span()))
            attribute.add(Node("attribute_name", *a.span(1)))
            value = next((k for k in (2, 3, 4) if a[k] is not None), None)
            if value == 4:
                attribute.add(Node("attribute_value", *a.span(4)))
            elif value:
                quoted = attribute.add(Node("quoted_attribute_value", a.start(value) - 1, a.end(value) + 1))
                if a[value]:
                    quoted.add(Node("attribute_value", *a.span(value)))
        if tag in (b"script", b"style") and not m[4]:
            close = re.compile(rb"</" + tag + rb"\s*>", re.I).search(data, at)
            stop = close.start() if close else len(data)
            if stop > at:
                element.add(Node("raw_text", at, stop))
            at = stop
            stack.append(element)
        elif not m[4] and tag not in VOID:
            stack.append(element)
    for n in stack[1:]:
        n.end = len(data)
    return Tree(root, Source(data), error)


def css_tree(data: bytes, scss: bool = False) -> Tree:
    clean = re.sub(rb"/\*.*?\*/" + (rb"|(?<!:)//[^\n]*" if scss else b""), lambda m: re.sub(rb"[^\n]", b" ", m[0]), data, flags=re.S)
    root = Node("stylesheet", 0, len(data))
    stack, start, error = [root], 0, False
    for m in re.finditer(rb"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#\{[^}]*\}|[{};]", clean):
        if m[0] not in (b"{", b"}", b";"):
            continue
        lead = clean[start : m.start()]
        text = lead.strip()
        a = start + len(lead) - len(lead.lstrip())
        b = a + len(text)
        if m[0] == b"{":
            node = css_block(stack[-1], text, a, b)
            stack.append(node)
        else:
            if text:
                css_statement(stack[-1], text, a, m.end() if m[0] == b";" else b, b)
            if m[0] == b"}":
                if len(stack) == 1:
                    error = True
                else:
                    stack.pop().end = m.end()
        start = m.end()
    for n in stack[1:]:
        n.end = len(data)
    return Tree(root, Source(data), error or len(stack) > 1)


def css_block(parent: Node, text: bytes, a: int, b: int) -> Node:
    for word, kind, name in ((rb"@(?:-\w+-)?keyframes\s+([\w-]+)", "keyframes_statement", "keyframes_name"), (rb"@mixin\s+([\w-]+)", "mixin_statement", "identifier"), (rb"@function\s+([\w-]+)", "function_statement", "identifier")):
        if m := re.match(word, text):
            node = parent.add(Node(kind, a, b))
            node.add(Node(name, a + m.start(1), a + m.end(1)), "name")
            return node
    if text.startswith(b"@"):
        node = parent.add(Node("at_rule", a, b))
        css_values(node, text, a)
        return node
    node = parent.add(Node("rule_set", a, b))
    chosen = node.add(Node("selectors", a, b))
    for m in re.finditer(rb"%([\w-]+)|\.([\w-]+)|#([\w-]+)|(?<![\w.:#%&-])([A-Za-z][\w-]*)", text):
        if m[1]:
            chosen.add(Node("placeholder", a + m.start(), a + m.end())).add(Node("identifier", a + m.start(1), a + m.end(1)))
        else:
            k = next(i for i in (2, 3, 4) if m[i])
            chosen.add(Node({2: "class_name", 3: "id_name", 4: "tag_name"}[k], a + m.start(k), a + m.end(k)))
    return node


def css_statement(parent: Node, text: bytes, a: int, end: int, b: int) -> None:
    if m := re.match(rb"@(import|use|forward)\b", text):
        parent.add(Node({b"import": "import_statement", b"use": "use_statement", b"forward": "forward_statement"}[m[1]], a, end))
        return
    if m := re.match(rb"(\$[\w-]+|--[\w-]+|[\w-]+)\s*:", text):
        node = parent.add(Node("declaration", a, end))
        node.add(Node("variable" if m[1].startswith(b"$") else "property_name", a, a + len(m[1])))
        css_values(node, text[m.end() :], a + m.end())
        return
    css_values(parent.add(Node("at_rule", a, end)), text, a)


def css_values(node: Node, text: bytes, a: int) -> None:
    for m in re.finditer(rb"\"[^\"]*\"|'[^']*'|(\$[\w-]+)|([A-Za-z_-][\w-]*)\(|(?<![\w@#.$%-])([A-Za-z][\w-]*)", text):
        if m[1]:
            node.add(Node("variable", a + m.start(1), a + m.end(1)))
        elif m[2]:
            node.add(Node("function_name", a + m.start(2), a + m.end(2)))
        elif m[3]:
            node.add(Node("plain_value", a + m.start(3), a + m.end(3)))


def lines_with_offsets(data: bytes):
    at = 0
    for x in data.split(b"\n"):
        yield at, x
        at += len(x) + 1


def yaml_tree(data: bytes) -> Tree:
    root = Node("stream", 0, len(data))
    open_pairs: list[tuple[int, Node]] = []
    literal, error = None, False
    pair = re.compile(rb"^(\s*(?:-\s+)*)(\"(?:\\.|[^\"\\])*\"|'[^']*'|[^\s#&*!\[\]{},\"'>|%@`-][^#\n]*?|-[^\s#][^#\n]*?)\s*:(?:\s+(.*)|)$")
    last = 0
    for at, raw in lines_with_offsets(data):
        line = raw.rstrip(b"\r ")
        indent = len(line) - len(line.lstrip(b" "))
        if not line.strip() or line.lstrip().startswith(b"#") or line.startswith((b"---", b"...")):
            continue
        if literal is not None:
            if indent > literal:
                for _, p in open_pairs:
                    p.end = at + len(line)
                continue
            literal = None
        error |= b"\t" in line[: len(line) - len(line.lstrip())]
        m = pair.match(line)
        depth = len(m[1]) if m else indent
        while open_pairs and open_pairs[-1][0] >= depth:
            open_pairs.pop()
        home = open_pairs[-1][1] if open_pairs else root
        for _, p in open_pairs:
            p.end = at + len(line)
        last = at + len(line)
        if m:
            node = home.add(Node("block_mapping_pair", at + m.start(2), last))
            key = node.add(Node("flow_node", at + m.start(2), at + m.end(2)), "key")
            quoted = m[2][:1] in (b'"', b"'")
            inner = key.add(Node({b'"': "double_quote_scalar", b"'": "single_quote_scalar"}.get(m[2][:1], "plain_scalar"), at + m.start(2), at + m.end(2)))
            if not quoted:
                inner.add(Node("string_scalar", inner.start, inner.end))
            open_pairs.append((depth, node))
            value, offset = m[3] or b"", at + (m.start(3) if m[3] else len(line))
            if re.match(rb"[|>][+-]?\d*\s*(#.*)?$", value):
                literal = depth
                continue
            yaml_values(node, value, offset)
        else:
            text = line.lstrip(b" -")
            yaml_values(home, text, at + len(line) - len(text))
    return Tree(root, Source(data), error)


def yaml_values(node: Node, text: bytes, at: int) -> None:
    for m in re.finditer(rb"#[^\n]*$|&([\w.-]+)|\*([\w.-]+)|(![\w!/.:-]*)|\"[^\"]*\"|'[^']*'|([A-Za-z_][^\s,\[\]{}:#]*(?: [^\s,\[\]{}:#&*!]+)*)(?=(\s*:\s)?)", text):
        if m[1]:
            node.add(Node("anchor", at + m.start(), at + m.end())).add(Node("anchor_name", at + m.start(1), at + m.end(1)))
        elif m[2]:
            node.add(Node("alias", at + m.start(), at + m.end())).add(Node("alias_name", at + m.start(2), at + m.end(2)))
        elif m[3]:
            node.add(Node("tag", at + m.start(3), at + m.end(3)))
        elif m[4] and m[5] is not None:
            pair = node.add(Node("flow_pair", at + m.start(4), at + m.end(4)))
            pair.add(Node("flow_node", pair.start, pair.end), "key").add(Node("plain_scalar", pair.start, pair.end)).add(Node("string_scalar", pair.start, pair.end))
        elif m[4]:
            node.add(Node("string_scalar", at + m.start(4), at + m.end(4)))


def markdown_tree(data: bytes) -> Tree:
    root = Node("document", 0, len(data))
    fence, previous = None, None
    for at, raw in lines_with_offsets(data):
        line = raw.rstrip(b"\r")
        if f := re.match(rb" {0,3}(`{3,}|~{3,})", line):
            fence = f[1][:1] if fence is None else None if fence == f[1][:1] else fence
            previous = None
            continue
        if fence:
            continue
        if m := re.match(rb" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*(?:#+[ \t]*)?$", line):
            node = root.add(Node("atx_heading", at + line.index(b"#"), at + len(raw)))
            node.level = len(m[1])
            if m[2]:
                node.add(Node("inline", at + m.start(2), at + m.end(2)))
            previous = None
        elif previous and (m := re.match(rb" {0,3}(=+|-+)[ \t]*$", line)):
            node = root.add(Node("setext_heading", previous[0], at + len(raw)))
            node.level = 1 if m[1].startswith(b"=") else 2
            node.add(Node("paragraph", *previous)).add(Node("inline", *previous))
            previous = None
        else:
            text = line.strip()
            start = at + len(line) - len(line.lstrip())
            previous = (start, start + len(text)) if text and not text.startswith((b"-", b"*", b">", b"+")) else None
    return Tree(root, Source(data))


def make_tree(data: bytes) -> Tree:
    root = Node("makefile", 0, len(data))
    rule = None
    for at, raw in lines_with_offsets(data):
        line = raw.split(b"#")[0].rstrip() if not raw.startswith(b"\t") else raw.rstrip()
        if raw.startswith(b"\t"):
            if rule is not None:
                rule.end = at + len(line)
                words_of(rule, line, at)
            continue
        if not line.strip():
            continue
        if re.match(rb"\s*-?s?include\b", line):
            root.add(Node("include_directive", at, at + len(line)))
        elif m := re.match(rb"\s*(?:export\s+|override\s+)*([\w.-]+)\s*(?::{0,3}|\?|\+|!)=", line):
            node = root.add(Node("variable_assignment", at + m.start(1), at + len(line)))
            node.add(Node("word", at + m.start(1), at + m.end(1)), "name")
            words_of(node, line[m.end() :], at + m.end())
            rule = None
        elif m := re.match(rb"([^\s:=][^:=]*?)\s*::?(?!=)\s*(.*)$", line):
            rule = root.add(Node("rule", at, at + len(line)))
            targets = rule.add(Node("targets", at + m.start(1), at + m.end(1)))
            words_of(targets, m[1], at + m.start(1))
            words_of(rule.add(Node("prerequisites", at + m.start(2), at + m.end(2))), m[2], at + m.start(2))
        else:
            words_of(root, line, at)
    return Tree(root, Source(data))


def words_of(node: Node, text: bytes, at: int, kind: str = "word") -> None:
    for m in re.finditer(rb"[\w./%-]+", text):
        node.add(Node(kind, at + m.start(), at + m.end()))


def bash_tree(data: bytes) -> Tree:
    root = Node("program", 0, len(data))
    stack: list[Node] = []
    depth: list[int] = []
    level, error = 0, False
    token = re.compile(rb"(?<![\w$\"'{])#[^\n]*|'[^']*'|\"(?:\\.|[^\"\\])*\"|\$\{?(\w+)\}?|(?:function\s+)([\w:.-]+)\s*(?:\(\s*\))?\s*\{|([\w:.-]+)\s*\(\s*\)\s*\{|((?:^|(?<=[\s;]))[A-Za-z_]\w*)\+?=|([\w./-]+)|([{}])|(\n|;|\|\|?|&&?)", re.M)
    first = True
    for m in token.finditer(data):
        home = stack[-1] if stack else root
        name = 2 if m[2] else 3 if m[3] else 0
        if name:
            level += 1
            node = home.add(Node("function_definition", m.start(), len(data)))
            node.add(Node("word", *m.span(name)), "name")
            stack.append(node)
            depth.append(level)
            first = True
        elif m[1]:
            home.add(Node("variable_name", *m.span(1)))
            first = False
        elif m[4]:
            end = data.find(b"\n", m.end())
            node = home.add(Node("variable_assignment", m.start(4), len(data) if end < 0 else end))
            node.add(Node("variable_name", *m.span(4)), "name")
            first = False
        elif m[5]:
            if first and m[5] not in (b"if", b"then", b"else", b"elif", b"fi", b"for", b"while", b"do", b"done", b"case", b"esac", b"in", b"return", b"local", b"export"):
                call = home.add(Node("command", *m.span(5)))
                call.add(Node("command_name", *m.span(5)), "name").add(Node("word", *m.span(5)))
                first = False
            elif m[5] in (b"then", b"else", b"do", b"if", b"while", b"elif"):
                first = True
            elif not first:
                home.add(Node("word", *m.span(5)))
        elif m[6] == b"{":
            level += 1
        elif m[6] == b"}":
            if depth and depth[-1] == level:
                stack.pop().end = m.end()
                depth.pop()
            level -= 1
            error |= level < 0
        elif m[7]:
            first = True
        else:
            first = False
    return Tree(root, Source(data), error or bool(stack))


RUBY_OPEN = re.compile(rb"^\s*(?:if|unless|while|until|case|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
RUBY_WORD = re.compile(rb"#[^\n{][^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|:([A-Za-z_]\w*[?!]?)|@{0,2}([A-Za-z_]\w*[?!]?)(\s*\()?")
RUBY_KEYWORDS = set(b"alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield require require_relative load include extend prepend autoload".split())


def ruby_tree(data: bytes) -> Tree:
    root = Node("program", 0, len(data))
    stack: list[Node | None] = []
    named: set[int] = set()

    def home() -> Node:
        return next((n for n in reversed(stack) if n is not None), root)

    error = False
    for at, raw in lines_with_offsets(data):
        line = raw.split(b" #")[0].rstrip()
        lead = len(line) - len(line.lstrip())
        if m := re.match(rb"\s*(class|module|def)\s+(self\.)?([A-Za-z_][\w:]*[?!=]?)", line):
            kind = m[1].decode() if m[1] != b"def" else "singleton_method" if m[2] else "method"
            node = home().add(Node(kind, at + lead, at + len(line)))
            node.add(Node("constant" if kind in ("class", "module") else "identifier", at + m.start(3), at + m.end(3)), "name")
            named.add(at + m.start(3))
            if not re.search(rb";\s*end\s*$|^\s*def\s+[^=]*\)?\s*=\s", line):
                stack.append(node)
        elif m := re.match(rb"\s*(require|require_relative|load|include|extend|prepend|autoload)\b[ \t(]+\S", line):
            home().add(Node("import_call", at + lead, at + len(line)))
        elif re.match(rb"\s*end\b", line):
            if stack:
                node = stack.pop()
                if node is not None:
                    node.end = at + lead + 3
            else:
                error = True
        else:
            if m := re.match(rb"\s*([a-z_]\w*)\s*=(?![=~>])", line):
                node = home().add(Node("assignment", at + m.start(1), at + len(line)))
                node.add(Node("identifier", at + m.start(1), at + m.end(1)), "left")
                named.add(at + m.start(1))
            if RUBY_OPEN.search(line):
                stack.append(None)
    error |= bool(stack)
    for n in stack:
        if n is not None:
            n.end = len(data)
    for m in RUBY_WORD.finditer(data):
        if m[2] and m[2] not in RUBY_KEYWORDS and m.start(2) not in named:
            spot = root.add(Node("call", *m.span(2))) if m[3] else root
            spot.add(Node("constant" if m[2][:1].isupper() else "identifier", *m.span(2)), "method" if m[3] else None)
    return Tree(root, Source(data), error)


SQL_NAME = rb"(?:[\w]+\s*\.\s*)*(\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[A-Za-z_]\w*)"
SQL_CREATE = [
    ("create_database", rb"DATABASE"), ("create_schema", rb"SCHEMA(?:\s+AUTHORIZATION)?"), ("create_table", rb"(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+|EXTERNAL\s+)?TABLE"), ("create_view", rb"(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+)?VIEW"),
    ("create_index", rb"(?:UNIQUE\s+)?INDEX(?:\s+CONCURRENTLY)?"), ("create_function", rb"(?:OR\s+REPLACE\s+)?FUNCTION"), ("create_sequence", rb"SEQUENCE"), ("create_type", rb"TYPE"), ("create_trigger", rb"(?:OR\s+REPLACE\s+)?TRIGGER"),
]
SQL_WORD = re.compile(rb"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|(\"[^\"]+\"|`[^`]+`)|([A-Za-z_]\w*)|([();.,])", re.S)
SQL_BEFORE_NAMES = {b".", b"FROM", b"JOIN", b"INTO", b"UPDATE", b"TABLE", b"ON", b"REFERENCES", b"VIEW"}
SQL_KEYWORDS = set(b"ADD ALL ALTER AND AS ASC AUTHORIZATION BEFORE AFTER INSTEAD OF BEGIN BETWEEN BIGINT BOOLEAN BY CASCADE CASE CHAR CHECK COLUMN CONCURRENTLY CONSTRAINT CREATE CROSS DATABASE DATE DECIMAL DEFAULT DELETE DESC DISTINCT DO DOUBLE DROP EACH ELSE END ENUM EXECUTE EXISTS FALSE FLOAT FOR FOREIGN FROM FULL FUNCTION GROUP HAVING IF IN INDEX INNER INSERT INT INTEGER INTO IS JOIN KEY LANGUAGE LEFT LIKE LIMIT MATERIALIZED NOT NULL NUMERIC OFFSET ON OR ORDER OUTER PRIMARY PROCEDURE REFERENCES REPLACE RETURN RETURNS RIGHT ROW SCHEMA SELECT SEQUENCE SERIAL SET SMALLINT TABLE TEMP TEMPORARY TEXT THEN TIMESTAMP TRIGGER TRUE TYPE UNION UNIQUE UPDATE USING VALUES VARCHAR VIEW WHEN WHERE WITH".split())


def sql_tree(data: bytes) -> Tree:
    root = Node("program", 0, len(data))
    blank = re.sub(rb"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'", lambda m: re.sub(rb"[^\n]", b" ", m[0]), data, flags=re.S)
    named: set[int] = set()
    at = 0
    for m in re.finditer(rb";|\Z", blank):
        text = blank[at : m.start()]
        start = at + len(text) - len(text.lstrip())
        end = at + len(text.rstrip())
        at = m.end()
        if start >= end:
            continue
        body = blank[start:end]
        home = root
        for kind, words in SQL_CREATE:
            if c := re.match(rb"CREATE\s+" + words + rb"\s+(?:IF\s+NOT\s+EXISTS\s+)?" + SQL_NAME, body, re.I):
                home = root.add(Node(kind, start, end))
                a, b = c.span(c.lastindex)
                home.add(Node("identifier", start + a, start + b), "name")
                named.add(start + a)
                if kind == "create_table" and (paren := body.find(b"(", b)) >= 0:
                    sql_columns(home, body, start, paren, named)
                break
        for c in re.finditer(rb"(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)" + SQL_NAME + rb"\s*(?:\([^()]*\)\s*)?AS\s*(?:NOT\s+MATERIALIZED\s*|MATERIALIZED\s*)?\(", body, re.I):
            depth, k = 1, c.end()
            while k < len(body) and depth:
                depth += (body[k] == 40) - (body[k] == 41)
                k += 1
            node = home.add(Node("cte", start + c.start(c.lastindex), start + k))
            node.add(Node("identifier", start + c.start(c.lastindex), start + c.end(c.lastindex)), "name")
            named.add(start + c.start(c.lastindex))
    first, before, lists = b"", b"", []  # the statement's first word, the last token, what opened each bracket
    for m in SQL_WORD.finditer(data):
        if m[3]:
            if m[3] == b";":
                first, lists = b"", []
            elif m[3] == b"(":
                lists.append(first in (b"INSERT", b"CREATE"))
            elif m[3] == b")" and lists:
                lists.pop()
            before = m[3]
            continue
        if not (m[1] or m[2]):
            continue
        word = m[0].upper()
        first = first or word
        # a name in double quotes is a string where nothing tells that it is a column or a table
        plain = not m[1] or m[0][:1] == b"`" or before in SQL_BEFORE_NAMES or before in (b"(", b",") and lists[-1:] == [True]
        if m.start() not in named and plain and (m[1] or word not in SQL_KEYWORDS):
            root.add(Node("identifier", *m.span()))
        before = word
    return Tree(root, Source(data), blank.count(b"(") != blank.count(b")"))


def sql_columns(home: Node, body: bytes, start: int, paren: int, named: set[int]) -> None:
    depth, at = 0, paren + 1
    for k in range(paren, len(body)):
        c = body[k]
        depth += (c == 40) - (c == 41)
        if (c == 44 and depth == 1) or depth == 0:
            part = body[at:k]
            if (m := re.match(rb"\s*" + SQL_NAME + rb"\s+\w", part)) and not re.match(rb"\s*(PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|KEY|INDEX|EXCLUDE)\b", part, re.I):
                a, b = m.span(m.lastindex)
                node = home.add(Node("column_definition", start + at + m.start(m.lastindex), start + at + len(part.rstrip())))
                node.add(Node("identifier", start + at + a, start + at + b), "name")
                named.add(start + at + a)
            at = k + 1
        if depth == 0:
            break
