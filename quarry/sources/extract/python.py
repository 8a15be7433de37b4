"""Trees of Python from the standard library's parser; a line scanner where the source has errors."""

from __future__ import annotations

import ast
import re
import warnings

from ..tree import Node, Source, Tree

NAMES = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment", "NamedExpr": "named_expression", "Call": "call", "Attribute": "attribute", "Name": "identifier", "Return": "return_statement",
    "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "With": "with_statement", "AsyncWith": "with_statement", "Try": "try_statement", "Raise": "raise_statement",
    "Assert": "assert_statement", "Delete": "delete_statement", "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement",
    "Lambda": "lambda", "List": "list", "Tuple": "tuple", "Dict": "dictionary", "Set": "set", "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression",
    "Subscript": "subscript", "BinOp": "binary_operator", "BoolOp": "boolean_operator", "UnaryOp": "unary_operator", "Compare": "comparison_operator", "IfExp": "conditional_expression", "Starred": "list_splat",
    "Await": "await", "Yield": "yield", "YieldFrom": "yield", "Expr": "expression_statement", "JoinedStr": "string", "ExceptHandler": "except_clause", "Match": "match_statement",
}
KINDS = set(NAMES.values()) | {"decorated_definition", "decorator", "block", "parameters", "argument_list", "keyword_argument", "string", "string_content", "integer", "float", "true", "false", "none", "ellipsis", "dotted_name", "aliased_import", "type", "default_parameter", "typed_parameter", "comment"}


class Builder:
    def __init__(self, data: bytes):
        self.data, self.source = data, Source(data)

    def at(self, line: int, col: int) -> int:
        return self.source.starts[min(line - 1, len(self.source.starts) - 1)] + col

    def bounds(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def name_after(self, pattern: bytes, start: int) -> tuple[int, int]:
        m = re.compile(pattern).search(self.data, start)
        return m.span(1)

    def statements(self, parent: Node, body: list[ast.stmt]) -> None:
        for x in body:
            self.node(parent, x)

    def definition(self, parent: Node, x) -> Node:
        start, end = self.bounds(x)
        home = parent
        if x.decorator_list:
            first = self.data.rindex(b"@", 0, self.bounds(x.decorator_list[0])[0])
            home = parent.add(Node("decorated_definition", first, end))
            for d in x.decorator_list:
                a, b = self.bounds(d)
                self.node(home.add(Node("decorator", self.data.rindex(b"@", 0, a), b)), d)
        own = home.add(Node(NAMES[type(x).__name__], start, end), "definition" if x.decorator_list else None)
        word = rb"class\s+([\w\x80-\xff]+)" if isinstance(x, ast.ClassDef) else rb"def\s+([\w\x80-\xff]+)"
        own.add(Node("identifier", *self.name_after(word, start)), "name")
        if isinstance(x, ast.ClassDef):
            extra = [*x.bases, *x.keywords]
            if extra:
                args = own.add(Node("argument_list", self.bounds(extra[0])[0], self.bounds(extra[-1])[1]), "superclasses")
                for e in extra:
                    self.node(args, e)
        else:
            a = x.args
            every = sorted([*a.posonlyargs, *a.args, *a.kwonlyargs, *(y for y in (a.vararg, a.kwarg) if y), *a.defaults, *(y for y in a.kw_defaults if y)], key=lambda y: (y.lineno, y.col_offset))
            low = own.children[0].end
            params = own.add(Node("parameters", low, self.bounds(every[-1])[1] + 1 if every else low + 2), "parameters")
            for y in every:
                if isinstance(y, ast.arg):
                    s, e = self.bounds(y)
                    if y.annotation:
                        typed = params.add(Node("typed_parameter", s, e))
                        typed.add(Node("identifier", s, s + len(y.arg.encode())))
                        self.node(typed.add(Node("type", *self.bounds(y.annotation)), "type"), y.annotation)
                    else:
                        params.add(Node("identifier", s, e))
                else:
                    self.node(params, y)
            if x.returns:
                self.node(own.add(Node("type", *self.bounds(x.returns)), "return_type"), x.returns)
        block = own.add(Node("block", self.bounds(x.body[0])[0], end), "body")
        self.statements(block, x.body)
        return home

    def node(self, parent: Node, x: ast.AST, name: str | None = None) -> Node | None:
        kind = type(x).__name__
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return self.definition(parent, x)
        if not hasattr(x, "lineno"):
            for c in ast.iter_child_nodes(x):
                self.node(parent, c)
            return None
        start, end = self.bounds(x)
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            own = parent.add(Node(NAMES[kind], start, end))
            for m in re.finditer(rb"[A-Za-z_\x80-\xff][\w\x80-\xff]*", self.data[start:end]):
                if m[0] not in (b"import", b"from", b"as"):
                    own.add(Node("dotted_name", start + m.start(), start + m.end())).add(Node("identifier", start + m.start(), start + m.end()))
            return own
        if isinstance(x, ast.Constant):
            value = x.value
            which = "string" if isinstance(value, (str, bytes)) else {True: "true", False: "false", None: "none"}.get(value, "integer") if value is None or isinstance(value, bool) else "float" if isinstance(value, (float, complex)) else "ellipsis" if value is ... else "integer"
            own = parent.add(Node(which, start, end), name)
            if which == "string":
                m = re.match(rb"[A-Za-z]*('''|\"\"\"|'|\")", self.data[start:end])
                if m:
                    own.add(Node("string_content", start + m.end(), end - len(m[1])))
            return own
        if isinstance(x, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            holder = parent.add(Node("expression_statement", start, end))
            own = holder.add(Node(NAMES[kind], start, end))
            for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                self.node(own, t, "left")
            if isinstance(x, ast.AnnAssign):
                self.node(own.add(Node("type", *self.bounds(x.annotation)), "type"), x.annotation)
            if x.value is not None:
                self.node(own, x.value, "right")
            return holder
        if isinstance(x, ast.Expr):
            own = parent.add(Node("expression_statement", start, end))
            self.node(own, x.value)
            return own
        if isinstance(x, ast.keyword):
            own = parent.add(Node("keyword_argument", start, end))
            if x.arg:
                own.add(Node("identifier", start, start + len(x.arg.encode())), "name")
            self.node(own, x.value, "value")
            return own
        own = parent.add(Node(NAMES.get(kind, re.sub(r"(?<!^)(?=[A-Z])", "_", kind).lower()), start, end), name)
        if isinstance(x, ast.Name):
            return own
        if isinstance(x, ast.Attribute):
            self.node(own, x.value, "object")
            own.add(Node("identifier", end - len(x.attr.encode()), end), "attribute")
            return own
        if isinstance(x, ast.Call):
            self.node(own, x.func, "function")
            args = own.add(Node("argument_list", self.bounds(x.func)[1], end), "arguments")
            for a in sorted([*x.args, *x.keywords], key=lambda y: (y.lineno, y.col_offset)):
                self.node(args, a)
            return own
        if isinstance(x, ast.arg):
            own.kind = "identifier"
            return own
        for field_name, value in ast.iter_fields(x):
            if field_name in ("body", "orelse", "finalbody") and isinstance(value, list) and value and isinstance(value[0], ast.stmt):
                block = own.add(Node("block", self.bounds(value[0])[0], self.bounds(value[-1])[1]), "body" if field_name == "body" else "alternative")
                self.statements(block, value)
            else:
                for c in value if isinstance(value, list) else [value]:
                    if isinstance(c, ast.AST):
                        self.node(own, c, field_name)
        own.children.sort(key=lambda n: (n.start, -n.end))
        return own


LINE = re.compile(rb"^([ \t]*)(?:(class|(?:async[ \t]+)?def)[ \t]+([\w\x80-\xff]+)|(import|from)\b[^\n]*|([A-Za-z_\x80-\xff][\w\x80-\xff]*)[ \t]*(?::[^=\n]+)?=(?!=))", re.M)
WORD = re.compile(rb"#[^\n]*|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|([A-Za-z_\x80-\xff][\w\x80-\xff]*)([ \t]*\()?")
KEYWORDS = set(b"False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())


def recovered(data: bytes) -> Tree:
    """What lines alone tell of a source with errors."""
    root = Node("module", 0, len(data))
    lines = data.split(b"\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    names: set[int] = set()
    for m in LINE.finditer(data):
        start = m.start() + len(m[1])
        if m[2]:
            row = data.count(b"\n", 0, start)
            last = row
            for k in range(row + 1, len(lines)):
                if lines[k].strip():
                    if len(lines[k]) - len(lines[k].lstrip()) <= len(m[1]):
                        break
                    last = k
            node = root.add(Node("class_definition" if m[2] == b"class" else "function_definition", start, starts[last] + len(lines[last].rstrip())))
            node.add(Node("identifier", *m.span(3)), "name")
            names.add(m.start(3))
        elif m[4]:
            root.add(Node("import_statement", start, m.end()))
        else:
            node = root.add(Node("assignment", start, data.find(b"\n", start) if b"\n" in data[start:] else len(data)))
            node.add(Node("identifier", *m.span(5)), "left")
            names.add(m.start(5))
    for m in WORD.finditer(data):
        if m[1] and m[1] not in KEYWORDS and m.start(1) not in names:
            home = root.add(Node("call", *m.span(1))) if m[2] else root
            home.add(Node("identifier", *m.span(1)), "function" if m[2] else None)
    return Tree(root, Source(data), True)


def tree(data: bytes) -> Tree:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return recovered(data)
    builder = Builder(data)
    root = Node("module", 0, len(data))
    builder.statements(root, parsed.body)
    return Tree(root, builder.source)
