"""The language registry and detection.

Fixed values: the 23 languages with their manifests, extensions and comment marks,
in the order in which they are tried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    id: str
    extensions: tuple[str, ...]
    manifests: tuple[str, ...] = ()
    comments: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()


SLASHES = ("//", "/*", "*")

#: Id, extensions, manifests, comment marks, kinds.
LANGUAGES: tuple[Language, ...] = (
    Language("python", ("py", "pyi"), ("pyproject.toml", "requirements.txt"), ("#",), ("import", "class", "function", "variable")),
    Language("javascript", ("js", "jsx", "mjs", "cjs"), ("package.json",), SLASHES, ("import", "class", "function", "method", "variable")),
    Language("html", ("html", "htm"), (), ("<!--",), ("id", "tag")),
    Language("css", ("css",), (), ("/*", "*"), ("import", "keyframes", "selector")),
    Language("scss", ("scss",), (), SLASHES, ("import", "keyframes", "mixin", "function", "placeholder", "variable", "selector")),
    Language("typescript", ("ts",), ("package.json", "tsconfig.json"), SLASHES, ("import", "class", "namespace", "function", "method", "interface", "type", "enum", "variable")),
    Language("tsx", ("tsx",), ("package.json", "tsconfig.json"), SLASHES, ("import", "class", "namespace", "function", "method", "interface", "type", "enum", "variable")),
    Language("rust", ("rs",), ("Cargo.toml",), SLASHES, ("import", "function", "struct", "enum", "trait", "type", "variable")),
    Language("go", ("go",), ("go.mod",), SLASHES, ("import", "function", "method", "type", "variable")),
    Language("java", ("java",), ("pom.xml", "build.gradle", "build.gradle.kts"), SLASHES, ("import", "class", "interface", "enum", "method", "variable")),
    Language("kotlin", ("kt", "kts"), ("build.gradle.kts", "settings.gradle.kts"), SLASHES, ("import", "namespace", "class", "interface", "function", "object", "variable", "type")),
    Language("swift", ("swift",), ("Package.swift",), SLASHES, ("import", "actor", "class", "enum", "struct", "protocol", "function", "variable", "type")),
    Language("c", ("c", "h"), ("CMakeLists.txt",), SLASHES, ("function", "prototype", "variable")),
    Language("csharp", ("cs",), ("*.csproj", "*.sln", "*.slnx", "Directory.Build.props", "Directory.Build.targets", "packages.config"), SLASHES, ("import", "namespace", "class", "interface", "struct", "enum", "variable", "delegate", "event", "method", "property")),
    Language("cpp", ("cc", "cpp", "cxx", "hpp", "hh", "hxx"), ("CMakeLists.txt",), SLASHES, ("namespace", "class", "struct", "enum", "union", "import", "function", "method", "prototype", "variable")),
    Language("ruby", ("rb",), ("Gemfile",), ("#",), ("import", "class", "module", "method", "variable")),
    Language("php", ("php", "phtml", "php3", "php4", "php5", "phps"), ("composer.json", "composer.lock"), ("//", "#", "/*", "*"), ("import", "namespace", "class", "interface", "trait", "enum", "function", "method", "property", "constant", "variable")),
    Language("bash", ("sh", "bash"), (".bashrc",), ("#",), ("function", "variable")),
    Language("sql", ("sql",), (), ("--", "/*", "*"), ("database", "schema", "table", "column", "view", "index", "function", "sequence", "type", "trigger", "cte")),
    Language("make", ("mk", "mak"), ("Makefile", "makefile", "GNUmakefile"), ("#",), ("import", "target", "variable")),
    Language("json", ("json",), (), (), ("key",)),
    Language("yaml", ("yaml", "yml"), (), ("#",), ("key", "anchor")),
    Language("markdown", ("md", "markdown"), (), (), ("heading",)),
)
BY_ID = {x.id: x for x in LANGUAGES}
#: Folders and files that never have a language.
BLOCKED = ["node_modules", "vendor", "target", ".venv", ".git", "dist", "build", ".next", ".turbo", ".parcel-cache"]
NEVER = ["build.gradle.kts", "settings.gradle.kts"]
#: What a first line that begins with #! must contain, in this order.
SHEBANGS = [("python", "python"), ("ruby", "ruby"), ("node", "javascript"), *((x, "bash") for x in ("bash", "zsh", "dash", "ksh", "/sh", " sh"))]


def shebang_language(head: bytes) -> str | None:
    line = head[:256].split(b"\n")[0].lower()
    if not line.startswith(b"#!"):
        return None
    return next((language for needle, language in SHEBANGS if needle.encode() in line), None)


def manifest_fits(pattern: str, name: str) -> bool:
    return name.endswith(pattern[1:]) if pattern.startswith("*") else name == pattern


def extension_of(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else ""


def detect(path: str, head: bytes = b"") -> str | None:
    """The language of a path relative to its repository."""
    parts = path.replace("\\", "/").split("/")
    if any(p in BLOCKED for p in parts):
        return None
    name = parts[-1]
    ext = extension_of(name)
    if ext in ("C", "H"):
        return "cpp"
    if name in NEVER:
        return None
    if not ext and (found := shebang_language(head)):
        return found
    for x in LANGUAGES:
        if x.id == "make" and name in x.manifests or ext.lower() in x.extensions and ext:
            return x.id
    return None


def language_of(path: Column, head: Column) -> Column:
    """The same as a Column: path and the file's first bytes as text."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.split(clean, "/")
    name = F.element_at(parts, -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    line = F.lower(F.get(F.split(F.substring(head, 1, 256), "\n"), F.lit(0)))
    shebang = F.lit(None).cast("string")
    for needle, language in reversed(SHEBANGS):
        shebang = F.when(line.contains(needle), language).otherwise(shebang)
    shebang = F.when((ext == "") & line.startswith("#!"), shebang)
    known = F.lit(None).cast("string")
    for x in reversed(LANGUAGES):
        fits = F.lower(ext).isin(list(x.extensions))
        known = F.when(fits | name.isin(list(x.manifests)) if x.id == "make" else fits, x.id).otherwise(known)
    out = F.when(F.arrays_overlap(parts, F.array(*(F.lit(b) for b in BLOCKED))), None).when(ext.isin("C", "H"), "cpp").when(name.isin(NEVER), None)
    return out.otherwise(F.coalesce(shebang, known))
