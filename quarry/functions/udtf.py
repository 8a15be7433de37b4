"""Table functions for SQL: ``extract_symbols``, ``extract_refs`` and ``syntax_query``.

    SELECT f.path, s.* FROM files f, LATERAL extract_symbols(f.language, f.content) s
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.extract.symbols import REF_FIELDS, SYMBOL_FIELDS, rows_of


class ExtractSymbols:
    def eval(self, language: str, content: bytes):
        if language is not None and content is not None:
            yield from rows_of(language, bytes(content))[0]


class ExtractRefs:
    def eval(self, language: str, content: bytes):
        if language is not None and content is not None:
            yield from rows_of(language, bytes(content))[1]


class SyntaxQuery:
    def eval(self, language: str, content: bytes, pattern: str):
        from ..sources.extract.trees import tree_of
        from ..sources.patterns import capture_stream, compiled

        if language is None or content is None:
            return
        tree = tree_of(language, bytes(content))
        for seq, (name, node) in enumerate(capture_stream(compiled(language, pattern), tree)):
            yield (seq, name, tree.source.of(node), *tree.source.span(node.start, node.end))


def register(spark: SparkSession) -> None:
    found = {
        "extract_symbols": (ExtractSymbols, SYMBOL_FIELDS),
        "extract_refs": (ExtractRefs, REF_FIELDS),
        "syntax_query": (SyntaxQuery, "seq long, capture string, text string, start_row long, start_col long, end_row long, end_col long"),
    }
    for name, (kind, fields) in found.items():
        spark.udtf.register(name, udtf(kind, returnType=fields))
