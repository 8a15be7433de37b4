"""Occurrences of many needles in files, in one pass over each text.

The needles become one automaton (states and failure links over their bytes), built once for each task; what it costs to
look at a text doesn't grow with their number.  Each needle is counted by itself and without overlaps with itself, from
the left.  Folders that hold no sources of their own are passed over, as are hidden entries and links.

Defined cases: null content and content that is no UTF-8 count nothing; an empty needle is refused; needles that repeat
count once; the index's own hidden folder is looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that aren't looked into.
PASSED_OVER = ["target", "node_modules", ".git"]


def searched(path: Column, own: str = ".quarry") -> Column:
    """Is a file at this path, relative to the folder that the search begins in, looked at?"""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return ~F.exists(parts, lambda x: (x.startswith(".") & (x != own)) | x.isin(PASSED_OVER))


def counted(files: DataFrame, needles: list[str], key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, needle, n) of the needles that stand in a file's content (text or bytes)."""
    wanted = list(dict.fromkeys(needles))
    if not wanted or "" in wanted:
        raise ValueError("needles must not be empty")

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, x in enumerate(wanted):
            automaton.add_word(x, (i, len(x)))
        automaton.make_automaton()
        for batch in batches:
            at, which, count = [], [], []
            for row, value in enumerate(batch.column("c")):
                try:
                    text = (value.as_py() or b"").decode()
                except UnicodeDecodeError:
                    continue
                n, free = [0] * len(wanted), [0] * len(wanted)
                for end, (i, size) in automaton.iter(text):
                    if end - size + 1 >= free[i]:
                        n[i], free[i] = n[i] + 1, end + 1
                some = [i for i, x in enumerate(n) if x]
                at += [row] * len(some)
                which += [wanted[i] for i in some]
                count += [n[i] for i in some]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at, pa.int64())), pa.array(which, pa.string()), pa.array(count, pa.int64())], [key, "needle", "n"])

    given = files.select(F.col(key).alias("k"), F.col(content).cast("binary").alias("c"))
    return given.mapInArrow(run, f"`{key}` {given.schema['k'].dataType.simpleString()}, needle string, n long")
