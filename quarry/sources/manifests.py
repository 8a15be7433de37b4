"""Manifest discovery and the votes for a repository's languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups
from .languages import LANGUAGES, manifest_fits, shebang_language

DEPTH, LEAST_SHARE = 3, 0.02


def within_depth(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Files at most so many folders deep, with their ``depth``."""
    return files.withColumn("depth", F.size(F.split("path", "/")) - 1).where(F.col("depth") <= depth)


def votes(files: list[tuple[str, str, bytes]]) -> list[tuple[str, str, int]]:
    """From (path, language, first bytes): rows (language, how, files).  A manifest of several languages
    counts for those with sources, if any has."""
    have: dict[str, int] = {}
    out: list[tuple[str, str, int]] = []
    for path, language, head in files:
        if language:
            have[language] = have.get(language, 0) + 1
            out.append((language, "extension", 1))
            if shebang_language(head) == language:
                out.append((language, "shebang", 1))
    for path, _, _ in files:
        if path.count("/") > DEPTH:
            continue
        name = path.rsplit("/", 1)[-1]
        owners = [x.id for x in LANGUAGES if any(manifest_fits(m, name) for m in x.manifests)]
        if len(owners) > 1:
            owners = [x for x in owners if x in have] or owners
        out += [(x, "manifest", 1) for x in owners]
    return out


def breakdown(spark: SparkSession, files: list[tuple[str, str, bytes]], least: float = LEAST_SHARE) -> list[dict]:
    """Languages by confidence, then files, then name."""
    cast = votes(files)
    if not cast:
        return []
    found = rollups.confidence(spark.createDataFrame(cast, "language string, how string, files long"))
    rows = found.orderBy(F.desc("confidence"), F.desc("files"), "language").collect()
    return [{"language": r.language, "files": r["files"], "confidence": r.confidence} for r in rows if r.confidence >= least]
