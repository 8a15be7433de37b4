"""The change feed: notifications as a stream, coalesced by micro-batch, applied by the builder.

A batch takes the distinct relevant paths of its window.  An overflow means that
notifications were lost, so it stands for all repositories.  A batch that is run
again after a failure finds nothing to do: builds compare content, so replays are
harmless.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import maintain
from ..plans.build import Builder, Stats

EVENTS = "at long, path string, kind string"
WINDOW_SECONDS = 2


def events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of EVENTS that appear in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def changed_paths(batch: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct relevant paths, rows that ask for a full scan).  Access isn't a change; closing a written file is.
    A path is relevant or not relative to the deepest root above it."""
    real = batch.where("kind NOT IN ('access')")
    relative = F.col("path")
    for root in sorted(roots, key=len):
        relative = F.when(F.startswith(F.col("path"), F.lit(root + "/")), F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))).otherwise(relative)
    paths = real.where("kind <> 'overflow' AND path IS NOT NULL").where(maintain.relevant(relative)).select("path").distinct()
    return paths, real.where("kind = 'overflow'")


WINDOWED = "window long, paths array<string>, rescan boolean"


def folded(held: list[tuple[int, str | None, bool]], seconds: int, until: int) -> tuple[list[tuple[int, list[str], bool]], list[tuple[int, str | None, bool]]]:
    """(windows that end by ``until``, events that are left).  A window opens at the first event that no window holds yet."""
    held, done, at = sorted(held, key=lambda e: (e[0], e[1] or "")), [], 0
    while at < len(held) and held[at][0] + seconds <= until:
        start, end = held[at][0], at
        while end < len(held) and held[end][0] < start + seconds:
            end += 1
        own = held[at:end]
        done.append((start, sorted({p for _, p, again in own if p is not None and not again}), any(again for _, _, again in own)))
        at = end
    return done, held[at:]


def windowed(feed: DataFrame, seconds: int = WINDOW_SECONDS, delay: int = WINDOW_SECONDS) -> DataFrame:
    """(window, paths, rescan) of a stream of EVENTS: each window opens at the first change that the one before doesn't hold,
    and is given once no event that is at most ``delay`` seconds late can fall into it.  Later ones are left out of windows
    that are given, and open one of their own if none that is open holds them.  The state is the distinct
    changes of open windows; an idle feed closes them as its clock moves on."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [(int(a), p, bool(r)) for a, p, r in zip(*state.get, strict=True)] if state.exists else []
        for batch in batches:
            held += [(int(a), p, k == "overflow") for a, p, k in zip(batch["at"], batch["path"], batch["kind"], strict=True)]
        done, left = folded(list(set(held)), seconds, state.getCurrentWatermarkMs() // 1000)
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(max(left[0][0] + seconds, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["window", "paths", "rescan"])

    real = feed.where("kind <> 'access' AND at IS NOT NULL").withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", f"{delay} seconds")
    return real.withColumn("_feed", F.lit(0)).groupBy("_feed").applyInPandasWithState(run, WINDOWED, "at array<long>, path array<string>, again array<boolean>", "append", "EventTimeTimeout")


def apply(builder: Builder, batch: DataFrame) -> Stats:
    """One window of changes."""
    roots = [os.path.realpath(r.root) for r in builder.config.repos]
    paths, overflow = changed_paths(batch, roots)
    if overflow.limit(1).count():
        return builder.update(roots)
    found = [r.path for r in paths.toLocalIterator()]  # as many as files changed within one window
    return builder.update(found) if found else Stats()


def follow(builder: Builder, feed: DataFrame, checkpoint: str, seconds: int = WINDOW_SECONDS, once: bool = False) -> StreamingQuery:
    """Keep the index up to date with a feed of EVENTS."""
    writer = feed.writeStream.foreachBatch(lambda batch, _: apply(builder, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
