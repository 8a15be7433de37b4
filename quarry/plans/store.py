"""Immutable generations of the index, and the pointer to the current one.

A generation is a folder of Parquet tables and a list of layers above it.  Symbols and references are range-
partitioned and sorted by name and file, so that the statistics of files and row
groups serve name lookups, and a name with very many rows spreads over several files.  A build writes
the next generation and then replaces the pointer in one step: readers see the old
one or the new one, never a mixture, and a build that fails leaves nothing behind
that a reader could find.

An update writes a layer: the rows of changed files, and a tombstone for each file whose
older rows are hidden (``rows`` false: only its entry in ``files``).  A reader merges: a row shows if no
later layer has a tombstone for its file.  What an update writes is in proportion to the change.
Layers are merged with others of their size, so that there are few of them, and a row is
written again only a number of times that grows with the logarithm of what is written after it; once they
hold a quarter of the base, everything becomes a new base.  ``vacuum`` removes what no pointer reaches.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILES, REFS, REPOS, SCHEMA_VERSION, SYMBOLS

TABLES = {"repos": REPOS, "files": FILES, "symbols": SYMBOLS, "refs": REFS}
GONE = "file_id long, rows boolean"
#: Layers that a reader merges at most; the share of the base at which layers become a new base, and the bytes below which
#: they don't; a layer joins one of at most so many times its size.
MOST_LAYERS, WHOLE_SHARE, LEAST_BYTES, RATIO = 8, 4, 8 << 20, 2


@dataclass
class Manifest:
    generation: int = 0
    folder: str = ""
    ready: bool = False
    updated_at: int = 0
    schema_version: int = SCHEMA_VERSION
    identity: str = ""
    base: str = ""
    base_identity: str = ""
    directory: int = 0
    fingerprint: dict = field(default_factory=dict)
    size: int = 0
    layers: list = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._work = spark, root.rstrip("/"), ""
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        fresh, target = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, target, overwrite)

    def manifest(self) -> Manifest:
        text = self._text("CURRENT")
        found = Manifest(**json.loads(text)) if text else Manifest()
        if found.schema_version > SCHEMA_VERSION:
            raise RuntimeError(f"the index has schema {found.schema_version}; this engine reads up to {SCHEMA_VERSION}")
        return found

    def read(self, table: str, manifest: Manifest | None = None) -> DataFrame:
        """A table of the current generation; one that isn't there is empty.  Columns that an older schema lacks are null."""
        m = manifest or self.manifest()
        if not m.folder:
            return self.spark.createDataFrame([], TABLES[table])
        if table == "repos":
            return self._rows([m.folder, *(x["folder"] for x in m.layers)][-1], table)
        return self._merged(table, [m.folder, *(x["folder"] for x in m.layers)])

    def _rows(self, folder: str, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES.get(table, GONE)).parquet(f"{self.root}/{folder}/{table}")

    def _merged(self, table: str, folders: list[str]) -> DataFrame:
        """The rows of the first folder and of the layers above it, without those that a later layer hides.  Filters on
        the rows reach every scan; the tombstones are the small side of a left join on ``file_id``."""
        if len(folders) == 1:
            return self._rows(folders[0], table)
        rows = reduce(DataFrame.unionByName, (self._rows(f, table).withColumn("_layer", F.lit(k)) for k, f in enumerate(folders)))
        gone = reduce(DataFrame.unionByName, (self._rows(f, "gone").withColumn("_last", F.lit(k)) for k, f in enumerate(folders) if k))
        gone = gone.where(F.lit(table == "files") | F.col("rows")).groupBy("file_id").agg(F.max("_last").alias("_last"))
        return rows.join(gone, "file_id", "left").where(F.col("_last").isNull() | (F.col("_layer") >= F.col("_last"))).select(*TABLES[table].names)

    def holds(self, table: str, manifest: Manifest) -> bool:
        """Are the table's files there?"""
        return all(self._fs.exists(self._path(f"{self.root}/{f}/{table}")) for f in (manifest.folder, *(x["folder"] for x in manifest.layers)))

    def _write_tables(self, folder: str, tables: dict[str, DataFrame]) -> int:
        """Write tables into a folder; the bytes written."""
        for name, schema in TABLES.items():
            rows = tables[name].select(*(tables[name][f.name].cast(f.dataType) for f in schema))
            if name in ("symbols", "refs"):
                rows = rows.repartitionByRange("name", "file_id").sortWithinPartitions("name", "file_id")
            elif name == "files":
                rows = rows.sortWithinPartitions("repo_id", "path")
            rows.write.parquet(f"{self.root}/{folder}/{name}")
        if "gone" in tables:
            tables["gone"].select(F.col("file_id").cast("long"), "rows").write.parquet(f"{self.root}/{folder}/gone")
        return self._fs.getContentSummary(self._path(f"{self.root}/{folder}")).getLength()

    def _point(self, old: Manifest, **more) -> Manifest:
        m = Manifest(**(asdict(old) | {"generation": old.generation + 1, "ready": True, "updated_at": int(time.time()), "schema_version": SCHEMA_VERSION} | more))
        self._write("CURRENT", json.dumps(asdict(m)))
        return m

    def publish(self, tables: dict[str, DataFrame], folder: str | None = None, **more) -> Manifest:
        """Write the tables as the next generation and point to it."""
        old = self.manifest()
        folder = folder or f"gen-{old.generation + 1:08d}-{uuid.uuid4().hex[:8]}"
        size = self._write_tables(folder, {t: tables[t] for t in TABLES})
        return self._point(old, folder=folder, size=size, layers=[], **more)

    def publish_delta(self, tables: dict[str, DataFrame], gone: DataFrame) -> Manifest:
        """Write a layer above the current generation: rows of ``files``, ``symbols`` and ``refs`` that come, all ``repos``,
        and ``gone`` (file_id, rows), the files whose older rows are hidden.  A file that comes again is in both."""
        old = self.manifest()
        if not old.folder:
            raise RuntimeError("there is no generation to add to")
        folder = f"delta-{old.generation + 1:08d}-{uuid.uuid4().hex[:8]}"
        gone = gone.groupBy("file_id").agg(F.bool_or("rows").alias("rows"))
        size = self._write_tables(folder, {t: tables[t] for t in TABLES} | {"gone": gone})
        m = self._point(old, layers=[*old.layers, {"folder": folder, "size": size}])
        return self.compact(m) if len(m.layers) > MOST_LAYERS or self._large(m) else m

    def _large(self, m: Manifest) -> bool:
        """Do the layers hold a large share of the base?"""
        size = sum(x["size"] for x in m.layers)
        return size > LEAST_BYTES and WHOLE_SHARE * size > m.size

    def compact(self, m: Manifest | None = None, whole: bool = False) -> Manifest:
        """Merge the youngest layers, as far back as each older one is at most ``RATIO`` times what is merged so far; a new
        base once the layers hold a large share of it, or if asked for.  The rows that show stay the same."""
        m = m or self.manifest()
        if whole or self._large(m):
            return self.publish({t: self.read(t, m) for t in TABLES}) if m.layers else m
        first, size = len(m.layers) - 1, m.layers[-1]["size"] if m.layers else 0
        while first > 0 and (m.layers[first - 1]["size"] <= RATIO * size or len(m.layers) - first < 2):
            first -= 1
            size += m.layers[first]["size"]
        young = [x["folder"] for x in m.layers[first:]]
        if len(young) < 2:
            return m
        folder = f"delta-{m.generation + 1:08d}-{uuid.uuid4().hex[:8]}"
        gone = reduce(DataFrame.unionByName, (self._rows(f, "gone") for f in young)).groupBy("file_id").agg(F.bool_or("rows").alias("rows"))
        tables = {t: self._merged(t, young) for t in ("files", "symbols", "refs")} | {"repos": self._rows(young[-1], "repos"), "gone": gone}
        size = self._write_tables(folder, tables)
        return self._point(m, layers=[*m.layers[:first], {"folder": folder, "size": size}])

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Remove generations, layers and work folders that the pointer doesn't reach and nobody has written to for so many
        seconds: a reader or a build may still use younger ones.  Their names."""
        m = self.manifest()
        held = {m.folder, f"{m.folder}-state", f"{m.folder}-files", *(x["folder"] for x in m.layers)}
        found = [(x.getPath().getName(), x.getModificationTime()) for x in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        old = sorted(n for n, at in found if n.startswith(("gen-", "delta-", ".work-", ".CURRENT-")) and n not in held and time.time() - at / 1000 >= older_than)
        for name in old:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return old

    def land(self, df: DataFrame, name: str) -> DataFrame:
        """Write what a build has seen beside the index and read it back: an executor that is lost can't make the build look
        again at sources that may have changed meanwhile."""
        self._work = self._work or f".work-{uuid.uuid4().hex}"
        path = f"{self.root}/{self._work}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Remove what was landed."""
        if self._work:
            self._fs.delete(self._path(f"{self.root}/{self._work}"), True)
            self._work = ""

    def snapshot(self, target: str) -> Store:
        """Copy the current generation to a new place, once: it's an error if something is there.  An index with
        files that wait for extraction can't be a base.  The identity follows from the rows."""
        from ..operators.rollups import fingerprint

        m, other = self.manifest(), Store(self.spark, target)
        if not m.ready:
            raise RuntimeError("the index isn't ready")
        if other._fs.exists(other._path(f"{other.root}/CURRENT")):
            raise FileExistsError(target)
        files = self.read("files", m)
        if files.where("mtime_ns = -1").limit(1).count():
            raise RuntimeError("the index has files that wait for extraction")
        prints = {t: [str(v) for v in fingerprint(self.read(t, m), TABLES[t].names).first()] for t in TABLES}
        other.publish({t: self.read(t, m) for t in TABLES}, identity=hashlib.sha256(json.dumps(prints, sort_keys=True).encode()).hexdigest())
        return other

    def sizes(self) -> dict[str, int]:
        """Files and bytes of the current generation."""
        m = self.manifest()
        if not m.folder:
            return {"files": 0, "bytes": 0}
        all_ = [self._fs.getContentSummary(self._path(f"{self.root}/{f}")) for f in (m.folder, *(x["folder"] for x in m.layers))]
        return {"files": sum(x.getFileCount() for x in all_), "bytes": sum(x.getLength() for x in all_)}

    def base_files(self) -> int:
        """Files of the generation below the layers, from the statistics of its Parquet files."""
        m = self.manifest()
        return self._rows(m.folder, "files").count() if m.folder else 0

    def outdated(self) -> bool:
        """An older schema asks for a new extraction of every file."""
        return self.manifest().schema_version < SCHEMA_VERSION
