"""Versioned tables for streaming jobs: epochs, one manifest, tiered compaction.

A store is a folder with named tables.  Every micro-batch writes its rows of
each table to fresh folders and then commits them all by one manifest file,
which is written aside and renamed.  Readers take the newest manifest and only
the folders it names, so they see a batch whole or not at all; a batch that
died before its commit leaves folders that no manifest names, and its replay
writes new ones.  A replay of a committed epoch is skipped.

Rows are never changed in place.  ``latest`` resolves tables in which a later
epoch replaces what an earlier one said about a key.  When ``fanout`` folders of
one level have gathered they become one of the next level, so a row is
rewritten a logarithmic number of times and the folders to read stay few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFESTS = "_manifest"
EPOCH = "epoch"


class EpochStore:
    """Tables under ``root`` (any Hadoop file system); one writer, many readers."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 8):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # ---- manifests -----------------------------------------------------------

    def _versions(self) -> list[int]:
        where = self._path(f"{self.root}/{_MANIFESTS}")
        if not self._fs.exists(where):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(where))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest committed manifest: ``epoch``, ``facts`` and the folders of each table."""
        versions = self._versions()
        if not versions:
            return {"version": 0, EPOCH: -1, "facts": {}, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/{_MANIFESTS}/v{versions[-1]:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        manifest = {**manifest, "version": manifest["version"] + 1}
        final = self._path(f"{self.root}/{_MANIFESTS}/v{manifest['version']:012d}.json")
        aside = self._path(f"{self.root}/{_MANIFESTS}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            raise RuntimeError(f"another writer published version {manifest['version']} of {self.root}")

    # ---- reading -------------------------------------------------------------

    def schema_of(self, table: str) -> str | None:
        return self.manifest()["tables"].get(table, {}).get("schema")

    def read(self, table: str) -> DataFrame | None:
        """All committed rows of a table with their ``epoch``; None before the first commit."""
        found = self.manifest()["tables"].get(table)
        if not found:
            return None
        return self._folders(found)

    def _folders(self, found: dict, only: list[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        paths = [f"{self.root}/{p}" for p, _ in found["folders"]] if only is None else only
        reader = self.spark.read.schema(StructType.fromJson(json.loads(found["schema"])))
        if not paths:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"])))
        # one folder is one root; partition folders below it give their columns
        frames = [reader.option("basePath", p).parquet(p) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def latest(self, table: str, touched: str, keys: list[str]) -> DataFrame | None:
        """Rows of ``table`` whose epoch is the last that ``touched`` names for their keys."""
        rows, marks = self.read(table), self.read(touched)
        if rows is None or marks is None:
            return rows
        last = marks.groupBy(*keys).agg(F.max(EPOCH).alias(EPOCH))
        return rows.join(last, [*keys, EPOCH], "left_semi")

    # ---- writing -------------------------------------------------------------

    def committed(self, epoch: int) -> bool:
        return self.manifest()[EPOCH] >= epoch

    def commit(self, epoch: int, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None,
               sort_by: dict[str, list[str]] | None = None, facts: Callable[[], dict] | None = None,
               resolve: dict[str, tuple[str, list[str]]] | None = None) -> None:
        """Write the rows of an epoch and publish them together.

        ``resolve`` names, for tables in which later epochs replace earlier ones,
        the table of touched keys and the keys; compaction drops replaced rows.
        """
        partition_by, sort_by = partition_by or {}, sort_by or {}
        written = {name: self._write(name, df.withColumn(EPOCH, F.lit(epoch).cast("bigint")), partition_by.get(name), sort_by.get(name))
                   for name, df in tables.items()}
        now = self.manifest()
        for name, (folder, schema) in written.items():
            old = now["tables"].get(name, {"folders": []})
            now["tables"][name] = {"schema": schema, "folders": [*old["folders"], [folder, 0]],
                                   "partition_by": partition_by.get(name), "sort_by": sort_by.get(name), "resolve": (resolve or {}).get(name)}
        now[EPOCH] = epoch
        now["facts"] = {**now.get("facts", {}), str(epoch): facts() if facts else {}}
        self._publish(now)
        self._compact()

    def _write(self, name: str, df: DataFrame, partition_by: list[str] | None, sort_by: list[str] | None) -> tuple[str, str]:
        folder = f"{name}/{uuid.uuid4().hex[:16]}"
        if partition_by:
            # few files a partition folder; one far larger than others is split
            df = df.hint("rebalance", *partition_by)
        if sort_by:
            # rows of one key lie together: row groups can be skipped by its least and greatest
            df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{folder}")
        return folder, df.schema.json()

    def _compact(self) -> None:
        """Fold ``fanout`` folders of one level into one of the next."""
        now = self.manifest()
        changed, old = False, []
        for name, t in now["tables"].items():
            level = 0
            while sum(lv == level for _, lv in t["folders"]) >= self.fanout:
                some = [f for f, lv in t["folders"] if lv == level]
                rows = self._folders(t, [f"{self.root}/{f}" for f in some])
                if t.get("resolve"):
                    touched, keys = t["resolve"]
                    last = self._folders(now["tables"][touched]).groupBy(*keys).agg(F.max(EPOCH).alias(EPOCH))
                    rows = rows.join(last, [*keys, EPOCH], "left_semi")
                folder, _ = self._write(name, rows, t.get("partition_by"), t.get("sort_by"))
                t["folders"] = [x for x in t["folders"] if x[0] not in some] + [[folder, level + 1]]
                old += some
                changed, level = True, level + 1
        if changed:
            self._publish(now)  # replaced folders stay for readers of the older manifest; see drop_unnamed

    def drop_unnamed(self) -> int:
        """Delete folders that the newest manifest does not name (left by dead
        batches and compaction).  Call it when no reader uses an older one."""
        now, n = self.manifest(), 0
        live = {f for t in now["tables"].values() for f, _ in t["folders"]}
        for table in self._fs.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            if name.startswith("_") or not table.isDirectory():
                continue
            for folder in self._fs.listStatus(table.getPath()):
                if f"{name}/{folder.getPath().getName()}" not in live:
                    n += self._fs.delete(folder.getPath(), True)
        return n
