"""Versioned tables under one root, with a log of small commit files.

A commit writes the tables that change into folders of their own and then adds one log
entry, by a rename that fails if the entry is there. The entry names every table's
folder, relative to the root, and holds the journal's keys. Readers take the last entry: they see all of a
commit or nothing of it, whatever fails in between, and two writers cannot both win.
The root may lie on any file system that Spark writes and that renames atomically.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the log -------------------------------------------------------------------

    def _path(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> int:
        """The last version; 0 before the first commit."""
        fs, log = self._path(f"{self.root}/_log")
        if not fs.exists(log):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(log))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def entry(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        if not version:
            return {"version": 0, "generation": 0, "tables": {}, "keys": {}}
        fs, p = self._path(f"{self.root}/_log/{version:020d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _append(self, entry: dict) -> None:
        name = f"{self.root}/_log/{entry['version']:020d}.json"
        fs, temp = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(json.dumps(entry).encode())
        out.close()
        jvm = self.spark._jvm
        _, final = self._path(name)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(temp).toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without the overwrite option, a rename onto an entry fails
            context.rename(fs.makeQualified(temp), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(final):
                raise Conflict(f"version {entry['version']} is there already") from e
            raise

    # -- tables --------------------------------------------------------------------

    def publish(self, tables: dict[str, DataFrame], content_changed: bool = True, keys: dict | None = None, partition_by: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> int:
        """Commit tables and journal keys (a null value removes a key); the rest stays as it is.

        ``content_changed`` counts the generation up; a change of card scopes alone does not.
        """
        before = self.entry()
        version = before["version"] + 1
        folders = {n: p for n, p in before["tables"].items() if n not in drop}
        for name, df in tables.items():
            folders[name] = f"{name}/{version:08d}-{uuid.uuid4().hex[:8]}"
            writer = df.write
            if partition_by and name in partition_by:
                writer = writer.partitionBy(partition_by[name])
            writer.parquet(f"{self.root}/{folders[name]}")
        merged = {**before["keys"], **(keys or {})}
        self._append({"version": version, "generation": before["generation"] + int(content_changed), "tables": folders, "keys": {k: v for k, v in merged.items() if v is not None}})
        return version

    def has(self, name: str) -> bool:
        return name in self.entry()["tables"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.entry()['tables'][name]}")

    def read_or_empty(self, name: str, schema: str) -> DataFrame:
        return self.read(name) if self.has(name) else self.spark.createDataFrame([], schema)

    def read_all(self) -> dict[str, DataFrame]:
        """All tables of one version."""
        return {name: self.spark.read.parquet(f"{self.root}/{folder}") for name, folder in self.entry()["tables"].items()}

    def generation(self) -> int:
        return self.entry()["generation"]

    def key(self, name: str, default=None):
        return self.entry()["keys"].get(name, default)

    def prune(self) -> int:
        """Delete folders that the last version does not name; for when no reader is on an older one."""
        keep, gone = set(self.entry()["tables"].values()), 0
        fs, root = self._path(self.root)
        for table in fs.listStatus(root) if fs.exists(root) else []:
            if table.isDirectory() and table.getPath().getName() != "_log":
                for version in fs.listStatus(table.getPath()):
                    folder = f"{table.getPath().getName()}/{version.getPath().getName()}"
                    if folder not in keep:
                        fs.delete(version.getPath(), True)
                        gone += 1
        return gone
