"""Versioned tables: every step of a crawl is a version that is there as a whole or not at all.

A version is a list of folders for each table. New rows are written to new folders first; then one small file, which
Spark's committer renames into place, names the version, the one it is based on, and its folders. A step that is killed
before that leaves the version before it in force, and folders that nobody names, which `expire` removes. Rolling back
is a new version that names an old one's folders. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version long, based_on long, note string, table string, path string"
#: Folders of a table from which on a commit writes them as one.
MOST_FOLDERS = 64


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        """schemas: of the tables, by name."""
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self) -> DataFrame:
        return self.spark.read.schema(VERSION).parquet(f"{self.root}/_versions")

    def current(self) -> int | None:
        """The number of the version in force."""
        if not self._fs.exists(self._path(f"{self.root}/_versions")):
            return None
        return self._log().agg(F.max("version")).first()[0]

    def folders(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table of a version, by default of the one in force: some dozens."""
        version = self.current() if version is None else version
        if version is None:
            return {}
        out: dict[str, list[str]] = {}
        for r in self._log().filter(F.col("version") == version).collect():
            if r["path"] is not None:
                out.setdefault(r["table"], []).append(f"{self.root}/{r['path']}")
            else:
                out.setdefault(r["table"], [])
        return {name: sorted(paths) for name, paths in out.items()}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        paths = self.folders(version).get(table, [])
        reader = self.spark.read.schema(self.schemas[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def write(self, table: str, rows: DataFrame) -> str:
        """Write rows of a table that no version names yet; returns their folder."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        fields = self.spark.createDataFrame([], self.schemas[table]).schema
        rows.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.parquet(path)
        return path

    def commit(self, added: dict[str, str], replaced: dict[str, str] | None = None, note: str = "") -> int:
        """A new version: the one in force with folders added to tables, or in place of all that a table had."""
        known = self.current()
        tables = {**dict.fromkeys(self.schemas, []), **self.folders(known)}
        for table, path in added.items():
            tables[table] = [*tables[table], path]
        for table, path in (replaced or {}).items():
            tables[table] = [path]
        for table, paths in tables.items():
            if len(paths) > MOST_FOLDERS:
                tables[table] = [self.write(table, self.spark.read.schema(self.schemas[table]).parquet(*paths))]
        return self._put(tables, known, note)

    def _put(self, tables: dict[str, list[str]], based_on: int | None, note: str) -> int:
        number = 0 if based_on is None else based_on + 1
        rows = [(number, based_on, note, table, path) for table, paths in tables.items() for path in ([p.removeprefix(f"{self.root}/") for p in paths] or [None])]
        # One file, so that the version appears at once.
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")
        return number

    def roll_back(self, version: int) -> int:
        """A new version with the tables of an old one."""
        tables = self.folders(version)
        if not tables:
            raise ValueError(f"no such version: {version}")
        return self._put(tables, self.current(), f"as {version}")

    def expire(self, keep: int = 1) -> list[str]:
        """Remove folders that none of the last `keep` versions names; returns them. The versions before can't be read then."""
        last = self.current()
        named = {p for v in range(max(0, (last or 0) - keep + 1), (last or 0) + 1) for paths in self.folders(v).values() for p in paths}
        gone = []
        for table in self.schemas:
            folder = self._path(f"{self.root}/{table}")
            if self._fs.exists(folder):
                for found in self._fs.listStatus(folder):
                    path = f"{self.root}/{table}/{found.getPath().getName()}"
                    if path not in named:
                        self._fs.delete(found.getPath(), True)
                        gone.append(path)
        return sorted(gone)
