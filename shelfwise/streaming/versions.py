"""Tables in buckets that are replaced together, a version at a time.

A version is a small JSON file that names, for each table, the folder of each bucket. A writer
adds folders that no version names yet and then publishes a file that does, by renaming it into
place. So a reader, who takes the newest file, sees all tables as one version left them, also
while the next is written; what a failed writer left behind is replaced by its next try. Files hold an
entry per table and bucket, whose number is fixed, and never rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Version:
    """What one version names: table -> bucket -> number of the version that wrote it."""

    number: int = 0
    tables: dict[str, dict[int, int]] = field(default_factory=dict)
    notes: dict[str, object] = field(default_factory=dict)

    def replaced(self, table: str, scope: Iterable[int], written: Iterable[int]) -> Version:
        """The next version, in which a table has these buckets anew and lacks the rest of the scope."""
        gone = set(scope)
        kept = {b: n for b, n in self.tables.get(table, {}).items() if b not in gone}
        mine = kept | {b: self.number for b in written}
        return Version(self.number, self.tables | {table: mine}, self.notes)


class VersionedTables:
    """The versions under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> JavaObject:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self, path: JavaObject) -> JavaObject:
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        files = self._files(path)
        if not files.exists(path):
            return []
        return [status.getPath().getName() for status in files.listStatus(path)]

    @property
    def published(self) -> str:
        """The folder of the version files, one line of JSON each; a stream can follow it."""
        return f"{self.root}/versions"

    def numbers(self) -> list[int]:
        """The versions that can be read, oldest first."""
        return sorted(int(n[:-5]) for n in self._names("versions") if n[:-5].isdigit() and n.endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """A published version, the newest by default; None before the first."""
        if number is None:
            number = max(self.numbers(), default=None)
        if number is None:
            return None
        path = self._path(f"versions/{number}.json")
        stream = self._files(path).open(path)
        read = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        tables = {t: {int(b): n for b, n in buckets.items()} for t, buckets in read["tables"].items()}
        return Version(number, tables, read["notes"])

    def next_version(self, **notes: object) -> Version:
        """What the next version starts from: the newest one, with other notes."""
        before = self.version() or Version()
        return Version(before.number + 1, before.tables, notes)

    def write(self, version: Version, table: str, rows: DataFrame, scope: Iterable[int]) -> Version:
        """Replaces the buckets in scope of a table by the rows, which have a ``bucket`` column.

        Rows are rebalanced by bucket: each becomes few files, and a large one is split.
        """
        folder = f"{table}/written_by={version.number}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        found = [name.removeprefix("bucket=") for name in self._names(folder) if name.startswith("bucket=")]
        return version.replaced(table, scope, map(int, found))

    def read(
        self, version: Version | None, table: str, buckets: Iterable[int] | None = None
    ) -> DataFrame | None:
        """A table, or some buckets of it, as a version has it; None where it has none of them."""
        known = version.tables.get(table, {}) if version else {}
        wanted = known if buckets is None else set(buckets) & set(known)
        paths = [f"{self.root}/{table}/written_by={known[b]}/bucket={b}" for b in sorted(wanted)]
        return self.spark.read.parquet(*paths) if paths else None

    def publish(self, version: Version) -> None:
        """Makes a version the newest one, whole or not at all."""
        line = json.dumps({"tables": version.tables, "notes": version.notes}, sort_keys=True)
        ready, place = self._path(f"_ready/{version.number}.json"), self._path(f"versions/{version.number}.json")
        files = self._files(place)
        files.mkdirs(place.getParent())
        out = files.create(ready, True)
        out.write(bytearray(line.encode()))
        out.close()
        if not files.rename(ready, place):
            raise RuntimeError(f"version {version.number} was published by another writer")

    def expire(self, keep: int) -> None:
        """Removes all but the newest versions, and the folders that only the others name.

        Readers of a removed version fail, so keep as many as a reader may lag behind.
        """
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        for number in numbers[:-keep]:
            path = self._path(f"versions/{number}.json")
            self._files(path).delete(path, False)
        for table in {t for v in kept for t in v.tables}:
            named = {(n, b) for v in kept for b, n in v.tables.get(table, {}).items()}
            for folder in self._names(table):
                number = int(folder.removeprefix("written_by="))
                if number > kept[-1].number:
                    continue
                for bucket in self._names(f"{table}/{folder}"):
                    if bucket.startswith("bucket=") and (number, int(bucket[7:])) not in named:
                        path = self._path(f"{table}/{folder}/{bucket}")
                        self._files(path).delete(path, True)
