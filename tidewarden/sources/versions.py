"""Tables that change as a whole: data folders that are never rewritten, and small version files that point at them.

A version file names the folders that make up the table. It is created exclusively and counts only once it is complete,
so a reader sees one whole version or the one before, also while a writer works or after one has failed. Of two writers
that started from the same version the second fails instead of undoing the first.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its number, the folders by part, the schema as JSON, and notes of the writer."""

    number: int
    parts: dict[str, str]
    schema: str
    notes: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """Versions of one table below ``path``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._files = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, *below: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(*below))

    def _numbers(self) -> list[int]:
        folder = self._hadoop(self.path, _FOLDER)
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())

    def _file(self, number: int):
        return self._hadoop(self.path, _FOLDER, f"{number:012d}.json")

    def _load(self, number: int) -> Version | None:
        """The version, or None while its file is not complete."""
        stream = self._files.open(self._file(number))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return Version(number, found["parts"], found["schema"], found["notes"])

    def current(self, number: int | None = None) -> Version | None:
        """The newest complete version, or the one asked for; None if there is none."""
        for n in reversed(self._numbers()):
            if number is None or n == number:
                version = self._load(n)
                if version is not None:
                    return version
        return None

    def new_folder(self) -> str:
        """A name below the table's path for data that no version knows yet."""
        return f"data/{uuid.uuid4().hex}"

    def full(self, folder: str) -> str:
        return os.path.join(self.path, folder)

    def commit(self, base: Version | None, parts: dict[str, str], schema: str, **notes: int) -> Version:
        """Publish ``parts`` as the version after ``base``."""
        newest = self.current()
        if (newest.number if newest else 0) != (base.number if base else 0):
            raise Conflict(f"{self.path}: version {newest.number} was published meanwhile")
        version = Version(max(self._numbers(), default=0) + 1, parts, schema, notes)
        text = json.dumps({"parts": parts, "schema": schema, "notes": notes})
        try:
            stream = self._files.create(self._file(version.number), False)
        except Py4JJavaError as error:
            raise Conflict(f"{self.path}: version {version.number} is being written by another") from error
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return version

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of the one asked for."""
        version = self.current(number)
        if version is None:
            raise ValueError(f"{self.path}: no version" + ("" if number is None else f" {number}"))
        return self.rows(version, sorted(version.parts))

    def rows(self, version: Version, parts: list[str]) -> DataFrame:
        """The rows of some parts of a version."""
        schema = StructType.fromJson(json.loads(version.schema))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.full(version.parts[p]) for p in parts))

    def publish(self, df: DataFrame, **notes: int) -> Version:
        """Replace the whole table. ``df`` may read an earlier version of it."""
        base, folder = self.current(), self.new_folder()
        df.write.parquet(self.full(folder))
        return self.commit(base, {"all": folder}, df.schema.json(), **notes)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete data folders that none of the last ``keep`` versions uses, and return their names.

        Readers of older versions must have ended, and no writer may be at work.
        """
        kept = [v for v in map(self._load, self._numbers()) if v is not None][-keep:]
        # A part may be a folder inside one written at once; the written one is what stays or goes.
        used = {"/".join(p.split("/")[:2]) for v in kept for p in v.parts.values()}
        data = self._hadoop(self.path, "data")
        if not kept or not self._files.exists(data):
            return []
        names = [f"data/{s.getPath().getName()}" for s in self._files.listStatus(data)]
        gone = sorted(n for n in names if n not in used)
        for name in gone:
            self._files.delete(self._hadoop(self.path, name), True)
        for number in self._numbers():
            if number < kept[0].number:
                self._files.delete(self._file(number), False)
        return gone
