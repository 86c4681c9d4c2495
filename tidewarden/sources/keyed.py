"""A keyed table in hash buckets: an update rewrites the buckets of its keys and leaves the others' files alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.sources import sinks
from tidewarden.sources.versions import Version, VersionedTable

BUCKETS = 64
_BUCKET = "_bucket"


class KeyedTable(VersionedTable):
    """Rows with unique, non-null keys; every change is one new version.

    The bucket of a row is the hash of its key, so buckets are even whatever the keys' values are. Buckets are rewritten
    whole: choose so many that one is a small share of the table. A stream hands over its batch number, and a batch that
    runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.keys, self.buckets = list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _put(self, base: Version | None, rows: DataFrame, replaced: list[str], **notes: int) -> Version:
        """Write ``rows`` by bucket; they stand for all rows of the ``replaced`` buckets."""
        notes = {**(base.notes if base else {}), **notes, "buckets": self.buckets}
        folder = self.new_folder()
        # Spark splits large buckets and joins small ones to files of a good size.
        laid = rows.withColumn(_BUCKET, self._bucket()).hint("rebalance", _BUCKET)
        laid.write.partitionBy(_BUCKET).parquet(self.full(folder))
        parts = {k: v for k, v in (base.parts if base else {}).items() if k not in replaced}
        listed = self._files.listStatus(self._hadoop(self.full(folder)))
        for name in (s.getPath().getName() for s in listed):
            if name.startswith(f"{_BUCKET}="):
                parts[name.split("=")[1]] = f"{folder}/{name}"
        return self.commit(base, parts, rows.schema.json(), **notes)

    def _checked(self) -> Version | None:
        base = self.current()
        if base and base.notes.get("buckets", self.buckets) != self.buckets:
            raise ValueError(f"{self.path} has {base.notes['buckets']} buckets, not {self.buckets}")
        return base

    def _touched(self, base: Version | None, rows: DataFrame) -> list[str]:
        """Names of the stored buckets that hold keys of ``rows``; at most one per bucket comes to the driver."""
        numbers = rows.select(self._bucket().alias("b")).distinct().collect()
        return sorted(n for n in (str(r["b"]) for r in numbers) if base and n in base.parts)

    def _old(self, base: Version | None, touched: list[str], like: DataFrame) -> DataFrame:
        return self.rows(base, touched) if base else like.limit(0)

    def upsert(self, updates: DataFrame, order_by: Sequence[Column], batch: int | None = None) -> Version | None:
        """Rows of ``updates`` replace those of their keys; of several the first in ``order_by`` counts.

        Returns the new version, or the present one if ``batch`` was applied before.
        """
        base = self._checked()
        if base and batch is not None and base.notes.get("batch", -1) >= batch:
            return base
        touched = self._touched(base, updates)
        merged = sinks.upsert(self._old(base, touched, updates), updates, self.keys, order_by)
        return self._put(base, merged, touched, **({} if batch is None else {"batch": batch}))

    def insert_new(self, new: DataFrame) -> Version:
        """Rows whose key is not stored yet."""
        base = self._checked()
        touched = self._touched(base, new)
        old = self._old(base, touched, new)
        fresh = sinks.insert_new(old, new, self.keys)
        return self._put(base, old.unionByName(fresh, allowMissingColumns=True), touched)

    def delete(self, keys: DataFrame) -> Version:
        """Drop the rows with the given keys."""
        base = self._checked()
        touched = self._touched(base, keys)
        kept = self._old(base, touched, keys).join(keys.select(*self.keys), self.keys, "left_anti")
        return self._put(base, kept, touched)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of a few keys; only their buckets are scanned."""
        base = self._checked()
        found = self._old(base, self._touched(base, keys), keys)
        return found.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
