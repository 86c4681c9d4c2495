"""What the operators share: table access, stored intermediate tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.session import scratch_path

#: Fixed by the result contracts: a word is a run of anything but these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Text bytes handled at a time inside a task; bounds a worker's memory, not the work.
SLICE_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_residue(column: str, modulus: int) -> Column:
    """crc32 of the decimal id modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column ``text`` holds about SLICE_BYTES, one row at least."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(lengths):
            if total and total + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(lengths) > start:
            yield batch.slice(start)
