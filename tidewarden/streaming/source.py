"""Payment streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidewarden.sources import binding
from tidewarden.sources.schema import EVENTS_SCHEMA
from tidewarden.sources.tables import parse_txn_json


def read_txn_stream(
    spark: SparkSession,
    path: str,
    schema: StructType = EVENTS_SCHEMA,
    glob: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream of new parquet files below a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str = "transactions.raw") -> DataFrame:
    """Decoded payments of a topic, from its end on; lost offsets do not stop the stream."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .option("failOnDataLoss", "false")
        .load()
    )
    return parse_txn_json(raw)


def payment_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The test events as a stream of wire payments with a real timestamp."""
    return binding.payments(read_txn_stream(spark, path, **options))
