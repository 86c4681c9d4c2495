"""Alert episodes as keyed state: opened once, counted, closed by a decision or by silence, then armed again.

The key is customer and rule. The first alert of a key opens an episode; further ones only raise its count and last
time. A decision closes the episode and arms the key again, so that the next alert opens a new one. Without either, a
timer closes the episode when the watermark has passed its last alert by ``memory``. The state is one row per open
episode, whatever the number of alerts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewarden.streaming.queries import LATENESS, run_to

ALERT, DECISION = "alert", "decision"
OPENED, DECIDED, EXPIRED = "opened", "decided", "expired"
MEMORY_DAYS = 32

# Times are microseconds since the epoch inside the state, so no worker's time zone matters.
_EPISODE = "customer_id string, rule_name string, change string, first_us bigint, last_us bigint, alert_count bigint, disposition string"
_STATE = "first_us bigint, last_us bigint, alert_count bigint"
_DAY_US = 86_400_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The processor travels with the job, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class EpisodeProcessor(StatefulProcessor):
    """One open episode per key, and at most one timer."""

    def __init__(self, memory_days: int = MEMORY_DAYS):
        self.memory = memory_days * _DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", _STATE)

    def _timer(self, last: int) -> int:
        return (last + self.memory) // 1000

    def _row(self, key, change: str, episode, disposition: str | None = None) -> Row:
        customer, rule = key
        first, last, count = episode
        return Row(
            customer_id=customer, rule_name=rule, change=change, first_us=first, last_us=last, alert_count=count, disposition=disposition
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = after = tuple(self.episode.get()) if self.episode.exists() else None
        for kind, ts, disposition in self._in_order(rows):
            if kind == DECISION:
                if after:
                    yield self._row(key, DECIDED, after, disposition)
                after = None
            elif after is None:
                after = (ts, ts, 1)
                yield self._row(key, OPENED, after)
            else:
                after = (min(after[0], ts), max(after[1], ts), after[2] + 1)
        if before and (after is None or after[1] != before[1]):
            self.handle.deleteTimer(self._timer(before[1]))
        if after is None:
            self.episode.clear()
        elif after != before:
            self.episode.update(after)
            self.handle.registerTimer(self._timer(after[1]))

    @staticmethod
    def _in_order(rows: Iterator[Row]) -> list[tuple]:
        """By time; a decision counts after the alerts of its own moment."""
        return sorted(((r["kind"], r["us"], r["disposition"]) for r in rows), key=lambda r: (r[1], r[0] == DECISION, r[2] or ""))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.episode.exists():
            yield self._row(key, EXPIRED, tuple(self.episode.get()))
            self.episode.clear()

    def close(self) -> None:
        pass


def alert_events(alerts: DataFrame) -> DataFrame:
    """Alerts as events of their key."""
    return alerts.select(
        "customer_id", "rule_name", F.lit(ALERT).alias("kind"), F.col("flagged_at").alias("ts"), F.lit(None).cast("string").alias("disposition")
    )


def decision_events(decided: DataFrame) -> DataFrame:
    """Decisions (customer_id, rule_name, disposition, created_at) as events of their key."""
    return decided.select("customer_id", "rule_name", F.lit(DECISION).alias("kind"), F.col("created_at").alias("ts"), "disposition")


def episodes(events: DataFrame, memory_days: int = MEMORY_DAYS, lateness: str = LATENESS) -> DataFrame:
    """Every change of an episode, from a stream of alert and decision events."""
    keyed = events.filter(F.col("customer_id").isNotNull() & F.col("rule_name").isNotNull() & F.col("ts").isNotNull())
    changes = (
        keyed.withColumn("us", F.unix_micros("ts"))
        .withWatermark("ts", lateness)
        .groupBy("customer_id", "rule_name")
        .transformWithState(EpisodeProcessor(memory_days), _EPISODE, "Append", "EventTime")
    )
    times = [F.timestamp_micros(f"{c}_us").alias(f"{c}_ts") for c in ("first", "last")]
    return changes.select("customer_id", "rule_name", "change", *times, "alert_count", "disposition")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; the session's own choice returns afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_episodes(events: DataFrame, base: str, memory_days: int = MEMORY_DAYS, lateness: str = LATENESS) -> DataFrame:
    """Run over all available events; all changes given out so far, with the batch that brought them."""
    with rocksdb_state(events.sparkSession):
        path = run_to(episodes(events, memory_days, lateness), base)
    return events.sparkSession.read.parquet(path)
