"""The tables of one data folder: bound inputs, and silver tables computed once and stored."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.config import RULES
from tidewarden.operators import alerts, features, lookup, normalize, ops, rules, scoring, windows
from tidewarden.session import scratch_path
from tidewarden.sources import binding, layout
from tidewarden.sources.tables import read_table

_stored: dict[tuple[str, ...], str] = {}


class Workspace:
    """Lazy access by table name.

    Transactions, customers, window metrics, alerts and scores feed most questions. As in a running
    installation they are stored tables: the first reader computes and writes them to the shared folder,
    later readers scan the files with pushdown. Everything else is a plan over the given tables. Payments
    arrive in time order, so the row groups of the stored transactions cover short time spans and filters
    on the event or ingestion time skip most of them.
    """

    def __init__(self, spark: SparkSession, base: str, as_of: str = binding.AS_OF, cfg: dict = RULES):
        self.spark, self.base, self.as_of, self.cfg = spark, base, as_of, cfg

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base, name)

    def _path(self, name: str, build: Callable[[], DataFrame], *depends: object) -> str:
        """Where a stored table lies; ``depends`` names the settings of the workspace that the table follows from, besides the inputs."""
        key = (self.spark.sparkContext.applicationId, self.base, name, *map(repr, depends))
        if key not in _stored:
            path = scratch_path(self.spark, name)
            build().write.parquet(path)
            _stored[key] = path
        return _stored[key]

    def _store(self, name: str, build: Callable[[], DataFrame], *depends: object) -> DataFrame:
        return self.spark.read.parquet(self._path(name, build, *depends))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def customers(self) -> DataFrame:
        return self._store("customers", lambda: binding.customers(self.table("customer")))

    @cached_property
    def wire(self) -> DataFrame:
        return binding.payments(self.events)

    @cached_property
    def normalized(self) -> DataFrame:
        """Transactions straight from the payments; ingested 30 seconds after the event."""
        return self._normalize(self.wire)

    @staticmethod
    def _normalize(wire: DataFrame) -> DataFrame:
        return normalize.normalize(wire, F.to_timestamp("ts") + F.expr("INTERVAL 30 SECONDS"))

    @cached_property
    def txns(self) -> DataFrame:
        """Dealt by time while the rows are still narrow: a single task may read the file of the events."""
        return self._store("transactions", lambda: self._normalize(binding.payments(self.events.repartitionByRange("ts"))))

    @cached_property
    def laid(self) -> DataFrame:
        """The transactions by day and clustered by sender, for lookups of a customer."""
        key = (self.spark.sparkContext.applicationId, self.base, "laid")
        if key not in _stored:
            path = scratch_path(self.spark, "laid")
            layout.lay_out(self.txns, path)
            _stored[key] = path
        return self.spark.read.parquet(_stored[key])

    @cached_property
    def addresses(self) -> DataFrame:
        return binding.address_expand(self.customers)

    @cached_property
    def acquired(self) -> DataFrame:
        return binding.acquisition_log(self.table("orders"))

    @cached_property
    def event_log(self) -> DataFrame:
        return binding.event_log(self.events)

    @cached_property
    def job_runs(self) -> DataFrame:
        return binding.job_runs(self.events)

    @cached_property
    def metrics(self) -> DataFrame:
        return self._store("metrics", lambda: windows.window_metrics(self.txns, self.as_of), self.as_of)

    @property
    def one_minute_later(self):
        return F.col("ts") + F.expr("INTERVAL 60 SECONDS")

    def evaluated(self, **options) -> DataFrame:
        """Alerts straight from the payments, for the rule questions."""
        metrics = windows.window_metrics(self.txns, self.as_of)
        return rules.evaluate_rules(
            self.txns, metrics, self.customers, self.cfg, flagged_at=self.one_minute_later, **options
        )

    @cached_property
    def flags_path(self) -> str:
        scored = lambda: alerts.alert_priority(self.evaluated(), self.customers)
        return self._path("flags", scored, self.as_of, self.cfg)

    @cached_property
    def flags(self) -> DataFrame:
        return self.spark.read.parquet(self.flags_path)

    @cached_property
    def dispositions(self) -> DataFrame:
        return binding.dispositions(self.flags)

    @cached_property
    def reports(self) -> DataFrame:
        return binding.filed_reports(self.flags, self.as_of)

    @cached_property
    def budgeted(self) -> DataFrame:
        """The last day's alerts that fit the budget, given those of the 24 hours before.

        The caps are above the defaults, which the test tables' alerts of one day fill. Stored, so that plans know how few
        they are before they read the payments.
        """
        return self._store("budgeted", self._within_budget, self.as_of, self.cfg)

    def _within_budget(self) -> DataFrame:
        day = F.lit(self.as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
        before = day - F.expr("INTERVAL 24 HOURS")
        at = F.col("flagged_at")
        counts = (
            self.flags.filter((at >= before) & (at < day))
            .groupBy("rule_name")
            .agg(F.count(F.lit(1)).alias("alert_count"))
        )
        return alerts.apply_budget(self.flags.filter(at >= day), counts, global_cap=150, rule_cap=40)

    @cached_property
    def archive(self) -> DataFrame:
        """Only budgeted alerts are archived: at most the daily cap times one customer's payments."""
        return alerts.archive(self.budgeted, self.txns, self.as_of)

    @cached_property
    def spend(self) -> DataFrame:
        return windows.spend_30d(self.txns, self.as_of)

    @cached_property
    def behavior(self) -> DataFrame:
        return windows.behavior_30d(self.txns, self.as_of)

    @cached_property
    def pipeline_metrics(self) -> DataFrame:
        """Audit snapshots at ``as_of`` and one hour before."""
        earlier = F.lit(self.as_of).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
        snapshots = [ops.pipeline_audit(self.flags, self.customers, self.acquired, t) for t in (self.as_of, earlier)]
        return snapshots[0].unionByName(snapshots[1])

    @cached_property
    def feature_rows(self) -> DataFrame:
        return features.features(self.txns, self.customers, self.flags, self.as_of)

    @cached_property
    def labelled(self) -> DataFrame:
        """Features with the label used for training: a high-value or velocity alert in 30 days."""
        hit = (
            self.flags.filter(F.col("rule_name").isin("high_value", "daily_velocity"))
            .select("customer_id", F.lit(True).alias("hit"))
            .distinct()
        )
        return (
            self.feature_rows.drop("rule_flagged")
            .join(hit, "customer_id", "left")
            .withColumn("rule_flagged", F.coalesce("hit", F.lit(False)))
            .drop("hit")
        )

    @cached_property
    def lookup(self) -> lookup.Index:
        parts = self._store("lookup_parts", lambda: lookup.build_parts(self.customers))
        return lookup.Index(parts, self._store("lookup_postings", lambda: lookup.build_postings(self.customers, parts)))

    @cached_property
    def scored(self) -> DataFrame:
        """A deterministic score standing in for a model: log volume, min-max normalised."""
        raw = self.labelled.withColumn("raw_score", F.log1p("volume_30d"))
        return scoring.normalize(scoring.flag_anomalies(raw, "raw_score"), "raw_score")

    @cached_property
    def scores(self) -> DataFrame:
        return self._store("scores", lambda: scoring.score_snapshot(self.scored, "v1"), self.as_of, self.cfg)

    @cached_property
    def steps(self) -> DataFrame:
        return scoring.confusion_steps(self.scores, "anomaly_score", "rule_flagged")
