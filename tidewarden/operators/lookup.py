"""Search texts resolved in bulk through a stored index of the substrings of customer ids and names.

Two stored tables, made once per state of the customers:

* ``parts``: every substring of one to ``GRAM`` characters, with how many customers have it and the smallest of their
  ids. It answers a short text by one equi join, however many customers share it. Only grams of exactly ``GRAM``
  characters are counted by customer; a shorter part counts once for every gram it begins, a bound from above.
* ``postings``: the customers of each substring of exactly ``GRAM`` characters, without those that more than
  ``SHARED`` customers have.

A longer text is looked up under the rarest of its grams and checked on that gram's customers only; a text with a gram
that nobody has is dropped at once. A text whose grams are all shared is compared with substrings of its own length,
kept only if asked for. There are only so many grams, so with many texts the pairs to check grow with texts times
customers; where they would exceed ``PAIRS`` per customer, a gram counts as shared from ``FEW`` customers on, and the rest
grows with the customers alone. Patterns with wildcards take the rarest gram of their literal parts, or, if these are shorter,
the customers that have the longest part; patterns of wildcards alone are answered from the lengths of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.session import cut_lineage

GRAM = 6
SHARED = 1000
FEW = 8
PAIRS = 20
#: Characters of ids and names that one task cuts, however few files hold the customers.
TASK_CHARS = 1_000_000
_WILD = r"[%_\\\\]"


@dataclass(frozen=True)
class Index:
    """The stored tables of one state of the customers."""

    parts: DataFrame
    postings: DataFrame


def _cuts(text: Column, size: int | Column) -> Column:
    """All substrings of exactly ``size`` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substring(text, i, size))


def _fields(customers: DataFrame) -> DataFrame:
    """(customer_id, body): id and name in lower case, one row each, dealt to as many tasks as their characters need."""
    known = customers.filter(F.col("customer_id").isNotNull()).select("customer_id", F.coalesce("name", F.lit("")).alias("name"))
    chars = known.agg(F.sum(F.length("customer_id") + F.length("name"))).first()[0] or 0
    both = F.array_distinct(F.array(F.lower("customer_id"), F.lower("name")))
    return known.repartition(1 + chars // TASK_CHARS, "customer_id", "name").select("customer_id", F.explode(both).alias("body"))


def build_parts(customers: DataFrame) -> DataFrame:
    """(part, customers, customer_id): every short substring, combined in each task before the shuffle.

    Each place of a text gives one row, its next ``GRAM`` characters or those up to the end; every shorter part begins one
    of these and is made from the different ones only.
    """
    spots = F.sequence(F.lit(1), F.length("body"))
    longest = F.array_distinct(F.transform(spots, lambda i: F.substring("body", i, F.lit(GRAM))))
    found = _fields(customers).filter(F.col("body") != "").select("customer_id", F.explode(longest).alias("part"))
    # A customer with the part in id and name counts twice: the number only ranks and bounds.
    found = found.groupBy("part").agg(F.count(F.lit(1)).alias("customers"), F.min("customer_id").alias("customer_id"))
    begun = F.transform(F.sequence(F.lit(1), F.length("part")), lambda n: F.substring("part", F.lit(1), n))
    return (
        found.select("customers", "customer_id", F.explode(begun).alias("part"))
        .groupBy("part")
        .agg(F.sum("customers").alias("customers"), F.min("customer_id").alias("customer_id"))
    )


def build_postings(customers: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, customer_id) of the grams that at most ``SHARED`` customers have."""
    rare = parts.filter((F.length("part") == GRAM) & (F.col("customers") <= SHARED)).select("part")
    found = _fields(customers).select("customer_id", F.explode(F.array_distinct(_cuts(F.col("body"), GRAM))).alias("part"))
    return found.join(rare, "part", "left_semi").distinct()


def _hit() -> Column:
    return F.expr("name ILIKE concat('%', sid, '%') OR customer_id ILIKE concat('%', sid, '%')")


def _plain_hit() -> Column:
    """The same for a text without wildcards, whose ``body`` is in lower case."""
    return F.contains(F.lower("name"), F.col("body")) | F.contains(F.lower("customer_id"), F.col("body"))


def _longest_literal(pattern: Column) -> Column:
    """The longest run of a LIKE pattern between wildcards; an escaped character is one of the run."""
    held = F.replace(pattern, F.lit("\\\\"), F.lit("\3"))
    held = F.replace(F.replace(held, F.lit("\\%"), F.lit("\1")), F.lit("\\_"), F.lit("\2"))
    runs = F.transform(F.split(held, _WILD), lambda p: F.translate(p, "\1\2\3", "%_\\"))
    return F.array_max(F.transform(runs, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]


def _least(found: DataFrame) -> DataFrame:
    return found.groupBy("q").agg(F.min("customer_id").alias("customer_id"))


def _by_rarest(asked: DataFrame, customers: DataFrame, index: Index, hit: Column, few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches of the texts (q, sid, body) through their rarest gram, and the texts all of whose grams are shared.

    ``few`` is the number of customers from which a gram counts as shared if there would be too many pairs.
    """
    grams = asked.select("q", F.explode(F.array_distinct(_cuts(F.col("body"), GRAM))).alias("part"))
    known = grams.join(index.parts.select("part", "customers"), "part", "left").groupBy("q").agg(
        F.min(F.struct(F.coalesce("customers", F.lit(0)).alias("customers"), "part")).alias("rarest")
    )
    known = known.select("q", F.col("rarest.customers").alias("customers"), F.col("rarest.part").alias("part"))
    known = cut_lineage(known.filter(F.col("customers") > 0).join(asked, "q"))
    most = SHARED
    if few is not None:
        pairs = known.filter(F.col("customers") <= SHARED).agg(F.sum("customers")).first()[0] or 0
        most = min(few, SHARED) if pairs > PAIRS * customers.count() else SHARED
    anchored = known.filter(F.col("customers") <= most)
    found = anchored.join(index.postings, "part").join(customers.select("customer_id", "name"), "customer_id").filter(hit)
    return _least(found), known.filter(F.col("customers") > most).select(*asked.columns)


def _by_length(asked: DataFrame, customers: DataFrame) -> DataFrame:
    """Matches among substrings as long as some asked text; a substring nobody asks for leaves no row."""
    sizes = asked.select(F.length("part").alias("n")).distinct().agg(F.sort_array(F.collect_set("n"))).first()[0]
    if not sizes:
        return asked.select("q", F.lit(None).cast("string").alias("customer_id")).limit(0)
    every = F.array_distinct(F.concat(*[_cuts(F.col("body"), n) for n in sizes]))
    found = _fields(customers).select("customer_id", F.explode(every).alias("part"))
    least = found.join(asked.select("part").distinct(), "part", "left_semi").groupBy("part").agg(F.min("customer_id").alias("customer_id"))
    return asked.join(least, "part").select("q", "customer_id")


def _by_short_part(asked: DataFrame, customers: DataFrame) -> DataFrame:
    """Patterns (q, sid, part) whose longest literal part is short: checked on the customers that have it."""
    sizes = range(1, GRAM)
    found = _fields(customers).select("customer_id", F.explode(F.array_distinct(F.concat(*[_cuts(F.col("body"), n) for n in sizes]))).alias("part"))
    having = found.join(asked.select("part").distinct(), "part", "left_semi").distinct()
    return _least(having.join(asked, "part").join(customers.select("customer_id", "name"), "customer_id").filter(_hit()))


def _by_wildcards(asked: DataFrame, customers: DataFrame) -> DataFrame:
    """Patterns without any literal: as many characters as underscores must be there."""
    longest = F.greatest(F.length("customer_id"), F.coalesce(F.length("name"), F.lit(0)))
    by_size = customers.groupBy(longest.alias("n")).agg(F.min("customer_id").alias("customer_id"))
    up_to = by_size.select("customer_id", F.explode(F.sequence(F.lit(0), "n")).alias("n")).groupBy("n").agg(F.min("customer_id").alias("customer_id"))
    return asked.withColumn("n", F.regexp_count("sid", F.lit("_")).cast("int")).join(up_to, "n").select("q", "customer_id")


def resolve_targets(queries: DataFrame, customers: DataFrame, flags: DataFrame, index: Index) -> DataFrame:
    """Search texts to a customer id, else the newest alert of a payment, else the first customer with the text in id or name."""
    asked = queries.select("q", F.trim("q").alias("sid")).filter(F.col("sid") != "").distinct()
    by_id = (
        asked.filter(F.startswith(F.upper("sid"), F.lit("CUST-")))
        .join(customers.select("customer_id"), F.col("sid") == F.col("customer_id"))
        .select("q", F.lit("customer").alias("mode"), "customer_id")
    )
    left = asked.join(by_id.select("q"), "q", "left_anti")
    newest = flags.groupBy("txn_id").agg(
        F.min(F.struct((-F.unix_micros("flagged_at")).alias("age"), "rule_name", "customer_id")).alias("f")
    )
    by_alert = left.join(newest, F.col("sid") == F.col("txn_id")).select(
        "q", F.lit("alert").alias("mode"), "f.customer_id", "txn_id", "f.rule_name"
    )
    left = left.join(by_alert.select("q"), "q", "left_anti").withColumn("body", F.lower("sid"))

    plain = ~F.col("sid").rlike(_WILD)
    body = F.when(plain, F.col("body")).otherwise(_longest_literal(F.col("body")))
    length = F.length("body")
    kind = (
        F.when(plain & (length <= GRAM), "short").when(plain, "long").when(length >= GRAM, "long pattern").when(length > 0, "pattern")
        .when(F.contains("sid", F.lit("\\")), "nothing").otherwise("wildcards")
    )
    # Stored once: every kind of text reads it, and kinds that were not asked for are left out of the plan.
    left = cut_lineage(left.withColumn("body", body).withColumn("kind", kind))
    kinds = {r["kind"] for r in left.select("kind").distinct().collect()}
    of = {k: left.filter(F.col("kind") == k).drop("kind") for k in kinds}

    named = left.select("q", "sid").limit(0).select("q", F.lit(None).cast("string").alias("customer_id"))
    if "short" in of:
        found = of["short"].join(index.parts.select("part", "customer_id"), F.col("body") == F.col("part"))
        named = named.unionByName(found.select("q", "customer_id"))
    if "long" in of:
        found, common = _by_rarest(of["long"], customers, index, _plain_hit(), FEW)
        named = named.unionByName(found).unionByName(_by_length(common.withColumnRenamed("body", "part"), customers))
    if "long pattern" in of:
        found, common = _by_rarest(of["long pattern"], customers, index, _hit())
        cut = common.select("q", "sid", F.left("body", F.lit(GRAM - 1)).alias("part"))
        named = named.unionByName(found).unionByName(_by_short_part(cut, customers))
    if "pattern" in of:
        named = named.unionByName(_by_short_part(of["pattern"].withColumnRenamed("body", "part"), customers))
    if "wildcards" in of:
        named = named.unionByName(_by_wildcards(of["wildcards"], customers))
    by_name = named.select("q", F.lit("customer").alias("mode"), "customer_id")
    return (
        by_id.unionByName(by_alert, allowMissingColumns=True)
        .unionByName(by_name, allowMissingColumns=True)
        .select("q", "mode", "customer_id", "txn_id", "rule_name")
    )
