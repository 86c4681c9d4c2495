"""URL filter: written rules first, then gradient-boosted trees on lexical features.

A rule is a host and the start of a path. It fits its host and all subdomains where the url's path starts with the
rule's, and of all that fit the longest decides. What no rule decides, the trees decide from the url alone: lengths,
depth, digit and symbol ratios, entropies, parameter count, and statistics of the host's suffix.

Suffix statistics cover all urls: per last host label the number of urls and hosts, and the share of its hosts that
are labelled bad, drawn towards the share of all hosts by ``PRIOR_HOSTS`` hosts. A suffix with a third of all urls is
combined in the tasks first, and the join back is left to Spark, which broadcasts the table only at a measured size.
The trees are trained by Spark on labelled urls, at most ``TRAIN_URLS`` of each label, drawn by hash.

The tables carry no label of urls, so ``labelled_by_words`` labels them from words of listed sites, as public host
lists do: a url is bad if a word of its host is listed. The words are not features; the trees must tell such hosts by
their form, so hosts of unlisted words are found as well. Rules are no labels: they state a policy on whole domains, and
trees trained on them would only learn the domain.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and all lengths zero. Repeated
rows are judged each. With fewer than ``LEAST`` urls of a label nothing is trained, and what no rule blocks is allowed;
an empty table gives no row. Other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import stored

ALLOW, BLOCK = "allow", "block"
#: Fixed by the result contract: (rule, verdict).
RULES = (("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW))
#: Rules are part of the plan; a longer list belongs into a table of its own.
MOST_RULES = 256
#: Words of hosts that public lists hold under adult, gambling, pharmacy, spam and advertising.
BAD_WORDS = ("adult", "porn", "xxx", "casino", "bets", "poker", "pills", "viagra", "spam", "ads", "track")

TRAIN_URLS, LEAST = 20_000, 10
PRIOR_HOSTS = 5.0
TREES, DEPTH, STEP, SEED = 20, 4, 0.3, 7

FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "host_labels", "longest_label", "depth",
    "digit_ratio", "symbol_ratio", "host_entropy", "path_entropy", "n_params", "suffix_urls", "suffix_hosts", "suffix_bad",
]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


@dataclass(frozen=True)
class Rule:
    """``host/path`` as written, and what it decides."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.text.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


def _url(url: str) -> Column:
    return F.coalesce(F.col(url), F.lit(""))


def host(url: str = "url") -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_url(url), _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)


def path(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_url(url), _PARTS, 2)


def query(url: str = "url") -> Column:
    """Between the path's ``?`` and ``#`` or the end."""
    return F.regexp_extract(_url(url), _PARTS, 3)


def fitting_rule(rules: Iterable[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    longest = sorted((Rule(*r) for r in rules), key=lambda r: (-len(r.text), r.text))
    if len(longest) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    choose = lambda value: F.coalesce(F.lit(None).cast("string"), *(F.when(r.fits(host, path), F.lit(value(r))) for r in longest))
    return choose(lambda r: r.text), choose(lambda r: r.verdict)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character distribution; 0 for the empty text."""
    size = F.length(text).cast("double")
    times = lambda c: F.greatest(size - F.length(F.replace(text, c, F.lit(""))), F.lit(1.0))
    spread = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda sum_, c: sum_ + times(c) * F.log2(times(c)))
    return F.when(size > 0, F.log2(size) - spread / size).otherwise(0.0)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, suffix and the features that need only the url itself."""
    parts = urls.withColumns({"host": host(url), "path": path(url), "_query": query(url), "_url": _url(url)})
    h, p, q, u = (F.col(c) for c in ("host", "path", "_query", "_url"))
    size = F.length(u).cast("double")
    labels = F.split(h, r"\.")
    return parts.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "url_length": size,
            "host_length": F.length(h).cast("double"),
            "path_length": F.length(p).cast("double"),
            "query_length": F.length(q).cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
            "depth": _count(p, r"/[^/]+"),
            "digit_ratio": _ratio(_count(u, "[0-9]"), size),
            "symbol_ratio": _ratio(_count(h, "[^a-z0-9.]"), F.length(h)),
            "host_entropy": entropy(h),
            "path_entropy": entropy(p),
            "n_params": _count(q, "[^&]+"),
        }
    ).drop("_query", "_url")


def labelled_by_words(words: Iterable[str] = BAD_WORDS, url: str = "url") -> Column:
    """1.0 if a word of the host, between dots and hyphens, is listed, else 0.0; null without a host."""
    listed = F.array(*(F.lit(w) for w in words))
    return F.when(host(url) != "", F.arrays_overlap(F.split(host(url), r"[.\-]"), listed).cast("double"))


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """(suffix, suffix_urls, suffix_hosts, suffix_bad) over all rows (host, suffix, label)."""
    hosts = urls.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("bad"))
    each = hosts.groupBy("suffix").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.count("bad").alias("labelled"), F.sum("bad").alias("bad")
    )
    whole = each.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0))).first()[0]
    return each.select(
        "suffix",
        F.log1p("n").alias("suffix_urls"),
        F.log1p("hosts").alias("suffix_hosts"),
        ((F.coalesce("bad", F.lit(0.0)) + PRIOR_HOSTS * whole) / (F.col("labelled") + PRIOR_HOSTS)).alias("suffix_bad"),
    )


def sample(rows: DataFrame, per_label: int = TRAIN_URLS) -> DataFrame:
    """At most ``per_label`` rows of each label, by hash of the url and its place among equal ones."""
    drawn = rows.where("label is not null").withColumn("_draw", F.xxhash64(F.lit("sample"), "host", "path", "_row"))
    sizes = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2 or min(sizes.values()) < LEAST:
        return rows.limit(0)
    share = F.coalesce(*(F.when(F.col("label") == v, F.lit(2.0 * per_label / n)) for v, n in sorted(sizes.items())))
    thinned = drawn.where(F.col("_draw") / F.lit(2.0**64) + 0.5 <= share)
    ranked = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy("label").orderBy("_draw", "_row")))
    return ranked.where(F.col("_rank") <= per_label).drop("_draw", "_rank")


def _vectors(rows: DataFrame) -> DataFrame:
    filled = rows.fillna(0.0, FEATURES)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled)


def fit(rows: DataFrame) -> GBTClassificationModel | None:
    """Trees from rows (label, features by name); None if there is nothing to train on."""
    train = stored(_vectors(rows).select("label", "features"), "url-train")
    if train.isEmpty():
        return None
    # A third of the features at each split, so that one sign of a few known hosts does not hide the others.
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, featureSubsetStrategy="onethird"
    )
    return trees.fit(train)


def scored(rows: DataFrame, model: GBTClassificationModel | None) -> DataFrame:
    """Add ``p_block``, the probability that the url is bad; 0 without a model."""
    if model is None:
        return rows.withColumn("p_block", F.lit(0.0))
    found = model.transform(_vectors(rows)).withColumn("p_block", vector_to_array("probability")[1])
    return found.drop("features", "rawPrediction", "probability", "prediction")


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, label: Column | None = None, per_label: int = TRAIN_URLS) -> DataFrame:
    """Every row of (page_id, url) with host, path, rule, verdict and ``p_block``.

    ``label`` over the columns of ``pages`` marks urls as bad (1.0), good (0.0) or unknown (null).
    """
    known = labelled_by_words() if label is None else label
    rows = lexical(pages.select("page_id", "url", known.cast("double").alias("label")))
    rows = rows.join(suffix_statistics(rows.select("host", "suffix", "label")), "suffix", "left")
    model = fit(sample(rows.withColumn("_row", F.col("page_id")), per_label))
    rule, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("p_block") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored(rows, model).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "p_block")
