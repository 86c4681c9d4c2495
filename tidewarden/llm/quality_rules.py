"""Quality rules under weak supervision, in DataFrame functions only.

Each rule looks at one property of a text and votes keep (1), reject (-1) or abstains (0). No rule decides
alone: with the true quality unknown, expectation-maximisation estimates the share of good texts and, for both
kinds of text, how often each rule votes keep or reject or abstains. The posterior probability of good quality then
replaces the demand that a text pass all rules. A text is kept at ``KEEP_AT`` or more.

The rules see each text once, in one scan. Estimation works on the counts of all documents by pattern of votes,
at most 3 ** rules rows whatever the size of the corpus, and the posterior of a row is a sum of literals.

Defined cases: a null or empty text has no words, gets abstentions only and fails the base test. Word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import WORD_GAP, stored

KEEP_AT = 0.5
ROUNDS = 100
#: Shares of the votes among good and among bad texts that estimation starts from, and their weight in texts.
START = {1: (0.6, 0.1), 0: (0.35, 0.5), -1: (0.05, 0.4)}
START_WEIGHT = 2.0
PRIOR = (0.05, 0.98)
#: Fixed by the result contract.
SYMBOLS = r"[#*$%&|<>]"
GAP_CHARACTERS = " \t\n\x0b\f\r"
WINDOW, LEAST_WORDS = 3, 50


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each whole text, one row per row of ``docs``."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    inner = F.btrim("text", F.lit(GAP_CHARACTERS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP, -1))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(GAP_CHARACTERS)) != "")
    split = plain.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    n = F.size("words")
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    )
    counted = split.select(
        "doc_id",
        "n_symbols",
        "n_upper",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, windows).alias("windows"),
    )
    # Only texts in which a window repeats are sorted.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = counted.withColumn(
        "ordered",
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    again = F.filter(
        "ordered",
        lambda w, k: ((k > 0) & (F.get("ordered", k - 1)["h"] == w["h"])) | F.coalesce(F.get("ordered", k + 1)["h"] == w["h"], F.lit(False)),
    )
    placed = ordered.withColumn("places", F.sort_array(F.transform(again, lambda w: w["i"])))
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get("places", k + 1) - p), F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "ordered", "places")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def _vote(keep: Column | None = None, reject: Column | None = None) -> Column:
    vote = F.lit(0)
    if keep is not None:
        vote = F.when(keep, F.lit(1)).otherwise(vote)
    if reject is not None:
        vote = F.when(reject, F.lit(-1)).otherwise(vote)
    return vote.cast("int")


def votes() -> dict[str, Column]:
    """The rules over the columns of ``features``.

    A defect shows in one property and leaves the others sound, so a rule about one property rejects or
    abstains; the rules that vote keep look at several properties at a time.
    """
    symbols, upper = _share("n_symbols", "n_words"), _share("n_upper", "word_chars")
    repeats, lines, length = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines"), _share("word_chars", "n_words")
    plain = (symbols <= 0.1) & (upper <= 0.2)
    return {
        "symbols": _vote(reject=symbols > 0.2),
        "capitals": _vote(reject=upper > 0.35),
        "repeated_words": _vote(reject=repeats > 0.3),
        "repeated_lines": _vote(reject=lines > 0.5),
        "word_length": _vote(reject=(length < 2) | (length > 14)),
        "prose": _vote(keep=plain & length.between(3, 10)),
        "varied": _vote(keep=plain & (repeats <= 0.3) & (lines <= 0.5)),
    }


@dataclass
class VoteModel:
    """``prior``: share of good texts; ``share[rule][vote] = (among good, among bad)``, abstaining included."""

    prior: float
    share: dict[str, dict[int, tuple[float, float]]]

    def weight(self, rule: str, vote: int) -> float:
        good, bad = self.share[rule][vote]
        return math.log(good / bad)

    def start(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior_of(self, pattern: dict[str, int]) -> float:
        return 1 / (1 + math.exp(-self.start() - sum(self.weight(r, v) for r, v in pattern.items())))

    def posterior(self) -> Column:
        total = F.lit(self.start())
        for rule in self.share:
            vote = F.col(f"vote_{rule}")
            total = total + F.when(vote == 1, self.weight(rule, 1)).when(vote == -1, self.weight(rule, -1)).otherwise(self.weight(rule, 0))
        return 1 / (1 + F.exp(-total))


def estimate(patterns: list[tuple[dict[str, int], int]], rules: list[str], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over the counts of vote patterns.

    The start says only that good texts draw keep votes and bad ones reject votes. It also weighs in as
    ``START_WEIGHT`` texts of either kind, so that votes never seen keep a finite weight; without any text it
    is the result.
    """
    model = VoteModel(0.8, {r: dict(START) for r in rules})
    for _ in range(rounds):
        good_sum, total = 0.8 * START_WEIGHT, START_WEIGHT
        seen = {r: {v: [x * START_WEIGHT for x in START[v]] for v in START} for r in rules}
        for pattern, count in patterns:
            good = count * model.posterior_of(pattern)
            good_sum, total = good_sum + good, total + count
            for rule, vote in pattern.items():
                seen[rule][vote][0] += good
                seen[rule][vote][1] += count - good
        share = {}
        for rule, own in seen.items():
            sums = [sum(x[k] for x in own.values()) for k in (0, 1)]
            share[rule] = {v: (x[0] / sums[0], x[1] / sums[1]) for v, x in own.items()}
        model = VoteModel(min(max(good_sum / total, PRIOR[0]), PRIOR[1]), share)
    return model


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The features with each rule's vote and the posterior ``quality``."""
    rules = votes()
    voted = stored(features(docs, doc_id, text), "quality").withColumns({f"vote_{r}": v for r, v in rules.items()})
    columns = [f"vote_{r}" for r in rules]
    counts = voted.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()
    model = estimate([({r: row[f"vote_{r}"] for r in rules}, row["n"]) for row in counts], list(rules))
    return voted.withColumn("quality", model.posterior())


def verdicts(docs: DataFrame) -> DataFrame:
    """The base counts, the base test and whether the text is kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = judged(docs).withColumn("base_failed", failed)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).alias("kept"), "quality",
    )
