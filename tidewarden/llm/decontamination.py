"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

For every benchmark item, all windows of the documents with as many words as the item are compared with it:

1. Windows that share too few five-word shingles with every item for the similarity asked for are never built.
   A document's shingle hashes meet the items' hashes; a window of ``a`` shingles can only reach similarity ``t``
   with an item of ``b`` shingles if ``t (a + b) / (1 + t)`` of its shingles occur in that item.
2. The windows left get a 64-bit SimHash over their shingles, and so do the items. The second and later occurrences of
   a shingle are hashed with their number, as shingles of their own: the weighted similarity is then the plain
   similarity of two sets, and no shingle moves a fingerprint by more than its one element.
3. A multi-index finds the items near each window: fingerprints within ``RADIUS`` bits differ in at most
   ``RADIUS // BLOCKS`` bits in one of ``BLOCKS`` blocks. Items are listed under all such values of all blocks,
   windows under their own values; the lists are joined by item size, block and value. This finds every pair
   within the radius. At similarity 0.8 two fingerprints of sets differ in 10 bits on average with a deviation of 3,
   however often a shingle repeats; the radius lies over four deviations above.
4. The exact similarity of the pairs' weighted shingles, the sum of the smaller weights over that of the larger
   ones, decides.

The items' shingles are broadcast only while there are at most ``BROADCAST_SHINGLES``; beyond, Spark shuffles.

Defined cases: texts are compared in lower case. Null and empty texts and items match nothing. An item shorter than
a shingle is one shingle of all its words; a document shorter than an item is one window. Rows that repeat a
doc_id and text count once; if a doc_id has several texts, it matches if one of them does. Ids are whole numbers; the
null id is one like others.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import WORD_GAP, free_name, stored

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BITS = 8, 8
RADIUS = 23
BROADCAST_SHINGLES = 1_000_000
#: Stands for a null id inside the joins, which null would not pass.
_NO_ID = -(2**63)
_GAP_CHARACTERS = " \t\n\x0b\f\r"


def _words(text: str) -> Column:
    inner = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_GAP_CHARACTERS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP, -1))


def _hashes(words: str, size: int) -> Column:
    """Hashes of all ``size`` consecutive words; null if there are fewer words."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])),
    )


def _simhash(grouped, shingle: str) -> DataFrame:
    """The fingerprint of each group of shingle hashes; a sum counts bits k and k + 32 in its two halves."""
    lanes = F.lit((1 << 32) + 1)
    half = BLOCKS * BITS // 2
    sums = grouped.agg(
        F.count(F.lit(1)).alias("many"),
        *[F.sum(F.shiftrightunsigned(shingle, k).bitwiseAND(lanes)).alias(f"sum{k}") for k in range(half)],
    )
    print_ = F.expr(
        f"aggregate(transform(array({', '.join(f'sum{k}' for k in range(half))}), (s, k) -> "
        f"if(2 * (s & 4294967295L) > many, shiftleft(1L, k), 0L) | "
        f"if(2 * shiftrightunsigned(s, 32) > many, shiftleft(1L, k + {half}), 0L)), 0L, (bits, x) -> bits | x)"
    )
    return sums.withColumn("print", print_).drop("many", *[f"sum{k}" for k in range(half)])


def _by_block(prints: DataFrame, flips: list[int]) -> DataFrame:
    """Each fingerprint under the values of its blocks, with each pattern of ``flips`` applied."""
    blocked = prints.select("*", F.explode_outer(F.lit(list(range(BLOCKS)))).alias("block"))
    flipped = blocked.select("*", F.explode_outer(F.lit(flips)).alias("flip"))
    own = F.expr(f"cast(shiftrightunsigned(print, block * {BITS}) & {(1 << BITS) - 1} as int)")
    return flipped.withColumn("value", own.bitwiseXOR(F.col("flip"))).drop("flip")


def _flips(most: int) -> list[int]:
    """All block patterns with at most ``most`` bits set."""
    return [sum(1 << k for k in bits) for n in range(most + 1) for bits in combinations(range(BITS), n)]


def _hashes_of(words: str, size: Column, sizes: list[int]) -> Column:
    """The hashes for the shingle size of the row, one of ``sizes``."""
    hashes = F.lit(None).cast("array<bigint>")
    for k in sizes:
        hashes = F.when(size == k, _hashes(words, k)).otherwise(hashes)
    return hashes


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """(item_id, n, k, b, h, weight): the weighted shingles of each item with a word, and the values of ``k``.

    ``n`` counts the item's words, ``k`` the words of a shingle and ``b`` the shingles.
    """
    words = items.select(F.col(item_id).alias("item_id"), _words(text).alias("words")).where(F.size("words") > 0)
    k = F.least(F.size("words"), F.lit(SHINGLE))
    sizes = sorted(row[0] for row in words.select(k).distinct().collect())
    shingled = words.select("item_id", F.size("words").alias("n"), k.alias("k"), _hashes_of("words", k, sizes).alias("hashes"))
    flat = shingled.select("item_id", "n", "k", F.size("hashes").alias("b"), F.explode_outer("hashes").alias("h"))
    return flat.groupBy("item_id", "n", "k", "b", "h").agg(F.count(F.lit(1)).alias("weight")), sizes


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    known = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID))
    return docs.select(known.alias("doc_id"), F.xxhash64(text).alias("body"), _words(text).alias("words"))


def _need(a: Column, b: Column) -> Column:
    """Least number of shared shingles for the similarity; a little is left for rounding."""
    return F.ceil(SIMILARITY * (a + b) / (1 + SIMILARITY) - 1e-9)


def candidate_windows(documents: DataFrame, shingles: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(doc_id, body, start, n, k, a): windows that share enough shingles with some item of their size."""
    targets = shingles.select("item_id", "n", "k", "b", "h")
    targets = F.broadcast(targets) if small else targets
    hits = None
    for k in sizes:
        hashed = documents.select("doc_id", "body", F.size("words").alias("length"), _hashes("words", k).alias("hashes"))
        # An outer explode, so that no filter on the array is pushed below it and computes it twice.
        at = hashed.select("doc_id", "body", "length", F.posexplode_outer("hashes").alias("at", "h"))
        own = at.join(targets.where(F.col("k") == k), "h").drop("h")
        hits = own if hits is None else hits.union(own)
    hits = hits.distinct()
    pair = ["doc_id", "body", "item_id"]
    a = F.least("n", "length") - F.col("k") + 1
    counted = hits.groupBy(*pair, "n", "k", "b", "length").agg(F.collect_list("at").alias("places"))
    able = counted.where(F.size("places") >= _need(a, F.col("b"))).withColumn("a", a)
    # A window with enough hits has its first hit near its start; each hit is taken as the first one.
    hit = able.select(*pair, "n", "k", "a", "b", "length", F.sort_array("places").alias("places"))
    first = hit.select("*", F.posexplode_outer("places").alias("rank", "at"))
    slack = F.col("a") - _need(F.col("a"), F.col("b"))
    before = F.when(F.col("rank") > 0, F.get("places", F.col("rank") - 1)).otherwise(F.lit(-1))
    low = F.greatest(F.col("at") - slack, before + 1)
    high = F.least(F.col("at"), F.greatest(F.lit(0), F.col("length") - F.col("n")))
    needed = F.get("places", (F.col("rank") + _need(F.col("a"), F.col("b")) - 1).cast("int"))
    low = F.greatest(low, needed - F.col("a") + 1)
    ranged = first.where(needed.isNotNull()).withColumns({"low": low.cast("int"), "high": high.cast("int")}).where("low <= high")
    starts = ranged.select("doc_id", "body", "n", "k", "a", F.explode_outer(F.sequence("low", "high")).alias("start"))
    return starts.distinct()


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): each document and item with the document's best window."""
    weighted_items, sizes = item_shingles(items)
    shingles = stored(weighted_items, "items")
    small = shingles.count() <= BROADCAST_SHINGLES
    documents = _documents(docs, doc_id, text)
    windows = candidate_windows(documents, shingles, sizes or [SHINGLE], small)
    per_document = windows.groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "n", "k", "a")).alias("windows"))
    per_document = stored(per_document, "starts")

    again = _documents(docs, doc_id, text).withColumnsRenamed({"doc_id": "id", "body": "digest"})
    match = (F.col("id") == F.col("doc_id")) & (F.col("digest") == F.col("body"))
    held = again.join(per_document, match).dropDuplicates(["doc_id", "body"]).select("doc_id", "body", "words", "windows")
    opened = held.select("doc_id", "body", "words", F.explode_outer("windows").alias("w")).select("doc_id", "body", "words", "w.*")
    cut = opened.withColumn("part", F.slice("words", F.col("start") + 1, F.col("a") + F.col("k") - 1)).drop("words")
    window = ["doc_id", "body", "start", "n"]
    hashed = cut.select(*window, _hashes_of("part", F.col("k"), sizes or [SHINGLE]).alias("hashes"))
    weighted = stored(
        hashed.select(*window, F.explode_outer("hashes").alias("h")).groupBy(*window, "h").agg(F.count(F.lit(1)).alias("w")), "windows"
    )

    window_prints = _simhash(weighted.select(*window, F.explode_outer(_occurrences("w")).alias("h")).groupBy(*window), "h")
    item_prints = _simhash(shingles.select("item_id", "n", F.explode_outer(_occurrences("weight")).alias("h")).groupBy("item_id", "n"), "h")
    listed = _by_block(item_prints, _flips(RADIUS // BLOCKS)).withColumnRenamed("print", "item_print")
    near = _by_block(window_prints, [0]).join(listed, ["n", "block", "value"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select(*window, "item_id").distinct()
    near = stored(near, "near")

    # Shared weight by pair, then the similarity from the two totals.
    totals = weighted.groupBy(*window).agg(F.sum("w").alias("a"))
    weights = near.join(_same(weighted, near, window), window).join(shingles.select("item_id", "b", "h", "weight"), ["item_id", "h"])
    shared = weights.groupBy(*window, "item_id", "b").agg(F.sum(F.least("w", "weight")).alias("both"))
    scored = shared.join(totals, window).withColumn("similarity", F.col("both") / (F.col("a") + F.col("b") - F.col("both")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best")
    found = scored.where(F.col("similarity") >= SIMILARITY).groupBy("doc_id", "item_id").agg(best)
    return found.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "item_id", (-F.col("best.back")).alias("start"), F.col("best.n").alias("n_words"), F.col("best.similarity").alias("similarity")
    )


def _occurrences(weight: str) -> Column:
    """One hash for each occurrence of a shingle ``h``; the first keeps the shingle's own."""
    numbers = F.sequence(F.lit(1), F.col(weight).cast("int"))
    return F.transform(numbers, lambda i: F.when(i == 1, F.col("h")).otherwise(F.xxhash64("h", i)))


def _same(weighted: DataFrame, near: DataFrame, window: list[str]) -> DataFrame:
    return weighted.join(near.select(*window).distinct(), window, "left_semi")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that match no item; those with a null id stay if no null id matched. Other columns may have any name."""
    name = free_name(docs.columns, "found")
    found = contaminated(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
