"""Periodic runs of words in whole texts, by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and 2q long, that no neighbouring word
extends with that period. A run leaves room for an aligned dyadic block of words, and its period is the distance from
that block to an equal one close behind it. The search therefore asks, for blocks of each dyadic size, where they
occur again within a few block lengths:

1. The texts of a slice are laid end to end, each with its own alphabet, so that equal blocks lie in one text. Prefix
   doubling sorts the suffixes; only groups that are still equal are sorted again. Its ranks after step k name the
   blocks of 2**k words, and a name is the start of the block's interval in the suffix array.
2. A wavelet matrix over the suffix array answers, for many intervals at once, how many suffixes of an interval lie
   below a position and which comes next: a range successor.
3. Blocks of b words look for periods from 2b - 1 to 4b - 2 (the smallest, of 4 words: from 1) in windows of b starts.
   Three or more occurrences in such a window form an arithmetic progression. If one stretch of the progression's
   difference covers block and occurrences, that difference is the only new period; else every member is a candidate.
4. A candidate period is extended to both sides by comparing block names from the longest to the shortest, and kept if
   the stretch is long enough. Equal stretches keep their smallest period.

A text of n words takes O(n log n) names, whatever it repeats; a slice holds about ``SLICE_BYTES`` of text or one longer
text, whose names take some 40 bytes a word for a million words.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text. Rows are judged one by one, so
repeated rows and ids give repeated results. An output name that is already taken is an error; other columns pass
through. Texts in which all words are equal are one run of period 1.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.llm.common import slices, text_bytes

LEAST = 12
#: The smallest block: two words apart, such blocks meet every run of LEAST words with a period below 15.
FIRST_BLOCK, FIRST_STEP = 4, 2

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


class SuffixNames:
    """Suffix array of a sequence, and names of all its blocks of 1, 2, 4, ... symbols.

    ``levels[k][i]`` is the first suffix-array slot of those suffixes that begin with the 2**k symbols at i. Levels
    end before the first at which all names differ; a block that passes the end equals no other.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        keys = codes[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        slots, at, size = np.arange(n), order, 1
        rank = np.empty(n, np.int32)
        self.levels: list[np.ndarray] = []
        while True:
            rank[at] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            slots = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
            if not len(slots):
                break
            self.levels.append(rank.copy())
            at = order[slots]
            after = at + size
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            keys = rank[at].astype(np.int64) * (n + 1) + second + 1
            by = np.argsort(keys, kind="stable")
            at, keys = at[by], keys[by]
            order[slots] = at
            new[slots] = np.concatenate([[True], keys[1:] != keys[:-1]])
            size *= 2
        self.order, self.size = order, n

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j > i on agree."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            inside = np.minimum(j, self.size - 1)
            same = (j < self.size) & (names[np.minimum(i, self.size - 1)] == names[inside])
            step = same.astype(np.int64) << k
            i, j, total = i + step, j + step, total + step
        return total

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i and before j > i agree."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            a, b = i - total - (1 << k), j - total - (1 << k)
            same = (a >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])
            total += same.astype(np.int64) << k
        return total


class WaveletMatrix:
    """Order statistics of ranges of a sequence of whole numbers; every call answers many ranges."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(int(top).bit_length(), 1)
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less than x, for x up to ``top``."""
        count = np.zeros(len(lo), np.int64)
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[lo], zeros[hi]
            one = (x >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of [lo, hi) that has k smaller ones; with ``k = below(x)`` the successor of x."""
        value, k = np.zeros(len(lo), np.int64), k.copy()
        for zeros, bit in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value


def _candidates(names: SuffixNames) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, period): all that the blocks' next occurrences suggest."""
    first = FIRST_BLOCK.bit_length() - 1
    if len(names.levels) <= first:
        return
    n = names.size
    sizes = np.bincount(names.levels[first], minlength=n)
    shared = sizes[names.levels[first][names.order]] > 1
    place = np.cumsum(shared) - shared
    tree = WaveletMatrix(names.order[shared], n)
    for k in range(first, len(names.levels)):
        block, rank = 1 << k, names.levels[k]
        if k > first:
            sizes = np.bincount(rank, minlength=n)
        starts = np.arange(0, n, FIRST_STEP if k == first else block)
        starts = starts[sizes[rank[starts]] > 1]
        low = place[rank[starts]]
        high = low + sizes[rank[starts]]
        for window in range(1, 4 * block - 1, block) if k == first else (2 * block - 1, 3 * block - 1):
            before = tree.below(low, high, np.minimum(starts + window, n))
            count = tree.below(low, high, np.minimum(starts + window + block, n)) - before
            some = np.flatnonzero(count)
            if not len(some):
                continue
            i, lo, hi, before, count = starts[some], low[some], high[some], before[some], count[some]
            one = tree.kth(lo, hi, before)
            more = np.flatnonzero(count > 1)
            step = np.zeros(len(i), np.int64)
            step[more] = tree.kth(lo[more], hi[more], before[more] + 1) - one[more]
            many = np.flatnonzero(count > 2)
            whole = i[many] + step[many] + names.right(i[many], i[many] + step[many]) >= one[many] + block
            covered = np.zeros(len(i), bool)
            covered[many] = whole
            # Within one stretch only its own period is new, and only the nearest occurrence shows it.
            use = ~covered | (one - i == step)
            count = np.where(covered, 1, count)[use]
            each = np.repeat(np.flatnonzero(use), count)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            yield i[each], one[each] + nth * step[each] - i[each]


def runs_of(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of codes, by start and period."""
    found = [np.empty((0, 3), np.int64)]
    if len(codes) >= least:
        names = SuffixNames(codes)
        for i, period in _candidates(names):
            start = i - names.left(i, i + period)
            length = i + period + names.right(i, i + period) - start
            good = length >= np.maximum(least, 2 * period)
            found.append(np.unique(np.stack([start[good], length[good], period[good]], axis=1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # Sorted by start, length, period: a multiple of the smallest period follows it on the same stretch.
    same = np.concatenate([[False], (runs[1:, :2] == runs[:-1, :2]).all(axis=1)]) if len(runs) else np.empty(0, bool)
    runs = runs[~same]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each list of words, found together."""
    edges = np.cumsum([0, *map(len, texts)])
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    own = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in texts]
    codes = np.concatenate([c + n * len(ids) for n, c in enumerate(own)]) if own else np.empty(0, np.int64)
    runs = runs_of(codes, least)
    cuts = np.searchsorted(runs[:, 0], edges)
    return [runs[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], edges[:-1], strict=True)]


def without_copies(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period) and ``collapsed``, the text with each run cut to one period.

    ``change`` may replace the words of a text before the search. The text itself is not returned.
    """
    kept = [c for c in docs.columns if c != text]
    if {"n_words", "runs", "collapsed", "_bytes", "_id"} & set(kept):
        raise ValueError("a column n_words, runs, collapsed, _bytes or _id exists already")
    plain = docs.select(*kept, F.col(doc_id).cast("bigint").alias("_id"), text_bytes(text).alias("_bytes"))
    at = len(kept) + 1
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = [t.split() for t in batch.column(at).to_pylist()]
            if change:
                texts = [change(i, words) for i, words in zip(batch.column(at - 1).to_pylist(), texts, strict=True)]
            found = runs_of_texts(texts, least)
            left = [b" ".join(without_copies(w, r)) for w, r in zip(texts, found, strict=True)]
            edges = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_ARROW_RUN.value_type))
            columns = [
                *batch.columns[: at - 1], pa.array(map(len, texts), pa.int64()),
                pa.ListArray.from_arrays(edges, spans), pa.array(left, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "runs", "collapsed"])

    return plain.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *fields]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Fixed by the result contract: one text in ten repeats a stretch of itself from some word on."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    # The stretch words[a : a + p] over and over, up to the old end.
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = find_runs(docs.select("doc_id", "text"), change=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.concat_ws("\n", lines), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.col3")
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
