"""Language identification by prediction by partial matching (PPM).

For each language, byte contexts of up to ``ORDER`` bytes with counts of the bytes that followed them form a
context tree. Under the frozen counts a context seen ``n`` times with ``d`` different next bytes gives a seen
byte ``c / (n + d)`` and escapes with ``d / (n + d)`` to the context one byte shorter, where the bytes already
ruled out are excluded; below the empty context all bytes are alike. So every context has an exact
distribution, and a text's code length is the sum of ``-log2 p`` over all of its bytes. The language with the
shortest code is the prediction; the score is its share among ``2 ** -bits`` of all languages.

Learning uses at most ``train_docs`` whole documents of a language, those with the smallest hash of their id:
a documented bound on the sample of labelled rows. Contexts seen fewer than ``min_seen`` times in a language
are left out of its tree (it is variable-order), and at most ``MAX_NODES`` contexts of all trees are kept, the
most frequent first. The tables broadcast to the tasks hold 512 bytes per context and language, whatever the
size of the data.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if nothing
could be learned. Ties go to the language that sorts first. Learning skips rows with a null text or language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewarden.llm.common import id_residue, slices, text_bytes

ORDER = 3
TRAIN_DOCS = 500
MIN_SEEN = 8
#: Rows of the table of code lengths, and languages it has columns for; see ``context_budget``.
MAX_NODES, MOST_LANGUAGES = 65_535, 32
UNKNOWN = "und"
#: Text bytes scored at a time; bounds a worker's memory whatever a text's length, and changes no result.
PIECE_BYTES = 1 << 18
#: Every text is read as if these bytes stood before it, so that its first bytes have a context too.
LEAD = b"\n" * ORDER


@dataclass
class ContextTrees:
    """Frozen code lengths: ``bits[node * 256 + byte, language]``, nodes in the order of ``contexts``."""

    languages: list[str]
    contexts: list[bytes]
    bits: np.ndarray

    def node_of(self) -> np.ndarray:
        """The node of the longest kept context for each value of the last ORDER bytes."""
        where = np.zeros(256**ORDER, np.uint16)
        for node in sorted(range(len(self.contexts)), key=lambda k: len(self.contexts[k])):
            context = self.contexts[node]
            # The first byte of a context is the oldest; all values that end in it lie one stride apart.
            where[int.from_bytes(context, "big") :: 256 ** len(context)] = node
        return where


def sample(docs: DataFrame, keep: Column, per_language: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """At most ``per_language`` labelled documents of each language, those with the smallest id hashes.

    The languages' row counts thin each language by hash first, so that ranking meets a bounded number of rows.
    """
    labelled = docs.where(keep & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("sample"), doc_id).alias("draw")
    )
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    position = F.col("draw") / F.lit(2.0**64) + 0.5
    # One row per language.
    thinned = labelled.join(F.broadcast(counts), "lang").where(position <= 2.0 * per_language / F.col("n"))
    first = Window.partitionBy("lang").orderBy("draw", "text")
    ranked = thinned.withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= per_language).select("lang", "text")


def gram_counts(rows: DataFrame, order: int = ORDER, min_seen: int = MIN_SEEN) -> DataFrame:
    """(lang, context, bytes, counts): what followed each context of up to ``order`` bytes, counted in parallel.

    Contexts seen fewer than ``min_seen`` times are left out, except the empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stream = LEAD[:order] + text
                own = counts.setdefault(lang, Counter())
                for size in range(order + 1):
                    own.update(stream[i - size : i + 1] for i in range(order, len(stream)))
        flat = [(lang, gram[:-1], gram[-1], n) for lang, own in counts.items() for gram, n in own.items()]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat, strict=True)], ["lang", "context", "byte", "n"])

    plain = rows.select("lang", text_bytes("text").alias("text"))
    grams = plain.mapInArrow(run, "lang string, context binary, byte bigint, n bigint")
    grams = grams.groupBy("lang", "context", "byte").agg(F.sum("n").alias("n"))
    nodes = grams.groupBy("lang", "context").agg(F.collect_list("byte").alias("bytes"), F.collect_list("n").alias("counts"), F.sum("n").alias("n"))
    return nodes.where((F.col("n") >= min_seen) | (F.length("context") == 0)).drop("n")


def context_budget(languages: int) -> int:
    """Contexts that each language may keep for itself, so that none is crowded out by the others.

    The table of code lengths has a row per context and a column per language; its size stays the same beyond four
    languages.
    """
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages to learn; at most {MOST_LANGUAGES} are supported")
    return MAX_NODES // max(languages, 4) * 4 // max(languages, 4)


def grow_trees(nodes: list[tuple[str, bytes, list[int], list[int]]], order: int = ORDER) -> ContextTrees:
    """Context trees of all languages over one list of contexts, from (lang, context, bytes, counts)."""
    languages = sorted({node[0] for node in nodes})
    if not languages:
        return ContextTrees([], [b""], np.empty((256, 0), np.float16))
    seen: dict[str, dict[bytes, tuple[list[int], list[int]]]] = {lang: {} for lang in languages}
    for lang, context, follow, counts in nodes:
        seen[lang][context] = (follow, counts)
    # Contexts are at least as frequent as the longer ones that end in them, so parents are kept first.
    kept: set[bytes] = {b""}
    for own in seen.values():
        kept.update(sorted(own, key=lambda c: (-sum(own[c][1]), len(c), c))[: context_budget(len(languages))])
    closed = kept | {c[i:] for c in kept for i in range(len(c))}
    contexts = sorted(closed, key=lambda c: (len(c), c))[:MAX_NODES]
    at = {c: i for i, c in enumerate(contexts)}
    bits = np.empty((len(contexts), 256, len(languages)), np.float16)
    for j, lang in enumerate(languages):
        p = np.full((len(contexts), 256), 1 / 256, np.float32)
        for size in range(order + 1):
            nodes_of = [i for i, c in enumerate(contexts) if len(c) == size]
            for start in range(0, len(nodes_of), 4096):
                part = nodes_of[start : start + 4096]
                lower = p[[at[contexts[i][1:]] for i in part]] if size else p[part]
                c = np.zeros((len(part), 256))
                for row, i in enumerate(part):
                    if contexts[i] in seen[lang]:
                        follow, counts = seen[lang][contexts[i]]
                        c[row, follow] = counts
                n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                rest = np.where(c > 0, 0.0, lower)
                left = rest.sum(axis=1, keepdims=True)
                escape = np.divide(d, n + d, out=np.ones_like(left), where=n > 0) * (left > 0)
                ruled = c / np.maximum(n + d * (left > 0), 1)
                p[part] = ruled + escape * np.divide(rest, left, out=np.zeros_like(rest), where=left > 0)
        bits[:, :, j] = -np.log2(p)
    return ContextTrees(languages, contexts, bits.reshape(-1, len(languages)))


def learn(
    docs: DataFrame, keep: Column, train_docs: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> ContextTrees:
    """Trees from a bounded sample of the labelled documents for which ``keep`` holds."""
    rows = gram_counts(sample(docs, keep, train_docs, doc_id, text, lang)).toLocalIterator()
    return grow_trees([(r["lang"], bytes(r["context"]), r["bytes"], r["counts"]) for r in rows])


def _piece_lengths(trees: ContextTrees, node_of: np.ndarray, leads: list[bytes], pieces: list[bytes]) -> np.ndarray:
    """Bits of each piece of text after its ORDER lead bytes, under each language; no piece is empty."""
    sizes = np.array([len(p) for p in pieces])
    stream = np.frombuffer(b"".join(x for pair in zip(leads, pieces, strict=True) for x in pair), np.uint8)
    code = np.zeros(len(stream) - ORDER, np.uint32)
    for k in range(ORDER):
        code = (code << np.uint32(8)) | stream[k : k + len(code)]
    starts = np.cumsum([0, *(sizes[:-1] + ORDER)])
    own = np.ones(len(code), bool)
    for k in range(ORDER):
        own[(starts + sizes + k)[:-1]] = False
    row = node_of[code[own]].astype(np.int64) * 256 + stream[ORDER:][own]
    edges = np.cumsum([0, *sizes[:-1]])
    return np.add.reduceat(trees.bits[row].astype(np.float32), edges, axis=0, dtype=np.float64)


def code_lengths(trees: ContextTrees, node_of: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text under each language, summed over pieces of at most PIECE_BYTES."""
    out = np.zeros((len(texts), len(trees.languages)))
    at: list[int] = []
    leads: list[bytes] = []
    pieces: list[bytes] = []
    held = 0

    def add() -> None:
        nonlocal held
        if pieces:
            np.add.at(out, at, _piece_lengths(trees, node_of, leads, pieces))
        for part in (at, leads, pieces):
            part.clear()
        held = 0

    for i, text in enumerate(texts):
        for start in range(0, len(text), PIECE_BYTES):
            piece = text[start : start + PIECE_BYTES]
            if held + len(piece) > PIECE_BYTES:
                add()
            at.append(i)
            leads.append(text[start - ORDER : start] if start else LEAD)
            pieces.append(piece)
            held += len(piece)
    add()
    return out


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` for each whole text; other columns pass through."""
    if {"lang_pred", "score"} & set(docs.columns):
        raise ValueError("a column lang_pred or score exists already")
    # Plain values: a broadcast is unpickled before the task's code, which brings the classes, has arrived.
    shared = docs.sparkSession.sparkContext.broadcast((trees.languages, trees.contexts, trees.bits))
    at = docs.columns.index(text)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = ContextTrees(*shared.value)
        names, node_of = np.array([*trees.languages, UNKNOWN], object), trees.node_of()
        for batch in slices(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if trees.languages and next((1 for ch in t if ch.isalpha()), 0)]
            if known:
                bits = code_lengths(trees, node_of, [texts[i].encode() for i in known])
                best[known] = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                score[known] = 1 / np.exp2(-gap).sum(axis=1)
            columns = [pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose id residue modulo 3 is not 1, predict all."""
    residue = id_residue("doc_id", 3)
    trees = learn(docs, residue != 1)
    found = predict(docs.select("doc_id", (residue == 1).alias("held_out"), "text"), trees)
    return found.select("doc_id", "held_out", "lang_pred", "score")
