"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability of being toxic is logistic in the weights of its words; a word counts by itself and by
its first 4 and 5 letters, so that inflected forms share what is learned. A document is toxic unless all of its
sentences are not: the noisy-or ``1 - product(1 - p)`` of its sentences. Training maximises the likelihood of the
document labels alone, which moves the blame to the sentences that set toxic documents apart. At scoring time
the sentences above ``OFFENDING`` are located in the text.

Learning uses at most ``train_docs`` whole documents of each label, those with the smallest hash of their id: a
documented bound. It happens on the driver, on a sample whose size does not depend on the data; scoring reads
every whole text in the tasks. Since toxic documents are rarer than the sample makes them, the sample's rows are
weighted back to the shares of all labelled rows.

Defined cases: a null or empty text has no sentence and score 0, and so has every text if one of the labels
was never seen. Rows with a null label or text teach nothing; rows that repeat an id are scored like any other.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewarden.llm.common import id_residue, slices

TRAIN_DOCS = 1500
MIN_DOCS = 5
#: ``SUPPORT``: a feature keeps a weight only if it explains about as many documents.
STEPS, RATE, SUPPORT = 150, 0.3, 0.8
OFFENDING = 0.5
#: Words whose scores a task keeps at most; a full table is emptied.
TABLE_WORDS = 1_000_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> tuple[str, ...]:
    return (f"={word}", *(f"{k}{word[:k]}" for k in (4, 5) if len(word) >= k))


@dataclass
class SentenceModel:
    """Log-odds of a sentence without words, and what each feature adds."""

    bias: float
    weights: dict[str, float]


class WordScores(dict):
    """The weight of each word met, computed once per task."""

    def __init__(self, model: SentenceModel):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) > TABLE_WORDS:
            self.clear()
        self[word] = score = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return score


def fit(labelled: list[tuple[str, int, float]], steps: int = STEPS) -> SentenceModel:
    """Maximum likelihood of the noisy-or over (text, label, weight of the row) by adaptive gradient steps."""
    if len({label for _, label, _ in labelled}) < 2:
        return SentenceModel(-np.inf, {})
    seen: Counter = Counter()
    for text, _, _ in labelled:
        seen.update({f for w in set(_WORD.findall(text.lower())) for f in features_of(w)})
    names = sorted(f for f, n in seen.items() if n >= MIN_DOCS)
    at = {f: i for i, f in enumerate(names)}
    del seen
    columns, sizes, own = array("i"), array("i"), array("i")
    for text, _, _ in labelled:
        found = _SENTENCE.findall(text.lower())
        own.append(len(found))
        for sentence in found:
            before = len(columns)
            for w in _WORD.findall(sentence):
                columns.extend([at[f] for f in features_of(w) if f in at])
            sizes.append(len(columns) - before)
    column, row = np.array(columns, np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    document = np.repeat(np.arange(len(own)), own)
    label = np.array([x[1] for x in labelled], bool)
    share = np.array([x[2] for x in labelled])
    share = share / share.mean()
    weights, bias = np.zeros(len(names)), -6.0
    moved, moved_bias = np.full(len(names), 1e-8), 1e-8
    for _ in range(steps):
        z = bias + np.bincount(row, weights[column], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), len(label))
        some = np.maximum(-np.expm1(none), 1e-9)
        pull = np.where(label, (1 - some) / some, -1.0) * share / len(label)
        by_sentence = p * pull[document]
        step = np.bincount(column, by_sentence[row], len(names))
        moved += step**2
        moved_bias += by_sentence.sum() ** 2
        rate = RATE / np.sqrt(moved)
        weights += rate * step
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * SUPPORT / len(label), 0)
        bias += RATE * by_sentence.sum() / np.sqrt(moved_bias)
    return SentenceModel(float(bias), {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3})


def sample(marks: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (doc_id, toxic, weight) of each label, by hash of the id.

    The labels' row counts thin the table by hash first, so that ranking meets a bounded number of rows; ``weight``
    is the number of labelled rows that a sampled row stands for.
    """
    drawn = marks.select("doc_id", "toxic", F.xxhash64(F.lit("sample"), "doc_id").alias("draw"))
    counts = drawn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    thinned = drawn.join(F.broadcast(counts), "toxic").where(F.col("draw") / F.lit(2.0**64) + 0.5 <= 2.0 * per_label / F.col("n"))
    ranked = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "doc_id")))
    return ranked.where(F.col("rank") <= per_label).select("doc_id", "toxic", (F.col("n") / F.least("n", F.lit(per_label))).alias("weight"))


def learn(docs: DataFrame, labels: DataFrame, keep: Column, train_docs: int = TRAIN_DOCS) -> SentenceModel:
    """A model from a bounded sample of the labelled documents for which ``keep`` (over ``doc_id``) holds."""
    marks = labels.where(keep & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most train_docs ids per label are broadcast; the documents are not shuffled.
    labelled = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample(marks, train_docs)), "doc_id")
    return fit(sorted((r["text"], r["toxic"], r["weight"]) for r in labelled.select("text", "toxic", "weight").collect()))


def score(docs: DataFrame, model: SentenceModel, text: str = "text") -> DataFrame:
    """Add ``score`` and ``offending``, the (start, end, p) of toxic sentences in characters."""
    if {"score", "offending"} & set(docs.columns):
        raise ValueError("a column score or offending exists already")
    # Plain values: a broadcast is unpickled before the task's code, which brings the classes, has arrived.
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    at = docs.columns.index(text)
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")] + [T.StructField("p", T.DoubleType())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))]
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SentenceModel(*shared.value)
        bias, scores = model.bias, WordScores(model)
        get, floor = scores.__getitem__, math.exp(max(bias, -50.0))
        for batch in slices(batches, at):
            totals, found = [], []
            for body in batch.column(at).to_pylist():
                none, spans = 0.0, []
                if body and bias > -np.inf:
                    lower = body.lower()
                    # A few characters change their length with their case; places are then taken in lower case.
                    for m in _SENTENCE.finditer(lower):
                        z = sum(map(get, _WORD.findall(m[0])))
                        odds = floor * math.exp(min(z, 60.0)) if z else floor
                        none -= math.log1p(odds)
                        if odds >= OFFENDING / (1 - OFFENDING):
                            spans.append({"start": m.start(), "end": m.end(), "p": odds / (1 + odds)})
                totals.append(-math.expm1(none))
                found.append(spans)
            columns = [pa.array(totals, pa.float64()), pa.array(found, arrow_span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "offending"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels whose id residue modulo 5 is not 0, score all documents."""
    residue = id_residue("doc_id", 5)
    model = learn(docs, labels, residue != 0)
    found = score(docs.select("doc_id", (residue == 0).alias("held_out"), "text"), model)
    return found.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending")
    )
