"""Token counts of documents in flat token files, by a scan for separators.

A token file is one sequence of ids without an index: documents follow each other, each closed by the
end-of-document id. Files are held as rows (file, block, payload): the payload is a run of little-endian ids
cut at a fixed size, wherever a document happens to end.

1. Each block is searched for separators alone, as one vector operation; only their positions leave the task.
2. A prefix scan over the blocks' sums gives every block the tokens and separators before it and the place of
   the last separator before it, which closes the document that began in an earlier block. The scan runs within
   groups of ``GROUP`` blocks and then over the groups, so that a file of any size is never one task's work.
3. A document's length is the distance of its separator from the one before.

Defined cases: two separators in a row enclose a document of no tokens; tokens after the last separator are a
document with ``closed`` false; an empty or null payload holds no token, and a file without tokens gives no row.
Block numbers order a file and need not be without gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm import sentence_pieces
from tidewarden.llm.common import slices, stored

BLOCK_TOKENS = 1 << 19
GROUP = 1024


def id_type(vocabulary: int) -> str:
    """The smallest id type of token files that holds the vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _blocks(parts: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], kind: str, block_tokens: int) -> Iterator[pa.RecordBatch]:
    """One task's file from parts (document ids, edges between the documents, ids of all)."""
    file = TaskContext.get().partitionId()
    held = np.empty(0, kind)
    block = ended = 0
    # Documents whose last token is not yet written, with the tokens still to come before their end.
    waiting: list[tuple[int | None, int]] = []

    def row(tokens: np.ndarray) -> pa.RecordBatch:
        nonlocal waiting, ended, block
        done = [d for d, end in waiting if end <= len(tokens)]
        waiting = [(d, end - len(tokens)) for d, end in waiting if end > len(tokens)]
        columns = [
            pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([tokens.tobytes()], pa.binary()),
            pa.array([ended], pa.int64()), pa.array([done], pa.list_(pa.int64())),
        ]
        ended, block = ended + len(done), block + 1
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "payload", "first_document", "doc_ids"])

    for ids, edges, values in parts:
        waiting += list(zip(ids, (len(held) + edges[1:]).tolist(), strict=True))
        held = np.concatenate([held, values.astype(kind)])
        while len(held) >= block_tokens:
            yield row(held[:block_tokens])
            held = held[block_tokens:]
    if len(held):
        yield row(held)


_BLOCK = "file int, block int, payload binary, first_document bigint, doc_ids array<bigint>"


def write_blocks(encoded: DataFrame, kind: str, block_tokens: int = BLOCK_TOKENS, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Flat files of documents whose ids end with the separator: one file per task.

    ``first_document`` and ``doc_ids`` say which documents end in a block; the scan does not look at them.
    """
    plain = encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                lists = batch.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                yield batch.column(0).to_pylist(), np.concatenate([[0], np.cumsum(sizes)]), values

        return _blocks(parts(), kind, block_tokens)

    return plain.mapInArrow(run, _BLOCK)


def write_text_blocks(docs: DataFrame, model: bytes, kind: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The files of ``write_blocks`` from (doc_id, text): encoded and cut in one worker, so no id list leaves it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tabled = sentence_pieces.words_are_separate(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sentence_pieces.WordTable(shared.value, texts=False)

        def parts():
            for batch in slices(batches, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                yield batch.column(0).to_pylist(), *sentence_pieces.id_lists(table, texts, tabled, True)

        return _blocks(parts(), kind, block_tokens)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def scan_blocks(blocks: DataFrame, separator: int, kind: str) -> DataFrame:
    """(file, block, tokens, ends): the tokens of each block and the positions of its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column(2)[i].as_py() or b"", kind)
                ends = pa.array([np.flatnonzero(tokens == separator)], pa.list_(pa.int64()))
                columns = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(tokens)], pa.int64()), ends]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "tokens", "ends"])

    return blocks.select(F.col("file").cast("int"), F.col("block").cast("int"), "payload").mapInArrow(
        run, "file int, block int, tokens bigint, ends array<bigint>"
    )


def _before(*partition: str):
    order = "block" if "group" in partition else "group"
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, document, n_tokens, closed): the documents of all files, numbered from 0 in each file."""
    inner = _before("file", "group")
    sums = scanned.withColumn("group", F.floor(F.col("block") / GROUP))
    sums = sums.withColumn("tokens_before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    sums = sums.withColumn("ends_before", F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0)))
    sums = sums.withColumn("last_end", F.col("tokens_before") + F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1))
    sums = sums.withColumn("end_before", F.max("last_end").over(inner))

    outer = _before("file")
    groups = sums.groupBy("file", "group").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.size("ends")).alias("ends"), F.max("last_end").alias("last_end")
    )
    groups = groups.withColumn("group_start", F.coalesce(F.sum("tokens").over(outer), F.lit(0)))
    groups = groups.withColumn("group_ends", F.coalesce(F.sum("ends").over(outer), F.lit(0)))
    groups = groups.withColumn("group_last", F.col("group_start") + F.col("last_end"))
    groups = groups.withColumn("group_end_before", F.coalesce(F.max("group_last").over(outer), F.lit(-1)))

    placed = sums.join(groups.select("file", "group", "group_start", "group_ends", "group_end_before"), ["file", "group"])
    placed = placed.select(
        "file", "ends",
        (F.col("group_start") + F.col("tokens_before")).alias("start"),
        (F.col("group_ends") + F.col("ends_before")).alias("first"),
        F.coalesce(F.col("group_start") + F.col("end_before"), "group_end_before").alias("open_since"),
    )
    each = placed.select("*", F.posexplode_outer("ends").alias("i", "end")).where("i is not null")
    since = F.when(F.col("i") == 0, F.col("open_since")).otherwise(F.col("start") + F.get("ends", F.col("i") - 1))
    closed = each.select(
        "file", (F.col("first") + F.col("i")).alias("document"), (F.col("start") + F.col("end") - since - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    tails = groups.groupBy("file").agg(
        F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends"), F.coalesce(F.max("group_last"), F.lit(-1)).alias("last")
    )
    left = F.col("tokens") - F.col("last") - 1
    tail = tails.where(left > 0).select("file", F.col("ends").alias("document"), left.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(tail)


def count_tokens(blocks: DataFrame, separator: int, kind: str) -> DataFrame:
    """Token counts, without the separator, of all documents of the files."""
    return stitch(scan_blocks(blocks, separator, kind))


def document_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """Write all documents as flat token files, count by scanning them, and name the documents again."""
    pieces = sentence_pieces.sentencepiece.SentencePieceProcessor(model_proto=model)
    kind = id_type(pieces.get_piece_size())
    files = stored(write_text_blocks(docs, model, kind), "tokens")
    counts = count_tokens(files, pieces.eos_id(), kind)
    named = files.select("file", "first_document", F.posexplode_outer("doc_ids").alias("i", "doc_id")).where("i is not null")
    named = named.select("file", (F.col("first_document") + F.col("i")).alias("document"), "doc_id")
    return named.join(counts, ["file", "document"]).select("doc_id", "n_tokens", "file", "document")
