"""Removal of repeated 20-word passages, found by recompression.

Words become 64-bit names. Three rounds of recompression then shorten the sequences: runs of one name are
named first and close the text around them like a border, after that every round splits the names by a hash
bit into left and right ones and gives each pair "left, right" a new name. A name is a hash of what it
stands for, so it is the same in all documents without a shared dictionary. Whether two neighbours are joined
depends on these two alone: equal passages get equal symbols but for at most 1 + 2 + 4 words at either end.
Symbols of the last round span 8 words at most, so every 20-word window has a symbol border, or a word of a run, 6
words or more from its ends, at the same place in each occurrence. The 12 words around such a place are its key.

1. Of texts that are equal as wholes only the first is searched: windows of the others all start earlier there.
2. Spark deals the keys out by hash; places whose key occurs twice or more are reported to their documents.
3. Windows around reported places are named by two hashes of all their 20 words and dealt out in the same way;
   the first occurrence stays, all others are reported. Windows without a reported place occur once.
4. Each document removes the words of its reported windows.

A task sends a key or window once per batch, however often it occurs there, so a passage that a third of all
documents share costs one entry per batch. Entries are packed: one Spark row holds what a batch sends to a
bucket. Keys travel shortened to 48 bits, as they only select places; a window counts as repeated only if both
of its hashes, 96 bits, are equal. The documents are shuffled once, by id; each step reads that shuffle again.

Defined cases: null and empty texts have no words; texts under 20 words lose nothing. Ids are integers; a null
id comes first. If a doc_id has several texts, they are documents of their own in the order of their texts;
rows that repeat a doc_id and text are one document, and all get its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewarden.llm.common import free_name, slices, text_bytes

WINDOW = 20
ROUNDS = 3
#: Words on either side of a place that make its key: (WINDOW - 2 ** ROUNDS) / 2.
REACH = (WINDOW - 2**ROUNDS) // 2

#: Text whose keys or windows meet in one bucket, which a worker holds at a time.
BUCKET_BYTES = 1 << 26

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _salted(salt: int) -> np.uint64:
    return np.uint64(int(_ODD) * salt & (2**64 - 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sequence_names(names: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A name for each ``size`` consecutive names, by where they start."""
    mult = np.uint64((2 * salt + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
    many = len(names) - size + 1
    if many <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(many, np.uint64)
    for k in range(size):
        out = out * mult + names[k : k + many]
    return _mix(out ^ _salted(salt + size))


def places(names: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Positions of symbol borders after all rounds, and of the words of runs.

    ``document`` numbers the words' documents; nothing is joined across two of them.
    """
    n = len(names)
    if not n:
        return np.empty(0, np.int64)
    same = (names[1:] == names[:-1]) & (document[1:] == document[:-1])
    in_run = np.r_[False, same] | np.r_[same, False]
    begin = np.flatnonzero(np.r_[True, ~same])
    length = np.diff(np.r_[begin, n])
    symbol = np.where(length > 1, _mix(names[begin] + _ODD * length.astype(np.uint64)), names[begin])
    closed, owner = length > 1, document[begin]
    for round_ in range(ROUNDS):
        left = (_mix(symbol ^ _salted(round_ + 1)) & np.uint64(1)).astype(bool) & ~closed
        right = ~left & ~closed
        joins = np.flatnonzero(left[:-1] & right[1:] & (owner[:-1] == owner[1:]))
        symbol[joins] = _mix(symbol[joins] * _ODD + symbol[joins + 1] + np.uint64(round_))
        keep = np.ones(len(symbol), bool)
        keep[joins + 1] = False
        symbol, closed, owner, begin = symbol[keep], closed[keep], owner[keep], begin[keep]
    border = in_run.copy()
    border[begin] = True
    return np.flatnonzero(border)


class Words:
    """The words of a slice of documents, one after the other."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in lists], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.names = word_names([w for words in lists for w in words])
        self.document = np.repeat(np.arange(len(lists)), self.sizes)

    def keyed_places(self) -> tuple[np.ndarray, np.ndarray]:
        """Places with REACH words of their document on either side, and their keys."""
        at = places(self.names, self.document)
        own = self.document[at]
        inside = (at - REACH >= self.first[own]) & (at + REACH <= self.first[own] + self.sizes[own])
        at = at[inside]
        return at, sequence_names(self.names, 2 * REACH, 1)[at - REACH]

    def windows_at(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the places with REACH words on either side of it."""
        lo = np.maximum(at + REACH - WINDOW, self.first[self.document[at]])
        own = self.document[at]
        hi = np.minimum(at - REACH, self.first[own] + self.sizes[own] - WINDOW)
        some = lo <= hi
        change = np.zeros(len(self.names) + 2, np.int64)
        np.add.at(change, lo[some], 1)
        np.add.at(change, hi[some] + 1, -1)
        return np.flatnonzero(np.cumsum(change)[: len(self.names)] > 0)


#: What a batch sends to a bucket: entries of equal length in four columns. ``settled`` entries need no
#: comparison any more: the batch itself knows that they repeat.
_SENT = "bucket int, settled boolean, names binary, docs binary, variants binary, positions binary"
_FOUND = "doc bigint, variant int, positions binary"
_NAME_BYTES = {"key": 6, "window": 12}


def _planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then all second bytes, and so on: small numbers then compress to little."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _grouped(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order with equal names together, earliest place first, and where a new name begins in it."""
    columns = (places["position"], places["variant"], places["doc"], *(names[:, k] for k in range(names.shape[1])))
    order = np.lexsort(columns)
    sorted_ = names[order]
    return order, np.r_[True, (sorted_[1:] != sorted_[:-1]).any(axis=1)] if len(order) else np.empty(0, bool)


_PLACE = np.dtype([("doc", np.int64), ("variant", np.int32), ("position", np.int32)])


def _send(names: np.ndarray, wide: int, places: np.ndarray, buckets: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """What one batch sends for its named places; each row of ``names`` is a name of one or two numbers."""
    order, begins = _grouped(names, places)
    group = np.cumsum(begins) - 1
    again = np.bincount(group, minlength=1)[group] > 1
    open_, settled = order[begins], order[again & ~begins if first_stays else again]
    bucket = np.r_[names[open_, 0] % np.uint64(buckets), places["doc"][settled].view(np.uint64) % np.uint64(buckets)].astype(np.int64)
    bucket = bucket * 2 + np.r_[np.zeros(len(open_), np.int64), np.ones(len(settled), np.int64)]
    members = np.r_[open_, settled]
    by = np.lexsort((places["position"][members], places["doc"][members], bucket))
    bucket, members = bucket[by], members[by]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    raw = np.ascontiguousarray(names).view(np.uint8).reshape(len(names), -1)
    raw = raw[:, 2:8] if wide == 6 else raw[:, :12]
    columns = [[], [], [], [], [], []]
    for a, b in zip(edges, np.r_[edges[1:], len(bucket)], strict=False):
        own, done = members[a:b], bool(bucket[a] & 1)
        at = places[own]
        row = (bucket[a] >> 1, done, b"" if done else raw[own].tobytes())
        for column, value in zip(columns, (*row, *(_planes(np.ascontiguousarray(at[k])) for k in _PLACE.names)), strict=True):
            column.append(value)
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "settled", "names", "docs", "variants", "positions"])


def _report(places: np.ndarray) -> pa.RecordBatch:
    """Positions by document."""
    places = np.sort(places, order=["doc", "variant", "position"])
    new = (places["doc"][1:] != places["doc"][:-1]) | (places["variant"][1:] != places["variant"][:-1])
    edges = np.flatnonzero(np.r_[True, new])
    positions = np.ascontiguousarray(places["position"])
    parts = [positions[a:b].tobytes() for a, b in zip(edges, np.r_[edges[1:], len(places)], strict=True)]
    columns = [pa.array(np.ascontiguousarray(places[k][edges])) for k in ("doc", "variant")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], ["doc", "variant", "positions"])


def _settle(held: list[tuple], wide: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """The repeated places of one bucket: all of them, or all but the first of each name."""
    places = np.empty(sum(len(h[2]) // 8 for h in held), _PLACE)
    start = 0
    for _, _, docs, variants, positions in held:
        part = slice(start, start := start + len(docs) // 8)
        for k, kind, data in zip(_PLACE.names, (np.int64, np.int32, np.int32), (docs, variants, positions), strict=True):
            places[k][part] = _from_planes(data, kind)
    done = np.repeat([h[0] for h in held], [len(h[2]) // 8 for h in held])
    open_, wanted = places[~done], [places[done]]
    if len(open_):
        raw = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(-1, wide)
        full = np.zeros((len(raw), 8 * -(-wide // 8)), np.uint8)
        full[:, :wide] = raw
        order, begins = _grouped(full.view(np.uint64), open_)
        group = np.cumsum(begins) - 1
        wanted.append(open_[order[~begins if first_stays else np.bincount(group)[group] > 1]])
    found = np.concatenate(wanted)
    if len(found):
        yield _report(found)


def _repeated(sent: DataFrame, wide: int, first_stays: bool) -> DataFrame:
    """(doc, found): the repeated places of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for bucket, *entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and bucket != now:
                    yield from _settle(held, wide, first_stays)
                    held = []
                now = bucket
                held.append(tuple(entry))
        if held:
            yield from _settle(held, wide, first_stays)

    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)
    return found.groupBy("doc").agg(F.collect_list(F.struct("variant", "positions")).alias("found"))


def _own(found: list[dict] | None, variant: int) -> np.ndarray:
    parts = [f["positions"] for f in found or () if f["variant"] == variant]
    return np.unique(np.frombuffer(b"".join(parts), np.int32)).astype(np.int64)


def _place_rows(batch: pa.RecordBatch, words: Words, at: np.ndarray) -> np.ndarray:
    own = words.document[at]
    out = np.empty(len(at), _PLACE)
    out["doc"], out["variant"] = batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own]
    out["position"] = at - words.first[own]
    return out


def _send_keys(searched: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words = Words(batch.column(2).to_pylist())
            at, keys = words.keyed_places()
            if len(at):
                yield from _send(keys[:, None], _NAME_BYTES["key"], _place_rows(batch, words, at), buckets, False)

    return searched.mapInArrow(run, _SENT)


def _send_windows(found: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words = Words(batch.column(2).to_pylist())
            places_ = [_own(f, v) for f, v in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = words.windows_at(np.concatenate([p + s for p, s in zip(places_, words.first, strict=True)]))
            if len(at):
                pair = np.stack([sequence_names(words.names, WINDOW, salt)[at] for salt in (2, 3)], axis=1)
                pair[:, 1] &= np.uint64(0xFFFFFFFF)
                yield from _send(pair, _NAME_BYTES["window"], _place_rows(batch, words, at), buckets, True)

    return found.mapInArrow(run, _SENT)


def bucket_count(plain: DataFrame) -> int:
    """So many that the keys of ``BUCKET_BYTES`` of text meet in a bucket, and enough to keep all tasks busy."""
    size = plain.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    return max(4 * int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def repeated_windows(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc, variant, words, carried), and (doc, firsts, found) for their variants.

    ``firsts`` lists the digests of the texts whose first document this is, ``found`` the starts of the windows
    that occur earlier, by variant.
    """
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    plain = docs.select(doc.alias("doc"), text_bytes(text).alias("words"), carried.alias("carried"))
    buckets = bucket_count(plain)
    # Rows of one document and text share a rank, and the first of them has it as its row number too.
    by_text = Window.partitionBy("doc").orderBy("words")
    numbered = plain.select("doc", "words", "carried", F.rank().over(by_text).alias("variant"), F.row_number().over(by_text).alias("row"))

    # The first document of each text; the digests come from the input itself and shuffle no text.
    digests = plain.select("doc", F.sha2("words", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc").alias("doc"))
    first = first.groupBy("doc").agg(F.collect_set("digest").alias("firsts"))
    # Rows that repeat a document would meet themselves: one is enough to search. All steps read the same columns
    # of the documents, so that Spark shuffles them once.
    is_first = F.array_contains("firsts", F.sha2("words", 256))
    searched = numbered.join(first, "doc").where(is_first & F.expr("row = variant"))
    searched = searched.select("doc", "variant", "words", "carried")

    keys = _repeated(_send_keys(searched, buckets), _NAME_BYTES["key"], False)
    suspects = searched.join(keys, "doc").select("doc", "variant", "words", "carried", "found")
    windows = _repeated(_send_windows(suspects, buckets), _NAME_BYTES["window"], True)
    return numbered, first.join(windows, "doc", "full")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc, words, n_words, n_removed, kept, carried): one row per row of ``docs``.

    ``words`` is the text as bytes, ``kept`` joins the words that are left by one space, and ``carried`` is a struct
    of the columns named in ``carry``, or a constant if there are none.
    """
    numbered, findings = repeated_windows(docs, doc_id, text, carry)
    copy = ~F.coalesce(F.array_contains("firsts", F.sha2("words", 256)), F.lit(False))
    joined = numbered.join(findings, "doc", "left").select("doc", "variant", "words", copy.alias("copy"), "found", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            counts, removed, kept = [], [], []
            rows = zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)
            for _, variant, text_, copy, found in rows:
                words = text_.split()
                n = len(words)
                cover = np.zeros(n + 1, np.int64)
                if n >= WINDOW and copy:
                    cover[0] = 1
                elif found:
                    starts = _own(found, variant)
                    cover[starts] += 1
                    np.add.at(cover, starts + WINDOW, -1)
                gone = np.cumsum(cover[:n]) > 0
                counts.append(n)
                removed.append(int(gone.sum()))
                if removed[-1]:
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept.append(b" ".join(words))
            columns = [
                batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()), batch.column(5),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "words", "n_words", "n_removed", "kept", "carried"])

    carried = joined.schema["carried"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc bigint, words binary, n_words bigint, n_removed bigint, kept binary, carried {carried}")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the repeats cut from the text; texts that lose nothing, nulls included, stay as they are."""
    rest = tuple(c for c in docs.columns if c != text)
    null = free_name(docs.columns, "_null")
    found = dedup(docs.withColumn(null, F.col(text).isNull()), doc_id, text, (*rest, null))
    same = F.when(~F.col(f"carried.{null}"), F.col("words").cast("string"))
    out = found.withColumn("_text", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(same))
    columns = {c: F.col(f"carried.{c}") for c in rest} | {text: F.col("_text")}
    if n_chars in docs.columns:
        columns[n_chars] = F.when(F.col("n_removed") > 0, F.length("_text")).otherwise(F.col(f"carried.{n_chars}")).cast("long")
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def removal(docs: DataFrame) -> DataFrame:
    """Per document: its words, those removed, and the digest of the words kept."""
    found = dedup(docs)
    doc_id = F.when(F.col("doc") != -(2**63), F.col("doc"))
    return found.select(doc_id.alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
