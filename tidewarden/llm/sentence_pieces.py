"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model none of whose pieces has a marker (U+2581, which stands for a space) after another character, no
piece crosses the border between a word and the marker that follows it. A text is then a sequence of marked
words, each segmented alone: every task keeps a table of the distinct marked words it has met, lets the
library segment a word and decodes its ids the first time only, and joins ids and decoded words back by position.
A text is walked in pieces of about ``PIECE_CHARS`` characters, cut before a single space.

The table is kept per task and emptied at ``TABLE_WORDS`` entries, which costs time and never changes a
result. One table of the whole corpus would need a join that shuffles every occurrence of every word.

Defined cases: null and empty texts have no ids but the end id; an id list that is null decodes to the empty
text; other columns pass through unchanged, and an output name that is already taken is an error. One endless word is
segmented as a whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.llm.common import slices

MARK = "▁"
TABLE_WORDS = 200_000
PIECE_CHARS = 1 << 17
#: Texts on which the table must give the library's ids before a model is used with it.
PROBES = ("a", " a", "a ", "  a  b ", " ", "   ", f"a{MARK}b {MARK}", "a\nb\t c　d", "①ﬁ é \0")

_MARKED = re.compile(r" +[^ ]*")
#: A single space between two words: no marked word lies on both sides of it.
_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")


def marked_words(text: str) -> list[str]:
    """The words of ``text``, each with the spaces before it but one, which the library's prefix supplies.

    A word of spaces only is kept whole: its first space is a marker like the others.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    if text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] if w.strip(" ") else w for w in _MARKED.findall(" " + text)] if text else []


def text_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at single spaces into pieces of ``size`` characters or a little more.

    The marked words of the pieces, one after the other, are those of the text.
    """
    if len(text) <= size:
        return [text]
    text = text.replace(MARK, " ")
    pieces, start = [], 0
    while cut := _CUT.search(text, start + size):
        pieces.append(text[start : cut.start()])
        start = cut.end()
    return [*pieces, text[start:]]


class WordTable:
    """Distinct marked words with their ids and, if ``texts``, these as decimals and decoded; made once each."""

    def __init__(self, model: bytes, limit: int = TABLE_WORDS, texts: bool = True):
        self.texts = texts
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = self.pieces.eos_id()
        self.mark = [self.pieces.piece_to_id(MARK)]
        self.limit = limit
        # The text of each piece; None for those that the library must decode: bytes, control and unknown pieces.
        odd = (self.pieces.is_byte, self.pieces.is_control, self.pieces.is_unknown)
        size = range(self.pieces.get_piece_size())
        self.text_of = [None if any(f(i) for f in odd) else self.pieces.id_to_piece(i).replace(MARK, " ") for i in size]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.edges = array("i"), array("q", [0])
        self.listed: list[bytes] = []
        self.decoded: list[str] = []

    def fill(self, words: list[str]) -> None:
        if len(self.place) > self.limit:
            self.clear()
        place, new = self.place, []
        for w in words:
            if w not in place:
                place[w] = len(place)
                new.append(w)
        if not new:
            return
        # The library's prefix is one of a word of spaces; a single one is a piece of its own.
        found = self.pieces.encode([w if w.strip(" ") else w[1:] for w in new], num_threads=1)
        text_of, flat, edges, listed, decoded = self.text_of, self.flat, self.edges, self.listed, self.decoded
        for w, ids in zip(new, found, strict=True):
            if w == " ":
                ids = self.mark
            flat.extend(ids)
            edges.append(len(flat))
            if not self.texts:
                continue
            listed.append(" ".join(map(str, ids)).encode())
            parts = [text_of[i] for i in ids]
            # The library drops the first marker of a decoded text.
            text = self.pieces.decode(ids) if None in parts else "".join(parts)[1:]
            decoded.append(w if text == w else text)

    def places(self, words: list[str]) -> list[int]:
        self.fill(words)
        return list(map(self.place.__getitem__, words))

    def ids(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        edges = np.frombuffer(self.edges, np.int64)
        at = np.array(places, np.int64)
        counts = edges[at + 1] - edges[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.empty(0, np.int32), counts
        return np.frombuffer(self.flat, np.int32)[np.repeat(edges[at] - ends + counts, counts) + np.arange(total)], counts

    def encode(self, text: str) -> list[int]:
        return self.ids(self.places(marked_words(text)))[0].tolist()

    def decode_words(self, text: str) -> str:
        """What the library decodes from the text's ids."""
        places = self.places(marked_words(text))
        return " ".join(map(self.decoded.__getitem__, places))


def words_are_separate(model: bytes) -> bool:
    """Whether the model's pieces respect the markers and its normaliser leaves texts as they are."""
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any(MARK in pieces.id_to_piece(i).lstrip(MARK) for i in range(pieces.get_piece_size())):
        return False
    table = WordTable(model)
    return all(table.encode(t) == pieces.encode(t) and table.decode_words(t) == pieces.decode(pieces.encode(t)) for t in PROBES)


def load_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def id_lists(table: WordTable, texts: list[str], tabled: bool, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and the edges between the texts."""
    values, sizes = [], np.zeros(len(texts), np.int64)
    if tabled:
        # Short texts are looked up together, a long one piece by piece.
        owners, words = [], []

        def look_up() -> None:
            ids, counts = table.ids(table.places(words))
            values.append(ids)
            edges = np.cumsum([0, *(n for _, n in owners)])
            sums = np.concatenate([[0], np.cumsum(counts)])[edges]
            np.add.at(sizes, [i for i, _ in owners], np.diff(sums))
            owners.clear()
            words.clear()

        held = 0
        for i, text in enumerate(texts):
            for piece in text_pieces(text):
                found = marked_words(piece)
                owners.append((i, len(found)))
                words += found
                held += len(piece)
                if held > PIECE_CHARS:
                    look_up()
                    held = 0
        look_up()
    else:
        lists = table.pieces.encode(texts, num_threads=1)
        sizes += [len(x) for x in lists]
        values.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())))
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    if end:
        flat = np.insert(flat, edges[1:], np.int32(table.end))
        edges = edges + np.arange(len(edges))
    return edges, flat


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """Add the ids of each whole text as an array, with the end id last if ``end``."""
    schema = _with_column(df, ids, T.ArrayType(T.IntegerType(), False))
    shared = df.sparkSession.sparkContext.broadcast(model)
    at, tabled = df.columns.index(text), words_are_separate(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value, texts=False)
        for batch in slices(batches, at):
            edges, values = id_lists(table, [t or "" for t in batch.column(at).to_pylist()], tabled, end)
            column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the library decodes from each array of ids."""
    schema = _with_column(df, text, T.StringType())
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
                edges = np.cumsum([0, *lengths]).tolist()
                texts = pieces.decode([flat[a:b] for a, b in zip(edges, edges[1:], strict=False)])
                column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, text])

    return df.mapInArrow(run, schema)


def _digests(table: WordTable, text: str, tabled: bool) -> tuple[int, str, str]:
    """Id count with the end id, sha256 of the ids and of the decoded text."""
    ids_sha, text_sha, count, space = hashlib.sha256(), hashlib.sha256(), 1, b""
    if tabled:
        for n, piece in enumerate(text_pieces(text)):
            places = table.places(marked_words(piece))
            if not places:
                continue
            edges = table.edges
            count += sum([edges[i + 1] - edges[i] for i in places])
            ids_sha.update(space + b" ".join(map(table.listed.__getitem__, places)))
            text_sha.update((" " if n else "").encode() + " ".join(map(table.decoded.__getitem__, places)).encode())
            space = b" "
    else:
        ids = table.pieces.encode(text, num_threads=1)
        count += len(ids)
        ids_sha.update(" ".join(map(str, ids)).encode())
        text_sha.update(table.pieces.decode(ids).encode())
        space = b" " if ids else b""
    ids_sha.update(space + str(table.end).encode())
    return count, ids_sha.hexdigest(), text_sha.hexdigest()


def round_trip(df: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of both directions: id count, sha256 of the ids and of the decoded text.

    One pass in one worker: ids and decoded texts are digested where they are made and do not leave the task.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    tabled = words_are_separate(model)
    plain = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([plain.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value)
        for batch in slices(batches, 1):
            found = [_digests(table, t or "", tabled) for t in batch.column(1).to_pylist()]
            counts, ids_sha, text_sha = zip(*found, strict=True)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema)


def encode_checked(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``n_tokens``, ``ids`` (the end id last) and ``same_text``: whether the ids decode to the text."""
    kept = [c for c in df.columns if c != text]
    if {"n_tokens", "ids", "same_text"} & set(kept):
        raise ValueError("a column n_tokens, ids or same_text exists already")
    shared = df.sparkSession.sparkContext.broadcast(model)
    tabled = words_are_separate(model)
    plain = df.select(*kept, text)
    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("same_text", T.BooleanType()),
    ]
    schema = T.StructType([*plain.schema.fields[:-1], *fields])

    def decodes(table: WordTable, body: str, ids: np.ndarray) -> bool:
        if not tabled:
            return table.pieces.decode(ids.tolist()) == body
        # A marker in the text becomes a space, so only a text without one can come back.
        return MARK not in body and all(table.decode_words(piece) == piece for piece in text_pieces(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(shared.value)
        for batch in slices(batches, len(kept)):
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            edges, values = id_lists(table, texts, tabled, True)
            same = [decodes(table, t, values[a : b - 1]) for t, a, b in zip(texts, edges, edges[1:], strict=False)]
            column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))
            columns = [*batch.columns[:-1], pa.array(np.diff(edges), pa.int64()), column, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema)
