"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words, 3-word shingles with repeats, XXH64 with seed 42; a bit is set if it is
set in over half of the shingle hashes.

Links: equal fingerprints are merged first, so a group of copies is one fingerprint however large it is. Two
fingerprints within ``RADIUS`` bits agree on one of four 16-bit blocks, and of the other 48 bits on one of four
12-bit blocks. Each fingerprint is sent to these 16 places of 28 agreed bits, where Spark sorts the arrivals of
a place by Gray rank. Neighbours in Gray order share long bit patterns: nodes over 8, 64, 512, ... neighbours
hold the mask of the bits that all their members share and the pattern of those bits. A pair of nodes whose
shared patterns already differ in more than ``RADIUS`` bits is dropped with all pairs below it; leaves share
all 64 bits, so what remains at the leaves are exactly the links. Pairs of nodes that lie within one chain of
linked Gray neighbours are skipped, since the chain connects them, and each place reports a star for every
connected part instead of all pairs. The stars are joined by Spark rounds to components.

Defined cases: no word or a null text has fingerprint zero, linked like any other; fewer words than three are one
shingle. Rows with a null id get their component like others; a component of null ids only has a null id.
Rows that repeat a doc_id are kept and all get the component of their own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import free_name, slices, stored, text_bytes
from tidewarden.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Children of a node of the index, and node pairs expanded at a time.
FAN, SLAB = 8, 1 << 18


def simhash(text: bytes) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        shingles = zip(words, words[1:], words[2:], strict=False)
        hashes = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint of each whole text as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, bits bigint")


def gray_rank(bits: Column) -> Column:
    """The place of a bit pattern in the reflected Gray order; as a signed number, which sorts as well."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def places(prints: DataFrame) -> DataFrame:
    """(place, rank, bits): each fingerprint at the 16 places that 28 agreed bits can name."""
    bits = F.col("bits")
    keys = []
    for block in range(4):
        outer = F.shiftrightunsigned(bits, 16 * block).bitwiseAND(F.lit(0xFFFF))
        low = bits.bitwiseAND(F.lit((1 << 16 * block) - 1))
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(bits, 16 * block), 16), 16 * block))
        for inner in range(4):
            agreed = F.shiftrightunsigned(rest, 12 * inner).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * block + inner) << 28).bitwiseOR(F.shiftleft(outer, 12)).bitwiseOR(agreed))
    return prints.select(F.explode(F.array(*keys)).alias("place"), gray_rank(bits).alias("rank"), "bits")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member reachable from each of n members over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def linked(place: np.ndarray, bits: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of all links within the places; rows are sorted by place and Gray rank."""
    n = len(bits)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    of = np.cumsum(np.r_[True, place[1:] != place[:-1]]) - 1
    offset = np.arange(n) - start[of]
    near = (place[1:] == place[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= radius)
    chain = np.cumsum(np.r_[True, ~near]) - 1
    # Levels of nodes, leaves first: shared mask, pattern, chain of the first and the last member, first child.
    mask, pattern, head, tail = np.full(n, ~np.uint64(0)), bits, chain, chain
    levels = [(mask, pattern, head, tail, np.arange(n))]
    group, place_of = offset, of
    while len(pattern) > len(start):
        edge = np.flatnonzero(np.r_[True, (place_of[1:] != place_of[:-1]) | (group[1:] // FAN != group[:-1] // FAN)])
        last = np.r_[edge[1:], len(pattern)] - 1
        ones = np.bitwise_and.reduceat(pattern & mask, edge)
        shared = np.bitwise_and.reduceat(mask, edge)
        some = np.bitwise_or.reduceat(pattern & mask, edge)
        mask = shared & ~(ones ^ some)
        pattern, head, tail = ones & mask, head[edge], tail[last]
        group, place_of = group[edge] // FAN, place_of[edge]
        levels.append((mask, pattern, head, tail, edge))
    found_a, found_b = [chain], [chain]
    top = np.arange(len(start))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        level, a, b = stack.pop()
        mask, pattern, head, tail, _ = levels[level]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) > radius
        one_chain = (head[a] == tail[a]) & (head[b] == tail[b]) & (head[a] == head[b])
        left = ~apart & ~one_chain
        a, b = a[left], b[left]
        if not len(a):
            continue
        if level == 0:
            found_a.append(chain[a])
            found_b.append(chain[b])
            continue
        first = np.append(levels[level][4], len(levels[level - 1][0]))
        many_a, many_b = first[a + 1] - first[a], first[b + 1] - first[b]
        for s in range(0, len(a), SLAB // FAN**2):
            cut = slice(s, s + SLAB // FAN**2)
            size = many_a[cut] * many_b[cut]
            pair = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i = first[a[cut]][pair] + at // many_b[cut][pair]
            j = first[b[cut]][pair] + at % many_b[cut][pair]
            stack.append((level - 1, i[i <= j], j[i <= j]))
    chains = int(chain[-1]) + 1
    chain_root = _roots(chains, np.concatenate(found_a), np.concatenate(found_b))
    # A chain's first member stands for it.
    first_of = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    root = first_of[chain_root[chain]]
    moved = np.flatnonzero(root != np.arange(n))
    return bits[moved], bits[root[moved]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(bits, other): edges that connect just the fingerprints whose links connect them; ``prints`` has each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(place: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            a, b = linked(place, bits.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["bits", "other"])

        held_place, held_bits = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.concatenate([held_place, batch.column(0).to_numpy()])
            bits = np.concatenate([held_bits, batch.column(1).to_numpy()])
            done = int(np.searchsorted(place, place[-1]))  # the last place may go on in the next batch
            if done:
                yield result(place[:done], bits[:done])
            held_place, held_bits = place[done:], bits[done:]
        if len(held_bits):
            yield result(held_place, held_bits)

    dealt = places(prints).repartition("place").sortWithinPartitions("place", "rank").select("place", "bits")
    return dealt.mapInArrow(run, "bits bigint, other bigint").distinct()


def _named(prints: DataFrame) -> DataFrame:
    """(bits, root, least, component_id): each fingerprint with its component's root and smallest id."""
    least = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("bits").distinct()))
    # One row per fingerprint from here on, however many documents have it.
    rooted = least.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    rooted = rooted.select("bits", "least", F.coalesce("root", "bits").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    prints = stored(fingerprints(docs, doc_id, text), "simhash")
    return prints.join(_named(prints).select("bits", "component_id"), "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def _text_hash(text: str) -> Column:
    return F.sha2(text_bytes(text), 256)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the component's id, one row of it if it is repeated.

    If several texts of one component have that id, the one with the smallest SHA-256 stays. An id with texts in
    several components is chosen in each of them apart. Documents with a null id stay: nothing names the copy to prefer.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    hashed = named.select("doc_id", _text_hash("text").alias("digest"), "text")
    prints = stored(fingerprints(hashed.select(F.struct("doc_id", "digest").alias("doc_id"), "text")), "simhash-kept")
    rows = prints.select("doc_id.doc_id", "doc_id.digest", "bits")
    # The root stands for the component; null ids link texts as well but are never chosen.
    everywhere = stored(fingerprints(docs.where(F.col("doc_id").isNull())), "simhash-null").select("doc_id", "bits")
    roots = _named(rows.select("doc_id", "bits").union(everywhere)).select("bits", "root")
    chosen = rows.join(roots, "bits").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    chosen = chosen.select("first.doc_id", "first.digest").distinct()
    # The documents' other columns may have any name, that of the digest too.
    own = free_name(docs.columns, "digest")
    chosen = chosen.withColumnRenamed("digest", own)
    kept = named.withColumn(own, _text_hash("text")).join(chosen, ["doc_id", own], "left_semi")
    kept = kept.dropDuplicates(["doc_id", own]).select(*docs.columns)
    return kept.union(docs.where(F.col("doc_id").isNull()).select(*docs.columns))
