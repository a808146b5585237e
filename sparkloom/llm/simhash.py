"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

1. A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64 values.
2. A fingerprint's embedding is the vector of bit counts of its 32 segments of 2 bits. A differing
   bit moves one count by at most one, so the Manhattan distance of two embeddings is a lower bound
   of the fingerprints' Hamming distance.
3. Grid range join: integer points within Manhattan distance m share a grid point within half of m
   (rounded up) of both. Each embedding goes to the cells that near to its own, and those that meet in a
   cell are candidates. A cell with one fingerprint has none.
4. Candidates are verified by the bits in which the fingerprints themselves differ. Of the pairs that pass
   in a cell only as many come out as link the same fingerprints, so no cell emits all its pairs.
   A cell with more than CELL fingerprints (embeddings may agree where fingerprints don't) isn't compared
   in whole: its members go to the words near to their own bits, where few can meet, and are verified there.
Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_list, id_text, is_empty, look_up, map_arrow, settle
from .components import connected_components

#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 1 << 16
SEGMENTS = 32
#: Fingerprints that are compared with each other in one cell.
CELL = 2048


def fingerprint(text: bytes, words_in_shingle: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all shingles, repeats included; 0 for no words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    total, ones = len(words) - k + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, CHUNK):
        to = min(at + CHUNK, total)
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at:to], ends[at + k - 1 : to + k - 1], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def embedding(fingerprints: np.ndarray) -> np.ndarray:
    """Bit counts (0 to 2) of the 32 segments, each in 2 bits of one word."""
    x = fingerprints.astype(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, cell long) of every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words_in_shingle, seed) for x in binary_list(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), pa.array(embedding(found).view(np.int64))], ["doc_id", "fp", "cell"])

    return map_arrow(id_text(docs), run, "doc_id long, fp long, cell long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _beside(at: Column) -> Column:
    """The cell and every cell at distance one."""
    steps = F.array(*[F.struct(F.lit(2 * i).alias("i"), F.lit(_signed(1 << 2 * i)).cast("long").alias("one"), F.lit(_signed(3 << 2 * i)).cast("long").alias("both")) for i in range(SEGMENTS)])
    bit = lambda i: F.call_function("getbit", at, i)
    low = F.filter(steps, lambda s: bit(s["i"] + 1) == 0)  # 0 <-> 1
    high = F.filter(steps, lambda s: (bit(s["i"] + 1) == 1) | (bit(s["i"]) == 1))  # 1 <-> 2
    return F.concat(F.array(at), F.transform(low, lambda s: at.bitwiseXOR(s["one"])), F.transform(high, lambda s: at.bitwiseXOR(s["both"])))


def _flipped(word: Column) -> Column:
    """The word and every word that differs in one bit."""
    bits = F.array(*[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    return F.concat(F.array(word), F.transform(bits, lambda b: word.bitwiseXOR(b)))


def _spread(nodes: DataFrame, start: str, around: Callable[[Column], Column], radius: int) -> DataFrame:
    """(at, fp, node): every node at all places within `radius` steps of its own."""
    out = nodes.select(F.col(start).alias("at"), "fp", "node")
    for _ in range(radius):
        out = out.select(F.explode(around(F.col("at"))).alias("at"), "fp", "node")
    return out.distinct() if radius > 1 else out


def linked(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Places of fingerprints within max_bits of each other, as many pairs as link the same fingerprints."""
    group = list(range(len(fps)))

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for i in range(len(fps) - 1):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= max_bits) + i + 1).tolist():
            x, y = root(i), root(j)
            if x != y:
                group[y] = x
                out.append((i, j))
    return out


def _verified(met: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) of the fingerprints of each place `at` that are within max_bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fps, nodes in zip(batch.column(0), batch.column(1), strict=True):
                at = nodes.values.to_numpy(zero_copy_only=False)
                out += [(int(at[i]), int(at[j])) for i, j in linked(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), max_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], ["src", "dst"])

    groups = met.groupBy("at").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")).where(F.size("fps") > 1)
    return map_arrow(groups.select("fps", "nodes"), run, "src long, dst long").distinct()


def links(nodes: DataFrame, max_bits: int = 2, cell: int = CELL) -> DataFrame:
    """(src, dst) between nodes of distinct fingerprints, enough to join all within max_bits of each other.

    `nodes`: fp long (unique), cell long, node long. A fingerprint goes to all cells within half of max_bits of
    its own, at most 65 for 2 bits; the number grows steeply with larger limits.
    """
    if max_bits < 0:
        raise ValueError("max_bits can't be negative")
    radius = (max_bits + 1) // 2
    cells = _spread(nodes, "cell", _beside, radius)
    shared = cells.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settle(cells.join(shared, "at"))
    found = _verified(met.where(F.col("n") <= cell), max_bits)
    crowded = met.where(F.col("n") > cell)
    if is_empty(crowded):
        return found
    return found.union(_verified(_spread(crowded.select("fp", "node").distinct(), "fp", _flipped, radius), max_bits)).distinct()


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3, seed: int = 42, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text).

    Nulls: a null text counts as empty (fingerprint 0, linked like any other). A row whose doc_id is
    null keeps its fingerprint and gets a null component: it takes no part in linking. Repeated rows
    come back repeated. An empty table gives an empty result. Other columns are ignored.
    """
    prints = settle(fingerprints(docs, words_in_shingle, seed))
    nodes = settle(prints.where("doc_id is not null").groupBy("fp", "cell").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(links(nodes, max_bits))
    named = settle(nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id")))
    known = look_up(prints.where("doc_id is not null").select("doc_id", "fp"), named, "fp").select("doc_id", "fp", "component_id")
    return known.union(prints.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long")))
