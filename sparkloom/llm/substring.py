"""Substring dedup with a count-min prefilter.

1. Every word has a 128-bit XXH3 hash. Every window of 50 words has a 128-bit rolling hash of those and, as its
   sketch key, the smallest hash of its 20-word grams. Equal windows have equal keys, so the number of documents with
   a key is at least the number with the window: counting keys overestimates window counts, and as neighbouring
   windows share keys a sketch takes about a sixteenth of the increments.
2. Each task makes a sparse count-min sketch (two rows of counters that stop at 2) of its documents; merging adds
   the counters. Only one bit a counter is needed after that ("two or more"). Counters are sized by the input, up to
   2^29 a row, so at most 128 MB are broadcast; a fuller sketch lets more windows through and changes no result.
3. The second pass emits only windows whose key is estimated in two documents or more and finds each
   one's first document by an aggregate with map-side combining, so a window in a third of all
   documents costs a row a task. Overestimates only let more windows through; none is lost.
4. The third pass removes from each document the words of estimated windows whose first document
   is another one. The join is on doc_id, so no window's popularity skews it.
Windows are equal if both 64-bit halves of their hashes are: for 10^15 windows the chance of any two that differ is below 10^-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_list, id_text, map_arrow, small_batches

ROWS, SHARD_BITS = 2, 21
#: Counters of a sketch row: sixteen for each expected key, and bounds of their number in bits.
SPARE, LEAST_BITS, MOST_BITS = 16, 20, 29
#: Keys a task gathers before it emits what it has, and words whose hashes it keeps.
KEYS, WORDS = 1 << 21, 1 << 19
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class WordHashes:
    """128-bit XXH3 hashes of words, kept by word while there are not too many."""

    class _Places(dict):
        def __init__(self) -> None:
            super().__init__()
            self.made: list[bytes] = []

        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            self.made.append(xxhash.xxh3_128_digest(word))
            return n

    def __init__(self) -> None:
        self._renew()

    def _renew(self) -> None:
        self.places = self._Places()
        self.table = np.zeros((2, 0), np.uint64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes (2, words) of the texts' words one after another, and the number of words of each text."""
        if len(self.places) > WORDS:
            self._renew()
        listed = [x.split() for x in texts]  # ASCII white space only, as on bytes
        counts = np.array([len(x) for x in listed], np.int64)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(listed)), np.int64, int(counts.sum()))
        if self.places.made:
            new = np.frombuffer(b"".join(self.places.made), np.uint64).reshape(-1, 2).T
            self.places.made.clear()
            self.table = np.concatenate([self.table, new], axis=1)
        return self.table[:, at], counts


def _rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of `size` hashes, by doubling."""
    done, have, power, length, whole = None, 0, base, 1, h
    bits = []
    while length <= size:
        if size & length:
            bits.append((length, whole, power))
        if length * 2 > size:
            break
        whole = whole[:-length] * power + whole[length:]
        power, length = power * power, length * 2
    for length, part, power in reversed(bits):
        if done is None:
            done, have = part, length
        else:
            n = len(h) - have - length + 1
            done, have = done[:n] * power + part[have : have + n], have + length
    return done


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a run of words: its two 64-bit hashes and its sketch key."""
    with np.errstate(over="ignore"):
        first, second = (_mix(_rolling(h[i], window, BASES[i])) for i in (0, 1))
        low = _mix(_rolling(h[0], gram, BASES[1]))
        span, length = window - gram + 1, 1
        while length * 2 <= span:
            low, length = np.minimum(low[:-length], low[length:]), length * 2
        if length < span:
            low = np.minimum(low[: len(low) - (span - length)], low[span - length :])
    return first, second, low


@dataclass
class Group:
    """Documents read together: most have few words, and arrays over many documents cost far less than many arrays.

    `words` counts the words of each of the group's texts, the first of which is text `start` of the batch.
    Text rows[j] has windows, n[j] of them from at[j] on in first, second and key.
    """

    start: int
    words: list[int]
    rows: list[int]
    at: list[int]
    n: list[int]
    whole: np.ndarray
    first: np.ndarray
    second: np.ndarray
    key: np.ndarray


def groups(texts: list[bytes], known: WordHashes, window: int, gram: int, most: int = 1 << 19) -> Iterator[Group]:
    """The texts in groups of at least `most` bytes, or what is left; a longer text ends its group."""
    start = total = 0
    for end, text in enumerate(texts, 1):
        total += len(text)
        if total < most and end < len(texts):
            continue
        hashes, counts = known.of(texts[start:end])
        n = np.maximum(counts - window + 1, 0)
        rows = np.flatnonzero(n)
        at = (np.cumsum(counts) - counts)[rows]
        if len(rows):
            first, second, key = windows(hashes, window, gram)
        else:
            first = second = key = np.zeros(0, np.uint64)
        # windows that run over a text's end belong to none
        edge = np.zeros(len(key) + 1, np.int8)
        edge[at] += 1
        edge[at + n[rows]] -= 1
        yield Group(start, counts.tolist(), (rows + start).tolist(), at.tolist(), n[rows].tolist(), np.cumsum(edge[:-1], dtype=np.int8) > 0, first, second, key)
        start, total = end, 0


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        return [(keys >> np.uint64(3)) & mask, _mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) & mask]


def partition_sketches(docs: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(row, shard, cells): counters of each task's sketch; a counter of 2 or more is listed twice."""

    def emit(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, shards, blobs = [], [], []
        for row, cells in enumerate(_cells(np.concatenate(keys), bits) if keys else []):
            cell, n = np.unique(cells, return_counts=True)
            cell = np.repeat(cell, np.minimum(n, 2))
            shard = (cell >> np.uint64(SHARD_BITS)).astype(np.int32)
            low = (cell & np.uint64((1 << SHARD_BITS) - 1)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for s, part in zip(shard[np.concatenate(([0], cuts))].tolist() if len(shard) else [], np.split(low, cuts), strict=False):
                rows.append(row)
                shards.append(s)
                blobs.append(part.tobytes())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["row", "shard", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, n = WordHashes(), [], 0
        for batch in batches:
            for g in groups(binary_list(batch, "text"), known, window, gram):
                new = np.concatenate(([True], g.key[1:] != g.key[:-1]))
                for at, size in zip(g.at, g.n, strict=True):  # each key once a document
                    new[at] = True
                    keys.append(np.unique(g.key[at : at + size][new[at : at + size]]))
                    n += len(keys[-1])
                if n > KEYS:
                    yield from emit(keys)
                    keys, n = [], 0
        yield from emit(keys)

    return map_arrow(docs.where("doc_id is not null"), run, "row int, shard int, cells binary")


def merged_sketch(docs: DataFrame, window: int, gram: int, bits: int) -> list[bytes]:
    """For each sketch row a bitmap of the counters that are 2 or more: 2^bits bits."""
    size = 1 << min(bits, SHARD_BITS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = counts.setdefault((row, shard), np.zeros(size, np.uint8))
                cell, n = np.unique(np.frombuffer(blob, np.uint32), return_counts=True)
                at[cell] = np.minimum(at[cell] + n, 2)
        for (row, shard), at in counts.items():
            if (at > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([shard], pa.int32()), pa.array([np.packbits(at > 1).tobytes()], pa.binary())], ["row", "shard", "cells"])

    shards = max(1, (1 << bits) // size)
    dealt = partition_sketches(docs, window, gram, bits).repartition(min(ROWS * shards, 32), "row", "shard")
    maps = [bytearray(max(1, (1 << bits) // 8)) for _ in range(ROWS)]
    for row, shard, cells in dealt.mapInArrow(merge, "row int, shard int, cells binary").collect():  # 128 MB at most
        maps[row][shard * len(cells) : (shard + 1) * len(cells)] = cells
    return [bytes(x) for x in maps]


def _among(first: np.ndarray, second: np.ndarray, own: np.ndarray, own_2: np.ndarray) -> np.ndarray:
    """Which windows are among a document's own, by both halves of their hashes."""
    return np.isin(first, own) & np.isin(second, own_2)


def _estimated(maps: list[np.ndarray], key: np.ndarray, bits: int) -> np.ndarray:
    """True where every row of the sketch says two or more."""
    out = np.ones(len(key), bool)
    for bitmap, cell in zip(maps, _cells(key, bits), strict=True):
        at = cell.astype(np.int64)
        out &= (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def sized(rows: DataFrame) -> int:
    """Bits of a sketch row for the texts' bytes: a key for about 100 of them."""
    total = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total * SPARE // 100)))))


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 20, sketch_bits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of docs (doc_id, text), and a struct `row` of the columns in `carry`.

    A word goes if a window of `window` words that covers it has a word sequence that also starts in a
    document with a smaller doc_id, judged on the input. Kept words are joined by one space.

    Nulls: a null text has no words. A row whose doc_id is null keeps all its words and takes nothing
    from others. Rows with equal doc_id don't remove each other's words and come back repeated. Texts
    shorter than a window keep everything. An empty table gives an empty result.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    rows = id_text(docs)
    spark, sketch_bits = rows.sparkSession, sketch_bits or sized(rows)
    sketch = spark.sparkContext.broadcast(merged_sketch(rows, window, gram, sketch_bits))

    def bitmaps() -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint8) for x in sketch.value]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maps = WordHashes(), bitmaps()
        for batch in batches:
            firsts, seconds, ids = [], [], []
            doc_ids = batch.column(0).to_numpy()
            for g in groups(binary_list(batch, "text"), known, window, gram):
                if not g.rows:
                    continue
                hit = np.flatnonzero(g.whole & _estimated(maps, g.key, sketch_bits))
                firsts.append(g.first[hit])
                seconds.append(g.second[hit])
                ids.append(doc_ids[g.rows][np.searchsorted(g.at, hit, "right") - 1])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (firsts, seconds, ids)], ["k1", "k2", "doc_id"])

    found = map_arrow(rows.where("doc_id is not null"), suspects, "k1 long, k2 long, doc_id long")
    owned = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner")).groupBy("owner").agg(F.collect_list("k1").alias("own"), F.collect_list("k2").alias("own_2"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maps = WordHashes(), bitmaps()
        for batch in batches:
            texts, own = binary_list(batch, "text"), [batch.column(batch.schema.get_field_index(c)) for c in ("own", "own_2")]
            named = batch.column(0).is_valid().to_pylist()
            kept: list[bytes] = [b" ".join(x.split()) for x in texts]
            words: list[int] = []
            removed = [0] * len(texts)
            for g in groups(texts, known, window, gram):
                words += g.words
                gone = g.whole & _estimated(maps, g.key, sketch_bits)
                for i, at, n in zip(g.rows, g.at, g.n, strict=True):
                    mine = gone[at : at + n]
                    if not named[i] or not mine.any():
                        continue
                    if own[0][i].is_valid:
                        mine = mine & ~_among(g.first[at : at + n], g.second[at : at + n], *(x[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for x in own))
                    size = n + window - 1
                    edge = np.zeros(size + 1, np.int64)
                    edge[:n] += mine
                    edge[window : window + n] -= mine
                    keep = np.cumsum(edge[:-1]) == 0
                    if lost := size - int(keep.sum()):
                        removed[i], kept[i] = lost, b" ".join(compress(kept[i].split(b" "), keep.tolist()))
            columns = [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(batch.schema.get_field_index("row"))], ["doc_id", "n_words", "n_removed", "kept_text", "row"])

    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("row"))
    both = whole.join(owned.withColumnRenamed("owner", "doc_id"), "doc_id", "left").select("doc_id", "text", "own", "own_2", "row")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("row", both.schema["row"].dataType)])
    small_batches(spark)
    out = both.mapInArrow(cut, schema)
    return out if carry else out.drop("row")
