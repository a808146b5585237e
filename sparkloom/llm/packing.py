"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of the sequence length and a rest. Only the histogram of piece lengths
(2048 rows at most) goes to the driver; it places lengths longest first, each into the shortest pack
that still has room, and counts equal packs together as one pattern. Patterns come back to the pieces
by rank: a piece's rank among those of its length selects pack and offset. Ranks are computed in
buckets of bounded size with running bucket totals, so a length that a third of all pieces have is
spread like any other.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, map_arrow, settle, text_list
from .tokenization import default_path, encoder

#: Rows of a bucket, beyond a number of buckets that small tables have too. Totals are one row for each bucket and length.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 17, 64


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids and the end id, cut at multiples of `sequence`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), text_list(batch, "text"), strict=True):
                found = np.array([*ids(text), end_id], "<u4")
                for start in range(0, len(found), sequence):
                    part = found[start : start + sequence]
                    for column, value in zip(out, (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(found)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(id_text(docs), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def plan_packs(histogram: dict[int, int], sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many packs have each.

    Longest lengths first; a length goes to the shortest pack (that with most room) it fits in, and
    opens new packs, each filled with as many copies as fit, only where none has room.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    most = -1

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        nonlocal most
        by_room[room][pattern] += n
        most = max(most, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most >= 0 and not by_room[most]:
                most -= 1
            if most < length:
                each = min(sequence // length, left)
                put(sequence - each * length, (length,) * each, left // each)
                left %= each
                continue
            pattern, n = next(iter(by_room[most].items()))
            took = min(n, left)
            if took == n:
                del by_room[most][pattern]
            else:
                by_room[most][pattern] = n - took
            put(most - length, (*pattern, length), took)
            left -= took
    return sorted(((pattern, n) for packs in by_room.values() for pattern, n in packs.items() if n), reverse=True)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the sequence of that rank and the offset in it."""
    rank: dict[int, int] = defaultdict(int)
    found, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            found.append(((length << 44) + rank[length], sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    found.sort()
    return tuple(np.array([x[i] for x in found], np.int64) for i in range(3))  # type: ignore[return-value]


def pack(docs: DataFrame, sequence: int = 2048, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs (doc_id, text).

    Nulls: a null text is the empty text, whose only id is the end id; a null doc_id is kept. Repeated
    rows are packed once each. Pieces of equal length are taken by bucket, then doc_id, start and crc.
    An empty table gives an empty result.
    """
    cut = settle(pieces(docs, tokenizer_path or default_path(), sequence, end_id))
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, sequences, offsets = _slots(plan_packs(histogram, sequence))
    buckets = max(LEAST_BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    # by the piece, not the document: a null doc_id, or one very long document, is spread like any other
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("bucket", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["bucket", "length"]).withColumn("rank", F.col("within") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column(2).to_numpy().astype(np.int64) << 44) + batch.column(5).to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return map_arrow(ranked.select(*columns, "rank"), place, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))
