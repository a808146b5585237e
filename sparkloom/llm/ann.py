"""Nearest neighbours by block matrix join.

1. Vectors are quantised to int8 with a scale each, and a bound of what rounding lost is kept. Blocks of queries
   meet blocks of candidates in tiles that hold codes, scales and bounds only, an eighth of the vectors.
2. A tile's int8 products give distances that are off by at most the sum of both errors (triangle inequality)
   and by what the sums themselves are rounded. Each query has a heap of the smallest upper bounds seen so far in
   its task; pairs whose lower bound exceeds its k-th can't be among the k nearest and are dropped. The k-th
   smallest upper bound over all tasks drops more.
3. The survivors' vectors are fetched by id, their distances recomputed in double precision, and the nearest kept.
Of candidates with one and the same vector only the k + 1 with the smallest ids can be among any query's k nearest,
so a vector that a third of all rows have costs no more than that.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, settle

#: Vectors in a block. What is shuffled is the number of pairs times a vector's codes by the size of a block, so blocks are large;
#: within them TILE products are made at a time. Small tables have smaller blocks, LEAST at least, for as many tasks as cores.
CANDIDATES, QUERIES, LEAST, TILE = 1 << 16, 1 << 14, 1 << 10, (1024, 4096)
#: Pairs that a task keeps before it drops those beyond the bounds it knows by then, and pairs recomputed at a time.
KEPT, PAIRS = 1 << 21, 1 << 15
EPS = float(np.finfo(np.float64).eps)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>): non-null ids, and vectors that are non-empty, finite and not zero."""
    v = F.col(vector).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row, and a bound of the Euclidean norm of what rounding lost."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # all components underflow; they are lost, and small
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    lost = x - codes * scale[:, None]
    most = np.maximum(np.abs(lost).max(axis=1), np.finfo(np.float64).tiny)  # no square under- or overflows
    norm = np.sqrt(((lost / most[:, None]) ** 2).sum(axis=1)) * most
    return codes, scale, norm * (1 + 4 * x.shape[1] * EPS) + 256 * math.sqrt(x.shape[1]) * EPS * scale


def bounds(q: dict[str, np.ndarray], c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances, as double precision gives them, of each query from each candidate.

    Where doubles overflow nothing is known: -inf and inf.
    """
    dim = q["codes"].shape[1]
    # whole numbers summed in float32 are exact below 2^24, and in float64 beyond 1040 dimensions
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
    products = (q["codes"].astype(kind) @ c["codes"].astype(kind).T).astype(np.float64)
    with np.errstate(all="ignore"):
        # by the larger scale, so that squares neither overflow nor vanish
        a, b = q["scale"][:, None], c["scale"][None, :]
        unit = np.maximum(a, b)
        a, b = a / unit, b / unit
        of_q, of_c = ((x["codes"].astype(np.float64) ** 2).sum(axis=1) for x in (q, c))
        both = of_q[:, None] * a**2 + of_c[None, :] * b**2
        square = both - 2 * products * (a * b)
        slack = 16 * EPS * both  # differences of squares are off by a part of the squares, not of the difference
        off = (q["error"][:, None] + c["error"][None, :]) * (1 + 4 * EPS)
        low, high = np.sqrt(np.maximum(square - slack, 0)) * unit, np.sqrt(np.maximum(square, 0) + slack) * unit
        # the exact figure is itself a rounded sum of dim squares, which vanish below 1e-154
        rounded = (2 * dim + 8) * EPS
        lower, upper = (low - off) * (1 - rounded) - 1e-150, (high + off) * (1 + rounded) + 1e-150
        beyond = ~(upper < 1e150)
    lower[beyond], upper[beyond] = -math.inf, math.inf
    return lower, upper


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows: squares are added in order of the components, so that equal vectors give equal sums everywhere."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for d in range(a.shape[1]):
            total += (a[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


class Candidates:
    """For each query the smallest upper bounds so far, and the pairs that may still be among its k nearest."""

    def __init__(self, k: int) -> None:
        self.k, self.n, self.least = k, 0, KEPT
        self.heaps: dict[int, list[float]] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def tiles(self, q: dict[str, np.ndarray], c: dict[str, np.ndarray]) -> None:
        part = lambda x, at, n: {name: v[at : at + n] for name, v in x.items()}
        for i in range(0, len(q["ids"]), TILE[0]):
            for j in range(0, len(c["ids"]), TILE[1]):
                a, b = part(q, i, TILE[0]), part(c, j, TILE[1])
                self.add(a["ids"], b["ids"], *bounds(a, b))

    def add(self, q_ids: np.ndarray, c_ids: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        own = q_ids[:, None] == c_ids[None, :]
        upper[own] = math.inf
        lower[own] = math.inf
        nearest = np.sort(np.partition(upper, self.k - 1, axis=1)[:, : self.k] if upper.shape[1] > self.k else upper, axis=1)
        limit = np.empty(len(q_ids))
        for i, q in enumerate(q_ids.tolist()):
            heap = self.heaps[q] = list(heapq.merge(self.heaps.get(q, []), nearest[i].tolist()))[: self.k]
            limit[i] = heap[-1] if len(heap) == self.k else math.inf
        at_q, at_c = np.nonzero((lower <= limit[:, None]) & ~own)
        self.parts.append((q_ids[at_q], c_ids[at_c], lower[at_q, at_c], upper[at_q, at_c]))
        self.n += len(at_q)
        if self.n > self.least:
            self.prune()
            self.least = max(KEPT, 2 * self.n)

    def prune(self) -> tuple[np.ndarray, ...]:
        """Drops the pairs that bounds found later rule out; the rest: queries, candidates, lower and upper bounds."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        found = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        at, where = np.unique(found[0], return_inverse=True)
        limit = np.array([h[-1] if len(h := self.heaps[i]) == self.k else math.inf for i in at.tolist()])
        keep = found[2] <= limit[where] if len(where) else np.zeros(0, bool)
        self.parts = [tuple(x[keep] for x in found)]
        self.n = int(keep.sum())
        return self.parts[0]


def _blocks(rows: DataFrame, size: int, others: int, own: int, name: str) -> DataFrame:
    """Blocks of vectors of one length, each dealt to a random-like `own` slot and repeated for every one of `others` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            ids, codes = (np.concatenate(x) for x in held.pop(dim))
            for at in range(0, len(ids), size):
                part = ids[at : at + size]
                found = quantise(codes[at : at + size])
                slot = int(part[0] * 2654435761 % 2**32) % own
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([slot], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (part, *found))], ["dim", "own", "ids", "codes", "scale", "error"])

        for batch in batches:
            values, ids = batch.column(1), batch.column(0).to_numpy()
            flat, lengths = values.flatten().to_numpy(), values.value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                to = held.setdefault(dim, ([], []))
                to[0].append(ids[at])
                to[1].append(flat[starts[at][:, None] + np.arange(dim)])
                if sum(map(len, to[0])) >= size:
                    yield from out(dim)
        for dim in list(held):
            yield from out(dim)

    made = map_arrow(rows, run, "dim int, own int, ids binary, codes binary, scale binary, error binary")
    mine, theirs = ("g", "h") if name == "c" else ("h", "g")
    return made.select("dim", F.col("own").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(theirs), *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "codes", "scale", "error")])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of `vectors` by Euclidean distance, ties to smaller ids.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part. A query's candidates are the vectors of its own length. Rows that share the query's id are its own
    and not candidates. Of queries that share an id that with the smallest vector counts; repeated candidates count as
    often as they occur. Distances that double precision can't hold are infinite. Fewer than k candidates: all of them.
    No queries or no candidates: an empty result.
    """
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    asked = settle(asked)
    # of equal vectors all but those with the k + 1 smallest ids have k others before them that are no query's own
    rows = usable(vectors, key, vector).withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("v", "id").orderBy("place"))).where(F.col("again") <= k)
    single = settle(rows.select("id", "v"))
    n, n_asked, cores = single.count(), asked.count(), vectors.sparkSession.sparkContext.defaultParallelism
    g = max(1, math.ceil(n / CANDIDATES), min(2 * cores, math.ceil(n / LEAST)))
    h = max(1, math.ceil(n_asked / QUERIES))
    cs, qs = _blocks(single, max(1, math.ceil(n / g)), h, g, "c"), _blocks(asked.coalesce(h), QUERIES, g, h, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Candidates(k)
        kinds = {"ids": np.int64, "codes": np.int8, "scale": np.float64, "error": np.float64}

        def side(batch: pa.RecordBatch, i: int, name: str, dim: int) -> dict[str, np.ndarray]:
            out = {c: np.frombuffer(batch.column(batch.schema.get_field_index(f"{name}_{c}"))[i].as_buffer(), t) for c, t in kinds.items()}
            return out | {"codes": out["codes"].reshape(-1, dim)}

        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(batch.schema.get_field_index("dim"))[i].as_py()
                q, c = side(batch, i, "q", dim), side(batch, i, "c", dim)
                found.tiles(q, c)
        left = found.prune()
        for s in range(0, len(left[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]) for x in left], ["query_id", "vec_id", "lower", "upper"])

    tiles = cs.join(qs.hint("shuffle_hash"), ["dim", "g", "h"])
    pairs = settle(map_arrow(tiles, run, "query_id long, vec_id long, lower double, upper double"))
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("upper"))).where(F.col("place") <= k)
    limit = best.groupBy("query_id").agg(F.max("upper").alias("limit"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(limit, "query_id").where((F.col("n") < k) | (F.col("lower") <= F.col("limit"))).select("query_id", "vec_id").distinct()
    both = pairs.join(single.select(F.col("id").alias("vec_id"), F.col("v").alias("c")), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").where("size(q) = size(c)")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            sides = [batch.column(i).flatten().to_numpy() for i in (2, 3)]
            score = np.empty(batch.num_rows)
            for dim in np.unique(lengths).tolist():
                every = np.flatnonzero(lengths == dim)
                for s in range(0, len(every), PAIRS):
                    at = every[s : s + PAIRS]
                    place = starts[at][:, None] + np.arange(dim)
                    score[at] = distances(sides[0][place], sides[1][place])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    scored = map_arrow(both.select("query_id", "vec_id", "q", "c"), exact, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
