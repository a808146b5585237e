"""An index for approximate vector search: rows clustered by cell, exact distances within the probed cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildError
from ..functions.vector import METRICS
from ..sources.tables import TableSource
from .model import Model

#: Most cells, vectors of the sample for each of them, and rounds of k-means on the sample.
MOST_CELLS, SAMPLE, ROUNDS = 1024, 32, 10
#: Cells probed by default are so many that this part of the neighbours of sampled vectors, so many each, would be found.
RECALL, QUERIES, NEAR = 0.95, 256, 10
#: Probed cells hold at least this many times k rows together.
SPARE = 4
#: Vectors assigned at once.
BLOCK = 2048
CELL = "vector_cell"
#: The cell of vectors that have no place: null, of another length than the sample's, or with a null or non-finite value.
APART = -1


@dataclass(frozen=True)
class VectorIndex:
    """An index over one column. With a folder it is built: the rows by cell, and the cells' centers, written last.

    It holds a copy of the rows as they were when it was built."""

    table: str
    column: str
    metric: str
    folder: str = ""

    def probed(self, source: TableSource, vector: list[float], k: int, probes: int | None) -> DataFrame:
        """The rows of the cells nearest to the vector and of those apart; all rows for a vector of another length."""
        cells = source.spark.read.parquet(f"{self.folder}/centers").collect()  # MOST_CELLS + 1 at most
        rows = source.spark.read.parquet(f"{self.folder}/rows")
        centers = [c for c in cells if c.cell != APART]
        if not centers or len(centers[0].center) != len(vector):
            return rows.drop(CELL)
        far = _distances(np.array([vector]), np.array([c.center for c in centers]), self.metric)[0]
        least = probes if probes is not None else centers[0].probes
        chosen, held = [APART], 0
        for at in np.argsort(far, kind="stable").tolist():
            if len(chosen) > least and held >= SPARE * k:
                break
            chosen.append(centers[at].cell)
            held += centers[at].n
        return rows.where(F.col(CELL).isin(chosen)).drop(CELL)


def build_vector_index(model: Model, field: str, metric: str, source: TableSource | None = None, folder: str = "") -> VectorIndex:
    """What an index covers; with a source and a new shared folder it is built there.

    Centers come from k-means on a sample of at most SAMPLE * MOST_CELLS rows, by the hash of the primary key, and so does
    the number of cells to probe: clustered vectors need few, evenly spread ones nearly all. Every row is indexed.
    Rows are written by ranges of (cell, hash), so a cell that holds much of the table is split between tasks."""
    if model.field(field).kind != "vector" or metric not in METRICS:
        raise BuildError("an index needs a vector field and a known metric")
    index = VectorIndex(model.table, model.field(field).column, metric, folder.rstrip("/"))
    if source is None and not folder:
        return index
    if source is None or not folder:
        raise BuildError("a built index needs a source and a folder")
    rows = source.table(model.table)
    if CELL in rows.columns:
        raise BuildError(f"{model.table} has a column {CELL}")
    spread = F.xxhash64(*[F.col(f.column) for f in model.pk] or [F.col(index.column)])
    cells = min(MOST_CELLS, math.isqrt(rows.count()))
    points = _sample(rows, index.column, spread, cells, metric)
    centers = _centers(points, cells, metric)
    probes = _probes(points, centers, metric)
    placed = _placed(rows, index.column, centers, metric)
    some = bool(rows.take(1))
    # without rows there are no partitions to read a schema from
    writer = placed.repartitionByRange(F.col(CELL), spread).write.partitionBy(CELL) if some else placed.write
    writer.parquet(f"{index.folder}/rows")
    spark = source.spark
    schema = f"{CELL} int, center array<double>"
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], schema)
    counts = spark.read.parquet(f"{index.folder}/rows").groupBy(CELL).agg(F.count(F.lit(1)).alias("n"))
    known = known.join(counts, CELL, "left")
    known.select(F.col(CELL).alias("cell"), "center", F.coalesce("n", F.lit(0)).alias("n"), F.lit(probes).alias("probes")).coalesce(1).write.parquet(f"{index.folder}/centers")
    return index


def _usable(column: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return column.isNotNull() & (F.size(column) > 0) & ~F.exists(column.cast("array<double>"), bad)


def _sample(rows: DataFrame, column: str, spread: Column, cells: int, metric: str) -> np.ndarray:
    """Distinct vectors of the sample, of its most usual length; none if there are no vectors."""
    taken = rows.where(_usable(F.col(column))).select(F.col(column).cast("array<double>").alias("v"), spread.alias("spread")).orderBy("spread").limit(SAMPLE * max(1, cells)).select("v")
    vectors = [r.v for r in taken.collect()]
    if not vectors:
        return np.zeros((0, 0))
    lengths, n = np.unique([len(v) for v in vectors], return_counts=True)
    points = np.unique(np.array([v for v in vectors if len(v) == lengths[n.argmax()]]), axis=0)  # copies would share a center
    return points if metric == "l2" else np.unique(_unit(points), axis=0)


def _centers(points: np.ndarray, cells: int, metric: str) -> np.ndarray:
    """(cells, dimensions) centers by k-means."""
    centers = points[np.random.default_rng(0).permutation(len(points))[:cells]]
    for _ in range(ROUNDS if len(centers) else 0):
        at = _nearest_cells(points, centers, metric)
        held = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, points)
        centers = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centers)
    return centers


def _nearest_cells(points: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    return np.concatenate([_distances(points[i : i + BLOCK], centers, metric).argmin(1) for i in range(0, len(points), BLOCK)])


def _probes(points: np.ndarray, centers: np.ndarray, metric: str) -> int:
    """Cells to probe, nearest first, for RECALL of the NEAR nearest sampled vectors of QUERIES of them."""
    if len(points) < 2:
        return 1
    queries = np.random.default_rng(1).permutation(len(points))[:QUERIES]
    cell = _nearest_cells(points, centers, metric)
    order = np.argsort(np.argsort(_distances(points[queries], centers, metric), axis=1, kind="stable"), axis=1)
    far = _distances(points[queries], points, metric)
    far[np.arange(len(queries)), queries] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(NEAR, len(points) - 1)]
    return int(math.ceil(np.quantile(order[np.arange(len(queries))[:, None], cell[near]], RECALL))) + 1


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _distances(points: np.ndarray, centers: np.ndarray, metric: str) -> np.ndarray:
    """(points, centers) values that order the centers of a point by their distance."""
    if metric == "cosine":
        return -(_unit(points) @ _unit(centers).T)
    return (centers**2).sum(1) - 2 * points @ centers.T


def _placed(rows: DataFrame, column: str, centers: np.ndarray, metric: str) -> DataFrame:
    """The rows with the cell whose center is nearest."""
    kept = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = kept.value
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index(column)).to_pylist()
            cell = np.full(len(vectors), APART, np.int32)
            fits = [i for i, v in enumerate(vectors) if v and len(centers) and len(v) == centers.shape[1] and None not in v]
            for start in range(0, len(fits), BLOCK):
                at = np.array(fits[start : start + BLOCK])
                points = np.array([vectors[i] for i in at], np.float64)
                with np.errstate(all="ignore"):
                    finite = np.isfinite(points).all(1)
                    found = _distances(np.where(finite[:, None], points, 0), centers, metric).argmin(1)
                cell[at] = np.where(finite, found, APART)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, CELL])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(CELL, T.IntegerType())]))
