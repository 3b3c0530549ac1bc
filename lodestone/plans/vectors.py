"""Nearest vectors without the full product: cells around centroids, and cells that can't hold a better one are left out.

Centroids are fitted on a bounded sample; every vector is entered in the cell of its nearest one. A question first meets the cells
nearest to it, which gives it a least score. The angle between a vector and its centroid is at most its cell's largest one, so a cell's vectors are
no nearer to a question than the angle to the centroid less that. A second pass meets the cells whose bound reaches the
least score, so results are those of the full product. How much is left out depends on the data: vectors with clusters gain,
random ones of many dimensions hardly do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import ranked
from ..sources.files import cut

#: Rows that centroids are fitted on at most, and how many centroids there are at most.
SAMPLE, CELLS = 20_000, 256
#: Rows whose angles to all centroids a task has in memory at once.
PIECE = 1024


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix; all lists have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def angles(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units(rows) @ centroids.T, -1.0, 1.0))


def centroids(vectors: DataFrame, key: str, vector: str, rounds: int = 8) -> np.ndarray:
    """Directions of clusters of a sample: the SAMPLE rows of least hashed keys."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).collect()
    points = units(np.array([r["v"] for r in rows], float)) if rows else np.zeros((0, 1))
    found = points[:: max(1, len(points) // max(1, min(CELLS, int(len(points) ** 0.5))))][:CELLS]
    for _ in range(rounds if len(found) else 0):
        nearest = np.argmax(points @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        found = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, units(sums), found)
    return found


def in_cells(vectors: DataFrame, key: str, vector: str, around: np.ndarray) -> DataFrame:
    """k, v, cell, angle (to its centroid) and norm of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, PIECE) for whole in batches for a in range(0, whole.num_rows, PIECE)):
            if batch.num_rows:
                rows = matrix(batch.column(1))
                to = angles(rows, around)
                cell = np.argmin(to, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(to[np.arange(len(cell)), cell]), pa.array(np.linalg.norm(rows, axis=1))], ["k", "v", "cell", "angle", "norm"])

    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "k long, v array<double>, cell long, angle double, norm double")


def _products(asked: DataFrame, held: DataFrame, most: int, block: int, sizes: dict[int, int], digits: int, parts: int) -> DataFrame:
    """query, row, score: the ``most`` best of each block of a cell for each question (cell, k, v) that asks the cell; a cell's questions are in ``parts`` parts."""
    blocks = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // block))])
    dealt = held.withColumn("block", F.pmod(F.xxhash64("k"), blocks[F.col("cell")]))
    rows = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("k", "v")).alias("held"))
    questions = asked.groupBy("cell", F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("k", "v")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, h in zip(batch.column("asked"), batch.column("held"), strict=True):
                a_ids, h_ids = (x.values.field("k").to_numpy(zero_copy_only=False) for x in (a, h))
                scores = np.round(matrix(a.values.field("v")) @ matrix(h.values.field("v")).T, digits)
                order = np.lexsort((np.broadcast_to(h_ids, scores.shape), -scores), axis=1)[:, :most]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a_ids, order.shape[1])), pa.array(h_ids[order].ravel()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], ["query", "row", "score"])

    return questions.join(rows, "cell").select("asked", "held").mapInArrow(run, "query long, row long, score double")


def nearest_pruned(queries: DataFrame, vectors: DataFrame, key: str, vector: str, most: int, block: int = 1024, digits: int = 6) -> DataFrame:
    """query, row, score, rank: the ``most`` vectors of largest dot product with each question, ties by row; the rows of the full product."""
    around = centroids(vectors, key, vector)
    empty = "query long, row long, score double, rank bigint"
    if not len(around):
        return queries.sparkSession.createDataFrame([], empty)
    held = cut(in_cells(vectors, key, vector, around))
    facts = {r["cell"]: r for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"), F.min("norm").alias("low"), F.max("norm").alias("high")).collect()}  # CELLS rows at most
    cells = np.array(sorted(facts))
    sizes = np.array([facts[c]["n"] for c in cells])
    widest, low, high = (np.array([facts[c][x] for c in cells]) for x in ("angle", "low", "high"))

    def order_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each question and cell, and which cells it meets first: the nearest ones that hold ``most`` rows."""
        to = angles(rows, around)[:, cells]
        cos = np.cos(np.maximum(0.0, to - widest)) * np.linalg.norm(rows, axis=1, keepdims=True)
        bound = np.where(cos >= 0, cos * high, cos * low) + 2 * 10.0**-digits
        near = np.argsort(to, axis=1, kind="stable")
        enough = np.cumsum(sizes[near], axis=1) - sizes[near] < most
        first = np.zeros(to.shape, bool)
        np.put_along_axis(first, near, enough, axis=1)
        return bound, first

    def meets(rows: DataFrame, second: bool) -> DataFrame:
        """k, v and cell. A question leaves its task once, with the list of its cells; Spark repeats its vector for each, row by row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in (batch.slice(a, PIECE) for a in range(0, batch.num_rows, PIECE)):
                    bound, first = order_of(matrix(piece.column(1)))
                    if second:
                        first = ~first & (bound >= piece.column(2).to_numpy(zero_copy_only=False)[:, None])
                    ends = np.append(0, np.cumsum(first.sum(axis=1)))
                    met = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells[np.nonzero(first)[1]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), met], ["k", "v", "cells"])

        return rows.mapInArrow(run, "k long, v array<double>, cells array<long>").select("k", "v", F.explode("cells").alias("cell"))

    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    parts = max(64, -(-queries.count() // block))
    each = {int(c): int(facts[c]["n"]) for c in cells}
    one = cut(_products(meets(asked, False), held, most, block, each, digits, parts))
    best = ranked(one, [F.desc("score"), F.col("row")], most, ["query"])
    least = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= most, F.min("score")).otherwise(float("-inf")).alias("least"))
    again = asked.join(least, asked["k"] == least["query"]).select("k", "v", "least")
    two = cut(_products(meets(again, True), held, most, block, each, digits, parts))
    return ranked(best.select("query", "row", "score").unionByName(two), [F.desc("score"), F.col("row")], most, ["query"])

