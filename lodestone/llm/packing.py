"""Packing of pieces of documents into sequences: best-fit decreasing for one length, and for several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (document's index, start in it, length)
Piece = tuple[int, int, int]


class RoomTree:
    """Open bins by their free room: a segment tree over 0..most tells the least room that is large enough."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.held = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.held[node] += by
            node >>= 1

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._count(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) of an open bin with the least room of at least ``least``, which is taken out; the newest of equal ones."""
        held, node = self.held, least + self.size
        if not held[node]:
            while node & 1 or not held[node + 1]:  # up, to a right neighbour that holds something
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if held[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return room, self.bins[room].pop()


def split_long(lengths: Sequence[int], most: int) -> list[Piece]:
    """Pieces of at most ``most``; a longer document gives full pieces and a rest, nothing is lost."""
    return [(i, at, min(most, n - at)) for i, n in enumerate(lengths) for at in range(0, n, most)]


def pack(lengths: Sequence[int], capacity: int) -> list[list[Piece]]:
    """Best-fit decreasing into bins of one capacity."""
    tree, bins = RoomTree(capacity), []
    for piece in sorted(split_long(lengths, capacity), key=lambda p: (-p[2], p[0], p[1])):
        found = tree.take(piece[2])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        bins[found[1]].append(piece)
        if found[0] > piece[2]:
            tree.add(found[0] - piece[2], found[1])
    return bins


def pack_variable(lengths: Sequence[int], capacities: Sequence[int], cost: Callable[[int], float]) -> list[tuple[int, list[Piece]]]:
    """Best-fit decreasing into bins of several permitted capacities.

    Where no open bin has room, the new bin has the size that costs least for what it can be expected to hold: the piece and
    as much of what is still to come as fits. At the end each bin is cut down to the smallest size that holds its contents.
    """
    sizes = sorted(set(capacities))
    tree, bins, size_of = RoomTree(sizes[-1]), [], []
    pieces = sorted(split_long(lengths, sizes[-1]), key=lambda p: (-p[2], p[0], p[1]))
    rest = sum(p[2] for p in pieces)
    for piece in pieces:
        rest -= piece[2]
        found = tree.take(piece[2])
        if found is None:
            size = min((s for s in sizes if s >= piece[2]), key=lambda s: (cost(s) / (piece[2] + min(s - piece[2], rest)), s))
            found = size, len(bins)
            bins.append([])
            size_of.append(size)
        bins[found[1]].append(piece)
        if found[0] > piece[2]:
            tree.add(found[0] - piece[2], found[1])
    return [(next(s for s in sizes if s >= sum(p[2] for p in b)), b) for b in bins]


#: Permitted sequence lengths, in tokens, and what each sequence costs beside its length.
CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 16
#: Documents that are packed together. Blocks bound a task's memory; each wastes at most a few part-filled bins.
BLOCK = 50_000


def best_fit_packing(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, block: int = BLOCK) -> DataFrame:
    """One row per bin from rows of doc_id and length: bin_id, capacity, used, doc_ids, starts and lengths (of the pieces, in order).

    The documents of each task are packed in blocks, without a shuffle, so the bins depend on how the input is dealt out; each
    token of each document is in one bin in any case. A document of no tokens (or null length) is in none. bin_id is unique.
    """
    sizes = tuple(int(c) for c in capacities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40

        def packed(ids: list, tokens: list[int]) -> pa.RecordBatch:
            nonlocal next_id
            bins = pack_variable(tokens, sizes, lambda s: s + overhead)
            first, next_id = next_id, next_id + len(bins)
            columns = [
                pa.array(range(first, next_id), pa.int64()),
                pa.array([c for c, _ in bins], pa.int32()),
                pa.array([sum(p[2] for p in b) for _, b in bins], pa.int32()),
                pa.array([[ids[p[0]] for p in b] for _, b in bins], pa.list_(pa.int64())),
                pa.array([[p[1] for p in b] for _, b in bins], pa.list_(pa.int64())),
                pa.array([[p[2] for p in b] for _, b in bins], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"])

        ids, tokens = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            tokens += batch.column(1).to_pylist()
            while len(ids) >= block:
                yield packed(ids[:block], tokens[:block])
                ids, tokens = ids[block:], tokens[block:]
        if ids:
            yield packed(ids, tokens)

    rows = lengths.select(F.col("doc_id").cast("long"), F.greatest(F.lit(0), F.coalesce(F.col("length"), F.lit(0))).cast("long").alias("length"))
    return rows.mapInArrow(run, "bin_id long, capacity int, used int, doc_ids array<long>, starts array<long>, lengths array<int>")


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and length: the words of the text (null: none) between blanks."""
    return docs.select("doc_id", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).alias("length"))


def position_ids(cu_seqlens: Sequence[int], width: int) -> np.ndarray:
    """Positions of a packed row, from 0 in each segment and in the padding."""
    edges = np.r_[np.asarray(cu_seqlens), width] if cu_seqlens[-1] < width else np.asarray(cu_seqlens)
    return np.arange(width) - np.repeat(edges[:-1], np.diff(edges))
