"""SimHash near-dedup: fingerprints of word shingles, a binary-trie self-join and connected components.

Two fingerprints that differ in at most ``budget`` bits agree on at least one of ``budget`` + 1 blocks of bits, so each
different fingerprint goes to one bucket for each block, and every pair within the budget meets in some bucket. In a bucket
the binary trie of its fingerprints is joined with itself: node pairs are followed down together, differing bits are added up
and a pair is dropped once they exceed the budget. A bucket of more than MOST fingerprints is split in the same way by blocks
of its other bits, again and again, until few free bits bound its size. Buckets give links to their components' first
members only, and the components of all links are found by label propagation over tables.

Defined results: null text counts as empty; a text without words has fingerprint 0 and is linked like any other; equal texts
have one fingerprint and are linked; an empty table gives no rows; other columns are ignored; a null doc_id is no one's
component unless all of its component are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, slices, text_rows

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints in a bucket; larger ones are split.
MOST = 4096


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 majority bits of the XXH64 values (seed 42) of all shingles of a text, repeats included; 0 without words."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends[: max(0, len(tokens) - words)]]
    of = xxhash.xxh64_intdigest
    h = np.array([of(joined[a : b - 1], 42) for a, b in zip(starts, ends[min(words, len(tokens)) - 1 :], strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        counts += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and code (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = [fingerprint(t.encode(), words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "code"])

    return text_rows(docs).mapInArrow(run, "doc_id long, code long")


def trie_pairs(codes: np.ndarray, low: np.ndarray, high: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of codes in the same bucket [low, high) that differ in at most ``budget`` bits. Codes are sorted in each bucket."""
    a0, a1, b0, b1, errors = low, high, low, high, np.zeros(len(low), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(63, -2, -1):
        own = a0 == b0
        live = ~own | (a1 - a0 > 1)
        leaf = ~own & (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = np.bitwise_count(codes[i] ^ codes[j]) <= budget
        found.append((i[near], j[near]))
        live &= ~leaf
        a0, a1, b0, b1, errors, own = (x[live] for x in (a0, a1, b0, b1, errors, own))
        if depth < 0 or not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        other = ~own
        new = [
            (a0, am, b0, bm, errors),
            (am, a1, bm, b1, errors),
            (a0, am, bm, b1, errors + 1),
            (am[other], a1[other], b0[other], bm[other], errors[other] + 1),
        ]
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*new, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (errors <= budget)
        a0, a1, b0, b1, errors = (x[keep] for x in (a0, a1, b0, b1, errors))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(i, j), np.maximum(i, j)


def first_members(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks that share out the given bits."""
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(mask: Column, parts: int, level: int) -> Column:
    """The finer masks below ``mask`` (null: none yet), as an array."""

    def finer(masks: list[int]) -> dict[int, list[int]]:
        return {m: [m | x for x in _blocks([b for b in range(63, -1, -1) if not m >> b & 1], parts)] for m in masks}

    masks = [0]
    for _ in range(level):
        masks = [x for m in masks for x in finer(masks)[m]]
    below = finer(masks)
    if not level:
        return F.array(*[F.lit(_signed(x)) for x in below[0]])
    table = F.create_map(*[y for m, xs in below.items() for y in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
    return table[mask]


def links(codes: DataFrame, budget: int = 2) -> DataFrame:
    """Links seed, a, b between the different fingerprints of ``codes`` (seed, code): spanning forests of what some buckets link."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((rows[:, 3].view(np.uint64), rows[:, 2], rows[:, 1], rows[:, 0]))
            rows = rows[order]
            edges = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1), True])
            low, high = edges[:-1], edges[1:]
            several = high - low > 1
            own = np.ascontiguousarray(rows[:, 3])
            low, high = low[several], high[several]
            share = np.cumsum((high - low) ** 2) // (MOST * MOST)  # buckets that are joined at a time: pairs bound the memory
            found = [trie_pairs(own.view(np.uint64), low[share == x], high[share == x], budget) for x in np.unique(share)]
            # one code may be in several buckets: of all its links only a spanning forest's are needed
            nodes, at = np.unique(rows[:, [0, 3]], axis=0, return_inverse=True)
            at = at.ravel()
            first = first_members(len(nodes), *(at[np.concatenate([np.zeros(0, np.int64), *x])] for x in zip(*found, strict=True))) if found else np.arange(len(nodes))
            on = np.flatnonzero(first != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (nodes[on, 0], nodes[on, 1], nodes[first[on], 1])], ["seed", "a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:  # sorted by bucket: the last bucket may go on
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            held.append(rows)
            if sum(map(len, held)) > 200_000:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield linked(rows[:whole])
                held = [rows[whole:]]
        if held and len(rows := np.concatenate(held)):
            yield linked(rows)

    out, level, rest, mask, bucket = None, 0, codes.select(F.col("seed").cast("long").alias("seed"), "code"), F.lit(None), ["seed", "mask", "part"]
    while True:
        mask = _keys(F.col("mask") if level else mask, budget + 1, level)
        rows = rest.select("seed", F.explode(mask).alias("mask"), "code").withColumn("part", F.col("code").bitwiseAND(F.col("mask"))).select("seed", "mask", "part", "code")
        if level:
            rows = cut(rows.distinct())  # buckets above overlap
        sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = cut(sizes.filter(F.col("n") > MOST))
        stop = level == 3 or large.isEmpty()
        small = rows if stop else rows.join(large, bucket, "left_anti")
        new = small.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(join, "seed long, a long, b long")
        out = cut(new if out is None else out.unionByName(new))
        if stop:
            return out
        rest, level = rows.join(large, bucket, "left_semi"), level + 1


def components(edges: DataFrame) -> DataFrame:
    """code, label: the smallest code reachable over ``edges`` (a, b), for every code that has an edge.

    In each round a code takes the least label of its neighbours and of the code that is its own label, so that labels travel
    twice as far each time. A join and a sum; lineage is cut after each.
    """
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("code")).agg(F.least(F.col("code"), F.min("b")).alias("label")))
    while True:
        own = labels.select(F.col("code").alias("a"), F.col("label").alias("b"), F.col("label").alias("was"))
        asked = both.withColumn("was", F.lit(None).cast(labels.schema["label"].dataType)).unionByName(own)
        reached = asked.join(labels.withColumnRenamed("label", "next"), F.col("b") == F.col("code")).groupBy("a")
        new = cut(reached.agg(F.min("next").alias("label"), F.min("was").alias("was")).select(F.col("a").alias("code"), F.least("label", "was").alias("label"), "was"))
        drop(labels)
        labels = new.select("code", "label")
        labels._written = new._written
        if new.filter("label <> was").isEmpty():
            drop(both)
            return labels


def simhash_dedup(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable)."""
    rows = cut(fingerprints(docs, words))
    firsts = cut(rows.groupBy("code").agg(F.min("doc_id").alias("first")))
    labels = components(links(firsts.select(F.lit(0).alias("seed"), "code"), budget).select("a", "b"))
    named = cut(firsts.join(labels, "code", "left").select("code", "first", F.coalesce("label", "code").alias("label")))
    least = cut(named.groupBy("label").agg(F.min("first").alias("component_id")))
    named = cut(named.join(least, "label").select("code", "component_id"))
    return rows.join(named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
