"""Removal of long repeated passages with suffix arrays.

Every byte goes that lies in a ``width``-byte string which also starts somewhere else in the corpus. One suffix array of the
corpus can't be had, so equal strings are first brought together. In each ``width``-byte window the k-gram (k = width / 2) of
least hash is its anchor; equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a run,
with a context of at most 2 * width - k bytes.

1. A bounded two-pass Bloom filter finds the anchors that may occur more than once; only their runs go on.
2. Runs are counted by anchor and context. A context that occurs twice is repeated as a whole. An anchor with one run is not.
3. One copy of each different context of the other anchors is fetched, and the contexts of an anchor get a suffix array
   (linear grouping construction, suffix_array.py); suffixes next to each other that share ``width`` bytes mark their windows.
4. An anchor with very many different contexts (a line that thousands of documents share) would make one large array. Its
   runs are cut into shorter ones of windows at like distance from the anchor, which are brought together by the bytes that
   all windows of such a piece share; then counting and suffix arrays go on as in 2 and 3. Pieces get shorter until no group
   is large: those of one window hold equal strings only.
5. Each document gets its marked spans and is cut.

Defined results: null text counts as empty; texts shorter than ``width`` stay whole; equal rows (same doc_id and text) are two
places, so both lose the text; an empty table gives no rows; other columns stay, whatever their names. Windows are told apart by two 64-bit
hashes where they are counted, and by their bytes in the suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import col, cut, drop, filter_log2, fresh, mix, repeated_filter, slices, text_buffer, text_rows
from .suffix_array import repeated_starts

BLOCK = 1 << 18
PLACES = np.uint64((1 << 20) - 1)
#: Bytes of different contexts up to which an anchor gets one suffix array.
MOST_BYTES = 32_768
#: Windows in the pieces of runs whose anchor has more than that.
PIECES = (32, 4, 1)
#: Bytes of contexts that a task holds at a time, and runs that it cuts into pieces at a time (each up to ``width`` pieces of ``width`` bytes).
SOME_BYTES = 500_000
SOME_RUNS = 50


@lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd base and of its inverse."""
    base = 0x9E3779B97F4A7C15
    powers = np.full(n, np.uint64(base))
    powers[0] = 1
    inverse = np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    inverse[0] = 1
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64), np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


class Hashed:
    """Hashes of any substring of a block of bytes."""

    def __init__(self, text: np.ndarray):
        table, self.powers, inverse = _tables(BLOCK + 4096)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(table[text] * inverse[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.powers[start])

    def each(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.powers[: len(self.sums) - k])


def blocks(text: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, place in it, bytes, offsets): whole documents up to BLOCK bytes, or pieces of a longer one that overlap by width - 1."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        size = int(offsets[stop] - offsets[at])
        if size <= BLOCK:
            yield at, 0, text[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        else:
            for k in range(0, size - width + 1, BLOCK - width + 1):
                piece = text[offsets[at] + k : offsets[at] + min(size, k + BLOCK)]
                yield at, k, piece, np.array([0, len(piece)])
        at = stop


class Runs:
    """The runs of windows with one anchor in a block: document, first and last window, anchor and context hashes."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, width: int):
        k = width // 2
        self.text, self.width = text, width
        self.doc = self.first = self.last = np.zeros(0, np.int64)
        self.anchor = self.context = np.zeros(0, np.uint64)
        if len(text) < width:
            return
        self.hashed = Hashed(text)
        grams = self.hashed.each(k)
        least = (grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64)
        span, have = width - k + 1, 1
        while 2 * have <= span:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        edge = np.zeros(len(least) + 1, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= width)
        edge[offsets[long]] += 1
        edge[offsets[long + 1] - width + 1] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        new = np.r_[True, least[1:] != least[:-1]]
        begins = inside & (new | ~np.r_[False, inside[:-1]])
        finishes = inside & np.r_[new[1:] | ~inside[1:], True]
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(finishes)
        self.place = (least[self.first] & PLACES).astype(np.int64)
        self.anchor = grams[self.place]
        self.context = self.hashed.of(self.first, self.last + width)
        self.doc = np.searchsorted(offsets, self.first, "right") - 1


def place_key(rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(rid.astype(np.int64).view(np.uint64) ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def each_block(batch: pa.RecordBatch, width: int) -> Iterator[tuple[Runs, np.ndarray, np.ndarray]]:
    """Runs, the row in the batch of each and the distance from places in the block to places in the document."""
    text, offsets = text_buffer(batch.column("text"))
    for first, place, piece, at in blocks(text, offsets, width):
        runs = Runs(piece, at, width)
        yield runs, runs.doc + first, place - at[runs.doc]


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def repeated_spans(docs: DataFrame, width: int = 200) -> DataFrame:
    """rid, doc_id, start, stop (bytes) of maximal repeated runs. ``docs`` has doc_id, text, rid."""
    sc = docs.sparkSession.sparkContext

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs, _, _ in each_block(batch, width):
                yield pa.RecordBatch.from_arrays([signed(runs.anchor)], ["h"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    seen = sc.broadcast(repeated_filter(docs.select("text").mapInArrow(anchors, "h long"), filter_log2(2 * size // (width // 2), 6)))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs, rows, shift in each_block(batch, width):
                on = np.flatnonzero(seen.value.has(runs.anchor))
                ids = batch.select(["rid", "doc_id"]).take(pa.array(rows[on]))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(runs.first[on] + shift[on]), pa.array(runs.last[on] + shift[on]), signed(runs.anchor[on]), signed(runs.context[on])], ["rid", "doc_id", "first", "last", "h", "context"])

    found = cut(docs.mapInArrow(candidates, "rid long, doc_id long, first long, last long, h long, context long"))
    contexts = cut(found.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "doc_id", "first", "last")).alias("one")))
    mixed = cut(
        contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.last") - F.col("one.first") + width).alias("bytes")).filter("kinds > 1")
    )
    to_fetch = cut(contexts.join(mixed.select("h"), "h").select("one.rid", "one.first"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed(place_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], ["h"])

    wanted = sc.broadcast(repeated_filter(to_fetch.mapInArrow(keys, "h long"), filter_log2(to_fetch.count()), least=1))
    drop(to_fetch)
    large = mixed.filter(F.col("bytes") > MOST_BYTES).select("h")
    dealt = sc.broadcast(repeated_filter(large, filter_log2(large.count()), least=1))
    drop(mixed)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for runs, rows, shift in each_block(batch, width):
                on = np.flatnonzero(wanted.value.has(place_key(rid[rows], runs.first + shift)))
                if not len(on):
                    continue
                many = dealt.value.has(runs.anchor[on])
                body = [runs.text[a : b + width].tobytes() for a, b in zip(runs.first[on], runs.last[on], strict=True)]
                ids = batch.select(["rid", "doc_id"]).take(pa.array(rows[on]))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(runs.first[on] + shift[on]), pa.array(runs.place[on] + shift[on]), signed(runs.anchor[on]), pa.array(many), pa.array(body, pa.binary())], ["rid", "doc_id", "first", "place", "h", "many", "body"])

    fetched = cut(docs.mapInArrow(fetch, "rid long, doc_id long, first long, place long, h long, many boolean, body binary"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, as they come sorted by h, some megabytes at a time."""
        held: list[tuple] = []
        weight = 0

        def marked() -> pa.RecordBatch:
            buckets: list[list[tuple]] = []
            for i, row in enumerate(held):
                if i and held[i - 1][3] == row[3]:
                    buckets[-1].append(row)
                else:
                    buckets.append([row])
            buckets = [b for b in buckets if len(b) > 1]
            rows: list[tuple] = []
            for bucket, starts in zip(buckets, repeated_starts([[r[4] for r in b] for b in buckets], width), strict=True):
                for row, at in zip(bucket, starts, strict=True):
                    if len(at):
                        gap = np.flatnonzero(np.diff(at) > 1)
                        rows += [(row[0], row[1], row[2] + int(a), row[2] + int(b) + width) for a, b in zip(at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["rid", "doc_id", "start", "stop"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if weight > SOME_BYTES and row[3] != held[-1][3]:
                    yield marked()
                    held, weight = [], 0
                held.append(row)
                weight += len(row[4])
        if held:
            yield marked()

    def in_arrays(rows: DataFrame) -> DataFrame:
        by_key = rows.select("rid", "doc_id", "first", "h", "body").repartition("h").sortWithinPartitions("h")
        return by_key.mapInArrow(arrays, "rid long, doc_id long, start long, stop long")

    found_in = [cut(in_arrays(fetched.filter("NOT many")))]
    source, rest = fetched, fetched.filter("many")
    for step in PIECES:
        if rest.isEmpty():
            break
        dealt_rows = cut(_pieces(rest, width, step))
        drop(source)
        kinds = cut(dealt_rows.groupBy("h", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first")).alias("one"), F.max(F.octet_length("body")).alias("size")))
        repeated = kinds.filter("n > 1").select("h", "content")
        found_in.append(cut(dealt_rows.select("h", "content", "rid", "doc_id", F.col("first").alias("start"), (F.col("first") + F.octet_length("body")).alias("stop")).join(repeated, ["h", "content"]).drop("h", "content")))
        keys_of = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("bytes")).filter("kinds > 1")
        needed = cut(kinds.join(keys_of, "h").select("h", "content", "one.rid", "one.first", (F.col("bytes") > MOST_BYTES).alias("many")))
        source = cut(dealt_rows.join(needed, ["h", "content", "rid", "first"]).select("rid", "doc_id", "first", "place", "h", "many", "body"))
        drop(dealt_rows, kinds, needed)
        found_in.append(cut(in_arrays(source.filter("NOT many"))))
        rest = source.filter("many")
    drop(source)
    copies = contexts.filter("n > 1").select("h", "context")
    whole = found.join(copies, ["h", "context"]).select("rid", "doc_id", F.col("first").alias("start"), (F.col("last") + width).alias("stop"))
    out = cut(_merged(reduce(DataFrame.unionByName, found_in, whole)))
    drop(found, contexts, *found_in)
    return out


def _merged(spans: DataFrame) -> DataFrame:
    """Spans (rid, doc_id, start, stop) of which those of a document that overlap or touch are one."""
    once = spans.groupBy("rid", "doc_id", "start").agg(F.max("stop").alias("stop"))
    in_order = Window.partitionBy("rid", "doc_id").orderBy("start")
    reached = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = once.withColumn("begins", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    numbered = begins.withColumn("run", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("rid", "doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _pieces(rows: DataFrame, width: int, step: int) -> DataFrame:
    """Runs cut where windows pass a multiple of ``step`` in their distance from the anchor; h is by the bytes that all windows of a piece share, content by all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh64_intdigest
        for batch in slices(batches, SOME_RUNS):
            out: list[tuple] = []
            for rid, doc_id, first, place, body in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "first", "place", "body")), strict=True):
                at, last = first, first + len(body) - width
                while at <= last:
                    away = (place - at) // step
                    high = place - away * step
                    end = min(last, high)
                    piece, shared = body[at - first : end - first + width], body[high - first : high - first + width - step + 1]
                    out.append((rid, doc_id, at, place, of(shared, away), of(piece, 1), piece))
                    at = end + 1
            longs = [pa.array(np.array([r[i] for r in out], np.uint64 if i in (4, 5) else np.int64).view(np.int64)) if i != 1 else pa.array([r[1] for r in out], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array([r[6] for r in out], pa.binary())], ["rid", "doc_id", "first", "place", "h", "content", "body"])

    return rows.mapInArrow(run, "rid long, doc_id long, first long, place long, h long, content long, body binary")


def suffix_dedup(docs: DataFrame, width: int = 200, as_text: bool = False) -> DataFrame:
    """doc_id, row (the other columns), kept (the bytes left; as text without what is left of characters that were cut through), spans (array of start, stop: maximal removed runs), n_bytes, one row per row of ``docs``."""
    others = [col(c) for c in docs.columns if c not in ("doc_id", "text")]
    docs = text_rows(docs, F.struct(F.lit(0).alias(fresh(docs, "none")), *others).alias("row")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(docs.drop("row"), width).groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    # the spans grow with the corpus: never broadcast
    joined = docs.join(spans.withColumnRenamed("doc_id", "id").hint("merge"), (docs["rid"] == spans["rid"]) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "row", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, runs, sizes = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, merged = text.encode(), marks or []
                at, left = 0, []
                for run in merged:
                    left.append(data[at : run["start"]])
                    at = run["stop"]
                whole = b"".join([*left, data[at:]])
                kept.append(whole.decode(errors="ignore") if as_text else whole)
                runs.append(merged)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(sizes, pa.int64())], ["doc_id", "row", "kept", "spans", "n_bytes"])

    schema = StructType([joined.schema["doc_id"], joined.schema["row"]]).add("kept", "string" if as_text else "binary").add("spans", ArrayType(StructType().add("start", "long").add("stop", "long"))).add("n_bytes", "long")
    return joined.mapInArrow(remove, schema)


def digest(cut_docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`suffix_dedup`."""
    return cut_docs.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with repeated passages cut out of text; what is left of a character that was cut through goes too."""
    left = suffix_dedup(docs, width, as_text=True)
    return left.select(*[F.col("kept").alias(c) if c == "text" else F.col(c) if c == "doc_id" else col("row")[c].alias(c) for c in docs.columns])
