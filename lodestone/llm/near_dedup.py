"""Near-duplicate removal: SimHash fingerprints collapse groups of copies, a join on first shingles finds every pair that is left.

Two texts are near duplicates if the Jaccard similarity of their word shingles is ``similarity`` or more; rows linked by such
pairs, directly or through others, are one group, of which the row of least doc_id stays.

1. Texts of the same words (A-Z lower-cased) are one text.
2. Candidate groups are (a) texts whose fingerprints are linked by the trie self-join of simhash.py, and (b) texts that have one
   of their first shingles in common. Shingles are ordered by frequency, then hash; two sets of similarity s share s * n shingles
   at least, n being the size of either, so that of the first n - s * n + k of both, k at least are shared. k grows with n
   (MORE): a text with fewer first shingles that occur elsewhere has no near duplicate, and chance meetings of texts end there.
3. ROUNDS times, one text of each group (the same one for most groups of a family) is compared with all others that aren't in its
   component yet: as many comparisons as groups have members, and most large groups become one component.
4. All pairs that share enough of their first shingles and are still in different components are compared, whatever their
   number: none of ``similarity`` is missed. They grow with the square of a group only where its texts are alike below that.

Shingles decide in 3 and 4. Neither the size of a group nor the fingerprints change the result.

Defined results: null text counts as empty; texts without words are equal to each other; a text of fewer words is one shingle;
null doc_ids come last; rows equal in doc_id and text leave one; an empty table gives no rows; all columns stay as they are,
whatever their names. Texts and rows are told apart by 128-bit hashes, shingles by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, col, cut, drop, filter_log2, fresh, mix, repeated_filter, slices, text_buffer
from .simhash import LOWER, components, links

#: Fingerprints of pairs of words for each of SEEDS hashes, linked at NEAR bits.
SEEDS, NEAR = 2, 3
#: Rounds in which one text of each group is compared with all others.
ROUNDS = 2
#: Frequent shingles are those of OFTEN texts or more in one text of SAMPLE. They set an order of shingles only.
SAMPLE, OFTEN = 8, 8
#: What the number of first shingles that near duplicates have in common grows by with the size of their sets.
MORE = 0.02
#: Words whose hashes a task keeps at hand.
KEPT = 500_000
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


#: Kept between the tasks of a Python worker.
_known = Words()


def tokens_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the shingles of a text's words; of the whole text if it has fewer."""
    k = min(words, len(hashes))
    n = len(hashes) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h += hashes[i : i + n] * _ODD[i]
    return mix(h)


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """The different ones, sorted."""
    return np.unique(shingle_hashes(hashes, words))


def many_fingerprints(h: np.ndarray, seeds: int) -> list[int]:
    """Majority bits of the values as each seed mixes them."""
    mixed = (h ^ (h >> np.uint64(31))) * _ODD[:seeds, None]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    counts = np.zeros((seeds, 64), np.int64)
    for k in range(0, len(h), 255):  # as many ones as a byte can count
        bits = np.unpackbits(np.ascontiguousarray(mixed[:, k : k + 255]).view(np.uint8).reshape(seeds, -1, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def text_key(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """If the Jaccard similarity of two sorted sets is at least ``similarity``."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _hashes(rows: DataFrame, column: str, least: int = 1) -> Bloom:
    """A filter of the values of a column (of all, or of those that occur twice)."""
    return repeated_filter(rows.select(F.col(column).alias("h")), filter_log2(rows.count()), least)


def _frequent(rows: DataFrame, words: int) -> Bloom:
    """A filter of shingles that many rows hold, from one row in SAMPLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            h = [shingles(_known.of(tokens_of(t)), words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], ["h"])

    some = rows.filter(F.pmod("rid2", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    often = cut(some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).select("h"))
    found = _hashes(often, "h")
    drop(often)
    return found


def _sketches(rows: DataFrame, words: int, similarity: float, seeds: int) -> DataFrame:
    """doc_id, rid, rid2, key, size (of the set of shingles), codes (fingerprints) and prefix (the first shingles, in order) of each row."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            keys, sizes, codes, firsts = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                hashes = _known.of(tokens)
                h = shingles(hashes, words)
                last = frequent.value.has(h)
                keys.append(text_key(tokens))
                sizes.append(len(h))
                codes.append(many_fingerprints(shingle_hashes(hashes, 2), seeds))
                firsts.append(np.concatenate([h[~last], h[last]])[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 + int(MORE * len(h))].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "rid2")), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(codes, pa.list_(pa.int64())), pa.array(firsts, pa.binary())], ["doc_id", "rid", "rid2", "key", "size", "codes", "prefix"])

    return rows.mapInArrow(run, "doc_id long, rid long, rid2 long, key binary, size int, codes array<long>, prefix binary")


def _sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key and shingles of the texts of ``wanted`` (rid), and of a few others, as Bloom filters go."""
    chosen = rows.sparkSession.sparkContext.broadcast(_hashes(wanted, "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            on = np.flatnonzero(chosen.value.has(batch.column("rid").to_numpy().view(np.uint64)))
            if len(on):
                texts = [tokens_of(t) for t in batch.column("text").take(pa.array(on)).to_pylist()]
                sets = [shingles(_known.of(t), words).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    return cut(rows.select("rid", "text").mapInArrow(run, "key binary, shingles binary").dropDuplicates(["key"]))


def _first_shingles(sketched: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """shingle, key, at and size (of its set) of the first shingles that some other text may have among its first ones, of the texts of ``firsts`` (rid) with enough of them."""
    chosen = sketched.sparkSession.sparkContext.broadcast(_hashes(firsts, "rid"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Batches, the shingles of all their rows one after the other, their rows and places."""
        for batch in slices(batches, 1000):
            batch = batch.filter(pa.array(chosen.value.has(batch.column("rid").to_numpy().view(np.uint64))))
            data, ends = text_buffer(batch.column("prefix"))
            sizes = np.diff(ends) // 8
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield batch, np.frombuffer(data.tobytes(), np.uint64), owner, np.arange(len(owner)) - ends[owner] // 8

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _, _ in prefixes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    of = sketched.select("rid", "key", "size", "prefix")
    n = of.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    again = sketched.sparkSession.sparkContext.broadcast(repeated_filter(of.mapInArrow(every, "h long"), filter_log2(n // 8, 6)))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, owner, at in prefixes(batches):
            shared = again.value.has(h)
            least = 1 + (MORE * similarity * batch.column("size").to_numpy()).astype(np.int64)
            on = np.flatnonzero(shared & (np.bincount(owner, shared, len(least)) >= least)[owner])
            of_rows = batch.select(["key", "size"]).take(pa.array(owner[on]))
            yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), of_rows.column(0), pa.array(at[on].astype(np.int32)), of_rows.column(1)], ["shingle", "key", "at", "size"])

    return cut(of.mapInArrow(repeated, "shingle long, key binary, at int, size int").distinct())


def _named(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``groups`` with the component (label) of each key."""
    if labels is None:
        return groups.withColumn("label", F.col("key"))
    return groups.join(labels.withColumnRenamed("code", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _shared(similarity: float) -> Column:
    """How many of their first shingles two texts (of sizes size and s) of ``similarity`` share at least."""
    both = F.ceil(similarity / (1 + similarity) * (F.col("size") + F.col("s")) - 1e-9)
    own = [both - F.ceil(similarity * F.col(n) - 1e-9) + 1 + F.floor(MORE * F.col(n)) for n in ("size", "s")]
    return F.least(*own)


def _with_one(groups: DataFrame, labels: DataFrame | None, similarity: float, salt: int) -> DataFrame:
    """key, head (key < head) of the pairs of one text of each group with all others that aren't in its component and may be alike."""
    named = cut(_named(groups, labels))
    central = F.col("at") if salt % 2 == 0 else F.lit(0)  # texts with few shingles of their own come early among those that share one
    one = F.min(F.struct(central.alias("first"), F.xxhash64("key", F.lit(salt)).alias("order"), F.col("key").alias("head"), F.col("label").alias("its"), F.col("size").alias("s"))).alias("one")
    heads = cut(named.groupBy("group").agg(one, F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("group", "one.head", "one.its", "one.s"))
    pairs = named.join(heads, "group").filter((F.col("label") != F.col("its")) & (F.least("size", "s") >= similarity * F.greatest("size", "s") - 1e-9))
    counted = pairs.groupBy(F.least("key", "head").alias("key"), F.greatest("key", "head").alias("head")).agg(F.count_if(F.col("at") >= 0).alias("shared"), F.count_if(F.col("at") < 0).alias("coded"), F.min(_shared(similarity)).alias("least"))
    out = cut(counted.filter("coded > 0 OR 4 * shared >= least").select("key", "head"))
    drop(named, heads)
    return out


def _all_left(firsts: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame:
    """key, head (key < head) of the pairs that share as many first shingles as those of ``similarity`` do and are in different components.

    What follows the i-th shingle that two texts share is, in either, all they can share beside the i before: of pairs of
    ``similarity``, the first ones that they share come early in both.
    """
    every = cut(_named(firsts, labels))
    mixed = every.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("shingle")
    named = cut(every.join(mixed, "shingle"))
    other = named.select("shingle", F.col("key").alias("head"), F.col("label").alias("its"), F.col("size").alias("s"), F.col("at").alias("a"))
    enough = 1 + F.floor(MORE * F.least("size", "s"))
    rest = F.least(F.col("size") - F.col("at"), F.col("s") - F.col("a")) >= similarity / (1 + similarity) * (F.col("size") + F.col("s")) - 1e-9 - enough + 1
    near = (F.col("key") < F.col("head")) & (F.col("label") != F.col("its")) & (F.least("size", "s") >= similarity * F.greatest("size", "s") - 1e-9) & rest
    counted = named.join(other, "shingle").filter(near).groupBy("key", "head").agg(F.count(F.lit(1)).alias("shared"), F.min(enough).alias("least"))
    out = cut(counted.filter("shared >= least").select("key", "head"))
    drop(every, named)
    return out


def _links(rows: DataFrame, texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links a, b: those of ``pairs`` (key, head) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            columns = (batch.column(c).to_pylist() for c in ("key", "shingles", "head", "leads"))
            found = [(k, h) for k, a, h, b in zip(*columns, strict=True) if alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in range(2)], ["a", "b"])

    wanted = cut(pairs.select("key").union(pairs.select("head")).distinct().join(texts, "key").select("order.rid"))
    sets = _sets(rows, wanted, words)
    both = pairs.join(sets, "key").join(sets.withColumnsRenamed({"key": "head", "shingles": "leads"}), "head")
    out = cut(both.select("key", "shingles", "head", "leads").mapInArrow(run, "a binary, b binary"))
    drop(wanted, sets)
    return out


def near_links(rows: DataFrame, sketched: DataFrame, texts: DataFrame, words: int, similarity: float, budget: int) -> DataFrame:
    """code, label: components of the texts (key, order, size, codes) that are alike to another one."""
    codes = cut(texts.select("key", "size", F.posexplode("codes").alias("seed", "code")).withColumn("seed", F.col("seed").cast("long")))
    name = lambda c: F.xxhash64("seed", c)
    linked = links(codes.select("seed", "code").distinct(), budget)
    labels = components(linked.select(name("a").alias("a"), name("b").alias("b")))
    marked = codes.withColumn("node", name("code")).join(labels.withColumnRenamed("code", "node"), "node", "left")
    by_code = marked.select(F.coalesce("label", "node").alias("group"), "key", F.lit(-1).alias("at"), "size")
    firsts = _first_shingles(sketched, texts.select("order.rid"), similarity)
    groups = cut(by_code.union(firsts.select(F.col("shingle").alias("group"), "key", "at", "size")))
    drop(codes, linked, labels)
    found, tried, own = [], [], None
    for salt in range(ROUNDS):
        pairs = _with_one(groups, own, similarity, salt)
        new = reduce(lambda left, done: left.join(done, ["key", "head"], "left_anti"), tried, pairs)
        tried.append(cut(new) if tried else pairs)
        found.append(_links(rows, texts, tried[-1], words, similarity))
        own = components(reduce(DataFrame.union, found))
    pairs = reduce(lambda left, done: left.join(done, ["key", "head"], "left_anti"), tried, _all_left(firsts, own, similarity))
    found.append(_links(rows, texts, cut(pairs), words, similarity))
    drop(groups, firsts)
    return components(reduce(DataFrame.union, found))


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, seeds: int = SEEDS, budget: int = NEAR) -> DataFrame:
    """``docs`` with one row of each group of near duplicates."""
    a, b = fresh(docs, "rid"), fresh(docs, "rid2")
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumns({a: F.xxhash64("doc_id", text), b: F.xxhash64(F.lit("second"), text, "doc_id")})
    rows = held.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(a).alias("rid"), F.col(b).alias("rid2"))
    sketched = cut(_sketches(rows, words, similarity, seeds))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2")
    texts = cut(sketched.groupBy("key").agg(F.min(F.struct(order.alias("order"), "size", "codes")).alias("one")).select("key", "one.order", "one.size", "one.codes"))
    alike_to = near_links(rows, sketched, texts, words, similarity, budget)
    ends = texts.select("key", "order").join(alike_to, F.col("key") == F.col("code"), "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("order").alias("order"))
    kept = cut(ends.select(F.col("order.rid").alias(a), F.col("order.rid2").alias(b)))
    ids = sketched.select(F.col("rid").alias(a), F.col("rid2").alias(b))
    # rows that go, or of which there are equal ones; all others stay without a shuffle
    doubtful = cut(ids.join(kept, [a, b], "left_anti").union(ids.groupBy(a, b).count().filter("count > 1").select(a, b)).select(a))
    seen = docs.sparkSession.sparkContext.broadcast(_hashes(doubtful, a))

    @F.arrow_udf("boolean")
    def maybe(rid: pa.Array) -> pa.Array:
        return pa.array(seen.value.has(rid.to_numpy(zero_copy_only=False).view(np.uint64)))

    asked = held.withColumn(fresh(held, "maybe"), maybe(F.col(a)))
    test = F.col(asked.columns[-1])
    own = [col(c) for c in docs.columns]
    staying = asked.filter(~test).select(*own)
    return staying.union(asked.filter(test).join(kept, [a, b], "left_semi").dropDuplicates([a, b]).select(*own))
