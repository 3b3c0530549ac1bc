"""Spelling variant grouping: one-edit pairs of words by merging an errata trie along heavy paths.

The words that occur often enough form a trie. At each node the child with most words below is heavy, the others are light, so
that a word has at most log2(words) light edges. At a node where a word's edge is light, or where the word ends, its rest is merged into the
larger side with one character treated as an error: replaced by the heavy one, skipped, or with the heavy one put before it.
The merged word is kept as the hash of its whole spelling. Where it meets the terminal of a word, or another light word
that was merged at the same node, the two differ by one edit:

- u = a·c·b and w = a·b (no c at the start of b): if c is light at a, u skips it; if it is heavy, w is light at a or ends there
  and gets it inserted;
- u = a·c·b and w = a·e·b: the light one gets the heavy character and meets the other, or both are light and meet each other.

So each pair is found once, and candidates are compared as strings before they count. The trie is not built in one place: its nodes are
hashes of prefixes (rolling, in numpy, linear in a word's length), sizes are counts by node and character, and merging is a join on
hashes. Nodes on the paths of very many words are joined by broadcast: at most HOT of them, whatever the corpus. Chains of forms are followed by
doubling, each n at least ``times`` the one before, so that few rounds do.

Words are counted by Spark before anything is shuffled. A word is carried along whole with its few merged spellings only, so very
long words stay linear.

Defined results: null text has no words; a null doc_id counts as an empty string in the hash, ids of other types as their
text; repeated rows count again; a run of one character whose only character is deleted is no word; ties of n go to the
smallest word in code-point order; a word without near words is its own root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, mix, slices

#: What a run is.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: At most so many nodes are joined by broadcast: those that every HOT-th step from node to node or more goes through.
HOT = 20_000
#: The odd number whose powers weigh the characters of a prefix, and its inverse, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
END = -1


def word_counts(docs: DataFrame, least_points: int = 6, least_n: int = 5, one_in: int = 199) -> DataFrame:
    """word and n: runs with A-Z lower-cased, one code point gone from one in ``one_in`` runs of a document, that are long and frequent enough."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_points)  # shorter ones get no longer
    hashed = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    k = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_points)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def weight(points: np.ndarray) -> np.ndarray:
    """What a character counts in a hash."""
    return mix(points.astype(np.uint64) + np.uint64(1))


class Hashes:
    """Rolling hashes of words: ``prefix`` has the words' prefix hashes one after another, each from the empty one (at ``start``) to the whole word's."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.word = np.repeat(np.arange(len(words)), self.lengths + 1)
        self.start = np.concatenate([[0], np.cumsum(self.lengths + 1)])[:-1]
        self.depth = np.arange(len(self.word)) - self.start[self.word]
        factors = np.full(int(self.lengths.max(initial=0)) + 2, BASE, np.uint64)
        factors[0] = 1
        self.powers = np.cumprod(factors, dtype=np.uint64)
        self.char = np.full(len(self.word), END, np.int64)
        self.char[self.depth < self.lengths[self.word]] = self.points
        terms = np.where(self.char == END, np.uint64(0), weight(self.char.astype(np.uint64)) * self.powers[self.depth])
        sums = np.cumsum(terms, dtype=np.uint64) - terms
        self.prefix = sums - sums[self.start][self.word]
        self.whole = self.prefix[self.start + self.lengths]

    def nodes(self) -> np.ndarray:
        return mix(self.prefix + self.depth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def steps(words: DataFrame) -> DataFrame:
    """id, depth, node (hash of the prefix) and char (END where the word ends) of every node on the words' paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            h = Hashes(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy()
            out = pa.RecordBatch.from_arrays([pa.array(ids[h.word]), pa.array(h.depth), _long(h.nodes()), pa.array(h.char)], ["id", "depth", "node", "char"])
            for k in range(0, out.num_rows, 20_000):
                yield out.slice(k, 20_000)

    return words.select("id", "word").mapInArrow(run, "id long, depth long, node long, char long")


def light_edges(words: DataFrame) -> DataFrame:
    """id and edges: the nodes (depth, and the heavy child's char) at which a word is light or ends above others; at most log2 of the number of words and one."""
    walked = steps(words)
    size = walked.groupBy("node", "char").agg(F.count(F.lit(1)).alias("size"))
    largest = F.max(F.struct(F.when(F.col("char") == END, 0).otherwise(F.col("size")).alias("s"), F.col("char").alias("c")))
    branching = cut(size.groupBy("node").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("children"), largest["c"].alias("heavy")).filter("children > 1").drop("children"))
    per_hot = (words.agg(F.sum(F.length("word") + 1)).first()[0] or 0) / HOT
    hot = F.broadcast(branching.filter(F.col("total") > per_hot).select("node", F.col("heavy").alias("hot")))
    rest = branching.filter(F.col("total") <= per_hot).select("node", "heavy").hint("merge")
    marked = walked.join(hot, "node", "left")
    at = F.struct("depth", "heavy").alias("edge")
    above = marked.filter("hot IS NOT NULL AND char <> hot").select("id", F.struct("depth", F.col("hot").alias("heavy")).alias("edge"))
    below = marked.filter("hot IS NULL").join(rest, "node").filter("char <> heavy").select("id", at)
    out = cut(above.union(below).groupBy("id").agg(F.collect_list("edge").alias("edges")))
    drop(branching)
    return out


def merged(words: DataFrame, edges: DataFrame) -> DataFrame:
    """word, n, key (hash of the merged spelling) and depth (of the node, where a character was replaced; else null) for each light edge."""
    held = words.join(edges.hint("merge"), "id").select("word", "n", F.col("edges.depth").alias("depths"), F.col("edges.heavy").alias("heavy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            h = Hashes(batch.column(0).to_pylist())
            many = np.array([len(x) for x in batch.column(2)], np.int64)
            of = np.repeat(np.arange(len(many)), many)
            depth, heavy = (c.flatten().to_numpy().astype(np.int64) for c in batch.columns[2:])
            at = h.start[of] + depth
            before, whole, power = h.prefix[at], h.whole[of], h.powers[depth]
            put = weight(heavy.astype(np.uint64)) * power
            ends = h.char[at] == END
            inserted = before + put + (whole - before) * np.uint64(BASE)
            following = np.minimum(at + 1, len(h.char) - 1)
            after = np.where(ends, before, h.prefix[following])
            replaced = before + put + (whole - after)
            skipped = before + (whole - after) * np.uint64(INVERSE)
            last = ~ends & (h.char[following] != h.char[at])  # of a run of one character only the last is skipped
            rows = np.concatenate([of, of[~ends], of[last]])
            keys = np.concatenate([inserted, replaced[~ends], skipped[last]])
            depths = np.concatenate([np.full(len(of), -1), depth[~ends], np.full(int(last.sum()), -1)])
            take = pa.array(rows)
            out = pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), _long(keys), pa.array(depths, mask=depths < 0)], ["word", "n", "key", "depth"])
            for k in range(0, out.num_rows, 2000):
                yield out.slice(k, 2000)

    return held.mapInArrow(run, "word string, n long, key long, depth long")


def terminals(words: DataFrame) -> DataFrame:
    """word, n and key (hash of the word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            yield pa.RecordBatch.from_arrays([*batch.columns, _long(Hashes(batch.column(0).to_pylist()).whole)], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words that one inserted, deleted or replaced code point tells apart, once; from id, word, n (a written table)."""
    edges = light_edges(words)
    light = cut(merged(words, edges))
    drop(edges)
    side = lambda df, s, *more: df.select(F.col("word").alias(s), F.col("n").alias(f"n_{s}"), *more)
    met = side(light, "a", "key").join(side(terminals(words), "b", "key"), "key").drop("key")
    replaced = light.filter("depth IS NOT NULL")
    siblings = side(replaced, "a", "key", "depth").join(side(replaced, "b", "key", "depth"), ["key", "depth"]).filter("a < b").drop("key", "depth")
    return met.union(siblings).filter(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of its chain, from word and form (not null)."""
    found = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while found.filter("moved").limit(1).count():
        next_ = found.select(F.col("word").alias("root"), F.col("root").alias("beyond")).hint("merge")
        further = F.coalesce("beyond", "root")
        before, found = found, cut(found.join(next_, "root", "left").select("word", further.alias("root"), F.col("beyond").isNotNull().alias("moved")))
        drop(before)
    return found.drop("moved")


def spelling_variants(docs: DataFrame, least_points: int = 6, least_n: int = 5, one_in: int = 199, times: int = 5) -> DataFrame:
    """word, form (its most frequent near word, if ``times`` as frequent or more), root, n, n_near, form_n of every word that is long and frequent enough."""
    words = cut(word_counts(docs, least_points, least_n, one_in).withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"))
    pairs = near_pairs(words)
    both: Column = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    first = F.min(F.struct((-F.col("m")).alias("less"), "near"))
    near = cut(pairs.select(F.explode(both).alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first["near"].alias("best"), (-first["less"]).alias("best_n")))
    enough = F.col("best_n") >= times * F.col("n")
    rows = cut(words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")))
    drop(near)
    ends = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
