"""Retrieval plans: index tables, BM25, vectors, fusion and graph-based scoring.

Statistics of the corpus (document frequency, lengths) are always of the whole index; filters apply to candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators.filters import ranked
from ..operators.joins import loosely_equal
from ..operators.ranking import fuse
from ..sources.files import cut

K1, B = 1.2, 0.75
LIMIT, LEAST_SIMILARITY, PARTICLE_WEIGHT, MOST_PARTICLES, EXPANSION_WEIGHT = 200, 0.35, 0.5, 24, 0.6


def bm25_index(docs: DataFrame, row: str, terms: Column, wanted: Sequence[str] | None = None, prefixes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings (row, dl, term, tf) and corpus totals (one row: n, avgdl).

    With ``wanted`` only postings of those terms are made (with ``prefixes`` of those up to two characters longer, too): each
    text is read once and leaves its length and its matching tokens.
    """
    sized = docs.select(F.col(row).alias("row"), terms.alias("terms")).withColumn("dl", F.size("terms"))
    if wanted is not None:
        listed = list(wanted)
        match = (lambda t: F.lit(False)) if not listed else lambda t: t.isin(*listed)
        if prefixes and listed:
            match = lambda t: t.isin(*listed) | F.exists(F.array(*map(F.lit, listed)), lambda w: F.startswith(t, w) & (F.length(t) - F.length(w) <= 2) & ~F.contains(t, F.lit(" ")))
        sized = cut(sized.select("row", "dl", F.filter("terms", match).alias("terms")))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return sized.select("row", "dl", F.explode("terms").alias("term")).groupBy("row", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), totals


def save_index(index: DataFrame, totals: DataFrame, path: str) -> None:
    """Postings in files of term ranges, sorted by term, so that a query reads the row groups of its terms only."""
    index.repartitionByRange("term", "row").sortWithinPartitions("term", "row").write.parquet(f"{path}/postings")
    totals.coalesce(1).write.parquet(f"{path}/totals")


def load_index(spark: SparkSession, path: str, wanted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The saved postings of some terms, and the totals."""
    return spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(*wanted)), spark.read.parquet(f"{path}/totals")


def bm25(index: DataFrame, totals: DataFrame, weighted: Sequence[tuple[str, float]], k1: float = K1, b: float = B, particles: bool = False) -> DataFrame:
    """row and score. Terms weigh as given, as often as they are given; with ``particles`` index terms of one or two more characters count half."""
    spark = index.sparkSession
    n, average = totals.first()
    query = spark.createDataFrame([(t, float(w)) for t, w in weighted], "q string, weight double")  # the words of one question
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    used = df.join(F.broadcast(query), F.col("term") == F.col("q")).select("term", "df", "weight")
    if particles:
        shorter = F.filter(F.array(*[F.substring("term", F.lit(1), F.length("term") - i) for i in (1, 2)]), lambda p: F.length(p) >= 2)
        longer = df.filter(~F.contains("term", F.lit(" "))).withColumn("q", F.explode(shorter)).join(F.broadcast(query), "q")
        first = ranked(longer.select("q", "term", "df", (F.col("weight") * PARTICLE_WEIGHT).alias("weight")), [F.col("term")], MOST_PARTICLES, ["q"], "_n")
        used = used.unionByName(first.select("term", "df", "weight"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("weight") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(average)))
    terms = used.groupBy("term", "df").agg(F.sum("weight").alias("weight"))
    return index.join(F.broadcast(terms), "term").groupBy("row").agg(F.sum(share).alias("score"))  # a question's terms and 24 more for each


def similarities(vectors: DataFrame, row: str, vector: str, query: Sequence[float]) -> DataFrame:
    """row and score: dot products with a query vector."""
    return vectors.select(F.col(row).alias("row"), dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))


def floored(scores: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Scores below ``least`` count as zero."""
    return scores.withColumn("score", F.when(F.col("score") >= least, F.col("score")).otherwise(0.0))


def top(scores: DataFrame, most: int = LIMIT, digits: int = 6) -> DataFrame:
    """Rows by score (rounded, so that noise in sums breaks no ties), then by row."""
    return ranked(scores.withColumn("score", F.round("score", digits)), [F.desc("score"), F.col("row")], most)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, most: int, block: int = 1024, digits: int = 6) -> DataFrame:
    """query, row, score, rank: the ``most`` vectors of largest dot product with each query, ties by row.

    Both sides are dealt by hash into blocks of about ``block`` rows; each block of queries meets each block of vectors once, as
    a product of matrices that leaves ``most`` rows of each query, so that no more than these are ranked in the end.
    """

    def packed(rows: DataFrame, name: str) -> DataFrame:
        shares = max(1, -(-rows.count() // block))
        dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(shares)).alias(f"{name}_block"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
        return dealt.groupBy(f"{name}_block").agg(F.collect_list(F.struct("k", "v")).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column("asked"), batch.column("held"), strict=True):
                ids, rows = (x.values.field("k").to_numpy(zero_copy_only=False) for x in (asked, held))
                a, b = (np.array(x.values.field("v").to_pylist(), float).reshape(len(x.values), -1) for x in (asked, held))
                scores = np.round(a @ b.T, digits)
                order = np.lexsort((np.broadcast_to(rows, scores.shape), -scores), axis=1)[:, :most]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])), pa.array(rows[order].ravel()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], ["query", "row", "score"])

    asked = packed(queries, "asked")
    held = packed(vectors, "held").withColumn("asked_block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-queries.count() // block)) - 1))))
    pairs = held.withColumn("asked_block", F.col("asked_block").cast("long")).join(asked, "asked_block").select("asked", "held")
    found = pairs.mapInArrow(run, "query long, row long, score double")
    return ranked(found, [F.desc("score"), F.col("row")], most, ["query"])


def hybrid(lexical: DataFrame, dense: DataFrame, candidates: DataFrame | None = None, most: int = LIMIT, least: float | None = None) -> DataFrame:
    """Both rankings of the candidates, fused: row, score, channels, rank."""
    if candidates is not None:
        lexical, dense = (s.join(candidates.select("row"), "row", "left_semi") for s in (lexical, dense))
    if least is not None:
        dense = dense.filter(F.col("score") >= least)
    return fuse({"keyword": top(lexical.filter("score > 0"), most), "vector": top(dense, most)}, "row", most)


def search_page(scores: DataFrame, dense: DataFrame | None, page: int, size: int = 10, most_pages: int = 5, most: int = 100) -> DataFrame:
    """One page of a search: row, rank, score, similarity, via, total, pages, from scores and similarities (row, score) of the candidates.

    The ``most`` best of each channel are fused, similarities below LEAST_SIMILARITY count as none. The total is all rows with a score
    and those of the fused ones that only the vectors found; without vectors similarity is null.
    """
    if not 1 <= page <= most_pages:
        raise ValueError(f"pages are 1 to {most_pages}")
    scores = cut(scores.filter("score > 0"))  # asked three times: the postings are read once
    channels = {"words": top(scores, most)}
    if dense is not None:
        dense = floored(dense)
        channels["meaning"] = top(dense.filter("score > 0"), most)
    fused = cut(fuse(channels, "row", None))  # at most ``most`` rows of each channel
    total = scores.count() + fused.filter("channels = 'meaning'").count()
    pages = min(most_pages, -(-min(total, most_pages * size) // size))
    shown = F.broadcast(fused.filter(F.col("rank").between((page - 1) * size + 1, page * size)).select("row", "rank", F.col("channels").alias("via")))  # one page
    scored = shown.join(scores.join(shown.select("row"), "row", "left_semi").select("row", F.round("score", 2).alias("score")), "row", "left")
    if dense is None:
        scored = scored.withColumn("similarity", F.lit(None).cast("double"))
    else:
        scored = scored.join(dense.join(shown.select("row"), "row", "left_semi").select("row", F.round("score", 3).alias("similarity")), "row", "left")
    return scored.select("row", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), "similarity", "via", F.lit(total).cast("bigint").alias("total"), F.lit(pages).cast("bigint").alias("pages"))


def node_scores(names: DataFrame, keys: DataFrame, least: int = 4) -> DataFrame:
    """id and score: 2 for each equal name (id, key), 1 for each that contains a looked-up key or lies in it (both of ``least`` characters).

    Keys are those of one question and are broadcast: names share few grams, so that a join by them would put most names into a few tasks.
    """
    names, keys = names.repartition("id"), F.broadcast(keys)
    exact = names.join(keys.select(F.col("key").alias("wanted")), F.col("key") == F.col("wanted")).select("id", F.lit(2).alias("score"))
    loose = loosely_equal(names, keys.select(F.col("key").alias("wanted")), "key", "wanted", least).select("id", F.lit(1).alias("score"))
    return exact.unionByName(loose).groupBy("id").agg(F.sum("score").alias("score"))


def report_scores(reports: DataFrame, terms: Column, chosen: DataFrame, query: Sequence[str]) -> DataFrame:
    """report, score: 3 for each chosen node (node_ids) and the occurrences of each query word, 3 at most."""
    by_node = reports.select("report", F.explode("node_ids").alias("id")).join(chosen.select("id"), "id", "left_semi").groupBy("report").agg((F.count(F.lit(1)) * 3).alias("score"))
    words = reports.select("report", F.explode(F.filter(terms, lambda t: t.isin(*query))).alias("term")).groupBy("report", "term").agg(F.least(F.count(F.lit(1)), F.lit(3)).alias("tf"))
    by_word = words.groupBy("report").agg(F.sum("tf").alias("score"))
    return by_node.unionByName(by_word).groupBy("report").agg(F.sum("score").alias("score"))


def code_search(direct: DataFrame, tokens: DataFrame, codes: DataFrame, key: str, words: Sequence[str]) -> DataFrame:
    """Codes by the best of: 0 code, 1 exact, 2 alias (terms of the key), 3 any word among its tokens; with level and code order as rank."""
    exact = direct.filter(F.col("norm") == key).groupBy("record_id").agg(F.min(F.when(F.col("kind") == "code", 0).when(F.col("kind") == "exact", 1).otherwise(2)).alias("priority"))
    related = tokens.filter(F.arrays_overlap("tokens", F.array(*map(F.lit, words)))).select("record_id", F.lit(3).alias("priority")) if words else exact.limit(0)
    hits = exact.unionByName(related).groupBy("record_id").agg(F.min("priority").cast("bigint").alias("priority"))
    return codes.join(hits, "record_id")
