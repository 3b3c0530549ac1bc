"""A corpus pipeline of five stages over the table documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.near_dedup import near_dedup
from lodestone.llm.packing import best_fit_packing, word_lengths
from lodestone.llm.quality import keep_good
from lodestone.llm.suffix_dedup import without_repeats


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for, n_chars as the text now has them."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; near copies are left to the next stage."""
    return _measured(line_dedup(docs, min_docs=10, spare_copies=True), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8)."""
    return near_dedup(docs, words=5, similarity=0.8)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes or more that are elsewhere too."""
    return _measured(without_repeats(docs, 200), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents, counted in words."""
    return best_fit_packing(word_lengths(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packing),
]

#: SQL can't express fitted rules, fingerprint components or suffix arrays; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
