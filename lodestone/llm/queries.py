"""The queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format as chats
from . import fill_in_middle as middles
from . import license_scan as licenses
from . import line_dedup as lines
from . import sentencepiece_codec as pieces
from . import suffix_dedup as suffixes
from . import media
from .common import table
from .exact_dedup import exact_dedup
from .packing import best_fit_packing, word_lengths
from .quality import score_quality
from .simhash import simhash_dedup
from .spelling import spelling_variants
from .token_ids import token_rows


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and the digest of the text that the ids decode to."""
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.chat_format(table(spark, sf_dir, "conversations"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.suffix_dedup(table(spark, sf_dir, "documents"), 200))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.decode_media(media.encode_media(table(spark, sf_dir, "documents")), tensors=False))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), words=3, budget=2)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"), width=2048)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(word_lengths(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middles.digest(middles.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_chat_format": op2_chat_format, "op3_suffix_dedup": op3_suffix_dedup, "op4_exact_dedup": op4_exact_dedup, "op5_media": op5_media, "op6_simhash": op6_simhash, "op7_quality": op7_quality, "op8_token_ids": op8_token_ids, "op9_line_dedup": op9_line_dedup, "op10_best_fit_packing": op10_best_fit_packing, "op11_fill_in_middle": op11_fill_in_middle, "op12_license_scan": op12_license_scan, "op13_spelling_variants": op13_spelling_variants}

SQL = {
    "op2_chat_format": chats.SQL,
    "op9_line_dedup": lines.SQL,
    "op11_fill_in_middle": middles.SQL,
    "op12_license_scan": licenses.sql(),
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        k AS (SELECT doc_id, length(text) AS n, sha256(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) AS text_sha256 FROM t)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
}
