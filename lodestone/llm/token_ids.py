"""Token ids as packed binary matrices.

Texts are split by a byte-level BPE vocabulary and packed by best-fit decreasing with a segment tree over free room; documents
longer than a row are split without loss. A row has its ids (unsigned 16-bit, little-endian, padded to the row's width), the
cumulative lengths of its segments and the places where positions start again.

Defined results: null text counts as empty; a document without tokens is in no row; equal texts are packed each on its own;
strings of special tokens in a text are ordinary text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import slices, text_rows
from .packing import pack

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this public vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAD = 50_256
#: Tokens that a task packs together.
BLOCK = 4_000_000


def load_ranks(spark: SparkSession, path: str):
    """The vocabulary (a few MB, whatever the corpus) as a broadcast variable."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of 16 bits are asked for")
    return spark.sparkContext.broadcast(ranks)


def token_rows(docs: DataFrame, width: int = 2048, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per packed sequence: row_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids and starts (token offsets in them)."""
    ranks = load_ranks(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_to_numpy

        def packed(ids: list, tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            rows = pack([len(t) for t in tokens], width)
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                matrix = np.full((len(some), width), PAD, "<u2")
                ends = [np.cumsum([0, *(p[2] for p in row)]).tolist() for row in some]
                for line, row, edges in zip(matrix, some, ends, strict=True):
                    for (doc, start, n), at in zip(row, edges, strict=False):
                        line[at : at + n] = tokens[doc][start : start + n]
                columns = [
                    pa.array(range(next_id, next_id + len(some)), pa.int64()),
                    pa.array([e[-1] for e in ends], pa.int32()),
                    pa.array([line.tobytes() for line in matrix], pa.binary()),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
                    pa.array([[ids[p[0]] for p in row] for row in some], pa.list_(pa.int64())),
                    pa.array([[p[1] for p in row] for row in some], pa.list_(pa.int64())),
                ]
                next_id += len(some)
                yield pa.RecordBatch.from_arrays(columns, ["row_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts"])

        ids, tokens, held = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                tokens.append(encode(text, disallowed_special=()).astype("<u2"))
                held += len(tokens[-1])
                if held >= block:
                    yield from packed(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield from packed(ids, tokens)

    return text_rows(docs).mapInArrow(run, "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>")
