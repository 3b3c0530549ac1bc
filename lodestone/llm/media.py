"""Media columns: payloads stored as progressive JPEG, decoded to coefficients and full-resolution RGB tensors.

A text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64, become the coefficients of an image, 64 to a
block, so that nothing is lost; the file is decoded from its stored bytes alone.

Defined results: null text counts as empty (one block of zeros); equal texts have equal media; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import slices, text_rows


def padded(text: str) -> bytes:
    data = text.encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (a JPEG file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            texts = batch.column(1).to_pylist()
            media = [jpeg.encode_payload(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(rows: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes and media with payload, feature (sizes, means and deviations of the RGB tensor), height, width and rgb (the tensor, by rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            images = [jpeg.decode(m) for m in batch.column("media").to_pylist()]
            rgb = [i.rgb() for i in images]
            features = []
            for x in rgb:
                flat = x.reshape(-1, 3)
                features.append(" ".join([f"{x.shape[0]}x{x.shape[1]}", *(f"{v:.3f}" for v in (*flat.mean(axis=0), *flat.std(axis=0)))]))
            columns = [*batch.columns, pa.array([jpeg.read_payload(i) for i in images], pa.binary()), pa.array(features), pa.array([x.shape[0] for x in rgb], pa.int32()), pa.array([x.shape[1] for x in rgb], pa.int32())]
            names = [*batch.schema.names, "payload", "feature", "height", "width"]
            if tensors:
                columns, names = [*columns, pa.array([x.tobytes() for x in rgb], pa.binary())], [*names, "rgb"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, media binary, payload binary, feature string, height int, width int"
    return rows.select("doc_id", "n_bytes", "media").mapInArrow(run, schema + ", rgb binary" * tensors)


def digests(decoded: DataFrame) -> DataFrame:
    """The contract's columns, from stored and read-back bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            media, payload = batch.column("media").to_pylist(), batch.column("payload").to_pylist()
            columns = [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(p) for p in payload], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                pa.array([zlib.crc32(p[-64:]) for p in payload], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                batch.column("feature"),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return decoded.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
