"""Texts as media columns: lossless WebP images that are written, read back and described.

A text's UTF-8 bytes, padded with blanks to whole rows of 64 RGB pixels, become an image of 64
columns; more than 64 rows become the frames of an animation, strip by strip, so images of any
size decode in parallel lanes of bounded memory. Every strip is written with the colour cache, palette,
predictor, cross-colour or subtract-green transform that its pixels ask for, if any. The files are
stored as a table in the shared folder and read back from there.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import webp
from lodestar.llm.shared import read, scratch

ROW = 192
WIDTH = 64
STRIP = 64
#: Up to so many bytes of payload are coded at once (a single larger text is cut by frames).
BLOCK = 6 << 20


def padded(data: bytes) -> bytes:
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def pixels(payload: bytes) -> np.ndarray:
    rgb = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH, 3).astype(np.uint32)
    return np.uint32(0xFF000000) | rgb[..., 0] << np.uint32(16) | rgb[..., 1] << np.uint32(8) | rgb[..., 2]


def samples(argb: np.ndarray) -> bytes:
    return np.ascontiguousarray(argb.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()


def _grouped(sizes: list[int]):
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and (end == at or held + sizes[end] <= BLOCK):
            held += sizes[end]
            end += 1
        yield at, end
        at = end


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A WebP file of every payload (each a positive multiple of 192 bytes)."""
    strips, counts = [], []
    for p in payloads:
        image = pixels(p)
        cut = [image[y : y + STRIP] for y in range(0, len(image), STRIP)]
        strips += cut
        counts.append(len(cut))
    streams = []
    for at in range(0, len(strips), webp.MAX_LANES):
        streams += webp.encode_best(strips[at : at + webp.MAX_LANES])
    out, at = [], 0
    for n in counts:
        out.append(webp.wrap(streams[at : at + n], WIDTH, [len(s) for s in strips[at : at + n]]))
        at += n
    return out


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """The (height, 64) ARGB pixels of every file, frames one below the other."""
    streams = [webp.unwrap(f) for f in files]
    images = webp.decode_images([s for own in streams for s in own])
    out, at = [], 0
    for own in streams:
        out.append(np.concatenate(images[at : at + len(own)]) if len(own) > 1 else images[at])
        at += len(own)
    return out


def describe(argb: np.ndarray) -> str:
    """Height, mean red, green and blue in hundredths, and an 8 x 8 average hash of the brightness."""
    parts = [(argb >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 8, 0)]
    light = sum(parts)
    rows = np.arange(9) * len(argb) // 8
    cells = np.array([light[min(a, len(argb) - 1) : max(b, min(a, len(argb) - 1) + 1)].reshape(-1, 8, WIDTH // 8).sum(axis=(0, 2)) * 1000 // max(b - a, 1) for a, b in zip(rows, rows[1:])])
    bits = "".join("1" if 64 * c > cells.sum() else "0" for c in cells.ravel())
    return ":".join([str(len(argb)), *(str(int(p.sum()) * 100 // p.size) for p in parts), f"{int(bits, 2):016x}"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for every row of (doc_id, text).

    Null text is empty, an empty text one row of blanks; a text of any length is one file; repeated
    rows have equal files; no other column is looked at; an empty table gives an empty one.
    """
    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _grouped([len(t) for t in texts]):
                files = encode_payloads([padded(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], type=pa.int64()), pa.array(files, type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """The digest of every row of (doc_id, n_bytes, media), computed from what its file decodes to.

    Equal files give equal values, repeated rows are repeated, a null doc_id stays null; a file that is no lossless
    WebP is an error.
    """
    def run(batches):
        for batch in batches:
            files, sizes = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for a, b in _grouped(sizes):
                rows = []
                for file, argb in zip(files[a:b], decode_files(files[a:b])):
                    payload = samples(argb)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), describe(argb)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    store(read(spark, sf_dir, "documents")).write.option("compression", "none").parquet(folder)
    return load(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(folder))
