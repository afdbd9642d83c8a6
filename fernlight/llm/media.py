"""Media columns: bytes as lossless WebP images, pixel arrays read back from them, and features of those."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .base import id_and_text, rows_of, slices

#: Samples in a row of a stored image, and the unit that payloads are padded to.
WIDTH = 64


def payload(data: bytes) -> bytes:
    """data with zeros up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def store(data: bytes) -> bytes:
    """A payload as one image, or several one after another where it has more rows than a side may have."""
    samples, most = np.frombuffer(data, np.uint8), WIDTH * webp.SIDE
    return b"".join(webp.encode_bytes(samples[at : at + most], WIDTH) for at in range(0, len(samples), most))


def read(media: bytes) -> np.ndarray:
    """The samples of stored media, through the decoder."""
    return np.concatenate([webp.green(webp.decode(image)) for image in webp.images(media)])


def feature(samples: np.ndarray) -> str:
    """rows, mean and standard deviation (thousandths), distinct values, steps between neighbours (sum), zeros."""
    n, x = len(samples), samples.astype(np.int64)
    total, squares = int(x.sum()), int((x * x).sum())
    deviation = int(1000 * np.sqrt(max(0, n * squares - total * total)) / n)
    return f"rows={n // WIDTH};mean={1000 * total // n};sd={deviation};values={np.count_nonzero(np.bincount(samples))};steps={int(np.abs(np.diff(x)).sum())};zeros={n - np.count_nonzero(samples)}"


def to_media(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media (binary): every whole text as UTF-8 in lossless WebP. Null counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            yield rows_of({"doc_id": batch.column("id").to_pylist(), "n_bytes": list(map(len, raw)), "media": [store(payload(r)) for r in raw]}, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def to_pixels(media: DataFrame, *, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """doc_id, width, height and pixels (array<int>, packed ARGB) of any lossless WebP images; null media have null pixels.

    Media that can't be decoded fail the job with the decoder's message.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [None if m is None else webp.decode(m) for m in batch.column("media").to_pylist()]
            yield rows_of(
                {"doc_id": batch.column("id").to_pylist(), "width": [None if p is None else p.shape[1] for p in found], "height": [None if p is None else p.shape[0] for p in found], "pixels": [None if p is None else p.ravel().view(np.int32) for p in found]},
                schema,
            )

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, width int, height int, pixels array<int>")


def digests(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row.

    Payload columns come from the samples read back from the stored form. A null text counts as empty: 64 zeros. Equal
    texts give equal values. Null ids and repeated rows pass through; other columns are ignored; an empty table gives no
    rows; long texts become several images.
    """
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
    schema = pa.schema([("doc_id", pa.int64()), *((n, kinds.get(n, pa.int64())) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                media = store(payload(raw))
                samples = read(media)
                back = samples.tobytes()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield rows_of({"doc_id": batch.column("id").to_pylist()} | {n: list(c) for n, c in zip(names, columns, strict=True)}, schema)

    types = {n: "string" if n in kinds else "long" for n in names}
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t in types.items()))
