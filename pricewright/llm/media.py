"""Media columns: baseline JPEG bytes with sizes, DC thumbnails and their hashes.

``store_payloads`` keeps a text's bytes losslessly as the DC samples of JPEG blocks
and reads the stored bytes back; ``read_media`` does the reading for any column of
JPEG files. Both work on one Arrow batch at a time, in parts of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .common import text_or_empty

#: Bytes that one part of a batch may have, unless one row alone has more.
PART_BYTES = 2 << 20
HASH_SIDE = 8

FEATURES = T.StructType(
    [
        T.StructField("images", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("thumbnail", T.BinaryType()),
        T.StructField("thumbnail_hash", T.StringType()),
    ]
)


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits, as hex: which cells of an 8 x 8 grid are lighter than the mean."""
    for axis in (0, 1):
        n = thumbnail.shape[axis]
        edges = np.arange(HASH_SIDE) * n // HASH_SIDE
        widths = np.maximum(np.diff(np.append(edges, n)), 1)
        sums = np.add.reduceat(thumbnail, edges, axis=axis, dtype=np.float64)
        thumbnail = sums / (widths[:, None] if axis == 0 else widths)
    bits = np.packbits(thumbnail > thumbnail.mean())
    return bits.tobytes().hex()


def _features(found) -> tuple:
    """Images, width, height (in all), thumbnail samples and hash; nulls if the file
    could not be read."""
    if found is None:
        return None, None, None, None, None
    width = max(w for w, _, _ in found)
    height = sum(h for _, h, _ in found)
    if len({t.shape[1] for *_, t in found}) == 1:
        grid = np.concatenate([t for *_, t in found])
        digest = average_hash(grid)
    else:
        digest = "".join(average_hash(t) for *_, t in found)
    return len(found), width, height, b"".join(t.tobytes() for *_, t in found), digest


def _parts(column: pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of values whose bytes stay under ``PART_BYTES``: (first row, values)."""
    first, part, size = 0, [], 0
    for i, value in enumerate(column):
        value = value.as_py()
        n = len(value) if value else 0
        if part and size + n > PART_BYTES:
            yield first, part
            first, part, size = i, [], 0
        part.append(value)
        size += n
    if part:
        yield first, part


def _media_batches(batches: Iterable[pa.RecordBatch], name: str, store: bool, schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [n for n in batch.schema.names if n != name or not store]
        for first, values in _parts(batch[name]):
            if store:
                padded = [v + b"\0" * (-len(v) % jpeg.ROW if v else jpeg.ROW) for v in (v or b"" for v in values)]
                files = jpeg.encode(padded)
            else:
                files = values
            features = list(zip(*map(_features, jpeg.thumbnails(files)), strict=True))
            own = [batch[n].slice(first, len(values)) for n in kept]
            if store:
                own.append(pa.array(files, pa.binary()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            own += [pa.array(c, k) for c, k in zip(features, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(own, names=schema.names)


def read_media(files: DataFrame, column: str = "media") -> DataFrame:
    """Append the media features (images, width, height, thumbnail, thumbnail_hash)
    of a binary column of baseline JPEG. A null or unreadable file has null features.
    Other columns are kept, but those that have the features' names.
    """
    kept = [f for f in files.schema.fields if f.name not in FEATURES.names or f.name == column]
    files = files.select(*[f.name for f in kept])
    schema = T.StructType([*kept, *FEATURES.fields])
    return files.mapInArrow(lambda b: _media_batches(b, column, False, schema), schema)


def store_payloads(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Replace a binary column by ``media``, the JPEG that stores it, and the
    features of that JPEG as read back from its bytes. The thumbnail is the payload
    with bytes 0 up to a positive multiple of 64. Null counts as empty. Other columns are
    kept, but those that have the new ones' names."""
    kept = [f for f in rows.schema.fields if f.name not in (column, "media", *FEATURES.names)]
    rows = rows.select(column, *[f.name for f in kept])
    schema = T.StructType([*kept, T.StructField("media", T.BinaryType()), *FEATURES.fields])
    return rows.mapInArrow(lambda b: _media_batches(b, column, True, schema), schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, media and its features, one row per row.

    Null and empty text: 64 bytes 0. Null doc_id and repeated rows: kept as they
    are. Very long texts: several images in one media value. Empty table: no rows.
    Further columns of ``docs`` are ignored.
    """
    payload = text_or_empty().cast("binary")
    return store_payloads(
        docs.select("doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), payload.alias("payload"))
    )


def op2(spark, sf_dir):
    media = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%dx%d:%s", "images", "width", "height", "thumbnail_hash").alias("feature"),
        "width",
        "height",
    )
