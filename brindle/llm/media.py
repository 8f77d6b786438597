"""Operator 5: media columns in progressive JPEG.

A payload of bytes is stored without loss in the format's own unit, quantised DCT coefficients: byte minus SHIFT, in zigzag order, with quantisation tables of
ones and luma at twice chroma's resolution each way. Reading accumulates the scans (spectral selection and successive approximation) into coefficient arrays,
from which the payload is taken; the inverse transform in numpy and upsampled chroma give the full-resolution RGB tensor. The arithmetic is exact in
integers, so equal payloads give equal files, tensors and features in any batch.

Defined results: a null text counts as empty; payloads are filled up with blanks to a positive multiple of UNIT bytes; a payload of any length is one picture;
repeated rows give equal rows; an empty table gives no rows; columns besides those named don't matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import progressive
from .common import Scratch, pick, slices, small_batches, table

UNIT, SHIFT = 192, 93
#: Rows and text bytes coded at once.
ROWS, BYTES = 400, 1 << 20
#: Parts in which a table's media are written and read back.
PARTS = 2


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def store(texts: list[bytes]) -> list[bytes]:
    """JPEG files of the texts' payloads."""
    pictures = []
    for text in texts:
        payload = padded(text)
        mcus = -(-len(payload) // 384)
        across = math.isqrt(mcus - 1) + 1
        down = -(-mcus // across)
        blocks = np.zeros((6 * across * down, 64), np.int16)
        flat = np.frombuffer(payload, np.uint8).astype(np.int16)
        blocks.reshape(-1)[: len(flat)] = flat - SHIFT
        pictures.append((across, down, blocks, b"bytes %d of %d" % (len(text), len(payload))))
    return progressive.encode(pictures)


def load(files: list[bytes]) -> list[tuple[int, bytes, np.ndarray]]:
    """Unpadded length, payload and RGB tensor of each file."""
    out = []
    for picture in progressive.decode(files):
        _, n, _, size = picture.comment.split()
        payload = np.concatenate([b.reshape(-1) for b in picture.blocks])[: int(size)] + SHIFT
        out.append((int(n), payload.astype(np.uint8).tobytes(), progressive.rgb(picture)))
    return out


def feature(tensor: np.ndarray) -> str:
    """Shape, channel means and deviations, and eight luma shares."""
    flat = tensor.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    sums, squares = flat.sum(0), (flat * flat).sum(0)
    luma = (flat @ np.array([299, 587, 114])) // 1000
    bins = np.bincount(luma >> 5, minlength=8)
    means = ",".join(f"{s / n:.3f}" for s in sums.tolist())
    spreads = ",".join(f"{math.sqrt(max(0, q * n - s * s)) / n:.3f}" for s, q in zip(sums.tolist(), squares.tolist()))
    return f"{tensor.shape[0]}x{tensor.shape[1]};{means};{spreads};" + ",".join(f"{b / n:.4f}" for b in bins.tolist())


def _bytes(part: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]


def _map(df: DataFrame, column: str, schema: str, keep: tuple[str, ...], names: list[str], work) -> DataFrame:
    df = pick(df, *keep, column)
    schema = f"{', '.join(f'`{k}` {df.schema[k].dataType.simpleString()}' for k in keep)}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, ROWS, BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *work(_bytes(part, column))], [*keep, *names])

    return small_batches(df).mapInArrow(run, schema)


def stored(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and media: the text as a JPEG file."""
    return _map(df, column, "media binary", keep, ["media"], lambda texts: [pa.array(store(texts), pa.binary())])


def loaded(df: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, payload, and the tensor: height, width and rgb, height * width * 3 bytes."""

    def work(files: list[bytes]) -> list[pa.Array]:
        found = load(files)
        return [pa.array([p for _, p, _ in found], pa.binary()), pa.array([x.shape[0] for _, _, x in found], pa.int32()), pa.array([x.shape[1] for _, _, x in found], pa.int32()), pa.array([x.tobytes() for _, _, x in found], pa.binary())]

    return _map(df, column, "payload binary, height int, width int, rgb binary", keep, ["payload", "height", "width", "rgb"], work)


def measured(df: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, and what stored files come to: all of it is taken from the file."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def work(files: list[bytes]) -> list[pa.Array]:
        rows = [(n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature(x)) for f, (n, p, x) in zip(files, load(files))]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]

    return _map(df, column, schema, keep, names, work)


def digests(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",), parts: int = PARTS) -> DataFrame:
    """keep, and what the files of texts come to: they are written as a media column, and read back from there. The rows are taken in parts, told by a hash of all that is kept, so that the media of one part at a
    time are on disk."""
    scratch, df = Scratch(df.sparkSession), pick(df, *keep, column)
    part, done = F.pmod(F.xxhash64(*df.columns), F.lit(parts)), []
    for number in range(parts):
        media = scratch.keep(stored(df.filter(part == number), column, keep), f"media-{number}")
        done.append(scratch.keep(measured(media, "media", keep), f"digests-{number}"))
        scratch.drop(f"media-{number}")
    return reduce(DataFrame.unionByName, done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
