"""Image items: files, bytes or URLs, decoded to RGB; rows that can't be used are left out and counted."""

from __future__ import annotations

import struct
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import counted, ordinals, require

Decoder = Callable[[bytes], np.ndarray | None]


def image_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("asset_id"), F.col("content").alias("image"))


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Rows x columns (x channels) as three channels: grey is repeated, alpha is dropped."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]


def decode_netpbm(data: bytes) -> np.ndarray | None:
    """Binary grey (P5) and colour (P6) images of 8 bits."""
    fields = data.split(maxsplit=4)
    if len(fields) < 4 or fields[0] not in (b"P5", b"P6") or not all(x.isdigit() for x in fields[1:4]) or fields[3] != b"255":
        return None
    width, height, depth = int(fields[1]), int(fields[2]), 3 if fields[0] == b"P6" else 1
    at = data.index(fields[3], data.index(fields[2], data.index(fields[1], 2) + len(fields[1])) + len(fields[2])) + 4
    body = data[at : at + width * height * depth]
    return rgb(np.frombuffer(body, np.uint8).reshape(height, width, depth)) if len(body) == width * height * depth and body else None


def decode_png(data: bytes) -> np.ndarray | None:
    """PNG of 8 bits without interlacing: grey, RGB, palette, each with or without alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, palette, head = 8, b"", None, None
    try:
        while at < len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            body, at = data[at + 8 : at + 8 + size], at + 12 + size
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed += body
        width, height, bits, colour, _, _, interlaced = head
        depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if bits != 8 or interlaced:
            return None
        lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * depth)
        pixels = _unfiltered(lines[:, 0], lines[:, 1:].reshape(height, width, depth))
        return palette[pixels[:, :, 0]] if colour == 3 else rgb(pixels)
    except (struct.error, zlib.error, ValueError, KeyError, TypeError, IndexError):
        return None


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines as sums of what is stored and of what their kind predicts from left, above, and both."""
    out = np.zeros((lines.shape[0] + 1, lines.shape[1] + 1, lines.shape[2]), np.int64)
    for y, kind in enumerate(kinds.tolist()):
        line, above = lines[y].astype(np.int64), out[y]
        if kind < 2:
            out[y + 1, 1:] = np.cumsum(line, axis=0) % 256 if kind else line
        elif kind == 2:
            out[y + 1, 1:] = (line + above[1:]) % 256
        elif kind < 5:
            for x in range(len(line)):
                left, up, corner = out[y + 1, x], above[x + 1], above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    far = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
                out[y + 1, x + 1] = (line[x] + guess) % 256
        else:
            raise ValueError(f"no line of kind {kind}")
    return out[1:, 1:].astype(np.uint8)


def decode(data: bytes) -> np.ndarray | None:
    """RGB of the formats that need no library; any other decoder can be given to image_items."""
    return decode_png(data) if data[:1] == b"\x89" else decode_netpbm(data)


def fetch(url: str, timeout: float) -> bytes | None:
    """What a URL holds; any failure on the way there makes the row one that can't be used."""
    try:
        answer = urllib.request.urlopen(url, timeout=timeout)
    except (OSError, ValueError):
        return None
    with answer:
        return answer.read()


def image_items(df: DataFrame, column: str, id_column: str | None = None, order: str | None = None, decoder: Decoder | None = decode, seen: Observation | None = None, timeout: float = 10.0, workers: int = 16) -> DataFrame:
    """asset_id, image (bytes) and, with a decoder, width, height and pixels (RGB, line by line).

    The column holds URLs, bytes or structs with `bytes`. The id is the id column, else the URL, else with a column that
    rows are ordered by the place in that order, else (unknown). What can't be fetched or decoded is skipped; an
    observation gets the numbers of rows written and skipped.
    """
    require(df, column, *([id_column] if id_column else []), *([order] if order else []))
    df = ordinals(df, order) if order else df
    kind = dict(df.dtypes)[column]
    own = [F.col(id_column).cast("string")] if id_column else []
    own += [F.col(column)] if kind == "string" else []
    own += [F.col("ordinal").cast("string")] if order else []
    image = F.col(f"{column}.bytes") if kind.startswith("struct") else F.col(column)
    rows = df.select(F.coalesce(*own, F.lit("(unknown)")).alias("asset_id"), image.cast("binary").alias("image"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                images = batch.column("image").to_pylist()
                if kind == "string":
                    images = list(pool.map(lambda u: None if u is None else fetch(u.decode(), timeout), images))
                found = [None if i is None or decoder is None else decoder(i) for i in images]
                columns = [batch.column("asset_id"), pa.array([None if decoder and p is None else i for i, p in zip(images, found, strict=True)], pa.binary())]
                columns += [pa.array([None if p is None else p.shape[n] for p in found], pa.int32()) for n in (1, 0)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([None if p is None else p.astype(np.uint8).tobytes() for p in found], pa.binary())], ["asset_id", "image", "width", "height", "pixels"])

    out = counted(rows.mapInArrow(run, "asset_id string, image binary, width int, height int, pixels binary"), F.col("image").isNotNull(), seen)
    return out if decoder else out.select("asset_id", "image")
