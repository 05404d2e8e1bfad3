"""PNG images in binary columns: zlib chunks with checksum tests, numpy unfiltering, low-frequency cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import CHUNK_BYTES, text_chunks, text_of

# Fixed values of the PNG format: signature, and samples per pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class BadImage(ValueError):
    """The bytes are no PNG image that this module reads, or are damaged."""


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit image of pixels, height x width for grey or height x width x channels. Each row takes the filter (none, left
    or up) whose residuals have the least sum of magnitudes."""
    height, width = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(height, width * channels)
    left, up = rows.copy(), rows.copy()
    left[:, channels:] -= rows[:, :-channels]
    up[1:] -= rows[:-1]
    options = np.stack([rows, left, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((height, width * channels + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = options[best, np.arange(height)]
    kind = {n: k for k, n in CHANNELS.items()}[channels]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def unfilter(raw: np.ndarray, channels: int) -> np.ndarray:
    """Samples of filtered rows; the first byte of each row names its filter."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    height, n = rows.shape
    if height and kinds.max() > 4:
        raise BadImage("unknown filter")
    y = 0
    while y < height:
        kind = kinds[y]
        stop = y + 1
        while stop < height and kinds[stop] == kind:
            stop += 1
        part = rows[y:stop]
        above = rows[y - 1] if y else np.zeros(n, np.uint8)
        if kind == 1:
            part[:] = np.cumsum(part.reshape(stop - y, -1, channels), axis=1, dtype=np.uint8).reshape(stop - y, n)
        elif kind == 2:
            part[0] += above
            part[:] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif kind >= 3:
            for row in part:
                mend(row, above, channels, paeth=kind == 4)
                above = row
        y = stop
    return rows


def mend(row: np.ndarray, above: np.ndarray, channels: int, paeth: bool) -> None:
    """Adds to each sample the mean of left and up, or whichever of left, up and corner is nearest to left + up - corner."""
    up = above.astype(np.int32).reshape(-1, channels)
    out = row.reshape(-1, channels)
    left = corner = np.zeros(channels, np.int32)
    for x in range(len(out)):
        if paeth:
            goal = left + up[x] - corner
            far = np.abs(np.stack([left, up[x], corner]) - goal)
            guess = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up[x], corner))
        else:
            guess = (left + up[x]) // 2
        out[x] = (out[x] + guess) & 255
        left, corner = out[x].astype(np.int32), up[x]


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit image without interlacing. Raises BadImage on a wrong signature, checksum, size or order."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadImage("cut off")
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + length]
        if len(part) < length or len(data) < at + 12 + length or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise BadImage("checksum")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + length
    if header is None or not ended or header[2] != 8 or header[3] not in CHANNELS or header[4:] != (0, 0, 0):
        raise BadImage("unsupported or incomplete")
    width, height, channels = header[0], header[1], CHANNELS[header[3]]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BadImage("damaged data") from e
    if len(raw) != height * (width * channels + 1):
        raise BadImage("size")
    rows = unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels)
    return rows if channels == 1 else rows.reshape(height, width, channels)


@cache
def shrink(n: int, to: int) -> np.ndarray:
    """Weights that average n samples down, or spread them out, to a number of equal shares."""
    edges = np.linspace(0, n, to + 1)
    cell = np.arange(n)
    share = np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell)
    return np.clip(share, 0, None) * (to / n)


@cache
def cosines(size: int, kept: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(kept)[:, None] * (2 * np.arange(size) + 1) / (2 * size))


def cosine_hash(pixels: np.ndarray, size: int = 32, kept: int = 8) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine coefficients of the shrunken grey image are above their median. The mean
    brightness, the first, is left out of the median."""
    grey = pixels.astype(np.float64) if pixels.ndim == 2 else pixels[..., : 3 if pixels.shape[2] >= 3 else 1].mean(axis=2)
    small = shrink(grey.shape[0], size) @ grey @ shrink(grey.shape[1], size).T
    low = (cosines(size, kept) @ small @ cosines(size, kept).T).ravel().round(6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_pixels(payload: bytes, unit: int = 24) -> np.ndarray:
    """A grey image of a payload of whole 24 x 24 tiles; as near to a square as the number of tiles lets it be."""
    tiles = len(payload) // (unit * unit)
    across = next(k for k in range(int(tiles**0.5), 0, -1) if tiles % k == 0)
    return np.frombuffer(payload, np.uint8).reshape(-1, unit * across)


def store_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 576, level: int = 1) -> DataFrame:
    """Texts as PNG images in a binary column: id, n_bytes, media.

    The UTF-8 bytes of the text are filled with 255 up to a positive multiple of block and become the samples of a grey image.
    Nulls: a null id stays null, a null text counts as empty and gives one block. Repeated rows give repeated rows, an empty
    table an empty result; other columns aren't read. Very long texts are stored whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_chunks(batches, "text", CHUNK_BYTES):
            media = [encode_png(to_pixels(r + b"\xff" * (-len(r) % block if r else block)), level) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def image_features(images: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """What the stored bytes hold: id, the columns of keep, width, height, payload_bytes, payload_sha256, tail_crc32 (of the last
    32 samples), media_bytes, media_sha256, feature (the cosine hash) and error.

    A null or damaged image has null features and its error's text; good ones have a null error. A null id stays null; repeated rows give
    repeated rows and equal values; an empty table gives an empty result; only the columns named are read. A task decodes about
    CHUNK_BYTES of stored images, or one image of any size, at a time.
    """

    def look(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None, None, None, "null"
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            pixels = decode_png(data)
        except BadImage as e:
            return None, None, None, None, None, *stored, None, str(e)
        payload = pixels.tobytes()
        return pixels.shape[1], pixels.shape[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, cosine_hash(pixels) if payload else None, None

    fields = [("width", pa.int32()), ("height", pa.int32()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stored in text_chunks(batches, media_col, CHUNK_BYTES):
            there = batch.column(batch.num_columns - 1).is_valid().to_pylist()
            found = [look(m if ok else None) for m, ok in zip(stored, there, strict=True)]
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *(n for n, _ in fields)])

    rows = images.select(id_col, *keep, media_col)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{own}, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
