"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized tiles in NPY form, difference hashes.

Readable: P1 to P6 with comments, 8 or 16 bits a sample, and uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel, either
way up. Arrays are (height, width, channels). A null or broken image gives null arrays, tiles and hashes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidetrace.llm.common import prepare

_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary PGM of a two-dimensional array of bytes."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A bottom-up BMP of an (h, w) grey or (h, w, 3) RGB array of bytes."""
    height, width = samples.shape[:2]
    grey = samples.ndim == 2
    row = width if grey else 3 * width
    lines = np.zeros((height, -(-row // 4) * 4), np.uint8)
    lines[:, :row] = (samples if grey else samples[:, :, ::-1].reshape(height, row))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + lines.size, 0, 0, start, 40, width, height, 1, 8 if grey else 24, 0, lines.size, 2835, 2835, len(palette), 0) + palette.tobytes() + lines.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("broken header")
        fields.append(int(m[1]))
        at = m.end()
    (width, height), top = fields[:2], fields[2] if len(fields) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if not n or not 0 < top < 65536:
        raise ValueError("broken header")
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n], np.uint8) - 48
    elif kind in (2, 3):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
    elif kind == 4:
        row = -(-width // 8)
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if kind in (1, 4):
        flat = (1 - flat) * 255  # 1 is black
    if len(flat) < n:
        raise ValueError("too few samples")
    return flat.astype(np.uint16 if top > 255 else np.uint8).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    start, header, width, height, _, bits, packed, _, _, _, colours = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    up, height = height > 0, abs(height)
    if packed not in (0, 3) or header < 40 or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("not a plain BMP")
    row = -(-width * bits // 32) * 4
    lines = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    if bits >= 24:
        out = lines[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
        pixels = np.unpackbits(lines, axis=1).reshape(height, -1, bits)
        index = np.packbits(np.pad(pixels, ((0, 0), (0, 0), (8 - bits, 0))), axis=2)[:, :width, 0]
        out = palette[index]
        if (palette == palette[:, :1]).all():
            out = out[:, :, :1]
    return np.ascontiguousarray(out[::-1] if up else out)


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP image."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by differences of an integral image that is linear inside a sample.

    Of the integral image only the rows beside the areas' edges are made, from sums of strips, so memory doesn't grow with
    the image's height.
    """
    h, w = image.shape[:2]
    y, x = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    low = np.minimum(y.astype(np.int64), h - 1)
    cuts = np.unique(np.concatenate([[0], low, low + 1]))
    ends, cuts = np.append(cuts[cuts < h], h), cuts[cuts < h]
    strips = np.zeros((len(ends), w + 1, image.shape[2]))
    strips[1:, 1:] = np.add.reduceat(image, cuts, axis=0, dtype=np.float64).cumsum(axis=0).cumsum(axis=1)
    part = (y - low)[:, None, None]
    rows = strips[np.searchsorted(ends, low)] * (1 - part) + strips[np.searchsorted(ends, low + 1)] * part
    left = np.minimum(x.astype(np.int64), w - 1)
    part = (x - left)[None, :, None]
    corners = rows[:, left] * (1 - part) + rows[:, left + 1] * part
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: of 8 rows of 9 means, whether each is darker than the next."""
    small = area_resize(image, 8, 9).mean(axis=2).round(6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def text_payload(text: str | None) -> bytes:
    """The UTF-8 bytes with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def store_text(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media): each whole text as a PGM 64 samples wide; null texts count as empty."""
    prepare(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[column].to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            media = [encode_pgm(np.frombuffer(text_payload(t), np.uint8).reshape(-1, 64)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias(key), column).mapInArrow(make, f"{key} long, n_bytes long, media binary")


def tiles(images: DataFrame, key: str, column: str = "media", size: int = 8) -> DataFrame:
    """Rows (key, height, width, channels, tile, dhash): the NPY file of each image area-resized to size x size, and its difference hash.

    A null or unreadable image keeps its row, with nulls.
    """
    prepare(images.sparkSession)
    schema = pa.schema([(key, pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string())])

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
        except (ValueError, IndexError, struct.error):
            return (None,) * 5
        return (*image.shape, npy(np.clip(area_resize(image, size, size).round(), 0, np.iinfo(image.dtype).max).astype(image.dtype)), difference_hash(image))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch[column]]
            yield pa.RecordBatch.from_arrays([batch[key], *(pa.array([f[i] for f in found], schema[i + 1].type) for i in range(5))], schema=schema)

    return images.select(F.col(key).cast("long").alias(key), column).mapInArrow(make, f"{key} long, height int, width int, channels int, tile binary, dhash string")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored media say of the texts in them: payload and media digests, the difference hash and the NPY tile, by doc_id.

    A null or broken medium keeps its row, with nulls beside doc_id and n_bytes.
    """
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary(), "tile_sha256": pa.string()}

    def one(media: bytes | None) -> tuple:
        try:
            image = decode(media or b"")
        except (ValueError, IndexError, struct.error):
            return (None,) * len(kinds)
        payload = memoryview(image).cast("B")
        tile = npy(area_resize(image, 8, 8).round().astype(np.uint8))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile, hashlib.sha256(tile).hexdigest()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(media.as_py()) for media in batch["media"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values()))], names=["doc_id", "n_bytes", *kinds])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, tile_sha256 string")
