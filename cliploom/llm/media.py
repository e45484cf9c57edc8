"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes.

A text's UTF-8 bytes are padded with 255 to a multiple of 576 (at least 576) and stored as
the samples of an image: by the number of 576-byte units in turn a PGM and a PPM file (24
bytes a row) or a bottom-up 8-bit BMP. All three are lossless and depend on the text only.
Null text is empty: one unit of padding. Long texts are stored whole, one image each, some of them at a time;
rows that repeat are images of their own with equal values; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

UNIT, ROW = 576, 24
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for height x width, P6 for height x width x 3; 8-bit samples."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image).tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain or raw; samples of up to 16 bits, bitmaps as 0 and 1."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm file")
    at, fields = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(raw, at)
        if not m:
            raise ValueError("Netpbm header ends early")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    most = fields[2] if len(fields) > 2 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*\n|\s", b"", raw[at:])
        return (np.frombuffer(digits, np.uint8)[: width * height] - 48).reshape(shape)
    if kind in (b"P2", b"P3"):
        values = re.sub(rb"#[^\n]*\n", b" ", raw[at:]).split()[: width * height * depth]
        return np.array(values, np.int64).astype(np.uint8 if most < 256 else np.uint16).reshape(shape)
    at += 1
    if kind == b"P4":
        line = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, line * height, at).reshape(height, line), axis=1)
        return bits[:, :width]
    sample = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
    return np.frombuffer(raw, sample, width * height * depth, at).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey with a palette for height x width, 24-bit for height x width x 3; rows from the bottom."""
    height, width = image.shape[:2]
    deep = image.ndim == 3
    rows = image[::-1, :, ::-1].reshape(height, width * 3) if deep else image[::-1]
    pad = -rows.shape[1] % 4
    body = np.pad(rows, ((0, 0), (0, pad))).tobytes()
    palette = b"" if deep else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1).copy().tobytes()
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + len(body), 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24 if deep else 8, 0, len(body), 2835, 2835, 0 if deep else 256, 0)
    return head + info + palette + body


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits; a grey palette gives height x width, else colours."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, = struct.unpack_from("<I", raw, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", raw, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    down, height = height < 0, abs(height)
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, line * height, start).reshape(height, line)[:, : width * bits // 8]
    rows = rows if down else rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.frombuffer(raw, np.uint8, 4 * used, 14 + size).reshape(used, 4)
        grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
        return palette[rows, 0] if grey else palette[rows][:, :, 2::-1]
    return rows.reshape(height, width, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from the integral image read at fractional corners."""
    grey = image.mean(2) if image.ndim == 3 else image.astype(np.float64)
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def lines(table: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, len(table) - 1, n + 1)
        low = np.minimum(at.astype(int), len(table) - 2)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corners = lines(lines(total, height).T, width).T
    cells = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return cells * (height * width / (grey.shape[0] * grey.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 9 resized image brighter than its left neighbour."""
    cells = np.round(resize(image, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def tile(image: np.ndarray, side: int = 16) -> bytes:
    """The image as an NPY file of ``side`` x ``side`` bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(image, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


def to_media(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    form = len(payload) // UNIT % 3
    if form == 1:
        return encode_netpbm(samples.reshape(-1, ROW // 3, 3))
    return encode_netpbm(samples.reshape(-1, ROW)) if form == 2 else encode_bmp(samples.reshape(-1, ROW))


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text as an image file."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "text"):
                raw = [(x or "").encode() for x in part.column("text").to_pylist()]
                media = [to_media(x + b"\xff" * (-len(x) % UNIT or (0 if x else UNIT))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Decodes stored images: checksums of their samples, an NPY tile and a difference hash."""

    def run(batches):
        for batch in batches:
            ids, sizes = batch.column("doc_id"), batch.column("n_bytes")
            at = 0
            while at < batch.num_rows:
                rows = []
                held = 0
                while at + len(rows) < batch.num_rows and held < common.CHUNK_BYTES:
                    raw = batch.column("media")[at + len(rows)].as_py()
                    held += len(raw)
                    image = decode(raw)
                    payload = np.ascontiguousarray(image).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), difference_hash(image), tile(image)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), sizes.slice(at, len(rows)), *columns], ["doc_id", "n_bytes", *names])
                at += len(rows)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = common.Scratch(spark, "media").save(stored(common.documents(spark, sf_dir)), "media")
    return features(media)
