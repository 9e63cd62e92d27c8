"""Media columns: Netpbm and BMP images as bytes in a column.

decode() gives numpy arrays, area_resize() shrinks or grows them by integral images
(exact box averages, fractional edges included), difference_hash() gives 64 bits, and
npy_tile() writes an array in NPY format.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_input

UNIT, WIDTH, PAD, TILE = 576, 24, 255, 16


def _netpbm_header(data: bytes) -> tuple[bytes, list[int], int]:
    """Magic, the numbers of the header, and where the samples begin.  Comments run from # to the line's end."""
    magic, at, numbers = data[:2], 2, []
    need = 2 if magic in (b"P1", b"P4") else 3
    while len(numbers) < need:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    return magic, numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    magic, numbers, at = _netpbm_header(data)
    w, h, most = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    deep = 3 if magic in (b"P3", b"P6") else 1
    if magic in (b"P1", b"P2", b"P3"):
        body = data[at - 1 :]
        text = b"\n".join(x.split(b"#")[0] for x in body.split(b"\n"))
        flat = [int(x) for x in (text.split() if magic != b"P1" else [bytes([c]) for c in text if c in b"01"])]
        out = np.array(flat[: w * h * deep], dtype=np.uint16 if most > 255 else np.uint8)
    elif magic == b"P4":
        row = -(-w // 8)
        out = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w].ravel()
    elif magic in (b"P5", b"P6"):
        out = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * deep, at)
    else:
        raise ValueError(f"not Netpbm: {magic!r}")
    if magic in (b"P1", b"P4"):
        out = (1 - out) * np.uint8(255)  # 1 is black
    return out.reshape((h, w, 3) if deep == 3 else (h, w))


def encode_netpbm(a: np.ndarray) -> bytes:
    """A binary greymap (two dimensions) or pixmap (three)."""
    wide = a.dtype.itemsize > 1
    head = b"%s\n%d %d\n%d\n" % (b"P6" if a.ndim == 3 else b"P5", a.shape[1], a.shape[0], 65535 if wide else 255)
    return head + a.astype(">u2" if wide else np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel; grey palettes give two dimensions."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    offset, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError("compressed BMP")
    row = -(-w * depth // 32) * 4
    lines = np.frombuffer(data, np.uint8, row * abs(h), offset).reshape(abs(h), row)
    if h > 0:
        lines = lines[::-1]
    if depth in (24, 32):
        k = depth // 8
        return lines[:, : w * k].reshape(abs(h), w, k)[:, :, 2::-1]
    bits = lines if depth == 8 else np.unpackbits(lines, axis=1)
    if depth == 4:
        bits = lines[:, :, None] >> np.array([4, 0], np.uint8) & 15
        bits = bits.reshape(abs(h), -1)
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    index = bits[:, :w]
    if (palette == palette[:, :1]).all():
        return palette[index, 0]
    return palette[index]


def encode_bmp(a: np.ndarray) -> bytes:
    """8-bit grey (two dimensions) or 24-bit colour (three), bottom row first."""
    h, w = a.shape[:2]
    grey = a.ndim == 2
    body = a if grey else a[:, :, ::-1].reshape(h, 3 * w)
    row = -(-body.shape[1] // 4) * 4
    lines = np.zeros((h, row), np.uint8)
    lines[:, : body.shape[1]] = body[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + lines.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, lines.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + lines.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Averages of the source over each target cell's box, by an integral image read between its nodes."""
    a = a.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        m = a.shape[axis]
        total = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
        edge = np.linspace(0, m, n + 1)
        low = np.minimum(edge.astype(int), m - 1)
        shape = [1] * a.ndim
        shape[axis] = n + 1
        part = (edge - low).reshape(shape)
        at = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
        a = np.diff(at, axis=axis) * (n / m)
    return a


def difference_hash(a: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8 x 9 area-resized grey image is darker than its right neighbour."""
    grey = a if a.ndim == 2 else a[:, :, :3].mean(axis=2)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(a: np.ndarray, size: int = TILE) -> bytes:
    """The image area-resized to size x size, in NPY format (8-bit samples)."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(a, size, size)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def store_payloads(docs: DataFrame, unit: int = UNIT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an image, written to the shared folder and read back.

    The bytes, padded with 255 to a positive multiple of `unit`, are the samples of an image `width` pixels wide: a greymap
    if the number of units is odd, a grey BMP if it is even.  Null texts are empty: one unit of padding.
    """

    def run(batches):
        for b in batches:
            texts, media = b.column(1), []
            for t in texts:
                raw = (t.as_py() or "").encode()
                units = max(1, -(-len(raw) // unit))
                a = np.frombuffer(raw.ljust(units * unit, bytes([PAD])), np.uint8).reshape(-1, width)
                media.append(encode_bmp(a) if units % 2 == 0 else encode_netpbm(a))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t.as_py() or "").encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return stored(text_input(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary"))


def media_features(media: DataFrame, tile: int = TILE) -> DataFrame:
    """Decodes each image and gives its checksums, difference hash and NPY tile.  An undecodable image raises."""

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "npy_tile"]
        for b in batches:
            rows = [[] for _ in names[2:]]
            for m in b.column(2):
                data = m.as_py()
                a = decode(data)
                payload = a.tobytes()
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(a), a.shape[1], a.shape[0], npy_tile(a, tile))
                for r, v in zip(rows, values):
                    r.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(r, k) for r, k in zip(rows, kinds)]], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, npy_tile binary"
    )


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_payloads(table(spark, sf_dir, "documents")))
