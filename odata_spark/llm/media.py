"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Texts become media columns too: their padded bytes are the samples of a Netpbm or BMP image,
which is decoded and stored as full-size NPY tiles, one after the other; everything else is
computed from those stored bytes read back.

Defined results: a null text or media value counts as empty; bytes that no decoder reads give
null columns, never a failed job. Repeated rows give equal values; an empty table gives an
empty table; only the named columns are read, so extra columns cannot clash.
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

from .common import ship

WIDTH = 64  # pixels of three samples: 192 bytes a row
TILE = 64  # rows of a stored tile
_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8, or uint16 where maxval is over 255: (height, width) or (height, width, 3)."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields[0], fields[1], fields[2] if len(fields) > 2 else 1
    n = w * h * (3 if kind in (b"P3", b"P6") else 1)
    if kind == b"P1":
        out = np.frombuffer(bytes(c for c in re.sub(rb"#[^\n]*", b"", data[at:]) if c in b"01"), np.uint8) - 48
        out = (1 - out[:n]).astype(np.uint8)
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = -(-w // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        out = (1 - bits).reshape(-1).astype(np.uint8)
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
        out = out.astype(np.uint16) if top > 255 else out
    return out.reshape((h, w, 3) if kind in (b"P3", b"P6") else (h, w))


def encode_ppm(samples: np.ndarray) -> bytes:
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 1, 4, 8, 24 and 32 bit BMP as uint8 RGB."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0:
        raise ValueError("unsupported BMP")
    row = -(-w * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)
    if bits <= 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        table = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        if bits < 8:
            parts = np.unpackbits(raw, axis=1).reshape(abs(h), -1, bits)
            raw = parts @ (1 << np.arange(bits - 1, -1, -1))
        out = table[raw[:, :w]]
    else:
        out = raw[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(out[::-1] if h > 0 else out)


def encode_bmp(samples: np.ndarray) -> bytes:
    h, w, _ = samples.shape
    row = -(-w * 3 // 4) * 4
    raw = np.zeros((h, row), np.uint8)
    raw[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, -1)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + raw.size, 0, 0, 54, 40, w, h, 1, 24, 0, raw.size, 2835, 2835, 0, 0) + raw.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from the integral image at (fractional) corners."""
    full = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=full[1:, 1:])

    def along(a: np.ndarray, n: int) -> np.ndarray:
        at = np.arange(n + 1) * ((len(a) - 1) / n)
        i = np.minimum(at.astype(int), len(a) - 2)
        part = (at - i)[:, None]
        return a[i] * (1 - part) + a[i + 1] * part

    corners = along(along(full, height).T, width).T
    return np.diff(np.diff(corners, axis=0), axis=1) * (height * width / (image.shape[0] * image.shape[1]))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.save(buffer, array, allow_pickle=False)
    return buffer.getvalue()


def store_tiles(image: np.ndarray, tile: int = TILE) -> bytes:
    """The whole image as NPY tiles of `tile` rows and columns, in reading order; NPY says where each ends."""
    h, w = image.shape[:2]
    return b"".join(npy(image[r : r + tile, c : c + tile]) for r in range(0, h, tile) for c in range(0, w, tile))


def read_tiles(stored: bytes, width: int, tile: int = TILE) -> np.ndarray:
    buffer, rows = io.BytesIO(stored), []
    while buffer.tell() < len(stored):
        row = [np.load(buffer, allow_pickle=False) for _ in range(-(-width // tile))]
        rows.append(row[0] if len(row) == 1 else np.concatenate(row, 1))
    return rows[0] if len(rows) == 1 else np.concatenate(rows)


def tiles(df: DataFrame, column: str = "media", key: str = "media_id", size: int = 32, tile: int = 16) -> DataFrame:
    """Each image resized to size x size and cut into NPY tiles: key, tile_row, tile_col, npy, dhash (nulls if unreadable)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, cols, blobs, hashes = [], [], [], [], []
            for i, value in enumerate(b.column(1)):
                try:
                    image = decode(value.as_py() or b"")
                    small = np.clip(np.rint(area_resize(grey(image), size, size)), 0, 65535).astype(np.uint8 if image.dtype == np.uint8 else np.uint16)
                    found = [(r, c, npy(small[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile])) for r in range(-(-size // tile)) for c in range(-(-size // tile))]
                    mark = difference_hash(image)
                except (ValueError, IndexError, struct.error, ZeroDivisionError, OverflowError):
                    found, mark = [(None, None, None)], None
                for r, c, blob in found:
                    at.append(i), rows.append(r), cols.append(c), blobs.append(blob), hashes.append(mark)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(blobs, pa.binary()), pa.array(hashes, pa.string())], [key, "tile_row", "tile_col", "npy", "dhash"])

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, tile_row int, tile_col int, npy binary, dhash string")


MEDIA_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text's padded UTF-8 as a 64 pixel wide RGB image (BMP where its CRC is odd, else Netpbm), decoded and
    stored as NPY tiles; digests of the stored bytes and what is read back of them, and its difference hash."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for value in b.column(1):
                data = (value.as_py() or "").encode("utf-8")
                payload = data + b" " * (-len(data) % 192 or 192 * (not data))
                samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
                media = store_tiles(decode(encode_bmp(samples) if zlib.crc32(payload) & 1 else encode_ppm(samples)))
                image = read_tiles(media, WIDTH)
                back = image.tobytes()
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), media)
                for column, x in zip(out, row):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            n = 8 if with_media else 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(out[:n], kinds))], ["doc_id", *names[:n]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {MEDIA_SCHEMA}" + ", media binary" * with_media)
