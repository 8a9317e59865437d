"""PNG images in binary columns: lossless storing, checked reading, and cosine-transform hashes.

The writer and the reader know the parts of the format that 8-bit grey and RGB images without interlacing need. A file
is a signature and chunks, each with length, type, data and a CRC-32; the rows of the image are filtered, one filter
type a row, and deflated into the IDAT chunks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
CHANNELS = {0: 1, 2: 3}

#: Bytes in one chunk of image data at most, and pixels in a row of a text's image.
CHUNK, WIDTH = 1 << 20, 64


class BadImage(ValueError):
    """The bytes aren't an image that this reader accepts: signature, chunk, checksum or size is wrong."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(pixels: np.ndarray, level: int = 6) -> bytes:
    """A PNG file of uint8 pixels (height, width) or (height, width, 3), height and width 1 or more.

    All rows take the filter among none, sub and up whose bytes, read as signed, have the least sum of sizes, the first
    of equals. The same pixels give the same bytes.
    """
    h, w = pixels.shape[:2]
    n = 1 if pixels.ndim == 2 else pixels.shape[2]
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, w * n)
    tried = np.empty((3, h, w * n), np.uint8)
    tried[0] = rows
    tried[1, :, :n] = rows[:, :n]
    np.subtract(rows[:, n:], rows[:, :-n], out=tried[1, :, n:])
    tried[2, 0] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=tried[2, 1:])
    best = int(np.minimum(tried, -tried).sum(axis=(1, 2), dtype=np.int64).argmin())
    out = np.empty((h, w * n + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tried[best]
    data = zlib.compress(out.tobytes(), level)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)), _chunk(b"IEND", b"")])


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """The chunks of a PNG file, each checked against its CRC; raises BadImage."""
    if data[:8] != SIGNATURE:
        raise BadImage("signature")
    at, out = 8, []
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("chunk cut off")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise BadImage("chunk cut off")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind!r}")
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            break
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND":
        raise BadImage("first or last chunk")
    return out


def unfilter(kinds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Undo the row filters; rows (height, bytes in a row) of n bytes a pixel.

    Runs of rows that look upward only are summed at once, and so are the pixels of a row that look left only. Average
    and Paeth need each pixel before the next and go pixel by pixel.
    """
    h, width = rows.shape
    if h and kinds.max() > PAETH:
        raise BadImage("filter type")
    out = rows.copy()
    cuts = np.flatnonzero(np.diff(kinds, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], h]):
        kind = kinds[a]
        above = out[a - 1] if a else np.zeros(width, np.uint8)
        if kind == SUB:
            part = out[a:b].reshape(b - a, width // n, n)
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == UP:
            out[a] += above
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind == AVERAGE:
            for y in range(a, b):
                row, up = out[y].astype(np.int32), (out[y - 1] if y else above).astype(np.int32)
                left = np.zeros(n, np.int32)
                for x in range(0, width, n):
                    left = (row[x : x + n] + (left + up[x : x + n]) // 2) & 255
                    out[y, x : x + n] = left
        elif kind == PAETH:
            for y in range(a, b):
                row, up = out[y].tolist(), (out[y - 1] if y else above).tolist()
                for x in range(width):
                    left, diagonal = (row[x - n], up[x - n]) if x >= n else (0, 0)
                    guess = left + up[x] - diagonal
                    by_left, by_up, by_diagonal = abs(guess - left), abs(guess - up[x]), abs(guess - diagonal)
                    nearest = left if by_left <= by_up and by_left <= by_diagonal else up[x] if by_up <= by_diagonal else diagonal
                    row[x] = (row[x] + nearest) & 255
                out[y] = row
    return out


def decode(data: bytes) -> np.ndarray:
    """The pixels of a PNG file, (height, width) or (height, width, 3); raises BadImage where anything doesn't fit."""
    found = chunks(data)
    if len(found[0][1]) != 13:
        raise BadImage("header")
    w, h, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", found[0][1])
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlace or not w or not h:
        raise BadImage("kind of image")
    n = CHANNELS[colour]
    want = h * (w * n + 1)
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(body for kind, body in found if kind == b"IDAT"), want + 1)
    except zlib.error as e:
        raise BadImage("deflated data") from e
    if len(raw) != want or not unpack.eof:
        raise BadImage("size of the data")
    rows = np.frombuffer(raw, np.uint8).reshape(h, w * n + 1)
    out = unfilter(rows[:, 0].astype(np.int64), rows[:, 1:], n)
    return out.reshape(h, w, n) if n > 1 else out


def _cosines(n: int, k: int) -> np.ndarray:
    """The first k rows of the orthonormal cosine transform of n points."""
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


SIDE, LOW = 32, 8
_LOW = _cosines(SIDE, LOW)


def _shrunk(grey: np.ndarray, side: int) -> np.ndarray:
    """Means over a grid of side x side cells; a side shorter than the grid repeats its rows."""
    for axis in (1, 0):
        n = grey.shape[axis]
        if axis == 1 and n % side == 0:
            grey = grey.reshape(len(grey), side, -1).mean(axis=2)
            continue
        edges = np.arange(side + 1) * n // side
        lo, hi = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
        sums = np.concatenate([np.zeros_like(grey.take([0], axis)), np.cumsum(grey, axis)], axis)
        width = (hi - lo).reshape([-1, 1] if axis == 0 else [1, -1])
        grey = (sums.take(hi, axis) - sums.take(lo, axis)) / width
    return grey


def dct_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the 8 x 8 lowest cosine frequencies lie above their median.

    The constant term takes no part in the median. Values are rounded first, so that equal images agree everywhere.
    """
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels.astype(np.float64)
    low = np.round(_LOW @ _shrunk(grey, SIDE) @ _LOW.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> bytes:
    """UTF-8, filled up with spaces to a multiple of 192 bytes, one at least: the rows of a 64-pixel RGB image."""
    data = (text or "").encode()
    row = WIDTH * 3
    return data.ljust(max(1, -(-len(data) // row)) * row, b" ")


def store_texts(docs: DataFrame, level: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text as a PNG in a binary column: the id, n_bytes (of the text, unpadded) and media.

    Null texts count as empty, which is one row of spaces. Repeated rows are kept, null ids stay null. Other columns
    are ignored. No shuffle; memory is one Arrow batch and one image.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            made = [encode(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH, 3), level) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(made, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_features(images: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """Decode each PNG of a binary column. Per row: the columns keep, media, payload (its samples as bytes), feature
    (``dct_hash``) and error.

    A null or damaged image gets null payload and feature and says in error what is wrong; other rows have error null.
    """
    names = [*keep, media_col]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bodies, features, errors = [], [], []
            for m in b.column(len(keep)).to_pylist():
                try:
                    if m is None:
                        raise BadImage("null")
                    px = decode(m)
                    body, feature, error = px.tobytes(), dct_hash(px), None
                except BadImage as e:
                    body, feature, error = None, None, str(e)
                bodies.append(body)
                features.append(feature)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())], [*names, "payload", "feature", "error"])

    kinds = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(images.select(*names), run, f"{kinds}, payload binary, feature string, error string")


def media_digest(docs: DataFrame) -> DataFrame:
    """Texts stored as images and read back, as digests; see ``store_texts`` and ``read_features``.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), media_bytes, media_sha256,
    feature. The digests are of what the decoder returns, so a damaged image would show.
    """
    back = read_features(store_texts(docs), ["doc_id", "n_bytes"])
    size = F.octet_length("payload").cast("long")
    return back.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
