"""Small pictures in and out of PNG: eight bits a sample, grey or colour, with or without alpha, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The signature, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    """(height, width, 1 to 4 samples) of 8 bits, rows unfiltered."""
    h, w, n = pixels.shape
    kind = next(k for k, v in SAMPLES.items() if v == n)
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(h, w * n)], axis=1)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, samples) of such a picture; anything else raises ValueError."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at, body, head = len(SIGNATURE), [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + part)):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("a kind of PNG that isn't read")
    w, h, n = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * n)
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    out = np.zeros((h + 1, w + 1, n), np.int32)  # with a row and a column of zeros before the first
    for y in range(h):
        how, row = raw[y, 0], raw[y, 1:].reshape(w, n).astype(np.int32)
        above, now = out[y], out[y + 1]
        if how == 0:
            now[1:] = row
        elif how == 1:
            now[1:] = np.cumsum(row, axis=0) & 255
        elif how == 2:
            now[1:] = (row + above[1:]) & 255
        else:
            for x in range(w):
                left, up, corner = now[x], above[x + 1], above[x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                now[x + 1] = (row[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def in_mode(pixels: np.ndarray, channels: int) -> np.ndarray:
    """The picture with 3 channels (colour) or 1 (grey, by the luma weights 299, 587 and 114 in a thousand); alpha goes."""
    colour = pixels[..., : pixels.shape[-1] - (pixels.shape[-1] in (2, 4))]
    if colour.shape[-1] == channels:
        return colour
    if channels == 3:
        return np.repeat(colour, 3, axis=-1)
    weighed = colour.astype(np.int64) @ np.array([19595, 38470, 7471])
    return ((weighed + 0x8000) >> 16).astype(np.uint8)[..., None]
