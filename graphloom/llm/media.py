"""Media columns: PNG through zlib chunks with checksum tests and numpy unfiltering, then low-frequency cosine hashes.

``encode`` lays a payload, filled up to a multiple of 576, out as 8-bit grey samples, 96 to a row, and writes a PNG
(filters chosen per row) into a binary column. ``decode`` reads any non-interlaced 8-bit PNG (grey, grey+alpha, RGB, RGBA, palette) back, tests every
chunk's checksum and undoes all five filters. ``cosine_hash`` shrinks the picture to 32 x 32 by exact area means and
takes the signs of its low-frequency cosine coefficients against their median.

Defined results: null counts as an empty payload, which is one row of padding; equal payloads give equal bytes and equal
features; a broken file gives an error text and null features. A row is handled alone: memory is about 12 times the
longest payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, WIDTH = 576, 96
PAD = 255
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class BadImage(ValueError):
    """A file that is no PNG this reader takes, or whose checksums or sizes don't hold."""


def payload(data: bytes | None, block: int = BLOCK, pad: int = PAD) -> bytes:
    """``data`` filled up to a positive multiple of ``block``."""
    data = data or b""
    return data + bytes([pad]) * (-len(data) % block if data else block)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey 8-bit PNG. Each row takes the filter, none or up, whose bytes have the smaller absolute sum; ties take none."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    if not len(rows):
        raise ValueError("a picture has at least one row")
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    up = rows - above
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (rows, up)]
    take = cost[1] < cost[0]
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = np.where(take, 2, 0)
    lines[:, 1:] = np.where(take[:, None], up, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters. Runs of rows of one filter go together: up and sub are running sums; average and Paeth step by pixel."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise BadImage(f"filter {kinds.max()}")
    n, stride = rows.shape
    cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), n]
    for first, last in zip(cuts, cuts[1:]):
        kind = kinds[first] if n else 0
        if kind == 1:
            rows[first:last] = np.add.accumulate(rows[first:last].reshape(last - first, -1, bpp), axis=1, dtype=np.uint8).reshape(last - first, stride)
        elif kind == 2:
            if first:
                rows[first] += rows[first - 1]
            np.add.accumulate(rows[first:last], axis=0, dtype=np.uint8, out=rows[first:last])
        for i in range(first, last) if kind > 2 else ():
            above = rows[i - 1].astype(np.int32) if i else np.zeros(stride, np.int32)
            line = rows[i].astype(np.int32)
            left = corner = np.zeros(bpp, np.int32)
            for x in range(0, stride, bpp):
                b = above[x : x + bpp]
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - corner
                    pa_, pb, pc = np.abs(p - left), np.abs(p - b), np.abs(p - corner)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
                left = line[x : x + bpp] = (line[x : x + bpp] + guess) & 255
                corner = b
            rows[i] = line
    return rows


def decode(png: bytes) -> np.ndarray:
    """Samples as (height, width, channels) 8-bit integers."""
    if png[:8] != _SIGNATURE:
        raise BadImage("signature")
    at, head, palette, data, ended = 8, None, None, [], False
    while at < len(png):
        if at + 12 > len(png):
            raise BadImage("cut off")
        (size,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body, crc = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise BadImage(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise BadImage(f"critical chunk {kind!r}")
        at += 12 + size
    if head is None or not ended:
        raise BadImage("no header or no end")
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or color not in _CHANNELS or interlace:
        raise BadImage(f"depth {depth}, colour {color}, interlace {interlace}")
    bpp = _CHANNELS[color]
    want = height * (width * bpp + 1)
    inflater = zlib.decompressobj()
    try:
        raw = inflater.decompress(b"".join(data), want + 1)
    except zlib.error as e:
        raise BadImage(f"zlib: {e}") from e
    if len(raw) != want:
        raise BadImage(f"{len(raw)} bytes instead of {want}")
    rows = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * bpp + 1), bpp).reshape(height, width, bpp)
    if color == 3:
        if palette is None or rows.max(initial=0) >= len(palette):
            raise BadImage("palette")
        rows = palette[rows[:, :, 0]]
    return rows


def _shrink(picture: np.ndarray, axis: int, to: int) -> np.ndarray:
    """Exact area means of ``to`` equal parts of an axis."""
    n = picture.shape[axis]
    sums = np.concatenate([np.zeros_like(np.take(picture, [0], axis)), np.cumsum(picture, axis=axis)], axis)
    edges = np.arange(to + 1) * n / to
    low = np.minimum(edges.astype(np.int64), n - 1)
    part = np.expand_dims(edges - low, 1 - axis)
    at = np.take(sums, low, axis) + part * np.take(picture, low, axis)
    return np.diff(at, axis=axis) * (to / n)


def _basis(low: int, n: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_SIDE, _LOW = 32, 8
_COS = _basis(_LOW, _SIDE)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: sign of each of the 8 x 8 lowest cosine coefficients against the median of those but the first."""
    grey = samples.mean(axis=2) if samples.ndim == 3 and samples.shape[2] > 1 else samples.reshape(samples.shape[:2]).astype(np.float64)
    small = _shrink(_shrink(grey.astype(np.float64), 0, _SIDE), 1, _SIDE)
    coefficients = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(coefficients > np.median(coefficients[1:])).tobytes()
