"""Width, height and format from an image's first bytes; no decoder needed."""

from __future__ import annotations

import struct
from typing import NamedTuple


class Header(NamedTuple):
    format: str
    width: int
    height: int


def image_header(data: bytes) -> Header | None:
    """Header of a PNG, JPEG, GIF, BMP, WebP, TIFF, AVIF or JPEG XL image; null if it is none or is cut short."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return Header("PNG", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return Header("GIF", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return Header("BMP", w, abs(h))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[4:8] == b"ftyp" and data[8:12] in (b"avif", b"avis"):
            at = data.index(b"ispe")
            return Header("AVIF", *struct.unpack(">II", data[at + 8 : at + 16]))
        if data[:2] == b"\xff\x0a":
            return _jxl(data[2:])
        if data[4:8] == b"JXL ":
            found = [data.find(kind) for kind in (b"jxlc", b"jxlp")]
            at = max(found) if found[0] < 0 else found[0]
            return _jxl(data[data.index(b"\xff\x0a", at) + 2 :])
    except (struct.error, IndexError, ValueError):
        pass
    return None


def _tiff(data: bytes) -> Header:
    """The first directory's width (tag 256) and height (257), as short or long numbers."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    sizes = {}
    for entry in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind = struct.unpack(order + "HH", data[entry : entry + 4])
        if tag in (256, 257):
            sizes[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), data[entry + 8 : entry + (10 if kind == 3 else 12)])[0]
    if len(sizes) < 2:
        raise ValueError("no size")
    return Header("TIFF", sizes[256], sizes[257])


def _jxl(data: bytes) -> Header:
    """The size header of a codestream: bits from the lowest on."""
    bits, at = int.from_bytes(data[:16], "little"), 0
    if len(data) < 12:
        raise ValueError("cut short")

    def take(n: int) -> int:
        nonlocal at
        at += n
        return bits >> at - n & (1 << n) - 1

    def size(small: int) -> int:
        return 8 * (take(5) + 1) if small else take((9, 13, 18, 30)[take(2)]) + 1

    small = take(1)
    height = size(small)
    ratio = take(3)
    # fixed values: the ratios of width to height that need no width
    width = height * (0, 1, 12, 4, 3, 16, 5, 2)[ratio] // (1, 1, 10, 3, 2, 9, 4, 1)[ratio] if ratio else size(small)
    return Header("JXL", width, height)


def _webp(data: bytes) -> Header | None:
    chunk = data[12:16]
    if chunk == b"VP8X":
        return Header("WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
    if chunk == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return Header("WEBP", w & 0x3FFF, h & 0x3FFF)
    if chunk == b"VP8L":
        (bits,) = struct.unpack("<I", data[21:25])
        return Header("WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    return None


def _jpeg(data: bytes) -> Header | None:
    at = 2
    while True:
        while data[at] != 0xFF:
            at += 1
        while data[at] == 0xFF:
            at += 1
        marker = data[at]
        at += 1
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 3 : at + 7])
            return Header("JPEG", w, h)
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            continue
        at += struct.unpack(">H", data[at : at + 2])[0]


def difference_hash(gray: list[list[int]]) -> int:
    """64-bit hash of an 8 x 9 gray image, rows from the top: a bit is set where a pixel is brighter than its right neighbour.

    Signed, as a Spark bigint holds it.
    """
    value = 0
    for row in gray:
        for a, b in zip(row, row[1:], strict=False):
            value = value << 1 | (a > b)
    return value - (1 << 64) if value >> 63 else value
