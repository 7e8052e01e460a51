"""What the head of an image file tells without decoding it: width and height, and what the camera wrote."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of the first directory and of the camera's directory, by the name of the field they become.
TAGS = {"description": 0x010E, "make": 0x010F, "model": 0x0110, "software": 0x0131, "changed": 0x0132, "artist": 0x013B, "copyright": 0x8298}
CAMERA_TAGS = {"exposure": 0x829A, "aperture": 0x829D, "iso": 0x8827, "taken": 0x9003, "focal_length": 0x920A}
CAMERA_DIRECTORY = 0x8769
#: Bytes of a value by its type (bytes, texts, 2, 4 and 8 byte numbers, fractions).
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
FIELDS = {**dict.fromkeys(TAGS, "string"), "exposure": "double", "aperture": "double", "iso": "long", "taken": "string", "focal_length": "double"}
#: A directory of more entries counts as damaged.
ENTRIES = 4096


class Short(Exception):
    """The head is too short; args[0] tells how many bytes are needed."""


def _at(data: bytes, start: int, n: int) -> bytes:
    if start < 0 or n < 0:
        raise ValueError("an offset before the start")
    if start + n > len(data):
        raise Short(start + n)
    return data[start : start + n]


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, length) of the segments of a JPEG before its picture data."""
    at = 2
    while True:
        if _at(data, at, 1) != b"\xff":
            return
        while _at(data, at, 1) == b"\xff":
            at += 1
        marker = data[at]
        at += 1
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if marker in (0xD9, 0xDA):
            return
        (n,) = struct.unpack(">H", _at(data, at, 2))
        yield marker, at + 2, n - 2
        at += n


def directory(data: bytes, base: int, at: int, order: str) -> dict[int, tuple[int, int, int]]:
    """{tag: (type, count, place of the value)} of a TIFF directory; base is the start of the TIFF block."""
    (n,) = struct.unpack(order + "H", _at(data, base + at, 2))
    out = {}
    for i in range(n if n <= ENTRIES else 0):
        tag, kind, count = struct.unpack(order + "HHI", _at(data, base + at + 2 + 12 * i, 8))
        place = at + 10 + 12 * i
        if WIDTHS.get(kind, 1) * count > 4:
            (place,) = struct.unpack(order + "I", _at(data, base + place, 4))
        out.setdefault(tag, (kind, count, place))
    return out


def _order(data: bytes, base: int) -> str:
    order = {b"II": "<", b"MM": ">"}.get(_at(data, base, 2))
    if order is None or struct.unpack(order + "H", _at(data, base + 2, 2))[0] != 42:
        raise ValueError("no TIFF block")
    return order


def value(data: bytes, base: int, order: str, entry: tuple[int, int, int]):
    """The value of an entry: a text, or its first number; None for other types."""
    kind, count, place = entry
    if kind == 2:
        return _at(data, base + place, count).split(b"\0")[0].decode("utf-8", "replace").strip() or None
    if kind in (3, 4, 9) and count:
        return struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind], _at(data, base + place, WIDTHS[kind]))[0]
    if kind in (5, 10) and count:
        a, b = struct.unpack(order + ("II" if kind == 5 else "ii"), _at(data, base + place, 8))
        return a / b if b else None
    return None


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the head of a file, None if it is no picture; raises Short where more bytes are needed."""
    if data[:3] == b"\xff\xd8\xff":
        for marker, start, _ in segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # frame headers; the others are tables
                height, width = struct.unpack(">HH", _at(data, start + 1, 4))
                return width, height
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", _at(data, 16, 8))
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", _at(data, 6, 4))
    if data[:2] == b"BM":
        width, height = struct.unpack("<ii", _at(data, 18, 8))
        return abs(width), abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = _at(data, 12, 4)
        if kind == b"VP8X":
            x = _at(data, 24, 6)
            return 1 + int.from_bytes(x[:3], "little"), 1 + int.from_bytes(x[3:], "little")
        if kind == b"VP8L":
            (bits,) = struct.unpack("<I", _at(data, 21, 4))
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            width, height = struct.unpack("<HH", _at(data, 26, 4))
            return width & 0x3FFF, height & 0x3FFF
        return None
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = _order(data, 0)
        found = directory(data, 0, struct.unpack(order + "I", _at(data, 4, 4))[0], order)
        size = [value(data, 0, order, found[tag]) if tag in found else None for tag in (256, 257)]
        return tuple(size) if all(size) else None
    if data[:4] == b"\0\0\1\0":
        width, height = _at(data, 6, 2)
        return width or 256, height or 256
    return None


def capture(data: bytes) -> dict:
    """The camera's fields of a JPEG or TIFF head; a field whose offset or type is damaged, or that lies beyond the head, is missing."""
    base = -1
    try:
        if data[:4] in (b"II*\0", b"MM\0*"):
            base = 0
        elif data[:2] == b"\xff\xd8":
            base, end = next((start + 6, start + n) for marker, start, n in segments(data) if marker == 0xE1 and n >= 14 and _at(data, start, 6) == b"Exif\0\0")
            data = data[:end]  # nothing beyond the segment is the camera's
        if base < 0:
            return {}
        order = _order(data, base)
        first = directory(data, base, struct.unpack(order + "I", _at(data, base + 4, 4))[0], order)
    except (Short, ValueError, StopIteration, struct.error):
        return {}
    out = {}
    camera: dict = {}
    try:
        if CAMERA_DIRECTORY in first:
            camera = directory(data, base, value(data, base, order, first[CAMERA_DIRECTORY]) or -1, order)
    except (Short, ValueError, TypeError, struct.error):
        pass
    for tags, entries in ((TAGS, first), (CAMERA_TAGS, camera)):
        for name, tag in tags.items():
            try:
                got = value(data, base, order, entries[tag]) if tag in entries else None
            except (Short, ValueError, struct.error):
                got = None
            if got is not None and isinstance(got, str) == (FIELDS[name] == "string"):
                out[name] = got
    return out


def capture_fields(head: Column) -> Column:
    """Struct of FIELDS out of the head of a file; fields that are missing or damaged are null, as are all of a null head."""

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in FIELDS.items()))
    def read(heads: pd.Series) -> pd.DataFrame:
        found = [capture(bytes(x)) if x is not None else {} for x in heads]
        kinds = {"string": "object", "double": "Float64", "long": "Int64"}
        return pd.DataFrame({n: pd.Series([f.get(n) for f in found], dtype=kinds[t]) for n, t in FIELDS.items()})

    return read(head)


def head_dimensions(head: Column) -> Column:
    """Struct (width, height) out of the head of a file, nulls where it does not tell."""

    @F.pandas_udf("width long, height long")
    def read(heads: pd.Series) -> pd.DataFrame:
        found = []
        for x in heads:
            try:
                found.append((x is not None and dimensions(bytes(x))) or (None, None))
            except (Short, ValueError, struct.error):
                found.append((None, None))
        return pd.DataFrame({"width": pd.Series([a for a, _ in found], dtype="Int64"), "height": pd.Series([b for _, b in found], dtype="Int64")})

    return read(head)
