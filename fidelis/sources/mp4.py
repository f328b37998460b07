"""What the headers of an ISO base media file (MP4, MOV) declare of its first video track. Pictures are never read.

Only box headers and the ``moov`` box are read, by seeks, so a file's cost doesn't grow with its length.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import BinaryIO

#: A larger movie box is refused.
MOVIE = 64 << 20


class Unreadable(ValueError):
    """Why a file's headers can't be read."""


def _kind(raw: bytes) -> str:
    return "".join(chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02x}" for b in raw)


def _top(f: BinaryIO, size: int) -> Iterator[tuple[bytes, int, int, bool]]:
    """(kind, begin and length of the payload, whether it runs to the end of the file) of each box of the file."""
    at = 0
    while at < size:
        if size - at < 8:
            raise Unreadable(f"truncated box header at offset {at}: {size - at} bytes left, 8 needed")
        f.seek(at)
        length, kind = struct.unpack(">I4s", f.read(8))
        head, whole = 8, length or size - at
        if length == 1:
            if size - at < 16:
                raise Unreadable(f"truncated 64-bit box header at offset {at}: {size - at} bytes left, 16 needed")
            head, whole = 16, struct.unpack(">Q", f.read(8))[0]
        if whole < head:
            raise Unreadable(f"box '{_kind(kind)}' at offset {at} declares {whole} bytes, smaller than its own header")
        if whole > size - at:
            raise Unreadable(f"box '{_kind(kind)}' at offset {at} declares {whole} bytes but only {size - at} remain")
        yield kind, at + head, whole - head, length == 0
        at += whole


def _movie(f: BinaryIO, size: int) -> bytes:
    seen, last = False, None
    for kind, begin, length, to_end in _top(f, size):
        seen = True
        if kind == b"moov":
            if length > MOVIE:
                raise Unreadable(f"moov box declares {length} bytes, over the {MOVIE}-byte ceiling")
            f.seek(begin)
            return f.read(length)
        if to_end:
            last = _kind(kind)
    if last:
        raise Unreadable(f"no moov box: the '{last}' box runs to the end of the file, so whatever is behind it can't be reached")
    raise Unreadable("no moov box: the file has no movie metadata" if seen else "not an MP4 container: the file has no boxes")


def _inside(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, payload) of the boxes in ``data``, as far as they fit."""
    at = 0
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        head, whole = 8, length or len(data) - at
        if length == 1:
            if at + 16 > len(data):
                return
            head, whole = 16, struct.unpack_from(">Q", data, at + 8)[0]
        if whole < head or whole > len(data) - at:
            return
        yield kind, data[at + head : at + whole]
        at += whole


def _find(data: bytes | None, *path: bytes) -> bytes | None:
    for kind in path:
        if data is None:
            return None
        data = next((p for k, p in _inside(data) if k == kind), None)
    return data


def _clock(mdhd: bytes | None) -> tuple[int, int] | None:
    """Ticks a second and ticks in all; unknown lengths are written as all ones."""
    form = {0: (">II", 12, 2**32 - 1), 1: (">IQ", 20, 2**64 - 1)}.get(mdhd[0]) if mdhd else None
    if form is None or len(mdhd) < form[1] + struct.calcsize(form[0]):
        return None
    scale, ticks = struct.unpack_from(form[0], mdhd, form[1])
    return None if ticks == form[2] else (scale, ticks)


def _track(moov: bytes) -> dict | None:
    # In a fragmented file the samples are in other boxes, and an empty table doesn't mean no frames.
    fragmented = _find(moov, b"mvex") is not None
    for kind, trak in _inside(moov):
        mdia = _find(trak, b"mdia") if kind == b"trak" else None
        handler = _find(mdia, b"hdlr")
        if handler is None or handler[8:12] != b"vide":
            continue
        table = _find(mdia, b"minf", b"stbl")
        sizes = None if fragmented else _find(table, b"stsz") or _find(table, b"stz2")
        frames = struct.unpack_from(">I", sizes, 8)[0] if sizes and len(sizes) >= 12 else None
        entry = next(_inside((_find(table, b"stsd") or b"")[8:]), None)
        known = entry is not None and len(entry[1]) >= 28
        width, height = struct.unpack_from(">HH", entry[1], 24) if known else (None, None)
        clock = _clock(_find(mdia, b"mdhd"))
        fps = frames * clock[0] / clock[1] if frames is not None and clock and clock[0] and clock[1] else None
        return {"codec": _kind(entry[0]) if known else None, "width": width, "height": height, "fps": fps, "frame_count": frames}
    return None


def probe(path: str) -> dict:
    """codec, width, height, fps and frame_count of the first video track, each None where the headers don't say."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            track = _track(_movie(f, size))
    except (OSError, struct.error) as e:
        raise Unreadable(f"cannot read: {type(e).__name__}") from None
    if track is None:
        raise Unreadable("no video track: no track has a 'vide' handler")
    return track
