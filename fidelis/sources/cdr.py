"""Heads of ROS messages in little-endian CDR: frames, layouts, intrinsics, poses and transforms, never the bulk of a message."""

from __future__ import annotations

import struct

#: A longer text is no name.
NAME = 4096
# Types of the fields of a point.
POINT_TYPES = ("unknown", "int8", "uint8", "int16", "uint16", "int32", "uint32", "float32", "float64")


class _Short(Exception):
    """The message ends before what is read."""


class Cursor:
    """Reads values at their alignment, which counts from behind the four bytes that name the encoding."""

    def __init__(self, data: bytes):
        if len(data) < 4 or data[1] not in (1, 3):  # the others are big-endian
            raise _Short
        self.data, self.at = data[4:], 0

    def many(self, form: str, n: int = 1) -> tuple:
        size = struct.calcsize(form)
        begin = -(-self.at // size) * size
        if begin + n * size > len(self.data):
            raise _Short
        self.at = begin + n * size
        return struct.unpack_from(f"<{n}{form}", self.data, begin)

    def one(self, form: str):
        return self.many(form)[0]

    def count(self, least: int) -> int:
        """A number of items of ``least`` bytes at least."""
        n = self.one("I")
        if n > (len(self.data) + 4) // least:
            raise _Short
        return n

    def text(self) -> str:
        n = self.one("I")
        if self.at + n > len(self.data):
            raise _Short
        raw = self.data[self.at : self.at + n].partition(b"\0")[0]
        self.at += n
        if len(raw) > NAME:
            raise _Short
        return raw.decode("utf-8", "replace")

    def header(self) -> str:
        self.many("I", 2)  # the stamp
        return self.text()


def frame_id(c: Cursor) -> str | None:
    return c.header() or None


def point_fields(c: Cursor) -> list[tuple[str, str]]:
    c.header()
    c.many("I", 2)  # height and width
    out = []
    for _ in range(c.count(13)):
        name = c.text()
        c.one("I")
        kind = c.one("B")
        c.one("I")
        out.append((name, POINT_TYPES[kind] if kind < len(POINT_TYPES) else "unknown"))
    return out


def camera(c: Cursor) -> list[float]:
    """fx, fy, cx, cy, and what follows: the distortion."""
    c.header()
    c.many("I", 2)
    c.text()
    bend = c.many("d", c.count(8))
    k = c.many("d", 9)
    return [k[0], k[4], k[2], k[5], *bend]


def odometry(c: Cursor) -> list[float]:
    """Translation and rotation."""
    c.header()
    c.text()
    return list(c.many("d", 7))


def transforms(c: Cursor) -> list[tuple[str, str, list[float]]]:
    return [(c.header(), c.text(), list(c.many("d", 7))) for _ in range(c.count(60))]


def read(what, data: bytes):
    """What ``what`` finds at the head of a message; None if it isn't there."""
    try:
        return what(Cursor(data))
    except _Short:
        return None
