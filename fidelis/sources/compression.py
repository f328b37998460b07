"""Compressed blocks of recordings, each inflated to a stated size at most, and checksums of theirs."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import zstandard


class Corrupt(ValueError):
    """A block that doesn't hold what it declares."""


def _lz4_block(data: bytes, out: bytearray, most: int) -> None:
    """Appends an LZ4 block: tokens of literals and of copies from what was written before."""
    at, end = 0, len(data)

    def length(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                if at >= end:
                    raise Corrupt("an LZ4 block ends inside a length")
                more = data[at]
                at += 1
                n += more
                if more != 255:
                    break
        return n

    while at < end:
        token = data[at]
        at += 1
        n = length(token >> 4)
        if at + n > end or len(out) + n > most:
            raise Corrupt("an LZ4 block runs over its end")
        out += data[at : at + n]
        at += n
        if at == end:
            return
        if at + 2 > end:
            raise Corrupt("an LZ4 block ends inside an offset")
        back = data[at] | data[at + 1] << 8
        at += 2
        n = length(token & 15) + 4
        if not 0 < back <= len(out) or len(out) + n > most:
            raise Corrupt("an LZ4 copy leads out of the block")
        start = len(out) - back
        if back >= n:
            out += out[start : start + n]
        else:  # a copy that overlaps itself repeats
            piece = bytes(out[start:])
            out += (piece * (n // back + 1))[:n]


def lz4_block(data: bytes, size: int) -> bytes:
    out = bytearray()
    _lz4_block(data, out, size)
    return bytes(out)


def lz4_frame(data: bytes, most: int) -> bytes:
    """An LZ4 frame; checksums are passed over."""
    out, at = bytearray(), 0
    while at < len(data):
        if data[at : at + 4] != b"\x04\x22\x4d\x18" or at + 7 > len(data):
            raise Corrupt("no LZ4 frame")
        flags = data[at + 4]
        at += 6 + 8 * (flags >> 3 & 1) + 4 * (flags & 1) + 1
        while True:
            if at + 4 > len(data):
                raise Corrupt("an LZ4 frame ends early")
            n = int.from_bytes(data[at : at + 4], "little")
            at += 4
            if not n:
                break
            plain, n = n >> 31, n & 0x7FFFFFFF
            if at + n > len(data):
                raise Corrupt("an LZ4 frame ends early")
            if plain:
                out += data[at : at + n]
                if len(out) > most:
                    raise Corrupt("an LZ4 frame holds more than it declares")
            else:
                _lz4_block(data[at : at + n], out, most)
            at += n + 4 * (flags >> 4 & 1)
        at += 4 * (flags >> 2 & 1)
    return bytes(out)


def zstd(data: bytes, most: int) -> bytes:
    try:
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
            out = r.read(most + 1)
    except zstandard.ZstdError as e:
        raise Corrupt(str(e)) from None
    if len(out) > most:
        raise Corrupt("a zstd stream holds more than it declares")
    return out


def deflate(data: bytes, most: int, wrap: int = 15) -> bytes:
    """zlib (``wrap`` 15) or gzip (31)."""
    z = zlib.decompressobj(wrap)
    try:
        out = z.decompress(data, most + 1)
    except zlib.error as e:
        raise Corrupt(str(e)) from None
    if len(out) > most:
        raise Corrupt("a deflated stream holds more than it declares")
    return out


def unshuffle(data: bytes, width: int) -> bytes:
    """Bytes that were sorted by their place in an item, in the order of the items again; a rest stays as it is."""
    n = len(data) // width
    head = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return head.tobytes() + data[n * width :]


def blosc(data: bytes, most: int) -> bytes:
    """A Blosc 1 chunk of LZ4, zstd or zlib blocks, shuffled by bytes or not at all."""
    if len(data) < 16:
        raise Corrupt("a Blosc chunk without a header")
    flags, width = data[2], max(1, data[3])
    size, block = (int.from_bytes(data[k : k + 4], "little") for k in (4, 8))
    if size > most:
        raise Corrupt("a Blosc chunk holds more than it declares")
    if flags & 2:
        return bytes(data[16 : 16 + size])
    if flags & 4:
        raise Corrupt("a Blosc chunk that is shuffled by bits")
    inflate = {1: lz4_block, 3: deflate, 4: zstd}.get(flags >> 5)
    if inflate is None or not block:
        raise Corrupt("a codec of Blosc that is not read")
    out = []
    for k in range(-(-size // block)):
        n = min(block, size - k * block)
        at = int.from_bytes(data[16 + 4 * k : 20 + 4 * k], "little")
        # A whole block is cut into one stream for each byte of an item, unless the chunk says it isn't.
        parts = width if not flags & 16 and n == block and width <= 16 and block // width >= 128 else 1
        got = bytearray()
        for _ in range(parts):
            long = int.from_bytes(data[at : at + 4], "little")
            raw = data[at + 4 : at + 4 + long]
            if long > len(data) or len(raw) != long:
                raise Corrupt("a Blosc block ends early")
            share = n // parts
            got += raw if long == share else inflate(raw, share)
            at += 4 + long
        out.append(unshuffle(bytes(got), width) if flags & 1 and width > 1 else bytes(got))
    whole = b"".join(out)
    if len(whole) != size:
        raise Corrupt("a Blosc chunk holds less than it declares")
    return whole


@lru_cache
def _crc32c_table() -> list[int]:
    """Remainders of all bytes by the Castagnoli polynomial, lowest bit first."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0x82F63B78 if byte & 1 else 0)
        table.append(byte)
    return table


#: Bytes of one lane, and from how many bytes on lanes are used.
LANE, LANES_FROM = 1024, 1 << 14


def _advance(state: np.ndarray, columns) -> np.ndarray:
    """States of lanes after the bytes of each column."""
    table = np.array(_crc32c_table(), np.uint32)
    for column in columns:
        state = table[(state ^ column) & np.uint32(255)] ^ state >> np.uint32(8)
    return state


@lru_cache
def _over_a_lane() -> list[list[int]]:
    """What each byte of a state becomes after a lane of zeros; a state's bytes add up by exclusive or."""
    basis = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]).reshape(-1)
    return _advance(basis, [np.uint32(0)] * LANE).reshape(4, 256).tolist()


def crc32c(data: bytes) -> int:
    c, n = 0xFFFFFFFF, 0
    if len(data) >= LANES_FROM:  # lanes are summed side by side, and then joined
        n = len(data) // LANE * LANE
        lanes = np.frombuffer(data, np.uint8, n).reshape(-1, LANE).T.astype(np.uint32)
        a, b, d, e = _over_a_lane()
        for lane in _advance(np.zeros(n // LANE, np.uint32), lanes).tolist():
            c = a[c & 255] ^ b[c >> 8 & 255] ^ d[c >> 16 & 255] ^ e[c >> 24] ^ lane
    table = _crc32c_table()
    for byte in data[n:]:
        c = table[(c ^ byte) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked_crc32c(data: bytes) -> int:
    """As record files keep it: rotated by 15 bits, and a constant added."""
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def fletcher32(data: bytes) -> int:
    """Sums of 16-bit words, highest byte first, and of these sums, both modulo 65535; an odd byte is a word's upper half."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.uint64)
    first = int(words.sum()) % 65535
    second = int((words * np.arange(len(words), 0, -1, dtype=np.uint64) % np.uint64(65535)).sum()) % 65535
    # A sum that isn't 0 is never reduced to 0 but to 65535.
    any_word = bool(words.any())
    return (second or 65535 * any_word) << 16 | (first or 65535 * any_word)
