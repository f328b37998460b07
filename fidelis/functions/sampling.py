"""Selecting episodes before a scan."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first(indices: list[int], n: int) -> list[int]:
    """The ``n`` lowest."""
    return sorted(set(indices))[:n]


def fraction(indices: list[int], share: float, seed: int) -> list[int]:
    """About ``share`` of the indices, one at least: those with the smallest hash of seed and index, ties by index."""
    all_of = sorted(set(indices))
    if not all_of:
        return []
    if not 0 < share <= 1:
        raise ValueError("a share lies over 0 and is 1 at most")
    rank = lambda i: (int.from_bytes(hashlib.sha256(seed.to_bytes(8, "little") + i.to_bytes(8, "little")).digest()[:8], "little"), i)
    n = min(len(all_of), max(1, math.ceil(share * len(all_of))))
    return sorted(sorted(all_of, key=rank)[:n])


def little_endian(x: int) -> str:
    """The eight bytes of ``x``, lowest first, in hexadecimal digits."""
    return x.to_bytes(8, "little").hex()


#: DuckDB: the same of a column ``u``, and the order of digests ``d`` by their first eight bytes, lowest first.
LITTLE_ENDIAN_SQL = " || ".join(f"printf('%02x', (u >> {8 * k}) & 255)" for k in range(8))
RANK_SQL = " || ".join(f"substr(d, {2 * k + 1}, 2)" for k in reversed(range(8)))


def fraction_of(episodes: DataFrame, index: str, share: float, seed: int) -> DataFrame:
    """What ``fraction`` chooses, as rows of ``episodes``: indices stay in tables, and only their number is collected."""
    if not 0 < share <= 1:
        raise ValueError("a share lies over 0 and is 1 at most")
    i = F.col(index).cast("long")
    low_first = F.concat(*(F.lpad(F.hex(F.shiftright(i, 8 * k).bitwiseAND(255)), 2, "0") for k in range(8)))
    # The first eight bytes of the digest are a number, lowest byte first: reversed pairs of digits order alike as text.
    digest = F.sha2(F.unhex(F.concat(F.lit(little_endian(seed)), low_first)), 256)
    rank = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in reversed(range(8))))
    n = episodes.select(index).distinct().count()
    chosen = episodes.select(F.col(index).alias("i"), rank.alias("r")).distinct().orderBy("r", "i").limit(min(n, max(1, math.ceil(share * n)))).select("i")
    return episodes.join(chosen, episodes[index] == chosen["i"], "left_semi")
