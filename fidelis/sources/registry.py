"""Formats, and which of them a path is in."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from fidelis.model import Recording


class SourceError(ValueError):
    """A source that can't be read, or options that it can't be read with."""


#: Bytes that any source may expand to.
EXPANDED = 64 << 20


@dataclass(frozen=True)
class Options:
    format: str | None = None
    first: int | None = None
    fraction: float | None = None
    seed: int = 0
    metadata_only: bool = False
    max_frames: int = 20_000_000

    #: Bytes that a source may expand to: so many times its own, or ``EXPANDED`` if that is more.
    max_expansion: int = 100

    def expanded(self, made: int, size: int) -> None:
        """Refuses a source of ``size`` bytes that declares or makes too many."""
        if made > max(EXPANDED, self.max_expansion * size):
            raise SourceError(f"{made} bytes out of {size} are over the decompression budget")

    @property
    def sampled(self) -> bool:
        return self.first is not None or self.fraction is not None


@dataclass(frozen=True)
class Format:
    id: str
    detect: Callable[[str], bool]
    read: Callable[[SparkSession, str, Options], Recording]
    metadata_only: bool = False
    samples: bool = False


_more: list[Format] = []


def register(format: Format) -> Format:
    """Adds a reader to those that ``open_recording`` chooses from; its id must be new."""
    if any(f.id == format.id for f in formats()):
        raise ValueError(f"{format.id} is registered")
    _more.append(format)
    return format


def formats() -> list[Format]:
    from fidelis.sources import candbc, hdf5, lerobot, mcap, mdf4, rlds, zarr

    return [lerobot.FORMAT, candbc.FORMAT, mcap.FORMAT, rlds.FORMAT, zarr.FORMAT, hdf5.FORMAT, mdf4.FORMAT, *_more]


def dataset_id(path: str) -> str:
    """The folder's real name, so that no spelling of the path changes it."""
    return os.path.basename(os.path.realpath(path))


def open_recording(spark: SparkSession, path: str, options: Options | None = None) -> Recording:
    o = options or Options()
    if "://" in path:
        raise SourceError("remote sources are not read")
    if not os.path.exists(path):
        raise SourceError(f"no such path: {path}")
    if o.metadata_only and o.sampled:
        raise SourceError("metadata alone has no sample")
    all_of = formats()
    if o.format:
        fits = [f for f in all_of if f.id == o.format]
    else:
        fits = [f for f in all_of if f.detect(path)]
    if not fits:
        raise SourceError(f"not one of the formats {', '.join(f.id for f in all_of)}")
    if len(fits) > 1:
        raise SourceError(f"ambiguous: {', '.join(f.id for f in fits)}")
    f = fits[0]
    if o.metadata_only and not f.metadata_only:
        raise SourceError(f"{f.id} has no metadata without frames")
    if o.sampled and not f.samples:
        raise SourceError(f"{f.id} has one episode")
    return f.read(spark, path, o)
