"""Names of video codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of codecs and the names that mean them.
FAMILIES = {
    "avc1": ("avc1", "avc3", "avc", "h264", "h.264", "x264"),
    "hvc1": ("hvc1", "hev1", "hevc", "h265", "h.265", "x265"),
    "av01": ("av01", "av1", "libsvtav1", "libaom-av1"),
    "vp09": ("vp09", "vp9"),
    "vp08": ("vp08", "vp8"),
    "mp4v": ("mp4v", "mpeg4"),
    "mjpg": ("mjpg", "mjpeg", "jpeg"),
    "apcn": ("apcn", "prores"),
}


def codec_family(name: Column) -> Column:
    """The family of a codec's name; null for one that is not known."""
    pairs = [F.lit(x) for family, names in FAMILIES.items() for n in names for x in (n, family)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(name)))
