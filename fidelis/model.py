"""The neutral model of a recording: DataFrames of episodes, streams, frames and what belongs to them.

``ep_ord`` and ``st_ord`` are ordinals in canonical order; neither an episode's index nor a stream's name need be unique
(that they are is something checks find out), so the ordinals are the keys. Only ``frames`` is large; it is partitioned
and ordered by (ep_ord, st_ord, frame_idx) wherever order matters.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

_STATS = "struct<min:double,max:double,mean:double,std:double>"
_DIMS = "array<struct<dim:long,min:double,max:double,mean:double,std:double>>"
_MEDIA = "struct<uri:string,declared:struct<codec:string,width:long,height:long,fps:double>,observed:struct<codec:string,width:long,height:long,fps:double>,status:string,reason:string,frame_count:long>"

SCHEMAS = {
    "metadata": "key string, value string",
    "episodes": "ep_ord long, episode decimal(20,0), start_ts long, end_ts long, task string, declared_frame_count long",
    "streams": f"ep_ord long, st_ord long, name string, modality string, declared_rate_hz double, clock_id string, clock_kind string, dtype string, shape array<long>, stats {_STATS}, dim_stats {_DIMS}, observed_stats {_STATS}, observed_saturation struct<n:long,at_min:long,at_max:long,min:double,max:double,dim:long>, observed_non_finite long, observed_dim_stats {_DIMS}, media {_MEDIA}, frame_id string, point_fields array<struct<name:string,dtype:string>>",
    "frames": "ep_ord long, st_ord long, frame_idx long, ts long, content_hash string",
    "labels": "ep_ord long, key string, value string, ts long",
    "ego_poses": "ep_ord long, idx long, ts long, x double, y double, z double",
    "transforms": "parent_frame string, child_frame string",
    "intrinsics": "stream string",
    "provenance": "scope_kind string, scope_episode long, scope_stream string, record_id long, key string, value string, class string",
}


@dataclass
class Recording:
    """One dataset. A table that a source has nothing for is empty; columns that it doesn't know are null."""

    spark: SparkSession
    dataset_id: str
    format_id: str
    coverage: str = "full"  # full, sample or metadata-only
    tables: dict[str, DataFrame] = field(default_factory=dict)
    unread: list[str] = field(default_factory=list)
    notes: dict[str, list[str]] = field(default_factory=dict)
    kept: DataFrame | None = None  # the profile of the streams, while a run of checks reads it

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.tables[name]

    def put(self, name: str, df: DataFrame) -> Recording:
        """Sets a table; columns of its schema that ``df`` lacks become null."""
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        want = T._parse_datatype_string(SCHEMAS[name])
        self.tables[name] = df.select(*(F.col(c.name).cast(c.dataType).alias(c.name) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in want))
        return self

    @property
    def frames_read(self) -> bool:
        return self.coverage != "metadata-only"


@dataclass(frozen=True)
class Tolerances:
    """Bounds of the checks; times in ns."""

    clock_skew_ns: int = 50_000_000
    start_offset_ns: int = 50_000_000
    end_offset_ns: int = 50_000_000
    rate_deviation: float = 0.10
    gap_factor: float = 3.0
    jitter_cv: float = 0.5
    episode_duration_factor: float = 10.0
    saturation_fraction: float = 0.5
    saturation_min_samples: int = 20
    outlier_z: float = 10.0
    sequence_drop_fraction: float = 0.05
    ego_max_speed_mps: float = 100.0

    def loosened(self) -> list[str]:
        """Names of the bounds that let more pass than the defaults do."""
        default = Tolerances()
        return [f.name for f in fields(self) if getattr(self, f.name) > getattr(default, f.name)]

    def departures(self) -> list[str]:
        """The loosened bounds with what they are and what they are by default."""
        default = Tolerances()
        return [f"{n} = {getattr(self, n):g}, by default {getattr(default, n):g}" for n in self.loosened()]
