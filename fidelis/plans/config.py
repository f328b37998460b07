"""Configuration files (TOML); unknown keys, unknown checks and values out of range are refused."""

from __future__ import annotations

import tomllib
from dataclasses import replace

from fidelis.model import Tolerances
from fidelis.operators.base import SEVERITIES
from fidelis.plans.catalog import BY_ID, categories
from fidelis.plans.engine import RunConfig


class ConfigError(ValueError):
    pass


# Keys of the tolerances, the bound each sets, its factor, and what values it may have.
TOLERANCES = {
    "clock_skew_ms": ("clock_skew_ns", 1e6, lambda x: x >= 0),
    "start_offset_ms": ("start_offset_ns", 1e6, lambda x: x >= 0),
    "end_offset_ms": ("end_offset_ns", 1e6, lambda x: x >= 0),
    "rate_deviation": ("rate_deviation", 1, lambda x: x >= 0),
    "gap_factor": ("gap_factor", 1, lambda x: x > 0),
    "jitter_cv": ("jitter_cv", 1, lambda x: x >= 0),
    "episode_duration_factor": ("episode_duration_factor", 1, lambda x: x > 1),
    "saturation_fraction": ("saturation_fraction", 1, lambda x: 0 < x <= 1),
    "saturation_min_samples": ("saturation_min_samples", 1, lambda x: x >= 1),
    "outlier_z": ("outlier_z", 1, lambda x: x > 1),
    "sequence_drop_fraction": ("sequence_drop_fraction", 1, lambda x: 0 <= x < 1),
    "ego_max_speed_mps": ("ego_max_speed_mps", 1, lambda x: x > 0),
}
KEYS = {"fail_on", "categories", "only_checks", "disabled_checks", "severity_overrides", "min_score", "tolerances"}


def parse(text: str) -> RunConfig:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    if unknown := sorted(set(raw) - KEYS):
        raise ConfigError(f"unknown keys: {', '.join(unknown)}")
    ids = [*raw.get("only_checks", []), *raw.get("disabled_checks", []), *raw.get("severity_overrides", {})]
    if unknown := sorted(set(ids) - set(BY_ID)):
        raise ConfigError(f"unknown checks: {', '.join(unknown)}")
    if unknown := sorted(set(raw.get("categories", [])) - set(categories())):
        raise ConfigError(f"unknown categories: {', '.join(unknown)}")
    for s in [raw.get("fail_on", "error"), *raw.get("severity_overrides", {}).values()]:
        if s not in SEVERITIES:
            raise ConfigError(f"no severity: {s}")
    score = raw.get("min_score")
    if score is not None and not (isinstance(score, int) and 0 <= score <= 100):
        raise ConfigError("min_score lies from 0 to 100")
    tol = Tolerances()
    for k, v in raw.get("tolerances", {}).items():
        if k not in TOLERANCES:
            raise ConfigError(f"unknown tolerance: {k}")
        name, factor, ok = TOLERANCES[k]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or not ok(v):
            raise ConfigError(f"{k} is out of range: {v}")
        tol = replace(tol, **{name: type(getattr(tol, name))(v * factor)})
    pick = lambda k: tuple(raw[k]) if k in raw else None
    return RunConfig(pick("categories"), pick("only_checks"), tuple(raw.get("disabled_checks", ())), dict(raw.get("severity_overrides", {})), tol, raw.get("fail_on", "error"), score)
