"""What keys of recorded metadata say: the dimension of a scenario, a reference to a simulation, a kind of provenance."""

from __future__ import annotations

import os
import re

# The dimensions in their order, and the spellings of each.
DIMENSIONS = {
    "weather": ("weather", "weather_condition"),
    "time_of_day": ("time_of_day", "tod", "daytime", "time-of-day"),
    "environment": ("environment", "scene", "scene_type", "area", "road_type"),
    "lighting": ("lighting", "illumination"),
    "season": ("season",),
    "traffic": ("traffic", "traffic_density"),
}
# Provenance keys and the spellings of each.
PROVENANCE = {
    "license": ("license", "spdx", "spdx_license", "license_id"),
    "sensor": ("sensor", "sensors", "device", "camera_model", "lidar_model", "hardware"),
    "calibration": ("calibration", "calibration_id", "calib", "calibration_version"),
    "annotator": ("operator", "annotator", "author", "recorded_by", "operator_id"),
    "upstream": ("upstream", "derived_from", "source_dataset", "parent_dataset", "upstream_dataset"),
    "firmware": ("firmware", "firmware_version", "fw", "fw_version"),
    "calibration_session": ("calibration_session", "calib_session", "calibration_session_id"),
    "platform": ("platform", "vehicle", "vehicle_id", "platform_id"),
    "drive": ("drive", "drive_id", "run_id", "session_id", "log_id"),
    "region": ("region", "geo_region", "country", "locale"),
    "map_version": ("map_version", "map", "hdmap_version", "map_id"),
    "redaction": ("redaction", "redacted", "redaction_status", "pii_redaction"),
    "consent": ("consent", "consent_status", "data_consent"),
}
# Provenance key of each kind of reference, its spellings, the key of its version and its files' extension.
REFERENCES = {
    "scenario_ref": (("scenario", "scenario_file", "scenario_ref", "openscenario", "openscenario_file", "xosc", "xosc_file"), "scenario_version", ".xosc"),
    "map_ref": (("map_file", "map_ref", "opendrive", "opendrive_file", "xodr", "xodr_file", "road_network", "hd_map"), "map_version", ".xodr"),
    "osi_version": (("osi", "osi_version", "open_simulation_interface"), None, None),
    "simulator": (("simulator", "sim", "sim_version", "simulation_tool", "sim_tool"), None, None),
}
#: Bytes of a referenced file in which its header is looked for.
HEADER = 64 * 1024

_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _of(table: dict[str, tuple[str, ...]], key: str) -> str | None:
    key = key.strip().translate(_ASCII_LOWER)
    return next((name for name, spellings in table.items() if key in spellings), None)


def dimension(key: str) -> str | None:
    return _of(DIMENSIONS, key)


def provenance_key(key: str) -> str | None:
    return _of(PROVENANCE, key)


def reference(key: str) -> str | None:
    return _of({k: v[0] for k, v in REFERENCES.items()}, key)


def dotted_version(value: str) -> str | None:
    """The first run of numbers joined by dots whose first number has two digits at most: a date is no version."""
    runs = (m[0] for m in re.finditer(r"[0-9]+(?:\.[0-9]+)+|[0-9]+", value))
    return next((r for r in runs if "." in r and len(r.partition(".")[0]) <= 2), None)


def header_version(text: str) -> str | None:
    """``major.minor`` as the header element of an ASAM document has it, outside comments."""
    plain = re.sub(r"<!--.*?-->", "", text, flags=re.S).partition("<!--")[0]
    tag = re.search(r"<(?:fileheader|header)(?=[\s/>]|$)([^>]*)", plain, re.I)
    if not tag:
        return None
    values: dict[str, str] = {}
    for m in re.finditer(r"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag[1]):
        values.setdefault(m[1], m[2] if m[2] is not None else m[3])
    parts = [values.get(k, "") for k in ("revMajor", "revMinor")]
    return ".".join(parts) if all(re.fullmatch("[0-9]+", p) for p in parts) else None


def sidecar_version(root: str, kind: str, value: str) -> str | None:
    """The version in the header of the file that ``value`` names, if it lies in ``root`` and is of the kind."""
    extension, value = REFERENCES[kind][2], value.strip()
    if not extension or not value or os.path.isabs(value) or not value.lower().endswith(extension) or ".." in value.split("/"):
        return None
    root = os.path.realpath(root)
    path = os.path.realpath(os.path.join(root, value))
    if not path.startswith(root + os.sep) or not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        return header_version(f.read(HEADER).decode("utf-8", "replace"))


def elements(pairs: list[tuple[str, str]], root: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """Of metadata in the order of the file: provenance (key, value, class), the first of each key, and labels (dimension, value)."""
    known: dict[str, str] = {}
    labels: dict[str, str] = {}
    refs: dict[str, str] = {}
    for key, value in pairs:
        if not value.strip():
            continue
        for name, into in ((provenance_key(key), known), (reference(key), refs), (dimension(key), labels)):
            if name:
                into.setdefault(name, value)
    out = [(k, v, "known") for k, v in known.items()]
    for kind, value in refs.items():
        out.append((kind, value, "known"))
        version_key = REFERENCES[kind][1]
        if version_key and version_key not in known and (version := sidecar_version(root, kind, value) or dotted_version(value)):
            known[version_key] = version
            out.append((version_key, version, "known"))
    return out, list(labels.items())
