"""The functions that programs call; the command line is made of them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fidelis.operators import provenance as _provenance
from fidelis.operators import rollup
from fidelis.plans import config as _config
from fidelis.plans import certificate, engine, report
from fidelis.sources import scenario
from fidelis.sources.registry import Options, open_recording


def check(spark: SparkSession, path: str, options: Options | None = None, config_toml: str = "", profile: bool = False) -> engine.Verdict:
    c = _config.parse(config_toml)
    if profile:
        from dataclasses import replace

        c = replace(c, tolerances=engine.profile_tolerances(c.tolerances))
    return engine.run(open_recording(spark, path, options), c)


def inspect(spark: SparkSession, path: str, options: Options | None = None) -> dict:
    """What a recording holds, without running checks."""
    rec = open_recording(spark, path, options)
    n = rec.frames.groupBy("ep_ord", "st_ord").count()
    s = rec.streams.join(n, ["ep_ord", "st_ord"], "left").groupBy("name", "modality", "dtype").agg({"ep_ord": "count", "count": "sum"}).orderBy("name")
    streams = [{"name": r["name"], "modality": r["modality"], "dtype": r["dtype"], "episodes": r["count(ep_ord)"], "frames": r["sum(count)"] or 0} for r in s.collect()]
    return {"schema": "fidelis-inspect/1", "dataset": rec.dataset_id, "format": rec.format_id, "coverage": rec.coverage, "episodes": rec.episodes.count(), "streams": streams, "simulation": references(rec), "scenarios": scenarios(rec), "provenance": {r["key"]: r["class"] for r in _provenance.coverage(rec).collect()}, "notes": rec.notes, "unread": rec.unread}


def references(rec) -> list[dict]:
    """What a recording says of the simulation it came from."""
    keys = [*scenario.REFERENCES, *(v[1] for v in scenario.REFERENCES.values() if v[1])]
    return [{"key": r["key"], "value": r["value"]} for r in rec.provenance.where(F.col("key").isin(keys)).orderBy("key").collect()]


def scenarios(rec) -> list[dict]:
    """How episodes spread over the values of each scenario dimension, the most frequent first."""
    return [r.asDict() for r in rollup.ordered_coverage(rec.labels).collect()]  # a row for each value of six dimensions


def catalog() -> list[dict]:
    return report.catalog()


def provenance(spark: SparkSession, path: str, options: Options | None = None) -> dict:
    return report.croissant(open_recording(spark, path, options))


def diff(old: dict, new: dict) -> dict:
    return report.difference(old, new)


def prov(spark: SparkSession, path: str, options: Options | None = None) -> dict:
    return report.w3c_prov(open_recording(spark, path, options))


def keygen() -> tuple[str, str]:
    """A new secret key and its public key, in hexadecimal digits."""
    import secrets

    from fidelis.functions import ed25519

    secret = secrets.token_bytes(32)
    return secret.hex(), ed25519.public(secret).hex()


def content_hash(spark: SparkSession, path: str) -> str:
    return certificate.content_hash(open_recording(spark, path))


def certify(spark: SparkSession, path: str, secret: str, options: Options | None = None, config_toml: str = "", profile: bool = False, timestamp: str | None = None) -> dict:
    """A signed certificate of a whole recording."""
    from datetime import UTC, datetime

    from fidelis.functions import ed25519

    c = _config.parse(config_toml)
    if profile:
        from dataclasses import replace

        c = replace(c, tolerances=engine.profile_tolerances(c.tolerances))
    key = certificate.key_of(secret)
    rec = open_recording(spark, path, options)
    v = engine.run(rec, c)
    certificate.certifiable(v)
    when = timestamp or datetime.now(UTC).isoformat(timespec="seconds")
    return certificate.sign(certificate.build(v, c, certificate.content_hash(rec), ed25519.public(key).hex(), when, engine.readiness(rec, v) if profile else None), secret)


def verify(signed: dict, spark: SparkSession | None = None, path: str | None = None, issuer: str | None = None) -> dict:
    return certificate.verify(signed, content_hash(spark, path) if path else None, issuer)


def readiness(spark: SparkSession, path: str, options: Options | None = None) -> dict:
    rec = open_recording(spark, path, options)
    from dataclasses import replace

    c = engine.RunConfig()
    return engine.readiness(rec, engine.run(rec, replace(c, tolerances=engine.profile_tolerances(c.tolerances))))


def formats() -> list[str]:
    from fidelis.sources.registry import formats as all_of

    return [f.id for f in all_of()]
