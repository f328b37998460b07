"""Certificates: a content hash of a recording, a verdict bound to it, a signature over both, and what verifying says."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import asdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.functions import ed25519
from fidelis.model import SCHEMAS, Recording
from fidelis.plans.catalog import categories
from fidelis.plans.engine import RunConfig, Verdict
from fidelis.plans.report import _plain

SCHEMA, ALGORITHM, VERSION = "fidelis.certificate/1", "ed25519", "1"
_DOMAIN, _HASH = b"fidelis.certificate.sig.v1\0", "fidelis.content.v1"


class CertificateError(ValueError):
    """Why a certificate is not issued, or not believed."""


def _same(column, kind: T.DataType):
    """Numbers that are equal have one form: there is one NaN and one zero."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(column), F.lit("NaN")).when(column == 0, F.lit("0")).otherwise(column.cast("double").cast("string"))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_same(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _same(x, kind.elementType))
    return column


def content_hash(rec: Recording) -> str:
    """SHA-256 of what the tables of a recording hold, whatever the order and the partitions of their rows.

    Every row has a digest; a table's rows add up, in eight sums of 32 bits each, so they are summed where they are and a
    few numbers reach the driver. Places in order (ordinals, frame numbers) are columns, so order counts where it is data.
    """
    tables = {}
    for name in sorted(SCHEMAS):
        df = getattr(rec, name)
        row = F.to_json(F.struct(*(_same(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)), {"ignoreNullFields": "false"})
        part = lambda k: F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
        sums = df.select(F.sha2(row, 256).alias("d")).agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"s{k}") for k in range(8))).first()
        tables[name] = [sums["n"]] + [int(sums[f"s{k}"] or 0) % 2**256 for k in range(8)]
    return hashlib.sha256(json.dumps([_HASH, rec.dataset_id, tables], separators=(",", ":")).encode()).hexdigest()


def certifiable(verdict: Verdict) -> None:
    if verdict.coverage != "full":
        raise CertificateError(f"a {verdict.coverage} run is not certified: a certificate speaks for a whole dataset")


def build(verdict: Verdict, config: RunConfig, content: str, key_id: str, timestamp: str, ready: dict | None = None) -> dict:
    certifiable(verdict)
    ran = {c.partition(".")[0] for c in (*verdict.executed, *verdict.errored)}
    out = {
        "schema": SCHEMA, "dataset_id": verdict.dataset_id, "content_hash": content, "version": VERSION, "status": verdict.status, "verdict": verdict.digest,
        "config": {"categories": config.categories, "only": config.only, "disabled": list(config.disabled), "severities": dict(sorted(config.severities.items())), "tolerances": asdict(config.tolerances)},
        "checks_run": list(verdict.executed), "checks_errored": sorted(verdict.errored), "categories_skipped": [c for c in categories() if c not in ran],
        "findings": {"by_severity": verdict.counts, "by_category": dict(sorted(Counter(f.category for f in verdict.findings).items()))},
        "score": {"data": verdict.data_score, "provenance": verdict.provenance, "score": verdict.score, "grade": verdict.grade},
        "issuance": {"key_id": key_id, "timestamp": timestamp},
    }
    return out | ({"readiness": ready} if ready else {})


def _message(certificate: dict) -> bytes:
    return _DOMAIN + json.dumps(certificate, separators=(",", ":"), sort_keys=True, ensure_ascii=False).encode()


def key_of(text: str) -> bytes:
    """The 32 bytes of a key in hexadecimal digits."""
    if not re.fullmatch("[0-9a-fA-F]{64}", text.strip()):
        raise CertificateError("a key is 64 hexadecimal digits")
    return bytes.fromhex(text.strip())


def sign(certificate: dict, secret: str) -> dict:
    raw = key_of(secret)
    return {"certificate": certificate, "algorithm": ALGORITHM, "public_key": ed25519.public(raw).hex(), "signature": ed25519.sign(raw, _message(certificate)).hex()}


def verify(signed: dict, content: str | None = None, issuer: str | None = None) -> dict:
    """The issuance of a certificate that holds; else why it doesn't."""
    try:
        certificate, algorithm, key, signature = (signed[k] for k in ("certificate", "algorithm", "public_key", "signature"))
        schema, bound, issuance = (certificate[k] for k in ("schema", "content_hash", "issuance"))
    except (KeyError, TypeError):
        raise CertificateError("no signed certificate") from None
    if algorithm != ALGORITHM:
        raise CertificateError(f"the algorithm {algorithm} is not supported")
    if schema != SCHEMA:
        raise CertificateError(f"the schema {schema} is not {SCHEMA}")
    for name, text, n in (("signature", signature, 128), ("public key", key, 64)):
        if not isinstance(text, str) or not re.fullmatch(f"[0-9a-f]{{{n}}}", text):
            raise CertificateError(f"the {name} is not {n} lower-case hexadecimal digits")
    if issuer is not None and issuer.strip().lower() != key:
        if re.fullmatch("[0-9a-fA-F]{64}", issuer.strip()) and ed25519.public(key_of(issuer)).hex() == key:
            raise CertificateError("the key given is the issuer's secret key, not the public one")
        raise CertificateError(f"the certificate's key {key} is not the issuer's")
    if not ed25519.verify(bytes.fromhex(key), _message(certificate), bytes.fromhex(signature)):
        raise CertificateError("the signature doesn't fit: the certificate was altered or signed by another key")
    if content is not None and content != bound:
        note = "" if certificate.get("version") == VERSION else f"; it was issued by version {certificate.get('version')}, whose hashes may differ"
        raise CertificateError(f"the certificate is bound to {bound}, and the dataset has {content}{note}")
    return {"key_id": key, "timestamp": issuance.get("timestamp")}


def narrowed(config: dict) -> list[str]:
    """How a run looked at less than the whole catalog, or let more pass."""
    from fidelis.model import Tolerances

    out = [f"{k} = {', '.join(v) or 'none'}" for k in ("only", "categories") if (v := config.get(k)) is not None]
    out += [f"disabled = {', '.join(config['disabled'])}"] if config.get("disabled") else []
    out += [f"severity of {k} = {v}" for k, v in (config.get("severities") or {}).items()]
    usual = asdict(Tolerances())
    return out + [f"{k} = {v}, by default {usual[k]}" for k, v in (config.get("tolerances") or {}).items() if k in usual and v > usual[k]]


def warnings(signed: dict, issuer_checked: bool, dataset_checked: bool) -> list[str]:
    c = signed["certificate"]
    out = [] if issuer_checked else ["the issuer is not verified: anyone may have issued this certificate"]
    out += [] if dataset_checked else ["the dataset is not checked: nothing says that this certificate is about the data at hand"]
    if clauses := narrowed(c["config"]):
        out.append(f"a narrowed run of {len(c['checks_run'])} checks: {'; '.join(clauses)}")
    for key, what in (("checks_errored", "checks that failed and measured nothing"), ("categories_skipped", "categories without checks")):
        if c[key]:
            out.append(f"{what}: {', '.join(c[key])}")
    return out


def verified_text(signed: dict, issuer_checked: bool, dataset_checked: bool) -> str:
    c = signed["certificate"]
    lines = ["certificate verified", *(f"  warning: {_plain(w)}" for w in warnings(signed, issuer_checked, dataset_checked))]
    lines += [f"  dataset {_plain(c['dataset_id'])}, content {c['content_hash']}", f"  {c['status']}, {c['score']['score']} of 100 ({c['score']['grade']})", f"  issued {_plain(str(c['issuance']['timestamp']))} by {signed['public_key']}"]
    if r := c.get("readiness"):
        lines.append("  readiness: " + ("does not apply" if not r["applicable"] else "ready" if r["ready"] else "not ready"))
        lines += [f"    {'passed' if ok else 'not passed'}: {k}" for k, ok in r["criteria"].items()]
    return "\n".join(lines)


def verified_json(signed: dict, issuer_checked: bool, dataset_checked: bool) -> str:
    return json.dumps({"verified": True, "issuer_verified": issuer_checked, "dataset_checked": dataset_checked, "warnings": warnings(signed, issuer_checked, dataset_checked), **signed}, indent=2, ensure_ascii=False)
