"""A verdict as JSON, SARIF, HTML and text; reports compared; provenance as JSON-LD."""

from __future__ import annotations

import html
import json
from collections import Counter
from urllib.parse import quote

from fidelis.operators import provenance as _provenance
from fidelis.plans.advice import ADVICE
from fidelis.plans.catalog import checks
from fidelis.plans.engine import Verdict

SCHEMA = "fidelis-report/1"
LEVEL = {"info": "note", "warning": "warning", "error": "error"}


def finding_dict(f) -> dict:
    return {"check_id": f.check_id, "severity": f.severity, "category": f.category, "code": f.code, "location": {"kind": f.loc_kind, "episode": f.episode, "stream": f.stream, "a": f.a, "b": f.b}, "message": f.message, "risk": _advice(f.check_id)[0], "remedy": _advice(f.check_id)[1]}


def _advice(check_id: str) -> tuple[str | None, str | None]:
    """What a check's findings put at risk and what helps; nothing is known of checks that others register."""
    return ADVICE.get(check_id, (None, None))


def as_dict(v: Verdict) -> dict:
    return {"schema": SCHEMA, "dataset": v.dataset_id, "coverage": v.coverage, "status": v.status, "counts": v.counts, "score": {"data": v.data_score, "provenance": v.provenance, "score": v.score, "grade": v.grade}, "executed": list(v.executed), "errored": dict(v.errored), "findings": [finding_dict(f) for f in v.findings], "digest": v.digest}


def to_json(v: Verdict) -> str:
    return json.dumps(as_dict(v), indent=2, ensure_ascii=False)


def to_sarif(v: Verdict) -> str:
    rules = sorted({f.code for f in v.findings} | ({"CHECK_ERRORED"} if v.errored else set()))
    told = {f.code: dict(zip(("fullDescription", "help"), ({"text": t} for t in _advice(f.check_id)), strict=True)) for f in v.findings if _advice(f.check_id)[0]}
    results = [{"ruleId": f.code, "level": LEVEL[f.severity], "message": {"text": f.message}, "locations": [{"logicalLocations": [{"fullyQualifiedName": "/".join(str(x) for x in (v.dataset_id, f.episode, f.stream) if x is not None)}]}]} for f in v.findings]
    results += [{"ruleId": "CHECK_ERRORED", "level": "error", "message": {"text": f"{k}: {e}"}} for k, e in sorted(v.errored.items())]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "fidelis", "rules": [{"id": r, **told.get(r, {})} for r in rules]}}, "results": results}]}, indent=2)


def _plain(text: str) -> str:
    """Without characters that steer a terminal."""
    return "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in text)


def worst(v: Verdict, n: int = 10) -> list[tuple[int, Counter]]:
    by: dict[int, Counter] = {}
    for f in v.findings:
        if f.episode is not None:
            by.setdefault(f.episode, Counter())[f.severity] += 1
    return sorted(by.items(), key=lambda x: (-x[1]["error"], -x[1]["warning"], -x[1]["info"], x[0]))[:n]


def to_text(v: Verdict) -> str:
    lines = [f"{_plain(v.dataset_id)}: {v.status}, {v.score} of 100 ({v.grade}), coverage {v.coverage}"]
    for f in v.findings:
        lines.append(f"  {f.severity:7} {f.code}: {_plain(f.message)}")
        lines += [f"          {word}: {text}" for word, text in zip(("risk", "remedy"), _advice(f.check_id), strict=True) if text]
    lines += [f"  not run: {k} ({e})" for k, e in sorted(v.errored.items())]
    lines += [f"  episode {i}: " + ", ".join(f"{c[s]} {s}" for s in ("error", "warning", "info") if c[s]) for i, c in worst(v)]
    return "\n".join(lines)


def to_html(v: Verdict) -> str:
    row = lambda f: f"<tr class='{f.severity}'><td>{f.severity}</td><td>{html.escape(f.code)}</td><td>{html.escape(f.message)}</td><td>{html.escape(_advice(f.check_id)[0] or '')}</td><td>{html.escape(_advice(f.check_id)[1] or '')}</td></tr>"
    return f"<!DOCTYPE html><html lang='en'><meta charset='utf-8'><title>{html.escape(v.dataset_id)}</title><h1>{html.escape(v.dataset_id)}</h1><p>{v.status}, {v.score} of 100 ({v.grade})</p><table>{''.join(map(row, v.findings))}</table></html>"


def catalog() -> list[dict]:
    return [{"id": c.id, "title": c.title, "category": c.category, "severity": c.severity, "version": c.version, "codes": c.codes, "risk": _advice(c.id)[0], "remedy": _advice(c.id)[1]} for c in checks()]


def difference(old: dict, new: dict) -> dict:
    """Two reports: findings that came, went and stayed, each as often as it stands there; and whether things got worse."""
    key = lambda f: json.dumps(f, sort_keys=True)
    before, after = {key(f) for f in old["findings"]}, {key(f) for f in new["findings"]}
    introduced = [f for f in new["findings"] if key(f) not in before]
    resolved = [f for f in old["findings"] if key(f) not in after]
    errored = sorted(set(new["errored"]) - set(old["errored"]))
    drop = new["score"]["score"] < old["score"]["score"]
    return {"introduced": introduced, "resolved": resolved, "unchanged": [f for f in new["findings"] if key(f) in before], "newly_errored": errored, "regression": bool(introduced or errored or drop or old["coverage"] != new["coverage"])}


def croissant(rec) -> dict:
    """A dataset description in JSON-LD; only real values are mapped."""
    real = {r["key"]: r["value"] for r in rec.provenance.where(_provenance.real(rec.provenance["value"], rec.provenance["class"])).collect()}
    out = {"@context": {"@vocab": "https://schema.org/", "cr": "http://mlcommons.org/croissant/"}, "@type": "Dataset", "name": rec.dataset_id, "conformsTo": "http://mlcommons.org/croissant/1.0"}
    return out | {there: real[here] for here, there in (("license", "license"), ("annotator", "creator"), ("upstream", "isBasedOn")) if here in real}


def iri(text: str) -> str:
    """A part of an address: every byte but letters, digits and ``-._~`` as a percentage sign and its number."""
    return quote(text, safe="-._~")


def w3c_prov(rec) -> dict:
    """The recording's lineage as W3C PROV in JSON-LD; only real values are mapped, each with how it is known."""
    rows = rec.provenance.where(_provenance.real(rec.provenance["value"], rec.provenance["class"])).select("scope_kind", "scope_episode", "scope_stream", "key", "value", "class").distinct().orderBy("scope_kind", "scope_episode", "scope_stream", "key", "value").collect()
    top = f"urn:dataset:{iri(rec.dataset_id)}"
    graph: dict[str, dict] = {top: {"@id": top, "@type": "prov:Entity", "rdfs:label": rec.dataset_id}}
    for r in rows:
        parts = [x for x in (None if r["scope_episode"] is None else f"episode/{r['scope_episode']}", r["scope_stream"] and f"stream/{iri(r['scope_stream'])}") if x]
        at = "/".join([top, *parts])
        node = graph.setdefault(at, {"@id": at, "@type": "prov:Entity", "prov:wasDerivedFrom": []} if at != top else {})
        if at != top and not node["prov:wasDerivedFrom"]:
            node["prov:wasDerivedFrom"].append({"@id": top})
        if r["key"] == "upstream":
            node.setdefault("prov:wasDerivedFrom", []).append({"@id": f"urn:source:{iri(r['value'])}"})
        elif r["key"] in ("annotator", "author", "recorder"):
            agent = f"urn:agent:{iri(r['value'])}"
            graph[agent] = {"@id": agent, "@type": "prov:Agent", "rdfs:label": r["value"]}
            node.setdefault("prov:wasAttributedTo", []).append({"@id": agent})
        else:
            node.setdefault("fidelis:element", []).append({"key": r["key"], "value": r["value"], "class": r["class"]})
    return {"@context": {"prov": "http://www.w3.org/ns/prov#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "fidelis": "urn:fidelis:"}, "@graph": list(graph.values())}
