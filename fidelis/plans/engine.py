"""Running checks: selection, fault isolation, findings about the run itself, verdict, score and readiness."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame

from fidelis.model import Recording, Tolerances
from fidelis.operators import provenance
from fidelis.operators.base import RANKS, SEVERITIES, Check, is_rig, profiled
from fidelis.plans.catalog import categories, checks

DOMAIN = "fidelis.verdict.v1\0"
PROFILE = ("autonomy.rig-sync", "autonomy.sequence-complete", "autonomy.ego-pose-continuity", "autonomy.calibration-completeness", "autonomy.sensor-frame-resolution")


@dataclass(frozen=True)
class RunConfig:
    categories: tuple[str, ...] | None = None
    only: tuple[str, ...] | None = None
    disabled: tuple[str, ...] = ()
    severities: dict[str, str] = field(default_factory=dict)
    tolerances: Tolerances = Tolerances()
    fail_on: str = "error"
    min_score: int | None = None

    def selects(self, check: Check) -> bool:
        return (self.categories is None or check.category in self.categories) and (self.only is None or check.id in self.only) and check.id not in self.disabled


@dataclass(frozen=True)
class Finding:
    check_id: str
    category: str
    severity: str
    code: str
    loc_kind: str
    episode: int | None
    stream: str | None
    a: int | None
    b: int | None
    nums: tuple[float | None, ...]
    texts: tuple[str | None, ...]

    @property
    def message(self) -> str:
        """Numbers are written here, not by Spark, which rounds halves up."""
        at = {"dataset": "The dataset", "episode": f"Episode {self.episode}", "stream": f"Stream {self.stream}" + (f" of episode {self.episode}" if self.episode is not None else "")}
        place = at.get(self.loc_kind, f"Stream {self.stream} of episode {self.episode}, {self.a} to {self.b}")
        shown = ", ".join([number(x) for x in self.nums if x is not None] + [str(t) for t in self.texts if t is not None])
        return f"{place}: {self.code.replace('_', ' ').lower()}" + (f" ({shown})" if shown else "")

    def key(self) -> tuple:
        none = lambda x, low: (x is not None, low if x is None else x)
        return (self.check_id, RANKS[self.loc_kind], none(self.episode, 0), none(self.stream, ""), none(self.a, 0), none(self.b, 0), self.code, self.message, SEVERITIES.index(self.severity), self.category)


def number(x: float) -> str:
    return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else f"{x:.6g}"


@dataclass(frozen=True)
class Verdict:
    dataset_id: str
    coverage: str
    status: str
    counts: dict[str, int]
    findings: tuple[Finding, ...]
    executed: tuple[str, ...]
    errored: dict[str, str]
    digest: str
    provenance: int

    @property
    def data_score(self) -> int:
        n = {s: sum(f.severity == s and f.category != "provenance" for f in self.findings) for s in SEVERITIES}
        return max(0, min(100, 100 - 15 * n["error"] - 4 * n["warning"] - 10 * len(self.errored)))

    @property
    def score(self) -> int:
        return (7 * self.data_score + 3 * self.provenance) // 10

    @property
    def grade(self) -> str:
        return next((g for low, g in ((90, "A"), (80, "B"), (70, "C"), (60, "D")) if self.score >= low), "F")


def _collected(df: DataFrame) -> list[Finding]:
    whole = lambda x: int(x) if isinstance(x, Decimal) else x
    names = [f.name for f in fields(Finding)]
    return [Finding(**{k: whole(r[k]) if k not in ("nums", "texts") else tuple(r[k]) for k in names}) for r in df.collect()]


def own(code: str, severity: str, *texts: str) -> Finding:
    return Finding("engine", code.split(".")[0].lower(), severity, code, "dataset", None, None, None, None, (), texts)


def notices(rec: Recording, config: RunConfig, selected: list[Check]) -> list[Finding]:
    """What the run did not look at; no configuration can turn these off."""
    out = []
    if rec.coverage == "sample":
        out.append(own("COVERAGE.SAMPLE", "info"))
    if rec.coverage == "metadata-only":
        out.append(own("COVERAGE.METADATA_ONLY", "info"))
    if rec.unread:
        out.append(own("COVERAGE.SOURCE_UNREAD", "warning", *rec.unread))
    loose = config.tolerances.departures()
    changed = sorted(k for k in config.severities if any(c.id == k for c in selected))
    if len(selected) < len(checks()) or changed or loose:
        out.append(own("SCOPE.NARROWED", "info", f"{len(selected)} of {len(checks())} checks", *changed, *loose))
    return out


def run(rec: Recording, config: RunConfig | None = None) -> Verdict:
    """Selected checks, a job for each category; if one fails, each of its checks runs alone, so the failing one is named and the rest count."""
    config = config or RunConfig()
    selected = [c for c in checks() if config.selects(c)]
    errored: dict[str, str] = {}
    findings: list[Finding] = []
    with profiled(rec):
        for category in categories():
            parts: dict[str, DataFrame] = {}
            for c in selected:
                if c.category == category:
                    try:
                        parts[c.id] = c.run(rec, config.tolerances)
                    except Exception as e:  # noqa: BLE001  a check must not take the others with it
                        errored[c.id] = type(e).__name__
            try:
                findings += _collected(reduce(DataFrame.unionByName, parts.values())) if parts else []
            except Exception:  # noqa: BLE001
                for k, df in parts.items():
                    try:
                        findings += _collected(df)
                    except Exception as e:  # noqa: BLE001
                        errored[k] = type(e).__name__
    findings = [replace(f, severity=config.severities.get(f.check_id, f.severity)) for f in findings] + notices(rec, config, selected)
    findings.sort(key=Finding.key)
    counts = {s: sum(f.severity == s for f in findings) for s in SEVERITIES}
    status = "fail" if counts["error"] else "pass-with-warnings" if counts["warning"] or errored else "pass"
    classes = [r["class"] for r in provenance.coverage(rec).collect()]
    percent = 100 * sum(c != "unknown" for c in classes) // len(classes)
    view = {"dataset": rec.dataset_id, "coverage": rec.coverage, "status": status, "counts": counts, "findings": [asdict(f) for f in findings], "errored": sorted(errored), "executed": [c.id for c in selected]}
    digest = hashlib.sha256((DOMAIN + json.dumps(view, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()
    return Verdict(rec.dataset_id, rec.coverage, status, counts, tuple(findings), tuple(c.id for c in selected if c.id not in errored), errored, digest, percent)


def readiness(rec: Recording, verdict: Verdict) -> dict:
    """The profile for world models: it applies to whole rigs with poses, and each of its checks must have run and found nothing."""
    # One episode must have all: a rig's sensors, one of them a cloud or a camera, and poses.
    sees = rec.streams.where("modality IN ('point-cloud', 'video')").select("ep_ord")
    rig = not is_rig(rec).join(sees, "ep_ord", "left_semi").join(rec.ego_poses.select("ep_ord"), "ep_ord", "left_semi").isEmpty()
    narrowed = any(f.code == "SCOPE.NARROWED" for f in verdict.findings)
    applies = verdict.coverage == "full" and not narrowed and rig
    criteria = {c: c in verdict.executed and not any(f.check_id == c for f in verdict.findings) for c in PROFILE}
    return {"applicable": applies, "criteria": criteria, "ready": applies and all(criteria.values()) and verdict.status != "fail"}


def profile_tolerances(t: Tolerances) -> Tolerances:
    """The profile only tightens."""
    return replace(t, clock_skew_ns=min(t.clock_skew_ns, 20_000_000))


def exit_code(verdict: Verdict, config: RunConfig) -> int:
    if config.min_score is not None and verdict.score < config.min_score:
        return 20
    worst = max((SEVERITIES.index(f.severity) for f in verdict.findings), default=0)
    if worst >= SEVERITIES.index(config.fail_on):
        return 20
    return 10 if verdict.status == "pass-with-warnings" else 0

