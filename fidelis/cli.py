"""python -m fidelis.cli check|inspect|checks|diff|provenance|certify|verify|keygen

Exit codes: 0 passed, 10 passed with warnings, 20 failed or below the score asked for, 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from fidelis import api
from fidelis.plans import certificate, config, engine, report
from fidelis.session import session
from fidelis.sources.registry import Options, SourceError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fidelis")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "inspect", "provenance"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format")
        c.add_argument("--max-frames", type=int, default=20_000_000)
        if name != "provenance":
            c.add_argument("--sample-episodes", type=int)
            c.add_argument("--sample-fraction", type=float)
            c.add_argument("--sample-seed", type=int, default=0)
            c.add_argument("--metadata-only", action="store_true")
        if name == "check":
            form = c.add_mutually_exclusive_group()
            for f in ("json", "sarif", "html"):
                form.add_argument(f"--{f}", action="store_true")
            c.add_argument("--config")
            c.add_argument("--fail-on", choices=("info", "warning", "error"))
            c.add_argument("--min-score", type=int)
            c.add_argument("--profile", choices=("world-model-ready",))
    sub.add_parser("checks")
    sub.choices["provenance"].add_argument("--prov", action="store_true", help="W3C PROV instead of a dataset description")
    k = sub.add_parser("keygen")
    k.add_argument("out", help="file of the secret key; the public one is written beside it, with .pub")
    c = sub.add_parser("certify")
    c.add_argument("path")
    c.add_argument("--key", required=True, help="file of the secret key")
    c.add_argument("--out")
    c.add_argument("--format")
    c.add_argument("--config")
    c.add_argument("--profile", choices=("world-model-ready",))
    v = sub.add_parser("verify")
    v.add_argument("certificate")
    v.add_argument("path", nargs="?")
    v.add_argument("--key", help="file or digits of the issuer's public key")
    v.add_argument("--json", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--fail-on-regression", action="store_true")
    return p


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False, default=str))
    try:
        if a.command == "checks":
            show(api.catalog())
            return 0
        if a.command == "diff":
            d = api.diff(_load(a.old), _load(a.new))
            show(d)
            return 20 if a.fail_on_regression and d["regression"] else 0
        if a.command == "keygen":
            secret, public = api.keygen()
            for path, text, mode in ((a.out, secret, 0o600), (f"{a.out}.pub", public, 0o644)):
                with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode), "w") as f:
                    f.write(text + "\n")
            print(public)
            return 0
        if a.command == "certify":
            signed = api.certify(session("fidelis"), a.path, _text(a.key), Options(a.format), _text(a.config) if a.config else "", a.profile is not None)
            text = json.dumps(signed, indent=2, ensure_ascii=False)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(text + "\n")
            else:
                print(text)
            return 0
        if a.command == "verify":
            signed, key = _load(a.certificate), a.key and (_text(a.key) if os.path.exists(a.key) else a.key).strip()
            api.verify(signed, session("fidelis") if a.path else None, a.path, key)
            say = certificate.verified_json if a.json else certificate.verified_text
            print(say(signed, key is not None, a.path is not None))
            return 0
        sampled = a.command != "provenance"
        o = Options(a.format, a.sample_episodes if sampled else None, a.sample_fraction if sampled else None, a.sample_seed if sampled else 0, sampled and a.metadata_only, a.max_frames)
        spark = session("fidelis")
        if a.command == "inspect":
            show(api.inspect(spark, a.path, o))
            return 0
        if a.command == "provenance":
            show((api.prov if a.prov else api.provenance)(spark, a.path, o))
            return 0
        toml = _text(a.config) if a.config else ""
        from dataclasses import replace

        c = config.parse(toml)
        c = replace(c, fail_on=a.fail_on or c.fail_on, min_score=a.min_score if a.min_score is not None else c.min_score)
        if c.min_score is not None and (o.sampled or o.metadata_only):
            raise SourceError("a score over part of a dataset is no score of it")
        if c.min_score is not None and (c.only is not None or c.categories is not None or c.disabled or c.severities or c.tolerances.loosened()):
            raise SourceError("a score within a narrowed run is no score of the dataset")
        v = api.check(spark, a.path, o, toml, a.profile is not None)
        print(report.to_json(v) if a.json else report.to_sarif(v) if a.sarif else report.to_html(v) if a.html else report.to_text(v))
        return engine.exit_code(v, c)
    except (SourceError, config.ConfigError, certificate.CertificateError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
