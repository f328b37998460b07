import json

from fidelis import cli


def test_checks_are_listed(capsys):
    assert cli.main(["checks"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 38


def test_reports_are_compared(tmp_path, capsys):
    f = lambda code: {"code": code, "severity": "warning"}
    base = {"findings": [f("A"), f("A"), f("B")], "errored": {}, "coverage": "full", "score": {"score": 90}}
    (tmp_path / "a").write_text(json.dumps(base))
    (tmp_path / "b").write_text(json.dumps(base | {"findings": [f("A"), f("A"), f("C")]}))
    assert cli.main(["diff", str(tmp_path / "a"), str(tmp_path / "b"), "--fail-on-regression"]) == 20
    d = json.loads(capsys.readouterr().out)
    assert ([x["code"] for x in d["introduced"]], [x["code"] for x in d["resolved"]], len(d["unchanged"])) == (["C"], ["B"], 2)
    assert cli.main(["diff", str(tmp_path / "a"), str(tmp_path / "a"), "--fail-on-regression"]) == 0


def test_wrong_use(tmp_path):
    assert cli.main(["diff", str(tmp_path / "none"), str(tmp_path / "none")]) == 2
