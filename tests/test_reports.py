"""Advice in reports, departures from the defaults, and checks that others add."""

import json

import pytest
from pyspark.sql import functions as F

from fidelis.model import Recording, Tolerances
from fidelis.operators.base import Check, found
from fidelis.plans import advice, catalog, config, engine, report


def test_every_check_has_advice():
    assert set(advice.ADVICE) == {c.id for c in catalog.CHECKS}
    assert all(risk.endswith(".") and remedy.endswith(".") for risk, remedy in advice.ADVICE.values())


@pytest.fixture
def rec(spark):
    rec = Recording(spark, "<b>", "table")
    rec.put("episodes", spark.createDataFrame([(0, 0, 9, 1)], "ep_ord long, episode long, start_ts long, end_ts long"))
    rec.put("labels", spark.createDataFrame([(0, "ToD", "night"), (0, "weather", "rain"), (0, "colour", "x")], "ep_ord long, key string, value string"))
    return rec


def test_reports_tell_risk_and_remedy(rec):
    v = engine.run(rec, config.parse('only_checks = ["structural.episode-boundary"]\n[tolerances]\ngap_factor = 9'))
    risk, remedy = advice.ADVICE["structural.episode-boundary"]
    assert risk in report.to_text(v) and f"remedy: {remedy}" in report.to_text(v) and risk in report.to_html(v) and "&lt;b&gt;" in report.to_html(v)
    assert next(f for f in json.loads(report.to_json(v))["findings"] if f["code"] == "EPISODE_BOUNDARY")["remedy"] == remedy
    rules = {r["id"]: r for r in json.loads(report.to_sarif(v))["runs"][0]["tool"]["driver"]["rules"]}
    assert rules["EPISODE_BOUNDARY"]["help"]["text"] == remedy and "help" not in rules["SCOPE.NARROWED"]
    assert "gap_factor = 9, by default 3" in report.to_text(v) and Tolerances().departures() == []


def test_registered_checks_run_like_others(rec):
    mine = Check("custom.night", "Night", {"NIGHT": "info"}, lambda rec, tol: found(rec.labels.where("value = 'night'"), "NIGHT", "info"))
    try:
        catalog.register(mine)
        with pytest.raises(ValueError):
            catalog.register(mine)
        v = engine.run(rec, config.parse('categories = ["custom"]'))
        assert [f.code for f in v.findings if f.check_id != "engine"] == ["NIGHT"] and v.executed == ("custom.night",)
        assert "custom.night" in {c["id"] for c in report.catalog()} and "NIGHT" in report.to_text(v)
    finally:
        del catalog.BY_ID["custom.night"]


def test_scenarios_in_the_order_of_dimensions(rec):
    from fidelis import api

    assert [(r["key"], r["value"], r["episodes"]) for r in api.scenarios(rec)] == [("weather", "rain", 1), ("time_of_day", "night", 1)]
    assert rec.labels.where(F.col("key") == "colour").count() == 1 and api.references(rec) == []
