"""Recordings read from files made here."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fidelis.functions import sampling
from fidelis.plans import config, engine, report
from fidelis.sources.registry import Options, SourceError, open_recording


@pytest.fixture
def robot(tmp_path):
    def make(lengths=(10, 10), spike=None, declared=None, stats=None):
        root = tmp_path / "robot"
        (root / "meta").mkdir(parents=True)
        (root / "data/chunk-000").mkdir(parents=True)
        info = {"codebase_version": "v3.0", "fps": 30, "total_episodes": len(lengths), "total_frames": sum(lengths), "features": {"action": {"dtype": "float32", "shape": [1]}, "observation.state": {"dtype": "float32", "shape": [2]}}}
        (root / "meta/info.json").write_text(json.dumps(info))
        (root / "meta/episodes.jsonl").write_text("".join(json.dumps({"episode_index": i, "length": (declared or lengths)[i]}) + "\n" for i in range(len(lengths))))
        (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "pick"}\nbroken\n{"task_index": 1, "task": "place"}\n')
        if stats:
            (root / "meta/stats.json").write_text(json.dumps(stats))
        (root / "README.md").write_text("---\nlicense: mit\n---\n# A dataset\n")
        ep = [i for i, n in enumerate(lengths) for _ in range(n)]
        fi = [k for n in lengths for k in range(n)]
        act = [float((3 * e + k) % 7) for e, k in zip(ep, fi)]
        if spike is not None:
            act[spike] = 1000.0
        t = pa.table({"episode_index": ep, "frame_index": fi, "timestamp": [k / 30 for k in fi], "task_index": [int(k > 4) for k in fi], "action": pa.array(act, pa.float32()), "observation.state": [[float(k + e), 1.0] for e, k in zip(ep, fi)]})
        pq.write_table(t, root / "data/chunk-000/file-000.parquet")
        return str(root)

    return make


def found(v):
    return {f.code for f in v.findings if not f.code.startswith(("MISSING", "NO_STORED", "SCOPE"))}


def test_clean_robot(spark, robot):
    rec = open_recording(spark, robot())
    v = engine.run(rec)
    assert found(v) == set() and not v.errored and v.coverage == "full" and v.dataset_id == "robot"
    assert {r["value"] for r in rec.labels.collect()} == {"place"} and {r["task"] for r in rec.episodes.collect()} == {"pick"}
    assert json.loads(report.to_json(v))["digest"] == v.digest and json.loads(report.to_sarif(v))["version"] == "2.1.0"
    assert "robot" in report.to_text(v) and "<table>" in report.to_html(v)
    assert report.croissant(rec)["license"] == "mit"
    narrow = config.parse('only_checks = ["temporal.jitter"]')
    assert [f.code for f in engine.run(rec, narrow).findings] == ["SCOPE.NARROWED"]
    assert engine.run(rec, narrow).digest == engine.run(rec, narrow).digest != v.digest


def test_defects(spark, robot):
    v = engine.run(open_recording(spark, robot((80, 80), spike=75, declared=(80, 70), stats={"action": {"min": [0], "max": [7], "mean": [3], "std": [2]}})), config.parse('only_checks = ["statistical.extreme-outlier", "statistical.stored-vs-observed", "structural.episode-boundary"]'))
    assert {"OUTLIER", "EPISODE_BOUNDARY", "STATS_STALE"} <= found(v) and v.status == "fail"


def test_samples_and_metadata(spark, robot):
    path = robot((5, 6, 7))
    one = open_recording(spark, path, Options(first=1))
    assert one.coverage == "sample" and one.frames.select("ep_ord").distinct().count() == 1
    meta = open_recording(spark, path, Options(metadata_only=True))
    assert meta.streams.count() == 6 and meta.frames.count() == 0
    assert "COVERAGE.METADATA_ONLY" in {f.code for f in engine.run(meta, config.parse('only_checks = ["structural.episode-continuity"]')).findings}
    for bad in (Options(first=1, metadata_only=True), Options(max_frames=3), Options(format="none")):
        with pytest.raises(SourceError):
            open_recording(spark, path, bad)


def test_can(spark, tmp_path):
    root = tmp_path / "can"
    root.mkdir()
    (root / "a.dbc").write_text("BO_ 256 Engine: 8 X\n SG_ Speed : 0|16@1+ (0.25,0) [0|1] \"\" X\n SG_ Temp : 16|8@1- (1,-40) [0|1] \"\" X\n SG_ Wheel : 39|16@0+ (1,0) [0|1] \"\" X\nBO_ 257 Mux: 8 X\n SG_ Sel M : 0|8@1+ (1,0) [0|1] \"\" X\n SG_ A m0 : 8|8@1+ (1,0) [0|1] \"\" X\n SG_ B m1 : 8|8@1+ (2,0) [0|1] \"\" X\n")
    (root / "a.log").write_text("(1000.000000) can0 100#40010000123434FF\n(1000.5) can0 101#0105\nnoise\n(1001.000000001) can0 101#0007\n(1001.1) can0 200#00\n")
    (root / "b.asc").write_text("(1002.0) can0 101#0109\n")
    rec = open_recording(spark, str(root))
    s = {r["name"]: r["observed_stats"] for r in rec.streams.collect()}
    assert s["Mux.B"]["max"] == 18 and s["Mux.Sel"]["max"] == 1
    assert s["Engine.Speed"]["min"] == 0x0140 * 0.25 and s["Engine.Temp"]["min"] == -40 and s["Engine.Wheel"]["min"] == 0x1234
    assert s["Mux.A"]["min"] == 7 and s["Mux.B"]["min"] == 10
    assert rec.notes["undefined"] == ["512: 1"] and 1_001_000_000_001 in {r["ts"] for r in rec.frames.collect()}


def test_sampling_is_steady():
    a = sampling.fraction(list(range(100)), 0.2, 7)
    assert len(a) == 20 and a == sampling.fraction(list(range(100))[::-1], 0.2, 7) != sampling.fraction(list(range(100)), 0.2, 8)
    assert sampling.fraction([5], 0.01, 1) == [5] and sampling.first([3, 1, 2], 2) == [1, 2]


@pytest.mark.parametrize("text", ["x = 1", 'only_checks = ["no.such"]', "[tolerances]\ngap_factor = 0", "min_score = 101", 'fail_on = "bad"', "[tolerances]\nnone = 1", "="])
def test_configuration_is_refused(text):
    with pytest.raises(config.ConfigError):
        config.parse(text)


def test_configuration():
    c = config.parse('fail_on = "warning"\ndisabled_checks = ["temporal.gap"]\n[tolerances]\nclock_skew_ms = 20')
    assert c.tolerances.clock_skew_ns == 20_000_000 and c.tolerances.loosened() == [] and c.fail_on == "warning"
