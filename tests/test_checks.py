"""Positive, negative and abstaining cases of checks on small recordings made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from fidelis.model import Recording, Tolerances
from fidelis.operators import autonomy, semantic, statistical, structural, temporal
from fidelis.plans import catalog
from fidelis.plans.catalog import BY_ID

MS = 1_000_000


def recording(spark, *streams, episodes=None, **columns):
    """streams: (episode, name, [ts in ms]) or with a dict of more columns behind."""
    s, f = [], []
    for k, (ep, name, ts, *more) in enumerate(streams):
        extra = more[0] if more else {}
        s.append((ep, k, name, extra.get("modality", "scalar-state"), extra.get("rate"), extra.get("clock", "c"), extra.get("kind", "measured"), extra.get("dtype"), extra.get("shape"), extra.get("frame")))
        hashes = extra.get("hashes", [None] * len(ts))
        f += [(ep, k, i, int(t * MS), h) for i, (t, h) in enumerate(zip(ts, hashes, strict=True))]
    rec = Recording(spark, "d", "test")
    rec.put("streams", spark.createDataFrame(s, "ep_ord long, st_ord long, name string, modality string, declared_rate_hz double, clock_id string, clock_kind string, dtype string, shape array<long>, frame_id string"))
    rec.put("frames", spark.createDataFrame(f, "ep_ord long, st_ord long, frame_idx long, ts long, content_hash string"))
    eps = episodes or sorted({x[0] for x in streams})
    rec.put("episodes", spark.createDataFrame([(e, e) for e in eps], "ep_ord long, episode long"))
    return rec


def codes(df):
    return sorted((r["code"], None if r["episode"] is None else int(r["episode"]), r["stream"]) for r in df.collect())


def test_monotonicity_names_the_first_violation(spark):
    rec = recording(spark, (0, "a", [0, 10, 5, 1]), (0, "b", [0, 1, 2, 3]))
    rows = BY_ID["temporal.monotonicity"].run(rec).collect()
    assert [(r["code"], r["stream"], r["a"], r["b"]) for r in rows] == [("NON_MONOTONIC", "a", 1, 2)]


def test_a_step_index_is_not_judged(spark):
    rec = recording(spark, (0, "a", [0, 10, 5], {"kind": "step-index"}))
    assert codes(temporal.monotonicity(rec, Tolerances())) == []
    assert codes(temporal.clock_measurability(rec, Tolerances())) == [("UNMEASURED_CLOCK", None, None)]


@pytest.mark.parametrize("rate,bad", [(float("nan"), True), (0.0, True), (-1.0, True), (float("inf"), True), (30.0, False), (None, False)])
def test_rates_that_are_none(spark, rate, bad):
    assert bool(codes(temporal.rate_validity(recording(spark, (0, "a", [0], {"rate": rate})), Tolerances()))) == bad


def test_twins_report_a_gap_once(spark):
    ts = [0, 10, 20, 30, 200, 210]
    assert codes(temporal.gaps(recording(spark, (0, "a", ts), (0, "b", ts)), Tolerances())) == [("GAP", 0, "a")]


def test_jitter_needs_eight_steps(spark):
    uneven = [0, 1, 20, 21, 40, 41, 60, 61, 80]
    assert codes(temporal.jitter(recording(spark, (0, "a", uneven)), Tolerances())) == [("JITTER", 0, "a")]
    assert codes(temporal.jitter(recording(spark, (0, "a", uneven[:8])), Tolerances())) == []


def test_clock_skew_allows_a_period(spark):
    assert codes(temporal.clock_skew(recording(spark, (0, "a", [0, 500, 1000]), (0, "b", [0, 600, 1200, 1800])), Tolerances())) == [("CLOCK_SKEW", 0, None)]
    assert codes(temporal.clock_skew(recording(spark, (0, "a", [0, 500, 1000]), (0, "b", [0, 500, 1040])), Tolerances())) == []


def test_times_at_the_ends_of_the_range(spark):
    rec = recording(spark, (0, "a", [0]))
    rec.put("frames", spark.createDataFrame([(0, 0, 0, -(2**63), None), (0, 0, 1, 2**63 - 1, None)], "ep_ord long, st_ord long, frame_idx long, ts long, content_hash string"))
    assert codes(temporal.monotonicity(rec, Tolerances())) == []


def test_empty_parts(spark):
    rec = recording(spark, (0, "a", []), (0, "b", [1]), (1, "a", [1, 2]), episodes=[0, 1, 2])
    assert codes(structural.degenerate_episode(rec, Tolerances())) == [("EMPTY_EPISODE", 2, None), ("EMPTY_STREAM", 0, "a"), ("SINGLE_FRAME_STREAM", 0, "b")]
    assert codes(structural.degenerate_episode(Recording(spark, "d", "t"), Tolerances())) == [("EMPTY_DATASET", None, None)]


def test_missing_numbers_are_not_enumerated(spark):
    rec = recording(spark, (0, "a", [1]))
    rec.put("episodes", spark.createDataFrame([(0, 0), (1, 2), (2, 9_000_000_000_000_000_000)], "ep_ord long, episode long"))
    r = structural.episode_continuity(rec, Tolerances()).collect()
    assert r[0]["texts"][0].split(",") == ["1", "3", "4", "5", "6", "7", "8", "9"]


def test_stuck_runs_end_at_a_missing_hash(spark):
    video = {"modality": "video"}
    five = recording(spark, (0, "v", list(range(6)), video | {"hashes": ["x"] * 5 + ["y"]}))
    cut = recording(spark, (0, "v", list(range(6)), video | {"hashes": ["x", "x", "x", None, "x", "x"]}))
    assert codes(structural.stuck_stream(five, Tolerances())) == [("STUCK_STREAM", 0, "v")]
    assert codes(structural.stuck_stream(cut, Tolerances())) == []


def test_equal_episodes_are_grouped(spark):
    h = {"hashes": ["p", "q"]}
    rec = recording(spark, (0, "a", [0, 1], h), (1, "a", [0, 1], h), (2, "a", [0, 1], {"hashes": ["q", "p"]}), (3, "a", [0, 1]))
    r = structural.duplicate_episode(rec, Tolerances()).collect()
    assert [x["texts"] for x in r] == [["0,1"]]


def test_shapes_have_a_baseline_each(spark):
    rec = recording(spark, (0, "a", [0], {"dtype": "f4"}), (1, "a", [0], {"shape": [3]}), (2, "a", [0], {"dtype": "f4", "shape": [4]}), (3, "a", [0], {"dtype": "f8"}))
    assert codes(structural.shape_consistency(rec, Tolerances())) == [("SHAPE_MISMATCH", 2, "a")]


def test_streams_that_some_episodes_lack(spark):
    rec = recording(spark, (0, "a", [0]), (0, "b", [0]), (1, "a", [0]))
    assert codes(structural.stream_presence(rec, Tolerances())) == [("STREAM_PRESENCE_INCONSISTENT", None, "b")]


def test_names_that_differ_in_case(spark):
    rec = recording(spark, (0, "Arm", [0]), (0, " arm", [0]), (0, "x", [0]), (0, "x", [1]))
    assert codes(semantic.stream_key_clarity(rec, Tolerances())) == [("AMBIGUOUS_STREAM_KEY", 0, " arm"), ("AMBIGUOUS_STREAM_KEY", 0, "Arm"), ("DUPLICATE_STREAM_KEY", 0, "x")]


def test_rig_frames(spark):
    rig = lambda ep, f: [(ep, n, [0, 1], {"modality": m, "frame": x}) for n, m, x in (("l", "point-cloud", f), ("i", "imu", "lidar"), ("g", "gnss", None), ("c", "video", "cam"))]
    rec = recording(spark, *rig(0, "nowhere"))
    rec.put("transforms", spark.createDataFrame([("base", "cam"), ("world", "lidar")], "parent_frame string, child_frame string"))
    assert codes(autonomy.sensor_frame_resolution(rec, Tolerances())) == [("SENSOR_FRAME_UNDECLARED", 0, "g"), ("SENSOR_FRAME_UNKNOWN", 0, "l"), ("SENSOR_FRAME_UNRELATED", 0, "i")]


def test_statistics_skip_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (1, [3.0, 2.0]), (1, [3.0, None]), (1, [3.0, float("inf")])], "k int, v array<double>")
    r = {x["dim"]: x for x in statistical.dimension_stats(df, ("k",), "v").collect()}
    assert (r[0]["n"], r[0]["min"], r[0]["max"], r[0]["at_max"], r[0]["non_finite"]) == (4, 1.0, 3.0, 3, 0)
    assert (r[1]["n"], r[1]["min"], r[1]["non_finite"], r[1]["std"]) == (1, 2.0, 2, 0.0)
    w = statistical.worst_saturation(statistical.dimension_stats(df, ("k",), "v"), ("k",)).collect()[0]
    assert w["dim"] == 0


@pytest.mark.parametrize("stats,code", [((0.0, float("nan"), 1.0, 1.0), "NON_FINITE"), ((2.0, 1.0, 1.0, 1.0), "RANGE_INVERTED"), ((0.0, 1.0, 0.5, -1.0), "NEGATIVE_STD"), ((0.0, 1.0, 2.0, 0.1), "MEAN_OUT_OF_RANGE"), ((0.0, 1.0, 0.5, 0.6), "STD_IMPLAUSIBLE"), ((0.0, 300.0, 5.0, 2.0), "DTYPE_RANGE"), ((1.0, 1.0, 1.0, 0.0), "DEGENERATE"), ((0.0, 1.0, 0.5, 0.5), None)])
def test_ranges(spark, stats, code):
    rec = recording(spark, (0, "a", [0]))
    rec.put("streams", spark.createDataFrame([(0, 0, "a", "uint8", stats)], "ep_ord long, st_ord long, name string, dtype string, stats struct<min:double,max:double,mean:double,std:double>"))
    assert [c for c, _, _ in codes(statistical.range_sanity(rec, Tolerances()))] == ([code] if code else [])


def test_equal_values_are_one_finding_however_rows_are_dealt(spark, tmp_path):
    rng = random.Random(5)
    values = [round(rng.expovariate(0.02), 2) for _ in range(30)]
    # Episodes 4, 19, 34, 49, 64 and 79 have a deviation that is too small, 9, 18 and 27 a negative one.
    rows = [(u, x) for u in (4, 18, 32, 47, 61, 75, 9, 17, 26) for x in values]
    rng.shuffle(rows)
    # 14.74 is further from the mean of both than 139.12, by the last bit; in deviations both are exactly 100.
    rows += [(89, 14.74), (89, 139.12)]
    df = spark.createDataFrame([(k * 211, "zoom" if u == 89 else "view", u, x) for k, (u, x) in enumerate(rows)], "event_id long, event_type string, user_id long, value double")
    df.withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz")).repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    run = lambda q: [(r["episode"], r["stream"], r["x3"], r["texts"]) for r in catalog.queries()[q](spark, str(tmp_path)).orderBy("episode").collect()]
    assert run("statistical_extreme_outlier") == [(4, "view", max(values), "maximum"), (94, "zoom", 14.74, "minimum")]
    assert run("statistical_range_sanity") == [(9, "view", max(values), "")]
