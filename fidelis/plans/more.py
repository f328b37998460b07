"""Registered queries besides the checks over events, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from fidelis.functions import sampling
from fidelis.model import Recording, Tolerances
from fidelis.operators import autonomy, media, provenance, ranges, rollup, semantic, statistical, temporal
from fidelis.operators.base import profile
from fidelis.sources import tables


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _flat(x):
    from fidelis.plans.catalog import flat

    return flat(x)


def _some(spark, d, tol=None):
    from fidelis.plans.catalog import BY_ID

    rec, out = tables.events(spark, d), None
    for c in ("temporal.gap", "temporal.jitter", "temporal.rate-conformance", "structural.episode-boundary"):
        one = BY_ID[c].run(rec, tol)
        out = one if out is None else out.unionByName(one)
    return rec, out


def interval_stats(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return profile(tables.events(spark, d)).select("ep_ord", "st_ord", "n", "lo", "hi", "n_iv", "n_pos", r("median"), F.col("upper").cast("long").alias("upper"), r("cv"), "period")


def dim_stats(spark, d):
    s = statistical.dimension_stats(_t(spark, d, "embeddings"), ("label",), "embedding")
    return s.select("label", F.col("dim").cast("long").alias("dim"), "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")), "at_min", "at_max", "non_finite")


def worst_dimension(spark, d):
    x = _t(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.round(v.cast("double"), 1)))))
    w = statistical.worst_saturation(statistical.dimension_stats(x, ("label",), "embedding"), ("label",))
    return w.select("label", F.col("dim").cast("long").alias("dim"), "n", "at_min", "at_max")


def worst_episodes(spark, d):
    return rollup.worst_episodes(_some(spark, d)[1]).select(F.col("episode").cast("long").alias("episode"), "errors", "warnings", "infos")


def trust_score(spark, d):
    rec, f = _some(spark, d)
    return rollup.trust_score(f, provenance.coverage(rec))


def report_diff(spark, d):
    old, new = _some(spark, d)[1], _some(spark, d, Tolerances(jitter_cv=0.9, rate_deviation=0.05))[1]
    x = rollup.difference(_flat(old), _flat(new))
    return x.groupBy("change", "code").agg(F.count("*").alias("n"))


def sample_first_n(spark, d):
    rec = tables.events(spark, d)
    chosen = rec.episodes.orderBy("episode").limit(10).select("ep_ord")
    return rec.frames.join(chosen, "ep_ord", "left_semi").groupBy("ep_ord").agg(F.count("*").alias("n"))


def sample_fraction(spark, d):
    rec = tables.events(spark, d)
    chosen = sampling.fraction_of(rec.episodes, "episode", 0.2, 7).select("ep_ord")
    return rec.frames.join(chosen, "ep_ord", "left_semi").groupBy("ep_ord").agg(F.count("*").alias("n"))


def task_transitions(spark, d):
    return rollup.transitions(_t(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


def replay_slices(spark, d):
    ends = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("episode"), ((F.col("n_nationkey") + 1) * (F.col("n_nationkey") + 1) * 3).cast("long").alias("stop"))
    e = _t(spark, d, "events").select("event_id", "value")
    return ranges.in_ranges(e, "event_id", ranges.slices(ends), 256).groupBy("episode").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _can(spark, d):
    e = _t(spark, d, "events")
    payload = (F.col("event_id") % 4) + 256 * F.floor(F.col("value") * 100) + F.lit(2**40) * (F.col("user_id") % 200)
    frames = e.select((F.lit(256) + F.col("user_id") % 5).alias("id"), F.col("event_id").alias("ts"), payload.cast("long").alias("payload"))
    rows = [(256, "speed", 8, 24, False, 0.01, 0.0, None, None), (256, "temp", 40, 8, True, 1.0, -40.0, None, None), (257, "a", 8, 16, False, 0.25, 0.0, 0, 0), (257, "b", 8, 16, True, 0.5, 1.0, 0, 1), (258, "speed", 8, 24, False, 0.01, 0.0, None, None)]
    return frames, spark.createDataFrame(rows, "id long, signal string, start int, length int, signed boolean, factor double, offset double, mux int, mux_value long")


def can_decode(spark, d):
    x = ranges.decoded(*_can(spark, d))
    return x.groupBy("id", "signal").agg(F.count("*").alias("n"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


def can_undefined(spark, d):
    return ranges.undefined(*_can(spark, d))


def tf_components(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    edges = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    return autonomy.reachable(edges).groupBy("root").agg(F.count("*").alias("n"))


def scenario_coverage(spark, d):
    x = _t(spark, d, "documents").select(F.col("doc_id").alias("ep_ord"), F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("key", "value"))
    return rollup.scenario_coverage(x, 0.1)


def provenance_coverage(spark, d):
    return provenance.coverage(tables.events(spark, d))


def duplicate_documents(spark, d):
    return rollup.repeated_content(_t(spark, d, "documents"), "doc_id", "text")


def undeclared_orders(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.join(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def stream_keys(spark, d):
    c = _t(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    rec = Recording(spark, "customers", "table")
    rec.put("streams", c.select(F.col("c_nationkey").cast("long").alias("ep_ord"), F.col("c_custkey").alias("st_ord"), name.alias("name")))
    rec.put("episodes", c.select(F.col("c_nationkey").cast("long").alias("ep_ord"), F.col("c_nationkey").alias("episode")).distinct())
    return _flat(semantic.stream_key_clarity(rec, Tolerances()))


def annotation_integrity(spark, d):
    c = _t(spark, d, "conversations")
    u = F.col("conv_id")
    rec = Recording(spark, "conversations", "table")
    value = F.when((u + F.col("turn")) % 5 == 0, "  ").otherwise(F.col("role"))
    rec.put("labels", c.select(u.alias("ep_ord"), F.lit("language").alias("key"), value.alias("value"), F.floor(F.col("turn") / 2).alias("ts")))
    rec.put("frames", c.select(u.alias("ep_ord"), F.lit(0).alias("st_ord"), F.col("turn").alias("frame_idx"), F.floor(F.least(F.col("turn"), F.lit(3)) / 2).alias("ts")))
    rec.put("episodes", c.select(u.alias("ep_ord"), u.alias("episode")).distinct())
    return _flat(semantic.annotation_integrity(rec, Tolerances()))


def _with_media(spark, d):
    s = _t(spark, d, "supplier")
    k = F.col("s_suppkey")
    params = lambda codec, width, fps: F.struct(codec.alias("codec"), width.cast("long").alias("width"), F.lit(480).cast("long").alias("height"), fps.cast("double").alias("fps"))
    status = F.when(F.col("s_nationkey") == 3, "missing").when(k % 11 == 0, "missing").when(k % 13 == 0, "unreadable").when(k % 17 == 0, "unattributable").otherwise("read")
    m = F.struct(
        F.concat(F.lit("v/"), k).alias("uri"), params(F.lit("h264"), F.lit(640), F.lit(30)).alias("declared"),
        params(F.when(k % 5 == 0, "hevc").otherwise("avc1"), F.when(k % 7 == 0, 320).otherwise(640), F.when(k % 9 == 0, 25).otherwise(30)).alias("observed"),
        status.alias("status"), F.when(status.isin("unreadable", "unattributable"), "why").alias("reason"), F.when(F.col("s_nationkey") == 5, 3).otherwise(2 + (k % 6 == 0).cast("int")).cast("long").alias("frame_count"),
    )
    rec = Recording(spark, "suppliers", "table")
    rec.put("streams", s.select(k.alias("ep_ord"), F.lit(0).alias("st_ord"), F.concat(F.lit("cam"), "s_nationkey").alias("name"), m.alias("media")))
    rec.put("episodes", s.select(k.alias("ep_ord"), k.alias("episode")))
    rec.put("frames", s.select(k.alias("ep_ord"), F.lit(0).alias("st_ord"), F.explode(F.array(F.lit(0), F.lit(1))).alias("frame_idx"), F.lit(0).alias("ts")))
    return rec


def media_readable(spark, d):
    return _flat(media.media_readable(_with_media(spark, d), Tolerances()))


def media_conformance(spark, d):
    return _flat(media.media_conformance(_with_media(spark, d), Tolerances()))


def durations(spark, d):
    return temporal.durations(tables.events(spark, d)).select("ep_ord", "duration")


def queries() -> dict:
    all_of = (interval_stats, dim_stats, worst_dimension, worst_episodes, trust_score, report_diff, sample_first_n, sample_fraction, task_transitions, replay_slices, can_decode, can_undefined, tf_components, scenario_coverage, provenance_coverage, duplicate_documents, undeclared_orders, stream_keys, annotation_integrity, media_readable, media_conformance, durations)
    return {f.__name__: f for f in all_of}


def oracle_sql() -> dict[str, str]:
    from fidelis.plans.catalog import _sql, rows

    base = tables.EVENTS_SQL
    q = {k: v.removeprefix(base) for k, v in _sql().items()}
    some = " UNION ALL ".join(f"SELECT * FROM ({q[k]})" for k in ("temporal.gap", "temporal.jitter", "temporal.rate-conformance", "structural.episode-boundary"))
    other = some.replace("sd_d / mean_d > 0.5", "sd_d / mean_d > 0.9").replace("abs(seen - rate) / rate > 0.1", "abs(seen - rate) / rate > 0.05")
    md = "(SELECT s_suppkey AS k, 'cam' || s_nationkey AS name, s_nationkey AS nk, CASE WHEN s_nationkey = 3 OR s_suppkey % 11 = 0 THEN 'missing' WHEN s_suppkey % 13 = 0 THEN 'unreadable' WHEN s_suppkey % 17 = 0 THEN 'unattributable' ELSE 'read' END AS status, CASE WHEN s_nationkey = 5 THEN 3 ELSE 2 + CAST(s_suppkey % 6 = 0 AS INT) END AS fc FROM supplier)"
    can = "(SELECT 256 + user_id % 5 AS id, event_id % 4 AS m, CAST(floor(value * 100) AS BIGINT) AS v, user_id % 200 AS t FROM events)"
    ck = "(SELECT c_nationkey AS u, c_custkey AS s, CASE WHEN c_custkey % 7 = 0 THEN ' ' || lower(c_mktsegment) ELSE c_mktsegment END AS name FROM customer)"
    conv = "(SELECT conv_id AS u, turn, turn // 2 AS ts, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE role END AS v FROM conversations)"
    roll = lambda code, cond, detail: rows(code, "warning", "stream", f"(SELECT name, min(k) AS k, count(*) AS n FROM {md} WHERE status = 'read' AND {cond} GROUP BY name)", "k", "name", x=["n"], texts=f"'{detail}'")
    read = f"(SELECT *, fc - 2 AS delta FROM {md} WHERE status = 'read')"
    same = f"(SELECT name, min(delta) AS d, count(*) AS n FROM {read} GROUP BY name HAVING min(delta) = max(delta) AND min(delta) <> 0 AND count(*) > 1)"
    gone = f"(SELECT *, count(*) OVER (PARTITION BY name) AS eps, count(*) FILTER (status = 'missing') OVER (PARTITION BY name) AS g FROM {md})"
    return {
        "interval_stats": base + "SELECT u AS ep_ord, s AS st_ord, n, lo, hi, niv AS n_iv, npos AS n_pos, round(med, 6) AS median, upper, round(sd_d / mean_d, 6) AS cv, period FROM pr",
        "dim_stats": "WITH x AS (SELECT label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT label, dim, count(v) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std FROM x GROUP BY ALL) SELECT label, dim, n, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, (SELECT count(*) FROM x WHERE x.label = s.label AND x.dim = s.dim AND v = s.min) AS at_min, (SELECT count(*) FROM x WHERE x.label = s.label AND x.dim = s.dim AND v = s.max) AS at_max, 0 AS non_finite FROM s",
        "worst_dimension": "WITH x AS (SELECT label, unnest(range(64)) AS dim, greatest(-0.2, least(0.2, round(CAST(unnest(embedding) AS DOUBLE), 1))) AS v FROM embeddings), s AS (SELECT label, dim, count(v) AS n, min(v) AS mn, max(v) AS mx FROM x GROUP BY ALL), c AS (SELECT s.label, s.dim, n, count(*) FILTER (v = mn) AS at_min, count(*) FILTER (v = mx) AS at_max FROM s JOIN x USING (label, dim) WHERE mn < mx GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY greatest(at_min, at_max) / n DESC, dim DESC) = 1",
        "worst_episodes": f"{base}, f AS ({some}) SELECT episode, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM f WHERE episode IS NOT NULL GROUP BY episode ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 10",
        "trust_score": f"{base}, f AS ({some}), d AS (SELECT greatest(0, least(100, 100 - 15 * count(*) FILTER (severity = 'error') - 4 * count(*) FILTER (severity = 'warning'))) AS data, 33 AS provenance FROM f) SELECT data, provenance, (7 * data + 3 * provenance) // 10 AS score, CASE WHEN (7 * data + 3 * provenance) // 10 >= 90 THEN 'A' WHEN (7 * data + 3 * provenance) // 10 >= 80 THEN 'B' WHEN (7 * data + 3 * provenance) // 10 >= 70 THEN 'C' WHEN (7 * data + 3 * provenance) // 10 >= 60 THEN 'D' ELSE 'F' END AS grade FROM d",
        "report_diff": f"{base}, o AS ({some}), n AS ({other}) SELECT change, code, count(*) AS n FROM (SELECT 'introduced' AS change, code FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT 'resolved', code FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT 'unchanged', code FROM (SELECT * FROM n INTERSECT ALL SELECT * FROM o)) GROUP BY ALL",
        "sample_first_n": base + "SELECT u AS ep_ord, count(*) AS n FROM e WHERE u IN (SELECT u FROM ep ORDER BY u LIMIT 10) GROUP BY u",
        "sample_fraction": base + f", h AS (SELECT u, sha256(unhex('{sampling.little_endian(7)}' || {sampling.LITTLE_ENDIAN_SQL})) AS d FROM (SELECT DISTINCT u FROM ep)), r AS (SELECT u, row_number() OVER (ORDER BY {sampling.RANK_SQL}, u) AS k, count(*) OVER () AS total FROM h) SELECT u AS ep_ord, count(*) AS n FROM e WHERE u IN (SELECT u FROM r WHERE k <= greatest(1, ceil(0.2 * total))) GROUP BY u",
        "task_transitions": "SELECT * FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before <> role",
        "replay_slices": "SELECT r.episode, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN (SELECT n_nationkey AS episode, n_nationkey * n_nationkey * 3 AS start, (n_nationkey + 1) * (n_nationkey + 1) * 3 AS stop FROM nation) r ON event_id >= start AND event_id < stop GROUP BY r.episode",
        "can_decode": f"SELECT id, signal, count(*) AS n, round(CAST(min(x) AS DOUBLE), 4) AS low, round(CAST(max(x) AS DOUBLE), 4) AS high FROM (SELECT id, 'speed' AS signal, (v % 16777216) * 0.01 AS x FROM {can} WHERE id IN (256, 258) UNION ALL SELECT id, 'temp', (CASE WHEN t >= 128 THEN t - 256 ELSE t END) - 40.0 FROM {can} WHERE id = 256 UNION ALL SELECT id, 'a', (v % 65536) * 0.25 FROM {can} WHERE id = 257 AND m = 0 UNION ALL SELECT id, 'b', (CASE WHEN v % 65536 >= 32768 THEN v % 65536 - 65536 ELSE v % 65536 END) * 0.5 + 1 FROM {can} WHERE id = 257 AND m = 1) GROUP BY ALL",
        "can_undefined": f"SELECT id, count(*) AS n FROM {can} WHERE id NOT IN (256, 257, 258) GROUP BY id",
        "tf_components": "WITH RECURSIVE e AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS o FROM b UNION SELECT b.b, r.o FROM r JOIN b ON b.a = r.node) SELECT root, count(*) AS n FROM (SELECT node, min(o) AS root FROM r GROUP BY node) GROUP BY root",
        "scenario_coverage": "WITH l AS (SELECT DISTINCT doc_id, 'lang' AS key, lang AS value FROM documents UNION SELECT doc_id, 'source', source FROM documents) SELECT key, value, count(*) AS episodes, any_value(c) AS covered, count(*) < 0.1 * any_value(c) AS sparse FROM l JOIN (SELECT key, count(DISTINCT doc_id) AS c FROM l GROUP BY key) USING (key) GROUP BY key, value",
        "provenance_coverage": "SELECT * FROM (VALUES ('license', 'known'), ('sensor', 'unknown'), ('clock', 'unknown'), ('calibration', 'unknown'), ('annotator', 'asserted'), ('upstream', 'unknown')) t(key, class)",
        "duplicate_documents": "SELECT min(doc_id) AS first, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
        "undeclared_orders": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
        "stream_keys": rows("DUPLICATE_STREAM_KEY", "error", "stream", f"(SELECT * FROM (SELECT u, name, count(*) AS k FROM {ck} GROUP BY u, name HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY name ORDER BY u) = 1)", "u", "name", x=["k"]) + " UNION ALL " + rows("AMBIGUOUS_STREAM_KEY", "warning", "stream", f"(SELECT u, norm, len(ns) AS k, unnest(ns) AS name FROM (SELECT u, norm, ns FROM (SELECT u, lower(trim(name)) AS norm, list(DISTINCT name) AS ns FROM {ck} GROUP BY ALL) WHERE len(ns) > 1 QUALIFY row_number() OVER (PARTITION BY norm ORDER BY u) = 1))", "u", "name", x=["k"], texts="norm"),
        "annotation_integrity": rows("ANNOTATION_UNALIGNED", "error", "episode", f"(SELECT l.*, lo, hi FROM {conv} l JOIN (SELECT u, min(least(turn, 3) // 2) AS lo, max(least(turn, 3) // 2) AS hi FROM {conv} GROUP BY u) USING (u)) WHERE ts < lo OR ts > hi", "u", x=["ts", "lo", "hi"]) + " UNION ALL " + rows("ANNOTATION_CONFLICT", "warning", "episode", f"(SELECT u, ts, count(DISTINCT v) AS k FROM {conv} GROUP BY u, ts HAVING count(DISTINCT v) > 1)", "u", x=["ts", "k"]) + " UNION ALL " + rows("EMPTY_ANNOTATION", "warning", "episode", f"{conv} WHERE v = ''", "u", x=["ts"]),
        "media_readable": rows("MEDIA_ABSENT", "error", "stream", f"(SELECT name, any_value(eps) AS n FROM {gone} WHERE eps = g GROUP BY name)", "NULL", "name", x=["n"]) + " UNION ALL " + rows("MEDIA_MISSING", "error", "stream", f"{gone} WHERE eps <> g AND status = 'missing'", "k", "name", texts="'v/' || k") + " UNION ALL " + rows("MEDIA_UNREADABLE", "error", "stream", f"{md} WHERE status = 'unreadable'", "k", "name", texts="'v/' || k || '|why'") + " UNION ALL " + rows("MEDIA_UNATTRIBUTED", "info", "stream", f"(SELECT name, count(*) AS n FROM {md} WHERE status = 'unattributable' GROUP BY name)", "NULL", "name", x=["n"], texts="'why'"),
        "media_conformance": rows("FRAME_COUNT_MISMATCH", "warning", "stream", same, "NULL", "name", x=["d", "n"], texts="'systematic'") + " UNION ALL " + rows("FRAME_COUNT_MISMATCH", "error", "stream", f"{read} WHERE delta <> 0 AND name NOT IN (SELECT name FROM {same})", "k", "name", x=["fc", "2"], texts="'episode'") + " UNION ALL " + " UNION ALL ".join((roll("RESOLUTION_MISMATCH", "k % 7 = 0", "640x480/320x480"), roll("CODEC_MISMATCH", "k % 5 = 0", "avc1/hvc1"), roll("FPS_MISMATCH", "k % 9 = 0", "30.0/25.0"))),
        "durations": base + "SELECT ep.u AS ep_ord, CASE WHEN ep.z > ep.a THEN ep.z - ep.a ELSE m.span END AS duration FROM ep LEFT JOIN (SELECT u, max(span) AS span FROM pr WHERE kind = 'measured' AND span > 0 GROUP BY u) m USING (u) WHERE CASE WHEN ep.z > ep.a THEN ep.z - ep.a ELSE m.span END IS NOT NULL",
    }
