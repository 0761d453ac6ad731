"""Queries of sources, sinks, frames, metadata and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import frames, metadata
from tempora.plans import fragments as sql
from tempora.plans.registry import query
from tempora.plans.series_queries import KEY, LIMITS, S, by_baseline, events, limits, users, with_
from tempora.plans.series_queries import E9 as PIPELINE
from tempora.sources import sinks, tables, timeline
from tempora.streaming import incremental

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("a1_stored_series", f"{KEY} t:3 value:6 data_type", with_(S) + " SELECT run_id, roi, t, value, 'raw' AS data_type FROM s")
def _(spark, d):
    path = tables.scratch(spark, "series")
    sinks.long_export(raw=(events(spark, d), "t", "value")).write.partitionBy("run_id").parquet(path)
    return tables.stored_series(spark, path, ["events"])


@query("a1_stored_attributes", f"{KEY} name value", with_(S) + f"""
, e AS (SELECT run_id, roi, count(*) AS n, max(t) - min(t) AS length FROM s GROUP BY run_id, roi), w AS (SELECT run_id, count(*) AS rois, max(n) AS n FROM e GROUP BY run_id)
SELECT run_id, roi, unnest(['roi_id', 'n_samples', 'duration']) AS name, unnest([roi, CAST(n AS VARCHAR), CAST(CAST(round(length) AS BIGINT) AS VARCHAR)]) AS value FROM e UNION ALL SELECT run_id, NULL, unnest(['frame_interval', 'n_frames', 'n_rois']), unnest(['1300.0', CAST(n AS VARCHAR), CAST(rois AS VARCHAR)]) FROM w""")
def _(spark, d):
    """Attributes that were saved with the series; durations to the second, as text of a fraction differs from engine to engine."""
    path, e = tables.scratch(spark, "run"), events(spark, d)
    sinks.save_run(path, {"raw": e.select("run_id", "roi", "t", "value")}, sinks.series_attributes(e, 1300))
    out = sinks.load_run(spark, path, "attributes", ["events"])
    second = F.round(F.col("value").try_cast("double")).cast("long").cast("string")
    return out.select("run_id", "roi", F.when(F.col("name") == "duration_seconds", "duration").otherwise(F.col("name")).alias("name"), F.when(F.col("name") == "duration_seconds", second).otherwise(F.col("value")).alias("value"))


@query("a2_frame_range", "frame_idx:int", "SELECT vec_id AS frame_idx FROM embeddings WHERE vec_id >= 100 AND vec_id < 300")
def _(spark, d):
    return timeline.frame_range(tables.frames(spark, d), 100, 300)


# A day of events is a recording; its duration goes by its number of frames, 300 s apart.
DAYS = """d0 AS (SELECT 'events' AS run_id, strftime(ts, '%Y-%m-%d') AS path, event_type AS roi, epoch_us(ts) / 1e6 - 86400 * floor(epoch_us(ts) / 1e6 / 86400) AS t, value, event_id AS tie FROM events),
rec AS (SELECT run_id, path, row_number() OVER (ORDER BY path) AS seq, (count(*) - 1) * 300.0 AS duration, 0.01 AS fps, count(*) AS frame_count, CASE WHEN count(*) % 11 = 0 THEN 'unreadable' END AS error FROM d0 GROUP BY run_id, path),
off AS (SELECT *, coalesce(sum(duration) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS time_start FROM rec)"""


def days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = tables.table(spark, d, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = e.select(F.lit("events").alias("run_id"), F.date_format("ts", "yyyy-MM-dd").alias("path"), F.col("event_type").alias("roi"), (s - 86_400 * F.floor(s / 86_400)).alias("t"), "value", F.col("event_id").alias("tie"))
    rec = rows.groupBy("run_id", "path").agg(F.count("*").alias("frame_count"))
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("path"))
    return rows, rec.select("run_id", "path", seq.alias("seq"), ((F.col("frame_count") - 1) * 300.0).alias("duration"), F.lit(0.01).alias("fps"), "frame_count", F.when(F.col("frame_count") % 11 == 0, "unreadable").alias("error"))


@query("a3_merged_recordings", f"{KEY} path t:3 value:6 tie:int", f"WITH {DAYS} SELECT run_id, path, roi, t + time_start AS t, value, tie FROM d0 JOIN off USING (run_id, path)")
def _(spark, d):
    return timeline.merge_recordings(*days(spark, d))


SAMPLED = f"WITH {DAYS}, sf AS (SELECT run_id, path, seq, frame_count, time_start, time_start + duration AS time_end, fps, unnest(range(0, frame_count, 3)) AS frame_idx FROM off)"


@query("a4_clip_timestamps", "run_id path seq:int frame_idx:int t:3 time_start:3 time_end:3", SAMPLED + " SELECT *, frame_idx / fps + time_start AS t FROM sf")
def _(spark, d):
    return timeline.sampled_frames(days(spark, d)[1], 300)


@query("a5_frame_sampling", "run_id path sampled:int", SAMPLED + " SELECT run_id, path, count(*) AS sampled FROM sf GROUP BY run_id, path")
def _(spark, d):
    return timeline.sampled_frames(days(spark, d)[1], 300).groupBy("run_id", "path").agg(F.count("*").alias("sampled"))


@query("a6_until_failure", "run_id path seq:int", f"WITH {DAYS} SELECT run_id, path, seq FROM (SELECT *, min(CASE WHEN error IS NOT NULL THEN seq END) OVER () AS bad FROM rec) WHERE bad IS NULL OR seq < bad")
def _(spark, d):
    return timeline.until_failure(days(spark, d)[1])


@query("a7_batch_summary", "run_id clips:int duration:3 frames:int sampled:int effective_fps:6", f"WITH {DAYS} SELECT run_id, count(*) AS clips, sum(duration) AS duration, sum(frame_count) AS frames, sum(ceil(frame_count / 3.0)) AS sampled, 1 / 300.0 AS effective_fps FROM rec GROUP BY run_id")
def _(spark, d):
    return timeline.batch_summary(days(spark, d)[1], 300)


@query("a8_long_export", f"{KEY} data_type t:1 value:4", PIPELINE + " SELECT run_id, roi, 'movement' AS data_type, t, state AS value FROM h UNION ALL SELECT run_id, roi, 'fraction', bin_center, fraction FROM z UNION ALL SELECT run_id, roi, 'quiescence', bin_center, quiescent FROM z UNION ALL SELECT run_id, roi, 'sleep', bin_center, sleep FROM z")
def _(spark, d):
    out = by_baseline(spark, d, store=True)
    bins = out["bins"]
    return sinks.long_export(movement=(out["states"], "t", "state"), fraction=(bins, "bin_center", "fraction"), quiescence=(bins, "bin_center", "quiescent"), sleep=(bins, "bin_center", "sleep"))


@query("a9_threshold_export", f"{KEY} baseline_mean:6 upper:6 lower:6 band_width:6", with_(S, LIMITS) + " SELECT *, upper - lower AS band_width FROM b")
def _(spark, d):
    return sinks.threshold_export(limits(spark, d))


@query("a10_run_parameters", "run_id name value", with_(S) + ", m AS (SELECT run_id, count(*) AS samples, count(DISTINCT roi) AS series FROM s GROUP BY run_id) SELECT run_id, 'samples' AS name, CAST(samples AS VARCHAR) AS value FROM m UNION ALL SELECT run_id, 'series', CAST(series AS VARCHAR) FROM m")
def _(spark, d):
    return sinks.parameter_table(events(spark, d).groupBy("run_id").agg(F.count("*").alias("samples"), F.count_distinct("roi").alias("series")))


@query("a10_parameter_json", "run_id parameters", with_(S) + """ SELECT run_id, '{"samples":' || count(*) || ',"series":' || count(DISTINCT roi) || '}' AS parameters FROM s GROUP BY run_id""")
def _(spark, d):
    return sinks.parameter_json(events(spark, d).groupBy("run_id").agg(F.count("*").alias("samples"), F.count_distinct("roi").alias("series")))


WIDE = " ".join(f"{t}:6" for t in TYPES)


@query("a11_wide_pivot", f"run_id time_key:2 {WIDE}", with_(S) + f", k AS (SELECT *, round_even(t / 60, 2) AS time_key, row_number() OVER (PARTITION BY run_id, roi, round_even(t / 60, 2) ORDER BY t DESC, tie DESC) AS pos FROM s) SELECT run_id, time_key, {', '.join(f'max(value) FILTER (WHERE roi = {t!r}) AS {t}' for t in TYPES)} FROM k WHERE pos = 1 GROUP BY run_id, time_key")
def _(spark, d):
    return sinks.wide(events(spark, d), TYPES)


@query("a12_tolerant_pivot", f"run_id time_key:2 {WIDE}", with_(S) + f""", k AS (SELECT DISTINCT run_id, round_even(t / 60, 2) AS time_key FROM s), b AS (SELECT run_id, time_key, floor(time_key / 0.01) + x AS bucket FROM k, range(-1, 2) AS r(x)),
n AS (SELECT b.run_id, time_key, roi, value, row_number() OVER (PARTITION BY b.run_id, time_key, roi ORDER BY t, tie) AS pos FROM b JOIN s ON s.run_id = b.run_id AND floor(t / 60 / 0.01) = bucket AND abs(t / 60 - time_key) < 0.01)
SELECT run_id, time_key, {', '.join(f'max(value) FILTER (WHERE roi = {t!r}) AS {t}' for t in TYPES)} FROM n WHERE pos = 1 GROUP BY run_id, time_key""")
def _(spark, d):
    return sinks.wide_tolerant(events(spark, d), TYPES)


@query("a13_saved_run", "name run_id rows:int", PIPELINE + " SELECT 'bins' AS name, run_id, count(*) AS rows FROM z GROUP BY run_id UNION ALL SELECT 'states', run_id, count(*) FROM h GROUP BY run_id UNION ALL SELECT 'thresholds', run_id, count(*) FROM b GROUP BY run_id")
def _(spark, d):
    path, out = tables.scratch(spark, "run"), by_baseline(spark, d, store=True)
    sinks.save_run(path, {k: out[k] for k in ("bins", "states", "thresholds")})
    parts = [sinks.load_run(spark, path, k, ["events"]).groupBy("run_id").agg(F.count("*").alias("rows")).withColumn("name", F.lit(k)) for k in ("bins", "states", "thresholds")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a13_manifest", "name run_id rows:int", """WITH s AS (SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, event_type, value FROM events) SELECT 'samples' AS name, run_id, count(*) AS rows FROM s GROUP BY run_id
UNION ALL SELECT 'means', run_id, count(DISTINCT event_type) FROM s WHERE run_id <> '2' GROUP BY run_id""")
def _(spark, d):
    """Three runs are saved, and two of them again: each stands once, as last saved."""
    path, e = tables.scratch(spark, "run"), tables.event_samples(spark, d, run="cast(user_id % 3 AS string)")
    means = e.where("run_id <> '2'").groupBy("run_id", "roi").agg(F.avg("value").alias("mean"))
    sinks.save_run(path, {"samples": e, "means": means})
    sinks.save_run(path, {"samples": e.where("run_id <> '2'"), "means": means})
    return sinks.saved_runs(spark, path)


# Frames: embeddings of 64 numbers as images of 8 by 8; circles from the suppliers, a few of them for the one camera.

PIXELS = "px AS (SELECT 'camera' AS run_id, vec_id AS frame_idx, generate_subscripts(embedding, 1) - 1 AS px, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
CIRCLES = "ci AS (SELECT CASE WHEN s_suppkey <= 25 THEN 'camera' ELSE 'plate' || s_nationkey END AS run_id, s_suppkey AS circle_id, s_suppkey % 8 AS x, (s_suppkey * 3) % 8 AS y, s_nationkey % 3 AS r FROM supplier)"
MASKS = CIRCLES + """, cm AS (SELECT *, greatest(r, least(x, 7 - r)) AS cx, greatest(r, least(y, 7 - r)) AS cy FROM ci WHERE r > 0),
mk AS (SELECT run_id, circle_id AS roi, CAST(py * 8 + qx AS BIGINT) AS px FROM cm, range(0, 8) AS a(qx), range(0, 8) AS b(py) WHERE (qx - cx) * (qx - cx) + (py - cy) * (py - cy) <= r * r)"""


def circles(spark, d) -> DataFrame:
    return tables.table(spark, d, "supplier").selectExpr("if(s_suppkey <= 25, 'camera', concat('plate', s_nationkey)) AS run_id", "s_suppkey AS circle_id", "cast(s_suppkey % 8 AS int) AS x", "cast((s_suppkey * 3) % 8 AS int) AS y", "cast(s_nationkey % 3 AS int) AS r")


def masks(spark, d) -> DataFrame:
    return frames.circle_masks(circles(spark, d), 8, 8)


@query("b1_gray", "frame_idx:int px:int gray:3", "SELECT frame_idx, px // 4 AS px, floor(0.299 * max(q) FILTER (WHERE px % 4 = 0) + 0.587 * max(q) FILTER (WHERE px % 4 = 1) + 0.114 * max(q) FILTER (WHERE px % 4 = 2)) AS gray FROM (SELECT *, floor(abs(v) * 255) AS q FROM (WITH " + PIXELS + " SELECT * FROM px)) GROUP BY frame_idx, px // 4")
def _(spark, d):
    f = tables.frames(spark, d).withColumn("pixels", F.transform("pixels", lambda p: F.floor(F.abs(p.cast("double")) * 255).cast("double")))
    return f.select("frame_idx", F.posexplode(frames.to_gray("pixels", 4)).alias("px", "gray"))


@query("b2_normalised", "frame_idx:int px:int value:6", f"WITH {PIXELS} SELECT frame_idx, px, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS value FROM px")
def _(spark, d):
    return frames.normalise(tables.frames(spark, d)).select("frame_idx", F.posexplode("pixels").alias("px", "value"))


NUMBERS = PIXELS + ", pi AS (SELECT frame_idx, px, floor(v * 1000) AS q FROM px)"


def whole(spark, d, shift: int = 0) -> DataFrame:
    """Frames of whole numbers."""
    return tables.frames(spark, d).withColumn("pixels", F.transform("pixels", lambda p: (F.floor(p.cast("double") * 1000) + shift).cast("int")))


@query("b2_integer_kinds", "kind frame_idx:int px:int value:6", f"WITH {NUMBERS}, m AS (SELECT *, min(q) OVER () AS lo, max(q) OVER () AS hi FROM pi) SELECT 'uint8' AS kind, frame_idx, px, q / 255 AS value FROM m UNION ALL SELECT 'uint16', frame_idx, px, q / 65535 FROM m UNION ALL SELECT 'int', frame_idx, px, (q - lo) / (hi - lo) FROM m UNION ALL SELECT 'target', frame_idx, px, (q - lo) / (hi - lo) * 3 - 1 FROM m UNION ALL SELECT 'constant', frame_idx, px, 0 FROM m UNION ALL SELECT 'inside', frame_idx, px, (q - lo) / (hi - lo) FROM m")
def _(spark, d):
    f, out = whole(spark, d), None
    inside = frames.normalise(f, "int")
    kinds = {
        "uint8": frames.normalise(f, "uint8"), "uint16": frames.normalise(f, "uint16"), "int": inside, "target": frames.normalise(f, "int", (-1.0, 2.0)),
        "constant": frames.normalise(f.withColumn("pixels", F.transform("pixels", lambda p: F.lit(7))), "int"), "inside": frames.normalise(inside, "float"),
    }
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), "frame_idx", F.posexplode("pixels").alias("px", "value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("b3_many_runs", "run_id roi:int t:3 value:5", f"WITH {PIXELS}, pr AS (SELECT 'c' || frame_idx % 3 AS run_id, frame_idx, px, v FROM px), {MASKS}, mr AS (SELECT 'c' || roi % 3 AS run_id, roi, px FROM mk WHERE run_id = 'camera'), df AS (SELECT run_id, px, lead(v) OVER (PARTITION BY run_id, px ORDER BY frame_idx) - v AS delta, row_number() OVER (PARTITION BY run_id, px ORDER BY frame_idx) - 1 AS i FROM pr) SELECT run_id, roi, i * 2.0 AS t, sum(abs(delta)) AS value FROM df JOIN mr USING (run_id, px) WHERE delta IS NOT NULL GROUP BY run_id, roi, i")
def _(spark, d):
    f = tables.frames(spark, d).withColumn("run_id", F.concat(F.lit("c"), F.col("frame_idx") % 3))
    m = masks(spark, d).where("run_id = 'camera'").withColumn("run_id", F.concat(F.lit("c"), F.col("roi") % 3))
    return frames.activity(f, m, 2)


@query("b3_activity", "run_id roi:int t:3 value:5", f"WITH {PIXELS}, {MASKS}, df AS (SELECT run_id, px, frame_idx, lead(v) OVER (PARTITION BY px ORDER BY frame_idx) - v AS delta, row_number() OVER (PARTITION BY px ORDER BY frame_idx) - 1 AS i FROM px) SELECT run_id, roi, i * 5.0 AS t, sum(abs(delta)) AS value FROM df JOIN mk USING (run_id, px) WHERE delta IS NOT NULL GROUP BY run_id, roi, i")
def _(spark, d):
    return frames.activity(tables.frames(spark, d), masks(spark, d), 5)


@query("b4_circle_masks", "run_id roi:int px:int", f"WITH {MASKS} SELECT * FROM mk")
def _(spark, d):
    return masks(spark, d)


WELLS = """wl AS (SELECT 'plate' || s_nationkey AS run_id, s_suppkey AS circle_id, (s_suppkey * 7919) % 500 AS x, (s_suppkey * 104729) % 300 AS y FROM supplier), wn AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM wl),
wr AS (SELECT *, CASE n WHEN 4 THEN 2 WHEN 6 THEN 2 WHEN 8 THEN 2 WHEN 12 THEN 3 WHEN 16 THEN 4 WHEN 24 THEN 4 ELSE 1 END AS rows FROM wn),
ws AS (SELECT *, CASE WHEN rows = 1 THEN 0 ELSE least(rows - 1, (row_number() OVER (PARTITION BY run_id ORDER BY y, x, circle_id) - 1) // (n // rows)) END AS row FROM wr)"""


@query("b5_well_numbers", "run_id circle_id:int row:int well:int", f"WITH {WELLS} SELECT run_id, circle_id, row, row_number() OVER (PARTITION BY run_id ORDER BY row, CASE WHEN row % 2 = 1 THEN -x ELSE x END, circle_id) AS well FROM ws")
def _(spark, d):
    s = tables.table(spark, d, "supplier").selectExpr("concat('plate', s_nationkey) AS run_id", "s_suppkey AS circle_id", "(s_suppkey * 7919) % 500 AS x", "(s_suppkey * 104729) % 300 AS y")
    return frames.number_wells(s)


@query("b6_region_geometry", "run_id roi:int center_x:int center_y:int radius:6 area:int", f"WITH {MASKS}, g AS (SELECT *, px % 8 AS x, px // 8 AS y FROM mk), m AS (SELECT run_id, roi, avg(x) AS mx, avg(y) AS my, count(*) AS area FROM g GROUP BY run_id, roi) SELECT run_id, roi, trunc(mx) AS center_x, trunc(my) AS center_y, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS radius, area FROM g JOIN m USING (run_id, roi) GROUP BY run_id, roi, mx, my, area")
def _(spark, d):
    return frames.region_geometry(masks(spark, d), 8)


@query("b7_range_report", "run_id stage min:6 max:6 mean:6 std:6 status", f"WITH {PIXELS} SELECT run_id, 'normalised' AS stage, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_pop(v) AS std, CASE WHEN min(v) >= -0.1 AND max(v) <= 1.1 THEN 'pass' ELSE 'warn' END AS status FROM px GROUP BY run_id")
def _(spark, d):
    return frames.range_report(tables.frames(spark, d), "normalised")


@query("b8_magnitude_class", f"{KEY} n:int largest:6 kind", with_(S) + f" SELECT run_id, roi, count(*) AS n, max(value) AS largest, CASE WHEN max(value) > 10000 THEN 'very_high' WHEN max(value) < 1 THEN 'normalised' WHEN max(value) BETWEEN 10 AND 1000 THEN 'typical' ELSE 'unusual' END AS kind FROM (SELECT *, row_number() OVER ({sql.T}) AS i FROM s) WHERE i <= 100 GROUP BY run_id, roi")
def _(spark, d):
    return frames.magnitude_class(events(spark, d))


# Metadata series of each event type as a recording, derived from the events in order.

DERIVED = {
    "actual_interval": "value / 10", "expected_interval": "5", "timing_drift": "(value - 50) / 1000", "temperature": "20 + value / 50", "humidity": "40 + value / 10", "led_power": "value", "led_duration": "value / 100",
    "led_success": "CASE WHEN value > 5 THEN 1 ELSE 0 END", "frame_mean": "100 + value / 20", "roi_signal": "value * 2", "_hidden": "value * 3",
}
META = f"""ord AS (SELECT event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events),
meta AS (SELECT run_id, idx, unnest([{', '.join(f"'{k}'" for k in DERIVED)}]) AS param, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in DERIVED.values())}]) AS value FROM ord)"""


def ordered(spark, d) -> DataFrame:
    e = events(spark, d)
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("roi").orderBy("t", "tie")) - 1
    return e.select(F.col("roi").alias("run_id"), i.alias("idx"), "t", "value")


def meta(spark, d) -> DataFrame:
    wide = ordered(spark, d).select("run_id", "idx", *(F.expr(v).cast("double").alias(k) for k, v in DERIVED.items()))
    return wide.unpivot(["run_id", "idx"], list(DERIVED), "param", "value")


NESTED = """'{"frame_metadata": {"k": ' || coalesce(json_extract_string(props, '$.k'), '0') || '}, "env": {"temp": 21.5, "ok": true, "name": "x", "deep": {"level": ' || (event_id % 7) || ', "list": [1, 2], "more": {"python_timing": {"jitter": ' || (event_id % 3) || ', "far": {"end": 4.5}}}}}, "count": ' || (event_id % 5) || '}'"""


@query("i1_json_numbers", "run_id frame_idx:int param value:4", "SELECT 'events' AS run_id, event_id AS frame_idx, unnest(['k', 'env_temp', 'deep_level', 'jitter', 'far_end', 'count']) AS param, unnest([CAST(coalesce(json_extract_string(props, '$.k'), '0') AS DOUBLE), 21.5, CAST(event_id % 7 AS DOUBLE), CAST(event_id % 3 AS DOUBLE), 4.5, CAST(event_id % 5 AS DOUBLE)]) AS value FROM events")
def _(spark, d):
    text = NESTED.replace("json_extract_string(props, '$.k')", "get_json_object(props, '$.k')")
    f = tables.table(spark, d, "events").select(F.lit("events").alias("run_id"), F.col("event_id").alias("frame_idx"), F.expr(text).alias("attrs"))
    return metadata.numeric_attributes(f)


# Parameters of different lengths: all events of a type, means of two events each, and the type's mean.
UNEQUAL = f"""ord AS (SELECT event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value FROM events),
odd AS (SELECT run_id, idx // 2 AS idx, avg(value) AS value FROM ord GROUP BY 1, 2), mean AS (SELECT event_type AS run_id, avg(value) AS mean FROM events GROUP BY event_type)"""


@query("i2_aligned_series", "run_id idx:int minutes:4 temperature:6 humidity:6 led_power:6", f"WITH {UNEQUAL} SELECT ord.run_id, ord.idx, ord.idx * 5 / 60 AS minutes, 20 + ord.value / 50 AS temperature, 40 + odd.value / 10 AS humidity, mean AS led_power FROM ord LEFT JOIN odd USING (run_id, idx) JOIN mean ON mean.run_id = ord.run_id")
def _(spark, d):
    o = ordered(spark, d).select("run_id", F.col("idx").cast("long").alias("idx"), "value")
    halves = o.groupBy("run_id", F.floor(F.col("idx") / 2).alias("idx")).agg(F.avg("value").alias("value"))
    mean = o.groupBy("run_id").agg(F.avg("value").alias("value")).select("run_id", F.lit(0).cast("long").alias("idx"), "value")
    one = lambda df, param, value: df.select("run_id", F.lit(param).alias("param"), "idx", value.alias("value"))
    m = one(o, "temperature", 20 + F.col("value") / 50).unionByName(one(halves, "humidity", 40 + F.col("value") / 10)).unionByName(one(mean, "led_power", F.col("value")))
    return metadata.align(m, ["temperature", "humidity", "led_power"], 5)


@query("i3_static_attributes", "run_id category parameter value data_type source", "SELECT 'c' || c_custkey AS run_id, unnest(['customer', 'customer', 'nation']) AS category, unnest(['key', 'name', 'key']) AS parameter, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR)]) AS value, unnest(['bigint', 'string', 'bigint']) AS data_type, 'customer' AS source FROM customer")
def _(spark, d):
    n = tables.table(spark, d, "customer")
    doc = F.to_json(F.struct(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).alias("customer"), F.struct(F.col("c_nationkey").alias("key")).alias("nation")))
    return metadata.flatten_static(n.select(F.concat(F.lit("c"), "c_custkey").alias("run_id"), doc.alias("attrs"), F.lit("customer").alias("source")))


def count_params(df: DataFrame) -> DataFrame:
    return df.groupBy("run_id", "param").agg(F.count("*").alias("n"))


#: Parameter names dealt to the events: some hold one of the words each, others none.
NAMES = [
    "ROI_1_mean", "baseline_x", "threshold_2", "my_upper_threshold", "Lower_Threshold", "movement_data", "fraction_data_3", "sleep_data", "quiescence_data", "intensity_roi_4", "analysis_time", "processed_frames", "calculated_gain",
    "Experiment", "start_date", "timestamp", "duration_s", "interval", "frame_mean", "FPS", "resolution_x", "microscope", "objective", "magnification", "exposure", "gain", "temperature", "humidity", "light_on", "treatment", "condition",
    "protocol", "researcher", "lab_name", "species", "strain", "age_days", "sex", "mask_version", "led_power", "baseline", "threshold", "operator", "camera", "phase", "roi", "x",
]
NAMED = f"nm AS (SELECT event_type AS run_id, [{', '.join(repr(n) for n in NAMES)}][event_id % {len(NAMES)} + 1] AS param FROM events)"
#: The words themselves are written out here, not taken from the operator.
ANALYSIS_SQL = " OR ".join(f"contains(lower(param), '{w}')" for w in "roi_ baseline_ threshold_ upper_threshold lower_threshold movement_data fraction_data sleep_data quiescence_data intensity_roi_ analysis_ processed_ calculated_".split())
EXPERIMENT_SQL = " OR ".join(f"contains(lower(param), '{w}')" for w in "experiment date time duration interval frame fps resolution microscope objective magnification exposure gain temperature humidity light treatment condition protocol researcher lab species strain age sex".split())


def named(spark, d) -> DataFrame:
    names = F.array(*(F.lit(n) for n in NAMES))
    return tables.table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.element_at(names, (F.col("event_id") % len(NAMES) + 1).cast("int")).alias("param"))


@query("i4_without_analysis", "run_id param n:int", f"WITH {NAMED} SELECT run_id, param, count(*) AS n FROM nm WHERE NOT ({ANALYSIS_SQL}) GROUP BY run_id, param")
def _(spark, d):
    return count_params(metadata.without_analysis(named(spark, d)))


@query("i5_experimental", "run_id param n:int", f"WITH {NAMED} SELECT run_id, param, count(*) AS n FROM nm WHERE {EXPERIMENT_SQL} GROUP BY run_id, param")
def _(spark, d):
    return count_params(metadata.experimental(named(spark, d), "param"))


def one(param: str) -> str:
    return f"(SELECT * FROM meta WHERE param = '{param}')"


@query("i6_timing_performance", "run_id n:int mean_actual:6 mean_expected:6 std_actual:6 accuracy:6", f"WITH {META} SELECT a.run_id, count(*) AS n, avg(a.value) AS mean_actual, avg(e.value) AS mean_expected, stddev_samp(a.value) AS std_actual, 1 - avg(abs(a.value - e.value)) / avg(e.value) AS accuracy FROM {one('actual_interval')} AS a JOIN {one('expected_interval')} AS e USING (run_id, idx) GROUP BY a.run_id")
def _(spark, d):
    return metadata.timing_performance(meta(spark, d), "actual_interval", "expected_interval")


@query("i7_drift_statistics", "run_id max_s:7 min_s:7 mean_s:7 std_s:7 max_ms:5 min_ms:5 mean_ms:5 std_ms:5 slope:9", f"WITH {META} SELECT run_id, max(value) AS max_s, min(value) AS min_s, avg(value) AS mean_s, stddev_samp(value) AS std_s, max(value) * 1000 AS max_ms, min(value) * 1000 AS min_ms, avg(value) * 1000 AS mean_ms, stddev_samp(value) * 1000 AS std_ms, regr_slope(value, idx) AS slope FROM {one('timing_drift')} GROUP BY run_id")
def _(spark, d):
    return metadata.drift_statistics(meta(spark, d), "timing_drift")


@query("i8_cumulative_drift", "run_id last:7 max:7 min:7", f"WITH {META} SELECT run_id, arg_max(value, idx) AS last, max(value) AS max, min(value) AS min FROM {one('timing_drift')} GROUP BY run_id")
def _(spark, d):
    return metadata.cumulative_drift(meta(spark, d), "timing_drift")


@query("i9_image_statistics", "run_id mean:6 std:6 min:6 max:6 trend:9 cv_percent:6 stability", f"WITH {META} SELECT *, CASE WHEN cv_percent < 5 THEN 'excellent' WHEN cv_percent < 10 THEN 'good' WHEN cv_percent < 20 THEN 'moderate' ELSE 'poor' END AS stability FROM (SELECT run_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, regr_slope(value, idx) AS trend, stddev_samp(value) * 100 / avg(value) AS cv_percent FROM {one('frame_mean')} GROUP BY run_id)")
def _(spark, d):
    return metadata.image_statistics(meta(spark, d), "frame_mean")


@query("i10_environment", "run_id param mean:6 std:6 min:6 max:6 range:6 grade", f"WITH {META} SELECT *, max - min AS range, CASE WHEN max - min < CASE param WHEN 'temperature' THEN 2 ELSE 10 END THEN 'stable' WHEN max - min < CASE param WHEN 'temperature' THEN 5 ELSE 20 END THEN 'moderate' ELSE 'variable' END AS grade FROM (SELECT run_id, param, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM meta WHERE param IN ('temperature', 'humidity') GROUP BY run_id, param)")
def _(spark, d):
    return metadata.environment(meta(spark, d), {"temperature": (2, 5), "humidity": (10, 20)})


LED_STATS = ", ".join(f"{f}(value) FILTER (WHERE param = 'led_{p}') AS {k}_{p}" for p in ("power", "duration") for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("i11_led_statistics", "run_id " + " ".join(f"{k}_{p}:6" for p in ("power", "duration") for k in ("mean", "std", "min", "max")) + " sync_rate:6 frames:int successes:int failures:int grade", f"WITH {META} SELECT *, CASE WHEN sync_rate > 0.98 THEN 'excellent' WHEN sync_rate > 0.95 THEN 'good' WHEN sync_rate > 0.9 THEN 'acceptable' ELSE 'poor' END AS grade FROM (SELECT run_id, {LED_STATS}, avg(value) FILTER (WHERE param = 'led_success') AS sync_rate, count(*) FILTER (WHERE param = 'led_success') AS frames, count(*) FILTER (WHERE param = 'led_success' AND value > 0) AS successes, count(*) FILTER (WHERE param = 'led_success' AND value <= 0) AS failures FROM meta GROUP BY run_id)")
def _(spark, d):
    return metadata.led_statistics(meta(spark, d), "led_power", "led_duration", "led_success")


@query("i12_drift_grade", "run_id largest:7 grade", f"WITH {META} SELECT run_id, max(abs(value)) AS largest, CASE WHEN max(abs(value)) < 0.05 THEN 'excellent' WHEN max(abs(value)) < 0.1 THEN 'good' WHEN max(abs(value)) < 0.2 THEN 'acceptable' ELSE 'poor' END AS grade FROM {one('timing_drift')} GROUP BY run_id")
def _(spark, d):
    return metadata.drift_grade(meta(spark, d), "timing_drift")


# Metadata under the names that have units, and one that hasn't; drifts grow with the type's number, so that every grade occurs.
UNIT_NAMES = [
    "frame_drift", "cumulative_drift", "actual_intervals", "expected_intervals", "frame_intervals", "capture_timestamps", "expected_timestamps", "temperature", "humidity", "led_power_percent", "led_duration_ms",
    "frame_mean", "frame_max", "frame_min", "frame_std", "frame_index", "other",
]
MEASURED = f"me AS (SELECT event_type AS run_id, [{', '.join(repr(n) for n in UNIT_NAMES)}][event_id % {len(UNIT_NAMES)} + 1] AS param, (value - 50) / 100 * length(event_type) / 21 / greatest(1, ascii(event_type) - 110) AS value FROM events)"
UNITS_SQL = """un(param, unit, description) AS (VALUES ('frame_drift', 'seconds', 'Time difference between expected and actual frame capture'), ('cumulative_drift', 'seconds', 'Total accumulated timing error since recording start'),
('actual_intervals', 'seconds', 'Measured time between consecutive frames'), ('expected_intervals', 'seconds', 'Configured frame interval (should be constant)'), ('frame_intervals', 'seconds', 'Parameter measured in seconds'),
('capture_timestamps', 'seconds', 'Parameter measured in seconds'), ('expected_timestamps', 'seconds', 'Parameter measured in seconds'), ('temperature', 'celsius', 'Ambient temperature during recording'), ('humidity', 'percent', 'Relative humidity during recording'),
('led_power_percent', 'percent', 'LED illumination power setting'), ('led_duration_ms', 'milliseconds', 'LED flash duration (only parameter in milliseconds)'), ('frame_mean', 'pixel_intensity', 'Parameter measured in pixel_intensity'),
('frame_max', 'pixel_intensity', 'Parameter measured in pixel_intensity'), ('frame_min', 'pixel_intensity', 'Parameter measured in pixel_intensity'), ('frame_std', 'pixel_intensity', 'Parameter measured in pixel_intensity'), ('frame_index', 'dimensionless', 'Parameter measured in dimensionless'))"""
GRADED = "CASE WHEN most < 0.05 THEN 'excellent' WHEN most < 0.1 THEN 'good' WHEN most < 0.2 THEN 'acceptable' ELSE 'poor' END"


def measured(spark, d) -> DataFrame:
    names = F.array(*(F.lit(n) for n in UNIT_NAMES))
    value = (F.col("value") - 50) / 100 * F.length("event_type") / 21 / F.greatest(F.lit(1), F.ascii("event_type") - 110)
    return tables.table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.element_at(names, (F.col("event_id") % len(UNIT_NAMES) + 1).cast("int")).alias("param"), value.alias("value"))


@query("i13_units", "run_id param unit description hint n:int max_drift_ms:5 quality", f"""WITH {MEASURED}, {UNITS_SQL}, v AS (SELECT run_id, param, count(*) AS n, max(abs(value)) AS most FROM me GROUP BY run_id, param)
SELECT *, CASE WHEN unit = 'seconds' THEN 'multiply by 1000 for milliseconds' ELSE 'values in ' || unit END AS hint, CASE WHEN unit = 'seconds' AND contains(param, 'drift') THEN most * 1000 END AS max_drift_ms, CASE WHEN unit = 'seconds' AND contains(param, 'drift') THEN {GRADED} END AS quality FROM v JOIN un USING (param)""")
def _(spark, d):
    return metadata.with_units(measured(spark, d), metadata.units_table(spark))


OWN_UNITS = [("temperature", "seconds", "drift of the warm-up", ""), ("humidity", "seconds", "Drift at the valve", ""), ("frame_mean", "percent", "drift of the mean", "")]


@query("i14_unit_statistics", "run_id param unit mean:6 std:6 min:6 max:6 range:6 mean_ms:4 std_ms:4 max_ms:4 range_ms:4 quality", f"""WITH {MEASURED}, {UNITS_SQL}, own(param, unit, description) AS (VALUES {', '.join(str(u[:3]) for u in OWN_UNITS)}), uu AS (SELECT * FROM un WHERE param NOT IN (SELECT param FROM own) UNION ALL SELECT * FROM own),
v AS (SELECT run_id, param, unit, description, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, max(abs(value)) AS most FROM me JOIN uu USING (param) GROUP BY run_id, param, unit, description)
SELECT *, {', '.join(f"CASE WHEN unit = 'seconds' THEN {c} * 1000 END AS {c}_ms" for c in ('mean', 'std', 'max', 'range'))}, CASE WHEN unit = 'seconds' AND contains(lower(description), 'drift') THEN {GRADED} END AS quality FROM v""")
def _(spark, d):
    """The known units, and a user's own ones in their place, of which two tell of drift."""
    own = spark.createDataFrame(OWN_UNITS, "param string, unit string, description string, hint string")
    known = metadata.units_table(spark)
    return metadata.unit_statistics(measured(spark, d), F.broadcast(known.join(own, "param", "left_anti").unionByName(own)))


#: Attributes of the customers as files: versions, some missing or unreadable, flags that are missing, false or true, files without time series or drifts.
FILE_ATTRIBUTES = {
    "file_version": ("CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'beta' ELSE CAST(c_custkey % 4 AS VARCHAR) || '.' || CAST(c_custkey % 5 AS VARCHAR) END"),
    "structure": "CASE WHEN c_custkey % 7 = 0 THEN 'images' WHEN c_custkey % 17 = 0 THEN NULL ELSE 'timeseries_only' END", "timeseries": "CASE WHEN c_custkey % 6 = 0 THEN 'false' ELSE 'true' END",
    "frame_drift": "CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE 'true' END", "units": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'seconds' END", "display_hint": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'milliseconds' END",
    "expected_intervals_fixed": "CASE WHEN c_custkey % 3 = 0 THEN 'false' WHEN c_custkey % 8 = 1 THEN NULL ELSE 'true' END", "unit_standard": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'SI' END",
}


@query("i15_legacy_check", "run_id old_version no_units intervals_not_fixed no_standard other_structure legacy", f"""WITH a AS (SELECT 'c' || c_custkey AS run_id, {', '.join(f'{v} AS {k}' for k, v in FILE_ATTRIBUTES.items())} FROM customer),
b AS (SELECT run_id, coalesce(TRY_CAST(coalesce(file_version, '1.0') AS DOUBLE) < 2.2, true) AS old_version, timeseries = 'true' AND frame_drift IS NOT NULL AND (units IS NULL OR display_hint IS NULL) AS no_units,
    timeseries = 'true' AND coalesce(expected_intervals_fixed, 'false') = 'false' AS intervals_not_fixed, timeseries = 'true' AND unit_standard IS NULL AS no_standard, coalesce(structure, '') <> 'timeseries_only' AS other_structure FROM a)
SELECT *, old_version OR no_units OR intervals_not_fixed OR no_standard OR other_structure AS legacy FROM b""")
def _(spark, d):
    n = tables.table(spark, d, "customer").selectExpr("concat('c', c_custkey) AS run_id", *(f"{v.replace('VARCHAR', 'STRING')} AS {k}" for k, v in FILE_ATTRIBUTES.items()))
    return metadata.legacy_check(n.unpivot(["run_id"], list(FILE_ATTRIBUTES), "parameter", "value").where("value is not null"))


#: Parameters of numbers, some of them not finite, and of text.
MIXED = META + """, mixed AS (SELECT run_id, idx, param, CASE WHEN param = 'humidity' AND idx % 9 = 4 THEN CAST('inf' AS DOUBLE) WHEN param = 'humidity' AND idx % 9 = 5 THEN CAST('nan' AS DOUBLE) ELSE value END AS value, CAST(NULL AS VARCHAR) AS text FROM meta
UNION ALL SELECT run_id, idx, 'mode', NULL, 'mode' || CAST(idx % 4 AS VARCHAR) FROM ord UNION ALL SELECT run_id, idx, 'single', value, NULL FROM ord WHERE idx = 0)"""


def mixed(spark, d) -> DataFrame:
    odd = F.when((F.col("param") == "humidity") & (F.col("idx") % 9 == 4), float("inf")).when((F.col("param") == "humidity") & (F.col("idx") % 9 == 5), float("nan")).otherwise(F.col("value"))
    m = meta(spark, d).select("run_id", "idx", "param", odd.alias("value"), F.lit(None).cast("string").alias("text"))
    o = ordered(spark, d)
    words = o.select("run_id", "idx", F.lit("mode").alias("param"), F.lit(None).cast("double").alias("value"), F.concat(F.lit("mode"), F.col("idx") % 4).alias("text"))
    return m.unionByName(words).unionByName(o.where("idx = 0").select("run_id", "idx", F.lit("single").alias("param"), "value", F.lit(None).cast("string").alias("text")))


@query("i16_parameter_summary", "run_id param length:int data_type min:6 max:6 mean:6 std:6 distinct_values:int", f"WITH {MIXED}, v AS (SELECT *, CASE WHEN isfinite(value) THEN value END AS f FROM mixed) SELECT run_id, param, count(*) AS length, CASE WHEN count(text) > 0 THEN 'text' ELSE 'number' END AS data_type, min(f) AS min, max(f) AS max, avg(f) AS mean, CASE WHEN count(f) > 1 THEN stddev_pop(f) END AS std, CASE WHEN count(text) > 0 THEN count(DISTINCT text) END AS distinct_values FROM v GROUP BY run_id, param")
def _(spark, d):
    return metadata.parameter_summary(mixed(spark, d))


@query("i17_parameter_inventory", "run_id params:int names data_types longest:int", f"WITH {MIXED} SELECT run_id, count(*) AS params, string_agg(param, ',' ORDER BY param) AS names, string_agg(param || ':' || kind, ',' ORDER BY param) AS data_types, max(n) AS longest FROM (SELECT run_id, param, count(*) AS n, CASE WHEN param = 'mode' THEN 'str' ELSE 'float' END AS kind FROM mixed WHERE param <> '_hidden' GROUP BY run_id, param) GROUP BY run_id")
def _(spark, d):
    return metadata.parameter_inventory(mixed(spark, d))


#: Which channels the users' recordings have, by the user's remainder: both names of white, the last one only, generic alone, infrared alone, all.
CHANNEL_OF = {
    "led_white_power_percent": "u % 7 = 0", "white_led_power": "u % 7 IN (0, 1)", "led_white_power": "u % 7 = 2", "white_led_power_percent": "u % 7 IN (3, 6)", "led_power_percent": "u % 7 IN (1, 4)",
    "led_ir_power_percent": "u % 7 = 6", "ir_led_power": "u % 7 IN (1, 5)", "led_ir_power": "u % 7 = 2", "ir_led_power_percent": "u % 7 IN (2, 6)", "capture_timestamps": "u % 2 = 0",
}
CHANNELS = "uo AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, epoch_us(ts) / 1e6 - 1704067200 AS t FROM events), ch AS (" + " UNION ALL ".join(f"SELECT CAST(u AS VARCHAR) AS run_id, idx, '{c}' AS param, CAST({'t' if c == 'capture_timestamps' else f'value + {k}'} AS DOUBLE) AS value FROM uo WHERE {w}" for k, (c, w) in enumerate(CHANNEL_OF.items())) + ")"


@query("i18_light_channels", "run_id idx:int t:3 white:6 infrared:6 white_name infrared_name", f"""WITH {CHANNELS}, x AS (SELECT CAST(u AS VARCHAR) AS run_id, u, idx, t, value FROM uo WHERE u % 7 IN (0, 1, 2, 3, 6))
SELECT run_id, idx, CASE WHEN u % 2 = 0 THEN t ELSE idx * 5.0 END AS t, value + CASE u % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS white, value + CASE u % 7 WHEN 6 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 7 END AS infrared,
CASE u % 7 WHEN 0 THEN 'led_white_power_percent' WHEN 1 THEN 'white_led_power' WHEN 2 THEN 'led_white_power' ELSE 'white_led_power_percent' END AS white_name, CASE u % 7 WHEN 6 THEN 'led_ir_power_percent' WHEN 1 THEN 'ir_led_power' WHEN 2 THEN 'led_ir_power' END AS infrared_name FROM x""")
def _(spark, d):
    from pyspark.sql import Window

    e = users(spark, d)
    i = F.row_number().over(Window.partitionBy("roi").orderBy("t", "tie")) - 1
    o = e.select(F.col("roi").alias("u"), i.cast("long").alias("idx"), "value", "t")
    has = F.explode(F.array(*(F.struct(F.lit(c).alias("param"), F.expr(w).alias("has"), (F.col("t") if c == "capture_timestamps" else F.col("value") + k).alias("v")) for k, (c, w) in enumerate(CHANNEL_OF.items()))))
    m = o.select("u", "idx", has.alias("c")).where("c.has").select(F.col("u").cast("string").alias("run_id"), "idx", "c.param", F.col("c.v").alias("value"))
    return metadata.light_channels(m, 5)


# A lamp for each of three runs: of day, all events of a user's remainder by their value; at night off.
LED = "led AS (SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, t, max(CASE WHEN hr >= 7 AND hr < 19 AND value > 3 THEN value / 100 ELSE 0 END) AS white FROM (SELECT epoch_us(ts) / 1e6 - 1704067200 AS t, user_id, value, hour(ts) AS hr FROM events) GROUP BY 1, 2)"
LIGHT = LED + """, l1 AS (SELECT *, CASE WHEN white > 0.05 THEN 1 ELSE 0 END AS lit, lead(t) OVER (PARTITION BY run_id ORDER BY t) AS nx FROM led), l2 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) - row_number() OVER (PARTITION BY run_id, lit ORDER BY t) AS run FROM l1),
l3 AS (SELECT run_id, min(t) AS start, max(coalesce(nx, t)) AS "end" FROM l2 WHERE lit = 1 GROUP BY run_id, run), l4 AS (SELECT run_id, "end" AS start, lead(start) OVER (PARTITION BY run_id ORDER BY start) AS "end" FROM l3)"""
LIT_RUNS = "s AS (SELECT CAST(user_id % 3 AS VARCHAR) AS run_id, event_type AS roi, epoch_us(ts) / 1e6 - 1704067200 AS t, value, event_id AS tie FROM events)"


def led(spark, d) -> DataFrame:
    e = tables.event_samples(spark, d, run="cast(user_id % 3 AS string)")
    hour = F.floor(F.pmod(F.col("t"), F.lit(86_400)) / 3600)
    return e.groupBy("run_id", "t").agg(F.max(F.when((hour >= 7) & (hour < 19) & (F.col("value") > 3), F.col("value") / 100).otherwise(F.lit(0.0))).alias("white"))


@query("i19_light_periods", "run_id phase start:3 end:3", f"""WITH {LIGHT}, u AS (SELECT run_id, 'light' AS phase, start, "end" FROM l3 UNION ALL SELECT run_id, 'dark', start, "end" FROM l4 WHERE "end" IS NOT NULL AND "end" > start), v AS (SELECT run_id, phase, greatest(start, 100000) AS start, least("end", 2000000) AS "end" FROM u) SELECT * FROM v WHERE "end" > start""")
def _(spark, d):
    return metadata.light_periods(led(spark, d), 0.05, (100_000.0, 2_000_000.0))


@query("i20_fixed_schedule", "run_id day:int start:3 end:3", with_(S) + """, e AS (SELECT run_id, min(t) AS t0, max(t) AS tn FROM s GROUP BY run_id), x AS (SELECT *, unnest(range(CAST(floor(t0 / 86400) AS BIGINT), CAST(floor(tn / 86400) AS BIGINT) + 1)) AS day FROM e), y AS (SELECT run_id, day, greatest(t0, day * 86400 + 25200) AS start, least(tn, day * 86400 + 68400) AS "end" FROM x) SELECT * FROM y WHERE "end" > start""")
def _(spark, d):
    return metadata.fixed_schedule(events(spark, d).groupBy("run_id").agg(F.min("t").alias("t0"), F.max("t").alias("tn")))


@query("i21_light_phase", f"{KEY} tie:int light:int", with_(LIT_RUNS, LED) + " SELECT s.run_id, s.roi, s.tie, CASE WHEN white > 0.05 THEN 1 WHEN white IS NOT NULL THEN 0 END AS light FROM s ASOF LEFT JOIN led ON s.run_id = led.run_id AND s.t >= led.t")
def _(spark, d):
    return metadata.with_light(tables.event_samples(spark, d, run="cast(user_id % 3 AS string)"), led(spark, d), 0.05)


@query("i22_detected_interval", "run_id interval:4 std:4 n:int", f"WITH {META} SELECT run_id, avg(gap) AS interval, stddev_pop(gap) AS std, count(*) AS n FROM (SELECT *, t - lag(t) OVER (PARTITION BY run_id ORDER BY idx) AS gap FROM ord) WHERE gap IS NOT NULL AND idx <= 9 GROUP BY run_id")
def _(spark, d):
    return metadata.detected_interval(ordered(spark, d))


# Streams over the same files.


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream. The pattern names the table alone, whether it is one file, which a stream doesn't take by its own path, or a folder of files."""
    schema = tables.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query("k1_streamed_activity", "run_id roi:int t:3 value:5", f"WITH {PIXELS}, {MASKS}, df AS (SELECT run_id, px, frame_idx, lead(v) OVER (PARTITION BY px ORDER BY frame_idx) - v AS delta, row_number() OVER (PARTITION BY px ORDER BY frame_idx) - 1 AS i FROM px) SELECT run_id, roi, i * 5.0 AS t, sum(abs(delta)) AS value FROM df JOIN mk USING (run_id, px) WHERE delta IS NOT NULL GROUP BY run_id, roi, i")
def _(spark, d):
    f = stream_of(spark, d, "embeddings").select(F.lit("camera").alias("run_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("pixels"))
    return incremental.run_to_table(incremental.activity(f, masks(spark, d), 5), tables.scratch(spark, "stream"))


@query("k2_streamed_hysteresis", f"{KEY} tie:int state:int", with_(S, LIMITS, sql.hysteresis("s", "b", "h")) + " SELECT * FROM h")
def _(spark, d):
    e = stream_of(spark, d, "events")
    s = e.select(F.lit("events").alias("run_id"), F.col("event_type").alias("roi"), tables.seconds(F.col("ts")).alias("t"), "value", F.col("event_id").alias("tie"))
    return incremental.run_to_table(incremental.hysteresis(s, limits(spark, d)), tables.scratch(spark, "stream"))


@query("k2_ordered_hysteresis", f"{KEY} t:3 tie:int state:int", with_(S, LIMITS, sql.hysteresis("s", "b", "h")) + " SELECT * FROM h WHERE t <= (SELECT max(t) - 3600 FROM s)")
def _(spark, d):
    """What the watermark has passed, an hour behind the last event."""
    e = stream_of(spark, d, "events")
    s = e.select(F.lit("events").alias("run_id"), F.col("event_type").alias("roi"), tables.seconds(F.col("ts")).alias("t"), "value", F.col("event_id").alias("tie"))
    return incremental.run_to_table(incremental.ordered_hysteresis(s, limits(spark, d)), tables.scratch(spark, "stream"), rocksdb=True)


#: Runs of several regions each, with limits of their own; one region has none.
RUNS = "CAST(user_id % 4 AS VARCHAR)"
RUN_LIMITS = "b AS (SELECT run_id, roi, avg(value) AS baseline_mean, avg(value) + 5 * CAST(run_id AS INTEGER) AS upper, avg(value) - 5 * CAST(run_id AS INTEGER) AS lower FROM s WHERE roi <> 'error' GROUP BY run_id, roi)"


@query("k2_many_runs", f"{KEY} tie:int state:int", with_(sql.samples(run=RUNS), RUN_LIMITS, sql.hysteresis("s", "b", "h")) + " SELECT * FROM h")
def _(spark, d):
    e = stream_of(spark, d, "events")
    s = e.select(F.expr(RUNS.replace("VARCHAR", "STRING")).alias("run_id"), F.col("event_type").alias("roi"), tables.seconds(F.col("ts")).alias("t"), "value", F.col("event_id").alias("tie"))
    mean, width = F.avg("value"), 5 * F.first("run_id").cast("int")
    known = tables.event_samples(spark, d, run=RUNS.replace("VARCHAR", "STRING")).where("roi <> 'error'").groupBy("run_id", "roi").agg(mean.alias("baseline_mean"), (mean + width).alias("upper"), (mean - width).alias("lower"))
    return incremental.run_to_table(incremental.hysteresis(s, known), tables.scratch(spark, "stream"))


@query("k3_streamed_bins", "event_type t:1 mean:6 n:int", "SELECT * FROM (SELECT event_type, floor(epoch_us(ts) / 1e6 / 1800) * 1800 - 1704067200 AS t, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2) WHERE t + 1800 + 1704067200 <= (SELECT max(epoch_us(ts)) / 1e6 - 3600 FROM events)")
def _(spark, d):
    e = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.run_to_table(incremental.binned_means(e, "event_type"), tables.scratch(spark, "stream"))
    return out.select("event_type", tables.seconds(F.col("start")).alias("t"), "mean", "n")
