"""Queries of alignment, geometry, measurement and of jobs that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import align as A
from motion_tables.operators import geometry as G
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y
from motion_tables.sources.scratch import scratch_folder

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
_NAMES = ["P1", "P4", "P6", "P9", "P10"]
_PAIRS = """pr AS (SELECT o_orderkey AS pair_id, a AS u_P1, a + b AS u_P4, a + b + c AS u_P6, a + b + c + d AS u_P9, a + b + c + d + 4 AS u_P10, d AS r_P1, d + c AS r_P4, d + c + 1 + b // 2 AS r_P6, d + c + 1 + b // 2 + a AS r_P9, d + c + 4 + b // 2 + a AS r_P10
    FROM (SELECT o_orderkey, CAST(o_custkey % 5 AS INTEGER) AS a, CAST(5 + o_orderkey % 20 AS INTEGER) AS b, CAST(3 + o_custkey % 7 AS INTEGER) AS c, CAST(o_orderkey % 9 AS INTEGER) AS d FROM orders))"""


def _pairs(spark, d):
    o = D.table(spark, d, "orders")
    a, b, c, e = (v.cast("int") for v in (F.col("o_custkey") % 5, 5 + F.col("o_orderkey") % 20, 3 + F.col("o_custkey") % 7, F.col("o_orderkey") % 9))
    half = F.floor(b / 2).cast("int")
    u = dict(zip(_NAMES, (a, a + b, a + b + c, a + b + c + e, a + b + c + e + 4)))
    r = dict(zip(_NAMES, (e, e + c, e + c + 1 + half, e + c + 1 + half + a, e + c + 4 + half + a)))
    return o.select(F.col("o_orderkey").alias("pair_id"), *[v.alias(f"u_{k}") for k, v in u.items()], *[v.alias(f"r_{k}") for k, v in r.items()])


_PIECES = f"""{_PAIRS}, ph AS ({" UNION ALL ".join(f"SELECT pair_id, {0 if i == 0 else 1} AS f, u_{a} AS u0, r_{a} AS r0, u_{b} - u_{a} AS u, r_{b} - r_{a} AS r FROM pr" for i, (a, b) in enumerate(zip(_NAMES, _NAMES[1:])))})
, st AS (SELECT *, unnest(range(f, u + 1)) AS i FROM ph WHERE u > 0 AND r > 0), al AS (SELECT pair_id, u0 + i AS user_frame, r0 + CAST(floor(i::DOUBLE / u * r) AS INTEGER) AS ref_frame FROM st)"""


@_R.add("d10_piecewise_alignment", f"WITH {_PIECES} SELECT * FROM al")
def piecewise_alignment(spark, d):
    return A.piecewise(_pairs(spark, d), _NAMES)


@_R.add("w24_playback_plan", f"""WITH {_PIECES}, n AS (SELECT *, row_number() OVER w - 1 AS n, lead(user_frame) OVER w IS NULL AS l FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY user_frame, ref_frame)), k AS (SELECT *, unnest(CASE WHEN l THEN [0] ELSE [0, 1, 2, 3] END) AS k FROM n WHERE pair_id % 20 = pair_id % 20)
SELECT pair_id, n * 4 + k AS out_frame, user_frame, ref_frame, k / 4.0::DOUBLE AS fraction, round((n * 4 + k) / 30.0::DOUBLE, 6) AS out_seconds FROM k""".replace(" WHERE pair_id % 20 = pair_id % 20", ""))
def playback_plan(spark, d):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, for a pair becomes many lines
    pairs = _pairs(spark, d).repartition(tasks, "pair_id")  # dealt out before it does
    return rounded(A.playback(A.piecewise(pairs, _NAMES)), but=("fraction",))  # which are quarters


@_R.add("d12_dtw_features")
def dtw_features(spark, d):
    return A.features(D.pose(spark, d))


def _ring(spark, d):
    v = D.pose(spark, d).select("video_id").distinct()
    return v.select(F.col("video_id").cast("long").alias("pair_id"), F.col("video_id").alias("user_id"), ((F.col("video_id") + 1) % 10).alias("ref_id"))


@_R.add("d13_dtw_paths")
def dtw_paths(spark, d):
    return A.dtw_paths(A.features(D.pose(spark, d)), _ring(spark, d))


def _marks():
    return F.explode(F.array(*[F.struct(F.lit(f"P{k}").alias("p"), F.lit(4 * k).alias("ref_frame")) for k in range(1, 11)])).alias("m")


@_R.add("j20_transferred_positions")
def transferred_positions(spark, d):
    return A.transferred(dtw_paths(spark, d), _ring(spark, d).select("pair_id", _marks()).select("pair_id", "m.*"))


@_R.add("d16_label_transfer")
def label_transfer(spark, d):
    return A.label_transfer(D.pose(spark, d), _ring(spark, d), _ring(spark, d).select("pair_id", _marks()).select("pair_id", "m.*"))


# A rig of two cameras 1440 x 1080, one behind the player and one beside, in metres; rotations row by row.
CAMERAS = [("dtl", 1500.0, 1501.5, 723.5, 538.0, [-0.12, 0.06, 0.0005, -0.0003, 0.0], [0.0, -1.0, 0.0, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0], [0.95, 1.25, 4.2]), ("face_on", 1500.0, 1501.5, 723.5, 538.0, [-0.12, 0.06, 0.0005, -0.0003, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0], [-0.1, 1.15, 3.6])]
_CAMERA = "rig_id int, camera_id string, fx double, fy double, cx double, cy double, dist array<double>, r array<double>, t array<double>"


def _cameras(spark):
    return spark.createDataFrame([(0, *c) for c in CAMERAS], _CAMERA)


def _points(spark, d):
    e = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("e"))
    return e.select(F.lit(0).alias("rig_id"), "point_id", *[(F.get("e", F.lit(i)) * 2 + (1.0 if a == "z" else 0.0)).alias(a) for i, a in enumerate("xyz")])


def _camera_sql() -> str:
    rows = []
    for name, fx, fy, cx, cy, dist, r, t in CAMERAS:
        numbers = ", ".join(f"{v}::DOUBLE" for v in (fx, fy, cx, cy))
        lists = ", ".join("[" + ", ".join(f"{v}::DOUBLE" for v in x) + "]" for x in (dist, r, t))
        rows.append(f"SELECT '{name}' AS camera_id, {', '.join(f'{n} AS {c}' for n, c in zip(numbers.split(', '), ('fx', 'fy', 'cx', 'cy')))}, {lists.split('], ')[0]}] AS d, {lists.split('], ')[1]}] AS r, {lists.split('], ')[2]} AS t")
    return " UNION ALL ".join(rows)


_PROJECT = f"""cam AS ({_camera_sql()}), pt AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE * 2 AS x, embedding[2]::DOUBLE * 2 AS y, embedding[3]::DOUBLE * 2 + 1 AS z FROM embeddings)
, cc AS (SELECT *, r[1] * x + r[2] * y + r[3] * z + t[1] AS xc, r[4] * x + r[5] * y + r[6] * z + t[2] AS yc, r[7] * x + r[8] * y + r[9] * z + t[3] AS depth FROM pt, cam), nn AS (SELECT *, CASE WHEN depth > 0 THEN xc / depth END AS a, CASE WHEN depth > 0 THEN yc / depth END AS b FROM cc)
, rr AS (SELECT *, 1 + d[1] * (a * a + b * b) + d[2] * power(a * a + b * b, 2) + d[5] * power(a * a + b * b, 3) AS rad FROM nn)
, pj AS (SELECT point_id, camera_id, fx * (a * rad + 2 * d[3] * a * b + d[4] * (3 * a * a + b * b)) + cx AS u, fy * (b * rad + d[3] * (a * a + 3 * b * b) + 2 * d[4] * a * b) + cy AS v, depth FROM rr)"""


@_R.add("g1_projected_points", f"WITH {_PROJECT} SELECT point_id, camera_id, round(u, 4) AS u, round(v, 4) AS v, round(depth, 4) AS depth FROM pj")
def projected_points(spark, d):
    return rounded(G.projected(_points(spark, d), _cameras(spark)), 4)


@_R.add("g3_triangulated_points", f"WITH {_PROJECT} SELECT pt.point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, 2 AS n_views FROM pt JOIN pj USING (point_id) WHERE u IS NOT NULL GROUP BY ALL HAVING count(*) = 2")
def triangulated_points(spark, d):
    """Points seen by both cameras come back from their pixels: the SQL gives the points themselves."""
    cams = _cameras(spark)
    seen = G.projected(_points(spark, d), cams).select("point_id", "camera_id", "u", "v")
    return rounded(G.triangulated(seen, cams).select("point_id", "x", "y", "z", "n_views"), 4)


@_R.add("g4_point_reasons")
def point_reasons(spark, d):
    cams = _cameras(spark)
    seen = G.projected(_points(spark, d), cams).select("point_id", "camera_id", (F.col("u") + F.when(F.col("point_id") % 10 == 3, 40.0).otherwise(0.0)).alias("u"), "v")
    return G.point_reasons(G.triangulated(seen, cams)).select("point_id", "reasons")


_PATH = "pa AS (SELECT label AS shot_id, vec_id * 4.0::DOUBLE AS t_ms, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _path(spark, d):
    e = D.table(spark, d, "embeddings")
    return e.select(F.col("label").alias("shot_id"), (F.col("vec_id") * 4.0).alias("t_ms"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")])


@_R.add("w23_central_speeds", f"""WITH {_PATH}, q AS (SELECT *, t_ms - lag(t_ms) OVER w AS st, lead(t_ms) OVER w - lag(t_ms) OVER w AS gap, sqrt(power(lead(x) OVER w - lag(x) OVER w, 2) + power(lead(y) OVER w - lag(y) OVER w, 2) + power(lead(z) OVER w - lag(z) OVER w, 2)) AS dist FROM pa WINDOW w AS (PARTITION BY shot_id ORDER BY t_ms))
, m AS (SELECT shot_id, median(st) AS med FROM q GROUP BY shot_id) SELECT q.shot_id, t_ms, round(CASE WHEN gap <= 3.2::DOUBLE * med THEN dist / gap * 1000 END, 4) AS speed FROM q JOIN m USING (shot_id)""")
def central_speeds(spark, d):
    return rounded(G.speeds(_path(spark, d)).select("shot_id", "t_ms", "speed"), 4)


@_R.add("g15_low_points", f"WITH {_PATH}, q AS (SELECT *, lag(z) OVER w AS b, lead(z) OVER w AS a, row_number() OVER (PARTITION BY shot_id ORDER BY z, t_ms) AS k FROM pa WINDOW w AS (PARTITION BY shot_id ORDER BY t_ms)) SELECT shot_id, t_ms, x, y, z FROM q WHERE k = 1 AND b > z AND a > z")
def low_points(spark, d):
    return G.low_points(_path(spark, d))


@_R.add("a17_rigidity", f"WITH {D.POSE}, q AS (SELECT video_id AS shot_id, frame, sqrt(power(e[22] - e[25], 2) + power(e[23] - e[26], 2) + power(e[24] - e[27], 2)) AS length FROM p), m AS (SELECT shot_id, median(length) AS median FROM q GROUP BY shot_id HAVING count(*) >= 3) SELECT q.shot_id, frame, round(length, 6) AS length, round(median, 6) AS median FROM q JOIN m USING (shot_id) WHERE abs(length - median) > greatest(0.01::DOUBLE, 0.05::DOUBLE * median)")
def rigidity(spark, d):
    a, b = P.at(F.col("lm"), 7), P.at(F.col("lm"), 8)
    ends = D.pose(spark, d).select(F.col("video_id").alias("shot_id"), "frame", *[q[k].alias(n + k) for n, q in (("a", a), ("b", b)) for k in "xyz"])
    return rounded(G.segment_rigidity(ends))


_BODY = f"sqrt(power(({x(1)} + {x(2)} - {x(13)} - {x(14)}) / 2, 2) + power(({y(1)} + {y(2)} - {y(13)} - {y(14)}) / 2, 2))"


@_R.add("d22_displacements", f"""WITH {D.POSE}, r AS (SELECT video_id, e AS e0, {_BODY} AS scale FROM p WHERE frame = 0), q AS (SELECT p.video_id, frame, e, e0, scale, unnest(['head', 'lead_hand', 'pelvis']) AS key, unnest([0, 5, 13]) AS j FROM p JOIN r USING (video_id))
SELECT video_id, frame, key, CASE WHEN scale > 0 THEN round((e[3 * j + 1] - e0[3 * j + 1]) / scale, 5) + 0 END AS dx, CASE WHEN scale > 0 THEN round((e0[3 * j + 2] - e[3 * j + 2]) / scale, 5) + 0 END AS dy FROM q""")
def displacements(spark, d):
    from motion_tables.operators.measure import displacements as measured

    return rounded(measured(D.pose(spark, d), {"head": P.NOSE, "lead_hand": P.L_WRIST, "pelvis": P.L_HIP}), 5)


@_R.add("j11_compared_measurements", f"""WITH {D.POSE}, m AS (SELECT video_id, frame, 'hands_height' AS key, ({y(5)} + {y(6)}) / 2 AS value FROM p UNION ALL SELECT video_id, frame, 'shoulder_tilt', degrees(atan2({y(2)} - {y(1)}, {x(2)} - {x(1)})) FROM p)
SELECT u.video_id, u.frame, u.key, round(u.value, 5) AS user_value, round(r.value, 5) AS ref_value, round(u.value - r.value, 5) + 0 AS difference FROM m u JOIN m r ON r.video_id = (u.video_id + 2) % 10 AND r.frame = u.frame AND r.key = u.key WHERE u.video_id % 2 = r.video_id % 2""")
def compared_measurements(spark, d):
    from motion_tables.operators.measure import compared, long_form

    p = D.pose(spark, d)
    lm = F.col("lm")
    hands = P.mid(P.at(lm, P.L_WRIST), P.at(lm, P.R_WRIST), "y")
    m = long_form(p, {"hands_height": hands, "shoulder_tilt": F.degrees(P.line_tilt(P.at(lm, 1), P.at(lm, 2)))}).withColumn("view", F.col("video_id") % 2)
    user = m.withColumn("pair_id", F.col("video_id"))
    ref = m.withColumn("pair_id", F.pmod(F.col("video_id") - 2, F.lit(10)))
    return rounded(compared(user, ref).select(F.col("pair_id").alias("video_id"), "frame", "key", "user_value", "ref_value", "difference"), 5)


#: A camera's frames for the ingest: ten sessions, numbers that at times repeat, sizes and formats that at times change; they arrive a little out of order.
_ARRIVING = """SELECT user_id % 10 AS session_id, event_type AS camera_id, event_id * 4 + event_id * 7 % 1000 AS arrival, CAST(floor(event_id / 40) AS BIGINT) AS sequence, {ns} AS ts_ns, CAST(floor(value * 100) AS BIGINT) AS bytes,
    CASE WHEN event_id % 37 = 5 THEN 320 ELSE 640 END AS width, 480 AS height, CASE WHEN event_id % 41 = 7 THEN 'yuv' ELSE 'rgb' END AS format, ts FROM {t} WHERE user_id IS NOT NULL AND event_type IS NOT NULL"""
_DUCK_ARRIVING = _ARRIVING.replace("{ns}", "epoch_us(ts) * 1000").replace("{t}", "events")


def _event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern, so that a single file will do as well as a folder


@_R.add("st1_ordered_ingest", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, camera_id ORDER BY arrival, sequence, ts_ns) AS k FROM ({_DUCK_ARRIVING}))
, r AS (SELECT DISTINCT session_id, camera_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BIGINT) AS sequence, CAST(NULL AS BIGINT) AS ts_ns, CAST(NULL AS BIGINT) AS last_ns, CAST(NULL AS BIGINT) AS last_sequence, CAST(NULL AS INTEGER) AS w, CAST(NULL AS VARCHAR) AS f, CAST(NULL AS VARCHAR) AS rule, CAST(0 AS BIGINT) AS missing FROM e
UNION ALL SELECT session_id, camera_id, k, arrival, sequence, ts_ns, CASE WHEN rule IS NULL THEN ts_ns ELSE last_ns END, CASE WHEN rule IS NULL THEN sequence ELSE last_sequence END, w, f, rule, CASE WHEN rule IS NULL THEN coalesce(sequence - last_sequence - 1, 0) ELSE 0 END
    FROM (SELECT *, CASE WHEN width <> w THEN 'size changed' WHEN format <> f THEN 'format changed' WHEN ts_ns = last_ns THEN 'duplicate timestamp' WHEN ts_ns < last_ns THEN 'backward timestamp' WHEN sequence <= last_sequence THEN 'sequence does not increase' WHEN bytes > 40000 THEN 'larger than the buffer' END AS rule
    FROM (SELECT e.*, r.last_ns, r.last_sequence, coalesce(r.w, e.width) AS w, coalesce(r.f, e.format) AS f FROM r JOIN e ON e.session_id = r.session_id AND e.camera_id = r.camera_id AND e.k = r.k + 1)))
SELECT session_id, camera_id, arrival, sequence, rule IS NULL AS accepted, rule, missing FROM r WHERE k > 0""")
def ordered_ingest(spark, d):
    """Frames through the stateful stream, once over all that is there; what it wrote is read back."""
    from motion_tables.streaming import capture

    capture.state_store(spark)
    f = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("*", "unix_micros(ts) * 1000 AS ns")
    frames = spark.sql(_ARRIVING.replace("{ns}", "ns"), t=f)
    out = scratch_folder(spark, "ingest")
    capture.ordered_ingest(frames, most_bytes=40_000).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(capture.OUT).parquet(out).select("session_id", "camera_id", "arrival", "sequence", "accepted", "rule", "missing")


@_R.add("st5_stream_retention")
def stream_retention(spark, d):
    """What each camera still holds of what a stream has brought in: the retention is a window over the landed frames, so nothing is buffered in a state."""
    from motion_tables.operators.windows import retained

    f = _event_stream(spark, d).where("user_id is not null and event_type is not null")
    f = f.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("camera_id"), F.col("event_id").alias("sequence"), (D.micros("ts") * 1000).alias("ts_ns"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))
    out = scratch_folder(spark, "landed")
    f.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    landed = spark.read.schema("session_id long, camera_id string, sequence long, ts_ns long, bytes long").parquet(out)
    return retained(landed, 600_000 * 10**9, 20_000).select("session_id", "camera_id", "sequence", "ts_ns")


@_R.add("st2_stream_clips")
def stream_clips(spark, d):
    """The clips of all triggers by the join of two streams, once over all that is there."""
    from motion_tables.streaming.capture import trigger_clips

    events = f"{d}/events.parquet"  # a pattern to the stream, so that a single file will do as well as a folder
    schema = spark.read.parquet(events).schema

    def stream():
        return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").where("user_id is not null and event_type is not null")

    ns = D.micros("ts") * 1000
    f = stream().select(F.col("user_id").alias("session_id"), F.col("event_type").alias("camera_id"), F.col("event_id").alias("sequence"), ns.alias("ts_ns"), F.col("ts").cast("timestamp").alias("ts"))
    t = stream().where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("shot_id"), ns.alias("trigger_ns"), F.lit(6 * 3600 * 10**9).cast("long").alias("pre_roll_ns"), F.col("ts").cast("timestamp").alias("ts"))
    out = scratch_folder(spark, "clips")
    clips = trigger_clips(t, f).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    clips.awaitTermination()
    return spark.read.parquet(out)


from motion_tables.plans.join_queries import ORACLE_SQL as _JOINS  # noqa: E402

from motion_tables.plans.series_queries import ORACLE_SQL as _SERIES  # noqa: E402

ORACLE_SQL["st2_stream_clips"] = _JOINS["j17_trigger_clips"]
ORACLE_SQL["st5_stream_retention"] = _SERIES["w22_retained"]


@_R.add("u1_model_inference", f"WITH {D.POSE} SELECT video_id, frame, round(({x(0)} + {x(5)}) / 2, 6) AS x, round(({y(0)} + {y(5)}) / 2, 6) AS y, round(conf, 6) AS score FROM p WHERE frame % 17 <> 5")
def model_inference(spark, d):
    from motion_tables.operators.inference import MidpointBackend, inferred

    return rounded(inferred(D.pose(spark, d), MidpointBackend))


@_R.add("u2_inference_cache", f"""WITH {D.POSE} SELECT CASE WHEN video_id IN (3, 7) THEN 'first' ELSE 'second' END AS run, video_id, count(*) AS frames, round(sum(conf), 6) AS score FROM p WHERE frame % 17 <> 5 GROUP BY ALL
    UNION ALL SELECT 'third', video_id, count(*), round(sum(conf), 6) FROM p WHERE frame % 17 <> 5 AND video_id = 5 GROUP BY ALL""")
def inference_cache(spark, d):
    """Two recordings are inferred, then all (which runs the others), then all again with one of other content: every result with the run that made it."""
    from motion_tables.operators.inference import InferenceStore, MidpointBackend

    p = D.pose(spark, d).withColumn("digest", F.sha2(F.concat(F.lit("v"), F.col("video_id").cast("string")), 256))
    changed = p.withColumn("digest", F.when(F.col("video_id") == 5, F.sha2(F.lit("other"), 256)).otherwise(F.col("digest")))
    store = InferenceStore(spark, scratch_folder(spark, "inference"))
    runs = {store.run(p.where("video_id in (3, 7)"), MidpointBackend): "first", store.run(p, MidpointBackend): "second", store.run(changed, MidpointBackend): "third"}
    every = store.results(p.unionByName(changed), MidpointBackend)
    named = F.element_at(F.create_map(*[F.lit(v) for item in runs.items() for v in item]), F.col("run"))
    return rounded(every.groupBy(named.alias("run"), "video_id").agg(F.count("*").alias("frames"), F.sum("score").alias("score")))
