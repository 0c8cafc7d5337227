"""Queries of gates and states in space: order lines stand for the views and points of a shot, recordings' poses for points in metres."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import space3d as S
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y, z

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_NAMES = ["left_wrist", "clubhead_toe", "ball_center", "nose", "floor_a", "left_knee", "right_elbow", "unknown_point"]
_NAME = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "][l_partkey % 8 + 1]"
_BOUND = "CASE l_partkey % 8 WHEN 0 THEN 20 WHEN 1 THEN 70 WHEN 2 THEN 105 WHEN 3 THEN 6 WHEN 4 THEN 1 WHEN 5 THEN 6 WHEN 6 THEN 15 ELSE 105 END::DOUBLE"


def _name():
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("l_partkey") % 8 + 1).cast("int"))


@_R.add("sc23_speed_bounds", f"SELECT l_orderkey, l_linenumber, {_NAME} AS point, ['hands_grip', 'clubhead', 'ball', 'head_torso', 'ground_marker', 'legs_feet', 'forearm_elbow', 'ball'][l_partkey % 8 + 1] AS speed_class, {_BOUND} AS bound FROM lineitem")
def speed_bounds(spark, d):
    l = D.table(spark, d, "lineitem").withColumn("point", _name())
    return l.select("l_orderkey", "l_linenumber", "point", S.speed_class(F.col("point")).alias("speed_class"), S.speed_bound(F.col("point")).alias("bound"))


#: A pair of views for each line: gap, uncertainty, exposure and the motion scales of both.
_TIMES = """tm AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 AS gap, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_tax * 10 END AS unc, CASE l_suppkey % 3 WHEN 0 THEN 'included' WHEN 1 THEN 'bounded' ELSE 'unknown' END AS alignment,
    CASE WHEN l_suppkey % 6 = 1 THEN l_discount END AS exposure, CASE WHEN l_partkey % 10 = 3 THEN NULL ELSE 1.0::DOUBLE END AS s0, CASE WHEN l_partkey % 13 = 5 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS s1 FROM lineitem)
, tb AS (SELECT *, CASE WHEN alignment = 'included' THEN 0::DOUBLE WHEN alignment = 'bounded' THEN exposure END AS ex FROM tm)
, tu AS (SELECT *, list_filter([CASE WHEN unc IS NULL THEN 'synchronization uncertainty is unknown' END, CASE WHEN ex IS NULL THEN 'exposure alignment is unknown' END, CASE WHEN s0 IS NULL THEN 'motion time of a stream is unknown' END,
    CASE WHEN s0 <> s1 THEN 'clocks run at different rates' END], lambda v: v IS NOT NULL) AS unknown FROM tb)
, tt AS (SELECT *, CASE WHEN len(unknown) = 0 THEN round(least(s0, s1) * (gap + unc) + ex, 6) END AS bound_ms FROM tu)"""


def _timed(spark, d):
    when = lambda cond, v: F.when(F.expr(cond), v)
    l = D.table(spark, d, "lineitem")
    return S.frame_timing(l.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10).alias("pair_gap_ms"), when("l_partkey % 9 <> 0", F.col("l_tax") * 10).alias("sync_uncertainty_ms"),
        when("l_suppkey % 3 = 0", F.lit("included")).when(F.expr("l_suppkey % 3 = 1"), "bounded").otherwise("unknown").alias("exposure_alignment"), when("l_suppkey % 6 = 1", F.col("l_discount")).alias("exposure_uncertainty_ms"),
        F.array(when("l_partkey % 10 <> 3", F.lit(1.0)), when("l_partkey % 13 = 5", F.lit(0.25)).otherwise(1.0)).alias("scales"),
    ))


@_R.add("g8_frame_timing", f"WITH {_TIMES} SELECT l_orderkey, l_linenumber, unknown, bound_ms FROM tt")
def frame_timing(spark, d):
    return _timed(spark, d).select("l_orderkey", "l_linenumber", "unknown", "bound_ms")


@_R.add("g8_point_timing", f"""WITH {_TIMES}, pt AS (SELECT *, {_NAME} AS point, l_partkey % 7 <> 2 AS placed, CASE WHEN l_partkey % 7 <> 2 THEN {_BOUND} * bound_ms / 1000 END AS err FROM tt)
SELECT l_orderkey, l_linenumber, point, round(err, 6) AS timing_error_m, CASE WHEN NOT placed THEN 'not_applicable' WHEN bound_ms IS NULL THEN 'unknown' WHEN err <= 0.05::DOUBLE THEN 'within' ELSE 'exceeds' END AS timing_status FROM pt""")
def point_timing(spark, d):
    p = _timed(spark, d).withColumn("point", _name()).withColumn("placed", F.expr("l_partkey % 7 <> 2"))
    return rounded(S.point_timing(p, 0.05).select("l_orderkey", "l_linenumber", "point", "timing_error_m", "timing_status"))


_WORD = {"kind": "CASE WHEN l_linenumber % 3 = 0 THEN 'static_address' ELSE 'dynamic' END", "calibration": "CASE WHEN l_partkey % 7 = 0 THEN 'estimated' ELSE 'verified' END", "shot_calibration": "CASE WHEN l_partkey % 8 = 0 THEN 'unknown' ELSE 'verified' END",
         "same_swing": "CASE WHEN l_suppkey % 5 = 0 THEN 'asserted' ELSE 'verified' END", "same_method": "'flash'", "same_by": "CASE WHEN l_partkey % 6 = 1 THEN ' ' ELSE 'ann' END", "same_at": "CASE WHEN l_partkey % 12 = 5 THEN NULL ELSE '2024-01-01' END",
         "synchronization": "CASE WHEN l_suppkey % 4 = 0 THEN 'estimated' ELSE 'verified' END", "sync_offset_ms": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_tax END", "estimated_views": "l_partkey % 5 % 2", "unverified_streams": "l_suppkey % 7 % 2"}


@_R.add("g6_frame_status", f"""WITH {_TIMES.replace('FROM lineitem)', ', l_tax FROM lineitem)', 1)}, fs AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _WORD.items())} FROM tt)
, fr AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN calibration <> 'verified' THEN 'calibration not verified' END, CASE WHEN shot_calibration <> 'verified' THEN 'the shot''s calibration not verified' END, CASE WHEN same_swing <> 'verified' THEN 'same swing not verified' END,
    CASE WHEN same_swing = 'verified' AND (trim(same_by) = '' OR same_at IS NULL) THEN 'same swing verified without provenance' END, CASE WHEN kind = 'dynamic' AND synchronization <> 'verified' THEN 'synchronization not verified' END,
    CASE WHEN kind = 'dynamic' AND synchronization = 'verified' AND (sync_offset_ms IS NULL OR unc IS NULL) THEN 'synchronization without offset or uncertainty' END, CASE WHEN kind = 'dynamic' AND estimated_views > 0 THEN 'estimated timestamp' END,
    CASE WHEN kind = 'dynamic' AND unverified_streams > 0 THEN 'source timestamps not verified' END], lambda v: v IS NOT NULL) || CASE WHEN kind = 'dynamic' THEN list_transform(unknown, lambda u: 'timing bound unknown: ' || u) ELSE [] END AS reasons FROM fs)
SELECT l_orderkey, l_linenumber, reasons, CASE WHEN len(reasons) = 0 THEN 'measured' ELSE 'unverified' END AS status FROM fr""")
def frame_status(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    l = D.table(spark, d, "lineitem")
    timed = _timed(spark, d).select(*key, "unknown", "sync_uncertainty_ms", F.col("pair_gap_ms"))
    words = l.select(*key, *[F.expr(v).alias(k) for k, v in _WORD.items()], (F.col("l_quantity") / 10).alias("pair_gap_ms"))
    both = words.distinct().join(timed, [*key, "pair_gap_ms"])
    return S.frame_status(both).select("l_orderkey", "l_linenumber", "reasons", "status")


#: Three views of each point: a view is a line's, its point the part's.
_VIEWS = "vw AS (SELECT l_orderkey AS shot_id, l_suppkey % 3 AS frame, 'p' || (l_partkey % 2) AS point, l_partkey % 5 <> 0 AS visible, CASE WHEN l_partkey % 7 < 3 THEN 'model_proposed' ELSE 'manual' END AS origin, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 3 = 1 END AS reviewed, CASE WHEN l_partkey % 23 = 0 THEN 'behind a camera' END AS problem FROM lineitem)"
_STATES = f"""{_VIEWS}, sv AS (SELECT shot_id, frame, point, count(*) AS views, bool_or(NOT visible OR (origin = 'model_proposed' AND NOT coalesce(reviewed, false))) AS guessed, max(problem) AS problem FROM vw GROUP BY ALL)
, ss AS (SELECT shot_id, frame, point, views, CASE WHEN views < 2 OR problem IS NOT NULL THEN 'missing' WHEN guessed THEN 'inferred' ELSE 'observed' END AS state, CASE WHEN views < 2 THEN 'seen in one view only' ELSE problem END AS reason FROM sv)"""


def _states(spark, d):
    e = F.expr
    v = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shot_id"), e("l_suppkey % 3").alias("frame"), F.concat(F.lit("p"), e("l_partkey % 2").cast("string")).alias("point"), e("l_partkey % 5 <> 0").alias("visible"),
        e("CASE WHEN l_partkey % 7 < 3 THEN 'model_proposed' ELSE 'manual' END").alias("origin"), e("CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 3 = 1 END").alias("reviewed"), e("CASE WHEN l_partkey % 23 = 0 THEN 'behind a camera' END").alias("problem"))
    return S.point_states(v)


@_R.add("g7_point_states", f"WITH {_STATES} SELECT * FROM ss")
def point_states(spark, d):
    return _states(spark, d)


_GATED = f"""{_STATES}, gp AS (SELECT *, CASE WHEN frame = 0 THEN 'static_address' ELSE 'dynamic' END AS kind, CASE WHEN shot_id % 4 = 1 THEN 'unverified' ELSE 'measured' END AS frame_status, CASE WHEN state = 'missing' THEN 'not_applicable' WHEN shot_id % 5 = 0 THEN 'unknown' WHEN shot_id % 3 = 0 THEN 'exceeds' ELSE 'within' END AS timing_status FROM ss)"""


def _gated(spark, d):
    e = F.expr
    return _states(spark, d).withColumns({"kind": e("CASE WHEN frame = 0 THEN 'static_address' ELSE 'dynamic' END"), "frame_status": e("CASE WHEN shot_id % 4 = 1 THEN 'unverified' ELSE 'measured' END"),
        "timing_status": e("CASE WHEN state = 'missing' THEN 'not_applicable' WHEN shot_id % 5 = 0 THEN 'unknown' WHEN shot_id % 3 = 0 THEN 'exceeds' ELSE 'within' END")})


@_R.add("g19_trusted_points", f"""WITH {_GATED} SELECT shot_id, frame, point, CASE WHEN frame_status <> 'measured' THEN 'frame not measured' WHEN state <> 'observed' THEN 'point is ' || state WHEN kind = 'dynamic' AND timing_status = 'unknown' THEN 'timing bound unknown' WHEN kind = 'dynamic' AND timing_status <> 'within' THEN 'may move too far between the exposures' END AS problem FROM gp""")
def trusted_points(spark, d):
    return S.trusted(_gated(spark, d)).select("shot_id", "frame", "point", "problem")


@_R.add("a19_state_summary", f"""WITH {_GATED}, sp AS (SELECT *, CASE WHEN shot_id % 5 <> 0 THEN shot_id % 40 / 10.0::DOUBLE END AS bound_ms, views * 0.25::DOUBLE AS reprojection_px FROM gp)
SELECT shot_id, count(CASE WHEN state = 'observed' THEN 1 END) AS observed, count(CASE WHEN state = 'inferred' THEN 1 END) AS inferred, count(CASE WHEN state = 'missing' THEN 1 END) AS missing, 0 AS not_labelled, count(CASE WHEN timing_status = 'within' THEN 1 END) AS timing_within,
    count(CASE WHEN timing_status = 'exceeds' THEN 1 END) AS timing_exceeds, count(CASE WHEN timing_status = 'unknown' THEN 1 END) AS timing_unknown, max(bound_ms) AS max_bound_ms, max(CASE WHEN state <> 'missing' THEN reprojection_px END) AS max_reprojection_px FROM sp GROUP BY shot_id""")
def state_summary(spark, d):
    p = _gated(spark, d).withColumn("bound_ms", F.expr("CASE WHEN shot_id % 5 <> 0 THEN shot_id % 40 / CAST(10 AS DOUBLE) END")).withColumn("reprojection_px", F.col("views") * 0.25)
    return S.state_summary(p)


@_R.add("a15_timestamp_status", f"""WITH {D.SIGNAL}, pr AS (SELECT video_id, frame, t_ms, CASE WHEN video_id % 7 = 3 AND frame % 11 = 5 THEN NULL ELSE t_ms + 40 + CASE WHEN video_id % 4 = 1 THEN frame % 3 * 0.9::DOUBLE ELSE 0 END END AS probed, video_id % 9 = 4 AND frame % 6 = 1 AS estimated FROM s)
, g AS (SELECT video_id, count(*) - count(probed) AS gone, arg_min(probed, frame) AS start, count(CASE WHEN estimated THEN 1 END) AS estimated FROM pr GROUP BY video_id)
, f AS (SELECT g.*, round(max(abs(probed - start - t_ms)), 3) AS far FROM g JOIN pr ON pr.video_id = g.video_id GROUP BY ALL)
SELECT video_id, CASE WHEN estimated > 0 THEN 'estimated' WHEN gone > 0 THEN 'unverified' WHEN far > 1 THEN 'inconsistent' ELSE 'verified' END AS status, CASE WHEN gone = 0 THEN round(start, 3) END AS start_offset_ms, CASE WHEN gone = 0 THEN far END AS max_deviation_ms, estimated FROM f""")
def timestamp_status(spark, d):
    gone, late = F.expr("video_id % 7 = 3 AND frame % 11 = 5"), F.when(F.expr("video_id % 4 = 1"), F.col("frame") % 3 * 0.9).otherwise(0.0)
    s = D.signal(spark, d).withColumn("probed_ms", F.when(~gone, F.col("t_ms") + 40 + late)).withColumn("estimated", F.expr("video_id % 9 = 4 AND frame % 6 = 1"))
    return rounded(S.timestamp_status(s, 1.0), 3)


@_R.add("g2_moved_points", f"WITH {D.POSE}, q AS (SELECT video_id, frame, {x(0)} AS x, {y(0)} AS y, {z(0)} AS z FROM p) SELECT video_id, frame, round(0.6::DOUBLE * x - 0.8::DOUBLE * y + 1, 6) AS x, round(0.8::DOUBLE * x + 0.6::DOUBLE * y - 2, 6) AS y, round(z + 0.5::DOUBLE, 6) AS z, round(0.36::DOUBLE * 4 + 0.64::DOUBLE, 6) AS var_x, round(0.64::DOUBLE * 4 + 0.36::DOUBLE, 6) AS var_y, round(x, 6) AS back_x, round(y, 6) AS back_y FROM q")
def moved_points(spark, d):
    q = P.at(F.col("lm"), 0)
    t = F.array(*[F.lit(v) for v in (0.6, -0.8, 0.0, 1.0, 0.8, 0.6, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0, 1.0)])
    pts = D.pose(spark, d).select("video_id", "frame", q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"), F.array(*[F.lit(v) for v in (4.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]).alias("cov")).withColumn("t", t)
    m = S.moved(pts, F.col("t")).withColumn("back", S.inverted(F.col("t")))
    b = S.moved(m.withColumnsRenamed({"x": "mx", "y": "my", "z": "mz"}).withColumns({"x": F.col("mx"), "y": F.col("my"), "z": F.col("mz"), "var": F.col("cov")}), F.col("back"))
    return rounded(b.select("video_id", "frame", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"), F.get("var", F.lit(0)).alias("var_x"), F.get("var", F.lit(4)).alias("var_y"), F.col("x").alias("back_x"), F.col("y").alias("back_y")))


_LINE = [("shoulder", 2, 1), ("pelvis", 14, 13), ("stance", 20, 19)]
_GROUND = f"""gl AS ({" UNION ALL ".join(f"SELECT video_id * 1000 + frame AS shot_id, '{n}' AS line, video_id % 2 = 0 AS rh, {x(b)} - {x(a)} AS dx, {y(b)} - {y(a)} AS dy FROM p" for n, a, b in _LINE)})
, go AS (SELECT shot_id, line, CASE WHEN sqrt(dx * dx + dy * dy) >= 0.02::DOUBLE THEN degrees(atan2(dy, dx)) END AS yaw, CASE WHEN rh THEN 1 ELSE -1 END AS sign, CASE WHEN sqrt(dx * dx + dy * dy) >= 0.02::DOUBLE THEN degrees(sqrt((dy * dy * 0.0002::DOUBLE + dx * dx * 0.0005::DOUBLE) / ((dx * dx + dy * dy) * (dx * dx + dy * dy)))) END AS sigma FROM gl)"""


def _ground(spark, d):
    lm = F.col("lm")
    line = lambda n, a, b: F.struct(F.lit(n).alias("line"), P.at(lm, a)["x"].alias("ax"), P.at(lm, a)["y"].alias("ay"), P.at(lm, b)["x"].alias("bx"), P.at(lm, b)["y"].alias("by"))
    hand = F.when(F.col("video_id") % 2 == 0, "right").otherwise("left")
    var = {"vax": 0.0001, "vbx": 0.0001, "vay": 0.0003, "vby": 0.0002}
    e = D.pose(spark, d).select((F.col("video_id") * 1000 + F.col("frame")).alias("shot_id"), hand.alias("handedness"), F.explode(F.array(*[line(*k) for k in _LINE])).alias("l")).select("shot_id", "handedness", "l.*")
    return S.ground_lines(e.withColumns({k: F.lit(v) for k, v in var.items()}))


@_R.add("g10_ground_lines", f"WITH {D.POSE}, {_GROUND} SELECT shot_id, line, round(yaw, 5) + 0 AS yaw_deg, round(sign * yaw, 5) + 0 AS open_deg, round(sigma, 5) AS sigma_deg, CASE WHEN yaw IS NULL THEN 'too short on the ground' END AS reason FROM go")
def ground_lines(spark, d):
    return rounded(_ground(spark, d), 5)


@_R.add("g10_line_differences", f"""WITH {D.POSE}, {_GROUND} SELECT a.shot_id, a.line || '_minus_' || b.line AS key, round(a.sign * a.yaw - b.sign * b.yaw, 5) + 0 AS value, round(sqrt(a.sigma * a.sigma + b.sigma * b.sigma), 5) AS sigma_deg
FROM go a JOIN go b ON b.shot_id = a.shot_id AND (a.line, b.line) IN (('shoulder', 'pelvis'), ('shoulder', 'stance'), ('pelvis', 'stance'))""")
def line_differences(spark, d):
    return rounded(S.line_differences(_ground(spark, d), [("shoulder", "pelvis"), ("shoulder", "stance"), ("pelvis", "stance")]), 5)


@_R.add("g10_foot_flare", f"""WITH {D.POSE}, ft AS ({" UNION ALL ".join(f"SELECT video_id * 1000 + frame AS shot_id, '{r}' AS role, CASE WHEN video_id % 2 = 0 THEN 1 ELSE -1 END AS sign, {o} AS turn, {x(b)} - {x(a)} AS dx, {y(b)} - {y(a)} AS dy FROM p" for r, o, a, b in (("lead", 1, 17, 19), ("trail", -1, 18, 20)))})
, fa AS (SELECT *, degrees(atan2(dy, dx)) + 90 * sign + 180 AS a FROM ft) SELECT shot_id, role, CASE WHEN sqrt(dx * dx + dy * dy) >= 0.02::DOUBLE THEN round(sign * turn * (a - 360 * floor(a / 360) - 180), 5) + 0 END AS flare_deg FROM fa""")
def foot_flare(spark, d):
    lm, hand = F.col("lm"), F.when(F.col("video_id") % 2 == 0, "right").otherwise("left")
    foot = lambda r, a, b: F.struct(F.lit(r).alias("role"), P.at(lm, a)["x"].alias("hx"), P.at(lm, a)["y"].alias("hy"), P.at(lm, b)["x"].alias("tx"), P.at(lm, b)["y"].alias("ty"))
    feet = D.pose(spark, d).select((F.col("video_id") * 1000 + F.col("frame")).alias("shot_id"), hand.alias("handedness"), F.explode(F.array(foot("lead", 17, 19), foot("trail", 18, 20))).alias("f")).select("shot_id", "handedness", "f.*")
    return rounded(S.foot_flare(feet), 5)


_PARTS = {"clubhead_center": (0, 3), "clubhead_heel": (5, 4), "clubhead_toe": (6, 5), "shaft_butt": (7, 7), "shaft_hosel": (8, 11)}


@_R.add("g11_tracking_centres", f"""WITH {D.POSE}, pa AS (SELECT video_id AS shot_id, frame, e, frame % 3 = 1 AS own, frame % 4 <> 1 AND frame % 5 <> 1 AS pair, frame % 7 <> 1 AND frame % 11 <> 1 AS shaft FROM p WHERE frame % 3 = 1 OR frame % 4 <> 1 OR frame % 5 <> 1 OR frame % 7 <> 1 OR frame % 11 <> 1)
SELECT shot_id, frame, {", ".join(f"round(CASE WHEN own THEN {f(0)} WHEN pair THEN ({f(5)} + {f(6)}) / 2 END, 6) AS {n}" for n, f in (("x", x), ("y", y), ("z", z)))}, CASE WHEN own THEN 'clubhead_center' WHEN pair THEN 'heel-toe midpoint' END AS basis,
    CASE WHEN shaft THEN round(sqrt(power({x(8)} - {x(7)}, 2) + power({y(8)} - {y(7)}, 2) + power({z(8)} - {z(7)}, 2)), 6) END AS shaft_length_m FROM pa""")
def tracking_centres(spark, d):
    lm, f = F.col("lm"), F.col("frame")
    part = lambda n, j, m: F.when((f % m == 1) if n == "clubhead_center" else (f % m != 1), F.struct(F.lit(n).alias("part"), P.at(lm, j)["x"].alias("x"), P.at(lm, j)["y"].alias("y"), P.at(lm, j)["z"].alias("z")))
    parts = D.pose(spark, d).select(F.col("video_id").alias("shot_id"), "frame", F.explode(F.array_compact(F.array(*[part(n, *v) for n, v in _PARTS.items()]))).alias("p")).select("shot_id", "frame", "p.*")
    return rounded(S.tracking_centres(parts))
