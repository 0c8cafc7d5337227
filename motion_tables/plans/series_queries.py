"""Queries of the per-recording series and of detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import detect as X
from motion_tables.operators import windows as W
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y, z

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
_BY = "OVER (PARTITION BY video_id ORDER BY frame)"
_HANDS = f"h AS (SELECT video_id, frame, t_ms, e, ({x(5)} + {x(6)}) / 2 AS mx, ({y(5)} + {y(6)}) / 2 AS my, greatest(sqrt(power(({x(1)} + {x(2)}) / 2 - ({x(13)} + {x(14)}) / 2, 2) + power(({y(1)} + {y(2)}) / 2 - ({y(13)} + {y(14)}) / 2, 2)), 1e-6::DOUBLE) AS scale FROM p)"
_HAND_SPEED = f"""{_HANDS}
, hs0 AS (SELECT video_id, frame, t_ms, e, sqrt(power(mx - lag(mx) {_BY}, 2) + power(my - lag(my) {_BY}, 2)) / scale / ((t_ms - lag(t_ms) {_BY}) / 1000) AS v FROM h)
, hs AS (SELECT video_id, frame, t_ms, e, CASE WHEN frame = 0 THEN coalesce(lead(v) {_BY}, 0) ELSE v END AS hand_speed FROM hs0)"""


@_R.add("w1_wrist_speed", f"WITH {D.POSE}, {_HANDS} SELECT video_id, frame, round(coalesce(sqrt(power(mx - lag(mx) {_BY}, 2) + power(my - lag(my) {_BY}, 2)) / (greatest(t_ms - lag(t_ms) {_BY}, 1) / 1000), 0), 5) AS speed FROM h")
def wrist_speed(spark, d):
    return rounded(W.wrist_speed(D.pose(spark, d)).select("video_id", "frame", "speed"), 5)


@_R.add("w2_hand_speed", f"WITH {D.POSE}, {_HAND_SPEED} SELECT video_id, frame, round(hand_speed, 4) AS hand_speed FROM hs")
def hand_speed(spark, d):
    return rounded(W.hand_speed(D.pose(spark, d)).select("video_id", "frame", "hand_speed"), 4)


@_R.add("w3_carried_forward", f"WITH {D.POSE} SELECT video_id, frame, NOT coalesce(e[1:63] = lag(e[1:63]) {_BY}, false) AS valid FROM p")
def carried_forward(spark, d):
    return W.carried_forward(D.pose(spark, d)).select("video_id", "frame", "valid")


_FRAME = "OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"


@_R.add("w4_moving_average", f"WITH {D.SIGNAL} SELECT video_id, frame, round(sum(speed) {_FRAME.format(2)} / 5, 6) AS of_5, round(sum(speed) {_FRAME.format(3)} / 7, 6) AS of_7 FROM s")
def moving_average(spark, d):
    s = W.moving_average(W.moving_average(D.signal(spark, d), "speed", 5, "of_5"), "speed", 7, "of_7")
    return rounded(s.select("video_id", "frame", "of_5", "of_7"))


_SG = [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6], [-4, 6, 12, 14, 12, 6, -4]]


def _fit(row: int, name: str) -> str:
    return "(" + " + ".join(f"({c}) * {name}[{k + 1}]" for k, c in enumerate(_SG[row])) + ") / 42"


@_R.add("w7_savitzky_golay", f"""WITH {D.SIGNAL}, q AS (SELECT video_id, frame, speed, count(*) OVER (PARTITION BY video_id) AS n, list(speed) {_FRAME.format(3)} AS near, list(speed) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM s)
SELECT video_id, frame, round(CASE WHEN n < 7 THEN speed {" ".join(f"WHEN frame = {i} THEN {_fit(i, 'every')} WHEN frame = n - {i + 1} THEN {_fit(i, 'list_reverse(every)')}" for i in range(3))} ELSE {_fit(3, 'near')} END, 6) AS smooth FROM q""")
def savitzky_golay(spark, d):
    return rounded(W.savgol7(D.signal(spark, d), "speed", "smooth").select("video_id", "frame", "smooth"))


def _step3(j: int) -> str:
    return "sqrt(" + " + ".join(f"power({f(j)} - lag({f(j)}) {_BY}, 2)" for f in (x, y, z)) + ")"


@_R.add("w8_wrist_velocity", f"WITH {D.POSE} SELECT video_id, frame, round(coalesce(({_step3(5)} + {_step3(6)}) / 2 / greatest((t_ms - lag(t_ms) {_BY}) / 1000, 0.001), 0), 5) AS velocity FROM p")
def wrist_velocity(spark, d):
    return rounded(W.wrist_velocity(D.pose(spark, d)).select("video_id", "frame", "velocity"), 5)


@_R.add("w9_frame_deltas", f"WITH {D.SIGNAL} SELECT video_id, frame, coalesce(least(greatest(raw_ms - lag(raw_ms) {_BY}, 0.1::DOUBLE), 100), 0) AS delta_ms FROM s")
def frame_deltas(spark, d):
    return W.frame_deltas(D.signal(spark, d), "raw_ms").select("video_id", "frame", "delta_ms")


_SMOOTH = f"sm AS (SELECT video_id, frame, t_ms, sum(speed) {_FRAME.format(2)} / 5 AS v FROM s)"
_BASE = f"""{_SMOOTH}
, b0 AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, min(CASE WHEN t_ms > 1000 THEN frame END) OVER (PARTITION BY video_id) AS late FROM sm)
, b1 AS (SELECT *, frame < greatest(10, least(greatest(coalesce(late, n), 1), n // 3)) AS early FROM b0)
, b2 AS (SELECT video_id, median(v) AS med FROM b1 WHERE early GROUP BY video_id)
, b3 AS (SELECT b1.video_id, any_value(med) AS med, greatest(median(abs(v - med)), 0.001::DOUBLE) AS mad FROM b1 JOIN b2 USING (video_id) WHERE early GROUP BY b1.video_id)"""
_BURSTS = f"""{_BASE}
, m0 AS (SELECT b1.video_id, frame, t_ms, v, n, med, mad, CASE WHEN v > med + 3 * mad THEN 1 WHEN v < med + 1.5::DOUBLE * mad THEN 0 END AS mark FROM b1 JOIN b3 USING (video_id))
, m1 AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS on_ FROM m0)
, m2 AS (SELECT *, CASE WHEN on_ = 1 AND coalesce(lag(on_) {_BY}, 0) = 0 THEN 1 ELSE 0 END AS new_ FROM m1)
, m3 AS (SELECT *, sum(new_) {_BY} AS id, lead(t_ms) {_BY} AS next_t FROM m2)
, m4 AS (SELECT video_id, id, min(frame) AS start, max(frame) AS last_, max(v) AS peak, min(t_ms) AS t_start, max(t_ms) AS t_last, arg_max(coalesce(next_t, t_ms), frame) AS t_end, any_value(med) AS med, any_value(mad) AS mad, any_value(n) AS n FROM m3 WHERE on_ = 1 GROUP BY video_id, id)
, m5 AS (SELECT *, CASE WHEN last_ < n - 1 THEN last_ + 1 ELSE last_ END AS end_, last_ < n - 1 AS closed FROM m4)
, bu AS (SELECT * FROM m5 WHERE CASE WHEN closed THEN end_ - start ELSE n - start END >= 5)"""
_MAIN = f"""{_BURSTS}
, sc AS (SELECT *, CASE WHEN t_end - t_start BETWEEN 500 AND 2000 THEN 1.0::DOUBLE WHEN t_end - t_start BETWEEN 300 AND 3000 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * 0.4::DOUBLE + least(peak / 0.1::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + least((end_ - start) / 100, 1.0::DOUBLE) * 0.2::DOUBLE AS score FROM bu)
, mb AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start DESC, end_ DESC, peak DESC) = 1)"""
_WINDOW = f"""{_MAIN}
, sw AS (SELECT mb.video_id, CAST(coalesce(arg_min(CASE WHEN frame < start AND (frame = start - 1 OR t_start - sm.t_ms <= 500) THEN frame END, CASE WHEN frame < start AND (frame = start - 1 OR t_start - sm.t_ms <= 500) THEN {{'v': v, 'f': frame}} END), greatest(0, start - 5)) AS INTEGER) AS start_frame,
    start AS takeaway_frame, arg_max(CASE WHEN frame BETWEEN start AND end_ THEN frame END, CASE WHEN frame BETWEEN start AND end_ THEN {{'v': v, 'f': -frame}} END) AS impact_frame, end_ AS end_frame, least((peak - med) / mad / 10, 1) AS confidence
    FROM mb JOIN sm USING (video_id) WHERE n >= 30 GROUP BY mb.video_id, start, end_, peak, med, mad)"""


@_R.add("a13_baseline", f"WITH {D.SIGNAL}, {_BASE} SELECT video_id, round(med, 6) AS median, round(mad, 6) AS mad FROM b3")
def baseline(spark, d):
    s = X.baseline(W.moving_average(D.signal(spark, d), "speed", 5, "smooth"), "smooth")
    return rounded(s.groupBy("video_id").agg(F.first("median").alias("median"), F.first("mad").alias("mad")))


@_R.add("w11_motion_bursts", f"WITH {D.SIGNAL}, {_BURSTS} SELECT video_id, start AS first_frame, end_ AS last_frame, round(peak, 6) AS peak FROM bu")
def motion_bursts(spark, d):
    s = X.baseline(W.moving_average(D.signal(spark, d), "speed", 5, "smooth"), "smooth")
    return rounded(X.bursts(s, "smooth").select("video_id", F.col("start").alias("first_frame"), F.col("end").alias("last_frame"), "peak"))


@_R.add("d1_main_burst", f"WITH {D.SIGNAL}, {_MAIN} SELECT video_id, start AS first_frame, end_ AS last_frame, round(score, 6) AS score FROM mb")
def main_burst(spark, d):
    s = X.baseline(W.moving_average(D.signal(spark, d), "speed", 5, "smooth"), "smooth")
    return rounded(X.main_burst(X.bursts(s, "smooth")).select("video_id", F.col("start").alias("first_frame"), F.col("end").alias("last_frame"), "score"))


@_R.add("d3_swing_window", f"WITH {D.SIGNAL}, {_WINDOW} SELECT video_id, start_frame, takeaway_frame, impact_frame, end_frame, round(confidence, 6) AS confidence FROM sw")
def swing_window(spark, d):
    return rounded(X.swing_window(D.signal(spark, d)))


@_R.add("d5_kinematic_positions", f"""WITH {D.SIGNAL}, {_WINDOW}
, k0 AS (SELECT s.video_id, s.frame, speed AS v, start_frame, takeaway_frame, end_frame FROM s JOIN sw USING (video_id))
, k1 AS (SELECT video_id, arg_max(frame, {{'v': v, 'f': -frame}}) AS impact, median(v) AS typical, max(v) AS fast FROM k0 WHERE frame BETWEEN takeaway_frame AND end_frame GROUP BY video_id)
, k2 AS (SELECT k0.video_id, impact, typical, fast, start_frame, end_frame, max(CASE WHEN frame = start_frame THEN v END) AS at_start, max(CASE WHEN frame = end_frame THEN v END) AS at_end,
    arg_min(CASE WHEN frame > takeaway_frame AND frame < impact THEN frame END, CASE WHEN frame > takeaway_frame AND frame < impact THEN {{'v': v, 'f': frame}} END) AS top, min(CASE WHEN frame > takeaway_frame AND frame < impact THEN v END) AS slow, max(CASE WHEN frame BETWEEN takeaway_frame AND impact THEN v END) AS around
    FROM k0 JOIN k1 USING (video_id) GROUP BY k0.video_id, impact, typical, fast, start_frame, end_frame)
, k3 AS (SELECT video_id, 'P1' AS p, start_frame AS frame, CASE WHEN fast > 0 THEN least(greatest((fast - at_start) / fast, 0), 1) ELSE 0 END AS c FROM k2 UNION ALL SELECT video_id, 'P4', top, CASE WHEN around > 0 THEN least(greatest((around - slow) / around, 0), 1) ELSE 0 END FROM k2
    UNION ALL SELECT video_id, 'P7', impact, CASE WHEN fast > 0 THEN least(greatest((fast - typical) / fast, 0), 1) ELSE 0 END FROM k2 UNION ALL SELECT video_id, 'P10', end_frame, CASE WHEN fast > 0 THEN least(greatest((fast - at_end) / fast, 0), 1) ELSE 0 END FROM k2)
SELECT video_id, p, frame, round(c, 6) AS confidence FROM k3 WHERE frame IS NOT NULL""")
def kinematic_positions(spark, d):
    s = D.signal(spark, d)
    return rounded(X.kinematic(s.select("video_id", "frame", F.col("speed").alias("hand_speed"), F.lit(True).alias("valid")), X.swing_window(s)))


def _arm_signal(spark, d):
    s = W.hand_speed(D.pose(spark, d))
    return s.withColumn("elevation", P.lead_arm_elevation(F.col("lm"), F.lit("right")))


_CROSS = f"""{_HAND_SPEED}
, el AS (SELECT video_id, frame, t_ms, hand_speed, ({y(5)} - {y(1)}) / greatest(sqrt(power(({x(1)} + {x(2)}) / 2 - ({x(13)} + {x(14)}) / 2, 2) + power(({y(1)} + {y(2)}) / 2 - ({y(13)} + {y(14)}) / 2, 2)), 1e-6::DOUBLE) AS v1 FROM hs)
, c0 AS (SELECT video_id, frame, t_ms AS t1, v1, lag(t_ms) {_BY} AS t0, lag(v1) {_BY} AS v0 FROM el)
, cr AS (SELECT video_id, frame, t0 + v0 / (v0 - v1) * (t1 - t0) AS t_ms, CASE WHEN v0 / (v0 - v1) >= 0.5 THEN frame ELSE frame - 1 END AS nearest, abs(v1 - v0) / ((t1 - t0) / 1000) AS slope FROM c0 WHERE (v0 > 0) <> (v1 > 0))"""


@_R.add("w13_crossings", f"WITH {D.POSE}, {_CROSS} SELECT video_id, frame, round(t_ms, 4) AS t_ms, nearest, round(slope, 3) AS slope FROM cr")
def crossings(spark, d):
    c = W.crossings(_arm_signal(spark, d), "elevation", "valid")
    return rounded(rounded(c, 4, but=("slope",)), 3, but=("t_ms",))


@_R.add("w14_first_last_crossing", f"WITH {D.POSE}, {_CROSS} SELECT video_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM cr WHERE slope >= 0.15 GROUP BY video_id")
def first_last_crossing(spark, d):
    c = W.crossings(_arm_signal(spark, d), "elevation", "valid").where(F.col("slope") >= X.SLOPE)
    return c.groupBy("video_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))


_ANCHORS = "an AS (SELECT video_id, n // 10 AS p1, 4 * n // 10 AS p4, 7 * n // 10 AS p7, 9 * n // 10 AS p10, (hi - lo) / nullif(n - 1, 0) AS step FROM (SELECT video_id, count(*) AS n, max(t_ms) AS hi, min(t_ms) AS lo FROM el GROUP BY video_id))"


@_R.add("d6_lead_arm_positions", f"""WITH {D.POSE}, {_CROSS}, {_ANCHORS}
, g AS (SELECT *, CASE WHEN step > 0 THEN greatest(1, CAST(round_even(40 / step, 0) AS INTEGER)) ELSE 0 END AS g FROM an)
, sp AS (SELECT video_id, 'P3' AS p, p1 AS lo, p4 - g AS hi, true AS l FROM g UNION ALL SELECT video_id, 'P5', p4 + g, p7 - g, false FROM g UNION ALL SELECT video_id, 'P9', p7 + g, p10, false FROM g)
SELECT video_id, p, nearest AS frame, round(t_ms, 4) AS t_ms, round(least(slope / 2, 1), 5) AS confidence FROM cr JOIN sp USING (video_id) WHERE hi > lo AND frame > lo AND frame <= hi AND slope >= 0.15
QUALIFY row_number() OVER (PARTITION BY video_id, p ORDER BY CASE WHEN l THEN -frame ELSE frame END) = 1""")
def lead_arm_positions(spark, d):
    s = _arm_signal(spark, d)
    n = s.groupBy("video_id").agg(F.count("*").alias("n"))
    at = lambda k: F.floor(F.col("n") * k / 10).cast("int")
    kin = n.select("video_id", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), at(k).alias("frame")) for p, k in (("P1", 1), ("P4", 4), ("P7", 7), ("P10", 9))])).alias("k")).select("video_id", "k.*")
    return rounded(rounded(X.lead_arm(s, kin), 4, but=("confidence",)), 5, but=("t_ms",))


@_R.add("d9_impact_by_wrists", f"""WITH {D.POSE}, v AS (SELECT video_id, frame, coalesce(sqrt(power({x(5)} - lag({x(5)}) {_BY}, 2) + power({y(5)} - lag({y(5)}) {_BY}, 2)) + sqrt(power({x(6)} - lag({x(6)}) {_BY}, 2) + power({y(6)} - lag({y(6)}) {_BY}, 2)), 0) AS v FROM p)
, q AS (SELECT video_id, frame, round(sum(v) {_FRAME.format(2)} / 5, 9) AS v FROM v) SELECT video_id, arg_max(frame, {{'v': v, 'f': -frame}}) AS impact FROM q GROUP BY video_id""")
def impact_by_wrists(spark, d):
    return X.impact_by_wrists(D.pose(spark, d))


@_R.add("d18_p1_p4_p7", f"""WITH {D.SIGNAL}, h AS (SELECT *, abs(speed - 20) AS height FROM s), g AS (SELECT video_id, arg_min(frame, {{'h': height, 'f': frame}}) AS p4, arg_min(t_ms, {{'h': height, 'f': frame}}) AS t4 FROM h GROUP BY video_id)
, j AS (SELECT h.*, p4, t4, max(CASE WHEN frame >= p4 AND t_ms <= t4 + 900 THEN speed END) OVER (PARTITION BY video_id) AS fast FROM h JOIN g USING (video_id))
SELECT video_id, arg_min(CASE WHEN frame <= p4 THEN frame END, CASE WHEN frame <= p4 THEN {{'v': speed, 'f': frame}} END) AS p1, p4, min(CASE WHEN frame >= p4 AND t_ms <= t4 + 900 AND speed >= fast * 0.95::DOUBLE THEN frame END) AS p7 FROM j GROUP BY video_id, p4""")
def p1_p4_p7(spark, d):
    return X.pick_p1_p4_p7(D.signal(spark, d).withColumn("height", F.abs(F.col("speed") - 20)), "height")


_GAPPY = "gp AS (SELECT video_id, frame, t_ms, CASE WHEN frame % 5 IN (1, 2) OR video_id % 13 = 0 THEN NULL ELSE speed END AS v FROM s)"


@_R.add("w16_filled", f"""WITH {D.SIGNAL}, {_GAPPY}, q AS (SELECT video_id, frame, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f0, first_value(CASE WHEN v IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f1 FROM gp
    WINDOW a AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT video_id, frame, round(CASE WHEN f0 = f1 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (frame - f0) / (f1 - f0), v0, v1, 45) END, 6) AS value FROM q""")
def filled(spark, d):
    gone = (F.col("frame") % 5).isin(1, 2) | (F.col("video_id") % 13 == 0)
    s = D.signal(spark, d).withColumn("v", F.when(~gone, F.col("speed")))
    return rounded(W.filled(s, "v", "value").select("video_id", "frame", "value"))


@_R.add("w17_resampled", f"""WITH {D.SIGNAL}, q AS (SELECT video_id, frame, t_ms - min(t_ms) OVER (PARTITION BY video_id) AS t0, speed AS v0 FROM s), r AS (SELECT *, lead(t0) {_BY} AS t1, lead(v0) {_BY} AS v1 FROM q)
, n AS (SELECT video_id, max(t0) AS total, CAST(floor(max(t0) / (1000.0::DOUBLE / 50)) AS BIGINT) + 1 AS n FROM q GROUP BY video_id), k AS (SELECT video_id, n, total, unnest(range(n)) AS step FROM n), g AS (SELECT video_id, step, step * CASE WHEN n > 1 THEN total / (n - 1) ELSE 0 END AS t FROM k)
SELECT g.video_id, step, round(t, 3) AS t_ms, round(CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 3) AS value FROM g JOIN r ON r.video_id = g.video_id AND g.t >= r.t0 - 1e-6::DOUBLE AND (r.t1 IS NULL OR g.t < r.t1 - 1e-6::DOUBLE)""")
def resampled(spark, d):
    return rounded(W.resampled(D.signal(spark, d), "speed", 50.0), 3)


@_R.add("w12_active_segments", f"WITH {D.SIGNAL}, q AS (SELECT *, speed > 15 AS a, frame - row_number() OVER (PARTITION BY video_id, speed > 15 ORDER BY frame) AS k FROM s) SELECT video_id, min(frame) AS first_frame, max(frame) AS last_frame, max(speed) AS peak FROM q WHERE a GROUP BY video_id, k")
def active_segments(spark, d):
    return W.active_segments(D.signal(spark, d), 15.0).select("video_id", F.col("start").alias("first_frame"), F.col("end").alias("last_frame"), "peak")


@_R.add("w19_settle_frame", f"""WITH {D.SIGNAL}, sm AS (SELECT video_id, frame, sum(speed) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS speed FROM s), c AS (SELECT video_id, quantile_cont(speed, 0.3) * 1.5::DOUBLE AS calm FROM sm GROUP BY video_id)
, q AS (SELECT video_id, frame, max(speed) OVER w AS most, count(*) OVER w AS n FROM sm WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT video_id, min(CASE WHEN n = 5 AND most < calm THEN frame END) AS settled FROM q JOIN c USING (video_id) GROUP BY video_id""")
def settle_frame(spark, d):
    return W.settle_frame(W.moving_average(D.signal(spark, d), "speed", 5, "smooth"), "smooth")


_CAM = "OVER (PARTITION BY session_id, camera_id ORDER BY sequence)"


@_R.add("w20_sequence_gaps", f"WITH {D.FRAMES}, q AS (SELECT session_id, camera_id, lag(ts_ns) {_CAM} AS start_ns, ts_ns AS end_ns, sequence - lag(sequence) {_CAM} - 1 AS missing, row_number() {_CAM} - 2 AS after_index FROM f) SELECT * FROM q WHERE missing > 0")
def sequence_gaps(spark, d):
    return W.sequence_gaps(D.frames(spark, d))


@_R.add("w21_order_violations", f"""WITH {D.FRAMES}, q AS (SELECT *, sequence * 7919 % 10007 AS arrival FROM f), r AS (SELECT session_id, camera_id, sequence, ts_ns - lag(ts_ns) OVER w AS dt, sequence - lag(sequence) OVER w AS ds FROM q WINDOW w AS (PARTITION BY session_id, camera_id ORDER BY arrival, sequence))
, v AS (SELECT session_id, camera_id, sequence, CASE WHEN dt = 0 THEN 'duplicate timestamp' WHEN dt < 0 THEN 'backward timestamp' WHEN ds <= 0 THEN 'sequence does not increase' END AS rule FROM r) SELECT * FROM v WHERE rule IS NOT NULL""")
def order_violations(spark, d):
    f = D.frames(spark, d).withColumn("arrival", F.struct(F.col("sequence") * 7919 % 10007, "sequence"))
    return W.order_violations(f).select("session_id", "camera_id", "sequence", "rule")


@_R.add("w22_retained", f"""WITH {D.FRAMES}, q AS (SELECT *, max(ts_ns) OVER (PARTITION BY session_id, camera_id) - ts_ns AS age, sum(bytes) OVER w AS total, count(*) OVER w AS k FROM f WINDOW w AS (PARTITION BY session_id, camera_id ORDER BY ts_ns DESC, sequence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, camera_id, sequence, ts_ns FROM q WHERE k = 1 OR (age <= 600000000000000 AND total <= 20000)""")
def retained(spark, d):
    return W.retained(D.frames(spark, d), 600_000 * 10**9, 20_000).select("session_id", "camera_id", "sequence", "ts_ns")


@_R.add("w25_position_order", f"WITH {D.POSITIONS}, q AS (SELECT video_id, p, predicted, lag(predicted) OVER (PARTITION BY video_id ORDER BY CAST(substr(p, 2) AS INTEGER)) AS before FROM pos) SELECT * FROM q WHERE predicted < before")
def position_order(spark, d):
    return W.position_order_warnings(D.positions(spark, d))


@_R.add("d25_blind_frames", f"WITH {D.POSE}, q AS (SELECT video_id, frame, frame = 12 AS is_p1, sha1_hex FROM (SELECT video_id, frame, md5('f' || video_id || '-' || frame) AS sha1_hex FROM p)) SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY is_p1 DESC, sha1('blind' || sha1_hex), frame) AS rank FROM q QUALIFY rank <= 3")
def blind_frames(spark, d):
    digest = F.md5(F.concat(F.lit("f"), F.col("video_id").cast("string"), F.lit("-"), F.col("frame").cast("string")))
    f = D.pose(spark, d).select("video_id", "frame", (F.col("frame") == 12).alias("is_p1"), digest.alias("digest"))
    return X.blind_frames(f).where("blind").select("video_id", "frame", "rank")


@_R.add("d28_sequence_frames", f"WITH {D.SIGNAL}, n AS (SELECT video_id, count(*) AS n FROM s GROUP BY video_id), k AS (SELECT video_id, unnest(range(10, n, 4)) AS frame FROM n) SELECT k.* FROM k ANTI JOIN (SELECT video_id, frame FROM s WHERE speed > 10) u ON u.video_id = k.video_id AND u.frame = k.frame")
def sequence_frames(spark, d):
    s = D.signal(spark, d)
    k = s.groupBy("video_id").agg(F.count("*").alias("n")).where("n > 10").select("video_id", F.explode(F.sequence(F.lit(10).cast("long"), F.col("n") - 1, F.lit(4).cast("long"))).alias("frame"))
    return k.join(s.where("speed > 10").select("video_id", F.col("frame").cast("long").alias("frame")), ["video_id", "frame"], "left_anti")
