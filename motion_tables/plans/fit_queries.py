"""Queries of fits in space: every supplier's shot is a club's head on a slanted circle, passing impact at time 0, with a size, tilt and speed of its own; every part of it comes from the supplier's row and its parts' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.operators import fits as X
from motion_tables.operators import geometry as G
from motion_tables.plans import space_queries as S
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
E = F.expr


def _samples(spark, d):
    """shot_id, t, x, y, z, sigma_m, timing_error_m: samples of 4 ms on a circle of radius r, tilted by a about the x axis, at w radians a second."""
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("shot_id"), E("1.2D + s_suppkey % 7 / 20D").alias("r"), E("radians(40D + s_suppkey % 20)").alias("a"), E("20D + s_suppkey % 5").alias("w"), F.explode(F.sequence(F.lit(-16), F.lit(16))).alias("k"))
    s = s.withColumn("t", F.col("k") * 0.004).where("not (shot_id % 11 = 3 and k between -1 and 0) and not (shot_id % 13 = 5 and k > 0)")
    turn = F.col("w") * F.col("t") - 0.2
    along = F.col("r") * (1 - F.cos(turn))
    return s.select("shot_id", "t", (F.col("r") * F.sin(turn)).alias("x"), (F.cos("a") * along).alias("y"), (F.sin("a") * along).alias("z"), F.lit(0.002).alias("sigma_m"), F.lit(0.001).alias("timing_error_m"), "r", "a", "w")


_SHOT = "SELECT s_suppkey AS shot_id, 1.2::DOUBLE + s_suppkey % 7 / 20.0::DOUBLE AS r, radians(40.0::DOUBLE + s_suppkey % 20) AS a, 20.0::DOUBLE + s_suppkey % 5 AS w, s_suppkey % 11 = 3 AS gap, s_suppkey % 13 = 5 AS cut FROM supplier"


#: The samples are as many before impact as after it, so that the quadratic's velocity is the sum of t x over that of t t.
@_R.add("g13_impact_velocity", f"""WITH q AS ({_SHOT}), k AS (SELECT *, unnest([-2, -1, 0, 1, 2]) * 0.004::DOUBLE AS t FROM q), x AS (SELECT *, r * sin(w * t - 0.2::DOUBLE) AS x, cos(a) * r * (1 - cos(w * t - 0.2::DOUBLE)) AS y, sin(a) * r * (1 - cos(w * t - 0.2::DOUBLE)) AS z FROM k)
, v AS (SELECT shot_id, gap OR cut AS few, sum(t * x) / sum(t * t) AS vx, sum(t * y) / sum(t * t) AS vy, sum(t * z) / sum(t * t) AS vz, 0.002::DOUBLE / sqrt(sum(t * t)) AS sigma, 0.001::DOUBLE * sum(abs(t)) / sum(t * t) AS bound FROM x GROUP BY shot_id, few)
, n AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed FROM v) SELECT shot_id, CASE WHEN NOT few THEN round(speed, 6) END AS speed, CASE WHEN NOT few THEN round(degrees(atan2(vy, vx)), 6) END AS path_yaw_deg, CASE WHEN NOT few THEN round(degrees(atan2(vz, sqrt(vx * vx + vy * vy))), 6) END AS attack_deg,
    CASE WHEN NOT few THEN round(sigma, 6) END AS speed_sigma, CASE WHEN NOT few THEN round(degrees(sigma / speed), 6) END AS angle_sigma_deg, CASE WHEN NOT few THEN round(bound, 6) END AS timing_bound, CASE WHEN few THEN 'needs two usable samples on each side of impact' END AS reason FROM n""")
def impact_velocity(spark, d):
    return rounded(X.impact_velocity(_samples(spark, d)))


@_R.add("g14_swing_planes", f"WITH q AS ({_SHOT}) SELECT shot_id, CASE WHEN NOT cut THEN 0.0::DOUBLE END AS direction_deg, CASE WHEN NOT cut THEN round(degrees(a), 4) END AS inclination_deg, CASE WHEN cut THEN 'needs seven usable samples that span impact' END AS reason FROM q")
def swing_planes(spark, d):
    return rounded(X.swing_planes(_samples(spark, d)).drop("rms_m"), 4)


@_R.add("g16_arc_low_points", f"WITH q AS ({_SHOT}) SELECT shot_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, round(r, 4) AS radius_m FROM q")
def arc_low_points(spark, d):
    return rounded(X.arc_low_points(_samples(spark, d)).select("shot_id", "x", "y", "z", "radius_m"), 4)


@_R.add("g9_world_frames", "SELECT s_suppkey AS shot_id, CASE WHEN s_suppkey % 9 = 1 THEN 'no ground' WHEN s_suppkey % 9 = 2 THEN 'no target line' WHEN s_suppkey % 9 = 3 THEN 'no ball' END AS reason, CASE WHEN s_suppkey % 9 NOT IN (1, 2, 3) THEN [1, 0, 0, -0.5, 0, 0, 1, -1.0 * s_suppkey, 0, -1, 0, 2, 0, 0, 0, 1]::DOUBLE[] END AS rig_to_world FROM supplier")
def world_frames(spark, d):
    """A rig whose y points down: the floor at y = 2, the ball at depth s_suppkey."""
    n = F.col("s_suppkey").cast("double")
    at = lambda *v: F.array(*[c if not isinstance(c, (int, float)) else F.lit(float(c)) for c in v])
    e = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("shot_id"), F.when(E("s_suppkey % 9 <> 1"), F.array(at(0, 2, n), at(1, 2, n), at(0, 2, n + 1), at(1, 2, n + 2))).alias("ground"), at(0, 2, n).alias("back"), F.when(E("s_suppkey % 9 <> 2"), at(2, 2, n)).otherwise(at(0.1, 2, n)).alias("front"), F.when(E("s_suppkey % 9 <> 3"), at(0.5, 1.9, n)).alias("ball"), at(0, 0, 0).alias("up"))
    w = X.world_frames(e)
    return w.select("shot_id", "reason", F.transform("rig_to_world", lambda v: F.round(v, 6) + F.lit(0.0)).alias("rig_to_world"))


@_R.add("g12_usable_samples", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'frame not measured' WHEN l_partkey % 7 = 0 THEN 'tracking centre not observed' WHEN l_suppkey % 6 = 0 THEN 'inconsistent club geometry' WHEN sqrt(greatest(0.0001::DOUBLE * (l_linenumber + 1), 0.0004::DOUBLE)) > 0.0215::DOUBLE THEN 'tracking centre uncertain' WHEN l_suppkey % 4 = 1 THEN 'point is inferred' END AS dropped FROM lineitem")
def usable_samples(spark, d):
    """The covariance is turned by 30 degrees, so that its largest variance lies along no axis."""
    l = D.table(spark, d, "lineitem")
    a, b = 0.0001 * (F.col("l_linenumber") + 1), F.lit(0.0004)
    cov = F.array(a * 0.75 + b * 0.25, (a - b) * F.lit(3**0.5 / 4), F.lit(0.0), (a - b) * F.lit(3**0.5 / 4), a * 0.25 + b * 0.75, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0001))
    s = l.select("l_orderkey", "l_linenumber", E("CASE WHEN l_partkey % 5 = 0 THEN 'unverified' ELSE 'measured' END").alias("status"), E("CASE WHEN l_partkey % 7 <> 0 THEN 1D END").alias("x"), (F.col("l_suppkey") % 6 != 0).alias("rigid"), cov.alias("cov"), E("CASE WHEN l_suppkey % 4 = 1 THEN 'point is inferred' END").alias("problem"))
    return X.usable_samples(X.largest_sigma(s), 0.0215).select("l_orderkey", "l_linenumber", "dropped")


@_R.add("g17_known_distances", f"""WITH {S._PROJECT}, se AS (SELECT point_id, count(u) AS views FROM pj GROUP BY point_id), q AS (SELECT a.point_id AS pair_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS real, va.views = 2 AND vb.views = 2 AS seen FROM pt a JOIN pt b ON b.point_id = a.point_id + 1 JOIN se va ON va.point_id = a.point_id JOIN se vb ON vb.point_id = b.point_id)
SELECT pair_id, CASE WHEN seen AND pair_id % 7 <> 2 THEN round(real, 4) END AS measured_m, seen AND pair_id % 5 <> 1 AND pair_id % 7 <> 2 AS verified, CASE WHEN NOT seen THEN 'an end without two views' WHEN pair_id % 7 = 2 THEN 'views disagree' END AS reason FROM q""")
def known_distances(spark, d):
    """Neighbours of the points, seen by the rig of two cameras: a fifth is said to be 3 cm longer than it is, a seventh has an end that the cameras see at different heights."""
    cams, points = S._cameras(spark), S._points(spark, d)
    next_ = points.select((F.col("point_id") - 1).alias("pair_id"), *[F.col(k).alias(f"n{k}") for k in "xyz"])
    both = points.withColumnRenamed("point_id", "pair_id").join(next_, "pair_id")
    length = F.sqrt(sum(((F.col(k) - F.col(f"n{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    pairs = both.select("pair_id", (length + F.when(F.col("pair_id") % 5 == 1, 0.03).otherwise(0.0)).alias("distance_m"))
    seen = G.projected(points, cams)
    ends = seen.select(F.col("point_id").alias("pair_id"), F.lit(0).alias("end"), "camera_id", "u", "v").unionByName(seen.select((F.col("point_id") - 1).alias("pair_id"), F.lit(1).alias("end"), "camera_id", "u", "v"))
    ends = ends.withColumn("v", F.col("v") + F.when(E("pair_id % 7 = 2 AND end = 1 AND camera_id = 'dtl'"), 60.0).otherwise(0.0)).join(pairs.select("pair_id"), "pair_id")
    k = X.known_distances(ends, cams, pairs, 0.01, 1.0)
    fine = F.col("verified") | ~F.array_contains("reasons", "views disagree")
    return rounded(k.select("pair_id", F.when(fine, F.col("measured_m")).alias("measured_m"), "verified", F.when(F.array_contains("reasons", "views disagree"), "views disagree").when(F.col("measured_m").isNull(), "an end without two views").alias("reason")), 4)


@_R.add("g18_measurement_documents", """SELECT o_orderkey AS shot_id, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS impact_ms, round(o_totalprice, 2) AS speed, 'too few samples' AS reason FROM orders""")
def measurement_documents(spark, d):
    """Documents of two values each, read back."""
    o = D.table(spark, d, "orders")
    row = lambda k, v, u, why: F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(0.5).alias("sigma"), F.lit(why).cast("string").alias("reason"))
    values = o.select(F.col("o_orderkey").alias("shot_id"), F.explode(F.array(row("speed", F.col("o_totalprice"), "m/s", None), row("path", F.lit(None), "deg", "too few samples"))).alias("v")).select("shot_id", "v.*")
    impacts = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("shot_id"), F.col("o_custkey").cast("double").alias("impact_ms"))
    docs = X.measurement_documents(values, impacts).select("shot_id", F.from_json("doc", "impact_ms double, values map<string, struct<value: double, status: string, reason: string>>").alias("m"))
    return rounded(docs.select("shot_id", "m.impact_ms", F.try_element_at("m.values", F.lit("speed"))["value"].alias("speed"), F.try_element_at("m.values", F.lit("path"))["reason"].alias("reason")), 2)


@_R.add("g5_stereo_gate", """WITH s AS (SELECT l_orderkey AS shot_id, count(*) AS n, list_sort(list(DISTINCT why) FILTER (why IS NOT NULL)) AS own FROM (SELECT l_orderkey, unnest([CASE WHEN l_partkey % 7 = 0 THEN 'a stream without calibration' END, CASE WHEN l_partkey % 7 <> 0 AND l_partkey % 5 = 0 THEN 'calibrated at another size' END, CASE WHEN l_suppkey % 9 = 0 THEN 'a stream without labels' END, CASE WHEN l_suppkey % 9 = 1 THEN 'labelled on other bytes' END]) AS why FROM lineitem) GROUP BY l_orderkey)
SELECT o_orderkey AS shot_id, list_filter([CASE WHEN coalesce(n, 0) < 8 THEN 'one view' END, CASE WHEN o_custkey % 4 = 0 OR o_custkey % 5 = 0 THEN 'same swing not documented' END], lambda v: v IS NOT NULL) || coalesce(own, []) AS reasons FROM orders LEFT JOIN s ON shot_id = o_orderkey""")
def stereo_gate(spark, d):
    shots = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("shot_id"), E("CASE WHEN o_custkey % 4 = 0 THEN 'unknown' ELSE 'verified' END").alias("same_status"), E("CASE WHEN o_custkey % 5 <> 0 THEN 'flash' END").alias("same_method"))
    streams = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shot_id"), F.col("l_linenumber").alias("stream_id"), E("l_partkey % 7 <> 0").alias("calibrated"), E("CASE WHEN l_partkey % 5 = 0 THEN 640 ELSE 1920 END").alias("cal_width"), F.lit(1080).alias("cal_height"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), E("CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_suppkey % 9 = 1 THEN 'x' ELSE 'h' END").alias("labelled_sha"), F.lit("h").alias("sha"))
    return X.stereo_gate(shots, streams)
