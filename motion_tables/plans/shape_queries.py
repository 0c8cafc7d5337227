"""Queries of the column functions: names, paths, times, lengths, angles."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.functions import text as T
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y, z

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_VIEW = "CASE WHEN lower(camera) LIKE '%down the line%' OR lower(camera) LIKE '%downtheline%' OR lower(camera) LIKE '%dtl%' THEN 'dtl' WHEN lower(camera) LIKE '%face on%' OR lower(camera) LIKE '%faceon%' OR lower(camera) LIKE '%front%' THEN 'face_on' END"
PARSED = f"""{D.CAPTURES}
, n AS (SELECT path, {_STEM} AS stem FROM c)
, m AS (SELECT path, stem, regexp_matches(stem, '{T.CAPTURE}') AS ok FROM n)
, k0 AS (SELECT path, {", ".join(f"CASE WHEN ok THEN regexp_extract(stem, '{T.CAPTURE}', {i}) END AS {c}" for i, c in enumerate(("golfer", "date", "time", "camera", "id"), 1))} FROM m)
, k AS (SELECT path, golfer, date, time, camera, lower(id) AS camera_id, {_VIEW} AS view FROM k0)"""


@_R.add("sc1_parse_capture", f"WITH {PARSED} SELECT * FROM k")
def parse_capture(spark, d):
    return T.with_capture(D.captures(spark, d))


@_R.add("sc2_view_from_label", f"WITH {PARSED} SELECT view, count(*) AS n FROM k GROUP BY view")
def view_from_label(spark, d):
    return parse_capture(spark, d).groupBy("view").agg(F.count("*").alias("n"))


@_R.add("sc4_identifiers", r"""WITH v AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'com' || (p_partkey % 12) WHEN 2 THEN p_name || '.' WHEN 3 THEN replace(p_name, ' ', '/') WHEN 4 THEN '..' ELSE p_brand END AS v FROM part)
SELECT id, v, v <> '' AND NOT regexp_matches(v, '[/\\:*?"<>|\x00-\x1f]') AND v NOT IN ('.', '..') AND NOT regexp_matches(v, '[. ]$') AND NOT regexp_matches(v, '(?i)^(?:con|prn|aux|nul|(?:com|lpt)[1-9])(?:\.|$)') AS ok FROM v""")
def identifiers(spark, d):
    n = F.col("p_name")
    k = F.col("p_partkey") % 6
    v = F.when(k == 0, n).when(k == 1, F.concat(F.lit("com"), (F.col("p_partkey") % 12).cast("string"))).when(k == 2, F.concat(n, F.lit("."))).when(k == 3, F.replace(n, F.lit(" "), F.lit("/"))).when(k == 4, "..").otherwise(F.col("p_brand"))
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), v.alias("v")).withColumn("ok", T.is_identifier(F.col("v")))


@_R.add("sc5_slugs", "SELECT p_partkey AS id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)")
def slugs(spark, d):
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@_R.add("sc6_relative_paths", r"""WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '//', '') WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN 'C:' || page_id ELSE 'videos/' || page_id || '.mp4' END AS path FROM pages)
SELECT page_id, path, path <> '' AND NOT contains(path, '\') AND NOT regexp_matches(path, '^[A-Za-z]:') AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS ok FROM v""")
def relative_paths(spark, d):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    v = F.when(k == 0, F.replace("url", F.lit("//"), F.lit(""))).when(k == 1, F.concat(F.lit("a/../"), i)).when(k == 2, F.concat(F.lit("C:"), i)).otherwise(F.concat(F.lit("videos/"), i, F.lit(".mp4")))
    return D.table(spark, d, "pages").select("page_id", v.alias("path")).withColumn("ok", T.is_relative_path(F.col("path")))


@_R.add("sc7_wall_clocks", rf"""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' ELSE strftime(ts, '%Y-%m-%dT25:%M:%SZ') END AS stamp FROM events)
SELECT event_id, stamp, regexp_matches(stamp, '{T.RFC3339}') AS ok FROM v""")
def wall_clocks(spark, d):
    k, ts = F.col("event_id") % 4, F.col("ts")
    f = lambda p: F.date_format(ts, p)
    v = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, f("yyyy-MM-dd HH:mm:ss")).when(k == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(f("yyyy-MM-dd'T25':mm:ss'Z'"))
    return D.table(spark, d, "events").select("event_id", v.alias("stamp")).withColumn("ok", T.is_rfc3339(F.col("stamp")))


@_R.add("sc8_frame_times", f"WITH {D.POSITIONS} SELECT video_id, p, round(labelled * 1000 / fps, 6) AS t_ms, CAST(round_even(labelled * 1000 / fps * 30 / 1000, 0) AS BIGINT) AS frame_at_30 FROM pos")
def frame_times(spark, d):
    p = D.positions(spark, d).select("video_id", "p", T.time_of(F.col("labelled"), F.col("fps")).alias("t_ms"))
    return rounded(p.withColumn("frame_at_30", T.frame_of(F.col("t_ms"), F.lit(30.0))))


@_R.add("sc9_crops", "SELECT l_orderkey, l_linenumber, CASE WHEN f BETWEEN 10 AND 40 THEN f - 10 END AS edit_frame, CASE WHEN cx BETWEEN 0 AND 59999 THEN cx END AS edit_x, f BETWEEN 10 AND 40 AND cx BETWEEN 0 AND 59999 AS inside FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS f, round(l_extendedprice - 5000, 2) AS cx FROM lineitem)")
def crops(spark, d):
    f, cx = F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") - 5000, 2)
    window, crop = f.between(10, 40), cx.between(0, 59999)
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(window, f - 10).alias("edit_frame"), F.when(crop, cx).alias("edit_x"), (window & crop).alias("inside"))


@_R.add("sc10_lead_trail", "SELECT o_orderkey AS id, CASE WHEN (o_orderstatus = 'O') = (o_custkey % 3 <> 0) THEN 'left_' ELSE 'right_' END || 'wrist' AS joint FROM orders")
def lead_trail(spark, d):
    role = F.when(F.col("o_orderstatus") == "O", "lead").otherwise("trail")
    hand = F.when(F.col("o_custkey") % 3 != 0, "right").otherwise("left")
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), P.sided(role, F.lit("wrist"), hand).alias("joint"))


_TORSO = f"sqrt(power(({x(1)} + {x(2)}) / 2 - ({x(13)} + {x(14)}) / 2, 2) + power(({y(1)} + {y(2)}) / 2 - ({y(13)} + {y(14)}) / 2, 2))"


def _norm(*parts: str) -> str:
    return "sqrt(" + " + ".join(f"({p}) * ({p})" for p in parts) + ")"


def _mids(f) -> str:
    return f"(({f(1)} + {f(2)}) / 2 - ({f(13)} + {f(14)}) / 2)"


@_R.add("sc12_body_scale", f"WITH {D.POSE} SELECT video_id, frame, round(greatest({_TORSO}, 1e-6::DOUBLE), 6) AS scale, round(greatest({_norm(_mids(x), _mids(y), _mids(z))}, 0.01::DOUBLE), 6) AS scale_3d FROM p")
def body_scale(spark, d):
    return rounded(D.pose(spark, d).select("video_id", "frame", P.body_scale(F.col("lm")).alias("scale"), P.body_scale_3d(F.col("lm")).alias("scale_3d")))


def _angle3(a: int, b: int, c: int) -> str:
    u, v = [[f"({f(k)} - {f(b)})" for f in (x, y, z)] for k in (a, c)]
    return f"acos(least(greatest(({' + '.join(f'{p} * {q}' for p, q in zip(u, v))}) / ({_norm(*u)} * {_norm(*v)} + 1e-8::DOUBLE), -1), 1))"


@_R.add("sc13_included_angles", f"WITH {D.POSE}, q AS (SELECT video_id, frame, {x(3)} - {x(1)} AS a, {y(3)} - {y(1)} AS b, {x(3)} - {x(5)} AS c, {y(3)} - {y(5)} AS d FROM p) SELECT video_id, frame, CASE WHEN sqrt(power(a, 2) + power(b, 2)) * sqrt(power(c, 2) + power(d, 2)) > 0 THEN round(degrees(acos(least(greatest((a * c + b * d) / (sqrt(a * a + b * b) * sqrt(c * c + d * d)), -1), 1))), 4) END AS lead_elbow FROM q")
def included_angles(spark, d):
    j = lambda k: P.at(F.col("lm"), k)
    return rounded(D.pose(spark, d).select("video_id", "frame", P.included_angle(j(1), j(3), j(5)).alias("lead_elbow")), 4)


_ANGLES = {
    "spine_tilt": f"acos(least(greatest(-{_mids(y)} / ({_norm(_mids(x), _mids(y), _mids(z))} + 1e-8::DOUBLE), -1), 1))",
    "shoulder_tilt": f"atan2({y(2)} - {y(1)}, {x(2)} - {x(1)})",
    "hip_tilt": f"atan2({y(14)} - {y(13)}, {x(14)} - {x(13)})",
    "left_elbow_angle": _angle3(1, 3, 5),
    "right_elbow_angle": _angle3(2, 4, 6),
    "left_knee_angle": _angle3(13, 15, 17),
    "right_knee_angle": _angle3(14, 16, 18),
}


@_R.add("sc15_joint_angles", f"WITH {D.POSE} SELECT video_id, frame, {', '.join(f'round({v}, 5) AS {k}' for k, v in _ANGLES.items())} FROM p")
def joint_angles(spark, d):
    return rounded(D.pose(spark, d).select("video_id", "frame", *[v.alias(k) for k, v in P.angles(F.col("lm")).items()]), 5)


@_R.add("sc14_elevations", f"WITH {D.POSE} SELECT video_id, frame, round(degrees(atan2({y(1)} - {y(5)}, abs({x(5)} - {x(1)}))), 5) AS lead_arm FROM p")
def elevations(spark, d):
    return rounded(D.pose(spark, d).select("video_id", "frame", P.elevation(P.at(F.col("lm"), 1), P.at(F.col("lm"), 5)).alias("lead_arm")), 5)


@_R.add("sc16_normalized_pose", f"""WITH {D.POSE}, q AS (SELECT video_id, frame, e, greatest({_norm(_mids(x), _mids(y), _mids(z))}, 0.01::DOUBLE) AS s, ({x(13)} + {x(14)}) / 2 AS hx, ({y(13)} + {y(14)}) / 2 AS hy, ({z(13)} + {z(14)}) / 2 AS hz FROM p)
SELECT video_id, frame, j AS joint, round((e[3 * j + 1] - hx) / s, 5) + 0 AS x, round((e[3 * j + 2] - hy) / s, 5) + 0 AS y, round((e[3 * j + 3] - hz) / s, 5) + 0 AS z FROM q, (SELECT unnest(range(21)) AS j)""")
def normalized_pose(spark, d):
    n = D.pose(spark, d).select("video_id", "frame", F.posexplode(P.normalized(F.col("lm"))).alias("joint", "q"))
    return rounded(n.select("video_id", "frame", "joint", "q.*"), 5)


@_R.add("sc17_club_angle", f"WITH {D.POSE} SELECT video_id, frame, round(degrees(atan2(abs({x(8)} - {x(7)}), abs({y(8)} - {y(7)}))), 5) AS angle FROM p")
def club_angle(spark, d):
    a, b = P.at(F.col("lm"), 7), P.at(F.col("lm"), 8)
    return rounded(D.pose(spark, d).select("video_id", "frame", P.club_angle(a["x"], a["y"], b["x"], b["y"]).alias("angle")), 5)


@_R.add("sc18_shaft_parallel", f"WITH {D.POSE} SELECT video_id, frame FROM p WHERE abs(degrees(atan2(abs({x(8)} - {x(7)}), abs({y(8)} - {y(7)}))) - 80) <= 15")
def shaft_parallel(spark, d):
    a, b = P.at(F.col("lm"), 7), P.at(F.col("lm"), 8)
    return D.pose(spark, d).where(F.abs(P.club_angle(a["x"], a["y"], b["x"], b["y"]) - 80) <= 15).select("video_id", "frame")


@_R.add("sc19_lead_arm", f"WITH {D.POSE} SELECT video_id, frame, round(CASE WHEN video_id % 2 = 1 THEN {y(6)} - {y(2)} ELSE {y(5)} - {y(1)} END / greatest({_TORSO}, 1e-6::DOUBLE), 5) AS elevation FROM p")
def lead_arm(spark, d):
    hand = F.when(F.col("video_id") % 2 == 1, "left").otherwise("right")
    return rounded(D.pose(spark, d).select("video_id", "frame", P.lead_arm_elevation(F.col("lm"), hand).alias("elevation")), 5)


@_R.add("sc21_interpolated", f"WITH {D.POSE}, q AS (SELECT video_id, frame, e, lead(e) OVER (PARTITION BY video_id ORDER BY frame) AS n FROM p) SELECT video_id, frame, round({x(5)} + (n[16] - {x(5)}) * 0.25, 6) AS x, round({y(5)} + (n[17] - {y(5)}) * 0.25, 6) AS y FROM q WHERE n IS NOT NULL")
def interpolated(spark, d):
    from motion_tables.operators.windows import by

    p = D.pose(spark, d).withColumn("n", F.lead("lm").over(by())).where("n is not null")
    q = P.at(P.interpolated(F.col("lm"), F.col("n"), F.lit(0.25)), P.L_WRIST)
    return rounded(p.select("video_id", "frame", q["x"].alias("x"), q["y"].alias("y")))


@_R.add("sc22_motion_clock", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 1.0::DOUBLE WHEN l_quantity > 10 THEN round(30.0::DOUBLE / (l_quantity * 10), 6) END AS real_ms,
    CASE l_returnflag WHEN 'N' THEN ['motion time unknown'] WHEN 'A' THEN [] ELSE CASE WHEN l_quantity > 10 THEN [] ELSE ['capture rate unknown'] END END AS reasons FROM lineitem""")
def motion_clock(spark, d):
    from motion_tables.operators.catalog import reasons

    kind, q = F.col("l_returnflag"), F.col("l_quantity")
    ms = F.when(kind == "A", 1.0).when((kind == "R") & (q > 10), 30.0 / (q * 10))
    why = reasons((kind == "N", "motion time unknown"), ((kind == "R") & (q <= 10), "capture rate unknown"))
    return rounded(D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ms.alias("real_ms"), why.alias("reasons")))


@_R.add("sc25_slope_confidence", f"WITH {D.SIGNAL} SELECT video_id, frame, round(least(greatest(speed / 10 / 2, 0), 1), 6) AS confidence FROM s")
def slope_confidence(spark, d):
    return rounded(D.signal(spark, d).select("video_id", "frame", P.slope_confidence(F.col("speed") / 10).alias("confidence")))


@_R.add("sc26_wrapped_angles", f"WITH {D.SIGNAL} SELECT video_id, frame, round(((speed * 7 + 180) % 360 + 360) % 360 - 180, 6) AS angle FROM s")
def wrapped_angles(spark, d):
    return rounded(D.signal(spark, d).select("video_id", "frame", P.wrap_degrees(F.col("speed") * 7).alias("angle")))


@_R.add("sc27_storage_keys", f"WITH {D.CAPTURES} SELECT path, CASE WHEN path LIKE '/library/1/%' THEN 'user:' || substr(path, 12) ELSE path END AS key FROM c")
def storage_keys(spark, d):
    return D.captures(spark, d).select("path", T.storage_key(F.col("path"), "/library/1", "user").alias("key"))


@_R.add("sc29_in_image", f"WITH {D.POSE} SELECT video_id, frame, {x(0)} BETWEEN -0.1 AND 0.1 AND {y(0)} BETWEEN -0.1 AND 0.1 AS inside FROM p")
def in_image(spark, d):
    n = P.at(F.col("lm"), P.NOSE)
    return D.pose(spark, d).select("video_id", "frame", (n["x"].between(-0.1, 0.1) & n["y"].between(-0.1, 0.1)).alias("inside"))


@_R.add("sc30_rate_plan", """WITH r AS (SELECT o_orderkey AS id, CAST(o_custkey % 5 * 6000 + 24000 AS VARCHAR) || '/1001' AS nominal, 24.0::DOUBLE + o_orderkey % 40 AS average FROM orders)
, v AS (SELECT id, CAST(split_part(nominal, '/', 1) AS DOUBLE) / CAST(split_part(nominal, '/', 2) AS DOUBLE) AS rate, average FROM r) SELECT id, round(rate, 6) AS rate, abs(rate - average) > 1 AS variable, abs(rate - average) > 1 OR abs(rate - 60) > 1 AS normalise FROM v""")
def rate_plan(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat((F.col("o_custkey") % 5 * 6000 + 24000).cast("string"), F.lit("/1001")).alias("nominal"), (F.col("o_orderkey") % 40 + 24.0).alias("average"))
    rate = F.split_part("nominal", F.lit("/"), F.lit(1)).cast("double") / F.split_part("nominal", F.lit("/"), F.lit(2)).cast("double")
    v = o.withColumn("rate", rate).withColumn("variable", F.abs(rate - F.col("average")) > 1)
    return rounded(v.select("id", "rate", "variable", (F.col("variable") | (F.abs(F.col("rate") - 60) > 1)).alias("normalise")))
