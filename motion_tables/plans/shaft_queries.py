"""Queries of the shaft and of local refinement: a track of segments from the poses' finger tips, whole thousandths of the image, missing on frames of its own for each recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import shaft as S
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y, z

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_FOUND = "CASE video_id % 3 WHEN 0 THEN frame % 20 <> 0 WHEN 1 THEN frame % 5 = 0 ELSE frame % 9 NOT IN (3, 4) AND frame % 23 NOT BETWEEN 8 AND 13 END"
_LINES = f"""ln AS (SELECT video_id, frame, {", ".join(f"CASE WHEN {_FOUND} THEN CAST(floor({v} * 1000) AS BIGINT) END AS {n}" for v, n in ((x(7), "x1"), (y(7), "y1"), (x(8), "x2"), (y(8), "y2")))} FROM p)"""
_ANGLES = f"""{_LINES}, ow AS (SELECT video_id, frame, x1 IS NOT NULL AS found, degrees(atan2(abs(x2 - x1), abs(y2 - y1))) AS v FROM ln)
, ends AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN found THEN frame END IGNORE NULLS) OVER a AS f0, first_value(CASE WHEN found THEN frame END IGNORE NULLS) OVER b AS f1 FROM ow
    WINDOW a AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
, an AS (SELECT video_id, frame, found, CASE WHEN f0 = f1 THEN v0 ELSE coalesce(v0 + (v1 - v0) * (frame - f0) / (f1 - f0), v0, v1, 45) END AS angle FROM ends)"""
_BASE = "CASE WHEN rate > 0.9::DOUBLE THEN 0.3::DOUBLE WHEN rate < 0.3::DOUBLE THEN 0.2::DOUBLE ELSE 0.5::DOUBLE + (rate - 0.3::DOUBLE) * 0.5::DOUBLE END"


def _lines(spark, d):
    v, f = F.col("video_id"), F.col("frame")
    found = F.when(v % 3 == 0, f % 20 != 0).when(v % 3 == 1, f % 5 == 0).otherwise(~(f % 9).isin(3, 4) & ~(f % 23).between(8, 13))
    a, b = P.at(F.col("lm"), 7), P.at(F.col("lm"), 8)
    return D.pose(spark, d).select("video_id", "frame", *[F.when(found, F.floor(c * 1000).cast("long")).alias(n) for c, n in ((a["x"], "x1"), (a["y"], "y1"), (b["x"], "x2"), (b["y"], "y2"))])


_FILL = ", ".join(f"CASE WHEN {c} IS NULL AND g.f1 - g.f0 <= 4 THEN trunc(g.a[{i}] + (frame - g.f0) / (g.f1 - g.f0) * (g.b[{i}] - g.a[{i}])) ELSE {c} END AS {c}" for i, c in enumerate(S.ENDS, 1))


@_R.add("w15_smoothed_track", f"""WITH {D.POSE}, {_LINES}, g AS (SELECT *, last_value(CASE WHEN x1 IS NOT NULL THEN [x1, y1, x2, y2] END IGNORE NULLS) OVER a AS a, first_value(CASE WHEN x1 IS NOT NULL THEN [x1, y1, x2, y2] END IGNORE NULLS) OVER b AS b,
    last_value(CASE WHEN x1 IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS f0, first_value(CASE WHEN x1 IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS f1 FROM ln
    WINDOW a AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
, h AS (SELECT video_id, frame, {_FILL} FROM g)
SELECT video_id, frame, {", ".join(f"CASE WHEN {c} IS NOT NULL THEN CAST(trunc(avg({c}) OVER w) AS BIGINT) END AS {c}" for c in S.ENDS)} FROM h WINDOW w AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def smoothed_track(spark, d):
    return S.smoothed_track(_lines(spark, d))


@_R.add("a21_detection_confidence", f"WITH {D.POSE}, {_LINES}, r AS (SELECT video_id, count(*) AS frames, avg(CASE WHEN x1 IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM ln GROUP BY video_id) SELECT video_id, frames, round(rate, 6) AS rate, round({_BASE}, 6) AS confidence FROM r")
def detection_confidence(spark, d):
    return rounded(S.detection_confidence(_lines(spark, d)))


@_R.add("w26_shaft_impact", f"""WITH {D.POSE}, {_ANGLES}, tu AS (SELECT *, coalesce(abs(angle - lag(angle) OVER (PARTITION BY video_id ORDER BY frame)), 0) AS turn FROM an)
, sp AS (SELECT *, sum(turn) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS speed FROM tu)
, g AS (SELECT video_id, count(*) AS n, avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0 END) AS rate, arg_min(frame, {{'v': -round(speed, 9), 'f': frame}}) AS hit FROM sp GROUP BY video_id)
SELECT video_id, CASE WHEN n >= 10 AND rate BETWEEN 0.3::DOUBLE AND 0.9::DOUBLE AND hit >= n * 0.1::DOUBLE AND hit <= n * 0.9::DOUBLE THEN hit END AS impact FROM g""")
def shaft_impact(spark, d):
    return S.impact(_lines(spark, d))


_POS = "po AS (SELECT video_id, count(*) // 10 AS p1, count(*) // 3 AS p4, count(*) // 2 AS p6, count(*) - 1 AS p9, count(*) * 3 // 5 AS p7, count(*) AS n FROM p GROUP BY video_id)"


def _positions(spark, d):
    n = F.count("*")
    at = lambda k, m: F.floor(n * k / m).cast("long")
    return D.pose(spark, d).groupBy("video_id").agg(at(1, 10).alias("p1"), at(1, 3).alias("p4"), at(1, 2).alias("p6"), (n - 1).alias("p9"))


@_R.add("d17_shaft_refined", f"""WITH {D.POSE}, {_ANGLES}, {_POS}, j AS (SELECT an.*, p1, p4, p6, p9, frame >= p1 AND frame < p4 AS back, frame >= greatest(p4, p6 - 15) AND frame < least(p9, p6 + 15) AS near FROM an JOIN po USING (video_id))
, g AS (SELECT video_id, p1, p4, p6, p9, coalesce(min(CASE WHEN back AND angle >= 65 THEN frame END), arg_min(frame, CASE WHEN back THEN {{'v': abs(round(angle, 9) - 80), 'f': frame}} END)) AS q2,
    coalesce(arg_min(frame, CASE WHEN near THEN {{'v': round(angle, 9), 'f': frame}} END), p6) AS q6, min(CASE WHEN near THEN angle END) AS upright, avg(CASE WHEN found THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM j GROUP BY video_id, p1, p4, p6, p9)
, h AS (SELECT g.*, (SELECT min(frame) FROM an WHERE an.video_id = g.video_id AND frame > q6 + 5 AND frame < p9 AND angle >= 65) AS q7, {_BASE} * (0.5::DOUBLE + CASE WHEN upright < 45 THEN 1 - upright / 90 ELSE 0.3::DOUBLE END * 0.5::DOUBLE) AS confidence FROM g)
, k AS (SELECT *, confidence >= 0.4::DOUBLE AS ok, CASE WHEN confidence >= 0.4::DOUBLE AND q6 > p4 AND q6 < p9 THEN q6 ELSE p6 END AS r6 FROM h)
SELECT video_id, round(rate, 6) AS rate, round(confidence, 6) AS confidence, p1, CASE WHEN ok AND q2 > p1 AND q2 < p4 THEN q2 END AS p2, p4, r6 AS p6, CASE WHEN ok AND q7 > r6 AND q7 < p9 THEN q7 END AS p7, p9 FROM k""")
def shaft_refined(spark, d):
    return rounded(S.refined_positions(_lines(spark, d), _positions(spark, d)))


def _moved(j: int) -> str:
    lag = lambda c: f"lag({c}) OVER (PARTITION BY video_id ORDER BY frame)"
    return f"sqrt({' + '.join(f'power({c} - {lag(c)}, 2)' for c in (x(j), y(j), z(j)))})"


_WRISTS = f"""ve AS (SELECT video_id, frame, ({y(5)} + {y(6)}) / 2 AS height, coalesce(({_moved(5)} + {_moved(6)}) / 2 / greatest((t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY frame)) / 1000, 0.001::DOUBLE), 0) AS velocity FROM p)"""
_STEPS = [("P1", "p1", "0.8", "dtw_transfer"), ("P2", "p1 + (q4 - p1) // 3", "0.6", "interpolated"), ("P3", "p1 + (q4 - p1) * 2 // 3", "0.6", "interpolated"), ("P4", "q4", "c4", "hand_height_peak"), ("P5", "q4 + (q6 - q4) // 2", "0.6", "interpolated"), ("P6", "q6", "c6", "velocity_peak"), ("P7", "r7", "c7", "velocity_pattern"), ("P8", "q6 + (p9 - q6) * 2 // 3", "0.5", "interpolated"), ("P9", "p9", "0.7", "dtw_transfer")]


@_R.add("d15_refined_positions", f"""WITH {D.POSE}, {_WRISTS}, {_POS}, j AS (SELECT ve.*, n, p1, p4, p6, p9, frame >= p4 - 10 AND frame < p4 + 10 AS n4, frame >= p6 - 15 AND frame < p6 + 15 AS n6 FROM ve JOIN po USING (video_id))
, g AS (SELECT video_id, n, p1, p9, arg_min(frame, CASE WHEN n4 THEN {{'v': round(height, 9), 'f': frame}} END) AS q4, least(1, (avg(CASE WHEN n4 THEN height END) - min(CASE WHEN n4 THEN height END)) / 0.1::DOUBLE + 0.5::DOUBLE) AS c4,
    arg_min(frame, CASE WHEN n6 THEN {{'v': round(-velocity, 9), 'f': frame}} END) AS q6, least(1, max(CASE WHEN n6 THEN velocity END) / (avg(CASE WHEN n6 THEN velocity END) + 0.01::DOUBLE)) AS c6 FROM j GROUP BY video_id, n, p1, p9)
, h AS (SELECT g.*, arg_min(frame, CASE WHEN frame >= q6 + 5 AND frame < q6 + 20 THEN {{'v': round(-velocity, 9), 'f': frame}} END) AS q7, count(CASE WHEN frame >= q6 + 5 AND frame < q6 + 20 THEN 1 END) AS k7,
    max(CASE WHEN frame >= q6 + 5 AND frame < q6 + 20 THEN velocity END) > 1.2::DOUBLE * avg(CASE WHEN frame >= q6 + 5 AND frame < q6 + 20 THEN velocity END) AS sharp FROM g JOIN ve USING (video_id) GROUP BY ALL)
, k AS (SELECT *, CASE WHEN k7 = 0 THEN least(q6 + 10, n - 1) WHEN k7 < 3 OR sharp THEN q7 ELSE q6 + 5 + k7 // 3 END AS r7, CASE WHEN k7 = 0 THEN 0.3::DOUBLE WHEN k7 >= 3 AND sharp THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS c7 FROM h)
, r AS ({" UNION ALL ".join(f"SELECT video_id, {i} AS i, '{p}' AS p, CAST({f} AS BIGINT) AS f, CAST({c} AS DOUBLE) AS confidence, '{m}' AS method FROM k" for i, (p, f, c, m) in enumerate(_STEPS))})
SELECT video_id, p, max(f - i) OVER (PARTITION BY video_id ORDER BY i) + i AS frame, round(confidence, 6) AS confidence, method FROM r""")
def local_refinements(spark, d):
    return rounded(S.local_refinements(D.pose(spark, d), _positions(spark, d)))


@_R.add("d11_two_phase_alignment", f"""WITH {D.POSE}, c AS (SELECT video_id, count(*) AS n, count(*) // 3 + video_id AS hit FROM p GROUP BY video_id)
, q AS (SELECT u.video_id AS pair_id, u.hit AS uh, r.hit AS rh, u.n - 1 - u.hit AS ua, r.n - 1 - r.hit AS ra FROM c u JOIN c r ON r.video_id = u.video_id + 1)
SELECT pair_id, f AS user_frame, CAST(floor(f / uh * rh) AS BIGINT) AS ref_frame FROM (SELECT *, unnest(range(uh + 1)) AS f FROM q WHERE uh > 0 AND rh > 0)
UNION ALL SELECT pair_id, uh + f, rh + CAST(floor(f / ua * ra) AS BIGINT) FROM (SELECT *, unnest(range(1, ua + 1)) AS f FROM q WHERE ua > 0 AND ra > 0)""")
def two_phase(spark, d):
    from motion_tables.operators.align import two_phase as aligned

    c = D.pose(spark, d).groupBy("video_id").agg(F.count("*").alias("n")).withColumn("hit", (F.floor(F.col("n") / 3) + F.col("video_id")).cast("long"))
    side = lambda k, key: c.select(key.alias("pair_id"), F.col("n").alias(f"{k}_frames"), F.col("hit").alias(f"{k}_impact"))
    return aligned(side("u", F.col("video_id")).join(side("r", F.col("video_id") - 1), "pair_id"))
