"""Queries of label sets: points in pixels of a thousand, both backends, scales from the first position."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import label_sets as L
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_SCALES = f"sc AS (SELECT video_id, 1000 * sqrt(power(({x(1)} + {x(2)} - {x(13)} - {x(14)}) / 2, 2) + power(({y(1)} + {y(2)} - {y(13)} - {y(14)}) / 2, 2)) AS scale FROM p WHERE frame = 0)"
_PTS = f"{D.POINTS}, {_SCALES}, pv AS (SELECT backend, video_id, frame, joint, x * 1000 AS x, (y + CASE WHEN backend = 'b' THEN frame % 7 * 0.01::DOUBLE ELSE 0 END) * 1000 AS y, detected AND conf >= min_conf AND (frame + joint) % 19 <> 2 AS valid FROM pts)"


def _points(spark, d):
    p = D.points(spark, d)
    off = F.when(F.col("backend") == "b", F.col("frame") % 7 * 0.01).otherwise(0.0)
    return p.select("backend", "video_id", "frame", "joint", (F.col("x") * 1000).alias("x"), ((F.col("y") + off) * 1000).alias("y"), (F.col("detected") & (F.col("conf") >= F.col("min_conf")) & ((F.col("frame") + F.col("joint")) % 19 != 2)).alias("valid"))


def _scales(spark, d):
    lm = F.col("lm")
    return D.pose(spark, d).where("frame = 0").select("video_id", (1000 * F.hypot(*[P.mid(P.at(lm, P.L_SHOULDER), P.at(lm, P.R_SHOULDER), k) - P.mid(P.at(lm, P.L_HIP), P.at(lm, P.R_HIP), k) for k in "xy"])).alias("scale"))


@_R.add("d27_proposals", f"""WITH {_PTS}, a AS (SELECT video_id, frame, joint, round(x, 1) AS x, round(y, 1) AS y FROM pv WHERE backend = 'a' AND valid AND frame % 3 = 0), b AS (SELECT video_id, frame, joint, round(x, 1) AS x, round(y, 1) AS y FROM pv WHERE backend = 'b' AND valid AND frame % 3 = 0)
SELECT video_id, frame, joint, a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / scale, 3) AS disagree FROM a FULL JOIN b USING (video_id, frame, joint) LEFT JOIN sc USING (video_id)""")
def proposals(spark, d):
    return L.proposals(_points(spark, d).where("frame % 3 = 0"), _scales(spark, d))


_FAR = "list_min(list_transform(taken, lambda t: abs(frame - t))) >= {gap} OR len(taken) = 0"
_PICK = "(SELECT arg_min(frame, {{'v': -round(apart, 9), 'f': frame}}) FROM ap WHERE ap.video_id = {h}.video_id AND frame >= low AND frame < high AND (" + _FAR.format(gap="gap") + "))"


@_R.add("d24_picked_frames", f"""WITH {_PTS}, ap AS (SELECT a.video_id, a.frame, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) / any_value(scale) AS apart FROM pv a JOIN pv b ON b.video_id = a.video_id AND b.frame = a.frame AND b.joint = a.joint JOIN sc ON sc.video_id = a.video_id WHERE a.backend = 'a' AND b.backend = 'b' AND a.valid AND b.valid GROUP BY a.video_id, a.frame)
, wi AS (SELECT video_id, count(*) // 10 AS low, count(*) * 9 // 10 AS high FROM p GROUP BY video_id), an AS (SELECT video_id, unnest(CASE video_id % 3 WHEN 0 THEN ['P1', 'P7'] WHEN 1 THEN ['P1'] ELSE [] END) AS p, unnest(CASE video_id % 3 WHEN 0 THEN [5, 20] WHEN 1 THEN [5] ELSE [] END) AS frame FROM wi)
, h0 AS (SELECT wi.*, greatest(5, (high - low) // 10) AS gap, coalesce((SELECT list(frame) FROM an WHERE an.video_id = wi.video_id), []) AS taken FROM wi), h1 AS (SELECT *, {_PICK.replace('{{', '{').replace('}}', '}').replace('{h}', 'h0')} AS f1 FROM h0)
, g1 AS (SELECT video_id, low, high, gap, f1, CASE WHEN f1 IS NULL THEN taken ELSE list_append(taken, f1) END AS taken FROM h1), h2 AS (SELECT *, {_PICK.replace('{{', '{').replace('}}', '}').replace('{h}', 'g1')} AS f2 FROM g1), g2 AS (SELECT video_id, low, high, f1, f2, CASE WHEN f2 IS NULL THEN taken ELSE list_append(taken, f2) END AS taken FROM h2)
, sp AS (SELECT video_id, frame, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS speed FROM pv WHERE backend = 'a' AND joint = 6 WINDOW w AS (PARTITION BY video_id ORDER BY frame)), fa AS (SELECT g2.video_id, taken, arg_min(frame, {{'v': -round(speed, 9), 'f': frame}}) AS frame FROM g2 JOIN sp ON sp.video_id = g2.video_id AND frame >= low AND frame < high AND speed IS NOT NULL WHERE g2.video_id % 3 <> 0 GROUP BY g2.video_id, taken)
SELECT video_id, frame, p AS why FROM an UNION ALL SELECT video_id, f1, 'backends disagree' FROM g2 WHERE f1 IS NOT NULL UNION ALL SELECT video_id, f2, 'backends disagree' FROM g2 WHERE f2 IS NOT NULL UNION ALL SELECT video_id, frame, 'fastest' FROM fa WHERE {_FAR.format(gap='3')}""")
def picked_frames(spark, d):
    pts = _points(spark, d)
    n = F.count("*")
    windows = D.pose(spark, d).groupBy("video_id").agg(F.floor(n / 10).alias("low"), F.floor(n * 9 / 10).alias("high"))
    row = lambda p, f: F.struct(F.lit(p).alias("p"), F.lit(f).cast("long").alias("frame"))
    v = F.col("video_id") % 3
    annotated = windows.select("video_id", F.explode(F.when(v == 0, F.array(row("P1", 5), row("P7", 20))).when(v == 1, F.array(row("P1", 5))).otherwise(F.array().cast("array<struct<p:string,frame:long>>"))).alias("a")).select("video_id", "a.*")
    return L.picked_frames(L.disagreement(pts, _scales(spark, d)), L.hand_speeds(pts.where("backend = 'a'"), 6), annotated, windows)
