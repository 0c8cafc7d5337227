"""Queries of picks that depend on the pick before: orders stand for frames, their lines for candidates, customers for recordings."""

from __future__ import annotations

from motion_tables.operators import follow as W
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

#: Read by both engines.  A frame's number is the order's; customers are dealt to 40 recordings.
_FRAMES = "SELECT o_custkey % 40 AS video_id, o_orderkey AS frame, 300 + o_custkey % 50 AS grip_x, 200 + o_orderkey % 40 AS grip_y, 640 AS width, 480 AS height FROM {o}"
_SEGMENTS = """SELECT o_custkey % 40 AS video_id, o_orderkey AS frame, l_linenumber AS candidate, 280 + l_partkey % 90 AS x1, 190 + l_suppkey % 60 AS y1,
    280 + l_partkey % 90 + (l_partkey * 7 + l_linenumber * 13) % 300 - 150 AS x2, 190 + l_suppkey % 60 + (l_suppkey * 11 + l_linenumber * 29) % 260 - 60 AS y2 FROM {o} JOIN {l} ON l_orderkey = o_orderkey"""
_BOXES = """SELECT o_custkey % 40 AS video_id, o_orderkey AS frame, l_linenumber AS candidate, l_linenumber * 90 + l_partkey % 45 AS x0, l_suppkey % 40 AS y0,
    l_linenumber * 90 + l_partkey % 45 + 100 + l_quantity AS x1, l_suppkey % 40 + 200 + l_partkey % 50 AS y1, l_discount * 10 AS score FROM {o} JOIN {l} ON l_orderkey = o_orderkey"""
_SQL = {k: v.replace("{o}", "orders").replace("{l}", "lineitem") for k, v in {"f": _FRAMES, "s": _SEGMENTS, "b": _BOXES}.items()}


def _read(spark, d, sql):
    return spark.sql(sql, o=D.table(spark, d, "orders"), l=D.table(spark, d, "lineitem")) if "{l}" in sql else spark.sql(sql, o=D.table(spark, d, "orders"))


@_R.add("d19_shaft_segments", f"""WITH RECURSIVE f AS MATERIALIZED ({_SQL['f']}), j AS (SELECT s.video_id, s.frame, candidate, hypot(x1, y1, x2, y2) AS length, d1 AS a, d2 AS b, x1, y1, x2, y2 FROM (SELECT *, sqrt((x1 - grip_x) * (x1 - grip_x) + (y1 - grip_y) * (y1 - grip_y)) AS d1, sqrt((x2 - grip_x) * (x2 - grip_x) + (y2 - grip_y) * (y2 - grip_y)) AS d2 FROM ({_SQL['s']}) JOIN f USING (video_id, frame)) s)
, o AS (SELECT video_id, frame, candidate, length, least(a, b) AS away, CASE WHEN b < a THEN x2 ELSE x1 END AS x1, CASE WHEN b < a THEN y2 ELSE y1 END AS y1, CASE WHEN b < a THEN x1 ELSE x2 END AS x2, CASE WHEN b < a THEN y1 ELSE y2 END AS y2 FROM j)
, g AS (SELECT *, atan2(y2 - y1, x2 - x1) AS angle FROM o WHERE length >= 72 AND away <= 72)
, c AS MATERIALIZED (SELECT video_id, frame, candidate, x1, y1, x2, y2, angle, length * abs(sin(angle)) * CASE WHEN y2 > y1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS worth, away + 1 AS far, dense_rank() OVER (PARTITION BY video_id ORDER BY frame) AS k FROM g WHERE abs(angle) BETWEEN radians(20) AND pi() - radians(20))
, r AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS x1, CAST(NULL AS BIGINT) AS y1, CAST(NULL AS BIGINT) AS x2, CAST(NULL AS BIGINT) AS y2, CAST(NULL AS DOUBLE) AS angle FROM c
UNION ALL SELECT video_id, k, frame, x1, y1, x2, y2, angle FROM (SELECT c.*, row_number() OVER (PARTITION BY c.video_id ORDER BY worth * coalesce(greatest(0.3::DOUBLE, 1 - abs(c.angle - r.angle) / radians(45)), 1) / far DESC, candidate) AS best FROM r JOIN c ON c.video_id = r.video_id AND c.k = r.k + 1) WHERE best = 1)
SELECT f.video_id, f.frame, x1, y1, x2, y2 FROM f LEFT JOIN r ON r.video_id = f.video_id AND r.frame = f.frame""".replace("hypot(x1, y1, x2, y2)", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"))
def shaft_segments(spark, d):
    return W.shaft_segments(_read(spark, d, _FRAMES), _read(spark, d, _SEGMENTS))


@_R.add("d20_person_boxes", f"""WITH RECURSIVE f AS MATERIALIZED (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS k FROM ({_SQL['f']}))
, b AS MATERIALIZED (SELECT video_id, frame, candidate, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(score AS DOUBLE) AS score FROM ({_SQL['b']}) WHERE score >= 0.5::DOUBLE)
, r AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS x0, CAST(NULL AS DOUBLE) AS y0, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, CAST(NULL AS DOUBLE) AS score FROM f
UNION ALL SELECT video_id, k, frame, x0, y0, x1, y1, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN most >= 0.3::DOUBLE THEN shared ELSE (x1 - x0) * (y1 - y0) END DESC, candidate) AS best FROM (SELECT *, max(shared) OVER (PARTITION BY video_id) AS most FROM (
    SELECT f.video_id, f.k, f.frame, candidate, b.x0, b.y0, b.x1, b.y1, b.score, i / ((b.x1 - b.x0) * (b.y1 - b.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - i) AS shared FROM r JOIN f ON f.video_id = r.video_id AND f.k = r.k + 1 LEFT JOIN b ON b.video_id = f.video_id AND b.frame = f.frame,
    LATERAL (SELECT CASE WHEN r.x0 IS NULL OR b.x0 IS NULL THEN NULL ELSE greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0) END AS i)))) WHERE best = 1)
SELECT video_id, frame, x0, y0, x1, y1, score FROM r WHERE k > 0""")
def person_boxes(spark, d):
    return W.person_boxes(_read(spark, d, _FRAMES), _read(spark, d, _BOXES))
