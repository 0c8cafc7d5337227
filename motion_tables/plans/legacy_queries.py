"""Queries of the older detector and of the merge of two views."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.operators import legacy as L
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_B = "(PARTITION BY video_id ORDER BY frame)"
_PAIRS = {"wrist": (5, 6, 0.5), "elbow": (3, 4, 0.3), "shoulder": (1, 2, 0.2)}
_MOVED = " + ".join(f"{s}::DOUBLE * sqrt(power({n}_x - lag({n}_x) OVER {_B}, 2) + power({n}_y - lag({n}_y) OVER {_B}, 2))" for n, (_, _, s) in _PAIRS.items())
_SERIES = f"""{D.POSE}, l0 AS (SELECT video_id, frame, least(greatest(t_ms - lag(t_ms) OVER {_B}, 1), 100) AS dt, {', '.join(f'({x(a)} + {x(b)}) / 2 AS {n}_x, ({y(a)} + {y(b)}) / 2 AS {n}_y' for n, (a, b, _) in _PAIRS.items())} FROM p)
, l1 AS (SELECT *, (wrist_y + elbow_y) / 2 AS arm_height, coalesce(({_MOVED}) * 33.33::DOUBLE / dt, 0) AS moved FROM l0), l2 AS (SELECT *, coalesce((arm_height - lag(arm_height) OVER {_B}) * 33.33::DOUBLE / dt, 0) AS risen FROM l1)
, l3 AS (SELECT video_id, frame, sum(moved) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS speed, arm_height, wrist_y AS wrist_height, sum(risen) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS climb, count(*) OVER (PARTITION BY video_id) AS n FROM l2)
, l4 AS (SELECT *, min(climb) OVER v > 0.0005::DOUBLE AND count(*) OVER v = 5 AS falling, max(speed) OVER v AS ahead FROM l3 WINDOW v AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"""


@_R.add("w18_descents", f"WITH {_SERIES} SELECT video_id, frame, round(climb, 6) + 0 AS climb, falling FROM l4")
def descents(spark, d):
    return rounded(L.descents(L.series(D.pose(spark, d))).select("video_id", "frame", "climb", "falling"))


def _least(cond, v):
    return f"arg_min(frame, CASE WHEN {cond} THEN {{'v': round({v}, 9), 'f': frame}} END) OVER (PARTITION BY video_id)"


_FULL = ["greatest(0, p1)", "greatest(p1 + 1, p2)", "greatest(p2 + 1, p3)", "p4", "greatest(p4 + 1, p4 + CAST(floor((p6 - p4) / 2) AS BIGINT))", "p6", "greatest(p6 + 1, p7)", "greatest(p7 + 1, p8)", "least(p9, n - 1)", "least(greatest(p9 + 15, p9 + CAST(floor((n - 1 - p9) * 9 / 10) AS BIGINT)), n - 1)"]


@_R.add("d4_legacy_positions", f"""WITH {_SERIES}, m0 AS (SELECT *, {_least('true', '-speed')} AS p6 FROM l4), m1 AS (SELECT *, greatest(10, CAST(floor(p6 * 0.2::DOUBLE) AS BIGINT)) AS low, CAST(floor(p6 * 0.95::DOUBLE) AS BIGINT) AS high FROM m0)
, m2 AS (SELECT *, CASE WHEN p6 > 20 AND high > low THEN {_least('frame >= low AND frame < high', 'arm_height')} ELSE greatest(1, p6 // 2) END AS top FROM m1)
, m3 AS (SELECT *, max(CASE WHEN frame = top THEN arm_height END) OVER (PARTITION BY video_id) AS h, avg(CASE WHEN frame >= top - 10 AND frame < top THEN arm_height END) OVER (PARTITION BY video_id) AS before, avg(CASE WHEN frame >= top AND frame < least(p6, top + 10) THEN arm_height END) OVER (PARTITION BY video_id) AS after, {_least('frame < p6', 'wrist_height')} AS highest FROM m2)
, m4 AS (SELECT *, CASE WHEN top > 5 AND top < p6 - 5 AND NOT (h < before AND h < after) THEN highest ELSE top END AS p4 FROM m3), m5 AS (SELECT *, max(CASE WHEN falling AND frame + 4 <= p4 - 15 THEN frame END) OVER (PARTITION BY video_id) AS down FROM m4)
, m6 AS (SELECT *, coalesce({_least('frame >= down AND frame < least(down + 20, p4 - 15)', 'speed')}, down + 5, 0) AS q1, quantile_cont(speed, 0.3) OVER (PARTITION BY video_id) * 1.5::DOUBLE AS calm FROM m5)
, m7 AS (SELECT *, min(CASE WHEN frame >= p6 + 20 AND frame + 5 < n AND ahead < calm THEN frame END) OVER (PARTITION BY video_id) AS settled FROM m6)
, m8 AS (SELECT video_id, n, p4, p6, CASE WHEN p4 - q1 < 20 THEN greatest(0, p4 - 30) ELSE q1 END AS p1, greatest(p6 + 30, least(coalesce(settled, n - 1), n - 1)) AS p9 FROM m7 WHERE frame = 0)
, m9 AS (SELECT *, p1 + CAST(floor((p4 - p1) / 3) AS BIGINT) AS p2, p1 + CAST(floor((p4 - p1) * 2 / 3) AS BIGINT) AS p3, p6 + CAST(floor((p9 - p6) / 3) AS BIGINT) AS p7, p6 + CAST(floor((p9 - p6) * 2 / 3) AS BIGINT) AS p8 FROM m8)
{' UNION ALL '.join(f"SELECT video_id, '{p}' AS p, CAST({c} AS BIGINT) AS frame FROM m9 WHERE n >= 20" for p, c in zip(L.NAMES, _FULL))} UNION ALL {' UNION ALL '.join(f"SELECT video_id, '{p}', {c} FROM m9 WHERE n < 20" for p, c in (('P1', '0'), ('P4', 'n // 3'), ('P6', 'n // 2'), ('P9', 'n - 1'), ('P10', 'n - 1')))}""")
def legacy_positions(spark, d):
    return L.legacy_positions(D.pose(spark, d))


#: A pair of views for each order; its lines are detections: a tier, a position, a time and how sure it is.
_DET = """vp AS (SELECT o_orderkey AS pair_id, 60.0::DOUBLE AS f_fps, CASE WHEN o_custkey % 3 = 0 THEN 30.0::DOUBLE ELSE 60.0::DOUBLE END AS d_fps, 100 AS f_frames, CASE WHEN o_custkey % 5 = 0 THEN 90 ELSE 100 END AS d_frames, CASE WHEN o_custkey % 7 <> 0 THEN 500.0::DOUBLE END AS f_impact_ms, CASE WHEN o_custkey % 11 <> 0 THEN 500.0::DOUBLE + o_custkey % 90 END AS d_impact_ms FROM orders)
, vd AS (SELECT l_orderkey AS pair_id, CASE WHEN l_suppkey % 2 = 0 THEN 'face_on' ELSE 'dtl' END AS "view", CASE WHEN l_linenumber IN (1, 4, 7) THEN 'kinematic' WHEN l_linenumber IN (3, 5) THEN 'arm' ELSE 'shaft' END AS tier, 'P' || l_linenumber AS p, max(l_quantity * 4) AS t_ms, max(l_discount) AS confidence FROM lineitem GROUP BY ALL)
, al AS (SELECT *, abs(f_fps - d_fps) < 0.5::DOUBLE AND f_frames = d_frames AS tog, f_impact_ms IS NOT NULL AND d_impact_ms IS NOT NULL AS pair FROM vp)
, an AS (SELECT pair_id, CASE WHEN tog THEN 'shared-trigger' WHEN pair THEN 'impact' ELSE 'none' END AS alignment, CASE WHEN tog THEN 0 WHEN pair THEN d_impact_ms - f_impact_ms END AS offset_ms, list_filter([CASE WHEN tog AND abs(d_impact_ms - f_impact_ms) > 40 THEN 'impacts apart on views triggered together' END,
    CASE WHEN NOT tog AND pair THEN 'views not frame-aligned; aligned on impact' END, CASE WHEN NOT tog AND f_impact_ms IS NULL THEN 'impact not found face on' END, CASE WHEN NOT tog AND NOT pair AND f_impact_ms IS NOT NULL THEN 'impact not found down the line' END], lambda v: v IS NOT NULL) AS warnings FROM al)"""


def _views(spark, d):
    e = F.expr
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.lit(60.0).alias("f_fps"), e("CASE WHEN o_custkey % 3 = 0 THEN 30D ELSE 60D END").alias("d_fps"), F.lit(100).alias("f_frames"), e("CASE WHEN o_custkey % 5 = 0 THEN 90 ELSE 100 END").alias("d_frames"),
        e("CASE WHEN o_custkey % 7 <> 0 THEN 500D END").alias("f_impact_ms"), e("CASE WHEN o_custkey % 11 <> 0 THEN 500D + o_custkey % 90 END").alias("d_impact_ms"))


@_R.add("d8_aligned_views", f"WITH {_DET} SELECT pair_id, alignment, CAST(offset_ms AS DOUBLE) AS offset_ms, warnings FROM an")
def aligned_views(spark, d):
    return L.aligned_views(_views(spark, d))


@_R.add("d8_merged_views", f"""WITH {_DET}, j AS (SELECT vd.pair_id, "view", tier, p, confidence, alignment, CASE WHEN "view" = 'face_on' THEN t_ms ELSE t_ms - offset_ms END AS t FROM vd JOIN an USING (pair_id))
, k AS (SELECT * FROM j WHERE t IS NOT NULL AND (tier = 'kinematic' OR (tier = 'arm' AND "view" = 'face_on') OR (tier = 'shaft' AND "view" = 'dtl'))), g AS (SELECT *, count(*) OVER w AS views, max(t) OVER w - min(t) OVER w AS spread, row_number() OVER (PARTITION BY pair_id, p, tier ORDER BY confidence DESC, "view" DESC) AS k FROM k WINDOW w AS (PARTITION BY pair_id, p, tier))
SELECT pair_id, p, "view", round(t, 6) AS t_ms, round(confidence, 6) AS confidence, CASE WHEN tier = 'kinematic' AND views = 2 AND spread > 50 AND NOT (alignment = 'impact' AND p = 'P7') THEN 'views disagree' END AS warning FROM g WHERE k = 1""")
def merged_views(spark, d):
    l = D.table(spark, d, "lineitem")
    tier = F.when(F.col("l_linenumber").isin(1, 4, 7), "kinematic").when(F.col("l_linenumber").isin(3, 5), "arm").otherwise("shaft")
    det = l.groupBy(F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_suppkey") % 2 == 0, "face_on").otherwise("dtl").alias("view"), tier.alias("tier"), F.concat(F.lit("P"), "l_linenumber").alias("p")).agg(F.max(F.col("l_quantity") * 4).alias("t_ms"), F.max("l_discount").alias("confidence"))
    return rounded(L.merged_views(det, L.aligned_views(_views(spark, d))))
