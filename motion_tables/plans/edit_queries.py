"""Queries of edit logs: order lines stand for edits of labels, parts for frames, suppliers for streams."""

from __future__ import annotations

from motion_tables.operators import label_edits as L
from motion_tables.operators import shot_edits as S
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_POINTS = ["head", "grip", "hosel", "toe"]
#: Read by both engines.
_EDITS = """SELECT l_suppkey % 20 AS stream_id, (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS seq, l_partkey % 61 AS frame, element_at(array('point', 'point', 'point', 'point', 'point', 'unavailable', 'remove', 'review', 'review', 'position', 'clear', 'paint'), CAST((l_partkey * 3 + l_orderkey + l_linenumber) % 60 AS INT) % 12 + 1) AS op,
    CASE WHEN (l_partkey * 3 + l_orderkey + l_linenumber) % 60 % 12 IN (9, 10) THEN concat('P', l_linenumber + 4) WHEN l_orderkey % 23 = 0 THEN 'nose' ELSE element_at(array('head', 'grip', 'hosel', 'toe'), CAST(l_linenumber % 4 AS INT) + 1) END AS name,
    CAST(l_quantity AS DOUBLE) * 13 AS x, CAST(l_partkey % 480 AS DOUBLE) AS y, l_orderkey % 3 <> 0 AS visible, CASE l_suppkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'ann' WHEN 2 THEN 'bob' WHEN 3 THEN 'cat' END AS by, element_at(array('manual', 'manual', 'model_proposed', 'guess'), CAST(l_orderkey % 7 % 4 AS INT) + 1) AS origin,
    concat('m', l_linenumber) AS model, CAST(l_discount AS DOUBLE) AS confidence, element_at(array('occluded', 'motion_blur', 'lost'), CAST(l_orderkey % 3 AS INT) + 1) AS reason, element_at(array('reviewed', 'rejected', 'unreviewed', 'done'), CAST(l_orderkey % 4 AS INT) + 1) AS status, CAST(NULL AS STRING) AS notes, concat('i', l_partkey % 61 * 10 + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END) AS image FROM {t}"""
_STREAMS = "SELECT CAST(s_suppkey AS BIGINT) AS stream_id, 640 AS width, 480 AS height, 60 AS frame_count, s_suppkey % 7 <> 3 AS same_bytes FROM {t} WHERE s_suppkey < 19"


def _checked(spark, d):
    return L.checked(spark.sql(_EDITS, t=D.table(spark, d, "lineitem")), spark.sql(_STREAMS, t=D.table(spark, d, "supplier")), _POINTS)


def _duck(sql, t):
    return sql.replace("element_at(array(", "list_extract(list_value(").replace(" STRING", " VARCHAR").replace("{t}", t)


_LISTED = "('head', 'grip', 'hosel', 'toe')"
_FOLD = f"""e0 AS ({_duck(_EDITS, 'lineitem')}), st AS ({_duck(_STREAMS, 'supplier')})
, e1 AS MATERIALIZED (SELECT e0.*, CASE WHEN op = 'paint' THEN 'unknown edit' WHEN op = 'position' AND name NOT IN ('P1', 'P2', 'P3', 'P4', 'P5', 'P6', 'P7', 'P8', 'P9', 'P10') THEN 'unknown position' WHEN op = 'position' AND origin = 'guess' THEN 'unknown origin'
    WHEN op IN ('point', 'unavailable') AND name NOT IN {_LISTED} THEN 'unknown point' WHEN op = 'unavailable' AND reason = 'lost' THEN 'unknown reason' WHEN op IN ('point', 'unavailable', 'position') AND frame_count IS NULL THEN 'unknown stream'
    WHEN op = 'point' AND NOT (x BETWEEN 0 AND width AND y BETWEEN 0 AND height) THEN 'outside the image' WHEN op IN ('point', 'unavailable', 'position') AND NOT same_bytes THEN 'index of other bytes' WHEN op IN ('point', 'unavailable', 'position') AND frame >= frame_count THEN 'no such frame'
    WHEN op = 'review' AND status = 'done' THEN 'unknown status' WHEN op = 'review' AND status <> 'unreviewed' AND coalesce(trim("by"), '') = '' THEN 'review without a reviewer' END AS why FROM e0 LEFT JOIN st USING (stream_id))
, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, frame ORDER BY seq) AS k FROM e1 WHERE op NOT IN ('position', 'clear'))
, r AS (SELECT DISTINCT stream_id, frame, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, CAST([] AS STRUCT(name VARCHAR, reason VARCHAR, x DOUBLE, y DOUBLE, visible BOOLEAN, origin VARCHAR, model VARCHAR, confidence DOUBLE, set_by VARCHAR)[]) AS live, CAST(NULL AS VARCHAR) AS image, CAST(NULL AS VARCHAR) AS review, CAST(NULL AS VARCHAR) AS review_by, CAST(NULL AS VARCHAR) AS why FROM e
UNION ALL SELECT stream_id, frame, k, seq, CASE WHEN late IS NOT NULL OR op = 'review' THEN live WHEN op = 'point' THEN list_append(others, {{'name': name, 'reason': CAST(NULL AS VARCHAR), 'x': x, 'y': y, 'visible': visible, 'origin': CASE WHEN fixes THEN 'corrected' ELSE origin END, 'model': CASE WHEN fixes THEN old.model ELSE model END, 'confidence': confidence, 'set_by': "by"}})
    WHEN op = 'unavailable' THEN list_append(others, {{'name': name, 'reason': reason, 'x': CAST(NULL AS DOUBLE), 'y': CAST(NULL AS DOUBLE), 'visible': CAST(NULL AS BOOLEAN), 'origin': CAST(NULL AS VARCHAR), 'model': CAST(NULL AS VARCHAR), 'confidence': CAST(NULL AS DOUBLE), 'set_by': CAST(NULL AS VARCHAR)}}) ELSE others END,
    CASE WHEN late IS NULL AND op IN ('point', 'unavailable') AND len(live) = 0 THEN new_image ELSE image END, CASE WHEN late IS NOT NULL THEN review WHEN op = 'review' THEN status ELSE 'unreviewed' END, CASE WHEN late IS NOT NULL THEN review_by WHEN op = 'review' AND status <> 'unreviewed' THEN "by" END, late
    FROM (SELECT *, coalesce(origin = 'manual' AND old.origin IN ('model_proposed', 'corrected'), false) AS fixes FROM (SELECT e.* EXCLUDE (image, why), e.image AS new_image, r.live, r.image, r.review, r.review_by, list_filter(r.live, lambda p: p.name <> e.name) AS others, list_extract(list_filter(r.live, lambda p: p.name = e.name), 1) AS old,
        CASE WHEN op = 'review' AND len(r.live) = 0 THEN 'no labels to review' ELSE coalesce(e.why, CASE WHEN op IN ('point', 'unavailable') AND len(r.live) > 0 AND r.image <> e.image THEN 'labels of another image' END) END AS late FROM r JOIN e ON e.stream_id = r.stream_id AND e.frame = r.frame AND e.k = r.k + 1)))"""


@_R.add("c12_label_points", f"""WITH RECURSIVE {_FOLD}, last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY stream_id, frame ORDER BY k DESC) = 1)
SELECT stream_id, frame, image, review, review_by, p.name, p.reason, p.x, p.y, p.visible, p.origin, p.model, p.confidence, p.set_by FROM (SELECT stream_id, frame, image, review, review_by, unnest(live) AS p FROM last)""")
def label_points(spark, d):
    return L.label_points(L.folded(_checked(spark, d)))


@_R.add("c12_refused_edits", f"WITH RECURSIVE {_FOLD} SELECT stream_id, seq, frame, why FROM r WHERE why IS NOT NULL UNION ALL SELECT stream_id, seq, frame, why FROM e1 WHERE op IN ('position', 'clear') AND why IS NOT NULL")
def refused_edits(spark, d):
    edits = _checked(spark, d)
    return L.label_refusals(L.folded(edits), edits)


@_R.add("c12_label_positions", f"WITH RECURSIVE {_FOLD} SELECT stream_id, name AS \"position\", frame, origin, \"by\" AS set_by, image FROM (SELECT * FROM e1 WHERE op IN ('position', 'clear') AND why IS NULL QUALIFY row_number() OVER (PARTITION BY stream_id, name ORDER BY seq DESC) = 1) WHERE op = 'position'")
def label_positions(spark, d):
    return L.label_positions(_checked(spark, d))


#: A log of shots: lines are edits of the shot of a part, in order of the order; suppliers are sources, customers golfers.
_SHOT_LOG = """SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000 AS seq, CASE l_partkey % 3 + l_linenumber % 2 WHEN 0 THEN 'shot' ELSE element_at(array('shot', 'stream', 'window', 'crop', 'quality', 'swing', 'review', 'same', 'sync', 'cal', 'remove', 'owner', 'golfer', 'paint'), CAST((l_orderkey * 5 + l_linenumber) % 41 AS INT) % 14 + 1) END AS op,
    concat('o', CASE WHEN l_partkey % 50 = 7 THEN '?' ELSE '' END, l_partkey % 150) AS shot_id, concat('g', l_partkey % 150 % 5 + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS golfer_id, concat('s', l_partkey % 150 % 5 + 5 * (l_suppkey % 4)) AS source_id, CASE WHEN l_orderkey % 4 > 0 THEN element_at(array('face_on', 'overhead', 'unknown'), CAST(l_linenumber % 3 AS INT) + 1) END AS stream_id,
    element_at(array('face_on', 'overhead', 'down_the_line', 'above'), CAST(l_orderkey % 13 % 4 AS INT) + 1) AS view, l_suppkey % 9 - 1 AS start_frame, l_partkey % 90 AS end_frame, CASE WHEN l_orderkey % 3 > 0 THEN named_struct('x', l_suppkey % 8 - 1, 'y', CAST(5 AS BIGINT), 'w', l_partkey % 700, 'h', l_suppkey % 40) END AS crop,
    element_at(array('good', 'poor'), CAST(l_orderkey % 2 AS INT) + 1) AS body, CAST(NULL AS STRING) AS club, 'good' AS resolution, element_at(array('full', 'half', 'wedge'), CAST(l_orderkey % 7 % 3 AS INT) + 1) AS swing_type, element_at(array('asserted', 'verified', 'unknown', 'reviewed', 'estimated', 'not_applicable'), CAST(l_partkey % 6 AS INT) + 1) AS status,
    CASE WHEN l_orderkey % 5 > 0 THEN 'flash' END AS method, element_at(array('ann', 'bob', ' '), CAST(l_suppkey % 8 % 3 AS INT) + 1) AS by, CAST(l_suppkey % 10 - 1 AS DOUBLE) AS uncertainty_ms, CASE l_orderkey % 8 WHEN 1 THEN 'bounded' WHEN 2 THEN 'included' WHEN 3 THEN 'odd' END AS exposure_alignment, CASE WHEN l_orderkey % 8 = 1 THEN CAST(2 AS DOUBLE) END AS exposure_uncertainty_ms FROM {t}"""
_SHOT_SOURCES = "SELECT concat('s', s_suppkey) AS source_id, CASE WHEN s_suppkey % 6 > 0 THEN concat('g', s_suppkey % 5) END AS golfer_id, 40 + s_suppkey * 3 AS frame_count, 640 AS width, 480 AS height FROM {t} WHERE s_suppkey < 20"


def shot_tables(spark, d):
    """The golfers, sources, held shots and log that the queries of shots read."""
    golfers = spark.sql("SELECT concat('g', c_custkey) AS golfer_id FROM {t} WHERE c_custkey < 4", t=D.table(spark, d, "customer"))
    held = spark.sql("SELECT concat('o', p_partkey % 150) AS shot_id FROM {t} WHERE p_partkey % 9 = 0", t=D.table(spark, d, "part"))
    log = spark.sql(_SHOT_LOG, t=D.table(spark, d, "lineitem"))
    return golfers, spark.sql(_SHOT_SOURCES, t=D.table(spark, d, "supplier")), held, log


@_R.add("c11_edited_shots")
def edited_shots(spark, d):
    return S.shot_rows(S.edited_shots(*shot_tables(spark, d)))


@_R.add("c11_refused_shot_edits")
def refused_shot_edits(spark, d):
    return S.refusals(S.edited_shots(*shot_tables(spark, d)))
