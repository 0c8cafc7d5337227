"""Queries of catalog jobs: the tables of customers, suppliers, parts and orders stand for golfers, sources, collections and shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.operators import catalog as C
from motion_tables.operators import catalog_rules as K
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


#: The catalog's tables by SQL that both engines read: customers are golfers, parts sources, orders shots, lines streams, suppliers collections.
_TABLES = {
    "golfers": ("customer", "SELECT CASE WHEN c_custkey % 97 = 0 THEN concat('g?', c_custkey) ELSE concat('g', c_custkey) END AS golfer_id, CASE WHEN c_custkey % 3 = 0 THEN 'reference' ELSE 'user' END AS role FROM {t}"),
    "sources": ("part", """SELECT concat('s', p_partkey) AS source_id, CASE WHEN p_partkey % 29 = 0 THEN 'nobody' WHEN p_partkey % 11 <> 0 THEN concat('g', p_partkey % 10 + 1) END AS golfer_id, concat('h', CASE WHEN p_partkey % 50 = 1 THEN p_partkey - 1 ELSE p_partkey END) AS sha256, p_size * 10 AS frame_count, 1920 AS width, 1080 AS height,
        CASE WHEN p_partkey % 4 = 0 THEN 'estimated' ELSE 'verified' END AS timestamps, CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'slowed' WHEN 2 THEN 'slowed' ELSE 'real_time' END AS motion_time, CASE WHEN p_partkey % 6 <> 0 THEN 240 END AS capture_fps, CASE WHEN p_partkey % 7 <> 0 THEN 'file' END AS basis, p_partkey % 8 = 1 AS variable FROM {t}"""),
    "shots": ("orders", """SELECT concat('o', o_orderkey) AS shot_id, CASE WHEN o_orderkey % 31 = 0 THEN 'nobody' ELSE concat('g', o_custkey % 10 + 1) END AS golfer_id, CASE o_orderkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'pitch' ELSE 'putt' END AS swing_type,
        CASE o_custkey % 4 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'asserted' ELSE 'verified' END AS same_status, CASE WHEN o_orderkey % 5 <> 0 THEN 'flash' END AS same_method, CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE 'ann' END AS same_by,
        CASE o_custkey % 5 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'unknown' WHEN 2 THEN 'estimated' ELSE 'verified' END AS sync_status, 'audio' AS sync_method, CASE WHEN o_orderkey % 8 <> 1 THEN 'ann' END AS sync_by,
        CASE o_custkey % 3 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'verified' ELSE 'unknown' END AS cal_status, CASE WHEN o_orderkey % 9 <> 2 THEN 'board' END AS cal_method, 'bob' AS cal_by, CASE WHEN o_orderkey % 12 = 1 THEN -1 WHEN o_orderkey % 12 = 2 THEN 2 END AS uncertainty_ms,
        CASE WHEN o_orderkey % 14 = 1 THEN -1 WHEN o_orderkey % 4 = 3 THEN 1 END AS exposure_uncertainty_ms, CASE o_orderkey % 4 WHEN 0 THEN 'included' WHEN 1 THEN 'bounded' WHEN 3 THEN 'bounded' END AS exposure_alignment,
        CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'O' THEN 'unreviewed' ELSE 'rejected' END AS review_status, CASE WHEN o_orderkey % 10 <> 3 THEN 'cat' END AS review_by FROM {t}"""),
    "streams": ("lineitem", """SELECT concat('o', l_orderkey) AS shot_id, concat('c', l_linenumber) AS stream_id, CASE WHEN l_partkey % 37 = 0 THEN 'gone' ELSE concat('s', l_partkey) END AS source_id, CASE l_suppkey % 7 WHEN 0 THEN 'unknown' ELSE concat('v', l_suppkey % 7) END AS view, l_suppkey % 5 - 1 AS start_frame, l_partkey % 200 AS end_frame,
        CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 9 - 1 END AS crop_x, CASE WHEN l_partkey % 3 = 0 THEN 4 END AS crop_y, CASE WHEN l_partkey % 3 = 0 THEN 1900 + l_partkey % 30 END AS crop_w, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 11 * 100 END AS crop_h,
        CASE l_partkey % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'partial' ELSE 'good' END AS body, CASE l_suppkey % 4 WHEN 0 THEN 'unassessed' WHEN 1 THEN 'partial' ELSE 'good' END AS club, CASE WHEN l_linenumber % 4 = 0 THEN 'no' ELSE 'yes' END AS resolution FROM {t}"""),
    "collections": ("supplier", "SELECT concat('k', s_suppkey) AS collection_id, CASE WHEN s_suppkey % 13 = 0 THEN 'nobody' ELSE concat('g', s_suppkey % 10 + 1) END AS golfer_id, CASE WHEN s_suppkey % 3 = 0 THEN 'frozen' ELSE 'draft' END AS status, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 7 = 1 THEN '2024' END AS frozen_at, CASE WHEN s_suppkey % 3 = 0 THEN 'ann' END AS frozen_by, CASE WHEN s_suppkey % 6 = 0 THEN 'x' END AS snapshot, CASE WHEN s_suppkey % 4 <> 0 THEN 'full' END AS swing_type FROM {t}"),
    "members": ("orders", "SELECT concat('k', o_orderkey % 10 + 1) AS collection_id, concat(CASE WHEN o_orderkey % 64 = 0 THEN 'x' ELSE 'o' END, o_orderkey) AS shot_id FROM {t} WHERE o_orderkey % 4 = 0"),
}
_CATALOG = ", ".join(f"{k} AS ({q.replace('{t}', t)})" for k, (t, q) in _TABLES.items())


def _catalog(spark, d, *names):
    return [spark.sql(_TABLES[k][1], t=D.table(spark, d, _TABLES[k][0])) for k in names]


def _rule(entity, id_, table, cond, text):
    return f"SELECT '{entity}' AS entity, {id_} AS id, '{text}' AS rule FROM {table} WHERE {cond}"


_SHOT_RULES = [
    ("kg IS NULL", "unknown golfer"), ("n = 1 AND (same_status <> 'not_applicable' OR sync_status <> 'not_applicable')", "one stream, but not not_applicable"), ("n <> 1 AND same_status NOT IN ('asserted', 'verified')", "several streams, but not of the same swing"),
    ("n <> 1 AND (sync_status = 'not_applicable' OR cal_status = 'not_applicable')", "several streams, but no synchronization or calibration"), ("n <> 1 AND sync_status = 'verified' AND same_status <> 'verified'", "synchronization verified, same swing not"), ("uncertainty_ms < 0", "negative uncertainty"),
    ("exposure_uncertainty_ms < 0", "negative exposure uncertainty"), ("exposure_alignment = 'bounded' AND exposure_uncertainty_ms IS NULL", "exposure bounded without a bound"), ("coalesce(exposure_alignment, 'unknown') <> 'bounded' AND exposure_uncertainty_ms IS NOT NULL", "exposure bound without being bounded"),
    ("exposure_alignment IS NOT NULL AND sync_status NOT IN ('estimated', 'verified')", "exposure alignment without synchronization"), ("same_status IN ('verified', 'asserted', 'estimated') AND (same_method IS NULL OR trim(same_by) = '')", "same swing decided without method or person"),
    ("sync_status IN ('verified', 'asserted', 'estimated') AND sync_by IS NULL", "synchronization decided without method or person"), ("cal_status IN ('verified', 'asserted', 'estimated') AND cal_method IS NULL", "calibration decided without method or person"), ("review_status <> 'unreviewed' AND review_by IS NULL", "review without a reviewer"),
]
_OFF = "(least(crop_x, crop_y) < 0 OR least(crop_w, crop_h) < 1)"
_STREAM_RULES = [
    ("there IS NULL", "unknown source"), ("there AND sg <> golfer_id", "source of another golfer"), ("there AND NOT (start_frame >= 0 AND start_frame <= end_frame AND end_frame < frame_count)", "window not within the source"), (f"there AND crop_x IS NOT NULL AND {_OFF}", "crop without place or size"),
    (f"there AND crop_x IS NOT NULL AND NOT {_OFF} AND (crop_x + crop_w > width OR crop_y + crop_h > height)", "crop past the frame"),
]


@_R.add("c1_catalog_violations", f"""WITH {_CATALOG}, ns AS (SELECT shot_id, count(*) AS n FROM streams GROUP BY shot_id)
, sh AS (SELECT s.* REPLACE (s.golfer_id AS golfer_id), coalesce(n, 0) AS n, g.golfer_id AS kg FROM shots s LEFT JOIN ns USING (shot_id) LEFT JOIN golfers g ON g.golfer_id = s.golfer_id)
, st AS (SELECT t.*, s.golfer_id AS sg, frame_count, width, height, CASE WHEN s.source_id IS NOT NULL THEN true END AS there, h.golfer_id FROM streams t LEFT JOIN sources s ON s.source_id = t.source_id JOIN shots h ON h.shot_id = t.shot_id)
, co AS (SELECT c.*, g.golfer_id AS kg, role FROM collections c LEFT JOIN golfers g ON g.golfer_id = c.golfer_id)
, me AS (SELECT m.*, c.golfer_id AS owner, c.status, c.swing_type AS wanted, s.golfer_id, s.swing_type FROM members m JOIN collections c ON c.collection_id = m.collection_id LEFT JOIN shots s ON s.shot_id = m.shot_id)
{_rule('golfer', 'golfer_id', 'golfers', "contains(golfer_id, '?')", 'no valid identifier')}
UNION ALL SELECT 'source', s.source_id, 'unknown golfer' FROM sources s LEFT JOIN golfers g ON g.golfer_id = s.golfer_id WHERE s.golfer_id IS NOT NULL AND g.golfer_id IS NULL
UNION ALL SELECT 'source', source_id, 'same bytes as another source' FROM (SELECT source_id, min(source_id) OVER (PARTITION BY sha256) AS first FROM sources) WHERE source_id <> first
UNION ALL {' UNION ALL '.join(_rule('shot', 'shot_id', 'sh', c, t) for c, t in _SHOT_RULES)} UNION ALL {' UNION ALL '.join(_rule('stream', "shot_id || '/' || stream_id", 'st', c, t) for c, t in _STREAM_RULES)}
UNION ALL SELECT 'stream', shot_id || '/' || stream_id, 'duplicate stream id' FROM (SELECT *, row_number() OVER (PARTITION BY shot_id, stream_id) AS k FROM streams) WHERE k > 1
UNION ALL {_rule('collection', 'collection_id', 'co', 'kg IS NULL', 'unknown golfer')} UNION ALL {_rule('collection', 'collection_id', 'co', "role <> 'reference'", 'of a user')}
UNION ALL {_rule('collection', 'collection_id', 'co', "status = 'frozen' AND (frozen_at IS NULL OR frozen_by IS NULL OR snapshot IS NULL)", 'frozen without provenance')} UNION ALL {_rule('collection', 'collection_id', 'co', "status = 'draft' AND (frozen_at IS NOT NULL OR frozen_by IS NOT NULL OR snapshot IS NOT NULL)", 'draft with provenance')}
UNION ALL {_rule('member', "collection_id || '/' || shot_id", 'me', 'golfer_id IS NULL', 'unknown shot')} UNION ALL {_rule('member', "collection_id || '/' || shot_id", 'me', 'golfer_id <> owner', 'shot of another golfer')} UNION ALL {_rule('member', "collection_id || '/' || shot_id", 'me', "status = 'draft' AND swing_type <> wanted", 'shot of another swing type')}""")
def catalog_violations(spark, d):
    return K.violations(*_catalog(spark, d, "golfers", "sources", "shots", "streams", "collections", "members"))


_CLOCK = "CASE WHEN motion_time = 'real_time' AND basis IS NOT NULL THEN NULL WHEN motion_time = 'slowed' AND basis IS NOT NULL AND capture_fps IS NOT NULL THEN CASE WHEN variable THEN stream_id || ': slowed with a variable rate' END WHEN motion_time = 'real_time' THEN stream_id || ': real time without a basis' ELSE stream_id || ': motion time ' || motion_time END"


def _listed(cond, text):
    return f"coalesce(list_sort(list({text}) FILTER (WHERE {cond})), [])"


@_R.add("c6_eligibility", f"""WITH {_CATALOG}, st AS (SELECT t.*, timestamps, motion_time, capture_fps, basis, variable FROM streams t JOIN sources s ON s.source_id = t.source_id)
, g AS (SELECT shot_id, count(*) AS n, count(DISTINCT "view") AS views, bool_or("view" = 'unknown') AS unknown, {_listed("timestamps <> 'verified'", "stream_id || ': timestamps ' || timestamps")} AS times, {_listed(f"({_CLOCK}) IS NOT NULL", _CLOCK)} AS clocks,
    {_listed("body NOT IN ('good', 'partial')", "stream_id || ': body visibility ' || body")} AS body, {_listed("club NOT IN ('good', 'partial')", "stream_id || ': club visibility ' || club")} AS club, {_listed("resolution <> 'yes'", "stream_id || ': resolution ' || resolution")} AS res FROM st GROUP BY shot_id)
, j AS (SELECT * FROM shots JOIN g USING (shot_id))
, k AS (SELECT shot_id, 'stereo_3d' AS gate, CASE WHEN n < 2 THEN ['one view'] ELSE list_filter([CASE WHEN same_status <> 'verified' THEN 'same swing ' || same_status END, CASE WHEN sync_status <> 'verified' THEN 'synchronization ' || sync_status END, CASE WHEN cal_status <> 'verified' THEN 'calibration ' || cal_status END, CASE WHEN unknown OR views < n THEN 'views not distinct and known' END], lambda v: v IS NOT NULL) END AS reasons FROM j
UNION ALL SELECT shot_id, 'motion_timing', times || clocks || CASE WHEN n > 1 AND sync_status IN ('unknown', 'not_applicable') THEN ['no synchronization'] ELSE [] END FROM j UNION ALL SELECT shot_id, 'body_landmarks', body FROM j UNION ALL SELECT shot_id, 'club_landmarks', club FROM j UNION ALL SELECT shot_id, 'resolution', res FROM j
UNION ALL SELECT shot_id, 'human_review', CASE WHEN review_status <> 'reviewed' THEN ['review ' || review_status] ELSE [] END FROM j) SELECT shot_id, gate, len(reasons) = 0 AS eligible, reasons FROM k""")
def eligibility(spark, d):
    shots, streams, sources = _catalog(spark, d, "shots", "streams", "sources")
    return K.eligibility(shots, streams, sources)


def _working(spark, d):
    c = D.table(spark, d, "customer").where("c_custkey % 9 <> 4")
    moved = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment"))).withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey")))
    return moved


@_R.add("c9_drift", """WITH a AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 3), b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 4)
, j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.c_nationkey IS DISTINCT FROM b.c_nationkey AS n, a.c_mktsegment IS DISTINCT FROM b.c_mktsegment AS m FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT c_custkey, change, CASE WHEN change <> 'changed' THEN [] ELSE list_filter([CASE WHEN n THEN 'c_nationkey' END, CASE WHEN m THEN 'c_mktsegment' END], lambda x: x IS NOT NULL) END AS fields FROM j WHERE change <> 'changed' OR n OR m""")
def drift(spark, d):
    return C.drift(D.table(spark, d, "customer").where("c_custkey % 11 <> 3"), _working(spark, d), "c_custkey", ["c_nationkey", "c_mktsegment"])


@_R.add("snk4_upserted_annotations", """WITH e AS (SELECT o_custkey AS c_custkey, 'ORDERED' AS c_mktsegment, -1 AS c_nationkey FROM orders WHERE o_orderkey % 7 = 1 GROUP BY o_custkey), cur AS (SELECT * FROM customer WHERE c_custkey % 4 <> 2)
SELECT coalesce(cur.c_custkey, e.c_custkey) AS c_custkey, CASE WHEN cur.c_custkey IS NULL THEN e.c_nationkey ELSE cur.c_nationkey END AS c_nationkey, CASE WHEN e.c_custkey IS NULL THEN cur.c_mktsegment ELSE e.c_mktsegment END AS c_mktsegment FROM cur FULL JOIN e ON e.c_custkey = cur.c_custkey""")
def upserted_annotations(spark, d):
    edits = D.table(spark, d, "orders").where("o_orderkey % 7 = 1").select(F.col("o_custkey").alias("c_custkey")).distinct().select("c_custkey", F.lit("ORDERED").alias("c_mktsegment"), F.lit(-1).alias("c_nationkey"))
    return C.upserted(D.table(spark, d, "customer").where("c_custkey % 4 <> 2").select("c_custkey", "c_nationkey", "c_mktsegment"), edits, "c_custkey", ["c_nationkey"], ["c_mktsegment"])


@_R.add("snk5_revision_checks", """SELECT o_orderkey AS id, CASE WHEN revision IS NOT DISTINCT FROM loaded THEN 'accepted' ELSE 'conflict' END AS outcome, CASE WHEN revision IS NOT DISTINCT FROM loaded THEN coalesce(revision, 0) + 1 ELSE revision END AS revision
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 5 END AS loaded FROM orders) e LEFT JOIN (SELECT l_orderkey, count(*) % 5 AS revision FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey""")
def revision_checks(spark, d):
    stored = D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") % 5).alias("revision"))
    edits = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderkey") % 5).alias("loaded_revision"))
    return C.revision_checked(stored, edits, "id")


@_R.add("c12_last_edits", "SELECT conv_id, role, turn, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def last_edits(spark, d):
    return C.last_edits(D.table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))


@_R.add("c14_frozen_unchanged", "SELECT a.o_orderkey AS id, 'frozen shot changed' AS rule FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 13 <> 5) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus = 'F' AND b.o_orderkey IS NULL")
def frozen_unchanged(spark, d):
    o = D.table(spark, d, "orders")
    gone = C.drift(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'F' and o_orderkey % 13 <> 5"), "o_orderkey", ["o_totalprice"])
    return gone.select(F.col("o_orderkey").alias("id"), F.lit("frozen shot changed").alias("rule"))


@_R.add("a18_duplicate_bytes", "SELECT md5(text) AS sha, list_sort(list(doc_id)) AS sources FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_bytes(spark, d):
    return D.table(spark, d, "documents").groupBy(F.md5("text").alias("sha")).agg(F.array_sort(F.collect_list("doc_id")).alias("sources")).where(F.size("sources") > 1)


@_R.add("src12_content_identity", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS size_bytes FROM pages")
def content_identity(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"))


_BASE = "SELECT DISTINCT concat('o', l_orderkey) AS shot_id, concat('c', l_linenumber) AS stream_id, concat('s', min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber)) AS source_id, 0 AS start_frame, 9 AS end_frame, 'good' AS quality FROM {t}"
_EDITS = """SELECT concat('o', l_orderkey) AS shot_id, concat('c', l_linenumber % 3 + 1) AS stream_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS seq, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey % 20 - 1 END AS start_frame, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 90 END AS end_frame,
    CASE l_suppkey % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'odd' WHEN 2 THEN 'bad' END AS quality FROM {t}"""


@_R.add("c11_edited_streams", f"""WITH {_CATALOG}, ba AS ({_BASE.replace('{t}', 'lineitem')}), ed AS ({_EDITS.replace('{t}', 'lineitem')}), j AS (SELECT ed.*, frame_count, ed.start_frame IS NOT NULL OR ed.end_frame IS NOT NULL AS win FROM ed JOIN ba USING (shot_id, stream_id) LEFT JOIN sources ON sources.source_id = ba.source_id)
, k AS (SELECT *, (NOT win OR coalesce(start_frame >= 0 AND start_frame <= end_frame AND end_frame < frame_count, false)) AND (quality IS NULL OR quality IN ('good', 'partial', 'bad')) AS ok FROM j)
, g AS (SELECT shot_id, stream_id, arg_max(start_frame, seq) FILTER (ok AND win) AS s, arg_max(end_frame, seq) FILTER (ok AND win) AS e, arg_max(quality, seq) FILTER (ok AND quality IS NOT NULL) AS q, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused FROM k GROUP BY ALL)
SELECT shot_id, stream_id, coalesce(s, start_frame) AS start_frame, coalesce(e, end_frame) AS end_frame, coalesce(q, quality) AS quality, coalesce(accepted, 0) AS accepted, coalesce(refused, 0) AS refused FROM ba LEFT JOIN g USING (shot_id, stream_id)""")
def edited_streams(spark, d):
    l = D.table(spark, d, "lineitem")
    return K.edited_streams(spark.sql(_BASE, t=l), spark.sql(_EDITS, t=l), *_catalog(spark, d, "sources"))
