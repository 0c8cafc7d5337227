"""Queries of pairing, as-of and range joins, and of set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.operators import joins as J
from motion_tables.operators import windows as W
from motion_tables.plans.registry import Registry
from motion_tables.plans.series_queries import _WINDOW
from motion_tables.plans.shape_queries import PARSED, parse_capture
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


def _captures(spark, d):
    return parse_capture(spark, d).where("golfer is not null")


# Dates and times of the derived names rarely agree, so swings are told by golfer, month and the last digits of their time here.
_SWINGS = f"{PARSED}, w AS (SELECT path, golfer, substr(date, 1, 7) AS date, substr(time, 5) AS time, camera_id, view FROM k WHERE golfer IS NOT NULL)"


def _swings(spark, d):
    return _captures(spark, d).withColumn("date", F.substring("date", 1, 7)).withColumn("time", F.substring("time", 5, 2))


@_R.add("j1_pair_views", f"WITH {_SWINGS} SELECT golfer, date, time, min(CASE WHEN view = 'dtl' THEN path END) AS dtl, min(CASE WHEN view = 'face_on' THEN path END) AS face_on FROM w GROUP BY ALL HAVING count(CASE WHEN view = 'dtl' THEN 1 END) > 0 AND count(CASE WHEN view = 'face_on' THEN 1 END) > 0")
def pair_views(spark, d):
    return J.pair_views(_swings(spark, d))


@_R.add("j1_unpaired", f"WITH {_SWINGS}, g AS (SELECT golfer, date, time FROM w GROUP BY ALL HAVING count(CASE WHEN view = 'dtl' THEN 1 END) = 0 OR count(CASE WHEN view = 'face_on' THEN 1 END) = 0) SELECT path FROM w JOIN g USING (golfer, date, time)")
def unpaired(spark, d):
    return J.unpaired(_swings(spark, d))


@_R.add("j2_partners", f"WITH {_SWINGS}, q AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM w WHERE view IS NOT NULL) SELECT a.path, min(b.path) AS partner FROM q a JOIN q b ON a.folder = b.folder AND a.golfer = b.golfer AND a.date = b.date AND a.time = b.time AND a.view <> b.view GROUP BY a.path")
def partners(spark, d):
    return J.partners(_swings(spark, d))


_TIMES = "tq AS (SELECT user_id AS video_id, event_id AS id, (event_id * 37 % 2400)::DOUBLE - 300 AS t FROM events WHERE event_type = 'view' AND user_id IS NOT NULL)"


def _times(spark, d):
    e = D.table(spark, d, "events").where("event_type = 'view' and user_id is not null")
    return e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("id"), ((F.col("event_id") * 37 % 2400).cast("double") - 300).alias("t"))


@_R.add("j3_nearest_frame", f"WITH {D.SIGNAL}, {_TIMES} SELECT q.video_id, id, t, arg_min(frame, {{'g': abs(t_ms - t), 'f': frame}}) AS frame FROM tq q JOIN s ON s.video_id = q.video_id GROUP BY q.video_id, id, t")
def nearest_frame(spark, d):
    return J.nearest(D.signal(spark, d), _times(spark, d))


@_R.add("j4_nearest_within", f"""WITH {D.SIGNAL}, {_TIMES}, e AS (SELECT video_id, min(t_ms) AS lo, max(t_ms) AS hi FROM s GROUP BY video_id), dd AS (SELECT video_id, coalesce(median(x), 0) / 2 AS slack FROM (SELECT video_id, t_ms - lag(t_ms) OVER (PARTITION BY video_id ORDER BY frame) AS x FROM s) GROUP BY video_id)
, n AS (SELECT q.video_id, id, t, arg_min(frame, {{'g': abs(t_ms - t), 'f': frame}}) AS frame FROM tq q JOIN s ON s.video_id = q.video_id GROUP BY q.video_id, id, t)
SELECT n.video_id, id, t, CASE WHEN t >= lo - slack AND t <= hi + slack THEN frame END AS frame FROM n JOIN e USING (video_id) JOIN dd USING (video_id)""")
def nearest_within(spark, d):
    return J.nearest_within(D.signal(spark, d), _times(spark, d))


_MARKS = "mk AS (SELECT video_id, frame, 'P' || (frame // 12 + 1) AS p FROM s WHERE frame % 12 = 7)"


@_R.add("j6_position_labels", f"""WITH {D.SIGNAL}, {_MARKS}, j AS (SELECT s.video_id, s.frame, mk.p FROM s LEFT JOIN mk ON mk.video_id = s.video_id AND mk.frame = s.frame)
, q AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current, first_value(p IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM j)
SELECT video_id, frame, current, CASE WHEN p IS NOT NULL THEN p WHEN current IS NULL AND nxt IS NOT NULL THEN 'before ' || nxt WHEN nxt IS NULL AND current IS NOT NULL THEN 'after ' || current WHEN current IS NOT NULL THEN current || '-' || nxt END AS between FROM q""")
def position_labels(spark, d):
    s = D.signal(spark, d)
    marks = s.where("frame % 12 = 7").select("video_id", "frame", F.concat(F.lit("P"), (F.floor(F.col("frame") / 12) + 1).cast("string")).alias("p"))
    return J.position_labels(s, marks)


@_R.add("j7_within_tolerance", f"""WITH {D.FRAMES}, a AS (SELECT session_id AS k, sequence AS id, ts_ns AS ts FROM f WHERE camera_id = 'click'), b AS (SELECT session_id AS k, sequence AS id, ts_ns AS ts FROM f WHERE camera_id = 'view')
, j AS (SELECT a.k, a.id AS a_id, b.id AS b_id, abs(a.ts - b.ts) AS gap FROM a JOIN b ON a.k = b.k AND abs(a.ts - b.ts) <= 3600000000000) SELECT k AS session_id, a_id, arg_min(b_id, {{'g': gap, 'b': b_id}}) AS b_id, min(gap) AS gap FROM j GROUP BY k, a_id""")
def within_tolerance(spark, d):
    f = D.frames(spark, d)
    side = lambda c: f.where(F.col("camera_id") == c).select("session_id", F.col("sequence").alias("id"), F.col("ts_ns").alias("ts"))
    return J.within_tolerance(side("click"), side("view"), "session_id", 3600 * 10**9)


_CLIPS = f"{D.TRIGGERS}, cl AS (SELECT t.session_id, shot_id, trigger_ns, pre_roll_ns, camera_id, sequence, ts_ns, bytes FROM t JOIN f ON f.session_id = t.session_id AND f.ts_ns BETWEEN trigger_ns - pre_roll_ns AND trigger_ns)"
_SUMMARY = f"{_CLIPS}, su AS (SELECT shot_id, camera_id, trigger_ns, pre_roll_ns, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, max(sequence) - min(sequence) + 1 - count(*) AS missing FROM cl GROUP BY ALL)"


@_R.add("j17_trigger_clips", f"WITH {_CLIPS} SELECT session_id, shot_id, camera_id, sequence, ts_ns FROM cl")
def trigger_clips(spark, d):
    return J.clips(D.triggers(spark, d), D.frames(spark, d)).select("session_id", "shot_id", "camera_id", "sequence", "ts_ns")


@_R.add("st4_clip_summary", f"WITH {_SUMMARY} SELECT shot_id, camera_id, n, first_ns, last_ns, missing, round(CASE WHEN n > 1 AND last_ns > first_ns THEN (n - 1) * 1e9 / (last_ns - first_ns) END, 9) AS fps FROM su")
def clip_summary(spark, d):
    return rounded(J.clip_summary(J.clips(D.triggers(spark, d), D.frames(spark, d))).drop("trigger_ns", "pre_roll_ns"), 9)


_ORIGIN = 1704153600 * 10**9


@_R.add("st3_pre_roll", f"WITH {_SUMMARY} SELECT shot_id, bool_or(trigger_ns - pre_roll_ns < {_ORIGIN}) AS reaches_before_origin, bool_and(trigger_ns - pre_roll_ns >= {_ORIGIN} AND first_ns <= greatest(trigger_ns - pre_roll_ns, {_ORIGIN})) AS full_pre_roll, count(*) AS cameras FROM su GROUP BY shot_id")
def pre_roll(spark, d):
    return J.pre_roll(J.clip_summary(J.clips(D.triggers(spark, d), D.frames(spark, d))), _ORIGIN)


@_R.add("j18_trimmed", f"WITH {D.SIGNAL}, {_WINDOW}, q AS (SELECT s.video_id, frame, t_ms, start_frame FROM s LEFT JOIN sw USING (video_id) WHERE start_frame IS NULL OR frame BETWEEN start_frame AND end_frame) SELECT video_id, frame, round(CASE WHEN start_frame IS NULL THEN t_ms ELSE t_ms - min(t_ms) OVER (PARTITION BY video_id) END, 6) AS t_ms FROM q")
def trimmed(spark, d):
    from motion_tables.operators.detect import swing_window

    s = D.signal(spark, d)
    return rounded(J.trimmed(s, swing_window(s)).select("video_id", "frame", "t_ms"))


@_R.add("j14_relocated_sources", """WITH pg AS (SELECT page_id, url, sha256(html) AS sha, octet_length(encode(html)) AS size FROM pages), fnd AS (SELECT url AS path, min(sha) AS sha, arg_min(size, sha) AS size FROM pg GROUP BY url)
, reg AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 1 THEN url || '.old' ELSE url END AS path, CASE WHEN page_id % 7 = 2 THEN sha256(sha) ELSE sha END AS sha, size FROM pg), el AS (SELECT sha, size, min(path) AS elsewhere FROM fnd GROUP BY ALL)
SELECT id, CASE WHEN fnd.sha = reg.sha THEN 'ok' WHEN elsewhere IS NOT NULL THEN 'relocated' WHEN fnd.sha IS NOT NULL THEN 'changed' ELSE 'missing' END AS status, CASE WHEN (fnd.sha = reg.sha) IS NOT TRUE THEN elsewhere END AS new_path FROM reg LEFT JOIN fnd ON fnd.path = reg.path LEFT JOIN el ON el.sha = reg.sha AND el.size = reg.size""")
def relocated_sources(spark, d):
    p = D.table(spark, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("size"))
    found = p.groupBy(F.col("url").alias("path")).agg(F.min(F.struct("sha", "size")).alias("s")).select("path", "s.*")
    sha = F.when(F.col("page_id") % 7 == 2, F.sha2("sha", 256)).otherwise(F.col("sha"))
    path = F.when(F.col("page_id") % 5 == 1, F.concat("url", F.lit(".old"))).otherwise(F.col("url"))
    return J.relocated(p.select(F.col("page_id").alias("id"), path.alias("path"), sha.alias("sha"), "size"), found)


@_R.add("j13_unknown_references", "SELECT l_partkey AS reference, count(*) AS n, 'unknown part' AS rule FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY l_partkey")
def unknown_references(spark, d):
    return J.unknown_references(D.table(spark, d, "lineitem"), "l_partkey", D.table(spark, d, "part").where("p_size > 5"), "p_partkey", "unknown part")


@_R.add("j19_memberships", "SELECT c_custkey AS golfer, count(DISTINCT o_orderkey) AS shots FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 3) GROUP BY c_custkey")
def memberships(spark, d):
    o = D.table(spark, d, "orders").join(D.table(spark, d, "lineitem").where("l_suppkey % 10 = 3").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return o.join(D.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").groupBy(F.col("o_custkey").alias("golfer")).agg(F.count_distinct("o_orderkey").alias("shots"))


@_R.add("j9_position_errors", f"WITH {D.POSITIONS} SELECT video_id, p, predicted - labelled AS error_frames, round((predicted - labelled) * 1000 / fps, 6) AS error_ms FROM pos")
def position_errors(spark, d):
    from motion_tables.operators.metrics import position_errors as errors

    return rounded(errors(D.positions(spark, d)).select("video_id", "p", "error_frames", "error_ms"))


@_R.add("so1_missing_positions", f"WITH {D.POSITIONS}, v AS (SELECT DISTINCT video_id FROM pos) SELECT video_id, 'P' || k AS p FROM v, (SELECT unnest(range(1, 11)) AS k) EXCEPT SELECT video_id, p FROM pos")
def missing_positions(spark, d):
    pos = D.positions(spark, d)
    order = F.array(*[F.lit(f"P{k}") for k in range(1, 11)])
    return pos.groupBy("video_id").agg(F.collect_set("p").alias("found")).select("video_id", F.explode(F.array_except(order, "found")).alias("p"))


@_R.add("so2_unlabelled_videos", f"WITH {D.POSITIONS}, {D.LABELS} SELECT DISTINCT video_id FROM pos WHERE video_id NOT IN (SELECT frame FROM l WHERE visible AND err > 0.05)")
def unlabelled_videos(spark, d):
    labelled = D.labels(spark, d).where("visible and err > 0.05").select(F.col("frame").alias("video_id"))
    return D.positions(spark, d).select("video_id").subtract(labelled)


@_R.add("so3_shared_positions", f"WITH {D.POSITIONS} SELECT a.video_id, a.p FROM pos a JOIN pos b ON b.video_id = a.video_id + 1 AND a.p = b.p")
def shared_positions(spark, d):
    pos = D.positions(spark, d).select("video_id", "p")
    return pos.intersect(pos.select((F.col("video_id") - 1).alias("video_id"), "p"))


@_R.add("so4_available_positions", f"WITH {D.POSITIONS} SELECT video_id, p FROM pos WHERE predicted % 3 = 0 UNION SELECT video_id, p FROM pos WHERE labelled % 2 = 0")
def available_positions(spark, d):
    pos = D.positions(spark, d)
    return pos.where("predicted % 3 = 0").select("video_id", "p").union(pos.where("labelled % 2 = 0").select("video_id", "p")).distinct()


@_R.add("so7_registered_copies", "SELECT o_custkey AS source, list_sort(list_distinct(list(o_orderpriority))) AS locations FROM orders GROUP BY o_custkey")
def registered_copies(spark, d):
    return D.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("locations"))


@_R.add("st7_live_metrics", f"WITH {D.FRAMES} SELECT camera_id, ts_ns // 3600000000000 AS hour, count(*) AS frames, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM f GROUP BY ALL")
def live_metrics(spark, d):
    from motion_tables.streaming.capture import live_counts

    f = D.frames(spark, d).withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
    g = live_counts(f, "1 hour")
    return g.select("camera_id", F.floor(F.unix_micros("start") / 3_600_000_000).cast("long").alias("hour"), "frames", "first_ns", "last_ns")
