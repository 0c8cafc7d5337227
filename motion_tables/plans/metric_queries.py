"""Queries of scores and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.operators import metrics as M
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_PCK = ", ".join(f"round(avg(CASE WHEN err <= {t}::DOUBLE THEN 1 ELSE 0 END), 6) AS pck_{str(t).replace('.', '_')}" for t in M.THRESHOLDS)
_ERR = f"count(*) AS n, round(avg(CASE WHEN err IS NULL THEN 1 ELSE 0 END), 6) AS missing, round(avg(err), 6) AS mean_err, round(median(err), 6) AS median_err, {_PCK}"


@_R.add("a1_position_mae", f"WITH {D.POSITIONS}, e AS (SELECT p, predicted - labelled AS f, (predicted - labelled) * 1000 / fps AS m FROM pos) SELECT p, round(avg(abs(f)), 6) AS mae_frames, round(stddev_pop(abs(f)), 6) AS std_frames, round(avg(abs(m)), 6) AS mae_ms, count(*) AS n FROM e GROUP BY GROUPING SETS ((p), ())")
def position_mae(spark, d):
    return rounded(M.position_mae(M.position_errors(D.positions(spark, d))))


@_R.add("a2_error_summary", f"WITH {D.LABELS} SELECT video_id, backend, {_ERR} FROM l GROUP BY ALL")
def error_summary(spark, d):
    return rounded(M.error_summary(D.labels(spark, d), ["video_id", "backend"]))


@_R.add("a3_frame_counts", f"WITH {D.LABELS}, q AS (SELECT backend, video_id, frame, count(*) AS n, count(*) FILTER (WHERE err IS NULL) AS missed FROM l GROUP BY ALL) SELECT backend, count(*) AS frames, count(*) FILTER (WHERE n = missed) AS frames_missed, CAST(sum(missed) AS BIGINT) AS joints_missed FROM q GROUP BY backend")
def frame_counts(spark, d):
    return M.frame_counts(D.labels(spark, d))


@_R.add("a4_group_summary", f"WITH {D.LABELS} SELECT backend, view, CASE WHEN visible THEN 'visible' WHEN NOT visible THEN 'hidden' END AS seen, joint, CAST(grouping_id(backend, view, visible, joint) AS BIGINT) AS level, {_ERR} FROM l GROUP BY GROUPING SETS ((backend, view), (backend, view, visible), (backend, view, joint))")
def group_summary(spark, d):
    g = M.group_summary(D.labels(spark, d))
    return rounded(g.withColumn("seen", F.when(F.col("visible"), "visible").when(~F.col("visible"), "hidden")).drop("visible"))


@_R.add("a5_label_coverage", f"WITH {D.LABELS} SELECT view, count(*) AS labelled, count(*) FILTER (WHERE NOT visible) AS hidden, count(DISTINCT video_id) AS videos, count(*) FILTER (WHERE backend = 'F') AS points_f, count(*) FILTER (WHERE backend = 'O') AS points_o FROM l GROUP BY view")
def label_coverage(spark, d):
    return M.coverage(D.labels(spark, d)).na.fill(0, ["points_f", "points_o"])


_VALID = f"{D.POINTS}, va AS (SELECT *, detected AND x IS NOT NULL AND y IS NOT NULL AND (conf IS NULL OR conf >= min_conf) AS valid FROM pts)"
_PICK = ", ".join(f"max(CASE WHEN joint = {j} THEN {a} END) AS {n}{a}" for j, n in ((1, "ls"), (2, "rs"), (13, "lh"), (14, "rh")) for a in "xy")
_SCALE = f"""{_VALID}, to0 AS (SELECT video_id, backend, frame, {_PICK} FROM va WHERE valid GROUP BY ALL)
, tor AS (SELECT video_id, backend, frame, sqrt(power((lsx + rsx - lhx - rhx) / 2, 2) + power((lsy + rsy - lhy - rhy) / 2, 2)) AS torso FROM to0), sca AS (SELECT video_id, backend, median(torso) AS scale FROM tor WHERE torso IS NOT NULL GROUP BY ALL)"""
_SPIKE = f"""{_SCALE}, sp0 AS (SELECT video_id, backend, joint, CASE WHEN valid AND lag(valid) OVER w AND lead(valid) OVER w THEN sqrt(power(x - (lag(x) OVER w + lead(x) OVER w) / 2, 2) + power(y - (lag(y) OVER w + lead(y) OVER w) / 2, 2)) END AS dev FROM va WINDOW w AS (PARTITION BY video_id, backend, joint ORDER BY frame))
, spk AS (SELECT s.video_id, s.backend, joint, quantile_cont(dev / scale, 0.99) AS p99, avg(CASE WHEN dev / scale > 0.2 THEN 1 ELSE 0 END) AS rate FROM sp0 s JOIN sca USING (video_id, backend) WHERE dev IS NOT NULL GROUP BY ALL)"""
_SWAP = f"""{_SCALE}, jp AS (SELECT unnest(['shoulder', 'elbow', 'wrist', 'hip', 'knee', 'ankle']) AS part, unnest([1, 3, 5, 13, 15, 17]) AS lj)
, sd AS (SELECT video_id, backend, part, frame, max(CASE WHEN joint = lj THEN x END) AS lx, max(CASE WHEN joint = lj THEN y END) AS ly, max(CASE WHEN joint = lj + 1 THEN x END) AS rx, max(CASE WHEN joint = lj + 1 THEN y END) AS ry, bool_and(valid) AS ok FROM va JOIN jp ON joint IN (lj, lj + 1) GROUP BY ALL)
, mo AS (SELECT video_id, backend, part, ok AND lag(ok) OVER w AS both_, sqrt(power(lx - lag(lx) OVER w, 2) + power(ly - lag(ly) OVER w, 2)) + sqrt(power(rx - lag(rx) OVER w, 2) + power(ry - lag(ry) OVER w, 2)) AS keep, sqrt(power(lx - lag(rx) OVER w, 2) + power(ly - lag(ry) OVER w, 2)) + sqrt(power(rx - lag(lx) OVER w, 2) + power(ry - lag(ly) OVER w, 2)) AS swap FROM sd WINDOW w AS (PARTITION BY video_id, backend, part ORDER BY frame))
, swp AS (SELECT mo.video_id, mo.backend, part, count(*) FILTER (WHERE both_ AND keep > 0.1::DOUBLE * scale AND swap < 0.5::DOUBLE * keep) AS events, count(*) FILTER (WHERE both_) AS checked FROM mo JOIN sca USING (video_id, backend) GROUP BY ALL)"""


@_R.add("a6_detection_rates", f"WITH {_VALID} SELECT video_id, backend, joint, round(avg(CASE WHEN detected THEN 1 ELSE 0 END), 6) AS detection_rate, round(avg(CASE WHEN valid THEN 1 ELSE 0 END), 6) AS valid_rate FROM va GROUP BY ALL")
def detection_rates(spark, d):
    return rounded(M.rates(D.points(spark, d)))


@_R.add("a7_body_scales", f"WITH {_SCALE} SELECT video_id, backend, round(scale, 6) AS scale FROM sca")
def body_scales(spark, d):
    return rounded(M.body_scales(D.points(spark, d)))


@_R.add("a8_spikes", f"WITH {_SPIKE} SELECT video_id, backend, joint, round(p99, 5) AS p99, round(rate, 5) AS rate FROM spk")
def spikes(spark, d):
    return rounded(M.spike_summary(D.points(spark, d)), 5)


@_R.add("a9_swaps", f"WITH {_SWAP} SELECT video_id, backend, part, events, checked FROM swp")
def swaps(spark, d):
    return M.swap_counts(D.points(spark, d))


@_R.add("a10_agreement", f"WITH {_SCALE}, ab AS (SELECT a.video_id, a.joint, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM va a JOIN va b ON a.video_id = b.video_id AND a.frame = b.frame AND a.joint = b.joint AND a.backend = 'a' AND b.backend = 'b' WHERE a.valid AND b.valid) SELECT ab.video_id, joint, round(median(dist / scale), 5) AS median_distance, count(*) AS n FROM ab JOIN sca ON sca.video_id = ab.video_id AND sca.backend = 'a' GROUP BY ALL")
def agreement(spark, d):
    return rounded(M.agreement(D.points(spark, d)), 5)


@_R.add("a11_behaviour", f"""WITH {_SPIKE}, {_SWAP[len(_SCALE) + 2:]}, ra AS (SELECT video_id, backend, joint, avg(CASE WHEN detected THEN 1 ELSE 0 END) AS dr, avg(CASE WHEN valid THEN 1 ELSE 0 END) AS vr FROM va GROUP BY ALL), r2 AS (SELECT video_id, backend, avg(dr) AS detection_rate, avg(vr) AS valid_rate FROM ra GROUP BY ALL)
SELECT r2.video_id, r2.backend, round(detection_rate, 5) AS detection_rate, round(valid_rate, 5) AS valid_rate, round(m, 5) AS median_p99, swaps FROM r2 LEFT JOIN (SELECT video_id, backend, median(p99) AS m FROM spk GROUP BY ALL) s USING (video_id, backend) LEFT JOIN (SELECT video_id, backend, CAST(sum(events) AS BIGINT) AS swaps FROM swp GROUP BY ALL) w USING (video_id, backend)""")
def behaviour(spark, d):
    return rounded(M.behaviour(D.points(spark, d)), 5)


@_R.add("a12_paired_bootstrap")
def paired_bootstrap(spark, d):
    return M.paired_bootstrap(D.labels(spark, d), "F", "O", 0.05)


@_R.add("a14_frame_rate", f"WITH {D.SIGNAL}, q AS (SELECT video_id, raw_ms - lag(raw_ms) OVER (PARTITION BY video_id ORDER BY frame) AS d FROM s), g AS (SELECT video_id, median(d) AS m, avg(d) AS a, min(d) AS lo, max(d) AS hi FROM q GROUP BY video_id) SELECT video_id, round(CASE WHEN m > 0 THEN 1000 / m ELSE 60 END, 9) AS fps, round(CASE WHEN a > 0 THEN 1000 / a ELSE 60 END, 9) AS average_fps, coalesce(hi - lo > 0.02::DOUBLE * a, false) AS variable FROM g")
def frame_rate(spark, d):
    return rounded(M.frame_rate(D.signal(spark, d)), 9)


@_R.add("a16_z_scores", f"WITH {D.POSE}, fe AS (SELECT video_id, frame, k AS feature, e[k + 1] AS value FROM p, (SELECT unnest(range(63)) AS k)), w AS (SELECT *, avg(value) OVER (PARTITION BY video_id, feature) AS m, stddev_pop(value) OVER (PARTITION BY video_id, feature) AS sd FROM fe) SELECT video_id, frame, feature, round((value - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 4) + 0 AS z FROM w")
def z_scores(spark, d):
    lm = F.transform("lm", lambda q: F.array(q["x"], q["y"], q["z"]))
    f = D.pose(spark, d).select("video_id", "frame", F.posexplode(F.flatten(lm)).alias("feature", "value"))
    return rounded(M.z_scores(f).select("video_id", "frame", "feature", "z"), 4)


@_R.add("a23_repeated_images", "SELECT lang AS grp, md5(text) AS digest, count(*) AS n, list_sort(list(doc_id)) AS ids FROM documents GROUP BY ALL HAVING count(*) > 1")
def repeated_images(spark, d):
    f = D.table(spark, d, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    return M.repeated_images(f).select("grp", "digest", "n", "ids")


@_R.add("a20_catalog_listing", "SELECT n_name AS owner, count(DISTINCT s_suppkey) AS sources, count(DISTINCT c_custkey) AS golfers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def catalog_listing(spark, d):
    n, s, c = (D.table(spark, d, t) for t in ("nation", "supplier", "customer"))
    s = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("sources"))
    c = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("golfers"))
    return n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select(F.col("n_name").alias("owner"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("golfers", F.lit(0)).alias("golfers"))


@_R.add("a24_label_torso", f"WITH {_SCALE} SELECT video_id, backend, round(torso, 6) AS torso FROM tor WHERE frame = 7 AND torso > 0")
def label_torso(spark, d):
    return rounded(M.torso_lengths(D.points(spark, d)).where("frame = 7 and torso > 0").drop("frame"))
