"""Queries of label jobs and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import labels as L
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


@_R.add("j5_current_labels", f"WITH {D.SIGNAL}, mk AS (SELECT video_id, frame, 'P' || (frame // 12 + 1) AS p FROM s WHERE frame % 12 = 7) SELECT s.video_id, s.frame, last_value(mk.p IGNORE NULLS) OVER (PARTITION BY s.video_id ORDER BY s.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM s LEFT JOIN mk ON mk.video_id = s.video_id AND mk.frame = s.frame")
def current_labels(spark, d):
    s = D.signal(spark, d)
    return L.current_labels(s, s.where("frame % 12 = 7").select("video_id", "frame", F.concat(F.lit("P"), (F.floor(F.col("frame") / 12) + 1).cast("string")).alias("p")))


@_R.add("j8_label_errors", f"""WITH {D.POINTS}, la AS (SELECT video_id, frame, joint, x + 0.02::DOUBLE * (frame % 4) AS x, y FROM pts WHERE backend = 'a' AND frame % 3 = 0), pr AS (SELECT video_id, frame, joint, x, y FROM pts WHERE backend = 'b' AND conf >= min_conf AND detected)
, sc AS (SELECT video_id, sqrt(power(({x(1)} + {x(2)} - {x(13)} - {x(14)}) / 2, 2) + power(({y(1)} + {y(2)} - {y(13)} - {y(14)}) / 2, 2)) AS scale FROM p WHERE frame = 0)
SELECT la.video_id, la.frame, la.joint, round(sqrt(power(pr.x - la.x, 2) + power(pr.y - la.y, 2)) / sc.scale, 6) AS err FROM la JOIN sc ON sc.video_id = la.video_id LEFT JOIN pr ON pr.video_id = la.video_id AND pr.frame = la.frame AND pr.joint = la.joint""")
def label_errors(spark, d):
    p = D.points(spark, d)
    labels = p.where("backend = 'a' and frame % 3 = 0").select("video_id", "frame", "joint", (F.col("x") + 0.02 * (F.col("frame") % 4)).alias("x"), "y")
    lm = F.col("lm")
    torso = F.hypot(*[P.mid(P.at(lm, P.L_SHOULDER), P.at(lm, P.R_SHOULDER), k) - P.mid(P.at(lm, P.L_HIP), P.at(lm, P.R_HIP), k) for k in "xy"])
    scales = D.pose(spark, d).where("frame = 0").select("video_id", torso.alias("scale"))  # the torso at the first position
    return rounded(L.label_errors(labels, p.where("backend = 'b' and conf >= min_conf and detected"), scales))


@_R.add("j12_resolved_positions", f"""WITH {D.POSITIONS} SELECT a.video_id, a.p, coalesce(CASE WHEN a.predicted % 3 = 0 THEN a.predicted END, CASE WHEN a.predicted % 3 = 1 THEN CAST(round_even(a.labelled * 1000 / a.fps * a.fps / 1000, 0) AS BIGINT) END, CAST(round_even(b.labelled * 1000 / b.fps * a.fps / 1000, 0) AS BIGINT)) AS frame,
    CASE WHEN a.predicted % 3 = 0 THEN 'frame' WHEN a.predicted % 3 = 1 THEN 'time' WHEN b.p IS NOT NULL THEN 'partner' ELSE 'missing' END AS source FROM pos a LEFT JOIN pos b ON b.video_id = a.video_id + 1 AND b.p = a.p""")
def resolved_positions(spark, d):
    pos = D.positions(spark, d)
    ms = F.col("labelled") * 1000 / F.col("fps")
    own = pos.select("video_id", "p", F.when(F.col("predicted") % 3 == 0, F.col("predicted")).alias("frame"), F.when(F.col("predicted") % 3 == 1, ms).alias("t_ms"))
    return L.resolved_positions(pos.select("video_id", "p", "fps"), own, pos.select((F.col("video_id") - 1).alias("video_id"), "p", ms.alias("t_ms")))


_DIGESTS = "fi AS (SELECT lang AS id, doc_id AS frame, md5(text) AS digest FROM documents), pl AS (SELECT lang AS id, doc_id AS frame, CASE WHEN doc_id % 5 = 0 THEN md5(text || 'x') WHEN doc_id % 7 = 0 THEN NULL ELSE md5(text) END AS sha FROM documents)"


def _digests(spark, d):
    t = D.table(spark, d, "documents")
    sha = F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("x")))).when(F.col("doc_id") % 7 != 0, F.md5("text"))
    key = [F.col("lang").alias("id"), F.col("doc_id").alias("frame")]
    return t.select(*key, sha.alias("sha")), t.where("doc_id % 11 <> 2").select(*key, F.md5("text").alias("digest"))


@_R.add("j15_identity_problems", f"WITH {_DIGESTS} SELECT pl.id, pl.frame, CASE WHEN digest IS NULL THEN 'frame not in the index' ELSE 'another image' END AS problem FROM pl LEFT JOIN (SELECT * FROM fi WHERE frame % 11 <> 2) f ON f.id = pl.id AND f.frame = pl.frame WHERE digest IS NULL OR digest <> sha")
def identity_problems(spark, d):
    return L.identity_problems(*_digests(spark, d))


@_R.add("j16_carried_labels", f"WITH {_DIGESTS}, r AS (SELECT pl.id, pl.frame, CASE WHEN digest IS NULL THEN 'frame no longer shown' WHEN sha IS NULL THEN 'no digest recorded' WHEN sha <> digest THEN 'image changed' END AS reason FROM pl LEFT JOIN (SELECT * FROM fi WHERE frame % 11 <> 2) f ON f.id = pl.id AND f.frame = pl.frame) SELECT id, frame, reason IS NULL AS kept, reason FROM r")
def carried_labels(spark, d):
    return L.carried(*_digests(spark, d))


@_R.add("d7_shaft_positions")
def shaft_positions(spark, d):
    a, b = P.at(F.col("lm"), 7), P.at(F.col("lm"), 8)
    p = D.pose(spark, d)
    s = p.select("video_id", "frame", "t_ms", F.when(F.col("frame") % 9 != 4, F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"]))).alias("angle"))
    n = p.groupBy("video_id").agg(F.count("*").alias("n"))
    at = lambda k: F.floor(F.col("n") * k / 10).cast("int")
    span = lambda name, lo, hi, last: F.struct(F.lit(name).alias("p"), at(lo).alias("lo"), at(hi).alias("hi"), F.lit(last).alias("last"))
    spans = n.select("video_id", F.explode(F.array(span("P2", 1, 4, False), span("P6", 4, 7, True), span("P8", 7, 9, False))).alias("s")).select("video_id", "s.*")
    return L.shaft_positions(s, spans)


@_R.add("w10_repaired_times", f"""WITH RECURSIVE {D.SIGNAL}, g AS MATERIALIZED (SELECT video_id, frame, CASE WHEN frame % 8 = 3 THEN NULL WHEN frame % 8 = 6 THEN t_ms - 60 ELSE t_ms END AS t FROM s)
, r AS (SELECT video_id, frame, coalesce(t, 0) AS t_ms, t IS NULL AS estimated FROM g WHERE frame = 0 UNION ALL SELECT g.video_id, g.frame, CASE WHEN t IS NULL THEN r.t_ms + 16.67::DOUBLE WHEN t <= r.t_ms THEN greatest(g.frame * 1000 / 60.0::DOUBLE, r.t_ms + 0.001::DOUBLE) ELSE t END, t IS NULL OR t <= r.t_ms FROM r JOIN g ON g.video_id = r.video_id AND g.frame = r.frame + 1)
SELECT video_id, frame, round(t_ms, 6) AS t_ms, estimated FROM r""")
def repaired_times(spark, d):
    s = D.signal(spark, d).withColumn("t_ms", F.when(F.col("frame") % 8 == 3, None).when(F.col("frame") % 8 == 6, F.col("t_ms") - 60).otherwise(F.col("t_ms")))
    return rounded(L.repaired_times(s))


@_R.add("src1_position_rows", f"WITH {D.POSITIONS} SELECT CAST(video_id AS VARCHAR) AS video_id, p, predicted AS frame FROM pos")
def position_rows(spark, d):
    """Positions written as one JSON document a recording, and read back as rows."""
    pos = D.positions(spark, d).select("video_id", "p", F.col("predicted").alias("frame"))
    docs = L.position_documents(pos).select(F.concat(F.lit('{"'), F.col("video_id").cast("string"), F.lit('":'), "doc", F.lit("}")).alias("doc"))
    return L.position_rows(docs).select("video_id", "p", "frame")


@_R.add("so5_benchmark_labels", f"WITH {D.LABELS} SELECT backend, video_id, frame, joint FROM l WHERE video_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def benchmark_labels(spark, d):
    return D.labels(spark, d).join(D.table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("video_id")), "video_id", "left_semi").select("backend", "video_id", "frame", "joint")


@_R.add("d26_primary_models", f"WITH {D.POSE} SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY md5('p' || video_id || '-' || frame)) % 2 AS first_choice FROM p")
def primary_models(spark, d):
    from pyspark.sql import Window

    order = F.md5(F.concat(F.lit("p"), F.col("video_id").cast("string"), F.lit("-"), F.col("frame").cast("string")))
    return D.pose(spark, d).select("video_id", "frame", (F.row_number().over(Window.partitionBy("video_id").orderBy(order)) % 2).alias("first_choice"))


@_R.add("src2_ground_truth", f"""WITH {D.POSITIONS}, gt AS (SELECT *, 'v' || video_id AS path, CAST(substr(p, 2) AS INTEGER) AS k FROM pos WHERE video_id % 9 <> 4)
SELECT path, p, CASE WHEN k % 4 = 1 THEN CAST(round_even(labelled * 16.6 * CASE WHEN video_id % 3 = 0 THEN 25.0::DOUBLE ELSE fps END / 1000, 0) AS BIGINT) ELSE labelled END AS frame, CASE WHEN video_id % 3 = 0 THEN 25.0::DOUBLE ELSE fps END AS fps FROM gt WHERE k % 4 <> 3""")
def ground_truth(spark, d):
    """Documents of many videos each: frames, times, bare frames and notes alone; a third of the videos have a rate of their own."""
    pos = D.positions(spark, d).withColumn("path", F.concat(F.lit("v"), F.col("video_id").cast("string"))).withColumn("k", F.substring("p", 2, 9).cast("int") % 4)
    said = F.when(F.col("k") == 0, F.concat(F.lit('{"frame": '), "labelled", F.lit("}"))).when(F.col("k") == 1, F.concat(F.lit('{"timestamp_ms": '), F.col("labelled") * 16.6, F.lit("}"))).when(F.col("k") == 2, F.col("labelled").cast("string")).otherwise('{"note": "unsure"}')
    v = pos.groupBy("path", "video_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "p", F.lit('": '), said))), ", ").alias("entries"))
    video = F.concat(F.lit('{"path": "'), "path", F.lit('", "fps": '), F.when(F.col("video_id") % 3 == 0, "25.0").otherwise("null"), F.lit(', "positions": {'), "entries", F.lit('}, "notes": "x"}'))
    docs = v.groupBy((F.col("video_id") % 9).alias("file")).agg(F.array_join(F.collect_list(video), ", ").alias("videos"))
    docs = docs.select(F.when(F.col("file") == 4, '{"metadata": {}}').otherwise(F.concat(F.lit('{"videos": ['), "videos", F.lit('], "metadata": {"version": "1.0"}}'))).alias("doc"))
    return L.ground_truth(docs, pos.select("path", "fps").distinct())


@_R.add("snk1_swing_documents", f"""WITH {D.POSITIONS} SELECT video_id AS pair_id, p, round_even(predicted * 1000 / 60.0::DOUBLE, 1) AS t_ms, round_even((predicted % 97) / 96.0::DOUBLE, 3) AS confidence, CASE WHEN predicted % 3 = 0 THEN 'dtl' ELSE 'face_on' END AS detected_in, predicted AS face_on, CASE WHEN video_id % 2 = 0 THEN predicted + 2 END AS dtl, 'v' || video_id || '.mp4' AS path FROM pos""")
def swing_documents(spark, d):
    """A document for each swing, read back."""
    pos = D.positions(spark, d).withColumnRenamed("video_id", "pair_id")
    found = pos.select("pair_id", "p", (F.col("predicted") * 1000 / F.lit(60.0)).alias("t_ms"), (F.col("predicted") % 97 / F.lit(96.0)).alias("confidence"), F.lit("kinematic").alias("method"), F.when(F.col("predicted") % 3 == 0, "dtl").otherwise("face_on").alias("view"), F.col("predicted").alias("face_on"), F.when(F.col("pair_id") % 2 == 0, F.col("predicted") + 2).alias("dtl"))
    swings = pos.select("pair_id").distinct().select("pair_id", F.lit("right").alias("handedness"), F.lit("impact").alias("alignment"), F.lit(3.5).alias("offset_ms"), F.array(F.lit("not detected: P10")).alias("warnings"))
    views = swings.select("pair_id", F.explode(F.array(F.lit("face_on"), F.lit("dtl"))).alias("view")).withColumn("path", F.concat(F.lit("v"), F.col("pair_id").cast("string"), F.lit(".mp4"))).withColumn("fps", F.lit(60.0)).withColumn("frame_count", F.lit(300))
    docs = L.swing_documents(found, views, swings)
    read = F.from_json("doc", "views map<string,struct<path:string>>, positions map<string,struct<timestamp_ms:double,confidence:double,detected_in:string,frames:struct<face_on:bigint,dtl:bigint>>>")
    e = docs.select("pair_id", read.alias("d")).select("pair_id", F.col("d.views")["dtl"]["path"].alias("path"), F.explode("d.positions").alias("p", "v"))
    return e.select("pair_id", "p", F.col("v.timestamp_ms").alias("t_ms"), "v.confidence", "v.detected_in", "v.frames.face_on", "v.frames.dtl", "path")
