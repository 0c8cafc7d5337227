"""Queries of label documents, written as JSON from the recordings' poses and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motion_tables.operators import label_documents as L
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
E = F.expr

#: What is in the documents, by SQL that both engines read over a recording's frames and joints (video_id, frame, joint, px, py).
_LISTED = "video_id < 9 AND frame % 5 = 0"
_SET = "CASE WHEN frame % 15 = 0 THEN 'benchmark' ELSE 'sequence' END"
_EXPECTED = "CASE WHEN frame % 40 <> 15 THEN concat('d', video_id, '-', frame) END"
_LABELLED = "frame % 5 = 0 OR frame % 35 = 1"
_DIGEST = "CASE WHEN frame % 20 = 5 THEN 'other' ELSE concat('d', video_id, '-', frame) END"
_SCHEMA = "CASE WHEN video_id = 8 THEN 5 ELSE 1 + video_id % 3 END"
_NAME = "CASE WHEN joint = 20 AND frame % 25 = 0 THEN 'tail' ELSE concat('j', joint) END"
_VISIBLE = "CASE WHEN (frame + joint) % 17 <> 3 THEN joint % 2 = 0 END"
_MODE = "CASE WHEN frame % 15 = 10 THEN NULL WHEN frame % 45 = 0 THEN 'odd' WHEN frame % 10 = 0 THEN 'blind' WHEN frame % 25 = 5 THEN 'blind' ELSE 'assisted' END"
_ORIGIN = "CASE frame % 4 WHEN 0 THEN 'placed' WHEN 1 THEN 'model_accepted' WHEN 2 THEN 'guess' ELSE 'model_corrected' END"


def _joints(spark, d) -> DataFrame:
    p = D.points(spark, d).where("backend = 'a'")
    return p.select("video_id", "frame", "joint", (F.col("x") * 300 + 500).alias("px"), (F.col("y") * 300 + 500).alias("py"))


def manifest_docs(spark, d) -> DataFrame:
    """A manifest for each recording."""
    f = D.pose(spark, d).where(_LISTED).select("video_id", F.struct(F.col("video_id").cast("string").alias("video"), F.col("frame").cast("int").alias("frame"), E("CASE WHEN frame % 15 <> 0 THEN 'sequence' END").alias("set"), E("CASE WHEN frame % 10 = 0 THEN true END").alias("blind"),
        E("CASE WHEN video_id % 2 = 0 THEN 'dtl' ELSE 'face_on' END").alias("view"), F.lit(10).alias("p1_frame"), F.lit(1000).alias("width"), F.lit(900).alias("height"), E(_EXPECTED).alias("image_sha1")).alias("f"))
    joints = F.array(*[F.lit(f"j{i}") for i in range(D.LANDMARKS)])
    return f.groupBy("video_id").agg(F.collect_list("f").alias("frames")).select(F.to_json(F.struct(joints.alias("joints"), "frames")).alias("doc"))


def export_docs(spark, d) -> DataFrame:
    """A label export for each recording."""
    q = _joints(spark, d).where(_LABELLED)
    place = F.struct(F.col("px").alias("x"), F.col("py").alias("y"), E(_VISIBLE).alias("visible"))
    per = q.groupBy("video_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct(E(_NAME), place))).alias("joints"))
    origins = F.map_from_arrays(E("CASE WHEN frame % 50 = 20 THEN array('j1', 'zz') ELSE array('j1') END"), F.transform(E("CASE WHEN frame % 50 = 20 THEN array(1, 2) ELSE array(1) END"), lambda _: F.struct(E(_ORIGIN).alias("origin"), E("CASE WHEN frame % 3 <> 1 THEN 'm' END").alias("model"))))
    status = F.struct(E(_MODE).alias("mode"), E("CASE WHEN frame % 30 = 0 THEN array('j3') WHEN frame % 30 = 5 THEN array('nope') ELSE CAST(array() AS array<string>) END").alias("cannot_place"), origins.alias("origins"),
        F.struct(E("CASE WHEN frame % 20 <> 5 THEN 'ann' END").alias("confirmed_by"), F.lit("2024").alias("confirmed_at")).alias("assist"))
    key = F.col("frame").cast("string")
    both = lambda v: F.map_from_entries(F.collect_list(F.struct(key, v)))
    video = per.withColumn("st", status).groupBy("video_id").agg(both(E(_DIGEST)).alias("image_sha1"), both(F.col("joints")).alias("frames"), both(F.col("st")).alias("frame_status"))
    body = F.struct(E("CASE WHEN video_id = 4 THEN 'face_on' WHEN video_id % 2 = 0 THEN 'dtl' ELSE 'face_on' END").alias("view"), E("CASE WHEN video_id = 5 THEN 11 ELSE 10 END").alias("p1_frame"), E("CASE WHEN video_id = 3 THEN ' ' ELSE 'ann' END").alias("verified_by"), "image_sha1", "frames", "frame_status")
    return video.select(F.to_json(F.struct(E(_SCHEMA).alias("schema"), E("CASE WHEN video_id = 7 THEN '' ELSE 'ann' END").alias("verified_by"), F.create_map(F.col("video_id").cast("string"), body).alias("videos"))).alias("doc"))


_VIEW = "CASE WHEN video_id % 2 = 0 THEN 'dtl' ELSE 'face_on' END"
_J = f"""{D.POSE}, jo AS (SELECT video_id, frame, j AS joint, e[3 * j + 1] * 300 + 500 AS px, e[3 * j + 2] * 300 + 500 AS py FROM p, (SELECT unnest(range({D.LANDMARKS})) AS j) WHERE {_LABELLED})
, ju AS (SELECT video_id, frame, {_NAME} AS joint, px AS x, py AS y, {_VISIBLE} AS visible, {_SCHEMA} AS schema, {_SET} AS "set", {_MODE} AS mode, {_ORIGIN} AS origin, frame % 10 = 0 AS blind,
    CASE WHEN NOT ({_LISTED}) THEN 'not a frame of the labelling set' WHEN {_SCHEMA} = 1 AND {_SET} <> 'benchmark' THEN 'schema 1 outside the benchmark' WHEN {_EXPECTED} IS NULL THEN 'no digest in the manifest' WHEN {_DIGEST} <> {_EXPECTED} THEN 'labelled on another image' END AS whole FROM jo WHERE video_id < 9)
, jr AS (SELECT *, CASE WHEN joint = 'tail' THEN 'not a labelled joint' WHEN x < 0 OR x > 1000 OR y < 0 OR y > 900 THEN 'outside the image' WHEN visible IS NULL THEN 'visible must be true or false' END AS rule FROM ju)"""


@_R.add("src4_manifest_frames", f"WITH {D.POSE} SELECT CAST(video_id AS VARCHAR) AS video, frame, {_SET} AS \"set\", frame % 10 = 0 AS blind, {_VIEW} AS \"view\", {_EXPECTED} AS image_sha1 FROM p WHERE {_LISTED}")
def manifest_frames(spark, d):
    return L.manifest_frames(manifest_docs(spark, d)).select("video", "frame", "set", "blind", "view", "image_sha1")


@_R.add("src3_label_rows", f"""WITH {_J} SELECT CAST(video_id AS VARCHAR) AS video, frame, joint, round(x, 6) AS x, round(y, 6) AS y, visible, "set", CASE WHEN schema = 3 THEN mode ELSE 'blind' END AS mode, {_VIEW} AS "view" FROM jr WHERE whole IS NULL AND rule IS NULL""")
def label_rows(spark, d):
    return rounded(L.label_rows(export_docs(spark, d), L.manifest_frames(manifest_docs(spark, d))).drop("p1_frame"))


_FINE = "mode IN ('blind', 'assisted')"


@_R.add("c3_export_violations", f"""WITH {_J}, va AS (SELECT DISTINCT video_id FROM p), fr AS (SELECT DISTINCT video_id, frame, schema, mode, origin, blind, whole, {_LISTED} AS listed FROM jr), pl AS (SELECT video_id, frame, joint FROM jr WHERE whole IS NULL AND rule IS NULL)
, st AS (SELECT fr.*, frame % 20 <> 5 AS signed, frame % 3 <> 1 AS model, EXISTS (SELECT 1 FROM pl WHERE pl.video_id = fr.video_id AND pl.frame = fr.frame AND pl.joint = 'j3') AS j3, EXISTS (SELECT 1 FROM pl WHERE pl.video_id = fr.video_id AND pl.frame = fr.frame AND pl.joint = 'j1') AS j1,
    EXISTS (SELECT 1 FROM pl WHERE pl.video_id = fr.video_id AND pl.frame = fr.frame) AS any_placed FROM fr WHERE schema IN (2, 3))
, ru AS (SELECT 'export' AS place, 'unknown schema' AS rule FROM va WHERE video_id = 8 UNION ALL SELECT 'export', 'no verified_by' FROM va WHERE video_id = 7
UNION ALL SELECT CAST(video_id AS VARCHAR), 'not in the manifest' FROM va WHERE video_id >= 9 UNION ALL SELECT CAST(video_id AS VARCHAR), 'no verified_by' FROM va WHERE video_id = 3 UNION ALL SELECT CAST(video_id AS VARCHAR), 'view differs' FROM va WHERE video_id = 4 UNION ALL SELECT CAST(video_id AS VARCHAR), 'p1_frame differs' FROM va WHERE video_id = 5
UNION ALL SELECT video_id || ' ' || frame, whole FROM fr WHERE whole IS NOT NULL UNION ALL SELECT video_id || ' ' || frame || ' ' || joint, rule FROM jr WHERE whole IS NULL AND rule IS NOT NULL
UNION ALL SELECT video_id || ' ' || frame, 'status of a frame outside the set' FROM st WHERE NOT listed UNION ALL SELECT video_id || ' ' || frame, 'cannot place an unknown point' FROM st WHERE listed AND frame % 30 = 5 UNION ALL SELECT video_id || ' ' || frame, 'placed and impossible to place' FROM st WHERE listed AND frame % 30 = 0 AND j3
UNION ALL SELECT video_id || ' ' || frame, 'mode must be blind or assisted' FROM st WHERE listed AND schema = 3 AND NOT coalesce({_FINE}, false) UNION ALL SELECT video_id || ' ' || frame, 'mode is not the manifest''s' FROM st WHERE listed AND schema = 3 AND {_FINE} AND mode <> CASE WHEN blind THEN 'blind' ELSE 'assisted' END
UNION ALL SELECT video_id || ' ' || frame, 'no mode' FROM st WHERE schema = 3 AND any_placed AND NOT coalesce({_FINE}, false) UNION ALL SELECT video_id || ' ' || frame || ' zz', 'origin of a point that is not placed' FROM st WHERE listed AND schema = 3 AND {_FINE} AND frame % 50 = 20
UNION ALL SELECT video_id || ' ' || frame || ' j1', CASE WHEN NOT j1 THEN 'origin of a point that is not placed' WHEN origin = 'guess' THEN 'unknown origin' WHEN origin LIKE 'model%' AND mode = 'blind' THEN 'model proposal on a blind frame' WHEN origin LIKE 'model%' AND NOT model THEN 'model does not produce this point' WHEN origin LIKE 'model%' AND NOT signed THEN 'model proposal without sign-off' END
    FROM st WHERE listed AND schema = 3 AND {_FINE}) SELECT place, rule FROM ru WHERE rule IS NOT NULL""")
def export_violations(spark, d):
    return L.export_violations(export_docs(spark, d), L.manifest_frames(manifest_docs(spark, d)))


#: Labels of a shot's stream: a recording's frames, every fourth.
_SHOT = {"point": "CASE WHEN joint = 19 THEN 'odd' ELSE concat('j', joint) END", "origin": "CASE joint % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'model_proposed' ELSE 'corrected' END", "model": "CASE WHEN (joint + frame) % 5 <> 0 THEN 'm' END", "placed": "(joint + frame) % 7 <> 0", "gone": "(joint + frame) % 7 = 0 OR (joint + frame) % 21 = 1"}


def shot_docs(spark, d) -> DataFrame:
    q = _joints(spark, d).where("frame % 4 = 0").withColumns({k: E(v) for k, v in _SHOT.items()})
    entries = lambda c, v: F.map_from_entries(F.array_compact(F.collect_list(F.when(E(c), F.struct("point", v)))))
    review = F.struct(E("CASE WHEN frame % 12 = 0 THEN 'reviewed' ELSE 'unreviewed' END").alias("status"), E("CASE WHEN frame % 24 = 0 THEN 'ann' END").alias("by"))
    f = q.groupBy("video_id", "frame").agg(entries("placed", F.struct(F.col("px").alias("x"), F.col("py").alias("y"), F.lit(True).alias("visible"), "origin", "model")).alias("points"), entries("gone", F.lit("hidden")).alias("unavailable"))
    f = f.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.struct("points", "unavailable", review.alias("review"))))).alias("frames"))
    positions = F.map_from_arrays(F.array(F.lit("P1"), F.lit("P7")), F.array(F.struct(F.lit(3).alias("frame"), F.lit("manual").alias("origin")), F.struct((F.col("video_id") * 9).cast("int").alias("frame"), F.lit("manual").alias("origin"))))
    body = F.struct(E("CASE WHEN video_id = 6 THEN 'sx' ELSE concat('s', video_id) END").alias("source_id"), E("CASE WHEN video_id = 5 THEN 'h' ELSE concat('h', video_id) END").alias("source_sha256"), positions.alias("positions"), "frames")
    return f.select(F.to_json(F.struct(F.concat(F.lit("o"), "video_id").alias("shot_id"), F.create_map(E("CASE WHEN video_id = 7 THEN 'c9' ELSE 'c1' END"), body).alias("streams"))).alias("doc"))


_SP = f"""{D.POSE}, sj AS (SELECT video_id, 'o' || video_id AS shot_id, CASE WHEN video_id = 7 THEN 'c9' ELSE 'c1' END AS stream_id, frame, j AS joint, e[3 * j + 1] * 300 + 500 AS x, e[3 * j + 2] * 300 + 500 AS y FROM p, (SELECT unnest(range({D.LANDMARKS})) AS j) WHERE frame % 4 = 0)
, sp AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _SHOT.items())} FROM sj)"""


@_R.add("src6_shot_points", f"WITH {_SP} SELECT shot_id, stream_id, frame, point, round(x, 6) AS x, origin, model, CAST(NULL AS VARCHAR) AS reason FROM sp WHERE placed UNION ALL SELECT shot_id, stream_id, frame, point, NULL, NULL, NULL, 'hidden' FROM sp WHERE gone")
def shot_points(spark, d):
    docs = shot_docs(spark, d)
    none = F.lit(None).cast("string")
    here = L.shot_points(docs).select("shot_id", "stream_id", "frame", "point", "x", "origin", "model", none.alias("reason"))
    gone = L.shot_unavailable(docs).select("shot_id", "stream_id", "frame", "point", F.lit(None).cast("double").alias("x"), none.alias("origin"), none.alias("model"), "reason")
    return rounded(here.unionByName(gone))


@_R.add("src6_shot_positions", f"WITH {D.POSE}, v AS (SELECT DISTINCT video_id FROM p) SELECT 'o' || video_id AS shot_id, CASE WHEN video_id = 7 THEN 'c9' ELSE 'c1' END AS stream_id, unnest(['P1', 'P7']) AS p, unnest([3, video_id * 9]) AS frame, 'manual' AS origin FROM v")
def shot_positions(spark, d):
    return L.shot_positions(shot_docs(spark, d))


_KEYED = "video_id NOT IN (6, 7, 8)"


def _catalog_streams(v):
    """The catalog's streams of recordings (video_id)."""
    return v.select(F.concat(F.lit("o"), "video_id").alias("shot_id"), F.lit("c1").alias("stream_id"), F.concat(F.lit("s"), "video_id").alias("source_id"), F.concat(F.lit("h"), "video_id").alias("sha256"), F.lit(40).alias("frame_count"), F.lit(1000).alias("width"), F.lit(900).alias("height"))


@_R.add("c2_shot_label_violations", f"""WITH {_SP}, v AS (SELECT DISTINCT video_id, shot_id, stream_id FROM sp), f AS (SELECT DISTINCT video_id, shot_id, stream_id, frame FROM sp)
SELECT shot_id AS place, 'unknown shot' AS rule FROM v WHERE video_id = 8 UNION ALL SELECT shot_id || ' ' || stream_id, CASE video_id WHEN 7 THEN 'no such stream' WHEN 6 THEN 'labelled on another source' ELSE 'labelled on other bytes' END FROM v WHERE video_id IN (5, 6, 7)
UNION ALL SELECT shot_id || ' ' || stream_id || ' P7', 'frame outside the source' FROM v WHERE {_KEYED} AND video_id * 9 >= 40 UNION ALL SELECT shot_id || ' ' || stream_id || ' ' || frame, 'frame outside the source' FROM f WHERE {_KEYED} AND frame >= 40
UNION ALL SELECT shot_id || ' ' || stream_id || ' ' || frame, 'review without a reviewer' FROM f WHERE {_KEYED} AND frame % 12 = 0 AND frame % 24 <> 0
UNION ALL SELECT * FROM (SELECT shot_id || ' ' || stream_id || ' ' || frame || ' ' || point, CASE WHEN point = 'odd' THEN 'not a known point' WHEN x < 0 OR x > 1000 OR y < 0 OR y > 900 THEN 'outside the image' WHEN origin <> 'manual' AND model IS NULL THEN 'origin without the model''s name' END AS rule FROM sp WHERE {_KEYED} AND placed) WHERE rule IS NOT NULL
UNION ALL SELECT * FROM (SELECT shot_id || ' ' || stream_id || ' ' || frame || ' ' || point, CASE WHEN point = 'odd' THEN 'not a known point' WHEN placed THEN 'both placed and unavailable' END AS rule FROM sp WHERE {_KEYED} AND gone) WHERE rule IS NOT NULL""")
def shot_label_violations(spark, d):
    streams = _catalog_streams(D.pose(spark, d).select("video_id").distinct().where("video_id <> 8"))
    return L.shot_label_violations(shot_docs(spark, d), streams, [f"j{i}" for i in range(D.LANDMARKS) if i != 19])


@_R.add("c7_freeze_problems", f"""WITH v AS (SELECT DISTINCT label AS video_id FROM embeddings WHERE label <> 8) SELECT 'o' || video_id AS shot_id, 'source s' || video_id || ' is ' || CASE WHEN video_id % 4 = 2 THEN 'changed' ELSE 'missing' END AS problem FROM v WHERE video_id % 4 >= 2
    UNION ALL SELECT split_part(place, ' ', 1), place || ': ' || rule FROM ({ORACLE_SQL['c2_shot_label_violations']})""")
def freeze_problems(spark, d):
    """What stands against freezing the shots: states of their sources, and all rules that their labels break."""
    from motion_tables.operators.snapshots import freeze_problems as problems

    v = D.pose(spark, d).select("video_id").distinct().where("video_id <> 8")
    streams = _catalog_streams(v)
    states = v.where("video_id % 4 < 3").select(F.concat(F.lit("s"), "video_id").alias("id"), F.when(F.col("video_id") % 4 == 0, "ok").when(F.col("video_id") % 4 == 1, "relocated").otherwise("changed").alias("status"))
    images = streams.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("frame"), F.lit("i").alias("digest"))
    return problems(streams, states, shot_docs(spark, d), images, [f"j{i}" for i in range(D.LANDMARKS) if i != 19])
