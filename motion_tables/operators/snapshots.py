"""Catalog documents, content-addressed snapshots of collections, setup readiness, reports and annotations as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions.json import canonical_text
from motion_tables.operators.catalog import reasons
from motion_tables.operators.geometry import is_rigid
from motion_tables.operators.label_documents import shot_label_violations

# Setup measurements, with the views that show them, the points they need, and groups of points of which one must be whole.
MEASUREMENTS = {
    "ball_position": (["face_on"], ["ball_center"], [["left_ankle", "right_ankle"], ["left_heel", "right_heel"], ["left_shoe_toe_contact", "right_shoe_toe_contact"]]),
    "ball_distance": (["down_the_line"], ["ball_center"], [["left_shoe_toe_contact", "right_shoe_toe_contact"], ["left_big_toe", "right_big_toe"]]),
    "stance_width": (["face_on"], [], [["left_heel", "right_heel"], ["left_ankle", "right_ankle"]]),
    "spine_inclination": (["down_the_line"], ["left_shoulder", "right_shoulder", "left_hip", "right_hip"], [["floor_a", "floor_b"]]),
    "hip_flexion": (["down_the_line"], ["left_shoulder", "right_shoulder", "left_hip", "right_hip", "left_knee", "right_knee"], []),
    "knee_flexion": (["down_the_line"], ["left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"], []),
    "hand_position": (["face_on", "down_the_line"], ["left_wrist", "right_wrist"], [["left_hip", "right_hip"]]),
    "shoulder_alignment": (["down_the_line"], ["left_shoulder", "right_shoulder"], []),
    "pelvis_alignment": (["down_the_line"], ["left_hip", "right_hip"], []),
    "shaft_orientation": (["face_on", "down_the_line"], ["shaft_butt", "shaft_hosel"], []),
}
CATALOG = "struct<schema_version:int,revision:bigint,records:array<map<string,string>>>"
CALIBRATION = "struct<calibration_id:string,cameras:array<struct<camera_id:string,width:int,height:int,rotation:array<double>,translation:array<double>>>>"


def canonical_sha256(document: Column, text: bool = False) -> Column:
    """SHA-256 of the canonical text of a struct, nulls kept, or of a JSON text: the order of fields and keys is of no account at any depth."""
    return F.sha2(canonical_text(document if text else F.to_json(document, {"ignoreNullFields": "false"})), 256)


def catalog_records(docs: DataFrame, id_field: str) -> DataFrame:
    """id, record (map), revision and duplicate (whether the id stands more than once) of a catalog document's records; no document is an empty catalog."""
    r = docs.select(F.from_json("doc", CATALOG).alias("d")).select("d.revision", F.explode("d.records").alias("record")).withColumn("id", F.try_element_at("record", F.lit(id_field)))
    n = r.groupBy("id").agg(F.count("*").alias("n"))
    return r.join(n, "id").select("id", "record", "revision", (F.col("n") > 1).alias("duplicate"))


def calibration_cameras(docs: DataFrame) -> DataFrame:
    """The cameras of calibrations, with ``rigid``, whether the rotation is one."""
    c = docs.select(F.from_json("doc", CALIBRATION).alias("d")).select("d.calibration_id", F.explode("d.cameras").alias("c")).select("calibration_id", "c.*")
    return c.withColumn("rigid", F.coalesce((F.size("rotation") == 9) & (F.size("translation") == 3) & is_rigid(F.col("rotation")), F.lit(False)))


_IMAGES = "struct<shot_id:string,streams:map<string,struct<source_id:string,frames:map<string,struct<image_sha1:string>>>>>"


def freeze_problems(streams: DataFrame, states: DataFrame, labels: DataFrame, images: DataFrame, known_points: list[str]) -> DataFrame:
    """shot_id, problem: everything that stands against freezing shots, from the checks themselves.

    ``streams``: shot_id, stream_id, source_id, sha256, frame_count, width, height; ``states``: id, status of sources as ``relocated`` gives them (a source without a row is missing); ``labels``: doc, the shots' label documents, which must break no rule of
    ``shot_label_violations``; ``images``: source_id, frame, digest of usable sources' frames: each labelled frame with an image's digest must be there with that digest.
    """
    usable = states.withColumnRenamed("id", "source_id").select("source_id", "status")
    s = streams.select("shot_id", "source_id").distinct().join(usable, "source_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    gone = s.where("status not in ('ok', 'relocated')").select("shot_id", F.concat_ws(" ", F.lit("source"), "source_id", F.lit("is"), "status").alias("problem"))
    broken = shot_label_violations(labels, streams, known_points).select(F.split_part("place", F.lit(" "), F.lit(1)).alias("shot_id"), F.concat_ws(": ", "place", "rule").alias("problem"))
    f = labels.select(F.from_json("doc", _IMAGES).alias("d")).select("d.shot_id", F.explode("d.streams").alias("stream_id", "t")).select("shot_id", "stream_id", "t.source_id", F.explode("t.frames").alias("frame", "f"))
    f = f.withColumn("frame", F.expr("try_cast(frame AS bigint)")).withColumn("sha", F.col("f.image_sha1")).where("sha is not null").join(usable.where("status in ('ok', 'relocated')"), "source_id", "left_semi")
    seen = f.join(images.select("source_id", F.col("frame").cast("long").alias("frame"), "digest"), ["source_id", "frame"], "left")
    why = F.when(F.col("digest").isNull(), "frame not in the index").when(F.col("digest") != F.col("sha"), "another image")
    other = seen.select("shot_id", F.concat(F.concat_ws(" ", "shot_id", "stream_id", "frame"), F.lit(": "), why).alias("problem")).where("problem is not null")
    return gone.unionByName(broken).unionByName(other)


def shot_texts(shots: DataFrame, streams: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """shot_id, shot: the canonical text of all that a shot is frozen with: its record, its sources' records in order of their ids, its labels and their hash (null without labels).

    ``shots``: shot_id, record (JSON text); ``streams``: shot_id, source_id; ``sources``: source_id, record; ``labels``: shot_id, doc.
    """
    own = streams.select("shot_id", "source_id").distinct().join(sources.select("source_id", F.col("record").alias("source")), "source_id")
    own = own.groupBy("shot_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "source"))).alias("sources"))
    j = shots.join(own, "shot_id", "left").join(labels.select("shot_id", "doc"), "shot_id", "left")
    sha = F.coalesce(F.concat(F.lit('"'), canonical_sha256(F.col("doc"), text=True), F.lit('"')), F.lit("null"))
    text = F.concat(F.lit('{"annotations":'), F.coalesce("doc", F.lit("null")), F.lit(',"annotations_sha256":'), sha, F.lit(',"shot":'), "record", F.lit(',"sources":['), F.array_join(F.coalesce(F.col("sources.source"), F.array().cast("array<string>")), ","), F.lit("]}"))
    return j.select("shot_id", canonical_text(text).alias("shot"))


def frozen(collections: DataFrame, members: DataFrame, problems: DataFrame, who: str | None, when: str) -> DataFrame:
    """What freezing each draft gives (collections: collection_id, golfer_id; members: collection_id, shot_id, shot as canonical text; problems: shot_id, problem): document, sha256, path and shot_count, or why it is refused."""
    shot = F.struct("shot_id", "shot")
    m = members.join(problems.groupBy("shot_id").agg(F.array_sort(F.collect_set("problem")).alias("problems")), "shot_id", "left")
    m = m.groupBy("collection_id").agg(F.array_sort(F.collect_list(shot)).alias("shots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("problems", F.array().cast("array<string>")))))).alias("problems"))
    c = collections.join(m, "collection_id", "left").withColumn("shots", F.coalesce("shots", F.array().cast("array<struct<shot_id:string,shot:string>>")))
    refused = F.concat(reasons((F.lit(not (who or "").strip()), "no name"), (F.size("shots") == 0, "no shots")), F.coalesce("problems", F.array().cast("array<string>")))
    ok = F.size("refused") == 0
    c = c.withColumn("refused", refused).withColumn("document", F.struct("collection_id", F.lit(when).alias("frozen_at"), F.lit(who).alias("frozen_by"), "golfer_id", "shots"))
    c = c.withColumn("sha256", F.when(ok, canonical_sha256(F.col("document"))))
    path = F.concat(F.lit("snapshots/"), "collection_id", F.lit("-"), F.substring("sha256", 1, 12), F.lit(".json"))
    return c.select("collection_id", "refused", F.when(ok, canonical_text(F.to_json("document", {"ignoreNullFields": "false"}))).alias("snapshot"), "sha256", path.alias("path"), F.when(ok, F.size("shots").cast("long")).alias("shot_count"))


def verified(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Snapshots (collection_id, snapshot text, recorded sha256) against their hash and the collection's members: collection_id, problem, null if it is what was frozen."""
    held = F.from_json("snapshot", "struct<shots:array<struct<shot_id:string>>>")["shots"]["shot_id"]
    now = members.groupBy("collection_id").agg(F.array_sort(F.collect_list("shot_id")).alias("now"))
    j = snapshots.join(now, "collection_id", "left")
    problem = F.when(F.col("snapshot").isNull(), "no snapshot").when(F.sha2("snapshot", 256) != F.col("sha256"), "altered since it was frozen").when(~F.array_sort(held).eqNullSafe(F.col("now")), "other shots than the collection's")
    return j.select("collection_id", problem.alias("problem"))


def setup_readiness(streams: DataFrame) -> DataFrame:
    """For each stream (shot_id, stream_id, view, p1 frame, points: names labelled there) and setup measurement: status and what is missing.

    One whole group of a measurement's alternatives is enough; if none is whole each that is not counts as missing.
    """
    rows = []
    for name, (views, points, groups) in MEASUREMENTS.items():
        has = lambda names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), "points")) == 0
        need = F.array_except(F.array(*[F.lit(p) for p in points]).cast("array<string>"), "points")
        parts = [F.when(~has(g), F.lit(" + ".join(g))) for g in groups]
        some = F.lit(False)
        for g in groups:
            some = some | has(g)
        lacking = F.when(some, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"))
        missing = F.concat(need, lacking)
        seen, marked = F.col("view").isin(views), F.col("p1").isNotNull()
        status = F.when(~seen, "not_this_view").when(~marked, "no_p1").when(F.size(missing) > 0, "missing_points").otherwise("observable_2d")
        rows.append(F.struct(F.lit(name).alias("id"), status.alias("status"), F.when(seen & marked, missing).otherwise(F.array().cast("array<string>")).alias("missing")))
    return streams.withColumn("points", F.coalesce("points", F.array().cast("array<string>"))).select("shot_id", "stream_id", F.explode(F.array(*rows)).alias("r")).select("shot_id", "stream_id", "r.*")


def report_documents(videos: DataFrame, errors: DataFrame) -> DataFrame:
    """An evaluation's document for each video (path, success, error_message, fps): its errors by position, none if it failed."""
    e = errors.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "predicted_frame", "ground_truth_frame", "error_frames", "error_ms"))).alias("errors"))
    j = videos.join(e, "path", "left")
    return j.select("path", F.to_json(F.struct("path", "success", F.when(~F.col("success"), F.col("error_message")).alias("error_message"), F.when(F.col("success"), F.struct("fps")).alias("metadata"), F.when(F.col("success"), F.col("errors")).alias("errors"))).alias("doc"))


def report_errors(docs: DataFrame) -> DataFrame:
    """path, position, error_frames, error_ms of an evaluation's documents."""
    kind = "struct<path:string,success:boolean,errors:array<struct<position:string,predicted_frame:bigint,ground_truth_frame:bigint,error_frames:bigint,error_ms:double>>>"
    return docs.select(F.from_json("doc", kind).alias("d")).select("d.path", F.explode("d.errors").alias("e")).select("path", "e.*")


def annotations_from_detections(results: DataFrame, current: DataFrame, convention: str) -> DataFrame:
    """Annotations (path, p, frame, view, convention) with those of each view that detections (doc: positions to frames by view, and the views' paths) have frames for replaced as a whole.

    A document gives each path that it replaces once, and both sides go to a set number of tasks: paths are short, and adaptive execution would put so many into one task that sorting them fills its memory.
    """
    kind = "struct<positions:map<string,struct<frames:map<string,int>>>,views:map<string,struct<path:string>>>"
    d = results.select(F.from_json("doc", kind).alias("d"))
    p = d.select("d.views", F.explode("d.positions").alias("p", "v")).select("views", "p", F.explode("v.frames").alias("view", "frame")).where("frame is not null")
    new = p.select(F.try_element_at("views", F.col("view"))["path"].alias("path"), "p", "frame", "view", F.lit(convention).alias("convention")).where("path is not null")
    seen = F.filter(F.map_values("d.positions"), lambda v: v["frames"].isNotNull())
    seen = F.flatten(F.transform(seen, lambda v: F.map_keys(F.map_filter(v["frames"], lambda _, frame: frame.isNotNull()))))
    replaced = d.select(F.explode(F.transform(F.array_distinct(seen), lambda v: F.try_element_at(F.col("d.views"), v)["path"])).alias("path")).where("path is not null")
    tasks = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = current.repartition(tasks, "path").join(replaced.repartition(tasks, "path"), "path", "left_anti")
    return kept.unionByName(new)


def overlay(pairs: DataFrame) -> DataFrame:
    """From the hips' middle and torso length in pixels of a user and a reference frame (u_x, u_y, u_torso, u_width, u_height and r_...): left, top, width of the reference's layer in shares of the user's frame."""
    s = F.when(F.col("r_torso") > 1e-6, F.col("u_torso") / F.col("r_torso")).otherwise(1.0)
    return pairs.withColumns({"left": (F.col("u_x") - s * F.col("r_x")) / F.col("u_width"), "top": (F.col("u_y") - s * F.col("r_y")) / F.col("u_height"), "width": s * F.col("r_width") / F.col("u_width")})


def overlaid(points: DataFrame) -> DataFrame:
    """Points in shares of the reference's frame (x, y) in shares of the user's: under left, top, width, mirrored about the layer's own axis if mirror is set."""
    s = F.col("width") * F.col("u_width") / F.col("r_width")
    across = F.when(F.col("mirror"), 1 - F.col("x")).otherwise(F.col("x"))
    return points.withColumns({"on_x": F.col("left") + across * s * F.col("r_width") / F.col("u_width"), "on_y": F.col("top") + F.col("y") * s * F.col("r_height") / F.col("u_height")})


def reconstruction_ids(inputs: DataFrame) -> DataFrame:
    """inputs (shot_id and a struct inputs) with reconstruction_id: the shot and the hash of what it is made from, so that a job run again writes the same place."""
    return inputs.withColumn("reconstruction_id", F.concat(F.col("shot_id").cast("string"), F.lit("-"), F.substring(canonical_sha256(F.col("inputs")), 1, 12)))
