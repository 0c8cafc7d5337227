"""Label manifests, label exports and shot labels: JSON documents (column doc) read to rows, and their rules as rows (place, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemas of label exports, modes of a frame, origins of a point and those from a model.
SCHEMAS, MODES = (1, 2, 3), ("blind", "assisted")
ORIGINS, MODEL_ORIGINS = ("placed", "earlier_kept", "model_accepted", "model_corrected", "floor_carried"), ("model_accepted", "model_corrected")

MANIFEST = "struct<joints:array<string>,frames:array<struct<video:string,frame:int,`set`:string,blind:boolean,view:string,p1_frame:int,width:int,height:int,image_sha1:string>>>"
_STATUS = "struct<mode:string,cannot_place:array<string>,origins:map<string,struct<origin:string,model:string>>,assist:struct<confirmed_by:string,confirmed_at:string>,review:struct<points_unchanged:array<string>>>"
EXPORT = f"struct<schema:int,verified_by:string,videos:map<string,struct<view:string,p1_frame:int,verified_by:string,image_sha1:map<string,string>,frames:map<string,map<string,struct<x:double,y:double,visible:boolean>>>,frame_status:map<string,{_STATUS}>>>>"
SHOT = "struct<shot_id:string,streams:map<string,struct<source_id:string,source_sha256:string,positions:map<string,struct<frame:int,origin:string>>,frames:map<string,struct<points:map<string,struct<x:double,y:double,visible:boolean,origin:string,model:string>>,unavailable:map<string,string>,review:struct<status:string,`by`:string>>>>>>"


def manifest_frames(docs: DataFrame) -> DataFrame:
    """The frames of labelling manifests with their joints; a frame without a set is of the benchmark, one without blind is not blind."""
    m = docs.select(F.from_json("doc", MANIFEST).alias("m")).select("m.joints", F.explode("m.frames").alias("f")).select("joints", "f.*")
    return m.withColumns({"set": F.coalesce("set", F.lit("benchmark")), "blind": F.coalesce("blind", F.lit(False))})


def _exports(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", EXPORT).alias("d")).select("d.*")


def _videos(docs: DataFrame) -> DataFrame:
    return _exports(docs).select("schema", F.explode("videos").alias("video", "v")).select("schema", "video", "v.*")


def _points(videos: DataFrame) -> DataFrame:
    """schema, video, frame, digest, joint, x, y, visible of every labelled point."""
    f = videos.select("schema", "video", "image_sha1", F.explode("frames").alias("key", "joints"))
    f = f.select("schema", "video", F.expr("try_cast(key as int)").alias("frame"), F.try_element_at("image_sha1", "key").alias("digest"), F.explode("joints").alias("joint", "p"))
    return f.select("schema", "video", "frame", "digest", "joint", "p.*")


def _judged(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Labelled points with the manifest's frame and, in rule, the first that is broken: of the frame (whole true), or of the point."""
    listed = manifest.select("video").distinct()
    p = _points(_videos(docs).join(listed, "video", "left_semi")).join(manifest.withColumnRenamed("image_sha1", "expected"), ["video", "frame"], "left")
    frame = F.when(F.col("set").isNull(), "not a frame of the labelling set").when((F.col("schema") == 1) & (F.col("set") != "benchmark"), "schema 1 outside the benchmark").when(F.col("expected").isNull(), "no digest in the manifest")
    frame = frame.when(~F.col("digest").eqNullSafe(F.col("expected")), "labelled on another image")
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    point = F.when(~F.array_contains("joints", F.col("joint")), "not a labelled joint").when(~(real("x") & real("y")), "no finite place").when(~(F.col("x").between(0, F.col("width")) & F.col("y").between(0, F.col("height"))), "outside the image").when(F.col("visible").isNull(), "visible must be true or false")
    return p.withColumn("whole", frame.isNotNull()).withColumn("rule", F.coalesce(frame, point))


def label_rows(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """video, frame, joint, x, y, visible, set, mode, view, p1_frame of every label without a broken rule; frames of exports before schema 3 are blind."""
    status = _videos(docs).select("video", F.explode_outer("frame_status").alias("key", "st")).select("video", F.expr("try_cast(key as int)").alias("frame"), F.col("st.mode").alias("mode"))
    good = _judged(docs, manifest).where("rule is null").join(status, ["video", "frame"], "left")
    return good.select("video", "frame", "joint", "x", "y", "visible", "set", F.when(F.col("schema") == 3, F.col("mode")).otherwise("blind").alias("mode"), "view", "p1_frame")


def export_violations(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """place, rule of all rules that label exports break against their manifest."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    at = lambda *c: F.concat_ws(" ", *c)

    def broken(df: DataFrame, place: Column, *rules: tuple[Column, str]) -> DataFrame:
        return df.select(place.alias("place"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("rule"))

    top = broken(_exports(docs), F.lit("export"), (~F.coalesce(F.col("schema").isin(*SCHEMAS), F.lit(False)), "unknown schema"), (blank(F.col("verified_by")), "no verified_by"), (F.coalesce(F.size("videos"), F.lit(0)) < 1, "no labelled videos"))
    own = manifest.groupBy("video").agg(F.min("view").alias("own_view"), F.min("p1_frame").alias("own_p1"))
    v = _videos(docs).join(own, "video", "left")
    listed = F.col("own_view").isNotNull()
    videos = broken(v, F.col("video"), (~listed, "not in the manifest"), (listed & blank(F.col("verified_by")), "no verified_by"), (listed & ~F.col("view").eqNullSafe(F.col("own_view")), "view differs"), (listed & ~F.col("p1_frame").eqNullSafe(F.col("own_p1")), "p1_frame differs"))
    judged = _judged(docs, manifest)
    frames = judged.where("whole").select(at("video", "frame").alias("place"), "rule").distinct()
    points = judged.where("not whole and rule is not null").select(at("video", "frame", "joint").alias("place"), "rule")

    placed = judged.where("rule is null").groupBy("schema", "video", "frame").agg(F.collect_set("joint").alias("placed"))
    st = v.where(listed & F.col("schema").isin(2, 3)).select("schema", "video", F.explode("frame_status").alias("key", "st")).select("schema", "video", F.expr("try_cast(key as int)").alias("frame"), "st")
    st = st.join(manifest.select("video", "frame", "blind", "joints"), ["video", "frame"], "left").join(placed.drop("schema"), ["video", "frame"], "left")
    st = st.withColumn("placed", F.coalesce("placed", F.array().cast("array<string>"))).withColumn("cannot", F.coalesce("st.cannot_place", F.array().cast("array<string>")))
    inside = F.col("blind").isNotNull()
    known = F.size(F.array_except("cannot", "joints")) == 0
    three, mode = F.col("schema") == 3, F.col("st.mode")
    fine = F.coalesce(mode.isin(*MODES), F.lit(False))
    expected = F.when(F.col("blind"), "blind").otherwise("assisted")
    status = broken(st, at("video", "frame"), (~inside, "status of a frame outside the set"), (inside & ~known, "cannot place an unknown point"), (inside & known & (F.size(F.array_intersect("cannot", "placed")) > 0), "placed and impossible to place"),
        (inside & three & ~fine, "mode must be blind or assisted"), (inside & three & fine & (mode != expected), "mode is not the manifest's"))
    unset = placed.where("schema = 3").join(st.where(inside & fine).select("video", "frame"), ["video", "frame"], "left_anti")
    unset = unset.select(at("video", "frame").alias("place"), F.lit("no mode").alias("rule"))
    signed = ~blank(F.col("st.assist.confirmed_by")) & ~blank(F.col("st.assist.confirmed_at"))
    o = st.where(inside & three & fine).select("video", "frame", "placed", mode.alias("mode"), signed.alias("signed"), F.coalesce("st.review.points_unchanged", F.array().cast("array<string>")).alias("kept"), F.explode("st.origins").alias("joint", "o"))
    origin, guessed = F.col("o.origin"), F.col("o.origin").isin(*MODEL_ORIGINS)
    rule = F.when(~F.array_contains("placed", F.col("joint")), "origin of a point that is not placed").when(~F.coalesce(origin.isin(*ORIGINS), F.lit(False)), "unknown origin").when(guessed & (F.col("mode") == "blind"), "model proposal on a blind frame")
    rule = rule.when(guessed & blank(F.col("o.model")), "model does not produce this point").when(guessed & ~F.col("signed"), "model proposal without sign-off").when((origin == "earlier_kept") & ~F.array_contains("kept", F.col("joint")), "kept without a review")
    origins = o.select(at("video", "frame", "joint").alias("place"), rule.alias("rule")).where("rule is not null")
    return reduce(DataFrame.unionByName, [top, videos, frames, points, status, unset, origins])


def _shot_streams(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", SHOT).alias("d")).select("d.shot_id", F.explode("d.streams").alias("stream_id", "s")).select("shot_id", "stream_id", "s.*")


def shot_positions(docs: DataFrame) -> DataFrame:
    return _shot_streams(docs).select("shot_id", "stream_id", F.explode("positions").alias("p", "v")).select("shot_id", "stream_id", "p", "v.frame", "v.origin")


def _shot_frames(docs: DataFrame) -> DataFrame:
    return _shot_streams(docs).select("shot_id", "stream_id", F.explode("frames").alias("frame", "f")).withColumn("frame", F.expr("try_cast(frame as int)"))


def shot_points(docs: DataFrame) -> DataFrame:
    return _shot_frames(docs).select("shot_id", "stream_id", "frame", F.explode("f.points").alias("point", "q")).select("shot_id", "stream_id", "frame", "point", "q.*")


def shot_unavailable(docs: DataFrame) -> DataFrame:
    return _shot_frames(docs).select("shot_id", "stream_id", "frame", F.explode("f.unavailable").alias("point", "reason"))


def shot_label_violations(docs: DataFrame, streams: DataFrame, known_points: list[str]) -> DataFrame:
    """place, rule of all rules that shots' labels break against the catalog's streams (shot_id, stream_id, source_id, sha256, frame_count, width, height)."""
    reg = streams.withColumnsRenamed({"source_id": "own_source"}).select("shot_id", "stream_id", "own_source", "sha256", "frame_count", "width", "height")
    shots = streams.select("shot_id").distinct().withColumn("known", F.lit(True))
    place = lambda *c: F.concat_ws(" ", "shot_id", "stream_id", *c)
    s = _shot_streams(docs).join(shots, "shot_id", "left").join(reg, ["shot_id", "stream_id"], "left")
    there = F.col("own_source").isNotNull()
    top = s.where("known is null").select(F.col("shot_id").alias("place"), F.lit("unknown shot").alias("rule")).distinct()
    st = s.where("known")
    own = st.select(place().alias("place"), F.when(~there, "no such stream").when(F.col("source_id") != F.col("own_source"), "labelled on another source").when(F.col("source_sha256") != F.col("sha256"), "labelled on other bytes").alias("rule")).where("rule is not null")
    keys = st.where(there & (F.col("source_id") == F.col("own_source"))).select("shot_id", "stream_id", "frame_count", "width", "height")
    on = ["shot_id", "stream_id"]
    out = ~((F.col("frame") >= 0) & (F.col("frame") < F.col("frame_count")))
    pos = shot_positions(docs).join(keys, on).where(out).select(place("p").alias("place"), F.lit("frame outside the source").alias("rule"))
    fr = _shot_frames(docs).join(keys, on)
    frames = fr.where(out).select(place("frame").alias("place"), F.lit("frame outside the source").alias("rule"))
    review = fr.where((F.coalesce("f.review.status", F.lit("unreviewed")) != "unreviewed") & (F.trim(F.coalesce("f.review.by", F.lit(""))) == "")).select(place("frame").alias("place"), F.lit("review without a reviewer").alias("rule"))
    strange = ~F.col("point").isin(known_points)
    pt = shot_points(docs).join(keys, on)
    rule = F.when(strange, "not a known point").when(~(F.col("x").between(0, F.col("width")) & F.col("y").between(0, F.col("height"))), "outside the image").when((F.col("origin") != "manual") & (F.trim(F.coalesce("model", F.lit(""))) == ""), "origin without the model's name")
    points = pt.select(place("frame", "point").alias("place"), rule.alias("rule")).where("rule is not null")
    un = shot_unavailable(docs).join(keys, on).join(shot_points(docs).select(*on, "frame", "point", F.lit(True).alias("placed")), [*on, "frame", "point"], "left")
    gone = un.select(place("frame", "point").alias("place"), F.when(strange, "not a known point").when(F.col("placed"), "both placed and unavailable").alias("rule")).where("rule is not null")
    return reduce(DataFrame.unionByName, [top, own, pos, frames, review, points, gone])
