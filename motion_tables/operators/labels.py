"""Label jobs: scoring joins, identity checks, carrying labels forward, contract rules, shaft positions, repaired times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.operators.windows import KEY, by, crossings

SHAFT_LEAST, SHAFT_MOST = 0.5, 0.6


def label_errors(labels: DataFrame, predictions: DataFrame, scales: DataFrame) -> DataFrame:
    """Distance of every labelled point (video_id, frame, joint, x, y) from its prediction in its recording's scale; null where nothing was predicted."""
    p = predictions.select(KEY, "frame", "joint", F.col("x").alias("px"), F.col("y").alias("py"))
    j = labels.join(p, [KEY, "frame", "joint"], "left").join(scales, KEY)
    return j.select(KEY, "frame", "joint", (F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) / F.col("scale")).alias("err"))


def current_labels(f: DataFrame, pos: DataFrame) -> DataFrame:
    """Every frame with the last position at or before it."""
    j = f.select(KEY, "frame").join(pos.groupBy(KEY, "frame").agg(F.min("p").alias("p")), [KEY, "frame"], "left")
    return j.select(KEY, "frame", F.last("p", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0)).alias("current"))


def identity_problems(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Labels (id, frame, sha) whose frame the index (id, frame, digest) lacks, or has with another digest."""
    j = labels.join(index, ["id", "frame"], "left")
    return j.where("digest is null or digest <> sha").select("id", "frame", F.when(F.col("digest").isNull(), "frame not in the index").otherwise("another image").alias("problem"))


def carried(prior: DataFrame, shown: DataFrame) -> DataFrame:
    """Earlier labels (id, frame, sha) against the frames shown now (id, frame, digest): kept only where the digests agree, else refused with the reason."""
    j = prior.join(shown, ["id", "frame"], "left")
    why = F.when(F.col("digest").isNull(), "frame no longer shown").when(F.col("sha").isNull(), "no digest recorded").when(F.col("sha") != F.col("digest"), "image changed")
    return j.select("id", "frame", why.isNull().alias("kept"), why.alias("reason"))


def resolved_positions(slots: DataFrame, own: DataFrame, partner: DataFrame) -> DataFrame:
    """Frame of each wanted position (video_id, p): its own frame, else its own time, else its partner's time; and which."""
    j = slots.join(own.select(KEY, "p", "frame", "t_ms"), [KEY, "p"], "left").join(partner.select(KEY, "p", F.col("t_ms").alias("partner_ms")), [KEY, "p"], "left")
    at = lambda t: F.bround(F.col(t) * F.col("fps") / 1000).cast("long")
    source = F.when(F.col("frame").isNotNull(), "frame").when(F.col("t_ms").isNotNull(), "time").when(F.col("partner_ms").isNotNull(), "partner").otherwise("missing")
    return j.select(KEY, "p", F.coalesce(F.col("frame").cast("long"), at("t_ms"), at("partner_ms")).alias("frame"), source.alias("source"))


def shaft_positions(s: DataFrame, spans: DataFrame) -> DataFrame:
    """video_id, p, frame, confidence where the shaft (angle from the upright, null if not tracked) crosses the horizontal inside a span (p, lo, hi, last), in recordings tracked on half their frames."""
    w = by().rowsBetween(Window.unboundedPreceding, 0)
    t = s.withColumn("tracked", F.col("angle").isNotNull()).withColumn("offset", F.coalesce(F.last(F.abs("angle") - 90, ignorenulls=True).over(w), F.lit(0.0)))
    t = t.withColumn("_share", F.avg(F.col("tracked").cast("int")).over(Window.partitionBy(KEY))).where(F.col("_share") >= SHAFT_LEAST)
    c = crossings(t, "offset", "tracked").where("slope > 0").join(spans, KEY).where("hi > lo and frame > lo and frame <= hi")
    k = F.row_number().over(Window.partitionBy(KEY, "p").orderBy(F.when(F.col("last"), -F.col("frame")).otherwise(F.col("frame"))))
    return c.withColumn("_k", k).where("_k = 1").select(KEY, "p", F.col("nearest").alias("frame"), F.least(F.col("slope") / 60 / 2, F.lit(SHAFT_MOST)).alias("confidence"))


#: Milliseconds after the last frame of a frame without a time, and of one whose time would not increase.
MISSING_STEP, LEAST_STEP = 16.67, 0.001


def repaired_times(s: DataFrame, fps: float = 60.0) -> DataFrame:
    """video_id, frame, t_ms, estimated: a missing time is set 16.67 ms after the one before (0 for the first), and one that does not increase to frame / fps, or just after the one before; estimated marks both.

    A time depends on the one before as repaired, but no repaired time can pass the largest of the times and of frame / fps so far, each moved on by the steps since (a running maximum).
    A time beyond that stands whatever came before, so recordings are cut there, and only the frames up to the next such one are folded in order.
    """
    missing, nominal = F.col("t_ms").isNull(), F.col("frame") * 1000 / F.lit(fps)
    w = by().rowsBetween(Window.unboundedPreceding, 0)
    t = s.select(KEY, F.col("frame").cast("int").alias("frame"), F.col("t_ms").cast("double").alias("t_ms"))
    t = t.withColumn("_o", F.sum(F.when(missing, MISSING_STEP).otherwise(LEAST_STEP)).over(w))
    t = t.withColumn("_most", F.max(F.greatest("t_ms", F.when(~missing, nominal), F.lit(0.0)) - F.col("_o")).over(w) + F.col("_o"))
    t = t.withColumn("_sure", F.coalesce(F.col("t_ms") > F.lag("_most").over(by()) + 1e-6, F.lag("frame").over(by()).isNull()))
    t = t.withColumn("_run", F.sum(F.col("_sure").cast("int")).over(w))
    g = t.groupBy(KEY, "_run").agg(F.array_sort(F.collect_list(F.struct("frame", "t_ms"))).alias("f"))
    kind = "struct<last:double,out:array<struct<t_ms:double,estimated:boolean>>>"

    def step(state, f):
        last, now = state["last"], f["t_ms"]
        behind = F.coalesce(now <= last, F.lit(False))
        new = F.when(now.isNull(), F.coalesce(last + MISSING_STEP, F.lit(0.0))).when(behind, F.greatest(f["frame"] * 1000 / F.lit(fps), last + LEAST_STEP)).otherwise(now)
        return F.struct(new, F.array_append(state["out"], F.struct(new, now.isNull() | behind).cast("struct<t_ms:double,estimated:boolean>"))).cast(kind)

    out = F.aggregate("f", F.struct(F.lit(None), F.array()).cast(kind), step)["out"]
    return g.select(KEY, F.explode(F.arrays_zip(F.col("f.frame").alias("frame"), out.alias("o"))).alias("e")).select(KEY, "e.frame", "e.o.t_ms", "e.o.estimated")


def position_rows(documents: DataFrame) -> DataFrame:
    """video_id, p, frame from annotation documents (doc, a JSON object of recordings to objects of positions with a frame); entries without a frame are left out."""
    m = documents.select(F.explode(F.from_json("doc", "map<string, map<string, struct<frame:int, timestamp_ms:double>>>")).alias("video_id", "positions"))
    return m.select("video_id", F.explode("positions").alias("p", "v")).where("v.frame is not null").select("video_id", "p", "v.frame", "v.timestamp_ms")


def position_documents(pos: DataFrame) -> DataFrame:
    """video_id, doc: the positions of each recording as one JSON object, in order of the position's number."""
    entry = F.struct(F.substring("p", 2, 9).cast("int").alias("k"), F.col("p"), F.struct("frame").alias("v"))
    g = pos.groupBy("video_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select("video_id", F.to_json(F.map_from_arrays(F.col("e")["p"], F.col("e")["v"])).alias("doc"))


def ground_truth(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """path, p, frame, fps of ground truth (doc: JSON with videos, each with path, fps or null, and positions).

    A position is an object with a frame, or with a time in ms, or the frame alone; a time becomes the nearest frame at the video's rate, even on a tie.  A video without a
    rate of its own takes that of ``rates`` (path, fps).  A position with neither a frame nor a time and a rate is left out; so is a document without videos.
    """
    kind = "videos array<struct<path:string,fps:double,positions:map<string,string>>>"
    v = documents.select(F.explode(F.from_json("doc", kind)["videos"]).alias("v")).select("v.path", F.col("v.fps").alias("own"), F.explode("v.positions").alias("p", "said"))
    v = v.join(rates.select("path", F.col("fps").alias("known")), "path", "left").withColumn("fps", F.coalesce("own", "known"))
    at = F.from_json("said", "frame double, timestamp_ms double")
    frame = F.coalesce(at["frame"], F.bround(at["timestamp_ms"] * F.col("fps") / 1000), F.col("said").try_cast("double"))
    return v.select("path", "p", frame.cast("long").alias("frame"), "fps").where("frame is not null")


def swing_documents(positions: DataFrame, views: DataFrame, swings: DataFrame) -> DataFrame:
    """pair_id, doc: the found positions of each swing as one nested JSON document, times to a tenth of a ms and confidences to three digits.

    ``positions``: pair_id, p, t_ms, confidence, method, view, face_on (frame there), dtl (frame there, or null); ``views``: pair_id, view, path, fps, frame_count; ``swings``: pair_id, handedness, alignment, offset_ms, warnings.  A swing without positions has an empty object.
    """
    entry = F.struct(F.bround("t_ms", 1).alias("timestamp_ms"), F.bround("confidence", 3).alias("confidence"), "method", F.col("view").alias("detected_in"), F.struct("face_on", "dtl").alias("frames"))
    p = positions.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(F.substring("p", 2, 9).cast("int").alias("k"), "p", entry.alias("v")))).alias("e"))
    v = views.groupBy("pair_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", F.struct("path", "fps", "frame_count").alias("v"))))).alias("views"))
    j = swings.join(v, "pair_id", "left").join(p, "pair_id", "left")
    found = F.coalesce(F.map_from_arrays(F.col("e.p"), F.col("e.v")), F.from_json(F.lit("{}"), "map<string,struct<timestamp_ms:double,confidence:double,method:string,detected_in:string,frames:struct<face_on:bigint,dtl:bigint>>>"))
    doc = F.struct(F.lit("p-positions/1").alias("schema"), "handedness", F.lit("face_on").alias("time_base"), "alignment", "offset_ms", "views", found.alias("positions"), "warnings")
    return j.select("pair_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


def confirmed(annotations: DataFrame, convention: str = "p7-impact") -> DataFrame:
    """Annotations of the canonical convention that need no review."""
    return annotations.where((F.col("convention") == convention) & ~F.coalesce("needs_review", F.lit(False)))


def presentation_times(f: DataFrame) -> DataFrame:
    """presentation_ms: a frame's time with its recording's start offset; null if that is unknown."""
    return f.withColumn("presentation_ms", F.col("start_offset_ms") + F.col("t_ms"))


def club_specifications(shots: DataFrame) -> DataFrame:
    """The club's entered facts of each shot, and whether its length is known."""
    return shots.select("shot_id", "club.category", "club.name", "club.length_in", "club.length_basis", F.col("club.length_in").isNotNull().alias("length_known"))
