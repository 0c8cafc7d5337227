"""Labels as what an edit log makes of them: each frame's edits are folded in order, refused edits keep their reason.

Whether an edit is taken, and what it does, depends on those before it at the same frame: a frame exists while it has a point or a point marked unavailable,
its image is that of the edit that made it, moving a model's proposal corrects it, and every change of a frame undoes its review.  Edits of different frames don't
meet, so frames are folded by themselves, each read once in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from motion_tables.operators.folds import in_order

# Kinds of edits, origins of a point and those of a model, reasons of a missing point, review states, positions.
FRAME_OPS, POSITION_OPS = ("point", "unavailable", "remove", "review"), ("position", "clear")
ORIGINS, OF_MODELS = ("manual", "model_proposed", "corrected"), ("model_proposed", "corrected")
UNAVAILABLE_REASONS = ("occluded", "out_of_frame", "motion_blur", "not_present", "cannot_determine")
REVIEW_STATUSES = ("unreviewed", "reviewed", "rejected")
POSITIONS = tuple(f"P{i}" for i in range(1, 11))

_POINT = "struct<name:string,reason:string,x:double,y:double,visible:boolean,origin:string,model:string,confidence:double,set_by:string>"
_POINT_FIELDS = ("name", "reason", "x", "y", "visible", "origin", "model", "confidence", "set_by")
_REVIEW = "struct<status:string,`by`:string,notes:string>"


def _why(points: list[str]) -> Column:
    """What is wrong with an edit whatever came before it: the first that holds."""
    op, name = F.col("op"), F.col("name")
    adds = op.isin("point", "unavailable", "position")
    inside = F.col("x").between(0, F.col("width")) & F.col("y").between(0, F.col("height"))

    def lacks(ok):
        return ~F.coalesce(ok, F.lit(False))

    checks = [
        (lacks(op.isin(*FRAME_OPS, *POSITION_OPS)), "unknown edit"), ((op == "position") & lacks(name.isin(*POSITIONS)), "unknown position"), ((op == "position") & lacks(F.col("origin").isin(*ORIGINS)), "unknown origin"),
        (op.isin("point", "unavailable") & lacks(name.isin(*points)), "unknown point"), ((op == "unavailable") & lacks(F.col("reason").isin(*UNAVAILABLE_REASONS)), "unknown reason"),
        (adds & F.col("frame_count").isNull(), "unknown stream"), ((op == "point") & lacks(inside), "outside the image"), (adds & lacks(F.col("same_bytes")), "index of other bytes"),
        (adds & lacks((F.col("frame") >= 0) & (F.col("frame") < F.col("frame_count"))), "no such frame"), ((op == "review") & lacks(F.col("status").isin(*REVIEW_STATUSES)), "unknown status"),
        ((op == "review") & (F.col("status") != "unreviewed") & lacks(F.trim("by") != ""), "review without a reviewer"),
    ]
    out = F.when(*[checks[0][0], F.lit(checks[0][1])])
    for c, t in checks[1:]:
        out = out.when(c, F.lit(t))
    return out


def checked(edits: DataFrame, streams: DataFrame, points: list[str]) -> DataFrame:
    """Edits (stream_id, seq, op, frame, name, x, y, visible, by, origin, model, confidence, reason, status, notes, image) with ``why``, null if nothing is wrong with them alone; streams: stream_id, width, height, frame_count, same_bytes."""
    j = edits.join(streams.select("stream_id", "width", "height", "frame_count", "same_bytes"), "stream_id", "left")
    return j.withColumn("why", _why(points)).drop("width", "height", "frame_count", "same_bytes")


def _frame(key: tuple, edits: Iterator[tuple]) -> Iterator[tuple]:
    """Every edit of a frame with its refusal, in order, then what stands on the frame."""
    live: dict[str, tuple] = {}
    image, review = None, (None, None, None)
    for _, _, seq, op, name, x, y, visible, by, origin, model, confidence, reason, status, notes, at_image, why in edits:
        places = op in ("point", "unavailable")
        if op == "review" and not live:
            why = "no labels to review"
        elif why is None and places and live and image != at_image:
            why = "labels of another image"
        yield (*key, seq, why, None, None, None)
        if why is not None:
            continue
        if op == "review":
            review = (status, by if status != "unreviewed" else None, notes)
            continue
        if places and not live:
            image = at_image
        if name is None:
            live.clear()
        old = live.pop(name, None)
        if op == "point":
            corrects = origin == "manual" and old is not None and old[5] in OF_MODELS
            live[name] = (name, None, x, y, visible, "corrected" if corrects else origin, old[6] if corrects else model, confidence, by)
        elif op == "unavailable":
            live[name] = (name, reason, None, None, None, None, None, None, None)
        review = ("unreviewed", None, None)
    for point in live.values():
        yield (*key, None, None, image, dict(zip(("status", "by", "notes"), review)), dict(zip(_POINT_FIELDS, point)))


def folded(edits: DataFrame) -> DataFrame:
    """stream_id, frame, seq and why (the refusal, null if it was taken) of each edit of frames; then stream_id, frame, image, review and p of each point or mark that stands in the end, with seq null.

    ``edits`` as ``checked`` gives them; of equal seq the order is by kind and name.
    """
    order = ["seq", "op", "name", "x", "y", "visible", "by", "origin", "model", "confidence", "reason", "status", "notes", "image", "why"]
    e = edits.where(F.col("op").isNull() | ~F.col("op").isin(*POSITION_OPS)).select("stream_id", "frame", *order)
    made = StructType.fromDDL(f"seq long, why string, image string, review {_REVIEW}, p {_POINT}")
    return in_order(e, ["stream_id", "frame"], order, _frame, StructType([e.schema["stream_id"], e.schema["frame"], *made]))


def label_points(frames: DataFrame) -> DataFrame:
    """One row per point or mark of the frames that ``folded`` gives."""
    return frames.where("p is not null").select("stream_id", "frame", "image", F.col("review.status").alias("review"), F.col("review.by").alias("review_by"), "p.*")


def label_refusals(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """stream_id, seq, frame, why of every refused edit, of frames (``folded``) and of positions (``checked``)."""
    at_frames = frames.select("stream_id", "seq", "frame", "why")
    return at_frames.unionByName(edits.where(F.col("op").isin(*POSITION_OPS)).select("stream_id", "seq", "frame", "why")).where("why is not null")


def label_positions(edits: DataFrame) -> DataFrame:
    """stream_id, position, frame, origin, set_by: the last accepted edit of each position, unless it cleared it."""
    w = Window.partitionBy("stream_id", "name").orderBy(F.desc("seq"), F.desc("op"))
    last = edits.where(F.col("op").isin(*POSITION_OPS) & F.col("why").isNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1 and op = 'position'")
    return last.select("stream_id", F.col("name").alias("position"), "frame", "origin", F.col("by").alias("set_by"), "image")
