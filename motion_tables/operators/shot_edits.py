"""Shots as what an edit log makes of them: every edit is taken or refused by what the accepted edits before it have made.

Edits depend on each other in layers, and each layer is decided by the ones before it.  Golfers are only ever added, so the first valid addition
of each decides from when it is known.  A source's owner changes without conditions; its changes are dealt to the shots that refer to the source
and become events of theirs.  Then each shot's events are folded in order: an edit is tried on the shot as it stands, all rules are put to the result, and
it is kept only if none is broken.  A shot's events are read one by one; nothing is gathered but its streams.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from motion_tables.functions.text import is_identifier
from motion_tables.operators.folds import in_order

# Swing types, camera views, review states, ways that exposures align, statuses that someone must have decided.
SWING_TYPES, VIEWS = ("full", "three_quarter", "half"), ("face_on", "down_the_line", "overhead", "impact", "unknown")
REVIEWS, ALIGNMENTS, DECIDED = ("unreviewed", "reviewed", "rejected"), ("unknown", "included", "bounded"), ("verified", "asserted", "estimated")
ON_STREAMS, ON_SHOTS = ("window", "crop", "quality"), ("swing", "review", "same", "sync", "cal")
OPS = ("shot", "stream", "remove", *ON_STREAMS, *ON_SHOTS)
#: Before every seq.
FIRST = -(2**62)

_CROP = "struct<x:long,y:long,w:long,h:long>"
_STREAM = f"struct<stream_id:string,source_id:string,view:string,start_frame:long,end_frame:long,crop:{_CROP},body:string,club:string,resolution:string,frame_count:long,width:long,height:long>"
_STATUS = "struct<status:string,method:string,`by`:string,uncertainty_ms:double,exposure_alignment:string,exposure_uncertainty_ms:double>"
_REVIEW = "struct<status:string,`by`:string>"
_SHOT = f"struct<golfer_id:string,swing_type:string,same:{_STATUS},sync:{_STATUS},cal:{_STATUS},review:{_REVIEW}>"
LOG = f"seq long, op string, shot_id string, golfer_id string, source_id string, stream_id string, view string, start_frame long, end_frame long, crop {_CROP}, body string, club string, resolution string, swing_type string, status string, method string, `by` string, uncertainty_ms double, exposure_alignment string, exposure_uncertainty_ms double"


_STREAM_FIELDS = ("stream_id", "source_id", "view", "start_frame", "end_frame", "crop", "body", "club", "resolution", "frame_count", "width", "height")
_PLAIN = ("seq", "op", "golfer_id", "source_id", "stream_id", "view", "start_frame", "end_frame", "crop", "body", "club", "resolution", "swing_type", "status", "method", "by", "uncertainty_ms", "exposure_alignment", "exposure_uncertainty_ms", "frame_count", "width", "height")


class Status(NamedTuple):
    status: str | None
    method: str | None = None
    by: str | None = None
    uncertainty_ms: float | None = None
    exposure_alignment: str | None = None
    exposure_uncertainty_ms: float | None = None


class Shot(NamedTuple):
    golfer_id: str | None
    swing_type: str | None
    same: Status
    sync: Status
    cal: Status
    review: tuple


Edit = namedtuple("Edit", [*_PLAIN, "named", "known", "held"])


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _blank(text: str | None) -> bool:
    return not (text or "").strip(" ")


def _differs(a, b) -> bool:
    return a is not None and b is not None and a != b


def _under(a, b) -> bool:
    return a is not None and b is not None and a < b


def stream_problems(st: dict) -> list[str]:
    """Texts of the rules that a stream breaks by itself."""
    out, crop = [], st["crop"]
    start, end, count = st["start_frame"], st["end_frame"], st["frame_count"]
    if start is None or end is None or count is None or not 0 <= start <= end < count:
        out.append("window not within the source")
    if crop:
        x, y, w, h = (crop[k] for k in "xywh")
        if any(_under(v, 0) for v in (x, y)) or any(_under(v, 1) for v in (w, h)):
            out.append("crop without place or size")
        elif None not in (x, w) and _under(st["width"], x + w) or None not in (y, h) and _under(st["height"], y + h):
            out.append("crop past the frame")
    return out


def shot_problems(shot: Shot, n: int) -> list[str]:
    """Texts of the rules that a shot of n streams breaks, but for those of its streams."""
    same, sync, cal = shot.same, shot.sync, shot.cal
    align, extra = "unknown" if sync.exposure_alignment is None else sync.exposure_alignment, sync.exposure_uncertainty_ms
    rules = [
        (n == 1 and (_differs(same.status, "not_applicable") or _differs(sync.status, "not_applicable")), "one stream, but not not_applicable"),
        (n != 1 and same.status is not None and same.status not in ("asserted", "verified"), "several streams, but not of the same swing"),
        (n != 1 and "not_applicable" in (sync.status, cal.status), "several streams, but no synchronization or calibration"),
        (n != 1 and sync.status == "verified" and _differs(same.status, "verified"), "synchronization verified, same swing not"),
        (_under(sync.uncertainty_ms, 0), "negative uncertainty"), (_under(extra, 0), "negative exposure uncertainty"),
        (align == "bounded" and extra is None, "exposure bounded without a bound"), (align != "bounded" and extra is not None, "exposure bound without being bounded"),
        (align != "unknown" and sync.status is not None and sync.status not in ("estimated", "verified"), "exposure alignment without synchronization"),
        *[(s.status in DECIDED and (_blank(s.method) or _blank(s.by)), f"{what} decided without method or person") for s, what in ((same, "same swing"), (sync, "synchronization"), (cal, "calibration"))],
        (_differs(shot.review[0], "unreviewed") and _blank(shot.review[1]), "review without a reviewer"),
    ]
    return [text for broken, text in rules if broken]


def _new_stream(e: Edit, streams: dict) -> dict:
    view = f"{e.view}-{len(streams) + 1}" if e.view in streams else e.view
    st = {k: getattr(e, k) for k in _STREAM_FIELDS}
    return st | {"stream_id": view if e.stream_id is None else e.stream_id, "body": "unassessed", "club": "unassessed", "resolution": "unassessed"}


def _changed(e: Edit, st: dict) -> dict:
    """A stream after an edit of its window, crop or quality."""
    if e.op == "window":
        return st | {"start_frame": e.start_frame, "end_frame": e.end_frame}
    return st | ({"crop": e.crop} if e.op == "crop" else {q: getattr(e, q) for q in ("body", "club", "resolution") if getattr(e, q) is not None})


def _tried(shot: Shot | None, e: Edit) -> Shot:
    """The shot as the edit would have it, but for its streams."""
    op = e.op
    if op == "shot":
        return Shot(e.golfer_id, e.swing_type, Status("not_applicable"), Status("not_applicable"), Status("unknown"), ("unreviewed", None))
    if op == "stream":
        joined = {"same": Status("asserted", e.method, e.by), "sync": Status("unknown"), "cal": Status("unknown")}
        return shot._replace(**{k: v for k, v in joined.items() if getattr(shot, k).status == "not_applicable"})
    if op == "swing":
        return shot._replace(swing_type=e.swing_type)
    if op == "review":
        return shot._replace(review=(e.status, e.by if e.status != "unreviewed" else None))
    if op == "sync":
        return shot._replace(sync=Status(e.status, e.method, e.by, e.uncertainty_ms, "unknown" if e.exposure_alignment is None else e.exposure_alignment, e.exposure_uncertainty_ms))
    return shot._replace(**{op: Status(e.status, e.method, e.by)}) if op in ON_SHOTS else shot


def _before(shot: Shot | None, streams: dict, e: Edit) -> list[str]:
    """What forbids to try the edit at all."""
    op, there = e.op, shot is not None
    rules = [
        (op not in OPS, "unknown edit"), (op is not None and op != "shot" and not there, "unknown shot"), (op == "review" and e.status not in REVIEWS, "unknown status"), (op in ON_STREAMS and there and e.stream_id not in streams, "unknown stream"),
        (op == "sync" and e.exposure_alignment is not None and e.exposure_alignment not in ALIGNMENTS, "unknown alignment"), (op == "remove" and e.held, "in a collection or labelled"),
    ]
    if op == "shot":
        rules += [(there, "shot already there"), (not e.named, "no valid identifier"), (not e.known, "unknown golfer"), (e.swing_type not in SWING_TYPES, "unknown swing type")]
    if op in ("shot", "stream"):
        rules += [(e.frame_count is None, "unknown source"), (e.view not in VIEWS, "unknown view"), (op == "stream" and (_blank(e.method) or _blank(e.by)), "same swing decided without method or person")]
    return [text for broken, text in rules if broken]


def _shot(key: tuple, events: Iterator[tuple]) -> Iterator[tuple]:
    """Every edit of a shot with the rules that it breaks, in order, then the shot's streams.

    What an edit leaves as it was has been found right before, but for the sources' owners: ``strange`` are the sources in use that belong to another golfer.  So an edit
    takes as long as what it changes, however many streams there are.
    """
    shot, streams, owners = None, {}, {}
    used, strange = set(), set()

    def settle(source: str) -> None:
        (strange.add if source in used and _differs(owners.get(source), shot.golfer_id) else strange.discard)(source)

    for e in map(Edit._make, (row[1:] for row in events)):
        if e.op == "owner":
            owners[e.source_id] = e.golfer_id
            if shot is not None:
                settle(e.source_id)
            continue
        why = _before(shot, streams, e)
        if not why and e.op == "remove":
            shot, streams = None, {}
            used.clear()
            strange.clear()
        elif not why:
            new, added = _tried(shot, e), e.op in ("shot", "stream")
            st = _new_stream(e, streams) if added else _changed(e, streams[e.stream_id]) if e.op in ON_STREAMS else None
            why = shot_problems(new, len(streams) + added) + (stream_problems(st) if st else [])
            if strange or added and _differs(owners.get(e.source_id), new.golfer_id):
                why.append("source of another golfer")
            if added and st["stream_id"] in streams:
                why.append("duplicate stream id")
            if not why:
                shot = new
                if st:
                    streams[st["stream_id"]] = st
                    used.add(st["source_id"])
        yield (*key, e.seq, sorted(set(why)), None, None)
    if shot is not None:
        whole = {"golfer_id": shot.golfer_id, "swing_type": shot.swing_type, **{k: getattr(shot, k)._asdict() for k in ("same", "sync", "cal")}, "review": dict(zip(("status", "by"), shot.review))}
        for st in streams.values():
            yield (*key, None, None, whole, st)


def known_golfers(golfers: DataFrame, log: DataFrame) -> DataFrame:
    """golfer_id, since: the seq of the edit that added it, null for those that were there."""
    there = golfers.select("golfer_id", F.lit(None).cast("long").alias("since"))
    added = log.where("op = 'golfer'").where(_true(is_identifier(F.col("golfer_id")))).groupBy("golfer_id").agg(F.min("seq").alias("since"))
    return there.unionByName(added.join(there, "golfer_id", "left_anti"))


def owner_changes(sources: DataFrame, log: DataFrame) -> DataFrame:
    """source_id, golfer_id, seq from when it is the owner; a source that is given to the golfer who has it is left out."""
    told = sources.select("source_id", "golfer_id", F.lit(FIRST).alias("seq")).unionByName(log.where("op = 'owner'").select("source_id", "golfer_id", "seq"))
    w = Window.partitionBy("source_id").orderBy("seq", "golfer_id")
    new = (F.row_number().over(w) == 1) | ~F.col("golfer_id").eqNullSafe(F.lag("golfer_id").over(w))
    return told.withColumn("_new", new).where("_new").drop("_new")


def edited_shots(golfers: DataFrame, sources: DataFrame, held: DataFrame, log: DataFrame) -> DataFrame:
    """shot_id, seq and why (the broken rules, none if it was taken) of every edit of a shot; then shot_id, shot and stream of each stream of the shots that are there in the end, with seq null.

    ``golfers``: golfer_id; ``sources``: source_id, golfer_id, frame_count, width, height; ``held``: shot_id of shots in collections or with labels;
    ``log``: the columns of ``LOG``, seq once each; op golfer adds one, owner gives a source to a golfer, shot, stream, window, crop, quality, swing, review, same, sync, cal and remove are of a shot.
    """
    since = known_golfers(golfers, log).select("golfer_id", F.coalesce("since", F.lit(FIRST)).alias("since"))
    edits = log.where("op is null or op not in ('golfer', 'owner')")
    facts = sources.select("source_id", F.col("frame_count").cast("long").alias("frame_count"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    edits = edits.join(facts, "source_id", "left").join(since, "golfer_id", "left").withColumn("known", _true(F.col("since") < F.col("seq"))).drop("since")
    edits = edits.join(held.select("shot_id").distinct().withColumn("held", F.lit(True)), "shot_id", "left").withColumn("named", _true(is_identifier(F.col("shot_id"))))
    told = edits.where("op in ('shot', 'stream')").select("shot_id", "source_id").distinct().join(owner_changes(sources, log), "source_id").withColumn("op", F.lit("owner"))
    events = edits.unionByName(told, allowMissingColumns=True).select("shot_id", *Edit._fields)
    made = StructType.fromDDL(f"seq long, why array<string>, shot {_SHOT}, stream {_STREAM}")
    order = ["seq", "op", *[c for c in Edit._fields if c not in ("seq", "op")]]
    return in_order(events, ["shot_id"], order, _shot, StructType([events.schema["shot_id"], *made]))


def shot_rows(edited: DataFrame) -> DataFrame:
    """One row per stream of the shots that are there."""
    j = edited.where("shot is not null").withColumnRenamed("stream", "t")
    return j.select("shot_id", "shot.golfer_id", "shot.swing_type", F.col("shot.same.status").alias("same"), F.col("shot.sync.status").alias("sync"), F.col("shot.cal.status").alias("cal"), F.col("shot.review.status").alias("review"), "t.stream_id", "t.source_id", "t.view", "t.start_frame", "t.end_frame", F.col("t.crop.x").alias("crop_x"), F.col("t.crop.w").alias("crop_w"), "t.body")


def refusals(edited: DataFrame) -> DataFrame:
    """shot_id, seq, why (sorted texts) of every refused edit."""
    return edited.where("size(why) > 0").select("shot_id", "seq", "why")
