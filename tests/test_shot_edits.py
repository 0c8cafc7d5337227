"""Edit logs of shots against one edit after the other."""

import copy
import re

import pytest

from motion_tables.operators import shot_edits as S
from motion_tables.plans.edit_queries import QUERIES, shot_tables

NA = {"status": "not_applicable", "method": None, "by": None, "uncertainty_ms": None, "exposure_alignment": None, "exposure_uncertainty_ms": None}


def blank(x):
    return not (x or "").strip(" ")


def broken(shot, owners):
    out, n, same, sync, cal = set(), len(shot["streams"]), shot["same"], shot["sync"], shot["cal"]
    names = [s["stream_id"] for s in shot["streams"]]
    if len(set(names)) < n:
        out.add("duplicate stream id")
    for s in shot["streams"]:
        if owners.get(s["source_id"]) not in (None, shot["golfer_id"]):
            out.add("source of another golfer")
        if not 0 <= s["start_frame"] <= s["end_frame"] < s["frame_count"]:
            out.add("window not within the source")
        if c := s["crop"]:
            if min(c["x"], c["y"]) < 0 or min(c["w"], c["h"]) < 1:
                out.add("crop without place or size")
            elif c["x"] + c["w"] > s["width"] or c["y"] + c["h"] > s["height"]:
                out.add("crop past the frame")
    if n == 1 and (same["status"] != "not_applicable" or sync["status"] != "not_applicable"):
        out.add("one stream, but not not_applicable")
    if n != 1:
        if same["status"] not in ("asserted", "verified"):
            out.add("several streams, but not of the same swing")
        if "not_applicable" in (sync["status"], cal["status"]):
            out.add("several streams, but no synchronization or calibration")
        if sync["status"] == "verified" and same["status"] != "verified":
            out.add("synchronization verified, same swing not")
    align, extra = sync["exposure_alignment"] or "unknown", sync["exposure_uncertainty_ms"]
    if (sync["uncertainty_ms"] or 0) < 0:
        out.add("negative uncertainty")
    if (extra or 0) < 0:
        out.add("negative exposure uncertainty")
    if align == "bounded" and extra is None:
        out.add("exposure bounded without a bound")
    if align != "bounded" and extra is not None:
        out.add("exposure bound without being bounded")
    if align != "unknown" and sync["status"] not in ("estimated", "verified"):
        out.add("exposure alignment without synchronization")
    for k, what in (("same", "same swing"), ("sync", "synchronization"), ("cal", "calibration")):
        if shot[k]["status"] in ("verified", "asserted", "estimated") and (blank(shot[k]["method"]) or blank(shot[k]["by"])):
            out.add(f"{what} decided without method or person")
    if shot["review"]["status"] != "unreviewed" and blank(shot["review"]["by"]):
        out.add("review without a reviewer")
    return out


def replay(golfers, sources, held, log):
    """One edit after the other on plain dicts."""
    golfers, owners, shots, refused = set(golfers), {k: v["golfer_id"] for k, v in sources.items()}, {}, {}
    for e in sorted(log, key=lambda e: e["seq"]):
        op, id_, shot, why = e["op"], e["shot_id"], shots.get(e["shot_id"]), set()
        if op == "golfer":
            if re.fullmatch("[A-Za-z0-9][A-Za-z0-9._-]*", e["golfer_id"]):
                golfers.add(e["golfer_id"])
            continue
        if op == "owner":
            owners[e["source_id"]] = e["golfer_id"]
            continue
        src = sources.get(e["source_id"])
        if op not in ("shot", "stream", "remove", "window", "crop", "quality", "swing", "review", "same", "sync", "cal"):
            why.add("unknown edit")
        if op == "shot":
            why |= ({"shot already there"} if shot else set()) | ({"no valid identifier"} if "?" in id_ else set()) | (set() if e["golfer_id"] in golfers else {"unknown golfer"}) | (set() if e["swing_type"] in S.SWING_TYPES else {"unknown swing type"})
        elif shot is None:
            why.add("unknown shot")
        if op in ("shot", "stream"):
            why |= (set() if src else {"unknown source"}) | (set() if e["view"] in S.VIEWS else {"unknown view"})
        if op == "stream" and (blank(e["method"]) or blank(e["by"])):
            why.add("same swing decided without method or person")
        if op in ("window", "crop", "quality") and shot and e["stream_id"] not in [s["stream_id"] for s in shot["streams"]]:
            why.add("unknown stream")
        if op == "review" and e["status"] not in S.REVIEWS:
            why.add("unknown status")
        if op == "sync" and (e["exposure_alignment"] or "unknown") not in S.ALIGNMENTS:
            why.add("unknown alignment")
        if op == "remove" and id_ in held:
            why.add("in a collection or labelled")
        if not why and op == "remove":
            del shots[id_]
            continue
        if not why:
            new = copy.deepcopy(shot) if op != "shot" else {"golfer_id": e["golfer_id"], "swing_type": e["swing_type"], "streams": [], "same": dict(NA), "sync": dict(NA), "cal": {**NA, "status": "unknown"}, "review": {"status": "unreviewed", "by": None}}
            if op in ("shot", "stream"):
                taken = [s["stream_id"] for s in new["streams"]]
                name = e["stream_id"] or (e["view"] if e["view"] not in taken else f"{e['view']}-{len(taken) + 1}")
                new["streams"].append({"stream_id": name, "source_id": e["source_id"], "view": e["view"], "start_frame": e["start_frame"], "end_frame": e["end_frame"], "crop": e["crop"], "body": "unassessed", **{k: src[k] for k in ("frame_count", "width", "height")}})
            if op == "stream":
                for k, to in (("same", {**NA, "status": "asserted", "method": e["method"], "by": e["by"]}), ("sync", {**NA, "status": "unknown"}), ("cal", {**NA, "status": "unknown"})):
                    if new[k]["status"] == "not_applicable":
                        new[k] = to
            for s in new["streams"]:
                if s["stream_id"] == e["stream_id"]:
                    s |= {"start_frame": e["start_frame"], "end_frame": e["end_frame"]} if op == "window" else {"crop": e["crop"]} if op == "crop" else {"body": e["body"] or s["body"]} if op == "quality" else {}
            if op == "swing":
                new["swing_type"] = e["swing_type"]
            if op == "review":
                new["review"] = {"status": e["status"], "by": e["by"] if e["status"] != "unreviewed" else None}
            if op in ("same", "sync", "cal"):
                new[op] = {**NA, "status": e["status"], "method": e["method"], "by": e["by"]}
                if op == "sync":
                    new[op] |= {"uncertainty_ms": e["uncertainty_ms"], "exposure_alignment": e["exposure_alignment"] or "unknown", "exposure_uncertainty_ms": e["exposure_uncertainty_ms"]}
            why = broken(new, owners)
            if not why:
                shots[id_] = new
        if why:
            refused[e["seq"]] = sorted(why)
    rows = {(i, s["golfer_id"], s["swing_type"], s["same"]["status"], s["sync"]["status"], s["cal"]["status"], s["review"]["status"], t["stream_id"], t["source_id"], t["view"], t["start_frame"], t["end_frame"], (t["crop"] or {}).get("x"), (t["crop"] or {}).get("w"), t["body"]) for i, s in shots.items() for t in s["streams"]}
    return rows, refused


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_against_one_edit_after_the_other(spark, sf):
    folder = f"/root/testdata/{sf}"
    golfers, sources, held, log = shot_tables(spark, folder)
    rows, refused = replay([r[0] for r in golfers.collect()], {r.source_id: r.asDict() for r in sources.collect()}, {r[0] for r in held.collect()}, [r.asDict(True) for r in log.collect()])
    assert len(rows) > 20 and len({t for why in refused.values() for t in why}) > 20
    assert {tuple(r) for r in QUERIES["c11_edited_shots"](spark, folder).collect()} == rows
    assert {r.seq: r.why for r in QUERIES["c11_refused_shot_edits"](spark, folder).collect()} == refused


def test_an_owner_who_changes_closes_the_shot(spark):
    """A source given to another golfer makes later edits of its shots fail, until it is given back; earlier ones stand."""
    def row(seq, op, **more):
        names = [c.split()[0].strip("`") for c in S.LOG.replace(S._CROP, "crop_type").split(", ")]
        return tuple({"seq": seq, "op": op, "shot_id": "a", **more}.get(n) for n in names)

    made = {"golfer_id": "g1", "source_id": "s1", "view": "face_on", "start_frame": 0, "end_frame": 5, "swing_type": "full"}
    edits = [row(1, "shot", **made), row(2, "golfer", golfer_id="g1"), row(3, "shot", **made), row(4, "window", stream_id="face_on", start_frame=1, end_frame=4), row(5, "owner", source_id="s1", golfer_id="g9"), row(6, "swing", swing_type="half"), row(7, "owner", source_id="s1", golfer_id="g1"), row(8, "swing", swing_type="half"), row(9, "window", stream_id="face_on", start_frame=1, end_frame=10)]
    log = spark.createDataFrame(edits, S.LOG)
    sources = spark.createDataFrame([("s1", None, 10, 64, 48)], "source_id string, golfer_id string, frame_count int, width int, height int")
    none = spark.createDataFrame([], "golfer_id string, shot_id string")
    edited = S.edited_shots(none, sources, none, log)
    assert {r.seq: r.why for r in S.refusals(edited).collect()} == {1: ["unknown golfer"], 6: ["source of another golfer"], 9: ["window not within the source"]}
    assert [(r.swing_type, r.start_frame, r.end_frame) for r in S.shot_rows(edited).collect()] == [("half", 1, 4)]
    assert S.edited_shots(none, sources, none, log.limit(0)).count() == 0


def test_a_shot_is_never_gathered(spark, capsys):
    """A shot's edits are read in order, not made one array: the plan collects nothing; an owner told again is no event."""
    golfers, sources, held, log = shot_tables(spark, "/root/testdata/sf0.001")
    edited = S.edited_shots(golfers, sources, held, log)
    edited.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert edited.where("seq is not null").count() == log.where("op is null or op not in ('golfer', 'owner')").count()
    told = spark.createDataFrame([(1, "s1", "g1"), (2, "s1", "g1"), (3, "s1", None), (4, "s1", None), (5, "s1", "g1")], "seq long, source_id string, golfer_id string").selectExpr("*", "'owner' AS op")
    changes = S.owner_changes(spark.createDataFrame([("s1", "g1")], "source_id string, golfer_id string"), told)
    assert sorted(r.seq for r in changes.collect()) == [S.FIRST, 3, 5]
