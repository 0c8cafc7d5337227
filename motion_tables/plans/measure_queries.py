"""Queries of measurements in the image: recordings' poses, with points missing on frames of their own; even recordings are face on, every third is left-handed."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import measure as M
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_AT = {"left_ear": 7, "right_ear": 8, "left_shoulder": 1, "right_shoulder": 2, "left_elbow": 3, "right_elbow": 4, "left_wrist": 5, "right_wrist": 6, "left_hip": 13, "right_hip": 14, "left_knee": 15, "right_knee": 16, "left_ankle": 17, "right_ankle": 18}


def _points(spark, d):
    lm, v = F.col("lm"), F.col("video_id")
    there = lambda j: ((F.col("frame") + j + v) % 13 != 4) | ((F.col("frame") == 0) & (v % 4 != 1))
    named = [F.when(there(j), F.struct(P.at(lm, j)["x"].alias("x"), P.at(lm, j)["y"].alias("y"))).alias(n) for n, j in _AT.items()]
    return M.named(D.pose(spark, d).select("video_id", "frame", F.when(v % 2 == 0, "face_on").otherwise("dtl").alias("view"), F.when(v % 3 == 0, "left").otherwise("right").alias("handedness"), *named))


def _references(spark, d):
    return M.body_references(_points(spark, d).where("frame = 0"))


def _xy(name):
    j = _AT[name]
    there = f"((frame + {j} + video_id) % 13 <> 4 OR (frame = 0 AND video_id % 4 <> 1))"
    return ", ".join(f"CASE WHEN {there} THEN e[{3 * j + k}] END AS {name}_{a}" for k, a in ((1, "x"), (2, "y")))


def _side(role, joint, a):
    one, two = ("left", "right") if role == "lead" else ("right", "left")
    return f"CASE WHEN video_id % 3 <> 0 THEN {one}_{joint}_{a} ELSE {two}_{joint}_{a} END AS {role}_{joint}_{a}"


_CENTRES = {"head": ("left_ear", "right_ear"), "shoulders": ("left_shoulder", "right_shoulder"), "hips": ("left_hip", "right_hip"), "lead_wrist": ("lead_wrist", "lead_wrist"), "trail_wrist": ("trail_wrist", "trail_wrist"), "hands": ("lead_wrist", "trail_wrist")}
_NAMED = f"""{D.POSE}, n0 AS (SELECT video_id, frame, {', '.join(_xy(n) for n in _AT)} FROM p), n1 AS (SELECT *, {', '.join(_side(r, j, a) for r in ('lead', 'trail') for j in M.JOINTS for a in 'xy')} FROM n0)
, n2 AS (SELECT *, {', '.join(f'({a}_{k} + {b}_{k}) / 2 AS c_{c}_{k}' for c, (a, b) in _CENTRES.items() for k in 'xy')} FROM n1), n3 AS (SELECT *, sqrt(power(c_shoulders_x - c_hips_x, 2) + power(c_shoulders_y - c_hips_y, 2)) AS torso FROM n2)
, r0 AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN lead_hip_x - trail_hip_x ELSE c_shoulders_x - c_hips_x END AS cue, CASE WHEN torso IS NULL THEN 'P1 torso (both shoulders and both hips) not detected' END AS no_reference FROM n3 WHERE frame = 0)
, r1 AS (SELECT *, CASE WHEN no_reference IS NOT NULL THEN NULL WHEN video_id % 2 = 0 AND cue IS NULL THEN 'P1 hips not detected' WHEN abs(cue) < 0.05::DOUBLE * torso THEN CASE WHEN video_id % 2 = 0 THEN 'P1 hips overlap horizontally; target direction unknown' ELSE 'no forward bend at P1; ball direction unknown' END END AS orientation_reason FROM r0)
, rf AS (SELECT *, CASE WHEN no_reference IS NULL AND orientation_reason IS NULL THEN CASE WHEN cue > 0 THEN 1 ELSE -1 END END AS sign FROM r1)"""


@_R.add("d21_body_references", f"WITH {_NAMED} SELECT video_id, round(torso, 6) AS scale, CAST(sign AS DOUBLE) AS sign, orientation_reason, no_reference, round(c_hands_x, 6) AS hands_x FROM rf")
def body_references(spark, d):
    return rounded(_references(spark, d).select("video_id", "scale", "sign", "orientation_reason", "no_reference", F.col("p1_hands.x").alias("hands_x")))


def _flexion(a, v, b):
    u, w = (f"sqrt(power({q}_x - {v}_x, 2) + power({q}_y - {v}_y, 2))" for q in (a, b))
    cos = f"(({a}_x - {v}_x) * ({b}_x - {v}_x) + ({a}_y - {v}_y) * ({b}_y - {v}_y)) / ({u} * {w})"
    return f"180 - degrees(acos(least(greatest({cos}, -1), 1)))", f"CASE WHEN {a}_x IS NULL OR {v}_x IS NULL OR {b}_x IS NULL THEN 'landmark not detected' END"


_ORIENTED = "CASE WHEN r.sign IS NULL THEN coalesce(r.orientation_reason, r.no_reference) END"
_SHOULDERS = "sqrt(power(lead_shoulder_x - trail_shoulder_x, 2) + power(lead_shoulder_y - trail_shoulder_y, 2))"
_KEYS = {f"{s}_{k}_flexion": _flexion(*(f"{s}_{j}" for j in js)) for s in ("lead", "trail") for k, js in (("elbow", ("shoulder", "elbow", "wrist")), ("knee", ("hip", "knee", "ankle")))}
_KEYS["spine_inclination"] = ("degrees(atan2(r.sign * (n.c_shoulders_x - n.c_hips_x), n.c_hips_y - n.c_shoulders_y))", f"coalesce(CASE WHEN n.torso IS NULL THEN 'landmark not detected' END, {_ORIENTED})")
_KEYS["shoulder_tilt"] = ("degrees(atan2(trail_shoulder_y - lead_shoulder_y, abs(lead_shoulder_x - trail_shoulder_x)))", f"CASE WHEN lead_shoulder_x IS NULL OR trail_shoulder_x IS NULL THEN 'landmark not detected' WHEN {_SHOULDERS} < 0.2::DOUBLE * torso THEN 'shoulders overlap in this projection' END")
_KEYS["lead_arm_inclination"] = ("degrees(atan2(lead_shoulder_y - lead_wrist_y, abs(lead_wrist_x - lead_shoulder_x)))", "CASE WHEN lead_shoulder_x IS NULL OR lead_wrist_x IS NULL THEN 'landmark not detected' END")
_KEYS = {k: tuple(" ".join(t.split()) for t in v) for k, v in _KEYS.items()}
_COLUMNS = ", ".join(f"n.{r}_{j}_{a}" for r in ("lead", "trail") for j in M.JOINTS for a in "xy")
for _c in M.CENTRES:
    _lost = f"CASE WHEN r.torso IS NULL THEN r.no_reference WHEN n.c_{_c}_x IS NULL THEN 'landmark not detected' WHEN r.c_{_c}_x IS NULL THEN 'not detected at P1' END"
    _KEYS[f"{_c}_dx"] = (f"r.sign * (n.c_{_c}_x - r.c_{_c}_x) / r.torso", f"coalesce({_lost}, {_ORIENTED})")
    _KEYS[f"{_c}_dy"] = (f"(r.c_{_c}_y - n.c_{_c}_y) / r.torso", _lost)


def _bare(text):
    """Names of a frame's own points get its prefix."""
    import re

    return re.sub(r"(?<![.\w])((?:lead|trail)_\w+_[xy]|torso)\b", r"n.\1", text)


@_R.add("d22_measurements", f"WITH {_NAMED} " + " UNION ALL ".join(f"SELECT n.video_id, n.frame, '{k}' AS key, CASE WHEN ({_bare(w)}) IS NULL THEN round({_bare(v)}, 5) + 0 END AS value, {_bare(w)} AS reason FROM n3 n JOIN rf r ON r.video_id = n.video_id" for k, (v, w) in _KEYS.items()))
def measurements(spark, d):
    return rounded(M.measurements(_points(spark, d), _references(spark, d)), 5)


@_R.add("d23_slot_comparison", f"WITH {_NAMED}, m AS (" + " UNION ALL ".join(f"SELECT n.video_id, n.frame, '{k}' AS key, CASE WHEN ({_bare(w)}) IS NULL THEN {_bare(v)} END AS value, {_bare(w)} AS reason FROM n3 n JOIN rf r ON r.video_id = n.video_id WHERE n.frame = 7" for k, (v, w) in _KEYS.items()) + """)
SELECT u.video_id AS pair_id, u.key, round(u.value, 2) AS user_value, round(r.value, 2) AS ref_value, round(u.value - r.value, 2) + 0 AS difference, CASE WHEN u.reason IS NOT NULL OR r.reason IS NOT NULL THEN concat_ws('; ', 'user: ' || u.reason, 'reference: ' || r.reason) END AS note FROM m u JOIN m r ON r.video_id = u.video_id + 2 AND r.key = u.key""")
def slot_comparison(spark, d):
    """The frames of one position of a user and a reference recording of the same view, every measurement side by side."""
    p = _points(spark, d)
    m = M.measurements(p.where("frame = 7"), _references(spark, d))
    return rounded(M.slot_comparison(m.withColumnRenamed("video_id", "pair_id"), m.withColumn("pair_id", F.col("video_id") - 2)), 2)


_MINE = M.Measurements()


@_MINE.add("hand_gap", "Distance of the wrists", ["lead_wrist", "trail_wrist"])
def _hand_gap(a, b):
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


@_MINE.add("knee_lead", "Lead knee ahead of the trail one", ["lead_knee", "trail_knee"], view="face_on")
def _knee_lead(a, b):
    return a["x"] - b["x"]


@_MINE.add("arm_ratio", "Forearm over upper arm", ["lead_shoulder", "lead_elbow", "lead_wrist"])
def _arm_ratio(s, e, w):
    upper = F.hypot(s["x"] - e["x"], s["y"] - e["y"])
    return F.hypot(e["x"] - w["x"], e["y"] - w["y"]) / F.when(upper > 0.1, upper)


def _user_sql(key, joints, value, cond="true", undefined="false"):
    gone = ", ".join(f"CASE WHEN {j}_x IS NULL THEN '{j}' END" for j in joints)
    return f"SELECT video_id, frame, '{key}' AS key, CASE WHEN len(gone) = 0 AND NOT coalesce({undefined}, false) THEN round({value}, 6) END AS value, CASE WHEN len(gone) > 0 THEN 'not detected: ' || array_to_string(gone, ', ') WHEN {undefined} THEN 'undefined' END AS reason FROM (SELECT *, list_filter([{gone}], lambda g: g IS NOT NULL) AS gone FROM n1) WHERE {cond}"


_UPPER = "sqrt(power(lead_shoulder_x - lead_elbow_x, 2) + power(lead_shoulder_y - lead_elbow_y, 2))"


@_R.add("u3_user_measurements", f"""WITH {_NAMED} {_user_sql('hand_gap', ['lead_wrist', 'trail_wrist'], 'sqrt(power(lead_wrist_x - trail_wrist_x, 2) + power(lead_wrist_y - trail_wrist_y, 2))')}
UNION ALL {_user_sql('knee_lead', ['lead_knee', 'trail_knee'], 'lead_knee_x - trail_knee_x', 'video_id % 2 = 0')}
UNION ALL {_user_sql('arm_ratio', ['lead_shoulder', 'lead_elbow', 'lead_wrist'], 'sqrt(power(lead_elbow_x - lead_wrist_x, 2) + power(lead_elbow_y - lead_wrist_y, 2)) / ' + _UPPER, undefined=_UPPER + ' <= 0.1::DOUBLE')}""")
def user_measurements(spark, d):
    """Three measurements that a user has added to a catalog of their own."""
    return rounded(_MINE.measured(_points(spark, d)))
