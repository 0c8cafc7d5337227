"""Picks that depend on the pick before, against a loop over the frames."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motion_tables.operators import follow as W


def boxes(seed, frames=300):
    """Two or three people who drift, cross and vanish, and boxes that are not sure."""
    r, out = random.Random(seed), []
    at = [[r.uniform(0, 300), r.uniform(0, 60)] for _ in range(3)]
    for f in range(frames):
        for k, p in enumerate(at):
            p[0] = (p[0] + r.gauss(2 * (k - 1), 6)) % 300
            if r.random() < 0.85 and not 100 <= f <= 104:
                out.append((f, k, p[0], p[1], p[0] + 60 + 10 * k, p[1] + 120, r.uniform(0.35, 1)))
    return out


def iou(a, b):
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    every = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / every if every > 0 else 0.0


def people(rows, frames):
    last, out = None, {}
    for f in range(frames):
        sure = [r[2:] for r in sorted(rows) if r[0] == f and r[6] >= 0.5]
        same = [b for b in sure if last and iou(b, last) >= 0.3]
        last = max(same, key=lambda b: iou(b, last)) if same else max(sure, key=lambda b: (b[2] - b[0]) * (b[3] - b[1]), default=None)
        out[f] = last
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_person_boxes(spark, monkeypatch, block):
    monkeypatch.setattr(W.followed, "__kwdefaults__", {"block": block})
    given = {v: boxes(v) for v in range(4)}
    df = spark.createDataFrame([(v, *r) for v, rows in given.items() for r in rows], "video_id int, frame int, candidate int, x0 double, y0 double, x1 double, y1 double, score double")
    frames = spark.range(1200).select((F.col("id") % 4).cast("int").alias("video_id"), F.floor(F.col("id") / 4).alias("frame"))
    got = defaultdict(dict)
    for r in W.person_boxes(frames, df.repartition(5)).collect():
        got[r.video_id][r.frame] = tuple(r)[2:] if r.x0 is not None else None
    assert {v: dict(x) for v, x in got.items()} == {v: people(rows, 300) for v, rows in given.items()}


def test_who_is_followed_through_crossings_depends_on_all_before(spark):
    """Two people always in view: no frame decides anew, so what is picked in the last comes down from the first."""
    n = 2000
    rows = [(0, f, k, 50.0 * k + (f % 7), 0.0, 50.0 * k + (f % 7) + 40 + 5 * (k if f else 1 - k), 100.0, 0.9) for f in range(n) for k in range(2)]
    df = spark.createDataFrame(rows, "video_id int, frame int, candidate int, x0 double, y0 double, x1 double, y1 double, score double")
    got = W.person_boxes(df.select("video_id", "frame").distinct(), df).collect()
    assert len(got) == n and all(r.x0 < 10 for r in got)


@pytest.mark.parametrize("block", [4, 256])
def test_shaft_segments(spark, monkeypatch, block):
    monkeypatch.setattr(W.followed, "__kwdefaults__", {"block": block})
    r = random.Random(8)
    frames = [(v, f, 320, 240, 640, 480) for v in range(3) for f in range(120) if f % 13]
    found = [(v, f, c, 320 + r.randrange(-80, 80), 240 + r.randrange(-80, 80), 320 + r.randrange(-200, 200), 240 + r.randrange(-200, 200)) for v, f, *_ in frames for c in range(r.randrange(0, 5))]
    found += [(0, 30, 9, 320, 240, 320, 240), (0, 31, 8, 320, 240, 420, 240)]
    want, last = {}, {}
    for v, f, gx, gy, w, h in frames:
        best, top = None, 0.0
        for _, _, c, x1, y1, x2, y2 in sorted(s for s in found if s[:2] == (v, f)):
            a, b = math.dist((x1, y1), (gx, gy)), math.dist((x2, y2), (gx, gy))
            if b < a:
                x1, y1, x2, y2 = x2, y2, x1, y1
            length, angle = math.dist((x1, y1), (x2, y2)), math.atan2(y2 - y1, x2 - x1)
            if length < 72 or min(a, b) > 72 or not math.radians(20) <= abs(angle) <= math.pi - math.radians(20):
                continue
            score = length * abs(math.sin(angle)) * (1.0 if y2 > y1 else 0.7) * (max(0.3, 1 - abs(angle - last[v]) / math.radians(45)) if v in last else 1.0) / (min(a, b) + 1)
            if score > top:
                best, top, turned = (x1, y1, x2, y2), score, angle
        if best:
            last[v] = turned
        want[v, f] = best
    a = spark.createDataFrame(frames, "video_id int, frame int, grip_x int, grip_y int, width int, height int")
    b = spark.createDataFrame(found, "video_id int, frame int, candidate int, x1 int, y1 int, x2 int, y2 int")
    got = {(x.video_id, x.frame): None if x.x1 is None else (x.x1, x.y1, x.x2, x.y2) for x in W.shaft_segments(a, b).collect()}
    assert got == want and 0 < sum(v is not None for v in want.values()) < len(want)
    assert W.shaft_segments(a, b.limit(0)).where("x1 is null").count() == len(frames) and W.shaft_segments(a.limit(0), b).count() == 0
