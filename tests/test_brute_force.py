"""Queries without SQL against plain Python over the smallest tables."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motion_tables.operators import metrics as M
from motion_tables.plans.queries import QUERIES
from motion_tables.sources import derived as D

FOLDER = "/root/testdata/sf0.001"


def test_w10_repaired_times(spark):
    s = defaultdict(list)
    for r in D.signal(spark, FOLDER).collect():
        t = None if r.frame % 8 == 3 else r.t_ms - 60 if r.frame % 8 == 6 else r.t_ms
        s[r.video_id].append((r.frame, t))
    want = {}
    for v, rows in s.items():
        last = None
        for f, t in sorted(rows):
            missing = t is None
            now = (0.0 if last is None else last + 16.67) if missing else t
            behind = not missing and last is not None and now <= last
            now = max(f * 1000 / 60, last + 0.001) if behind else now
            want[v, f] = (round(now, 6), missing or behind)
            last = now
    got = {(r.video_id, r.frame): (r.t_ms, r.estimated) for r in QUERIES["w10_repaired_times"](spark, FOLDER).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 for k in want)


@pytest.fixture(scope="module")
def labels(spark):
    return D.labels(spark, FOLDER)


def test_a12_bootstrap(spark, labels):
    got = {r.view: r for r in M.paired_bootstrap(labels, "F", "O", 0.05, draws=200).collect()}
    again = {r.view: r for r in M.paired_bootstrap(labels.repartition(5), "F", "O", 0.05, draws=200).collect()}
    assert got == again
    frames = defaultdict(lambda: [0, 0, 0, 0])
    for r in labels.collect():
        f = frames[r.view, r.video_id, r.frame]
        k = 0 if r.backend == "F" else 2
        f[k] += r.err is not None and r.err <= 0.05
        f[k + 1] += 1
    rng = np.random.RandomState(0)
    for view, r in got.items():
        c = np.array([f for (v, *_), f in frames.items() if v == view and f[1] and f[3]], float)
        share = lambda t: t[..., 2] / t[..., 3] - t[..., 0] / t[..., 1]
        assert abs(r.difference - share(c.sum(axis=0))) < 1e-9
        d = share(rng.poisson(1, (2000, len(c))) @ c)
        low, high = np.nanpercentile(d, [2.5, 97.5])
        assert abs(r.low - low) < 0.35 * (high - low) and abs(r.high - high) < 0.35 * (high - low)


def test_g4_reasons(spark):
    from motion_tables.operators import geometry as G

    p = G.point_reasons(spark.createDataFrame([(1, 1.0, 1.0, 1.0, [0.0] * 9, 0.5, 30.0, True, 2), (2, 1.0, 1.0, 1.0, [0.0] * 9, 9.0, 1.0, False, 2)], G.OUT.replace("cov array<double>", "cov array<double>")))
    by_id = {r.point_id: r.reasons for r in p.collect()}
    assert not by_id[1] and len(by_id[2]) >= 3


def test_j20_transfer(spark):
    from motion_tables.operators import align as A

    path = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 5)], "pair_id long, user_frame int, ref_frame int")
    pos = spark.createDataFrame([(1, "P1", 0), (1, "P4", 3), (1, "P7", 4), (1, "P9", 99)], "pair_id long, p string, ref_frame int")
    assert {r.p: r.user_frame for r in A.transferred(path, pos).collect()} == {"P1": 0, "P4": 2, "P7": 3, "P9": 3}


def test_d12_features(spark):
    f = QUERIES["d12_dtw_features"](spark, FOLDER) if "d12_dtw_features" in QUERIES else QUERIES[next(k for k in QUERIES if k.startswith("d12"))](spark, FOLDER)
    rows = f.collect()
    assert rows and f.select("video_id", "frame").distinct().count() == len(rows)


def test_fits_recover_what_made_them(spark):
    """Planes, circles and velocities in random directions, against their makers."""
    from motion_tables.operators import fits as X

    rng, rows, truth = np.random.RandomState(4), [], {}
    for shot in range(12):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        centre, radius, w, phase = rng.normal(size=3), 1 + rng.rand(), 20 + rng.rand(), -0.3
        for k in range(-16, 17):
            t = k * 0.004
            p = centre + radius * (np.cos(w * t + phase) * q[0] + np.sin(w * t + phase) * q[1])
            rows.append((shot, t, *map(float, p), 0.002, 0.001))
        truth[shot] = (q, centre, radius, w, phase)
    s = spark.createDataFrame(rows, "shot_id long, t double, x double, y double, z double, sigma_m double, timing_error_m double")
    for r in X.swing_planes(s).collect():
        n = truth[r.shot_id][0][2]
        tilt = np.degrees(np.arccos(abs(n[2])))
        assert abs(r.inclination_deg - tilt) < 1e-6 if r.reason is None else tilt < X.MIN_INCLINATION_DEG
    for r in X.arc_low_points(s).collect():
        q, centre, radius, *_ = truth[r.shot_id]
        down = np.array([0, 0, -1.0]) + q[2][2] * q[2]
        assert np.allclose([r.x, r.y, r.z], centre + radius * down / np.linalg.norm(down), atol=1e-6) and abs(r.radius_m - radius) < 1e-6
    for r in X.impact_velocity(s).collect():
        q, _, radius, w, phase = truth[r.shot_id]
        assert abs(r.speed - radius * w) < 0.01 * radius * w
    cov = rng.normal(size=(20, 3, 3))
    cov = cov @ cov.transpose(0, 2, 1)
    got = X.largest_sigma(spark.createDataFrame([(i, [float(v) for v in c.ravel()]) for i, c in enumerate(cov)], "id int, cov array<double>")).collect()
    assert all(abs(r.sigma_m**2 - np.linalg.eigvalsh(cov[r.id]).max()) < 1e-9 for r in got)


def test_d16_transfer_of_a_recording_to_itself_keeps_what_is_not_refined(spark):
    from motion_tables.operators import align as A
    from motion_tables.operators import shaft as S

    p = D.pose(spark, FOLDER)
    v = p.groupBy("video_id").agg(F.max("frame").alias("n")).where("n >= 4")
    pairs = v.select(F.col("video_id").cast("long").alias("pair_id"), F.col("video_id").alias("user_id"), F.col("video_id").alias("ref_id"))
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), F.lit(f).alias("ref_frame")) for k, f in (("P1", 0), ("P4", 1), ("P6", 2), ("P9", 3))])).alias("m")
    got = {(r.pair_id, r.p): r.frame for r in A.label_transfer(p, pairs, pairs.select("pair_id", marks).select("pair_id", "m.*")).collect()}
    plain = v.select(F.col("video_id"), *[F.lit(f).cast("long").alias(k) for k, f in (("p1", 0), ("p4", 1), ("p6", 2), ("p9", 3))])
    want = {(r.video_id, r.p): r.frame for r in S.local_refinements(p.join(v.select("video_id"), "video_id"), plain).collect()}
    assert got == want and len(got) == 9 * v.count()


def test_world_frames_recover_the_rig(spark):
    """Ground, line and ball of known worlds seen from turned rigs."""
    from motion_tables.operators import fits as X

    rng, rows, truth = np.random.RandomState(9), [], {}
    for shot in range(20):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn = turn if np.linalg.det(turn) > 0 else -turn
        at = rng.normal(size=3) * 3
        rig = lambda p, turn=turn, at=at: [float(v) for v in turn.T @ (np.asarray(p, float) - at)]
        ground = [rig([*rng.normal(size=2), rng.normal() * 1e-3]) for _ in range(6)]
        front = [2.0, 0.0, 0.3] if shot % 4 else [0.5, 0.0, 2.0]
        rows.append((shot, ground if shot % 5 else ground[:2], rig([0, 0, 0.3]), rig(front), rig([0, 0, 0.02]), rig([0, 0, 2.0])))
        truth[shot] = (turn, at)
    e = spark.createDataFrame(rows, "shot_id int, ground array<array<double>>, back array<double>, front array<double>, ball array<double>, up array<double>")
    for r in X.world_frames(e).collect():
        if r.shot_id % 5 == 0 or r.shot_id % 4 == 0:
            assert r.rig_to_world is None and r.reason == ("no ground" if r.shot_id % 5 == 0 else "target line nearly upright")
            continue
        m, (turn, at) = np.array(r.rig_to_world).reshape(4, 4), truth[r.shot_id]
        assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3), atol=1e-9) and np.linalg.det(m[:3, :3]) > 0
        assert np.abs(m[:3, :3] - turn).max() < 0.02 and np.abs(m[:3, 3] - at).max() < 0.02
    def floats(*points):
        return [[float(v) for v in p] for p in points]

    line = (*floats([0, 0, 0], [2, 0, 0], [0, 0, 0], [0, 0, 1]),)
    flat = spark.createDataFrame([(1, floats([0, 0, 0], [1, 0, 0], [2, 0, 0]), *line), (2, floats([0, 0, 0], [1, 0, 0.2], [0, 1, 0.3], [1, 1, -0.4]), *line), (3, None, None, None, None, None)], e.schema)
    assert {r.shot_id: r.reason for r in X.world_frames(flat).collect()} == {1: "ground points in one line", 2: "ground points off a plane", 3: "no ball"}
