"""Operators on small series with known answers."""

import math

import numpy as np
import pytest

from motion_tables.functions import text as T
from motion_tables.operators import align as A
from motion_tables.operators import detect as X
from motion_tables.operators import geometry as G
from motion_tables.operators import joins as J
from motion_tables.operators import metrics as M
from motion_tables.operators import windows as W


def series(spark, values, step=16.67, video="v"):
    return spark.createDataFrame([(video, i, i * step, float(v)) for i, v in enumerate(values)], "video_id string, frame int, t_ms double, speed double")


def test_standing_still_has_a_flat_baseline_and_no_burst(spark):
    s = X.baseline(series(spark, [0.0] * 100), "speed", 500.0)
    assert tuple(s.select("median", "mad").first()) == (0.0, 0.001)
    assert X.bursts(s, "speed").count() == 0
    assert X.swing_window(series(spark, [0.0] * 100)).count() == 0


def test_bursts_end_with_the_first_frame_under_the_lower_threshold(spark):
    values = [0.0] * 20 + [0.1] * 10 + [0.0] * 20 + [0.5] * 30
    got = X.bursts(X.baseline(series(spark, values), "speed", 200.0), "speed").orderBy("start").collect()
    assert [(r["start"], r["end"], r["peak"]) for r in got] == [(20, 30, 0.1), (50, 79, 0.5)]


def burst_loop(v, median, mad):
    """The rule as a loop."""
    out, start, peak = [], None, 0.0
    for i, x in enumerate(v):
        if start is None:
            if x > median + 3 * mad:
                start, peak = i, x
        else:
            peak = max(peak, x)
            if x < median + 1.5 * mad:
                if i - start >= 5:
                    out.append((start, i, peak))
                start = None
    if start is not None and len(v) - start >= 5:
        out.append((start, len(v) - 1, peak))
    return out


def test_bursts_agree_with_the_loop_on_random_series(spark):
    rng = np.random.RandomState(0)
    series_ = {f"v{k}": np.round(np.abs(rng.normal(0, 1, 80)) ** 2, 3) for k in range(30)}
    rows = [(k, i, i * 10.0, float(x)) for k, v in series_.items() for i, x in enumerate(v)]
    s = X.baseline(spark.createDataFrame(rows, "video_id string, frame int, t_ms double, speed double"), "speed", 300.0).cache()
    base = {r[0]: (r[1], r[2]) for r in s.select("video_id", "median", "mad").distinct().collect()}
    got = {}
    for r in X.bursts(s, "speed").collect():
        got.setdefault(r["video_id"], []).append((r["start"], r["end"], r["peak"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: b for k, v in series_.items() if (b := burst_loop(v, *base[k]))}


def test_savgol_is_the_fit_of_a_quadratic(spark):
    rng = np.random.RandomState(1)
    v = rng.normal(size=20)
    got = [r[0] for r in W.savgol7(series(spark, v), "speed", "s").orderBy("frame").select("s").collect()]
    want = []
    for i in range(20):
        a = min(max(i - 3, 0), 13)
        want.append(np.polyval(np.polyfit(np.arange(7), v[a : a + 7], 2), i - a))
    assert np.allclose(got, want)
    assert [r[0] for r in W.savgol7(series(spark, v[:6]), "speed", "s").orderBy("frame").select("s").collect()] == list(v[:6])


@pytest.mark.parametrize("n,step,count", [(100, 33.33, 198), (200, 8.33, 100)])
def test_resampling_to_60_hz(spark, n, step, count):
    got = W.resampled(series(spark, range(n), step), "speed", 60.0).orderBy("step").collect()
    assert abs(len(got) - count) <= 2
    assert got[0].value == 0 and math.isclose(got[-1].value, n - 1, abs_tol=1e-6)
    assert all(math.isclose(r.value, r.t_ms / step, abs_tol=1e-6) for r in got)


def test_filled_gaps(spark):
    s = spark.createDataFrame([("v", i, i * 1.0, x) for i, x in enumerate([None, 2.0, None, 4.0, None])] + [("w", 0, 0.0, None)], "video_id string, frame int, t_ms double, a double")
    got = {(r[0], r[1]): r[2] for r in W.filled(s, "a", "b").select("video_id", "frame", "b").collect()}
    assert [got["v", i] for i in range(5)] == [2, 2, 3, 4, 4] and got["w", 0] == 45


def test_nearest_prefers_the_earlier_frame_on_a_tie(spark):
    f = series(spark, [0] * 4, 10.0)
    q = spark.createDataFrame([("v", 1, 5.0), ("v", 2, 26.0), ("v", 3, -9.0), ("w", 4, 1.0)], "video_id string, id long, t double")
    assert {r["id"]: r["frame"] for r in J.nearest(f, q).collect()} == {1: 0, 2: 3, 3: 0, 4: None}
    assert {r["id"]: r["frame"] for r in J.nearest_within(f, q).collect()} == {1: 0, 2: 3, 3: None, 4: None}


def test_sequence_gaps_and_retention(spark):
    f = spark.createDataFrame([(1, "c", s, t, 10) for s, t in ((0, 0), (1, 10), (4, 40), (5, 50))], "session_id long, camera_id string, sequence long, ts_ns long, bytes long")
    assert [tuple(r)[2:] for r in W.sequence_gaps(f).collect()] == [(10, 40, 2, 1)]
    assert sorted(r["sequence"] for r in W.retained(f, 10, 1000).collect()) == [4, 5]
    assert sorted(r["sequence"] for r in W.retained(f, 1000, 30).collect()) == [1, 4, 5]
    assert [r["sequence"] for r in W.retained(f, 1000, 5).collect()] == [5]


def test_trigger_clips_include_both_ends(spark):
    rows = [(1, "a", i, i * 10) for i in range(12)] + [(1, "b", i, i * 10 + 1) for i in range(12)]
    f = spark.createDataFrame(rows, "session_id long, camera_id string, sequence long, ts_ns long")
    t = spark.createDataFrame([(1, 7, 100, 50)], "session_id long, shot_id long, trigger_ns long, pre_roll_ns long")
    got = J.clips(t, f).groupBy("camera_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 6, "b": 5}


def test_position_errors(spark):
    rows = [("1", "P1", 12, 10), ("1", "P4", 52, 50), ("1", "P6", 68, 70), ("2", "P1", 8, 10), ("2", "P4", 28, 25), ("2", "P6", 35, 35)]
    pos = spark.createDataFrame([(*r, 60.0) for r in rows], "video_id string, p string, predicted long, labelled long, fps double")
    got = {r.p: (r.mae_frames, r.n) for r in M.position_mae(M.position_errors(pos)).collect()}
    assert got["P1"] == (2.0, 2) and got["P4"] == (2.5, 2) and got["P6"] == (1.0, 2)
    assert math.isclose(got[None][0], 11 / 6) and got[None][1] == 6


def test_dtw_in_bands_is_the_same_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    for n, m in ((300, 170), (77, 400), (33, 33), (1, 50), (50, 1)):
        a, b = rng.integers(0, 4, (n, 2)).astype(float), rng.integers(0, 4, (m, 2)).astype(float)  # many ties
        whole, banded = A.dtw(a, b), A.dtw(a, b, most_bytes=1)
        assert whole[0] == banded[0] and (whole[1] == banded[1]).all()
    a, b = rng.random((4000, 3)), rng.random((1500, 3))
    tracemalloc.start()
    A.dtw(a, b, most_bytes=1)
    assert tracemalloc.get_traced_memory()[1] < 2_500_000  # six million cells
    tracemalloc.stop()


def test_dtw_pairs_are_dealt_over_a_set_number_of_tasks(spark):
    rows = [(v, f, [float(v), float(f * v % 5), 1.0]) for v in range(4) for f in range(6)]
    features = spark.createDataFrame(rows, "video_id int, frame int, features array<double>")
    pairs = spark.createDataFrame([(k, k, (k + 1) % 4) for k in range(4)], "pair_id long, user_id int, ref_id int")
    paths = A.dtw_paths(features, pairs)
    assert paths.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.pair_id for r in paths.collect()} == {0, 1, 2, 3}


def test_equal_vectors_cost_nothing_and_equal_pairs_the_same():
    rng = np.random.default_rng(5)
    some = rng.normal(size=(7, 71)) * 1e3
    a, b = some[rng.integers(0, 7, 150)], some[rng.integers(0, 7, 90)]
    cost = A._costs(a, b, (a**2).sum(1), (b**2).sum(1))
    alike = (a[:, None] == b).all(2)
    assert (cost[alike] == 0).all() and np.allclose(cost, np.sqrt(((a[:, None] - b) ** 2).sum(2)))
    assert len(np.unique(cost[~alike])) <= 42


def test_dtw_is_exact():
    rng = np.random.RandomState(2)
    for n, m in ((5, 7), (1, 4), (12, 9)):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        best = np.full((n, m), np.inf)
        for i in range(n):
            for j in range(m):
                before = 0 if i == j == 0 else min(best[i - 1, j - 1] if i and j else np.inf, best[i - 1, j] if i else np.inf, best[i, j - 1] if j else np.inf)
                best[i, j] = before + np.linalg.norm(a[i] - b[j])
        distance, path = A.dtw(a, b)
        assert math.isclose(distance, best[-1, -1], rel_tol=1e-9)
        assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (n - 1, m - 1)
        assert all(tuple(s) in ((0, 1), (1, 0), (1, 1)) for s in np.diff(path, axis=0).tolist())
        assert math.isclose(sum(np.linalg.norm(a[i] - b[j]) for i, j in path), distance, rel_tol=1e-9)


def test_undistortion_inverts_the_distortion():
    rng = np.random.RandomState(3)
    n, d = rng.uniform(-0.5, 0.5, (50, 2)), np.tile([-0.12, 0.06, 0.0005, -0.0003, 0.0], (50, 1))
    assert np.abs(G.undistorted(G._distorted(n, d), d) - n).max() < 1e-12


def test_captures_and_identifiers(spark):
    df = spark.createDataFrame([("/a/Jo - Lee - 2026-10-01 101112 Face On 0aF1.mp4",), ("/a/x.mp4",)], "path string")
    from pyspark.sql import functions as F

    one, two = df.select(*[v.alias(k) for k, v in T.capture(F.col("path")).items()]).collect()
    assert tuple(one) == ("Jo - Lee", "2026-10-01", "101112", "Face On", "0af1", "face_on") and two[0] is None
    names = ["a", "con", "COM1.x", "a.", "a/b", "..", "", "a b"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.is_identifier(F.col("n"))).collect()
    assert {r[0] for r in got if r[1]} == {"a", "a b"}


def test_a_capture_is_matched_once_and_as_its_groups_say(spark):
    from pyspark.sql import functions as F

    good = "Jo - Lee - 2026-10-01 101112 Face On 0aF1"
    names = [f"/a/{good}.mp4", f"/a/{good}", f"/a/{good}.mp4\n", f"{good}\n", "/b/A - 2026-10-01 101112 DTL - 2026-10-01 101112 x 00ff.mov", "/a/x.mp4", "/a/", "", f"/a/{good}z.mp4", None, "/a/$1 - 2026-10-01 101112 \\ 0aF1.mp4"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    group = lambda i: F.when(T.stem(F.col("path")).rlike(T.CAPTURE), F.regexp_extract(T.stem(F.col("path")), T.CAPTURE, i))
    want = df.select("path", group(1), group(2), group(3), group(4), F.lower(group(5)), T.view_of(group(4))).collect()
    got = T.with_capture(df)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    used = got.where("golfer is not null and view is not null and date > '2000' and time < '3'").select(F.concat("golfer", "camera_id"), "date")
    assert used._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(regexp_replace(") <= 2


def test_order_of_rows_and_partitions_do_not_matter(spark):
    s = series(spark, np.concatenate([np.zeros(60), np.abs(np.sin(np.arange(140) / 20)) + 0.01]))
    a = X.swing_window(s).collect()
    b = X.swing_window(s.orderBy("speed").repartition(7)).collect()
    assert a == b and len(a) == 1


def test_bootstrap_of_equal_backends_is_zero(spark):
    rows = [(b, "v", 1, f, j, True, 0.01 * (f % 9)) for b in "FO" for f in range(40) for j in range(3)]
    l = spark.createDataFrame(rows, "backend string, view string, video_id long, frame long, joint int, visible boolean, err double")
    r = M.paired_bootstrap(l, "F", "O", 0.05, draws=50).first()
    assert (r.difference, r.low, r.high) == (0.0, 0.0, 0.0)


def test_repaired_times_increase(spark):
    from motion_tables.operators import labels as L

    s = spark.createDataFrame([("v", i, t) for i, t in enumerate([0.0, 10.0, None, 20.0, 500.0, 90.0])], "video_id string, frame int, t_ms double")
    got = L.repaired_times(s).orderBy("frame").collect()
    times = [r.t_ms for r in got]
    assert times[:3] == [0.0, 10.0, 26.67] and all(a < b for a, b in zip(times, times[1:]))
    assert [r.estimated for r in got] == [False, False, True, True, False, True]


def test_shaft_positions_need_half_of_the_frames(spark):
    from motion_tables.operators import labels as L

    rows = [("v", i, i * 10.0, 45.0 + i if i % 5 else None) for i in range(100)] + [("w", i, i * 10.0, 45.0 + i if i % 3 == 0 else None) for i in range(100)]
    s = spark.createDataFrame(rows, "video_id string, frame int, t_ms double, angle double")
    spans = spark.createDataFrame([(v, "P2", 0, 99, False) for v in "vw"], "video_id string, p string, lo int, hi int, last boolean")
    assert [tuple(r)[:3] for r in L.shaft_positions(s, spans).collect()] == []
    whole = s.withColumn("angle", s.frame + 44.5)
    assert {tuple(r)[:3] for r in L.shaft_positions(whole, spans).collect()} == {("v", "P2", 46), ("w", "P2", 46)}


def test_user_measurements(spark):
    from motion_tables.operators.measure import Measurements

    mine = Measurements()
    df = spark.createDataFrame([(1, 0, "dtl", (0.0, 0.0), (3.0, 4.0)), (1, 1, "face_on", None, (1.0, 1.0))], "video_id int, frame int, view string, a struct<x:double,y:double>, b struct<x:double,y:double>")
    assert mine.measured(df).count() == 0
    mine.add("gap", "Gap", ["a", "b"])(lambda a, b: ((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5)
    mine.add("side", "Side", ["b"], view="face_on")(lambda b: b["x"] * float("nan"))
    got = {(r.frame, r.key): (r.value, r.reason) for r in mine.measured(df).collect()}
    assert got == {(0, "gap"): (5.0, None), (1, "gap"): (None, "not detected: a"), (1, "side"): (None, "undefined")}
    with pytest.raises(ValueError):
        mine.add("gap", "Again", ["a"])


def test_a_gap_is_held_against_its_own_stream(spark):
    """Gaps of a manifest without an id, or with another's, are told of once each."""
    from motion_tables.operators import contracts as C

    stream = '{"camera_id":"c","width":9,"height":9,"frame_count":5,"nominal_fps":60.0,"first_timestamp_ns":0,"last_timestamp_ns":%d,"dropped_frame_count":9,"gaps":[{"start_timestamp_ns":5,"end_timestamp_ns":6,"missing_frame_count":0}]}'
    docs = spark.createDataFrame([('{%s"streams":[%s]}' % (i, stream % last),) for i, last in (("", 9), ('"shot_id":"a",', 9), ('"shot_id":"a",', 4))], "doc string")
    got = sorted((r.shot_id or "", r.rule) for r in C.manifest_violations(C.manifests(docs)).collect() if "gaps" in r.path)
    assert got == [("", "no frame missing"), ("a", "no frame missing"), ("a", "no frame missing"), ("a", "outside its stream")]


def test_annotations_of_detected_views_are_replaced_in_a_set_number_of_tasks(spark):
    from motion_tables.operators import snapshots as S

    docs = ['{"positions":{"P1":{"frames":{"face_on":3,"dtl":null}},"P2":{"frames":null},"P3":null},"views":{"face_on":{"path":"a"},"dtl":{"path":"b"}}}', '{"positions":null,"views":{"face_on":{"path":"c"}}}', '{"positions":{"P1":{"frames":{"face_on":1,"top":2}}}}', "no json", '{"positions":{"P9":{"frames":{"dtl":8,"top":2}}},"views":{"dtl":{"path":"d"},"face_on":{"path":"e"}}}']
    current = spark.createDataFrame([(p, "P1", 0, "face_on", "old") for p in ("a", "b", "c", "d", "e", None)], "path string, p string, frame int, view string, convention string")
    out = S.annotations_from_detections(spark.createDataFrame([(x,) for x in docs], "doc string"), current, "new")
    assert sorted((str(r.path), r.p, r.frame, r.convention) for r in out.collect()) == [("None", "P1", 0, "old"), ("a", "P1", 3, "new"), ("b", "P1", 0, "old"), ("c", "P1", 0, "old"), ("d", "P9", 8, "new"), ("e", "P1", 0, "old")]
    docs = spark.createDataFrame([('{"positions":{"P1":{"frames":{"dtl":1}}},"views":{"dtl":{"path":"%d"}}}' % k,) for k in range(50)], "doc string").coalesce(1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.annotations_from_detections(docs, current, "new")
        assert out.count() == 56 and out.rdd.getNumPartitions() == tasks + 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_results_are_read_once_for_all_rules_and_values(spark):
    from pyspark.sql import functions as F

    from motion_tables.operators import contracts as C

    docs = [
        '{"shot_id":"a","analyzer":{"name":"k","version":" "},"status":"ok","events":[{"name":"P1","timestamp_ns":5,"confidence":2,"range":{"start_timestamp_ns":6,"end_timestamp_ns":9}},null,{"name":" ","timestamp_ns":5,"confidence":0.5,"range":{"start_timestamp_ns":9,"end_timestamp_ns":6}}],"errors":[{"code":"","message":"m"}],"warnings":[],"measurements":{"t":{"value":1.5,"unit":""},"u":{"value":2,"unit":null}},"artifacts":[{"kind":"o","path":"../x"},{"kind":"","path":"x/y"}]}',
        '{"shot_id":"b","analyzer":{"name":"k","version":"1"},"status":"ok"}', "no json",
    ]
    read = C.results(spark.createDataFrame([(x,) for x in docs], "doc string"))
    want = {
        ("a", "result", "analyzer without a version"), ("a", "result", "ok in spite of errors"), ("a", "events[0]", "outside its range"), ("a", "events[0]", "confidence not from 0 to 1"), ("a", "events[1]", "no name"), ("a", "events[1]", "confidence not from 0 to 1"),
        ("a", "events[2]", "no name"), ("a", "events[2]", "range ends before it begins"), ("a", "errors[0]", "no code"), ("a", "measurements.t", "blank unit"), ("a", "artifacts[0]", "no portable path"), ("a", "artifacts[1]", "no kind"),
        (None, "result", "analyzer without a name"), (None, "result", "analyzer without a version"),
    }
    got = C.result_violations(read)
    assert len(got.collect()) == len(want) and {tuple(r) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1

    values = C.result_values(read)
    assert sorted(tuple(r) for r in values.select(F.col("key"), "value", "kind", "path").collect()) == [("t", 1.5, "", "x/y"), ("t", 1.5, "o", "../x"), ("u", 2.0, "", "x/y"), ("u", 2.0, "o", "../x")]
    assert "Join" not in values._jdf.queryExecution().optimizedPlan().toString()


def test_events_in_captures_read_each_document_once(spark):
    from motion_tables.operators import contracts as C
    from motion_tables.plans.queries import QUERIES

    plan = QUERIES["c13_events_in_captures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count("StructsToJsonEvaluator") == 2

    def docs(*texts):
        return spark.createDataFrame([(x,) for x in texts], "doc string")

    captured = docs(
        '{"shot_id":"a","streams":[{"width":"odd","first_timestamp_ns":5,"last_timestamp_ns":7},null,{"first_timestamp_ns":null,"last_timestamp_ns":9}]}', '{"shot_id":"a","streams":[{"first_timestamp_ns":3,"last_timestamp_ns":4}]}',
        '{"shot_id":"b","streams":[]}', '{"streams":[{"first_timestamp_ns":0,"last_timestamp_ns":99}]}', "no json", None,
    )
    analysed = docs(
        '{"shot_id":"a","events":[{"name":"P1","timestamp_ns":3},null,{"name":"P2","timestamp_ns":9,"confidence":"odd"},{"name":"P3","timestamp_ns":10},{"name":"P4","timestamp_ns":null}],"warnings":"odd"}', '{"shot_id":"a","events":[{"name":"P5","timestamp_ns":2}]}',
        '{"shot_id":"b","events":[{"name":"P1","timestamp_ns":1}]}', '{"shot_id":"c","events":[{"name":"P1","timestamp_ns":1}]}', '{"events":[{"name":"P1","timestamp_ns":1}]}', '{"shot_id":"d","events":[]}', '{"shot_id":"d"}', "no json", None,
    )
    want = [("a", 0, "P1", True), ("a", 1, None, None), ("a", 2, "P2", True), ("a", 3, "P3", False), ("a", 4, "P4", None), ("a", 0, "P5", False), ("b", 0, "P1", None), ("c", 0, "P1", None), (None, 0, "P1", None)]
    for m, r in ((C.manifests(captured), C.results(analysed)), (C.manifests(captured, C.CAPTURED), C.results(analysed, C.ANALYSED))):
        assert sorted(map(str, C.events_in_captures(m, r).collect())) == sorted(f"Row(shot_id={a!r}, event={b}, name={c!r}, inside={d})" for a, b, c, d in want)


def test_playback_deals_out_pairs_before_they_are_lines(spark):
    from motion_tables.plans import space_queries as Q

    plan = Q.playback_plan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(exchanges) == 1 and exchanges[0] > max(i for i, line in enumerate(lines) if "Generate" in line)


def test_followed_picks_work_out_tables_once(spark):
    from motion_tables.plans.follow_queries import QUERIES

    plan = QUERIES["d19_shaft_segments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "lineitem" not in plan
