"""Repaired times against a loop over the frames."""

import random

import pytest

from motion_tables.operators.labels import repaired_times


def loop(times, fps):
    out, last = [], None
    for i, t in enumerate(times):
        missing = t is None
        now = (0.0 if last is None else last + 16.67) if missing else t
        behind = not missing and last is not None and now <= last
        now = max(i * 1000 / fps, last + 0.001) if behind else now
        out.append((now, missing or behind))
        last = now
    return out


@pytest.mark.parametrize("fps", [60.0, 240.0])
def test_random_times(spark, fps):
    r = random.Random(11)
    given = {}
    for v in range(30):
        t, times = r.uniform(-50, 50), []
        for _ in range(r.randrange(1, 200)):
            t += r.choice([1000 / fps, 1000 / fps, 1000 / fps, 0.0, -40.0, 400.0])
            times.append(None if r.random() < 0.15 else round(t, 3))
        given[v] = times
    given[30], given[31] = [None] * 5, [5.0] * 40
    df = spark.createDataFrame([(v, i, t) for v, times in given.items() for i, t in enumerate(times)], "video_id int, frame int, t_ms double").repartition(5)
    got = {(x.video_id, x.frame): (x.t_ms, x.estimated) for x in repaired_times(df, fps).collect()}
    want = {(v, i): x for v, times in given.items() for i, x in enumerate(loop(times, fps))}
    assert got == want
    assert repaired_times(df.limit(0)).count() == 0
