"""Streams give what their batch twins give."""

import random

from pyspark.sql import functions as F

from motion_tables.plans import join_queries, space_queries
from motion_tables.streaming import capture

FOLDER = "/root/testdata/sf0.001"


def loop(frames, most_bytes):
    """Every frame against the last accepted one of its camera, in order of arrival."""
    last, kind, dropped, out = {}, {}, {}, {}
    for f in sorted(frames, key=lambda f: (f["arrival"], f["sequence"], f["ts_ns"])):
        key = f["session_id"], f["camera_id"]
        kind.setdefault(key, (f["width"], f["height"], f["format"]))
        ns, sequence = last.get(key, (None, None))
        rule = (
            "size changed" if (f["width"], f["height"]) != kind[key][:2] else "format changed" if f["format"] != kind[key][2] else "duplicate timestamp" if f["ts_ns"] == ns else "backward timestamp" if ns is not None and f["ts_ns"] < ns
            else "sequence does not increase" if sequence is not None and f["sequence"] <= sequence else "larger than the buffer" if f["bytes"] > most_bytes else None
        )
        missing = 0 if rule or sequence is None else f["sequence"] - sequence - 1
        dropped[key] = dropped.get(key, 0) + missing
        if rule is None:
            last[key] = f["ts_ns"], f["sequence"]
        out[*key, f["arrival"]] = (rule is None, rule, missing, dropped[key])
    return out


def test_ordered_ingest_over_files_and_micro_batches(spark, tmp_path):
    """Frames of several cameras over many files; within a file in any order; every row as the loop has it."""
    r = random.Random(6)
    capture.state_store(spark)
    files, frames = [], []
    for n in range(6):
        rows = []
        for i in range(80):
            arrival = n * 1000 + i
            rows.append({"session_id": i % 2, "camera_id": "ab"[i % 3 == 0], "arrival": arrival, "sequence": max(0, arrival // 2 + r.choice([0, 0, 0, 3, -40])), "ts_ns": arrival * 10**6 + r.choice([0, 0, 0, 0, -(10**8), *(-(10**6) * k for k in range(1, 7))]), "bytes": r.choice([10, 10, 900]), "width": r.choice([64] * 15 + [32]), "height": 48, "format": r.choice(["rgb"] * 15 + ["yuv"])})
        r.shuffle(rows)
        frames += rows
        df = spark.createDataFrame([tuple(x.values()) for x in rows], capture.FRAMES.removesuffix(", ts timestamp")).withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
        df.repartition(3).write.mode("append").parquet(str(tmp_path / f"in/batch={n}"))
    stream = spark.readStream.schema(capture.FRAMES + ", batch int").option("maxFilesPerTrigger", 3).option("latestFirst", "false").parquet(str(tmp_path / "in")).drop("batch")
    q = capture.ordered_ingest(stream, most_bytes=800).writeStream.format("memory").queryName("ingested").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batches = [p for p in q.recentProgress if p["numInputRows"]]
    got = {(x.session_id, x.camera_id, x.arrival): (x.accepted, x.rule, x.missing, x.dropped_so_far) for x in spark.table("ingested").collect()}
    assert len(batches) > 1 and got == loop(frames, 800)
    assert len({v[1] for v in got.values()}) == 7


def test_a_silent_camera_is_told_and_what_it_sends_late_is_refused(spark, tmp_path):
    capture.state_store(spark)
    rows = [[(1, "c", 1, 1, 10**9, 1, 64, 48, "rgb")], [(1, "d", 2, 1, 100 * 10**9, 1, 64, 48, "rgb")], [(1, "d", 3, 2, 101 * 10**9, 1, 64, 48, "rgb")], [(1, "c", 4, 2, 10**9 - 5, 1, 64, 48, "rgb")]]
    for n, part in enumerate(rows):
        df = spark.createDataFrame(part, capture.FRAMES.removesuffix(", ts timestamp")).withColumn("ts", F.timestamp_micros(F.lit((100 + n if n else 1) * 10**6)))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(capture.FRAMES).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
        capture.ordered_ingest(stream, idle_ms=5000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted(((x.camera_id, x.arrival, x.accepted, x.rule) for x in spark.read.schema(capture.OUT).parquet(str(tmp_path / "out")).collect()), key=str)
    assert ("c", None, None, "silent") in got and ("c", 4, False, "backward timestamp") in got and ("c", 1, True, None) in got


def test_stream_join_equals_the_batch_clips(spark):
    stream = space_queries.QUERIES["st2_stream_clips"](spark, FOLDER).select("session_id", "shot_id", "camera_id", "sequence", "ts_ns")
    batch = join_queries.QUERIES["j17_trigger_clips"](spark, FOLDER).select(*stream.columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_activity_sessions_split_at_pauses(spark):
    f = spark.createDataFrame([("c", t * 10**9) for t in (0, 5, 100, 103)], "camera_id string, ts_ns long").withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
    assert sorted(r.frames for r in capture.activity_sessions(f, "30 seconds").collect()) == [2, 2]


def test_triggers_that_reach_back_too_far_are_refused(spark):
    hour = 3600 * 10**9
    t = spark.createDataFrame([(1, k, 100 * hour, n * hour) for k, n in enumerate((1, 24, 25))], "session_id long, shot_id int, trigger_ns long, pre_roll_ns long").withColumn("ts", F.timestamp_micros(F.floor(F.col("trigger_ns") / 1000).cast("long")))
    f = spark.createDataFrame([(1, "c", i, i * hour) for i in range(70, 101)], "session_id long, camera_id string, sequence long, ts_ns long").withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")))
    assert [(r.shot_id, r.rule) for r in capture.refused_triggers(t).collect()] == [(2, "pre-roll longer than the retention")]
    got = {}
    for r in capture.trigger_clips(t, f).collect():
        got.setdefault(r.shot_id, []).append(r.sequence)
    assert {k: sorted(v) for k, v in got.items()} == {0: [99, 100], 1: list(range(76, 101))}
    assert [r.shot_id for r in capture.refused_triggers(t, "30 minutes").orderBy("shot_id").collect()] == [0, 1, 2]
