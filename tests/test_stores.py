"""Pose caches, array stores and library listings: round trips, rejected and altered files, writes that fail."""

import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from motion_tables.sources import array_store as A
from motion_tables.sources.files import library, library_stream
from motion_tables.sources.pose_cache import ROWS, pose_points, write_pose_points

JOINTS = ["hip", "knee", "toe"]


def archive(path, video, n, seed, **more):
    r = np.random.default_rng(seed)
    xy = r.random((n, 3, 2))
    xy[::4, 1] = np.nan
    meta = {"video_path": video, "backend": "b", "fps": 60.0, "width": 64, "height": 48, "schema": 1, "min_confidence": 0.5, "landmarks": JOINTS} | more.pop("meta", {})
    arrays = {"timestamps_ms": np.arange(n) * 16.7, "xy": xy, "z": r.random((n, 3)), "confidence": r.random((n, 3)), "detected": r.random(n) > 0.2, "meta": np.array(json.dumps(meta))} | more
    path.parent.mkdir(parents=True, exist_ok=True)
    np.savez_compressed(path, **{k: v for k, v in arrays.items() if v is not None})
    return arrays


def test_pose_caches(spark, tmp_path):
    kept = {f"v{i}": archive(tmp_path / f"{i}.npz", f"v{i}", 5 + i, i) for i in range(4)}
    archive(tmp_path / "old.npz", "x", 3, 9, meta={"schema": 0})
    archive(tmp_path / "sub/other.npz", "x", 3, 9, meta={"landmarks": ["hip", "toe", "knee"]})
    archive(tmp_path / "shape.npz", "x", 3, 9, z=np.zeros((2, 3)))
    archive(tmp_path / "lacks.npz", "x", 3, 9, detected=None)
    (tmp_path / "text.npz").write_text("no archive")
    rows = pose_points(spark, str(tmp_path), landmarks=json.dumps(JOINTS), partition_bytes="2000")
    assert rows.rdd.getNumPartitions() > 2 and rows.schema.simpleString() == spark.createDataFrame([], ROWS).schema.simpleString()
    why = {r.file: r.rejected for r in rows.where("rejected is not null").collect()}
    assert why == {"old.npz": "another layout", "sub/other.npz": "other landmarks", "shape.npz": "arrays of other shapes", "lacks.npz": "arrays of other shapes", "text.npz": "no pose archive: ValueError"}
    got = {(r.video_id, r.frame, r.joint): r for r in rows.where("rejected is null").collect()}
    assert len(got) == sum(3 * (5 + i) for i in range(4))
    for (v, f, j), r in got.items():
        a, k = kept[v], JOINTS.index(j)
        x = a["xy"][f, k, 0]
        assert (r.x is None if np.isnan(x) else r.x == x) and r.conf == a["confidence"][f, k] and r.detected == a["detected"][f] and r.t_ms == a["timestamps_ms"][f] and r.min_confidence == 0.5


def test_pose_caches_round_trip(spark, tmp_path):
    made = spark.range(6 * 40 * 3).select(
        F.concat(F.lit("v"), (F.col("id") % 6).cast("string")).alias("video_id"), F.lit("b").alias("backend"), F.lit(60.0).alias("fps"), F.lit(64).alias("width"), F.lit(48).alias("height"), F.lit(0.5).alias("min_confidence"), F.floor(F.col("id") / 18).cast("int").alias("frame"),
        (F.floor(F.col("id") / 18) * 16.7).alias("t_ms"), (F.floor(F.col("id") / 18) % 5 != 2).alias("detected"), F.element_at(F.array(*[F.lit(j) for j in JOINTS]), (F.floor(F.col("id") / 6) % 3 + 1).cast("int")).alias("joint"), F.when(F.col("id") % 7 != 3, F.rand(1)).alias("x"), F.rand(2).alias("y"), F.rand(3).alias("z"), F.rand(4).alias("conf"),
    ).cache()
    write_pose_points(made, str(tmp_path))
    write_pose_points(made.where("video_id = 'v1'"), str(tmp_path))  # replaces its own archive
    assert sorted(os.listdir(tmp_path)) == sorted(p for p in os.listdir(tmp_path) if p.endswith(".npz") or p == "_staging") and len(list(tmp_path.glob("*.npz"))) == 6
    back = pose_points(spark, str(tmp_path))
    assert back.where("rejected is not null").count() == 0
    assert sorted(map(tuple, back.select(*made.columns).collect()), key=str) == sorted(map(tuple, made.collect()), key=str)


def rows_of(spark, n, seed=0):
    return spark.range(n).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("key"), F.col("id").alias("frame"), (F.col("id") * 0.5 + seed).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("y"), (F.col("id") % 2 == 0).alias("ok"))


def content(df):
    return sorted(map(tuple, df.select("key", "frame", "x", "y", "ok").collect()), key=str)


def test_array_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 20)
    path, one, two = str(tmp_path / "store"), rows_of(spark, 200), rows_of(spark, 90, 1)
    A.write_arrays(one, path, "key", ["frame"], loaded_revision=0)
    assert A.manifest(path)["revision"] == 1 and content(A.read_arrays(spark, path)) == content(one)
    A.write_arrays(one, path, "key", ["frame"], loaded_revision=1)
    assert A.manifest(path)["revision"] == 1  # the same again changes nothing
    A.write_arrays(two, path, "key", ["frame"], loaded_revision=1)
    assert A.manifest(path)["revision"] == 2 and content(A.read_arrays(spark, path)) == content(two)
    with pytest.raises(Exception, match="loaded was 1"):
        A.write_arrays(one, path, "key", ["frame"], loaded_revision=1)
    more = two.withColumn("key", F.concat("key", F.lit("+")))
    A.write_arrays(more, path, "key", ["frame"], overwrite=False)
    assert content(A.read_arrays(spark, path)) == content(two.union(more))


def test_a_write_that_fails_leaves_nothing_readable(spark, tmp_path):
    path, one = str(tmp_path), rows_of(spark, 200)
    failing = one.withColumn("x", F.when(F.col("frame") == 150, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        A.write_arrays(failing, path, "key", ["frame"])
    assert A.manifest(path)["revision"] == 0
    with pytest.raises(Exception, match="nothing is stored"):
        A.read_arrays(spark, path)
    A.write_arrays(one, path, "key", ["frame"])
    with pytest.raises(Exception, match="lost"):
        A.write_arrays(failing, path, "key", ["frame"])
    assert A.manifest(path)["revision"] == 1 and content(A.read_arrays(spark, path)) == content(one)


def test_altered_arrays_are_seen(spark, tmp_path):
    A.write_arrays(rows_of(spark, 50), str(tmp_path), "key", ["frame"])
    at = next(tmp_path.glob("data/*.npz"))
    with np.load(at) as f:
        arrays = {k: f[k].copy() for k in f.files}
    arrays["x"][3] += 1
    np.savez_compressed(at, **arrays)
    with pytest.raises(Exception, match="not what was written"):
        A.read_arrays(spark, str(tmp_path)).count()
    with pytest.raises(ValueError):
        A._Writer(spark.createDataFrame([], "key string, name string").schema, {"path": str(tmp_path), "key": "key"}, True)


def test_library(spark, tmp_path):
    names = ["b/2.MP4", "a/x y.mov", "a/+1.mkv", "z.avi", "a/b/c/é.m4v", "a/.hidden.mp4", ".trash/1.mp4", "a/.b/2.mp4", "notes.txt", "a/mp4", "10%.mp4"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"12345")
    want = sorted(n for n in names[:5] + names[-1:])
    got = library(spark, str(tmp_path)).orderBy("name")
    assert [r.name for r in got.collect()] == want and {r.size_bytes for r in got.collect()} == {5}
    plan = got._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]
    assert library(spark, str(tmp_path / "none")).count() == 0
    out, marks = str(tmp_path / "_out"), str(tmp_path / "_marks")
    for extra in ("", "a/new.mp4"):
        if extra:
            (tmp_path / extra).write_bytes(b"1")
        q = library_stream(spark, str(tmp_path)).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert sorted(r.name for r in spark.read.parquet(out).collect()) == sorted([*want, *([extra] if extra else [])])
