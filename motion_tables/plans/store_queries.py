"""Queries of stores: tables written as a capture library, pose caches or arrays under a manifest, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators.snapshots import reconstruction_ids
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.array_store import read_arrays, write_arrays
from motion_tables.sources.files import library
from motion_tables.sources.pose_cache import pose_points, write_pose_points
from motion_tables.sources.scratch import scratch_folder

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql


@_R.add("src11_library", f"WITH {D.CAPTURES} SELECT split_part(path, '/', 3) AS folder, 1 AS files, CAST(sum(length(path) + 1) AS BIGINT) AS size_bytes FROM c GROUP BY ALL")
def library_listing(spark, d):
    """A file of names for each folder of the library, found again by the files' metadata."""
    out = scratch_folder(spark, "library")
    D.captures(spark, d).select("path", F.split_part("path", F.lit("/"), F.lit(3)).alias("folder")).repartition("folder").write.partitionBy("folder").text(out)
    found = library(spark, out, (".txt",))
    return found.groupBy(F.regexp_extract("name", "^folder=([^/]*)/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


@_R.add("src7_pose_caches", f"""WITH {D.POINTS} SELECT 'v' || video_id AS video_id, frame, 'j' || lpad(CAST(joint AS VARCHAR), 2, '0') AS joint, t_ms, CASE WHEN frame % 7 <> 3 THEN x END AS x, y, conf, detected FROM pts WHERE backend = 'b'""")
def pose_caches(spark, d):
    """Points written as an archive for each recording, and read back."""
    out = scratch_folder(spark, "poses")
    p = D.points(spark, d).where("backend = 'b'")
    given = p.select(F.concat(F.lit("v"), "video_id").alias("video_id"), "backend", F.lit(60.0).alias("fps"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("min_conf").alias("min_confidence"), F.col("frame").cast("int").alias("frame"), "t_ms", "detected",
        F.concat(F.lit("j"), F.lpad(F.col("joint").cast("string"), 2, "0")).alias("joint"), F.when(F.col("frame") % 7 != 3, F.col("x")).alias("x"), "y", F.lit(None).cast("double").alias("z"), "conf")
    write_pose_points(given, out)
    return pose_points(spark, out).where("rejected is null").select("video_id", "frame", "joint", "t_ms", "x", "y", "conf", "detected")


@_R.add("snk3_reconstructions", f"WITH {D.POSE} SELECT video_id AS shot_id, video_id || '-' || substr(sha256('{{\"rig\":\"r1\",\"shot_id\":' || video_id || '}}'), 1, 12) AS reconstruction_id, count(*) AS points, true AS intact FROM p GROUP BY video_id")
def reconstructions(spark, d):
    """Written as arrays under a manifest, written again, read back and held against what was given."""
    q = P.at(F.col("lm"), 0)
    made = reconstruction_ids(D.pose(spark, d).select(F.col("video_id").alias("shot_id"), F.col("frame").cast("int").alias("frame"), *[q[k].alias(k) for k in "xyz"]).withColumn("inputs", F.struct(F.lit("r1").alias("rig"), "shot_id"))).drop("inputs")
    out = scratch_folder(spark, "reconstructions")
    write_arrays(made, out, "reconstruction_id", ["frame"], loaded_revision=0)
    write_arrays(made, out, "reconstruction_id", ["frame"], loaded_revision=1)
    back = read_arrays(spark, out).join(made.select("reconstruction_id", "frame", F.struct("x", "y", "z").alias("given")), ["reconstruction_id", "frame"], "left")
    return back.groupBy("shot_id", "reconstruction_id").agg(F.count("*").alias("points"), F.bool_and(F.coalesce(F.struct("x", "y", "z") == F.col("given"), F.lit(False))).alias("intact"))
