"""The inference store: what is inferred when, under which identity, and what a lost run leaves."""

from pyspark.sql import functions as F

from motion_tables.operators.inference import InferenceStore, MidpointBackend, backend_identity, inferred
from motion_tables.sources import derived as D


class Other(MidpointBackend):
    version = 2


def test_only_what_is_missing_is_inferred(spark, tmp_path):
    p = D.pose(spark, "/root/testdata/sf0.001").withColumn("digest", F.concat(F.lit("d"), F.col("video_id").cast("string"))).cache()
    store, me = InferenceStore(spark, str(tmp_path)), backend_identity(MidpointBackend)
    assert store.missing(p, me).count() == p.count() and store.results(p, MidpointBackend).count() == 0
    one = store.run(p, MidpointBackend)
    assert store.missing(p, me).isEmpty()
    want = sorted(map(tuple, inferred(p, MidpointBackend).collect()))
    assert sorted((r.video_id, r.frame, r.x, r.y, r.score) for r in store.results(p, MidpointBackend).collect()) == want
    two = store.run(p, MidpointBackend)
    assert spark.read.parquet(f"{tmp_path}/done").where(F.col("run") == two).isEmpty()
    changed = p.withColumn("digest", F.when(F.col("video_id") == 2, "new").otherwise(F.col("digest")))
    three = store.run(changed, MidpointBackend)
    assert {r.video_id for r in spark.read.parquet(f"{tmp_path}/done").where(F.col("run") == three).collect()} == {2}
    assert {r.run for r in store.results(changed, MidpointBackend).collect()} == {one, three} and {r.run for r in store.results(p, MidpointBackend).collect()} == {one}
    assert backend_identity(Other) != me != backend_identity(MidpointBackend, size=2)
    assert store.missing(p, backend_identity(Other)).count() == p.count()


def test_what_a_lost_run_has_left_is_not_read(spark, tmp_path):
    p = D.pose(spark, "/root/testdata/sf0.001").where("video_id < 2").withColumn("digest", F.lit("d")).cache()
    store = InferenceStore(spark, str(tmp_path))
    left = inferred(p, MidpointBackend).select("video_id", "frame", "x", "y", "score", F.lit("d").alias("digest"), F.lit("lost").alias("run"), F.lit(backend_identity(MidpointBackend)).alias("backend"))
    left.write.partitionBy("backend").parquet(f"{tmp_path}/frames")
    store.run(p, MidpointBackend)
    assert store.results(p, MidpointBackend).count() == inferred(p, MidpointBackend).count()
