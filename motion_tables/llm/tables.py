"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset a folder of this machine if all executors are on it, as in tests; else there is none that they share, and it raises."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and losing an executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "stored_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_key() -> "F.Column":
    """A key of a row of ``documents`` that is never null; equal rows share it and are treated alike."""
    return F.xxhash64("doc_id", "text")


def with_own_columns(docs: DataFrame, used: list[str], step) -> DataFrame:
    """step(docs) with the columns of docs as they were, though the step makes columns of the names in ``used``."""
    own = {c: f"_own_{c}" for c in docs.columns if c in used}
    out = step(docs.withColumnsRenamed(own)).drop(*used)
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): columns node, comp with the smallest node; only nodes with an edge appear.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes.  Each
    round is a stored table, so no plan grows with the rounds; a round's rows are at most the edges.
    A hub's edges are joined to its minimum by a join that adaptive execution can split.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        step = stored(small, "edges")
        state = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        dropped(now)
        now = step
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))
