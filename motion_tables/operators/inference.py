"""A pluggable model that runs frame by frame inside tasks, and what is left to run."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "video_id long, frame long, x double, y double, score double"


class Backend(Protocol):
    """open and close run once a task; detect gets a block of frames and gives x, y and score for each, NaN where nothing is found."""

    def open(self) -> None: ...

    def detect(self, frames: pd.DataFrame) -> np.ndarray: ...

    def close(self) -> None: ...


class MidpointBackend:
    """A deterministic stand-in: the middle of the nose and the lead wrist, nothing on every seventeenth frame."""

    def open(self) -> None:
        self.ready = True

    def detect(self, frames: pd.DataFrame) -> np.ndarray:
        q = np.array([[r[0]["x"], r[0]["y"], r[5]["x"], r[5]["y"]] for r in frames["lm"]])
        out = np.column_stack([(q[:, 0] + q[:, 2]) / 2, (q[:, 1] + q[:, 3]) / 2, frames["conf"]])
        out[frames["frame"] % 17 == 5] = np.nan
        return out

    def close(self) -> None:
        self.ready = False


def inferred(frames: DataFrame, backend: type[Backend]) -> DataFrame:
    """video_id, frame, x, y, score of every frame on which the backend finds something."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        model.open()
        try:
            for b in batches:
                if len(b):
                    got = model.detect(b)
                    keep = ~np.isnan(got).any(axis=1)
                    yield pd.DataFrame({"video_id": b["video_id"][keep], "frame": b["frame"][keep], **{c: got[keep, i] for i, c in enumerate(("x", "y", "score"))}})
        finally:
            model.close()

    return frames.mapInPandas(work, OUT)


def backend_identity(backend: type[Backend], **settings) -> str:
    """What a backend's results depend on: its class and its settings, as canonical JSON's hash."""
    told = {"backend": f"{backend.__module__}.{backend.__qualname__}", "version": getattr(backend, "version", 1), **settings}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:32]


class InferenceStore:
    """What backends have found, kept by both identities: the recording's content (digest) and the backend's.

    A folder of Parquet in partitions by backend.  ``frames`` are the results, ``done`` lists the recordings that have been run, also those in which nothing was found.  A run
    works only on recordings that ``done`` lacks for their digest, writes their frames first and lists them last, under a run's number of its own; so a run that is lost between the two is done again, and what
    it has left is not read, since readers take the frames of listed runs alone.
    """

    FRAMES = OUT + ", digest string, run string, backend string"
    DONE = "video_id long, digest string, run string, backend string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, table: str, kind: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.path}/{table}")

    def done(self, identity: str) -> DataFrame:
        """Recordings (video_id, digest, run) that this backend has been run on; of several runs the least counts."""
        d = self._read("done", self.DONE).where(F.col("backend") == identity)
        return d.groupBy("video_id", "digest").agg(F.min("run").alias("run"))

    def missing(self, frames: DataFrame, identity: str) -> DataFrame:
        """Frames (with video_id, digest) of recordings that are not stored under their digest."""
        return frames.join(self.done(identity).select("video_id", "digest"), ["video_id", "digest"], "left_anti")

    def run(self, frames: DataFrame, backend: type[Backend], **settings) -> str:
        """Infers what is missing and stores it; returns the run's number."""
        identity, number = backend_identity(backend, **settings), uuid.uuid4().hex
        todo = self.missing(frames, identity)
        own = [F.lit(number).alias("run"), F.lit(identity).alias("backend")]
        listed = todo.select("video_id", "digest").distinct()
        found = inferred(todo, backend).join(listed, "video_id").select("video_id", "frame", "x", "y", "score", "digest", *own)
        found.write.mode("append").partitionBy("backend").parquet(f"{self.path}/frames")
        listed.select("video_id", "digest", *own).write.mode("append").partitionBy("backend").parquet(f"{self.path}/done")
        return number

    def results(self, frames: DataFrame, backend: type[Backend], **settings) -> DataFrame:
        """Stored results of the recordings of ``frames`` under their digests: video_id, digest, run, frame, x, y, score."""
        identity = backend_identity(backend, **settings)
        listed = self.done(identity).join(frames.select("video_id", "digest").distinct(), ["video_id", "digest"])
        stored = self._read("frames", self.FRAMES).where(F.col("backend") == identity).drop("backend")
        return stored.join(listed, ["video_id", "digest", "run"])
