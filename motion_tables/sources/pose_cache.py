"""Pose caches as a data source: a NumPy archive for each recording, read to rows of points.

``spark.read.format("pose_cache").option("path", folder)`` deals the folder's archives to partitions by size.  An archive of another layout gives one
row with the reason in ``rejected``.  Arrays: timestamps_ms (frames), xy (frames, landmarks, 2), z and confidence (frames, landmarks), detected (frames); meta is a JSON text.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from motion_tables.sources.files import Folder, packed

SCHEMA = 1  # fixed value: the layout's number
ROWS = "video_id string, backend string, fps double, width int, height int, min_confidence double, frame int, t_ms double, detected boolean, joint string, x double, y double, z double, conf double, rejected string, file string"
BATCH = 1 << 16


@dataclass
class Files(InputPartition):
    names: list[str]


def _rejection(data: bytes, landmarks: list[str] | None) -> tuple[str | None, dict, dict]:
    try:
        with np.load(io.BytesIO(data), allow_pickle=False) as f:
            arrays = {k: f[k] for k in f.files}
        meta = json.loads(str(arrays.pop("meta")))
    except (ValueError, OSError, KeyError, EOFError) as e:
        return f"no pose archive: {type(e).__name__}", {}, {}
    if meta.get("schema") != SCHEMA:
        return "another layout", {}, {}
    if landmarks is not None and meta.get("landmarks") != landmarks:
        return "other landmarks", {}, {}
    n, j = len(arrays.get("timestamps_ms", ())), len(meta.get("landmarks", ()))
    shapes = {"timestamps_ms": (n,), "xy": (n, j, 2), "z": (n, j), "confidence": (n, j), "detected": (n,)}
    if any(k not in arrays or arrays[k].shape != s for k, s in shapes.items()):
        return "arrays of other shapes", {}, {}
    return None, meta, arrays


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.landmarks = json.loads(options["landmarks"]) if "landmarks" in options else None
        self.most = int(options.get("partition_bytes", 64 << 20))

    def partitions(self):
        return [Files(p) for p in packed(Folder(self.path).names(".npz"), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder, kind = Folder(self.path), to_arrow_schema(self.schema)
        for name in partition.names:
            why, meta, arrays = _rejection(folder.read(name), self.landmarks)
            if why:
                yield pa.RecordBatch.from_pylist([{"rejected": why, "file": name}], schema=kind)
                continue
            joints = np.array(meta["landmarks"], dtype=object)
            j = len(joints)
            step = max(1, BATCH // max(1, j))
            for a in range(0, len(arrays["timestamps_ms"]), step):
                part = {k: v[a : a + step] for k, v in arrays.items()}
                n = len(part["timestamps_ms"])
                point = {"x": part["xy"][:, :, 0], "y": part["xy"][:, :, 1], "z": part["z"], "conf": part["confidence"]}
                columns = {k: pa.array(v.reshape(-1).astype(np.float64), from_pandas=True) for k, v in point.items()}  # NaN is null
                columns |= {"frame": pa.array(np.repeat(np.arange(a, a + n, dtype=np.int32), j)), "t_ms": pa.array(np.repeat(part["timestamps_ms"].astype(np.float64), j)), "detected": pa.array(np.repeat(part["detected"].astype(bool), j)), "joint": pa.array(np.tile(joints, n).tolist(), pa.string())}
                same = {"video_id": meta["video_path"], "backend": meta["backend"], "fps": float(meta["fps"]), "width": int(meta["width"]), "height": int(meta["height"]), "min_confidence": meta.get("min_confidence"), "rejected": None, "file": name}
                columns |= {k: pa.array([v] * (n * j), kind.field(k).type) for k, v in same.items()}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in kind], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """An archive for each recording, of rows that stand together and in order; all are moved to their places when every task is done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.stage = options["path"], f"_staging/{options.get('run', 'run')}"
        if overwrite:
            raise ValueError("pose caches are added to a folder; those of the same recording and backend replace each other")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, names, held = Folder(self.path), [], []

        def put():
            rows = pa.Table.from_batches(held)
            one = {k: rows.column(k)[0].as_py() for k in ("video_id", "backend", "fps", "width", "height", "min_confidence")}
            frames, first = np.unique(rows.column("frame").to_numpy(), return_index=True)
            n, joints = len(frames), rows.column("joint").to_pylist()[: rows.num_rows // max(1, len(frames))]
            grid = {k: rows.column(k).to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, len(joints)) for k in ("x", "y", "z", "conf")}
            meta = {"video_path": one["video_id"], "backend": one["backend"], "fps": one["fps"], "width": one["width"], "height": one["height"], "schema": SCHEMA, "min_confidence": one["min_confidence"], "landmarks": joints}
            out = io.BytesIO()
            np.savez_compressed(out, timestamps_ms=rows.column("t_ms").to_numpy()[first], xy=np.stack([grid["x"], grid["y"]], axis=2), z=grid["z"], confidence=grid["conf"], detected=rows.column("detected").to_numpy(zero_copy_only=False)[first].astype(bool), meta=np.array(json.dumps(meta)))
            name = f"{hashlib.sha256(json.dumps([one['video_id'], one['backend']]).encode()).hexdigest()[:32]}.npz"
            folder.write(f"{self.stage}/{name}", out.getvalue())
            names.append((f"{self.stage}/{name}", name))
            held.clear()

        now = None
        for batch in iterator:
            keys = list(zip(batch.column("video_id").to_pylist(), batch.column("backend").to_pylist()))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if held and keys[start] != now:
                        put()
                    now = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            put()
        return Written(names)

    def commit(self, messages) -> None:
        folder = Folder(self.path)
        for m in messages:
            for staged, name in m.names if m else ():
                folder.fs.move(f"{folder.top}/{staged}", f"{folder.top}/{name}")
        folder.drop(self.stage)

    def abort(self, messages) -> None:
        Folder(self.path).drop(self.stage)


class PoseCache(DataSource):
    """Options: path; landmarks (a JSON list that an archive's must equal); partition_bytes; run (a name for the staging folder of a write)."""

    @classmethod
    def name(cls) -> str:
        return "pose_cache"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def pose_points(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Points of all archives below a folder, rejected ones as rows of their own."""
    spark.dataSource.register(PoseCache)
    return spark.read.format("pose_cache").option("path", path).options(**options).load()


def write_pose_points(points: DataFrame, path: str, run: str = "run") -> None:
    """Archives of the recordings of ``points`` (the columns of ``ROWS`` but for the last two, with each frame's points complete)."""
    points.sparkSession.dataSource.register(PoseCache)
    dealt = points.repartition("video_id", "backend").sortWithinPartitions("video_id", "backend", "frame", "joint")
    dealt.write.format("pose_cache").option("path", path).option("run", run).mode("append").save()
