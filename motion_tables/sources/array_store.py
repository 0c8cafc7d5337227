"""Tables as arrays under a manifest: a write is there as a whole or not at all, and every array is held against its hash when it is read.

Tasks write parts: an archive of the columns' arrays, many keys one after the other, and a list of the keys with the SHA-256 of each key's piece of each array.
Names are hashes of contents, so what is written twice is there once.  Only when all parts stand is the manifest put in place, which names
them; readers see the parts that it names and nothing else.  A write may say which revision it was made from, and fails if another came in between.
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

from motion_tables.sources.files import Folder

MANIFEST = "manifest.json"
PART_ROWS = 1 << 20


class Conflict(ValueError):
    """What a write was made from is no longer what is stored."""


@dataclass
class Part(InputPartition):
    name: str


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def manifest(path: str) -> dict:
    """What is stored: revision (0 if nothing is), key, schema, parts."""
    data = Folder(path).read(MANIFEST)
    return json.loads(data) if data else {"revision": 0, "key": None, "schema": None, "parts": []}


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.key, self.overwrite = options["path"], options["key"], overwrite
        self.loaded = int(options["loaded_revision"]) if "loaded_revision" in options else None
        self.kind = schema
        self.columns = [f.name for f in schema.fields if f.name != self.key]
        bad = [f.name for f in schema.fields if f.name != self.key and f.dataType.typeName() not in ("double", "float", "long", "integer", "short", "byte", "boolean")]
        if bad or self.key not in schema.names:
            raise ValueError(f"columns {bad or [self.key]} can't be stored as arrays by {self.key}")
        if self.loaded is not None and manifest(self.path)["revision"] != self.loaded:
            raise Conflict(f"stored is revision {manifest(self.path)['revision']}, loaded was {self.loaded}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        folder, names, held, count, now = Folder(self.path), [], [], 0, None

        def put():
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column(self.key).to_pylist()
            first = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            if len({keys[i] for i in first}) < len(first):
                raise ValueError("a key's rows must stand together")
            ends = [*first[1:], len(keys)]
            arrays = {}
            for c in self.columns:
                column = rows.column(c)
                arrays[c] = (column.cast(pa.int8()).fill_null(-1) if pa.types.is_boolean(column.type) else column).to_numpy()
            data = io.BytesIO()
            np.savez_compressed(data, **arrays)
            entries = [{"key": keys[a], "first": a, "rows": b - a, "sha256": {c: _sha(v[a:b].tobytes()) for c, v in arrays.items()}} for a, b in zip(first, ends)]
            body = {"arrays": {c: str(v.dtype) for c, v in arrays.items()}, "keys": entries}
            name = _sha(json.dumps(body, sort_keys=True).encode())
            folder.write(f"data/{name}.npz", data.getvalue())
            folder.write(f"parts/{name}.json", json.dumps(body, sort_keys=True).encode())
            names.append(name)

        for batch in iterator:
            keys = batch.column(self.key).to_pylist()
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != now and count >= PART_ROWS:
                        put()
                        held, count = [], 0
                    now = keys[start]
                    held.append(batch.slice(start, i - start))
                    count += i - start
                    start = i
        if held:
            put()
        return Parts(names)

    def commit(self, messages) -> None:
        before = manifest(self.path)
        if self.loaded is not None and before["revision"] != self.loaded:
            raise Conflict(f"stored is revision {before['revision']}, loaded was {self.loaded}")
        parts = sorted({n for m in messages if m for n in m.names} | set([] if self.overwrite else before["parts"]))
        after = {"key": self.key, "schema": self.kind.jsonValue(), "parts": parts}
        if any(before[k] != v for k, v in after.items()):
            Folder(self.path).write(MANIFEST, json.dumps({"revision": before["revision"] + 1, **after}, sort_keys=True).encode())

    def abort(self, messages) -> None:
        """Parts that no manifest names are never read; those of this write go, unless the manifest has them."""
        folder, kept = Folder(self.path), set(manifest(self.path)["parts"])
        for name in {n for m in messages if m for n in m.names} - kept:
            folder.drop(f"parts/{name}.json")
            folder.drop(f"data/{name}.npz")


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.schema, self.key = options["path"], schema, manifest(options["path"])["key"]

    def partitions(self):
        return [Part(n) for n in manifest(self.path)["parts"]] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        folder, kind = Folder(self.path), to_arrow_schema(self.schema)
        body = json.loads(folder.read(f"parts/{partition.name}.json"))
        with np.load(io.BytesIO(folder.read(f"data/{partition.name}.npz")), allow_pickle=False) as f:
            arrays = {c: f[c] for c in body["arrays"]}
        for e in body["keys"]:
            a, b = e["first"], e["first"] + e["rows"]
            altered = [c for c, v in arrays.items() if _sha(v[a:b].tobytes()) != e["sha256"][c]]
            if altered:
                raise ValueError(f"arrays {altered} of {e['key']} are not what was written")
            columns = []
            for field in kind:
                if field.name == self.key:
                    columns.append(pa.array([e["key"]] * (b - a), field.type))
                elif pa.types.is_boolean(field.type):
                    v = arrays[field.name][a:b]
                    columns.append(pa.array(v == 1, mask=v < 0))
                else:
                    columns.append(pa.array(arrays[field.name][a:b], from_pandas=True).cast(field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=kind)


class ArrayStore(DataSource):
    """Options: path; key (the column whose rows are one piece of each array); loaded_revision (a write fails if the stored one is another)."""

    @classmethod
    def name(cls) -> str:
        return "array_store"

    def schema(self) -> StructType:
        kind = manifest(self.options["path"])["schema"]
        if kind is None:
            raise ValueError("nothing is stored there")
        return StructType.fromJson(kind)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, dict(self.options), overwrite)


def write_arrays(rows: DataFrame, path: str, key: str, order: list[str], *, loaded_revision: int | None = None, overwrite: bool = True) -> None:
    """Stores rows as arrays by ``key``, each in ``order``; with ``overwrite`` in place of what is there, else beside it (keys must be new).  Nulls of numbers become NaN, so columns with nulls must be doubles."""
    rows.sparkSession.dataSource.register(ArrayStore)
    out = rows.repartition(key).sortWithinPartitions(key, *order).write.format("array_store").option("path", path).option("key", key)
    if loaded_revision is not None:
        out = out.option("loaded_revision", str(loaded_revision))
    out.mode("overwrite" if overwrite else "append").save()


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """What the manifest of a folder names; an altered array raises."""
    spark.dataSource.register(ArrayStore)
    return spark.read.format("array_store").option("path", path).load()
