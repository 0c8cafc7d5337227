"""Files of a shared folder from tasks and data sources, by Arrow's file systems: local folders, and stores that a URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of video files.
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".m4v")


class Folder:
    """A folder and the file system that it is on."""

    def __init__(self, path: str):
        self.uri = path
        self.fs, self.top = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.top = self.top.rstrip("/")

    def read(self, name: str) -> bytes | None:
        """A file's bytes, None if there is no such file."""
        if self.fs.get_file_info(f"{self.top}/{name}").type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.top}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        """The whole file or nothing: it is written beside its place and moved there."""
        at = f"{self.top}/{name}"
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        beside = f"{at}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(beside) as f:
            f.write(data)
        self.fs.move(beside, at)

    def names(self, ending: str) -> list[tuple[str, int]]:
        """Names under the folder with this ending, and their sizes, in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.top, recursive=True, allow_not_found=True))
        return sorted((i.path[len(self.top) + 1 :], i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(ending))

    def drop(self, name: str) -> None:
        at = f"{self.top}/{name}"
        kind = self.fs.get_file_info(at).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(at)
        elif kind == fs.FileType.File:
            self.fs.delete_file(at)


def packed(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Names in order, in groups of about so many bytes."""
    out, held = [], 0
    for name, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


def _listed(files: DataFrame, top: str, endings: tuple[str, ...]) -> DataFrame:
    bare = F.regexp_replace("path", "^[a-z]+:/+", "/")
    root = "/" + top.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    name = F.substring(bare, len(root) + 1, 1 << 30)
    ok = F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + r")\z") & ~name.rlike(r"(^|/)\.")
    return files.select(name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")).where(ok)


def library(spark: SparkSession, top: str, endings: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """name (below ``top``), size_bytes, modified of the files of a capture library, by their metadata alone: no content is read.

    All folders below are searched; hidden files and those in hidden folders (a leading point) are left out, and endings are compared without case.
    Spark's listing also leaves out names with a leading underscore.  For the list in order, order by name.  A folder that isn't there is an empty library.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "name string, size_bytes long, modified timestamp")
    return _listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top), top, endings)


def library_stream(spark: SparkSession, top: str, endings: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """The same as a stream of the files that are new since the last batch."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    return _listed(spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(top), top, endings)
