"""Capture manifests and analysis results: JSON documents read to rows with a schema of their own, their rules, summaries and the join of both.

A document is a row with its JSON text in ``doc``.  One that is no JSON object has null fields, and gives a violation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions.text import is_relative_path

GAP = "struct<start_timestamp_ns:bigint,end_timestamp_ns:bigint,missing_frame_count:bigint>"
STREAM = f"struct<camera_id:string,view:string,width:int,height:int,frame_count:bigint,nominal_fps:double,first_timestamp_ns:bigint,last_timestamp_ns:bigint,dropped_frame_count:bigint,gaps:array<{GAP}>>"
MANIFEST = f"struct<shot_id:string,trigger_timestamp_ns:bigint,streams:array<{STREAM}>>"
NOTE = "struct<code:string,message:string>"
EVENT = "struct<name:string,timestamp_ns:bigint,confidence:double,`range`:struct<start_timestamp_ns:bigint,end_timestamp_ns:bigint>>"
RESULT = f"struct<shot_id:string,analyzer:struct<name:string,version:string>,status:string,events:array<{EVENT}>,warnings:array<{NOTE}>,errors:array<{NOTE}>,measurements:map<string,struct<value:double,unit:string>>,artifacts:array<struct<kind:string,path:string>>>"
#: What events_in_captures needs of both.
CAPTURED = "struct<shot_id:string,streams:array<struct<first_timestamp_ns:bigint,last_timestamp_ns:bigint>>>"
ANALYSED = "struct<shot_id:string,events:array<struct<name:string,timestamp_ns:bigint>>>"


def _read(docs: DataFrame, schema: str) -> DataFrame:
    """The fields of each document.  It is read in a generator, which filters and fields do not pass: as a projection it would be read, and written, again for each of them."""
    return docs.select(F.inline(F.array(F.from_json("doc", schema))))


def manifests(docs: DataFrame, schema: str = MANIFEST) -> DataFrame:
    """shot_id, trigger_timestamp_ns and streams (array) of each manifest; the fields of a narrower schema alone cost less to read."""
    return _read(docs, schema)


def manifest_streams(read: DataFrame) -> DataFrame:
    """shot_id, stream (its place) and the fields of every stream of manifests."""
    return read.select("shot_id", F.posexplode("streams").alias("stream", "s")).select("shot_id", "stream", "s.*")


def manifest_gaps(streams: DataFrame) -> DataFrame:
    """Every stream with each of its gaps (gap, its place, and the fields); null ones for a stream without gaps."""
    return streams.select("shot_id", "stream", "camera_id", F.posexplode_outer("gaps").alias("gap", "g")).select("shot_id", "stream", "camera_id", "gap", "g.*")


def _broken(df: DataFrame, path: Column, rules: list[tuple[Column, str]]) -> DataFrame:
    """shot_id, path, rule of all rules that hold of a row."""
    return df.select("shot_id", path.alias("path"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("rule"))


def _place(name: str, *more: Column | str) -> Column:
    return F.concat(F.lit("streams["), F.col("stream").cast("string"), F.lit("]"), *[F.lit(m) if isinstance(m, str) else m for m in more])


def manifest_violations(read: DataFrame) -> DataFrame:
    """All rules that manifests break: shot_id, path, rule."""
    streams = manifest_streams(read)
    gaps = streams.select("shot_id", "stream", "first_timestamp_ns", "last_timestamp_ns", F.posexplode("gaps").alias("gap", "g")).select("shot_id", "stream", "first_timestamp_ns", "last_timestamp_ns", "gap", "g.*")
    first, last = F.col("first_timestamp_ns"), F.col("last_timestamp_ns")
    fps = F.col("nominal_fps")
    own = _broken(streams, _place("streams"), [
        (F.col("width") < 1, "no width"), (F.col("height") < 1, "no height"), (F.col("frame_count") < 1, "no frames"), (fps.isNull() | F.isnan(fps) | (fps <= 0), "frame rate not positive"),
        (last < first, "ends before it begins"), ((last == first) & (F.col("frame_count") > 1), "several frames at one time"),
        (F.aggregate("gaps", F.lit(0).cast("long"), lambda a, g: a + g["missing_frame_count"]) > F.col("dropped_frame_count"), "gaps miss more frames than were dropped"),
    ])
    start, end = F.col("start_timestamp_ns"), F.col("end_timestamp_ns")
    inner = _broken(gaps, _place("streams", ".gaps[", F.col("gap").cast("string"), "]"), [
        (end < start, "ends before it begins"), (F.col("missing_frame_count") < 1, "no frame missing"), ((first <= last) & ((start < first) | (end > last)), "outside its stream"),
    ])
    empty = _broken(read, F.lit("streams"), [(F.coalesce(F.size("streams"), F.lit(0)) < 1, "no streams")])
    twice = streams.groupBy("shot_id", "camera_id").agg(F.collect_list("stream").alias("at")).where(F.size("at") > 1)
    twice = twice.select("shot_id", F.explode(F.slice(F.array_sort("at"), 2, F.size("at") - 1)).alias("stream"))
    return reduce(DataFrame.unionByName, [empty, own, inner, _broken(twice, _place("streams", ".camera_id"), [(F.lit(True), "camera on more than one stream")])])


def stream_summaries(streams: DataFrame) -> DataFrame:
    """Of every stream of manifests: frames, duration_ms, measured_fps (null under two frames or without duration), dropped, gaps."""
    ns = F.col("last_timestamp_ns") - F.col("first_timestamp_ns")
    fps = F.when((F.col("frame_count") > 1) & (ns > 0), (F.col("frame_count") - 1) * F.lit(1e9) / ns)
    return streams.select("shot_id", "stream", "camera_id", F.col("frame_count").alias("frames"), (ns / F.lit(1e6)).alias("duration_ms"), fps.alias("measured_fps"), F.col("dropped_frame_count").alias("dropped"), F.coalesce(F.size("gaps"), F.lit(0)).cast("long").alias("gaps"))


def results(docs: DataFrame, schema: str = RESULT) -> DataFrame:
    """The fields of each analysis result, or those of a narrower schema."""
    return _read(docs, schema)


def result_events(read: DataFrame) -> DataFrame:
    return read.select("shot_id", F.posexplode("events").alias("event", "e")).select("shot_id", "event", "e.name", "e.timestamp_ns", "e.confidence", F.col("e.range.start_timestamp_ns").alias("start_ns"), F.col("e.range.end_timestamp_ns").alias("end_ns"))


def result_measurements(read: DataFrame) -> DataFrame:
    return read.select("shot_id", F.explode("measurements").alias("key", "m")).select("shot_id", "key", "m.value", "m.unit")


def result_artifacts(read: DataFrame) -> DataFrame:
    return read.select("shot_id", F.posexplode("artifacts").alias("artifact", "a")).select("shot_id", "artifact", "a.kind", "a.path")


def result_values(read: DataFrame) -> DataFrame:
    """shot_id, key, value, unit, kind, path: every measurement of a result with every artifact of the same result."""
    m = read.select("shot_id", F.explode("measurements").alias("key", "m"), "artifacts")
    return m.select("shot_id", "key", "m", F.explode("artifacts").alias("a")).select("shot_id", "key", "m.value", "m.unit", "a.kind", "a.path")


def _rules(path: Column, rules: list[tuple[Column, str]]) -> Column:
    """Array of (path, rule) of all rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.struct(path.alias("path"), F.lit(t).alias("rule"))) for c, t in rules]))


def result_violations(read: DataFrame) -> DataFrame:
    """All rules that analysis results break: shot_id, path, rule.  Every document is read once and gives all of its violations."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def each(name: str, rules) -> Column:
        """Violations of all entries of an array, none if it is null."""
        at = lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
        return F.coalesce(F.flatten(F.transform(name, lambda v, i: _rules(at(i), rules(v)))), F.array())

    def event(e: Column) -> list:
        at, start, end = e["timestamp_ns"], e["range"]["start_timestamp_ns"], e["range"]["end_timestamp_ns"]
        return [
            (blank(e["name"]), "no name"), (~(start <= end), "range ends before it begins"), ((start <= end) & ~at.between(start, end), "outside its range"),
            (F.coalesce(~e["confidence"].between(0.0, 1.0), F.lit(True)), "confidence not from 0 to 1"),
        ]

    def measured(m: Column) -> Column:
        value, unit = m["value"]["value"], m["value"]["unit"]
        return _rules(F.concat(F.lit("measurements."), m["key"]), [(F.coalesce(F.isnan(value), F.lit(True)), "no number"), (unit.isNotNull() & blank(unit), "blank unit")])

    note = lambda n: [(blank(n["code"]), "no code"), (blank(n["message"]), "no message")]
    every = F.concat(
        _rules(F.lit("result"), [(blank(F.col("analyzer.name")), "analyzer without a name"), (blank(F.col("analyzer.version")), "analyzer without a version"), ((F.col("status") == "ok") & (F.size("errors") > 0), "ok in spite of errors")]),
        each("events", event), each("warnings", note), each("errors", note),
        F.coalesce(F.flatten(F.transform(F.map_entries("measurements"), measured)), F.array()),
        each("artifacts", lambda a: [(blank(a["kind"]), "no kind"), (~F.coalesce(is_relative_path(a["path"]), F.lit(False)), "no portable path")]),
    )
    return read.select("shot_id", F.inline(every))


def result_summaries(read: DataFrame) -> DataFrame:
    """Of every result: status and how many events, warnings, errors, measurements and artifacts it has."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
    return read.select("shot_id", "status", *[n(c) for c in ("events", "warnings", "errors", "measurements", "artifacts")])


def events_in_captures(captured: DataFrame, analysed: DataFrame) -> DataFrame:
    """Events of results against the span of their shot's capture, all its streams: shot_id, event, name, inside (null if the shot was not captured)."""
    span = captured.select("shot_id", F.array_min("streams.first_timestamp_ns").alias("first_ns"), F.array_max("streams.last_timestamp_ns").alias("last_ns"))
    span = span.groupBy("shot_id").agg(F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))
    e = analysed.select("shot_id", F.arrays_zip(F.col("events.name"), F.col("events.timestamp_ns")).alias("events")).join(span, "shot_id", "left")
    e = e.select("shot_id", "first_ns", "last_ns", F.posexplode("events").alias("event", "e"))
    return e.select("shot_id", "event", "e.name", F.col("e.timestamp_ns").between(F.col("first_ns"), F.col("last_ns")).alias("inside"))
