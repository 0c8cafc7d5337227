"""Queries of capture manifests and analysis results: one document of each kind for every order, its lines the streams and events, written as JSON and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.operators import contracts as C
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount")
#: Fields of a stream and of an event, by SQL that both engines read.
_STREAM = {
    "camera_id": "concat('c', CAST(l_suppkey % 7 AS VARCHAR(9)))", "view": "CASE WHEN l_partkey % 2 = 0 THEN 'face_on' ELSE 'down_the_line' END", "width": "CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1920 END", "height": "CASE WHEN l_partkey % 60 = 7 THEN 0 ELSE 1080 END",
    "frame_count": "CAST(l_quantity AS BIGINT) - 1", "nominal_fps": "CASE WHEN l_partkey % 40 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END", "first_timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber",
    "last_timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber + CASE l_partkey % 11 WHEN 0 THEN -5 WHEN 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 16666667 END", "dropped_frame_count": "CAST(l_linenumber % 3 AS BIGINT)",
}
_GAP = {"start_timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber + l_partkey % 5 - 1", "end_timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber + l_partkey % 5 + l_partkey % 7 - 2", "missing_frame_count": "CAST(l_partkey % 3 AS BIGINT)"}
_EVENT = {"name": "CASE WHEN l_partkey % 30 = 0 THEN ' ' ELSE concat('P', CAST(l_linenumber AS VARCHAR(9))) END", "timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_partkey", "confidence": "l_discount * 12"}
_RANGE = {"start_timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_partkey - l_suppkey % 5 + 1", "end_timestamp_ns": "CAST(l_orderkey AS BIGINT) * 1000 + l_partkey + l_suppkey % 7 - 2"}


def _fields(of: dict[str, str]) -> list[Column]:
    return [F.expr(v).alias(k) for k, v in of.items()]


def _lines(spark, d, *fields: Column) -> DataFrame:
    """shot_id, rows: the fields of an order's lines in order.  Lines go to their order's partition as they are; lists begun before that would be as many as the lines, and wider."""
    row = F.struct(*_ORDER, F.struct(*fields).alias("of"))
    lines = D.table(spark, d, "lineitem").select("l_orderkey", *_ORDER).repartition("l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(row))["of"].alias("rows"))


def manifest_docs(spark, d) -> DataFrame:
    gaps = F.when(F.expr("l_partkey % 4 > 0"), F.array(F.struct(*_fields(_GAP)))).otherwise(F.array().cast(f"array<{C.GAP}>"))
    o = D.table(spark, d, "orders").select("o_orderkey").join(_lines(spark, d, *_fields(_STREAM), gaps.alias("gaps")), "o_orderkey", "left")
    return o.select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("shot_id"), F.coalesce("rows", F.array().cast(f"array<{C.STREAM}>")).alias("streams"))).alias("doc"))


def result_docs(spark, d) -> DataFrame:
    o = D.table(spark, d, "orders").where("o_orderkey % 9 <> 4").join(_lines(spark, d, *_fields(_EVENT), F.struct(*_fields(_RANGE)).alias("range")), "o_orderkey", "left")
    note = lambda cond, code, text: F.when(F.expr(cond), F.array(F.struct(F.expr(code).alias("code"), F.expr(text).alias("message")))).otherwise(F.array().cast(f"array<{C.NOTE}>"))
    return o.select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("shot_id"), F.struct(F.lit("kinematic").alias("name"), F.expr("CASE WHEN o_custkey % 17 = 0 THEN '' ELSE '1.0' END").alias("version")).alias("analyzer"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'partial' ELSE 'failed' END").alias("status"), F.coalesce("rows", F.array().cast(f"array<{C.EVENT}>")).alias("events"),
        note("o_custkey % 5 = 0", "'W1'", "CASE WHEN o_custkey % 10 = 0 THEN ' ' ELSE 'blurred' END").alias("warnings"), note("o_custkey % 4 = 0", "CASE WHEN o_custkey % 8 = 0 THEN '' ELSE 'E1' END", "'no club'").alias("errors"),
        F.create_map(F.lit("tempo"), F.struct(F.col("o_totalprice").alias("value"), F.expr("CASE WHEN o_custkey % 6 = 0 THEN '' WHEN o_custkey % 7 = 0 THEN NULL ELSE 'ms' END").alias("unit"))).alias("measurements"),
        F.array(F.struct(F.lit("overlay").alias("kind"), F.expr("CASE WHEN o_custkey % 13 = 0 THEN '../overlay.mp4' ELSE concat('shots/', CAST(o_orderkey AS VARCHAR(20)), '.mp4') END").alias("path"))).alias("artifacts"),
    )).alias("doc"))


def _sql(of: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in of.items())


_RANK = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1"
_ST = f"st AS (SELECT CAST(l_orderkey AS VARCHAR) AS shot_id, {_RANK} AS stream, {_sql(_STREAM)}, l_partkey % 4 > 0 AS has_gap, {', '.join(f'{v} AS gap_{k}' for k, v in _GAP.items())} FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_EV = f"ev AS (SELECT CAST(l_orderkey AS VARCHAR) AS shot_id, {_RANK} AS event, {_sql(_EVENT)}, {', '.join(f'{v} AS {k[:-13]}_ns' for k, v in _RANGE.items())} FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 4)"


@_R.add("src8_manifest_gaps", f"WITH {_ST} SELECT shot_id, stream, camera_id, CASE WHEN has_gap THEN 0 END AS gap, {', '.join(f'CASE WHEN has_gap THEN gap_{k} END AS {k}' for k in _GAP)} FROM st")
def manifest_gaps(spark, d):
    return C.manifest_gaps(C.manifest_streams(C.manifests(manifest_docs(spark, d))))


_AT = "'streams[' || stream || ']'"


@_R.add("c4_manifest_violations", f"""WITH {_ST}
SELECT CAST(o_orderkey AS VARCHAR) AS shot_id, 'streams' AS path, 'no streams' AS rule FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT shot_id, {_AT}, 'no width' FROM st WHERE width < 1 UNION ALL SELECT shot_id, {_AT}, 'no height' FROM st WHERE height < 1 UNION ALL SELECT shot_id, {_AT}, 'no frames' FROM st WHERE frame_count < 1
UNION ALL SELECT shot_id, {_AT}, 'frame rate not positive' FROM st WHERE nominal_fps <= 0 UNION ALL SELECT shot_id, {_AT}, 'ends before it begins' FROM st WHERE last_timestamp_ns < first_timestamp_ns
UNION ALL SELECT shot_id, {_AT}, 'several frames at one time' FROM st WHERE last_timestamp_ns = first_timestamp_ns AND frame_count > 1 UNION ALL SELECT shot_id, {_AT}, 'gaps miss more frames than were dropped' FROM st WHERE has_gap AND gap_missing_frame_count > dropped_frame_count
UNION ALL SELECT shot_id, {_AT} || '.gaps[0]', 'ends before it begins' FROM st WHERE has_gap AND gap_end_timestamp_ns < gap_start_timestamp_ns UNION ALL SELECT shot_id, {_AT} || '.gaps[0]', 'no frame missing' FROM st WHERE has_gap AND gap_missing_frame_count < 1
UNION ALL SELECT shot_id, {_AT} || '.gaps[0]', 'outside its stream' FROM st WHERE has_gap AND first_timestamp_ns <= last_timestamp_ns AND (gap_start_timestamp_ns < first_timestamp_ns OR gap_end_timestamp_ns > last_timestamp_ns)
UNION ALL SELECT shot_id, {_AT} || '.camera_id', 'camera on more than one stream' FROM (SELECT *, row_number() OVER (PARTITION BY shot_id, camera_id ORDER BY stream) AS k FROM st) WHERE k > 1""")
def manifest_violations(spark, d):
    return C.manifest_violations(C.manifests(manifest_docs(spark, d)))


@_R.add("a22_stream_summaries", f"""WITH {_ST} SELECT shot_id, stream, camera_id, frame_count AS frames, round((last_timestamp_ns - first_timestamp_ns) / 1e6::DOUBLE, 6) AS duration_ms,
    round(CASE WHEN frame_count > 1 AND last_timestamp_ns > first_timestamp_ns THEN (frame_count - 1) * 1e9::DOUBLE / (last_timestamp_ns - first_timestamp_ns) END, 6) AS measured_fps, dropped_frame_count AS dropped, CASE WHEN has_gap THEN 1 ELSE 0 END AS gaps FROM st""")
def stream_summaries(spark, d):
    return rounded(C.stream_summaries(C.manifest_streams(C.manifests(manifest_docs(spark, d)))))


_OR = "ro AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS shot_id FROM orders WHERE o_orderkey % 9 <> 4)"


@_R.add("a22_result_summaries", f"WITH {_OR}, {_EV} SELECT ro.shot_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, (SELECT count(*) FROM ev WHERE ev.shot_id = ro.shot_id) AS events, CAST(o_custkey % 5 = 0 AS BIGINT) AS warnings, CAST(o_custkey % 4 = 0 AS BIGINT) AS errors, 1 AS measurements, 1 AS artifacts FROM ro")
def result_summaries(spark, d):
    return C.result_summaries(C.results(result_docs(spark, d)))


@_R.add("src9_result_events", f"WITH {_EV} SELECT shot_id, event, name, timestamp_ns, round(confidence, 6) AS confidence, start_ns, end_ns FROM ev")
def result_events(spark, d):
    return rounded(C.result_events(C.results(result_docs(spark, d))))


@_R.add("src9_result_values", f"WITH {_OR} SELECT shot_id, 'tempo' AS key, round(o_totalprice, 4) AS value, CASE WHEN o_custkey % 6 = 0 THEN '' WHEN o_custkey % 7 = 0 THEN NULL ELSE 'ms' END AS unit, 'overlay' AS kind, CASE WHEN o_custkey % 13 = 0 THEN '../overlay.mp4' ELSE 'shots/' || o_orderkey || '.mp4' END AS path FROM ro")
def result_values(spark, d):
    return rounded(C.result_values(C.results(result_docs(spark, d))), 4)


@_R.add("c5_result_violations", f"""WITH {_OR}, {_EV}
SELECT shot_id, 'result' AS path, 'analyzer without a version' AS rule FROM ro WHERE o_custkey % 17 = 0 UNION ALL SELECT shot_id, 'result', 'ok in spite of errors' FROM ro WHERE o_orderstatus = 'F' AND o_custkey % 4 = 0
UNION ALL SELECT shot_id, 'events[' || event || ']', 'no name' FROM ev WHERE trim(name) = '' UNION ALL SELECT shot_id, 'events[' || event || ']', 'range ends before it begins' FROM ev WHERE end_ns < start_ns
UNION ALL SELECT shot_id, 'events[' || event || ']', 'outside its range' FROM ev WHERE start_ns <= end_ns AND (timestamp_ns < start_ns OR timestamp_ns > end_ns) UNION ALL SELECT shot_id, 'events[' || event || ']', 'confidence not from 0 to 1' FROM ev WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT shot_id, 'warnings[0]', 'no message' FROM ro WHERE o_custkey % 10 = 0 UNION ALL SELECT shot_id, 'errors[0]', 'no code' FROM ro WHERE o_custkey % 8 = 0
UNION ALL SELECT shot_id, 'measurements.tempo', 'blank unit' FROM ro WHERE o_custkey % 6 = 0 UNION ALL SELECT shot_id, 'artifacts[0]', 'no portable path' FROM ro WHERE o_custkey % 13 = 0""")
def result_violations(spark, d):
    return C.result_violations(C.results(result_docs(spark, d)))


@_R.add("c13_events_in_captures", f"WITH {_ST}, {_EV}, sp AS (SELECT shot_id, min(first_timestamp_ns) AS a, max(last_timestamp_ns) AS b FROM st WHERE CAST(shot_id AS BIGINT) % 7 <> 2 GROUP BY shot_id) SELECT ev.shot_id, event, name, timestamp_ns BETWEEN a AND b AS inside FROM ev LEFT JOIN sp ON sp.shot_id = ev.shot_id")
def events_in_captures(spark, d):
    captured = C.manifests(manifest_docs(spark, d), C.CAPTURED).where(F.col("shot_id").cast("long") % 7 != 2)
    return C.events_in_captures(captured, C.results(result_docs(spark, d), C.ANALYSED))
