"""The shapes that the operators work on, derived from the given tables: one function for Spark and one piece of SQL for each.

``pose``: frames of 21 landmarks; ``signal``: one value a frame; ``frames`` and ``triggers``: a camera stream; ``labels``: scored
observations; ``captures``: files named as a capture library names them; ``positions``: predicted and labelled frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LANDMARKS = 21
UNIFORM_MS = 16.67


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds of a time without a zone, read as the session's."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, t_ms, lm array<struct<x,y,z>>, conf: a recording for each label of embeddings, 60 frames a second."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    frame = F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1
    lm = F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda j: F.struct(F.get("e", j * 3).alias("x"), F.get("e", j * 3 + 1).alias("y"), F.get("e", j * 3 + 2).alias("z")))
    return e.withColumn("frame", frame).select("video_id", "frame", (F.col("frame") * 1000 / F.lit(60.0)).alias("t_ms"), lm.alias("lm"), F.abs(F.get("e", F.lit(63))).alias("conf"))


POSE = """pose AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
, p AS (SELECT video_id, frame, frame * 1000 / 60.0::DOUBLE AS t_ms, e, abs(e[64]) AS conf FROM pose)"""


def x(j: int) -> str:
    return f"e[{3 * j + 1}]"


def y(j: int) -> str:
    return f"e[{3 * j + 2}]"


def z(j: int) -> str:
    return f"e[{3 * j + 3}]"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pose as rows: video_id, backend, frame, t_ms, joint, x, y, conf, detected; backend b is the frame's neighbour with its points a little off."""
    p = pose(spark, sf_dir)
    rows = p.select("video_id", "frame", "t_ms", "conf", F.posexplode("lm").alias("joint", "q")).select("video_id", "frame", "t_ms", "joint", "q.x", "q.y", "conf")
    a = rows.withColumn("backend", F.lit("a"))
    b = rows.withColumn("backend", F.lit("b")).withColumn("x", F.col("x") + 0.05 * (F.col("joint") % 3)).withColumn("conf", F.col("conf") * 0.9)
    both = a.unionByName(b)
    return both.withColumn("detected", (F.col("frame") % 17) != 5).withColumn("min_conf", F.when(F.col("backend") == "a", 0.05).otherwise(0.03))


POINTS = f"""{POSE}
, joints AS (SELECT video_id, frame, t_ms, conf, j AS joint, e[3 * j + 1] AS x, e[3 * j + 2] AS y FROM p, (SELECT unnest(range({LANDMARKS})) AS j))
, pts AS (SELECT *, frame % 17 <> 5 AS detected FROM (SELECT 'a' AS backend, video_id, frame, t_ms, joint, x, y, conf, 0.05::DOUBLE AS min_conf FROM joints
    UNION ALL SELECT 'b', video_id, frame, t_ms, joint, x + 0.05::DOUBLE * (joint % 3), y, conf * 0.9::DOUBLE, 0.03::DOUBLE FROM joints))"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, t_ms (uniform), raw_ms (as recorded), speed: a recording for each user of events."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("video_id"), "ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("speed"))
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    e = e.withColumn("frame", F.row_number().over(w) - 1).withColumn("raw_ms", (micros("ts") - micros(F.first("ts").over(w))) / F.lit(1000.0))
    return e.select("video_id", "frame", (F.col("frame") * UNIFORM_MS).alias("t_ms"), "raw_ms", "speed")


SIGNAL = f"""s0 AS (SELECT user_id AS video_id, row_number() OVER w - 1 AS frame, (epoch_us(ts) - epoch_us(first(ts) OVER w)) / 1000.0::DOUBLE AS raw_ms, coalesce(value, 0) AS speed
    FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
, s AS (SELECT video_id, frame, frame * {UNIFORM_MS}::DOUBLE AS t_ms, raw_ms, speed FROM s0)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, camera_id, sequence, ts_ns, bytes: every event is a frame of the camera of its type."""
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("camera_id"), F.col("event_id").alias("sequence"), (micros("ts") * 1000).alias("ts_ns"), F.floor(F.col("value") * 100).cast("long").alias("bytes"))


FRAMES = """f AS (SELECT user_id AS session_id, event_type AS camera_id, event_id AS sequence, epoch_us(ts) * 1000 AS ts_ns, CAST(floor(value * 100) AS BIGINT) AS bytes
    FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"""


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, shot_id, trigger_ns, pre_roll_ns: every purchase triggers a clip of the six hours before it."""
    return frames(spark, sf_dir).where("camera_id = 'purchase'").select("session_id", F.col("sequence").alias("shot_id"), F.col("ts_ns").alias("trigger_ns"), F.lit(6 * 3600 * 10**9).cast("long").alias("pre_roll_ns"))


TRIGGERS = f"""{FRAMES}
, t AS (SELECT session_id, sequence AS shot_id, ts_ns AS trigger_ns, CAST(21600000000000 AS BIGINT) AS pre_roll_ns FROM f WHERE camera_id = 'purchase')"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backend, view, video_id, frame, joint, visible, err (null where nothing was found): one row per line of an order."""
    l = table(spark, sf_dir, "lineitem")
    err = F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount"))
    return l.select(F.col("l_linestatus").alias("backend"), F.col("l_returnflag").alias("view"), F.col("l_suppkey").alias("video_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("joint"), (F.col("l_tax") < 0.04).alias("visible"), err.alias("err"))


LABELS = """l AS (SELECT l_linestatus AS backend, l_returnflag AS view, l_suppkey AS video_id, l_orderkey AS frame, l_linenumber AS joint, l_tax < 0.04::DOUBLE AS visible, CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS err FROM lineitem)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, p, predicted, labelled, fps: frames of key positions, one row per order line of the first ten."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber between 1 and 10")
    g = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").cast("long").alias("q"))
    labelled = F.col("part") % 60 + F.col("l_linenumber") * 20
    return g.select(F.col("l_orderkey").alias("video_id"), F.concat(F.lit("P"), "l_linenumber").alias("p"), (labelled + F.col("q") % 9 - 4).alias("predicted"), labelled.alias("labelled"), F.when(F.col("l_orderkey") % 2 == 0, 60.0).otherwise(30.0).alias("fps"))


POSITIONS = """g AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS part, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linenumber BETWEEN 1 AND 10 GROUP BY ALL)
, pos AS (SELECT l_orderkey AS video_id, 'P' || l_linenumber AS p, part % 60 + l_linenumber * 20 + q % 9 - 4 AS predicted, part % 60 + l_linenumber * 20 AS labelled, CASE WHEN l_orderkey % 2 = 0 THEN 60.0::DOUBLE ELSE 30.0::DOUBLE END AS fps FROM g)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: a capture file for each order, named after its customer, date and camera; every seventh name is not of that form."""
    o = table(spark, sf_dir, "orders")
    camera = F.element_at(F.array(*[F.lit(c) for c in ("Down The Line", "Face On", "DTL cam", "Front", "Ceiling")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.lpad((F.col("o_custkey") % 240000).cast("string"), 6, "0")
    name = F.concat(F.lit("User "), (F.col("o_custkey") % 40).cast("string"), F.lit(" - "), stamp, F.lit(" "), time, F.lit(" "), camera, F.lit(" "), F.lpad(F.lower(F.hex(F.col("o_orderkey") % 65536)), 4, "0"), F.lit(".mp4"))
    odd = F.concat(F.lit("clip_"), F.col("o_orderkey").cast("string"), F.lit(".mov"))
    return o.select(F.concat(F.lit("/library/"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), F.when(F.col("o_orderkey") % 7 == 0, odd).otherwise(name)).alias("path"))


CAPTURES = """c AS (SELECT '/library/' || (o_custkey % 40) || '/' || CASE WHEN o_orderkey % 7 = 0 THEN 'clip_' || o_orderkey || '.mov' ELSE 'User ' || (o_custkey % 40) || ' - ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' ||
    lpad(CAST(o_custkey % 240000 AS VARCHAR), 6, '0') || ' ' || ['Down The Line', 'Face On', 'DTL cam', 'Front', 'Ceiling'][o_orderkey % 5 + 1] || ' ' || lpad(lower(to_hex(o_orderkey % 65536)), 4, '0') || '.mp4' END AS path FROM orders)"""


def rounded(df: DataFrame, digits: int = 6, *, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles of a result to so many decimals, as its SQL gives them; -0 becomes 0."""
    def one(c: str, t: str) -> Column:
        return (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in but else F.col(c)

    return df.select(*[one(c, t) for c, t in df.dtypes])
