"""Queries of catalog documents, snapshots, setup readiness, reports, annotations and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.functions.text import contract_view
from motion_tables.operators import snapshots as S
from motion_tables.plans.registry import Registry
from motion_tables.sources import derived as D
from motion_tables.sources.derived import rounded, x, y
from motion_tables.sources.scratch import scratch_folder

_R = Registry()
QUERIES, ORACLE_SQL = _R.queries, _R.sql
E = F.expr


@_R.add("sc3_contract_views", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'down_the_line' WHEN 1 THEN 'face_on' END AS contract, o_orderkey % 3 = 2 AS rejected FROM orders")
def contract_views(spark, d):
    v = E("CASE o_orderkey % 3 WHEN 0 THEN 'dtl' WHEN 1 THEN 'face_on' ELSE 'rear' END")
    return D.table(spark, d, "orders").select("o_orderkey", contract_view(v).alias("contract"), contract_view(v).isNull().alias("rejected"))


@_R.add("sc24_canonical_hashes", r"""SELECT o_orderkey, sha256('{"club":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '{"length_in":' || CASE WHEN o_orderkey % 2 = 0 THEN '34.5' ELSE '34' END || ',"name":"' || trim(o_orderpriority) || '","Ärmel":[' || CASE o_orderkey % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '1' ELSE '1e-07' END || ',{"a":"\"\u0001","b":"é\n"}]}' END || ',"golfer_id":' || o_custkey || ',"shot_id":"o' || o_orderkey || '"}') AS sha256 FROM orders""")
def canonical_hashes(spark, d):
    """Documents whose keys stand in one of several orders, spelled in one of several ways."""
    club = E(r"""CASE WHEN o_orderkey % 5 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN concat('{ "name" : "', trim(o_orderpriority), '", "\\u00c4rmel":[', n, ', {"b":"\\u00e9\\n","a":"\\"\\u0001"}], "length_in":', len, '}')
        ELSE concat('{"length_in":', len, ',"\u00c4rmel":[', n, ',{"a":"\\u0022\\u0001","b":"é\\n"}],"name":"', trim(o_orderpriority), '"}') END""")
    o = D.table(spark, d, "orders").withColumns({"n": E("CASE o_orderkey % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '1' ELSE '1E-7' END"), "len": E("CASE WHEN o_orderkey % 2 = 0 THEN '3.450e1' ELSE '34' END")}).withColumn("club", club)
    doc = E("""CASE WHEN o_orderkey % 2 = 0 THEN concat('{"shot_id":"o', o_orderkey, '","club":', club, ',"golfer_id":', o_custkey, '}') ELSE concat('{"golfer_id": ', o_custkey, ', "club": ', club, ', "shot_id": "o', o_orderkey, '"}') END""")
    return o.select("o_orderkey", S.canonical_sha256(doc, text=True).alias("sha256"))


@_R.add("sc28_confirmed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' AND o_custkey % 2 = 0")
def confirmed(spark, d):
    from motion_tables.operators.labels import confirmed as kept

    a = D.table(spark, d, "orders").select("o_orderkey", E("CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'p6' ELSE 'p7-impact' END").alias("convention"), E("CASE WHEN o_custkey % 2 = 1 THEN true WHEN o_custkey % 4 = 0 THEN false END").alias("needs_review"))
    return kept(a).select("o_orderkey")


@_R.add("sc31_presentation_times", f"WITH {D.SIGNAL} SELECT video_id, frame, CASE WHEN video_id % 6 <> 5 THEN round(video_id * 10 + t_ms, 3) END AS presentation_ms FROM s")
def presentation_times(spark, d):
    from motion_tables.operators.labels import presentation_times as shown

    return rounded(shown(D.signal(spark, d).withColumn("start_offset_ms", E("CASE WHEN video_id % 6 <> 5 THEN video_id * 10 END"))).select("video_id", "frame", "presentation_ms"), 3)


@_R.add("sc32_club_specifications", "SELECT p_partkey AS shot_id, p_brand AS category, p_name AS name, CASE WHEN p_size % 4 <> 0 THEN p_size END AS length_in, p_size % 4 <> 0 AS length_known FROM part")
def club_specifications(spark, d):
    from motion_tables.operators.labels import club_specifications as specified

    shots = D.table(spark, d, "part").select(F.col("p_partkey").alias("shot_id"), F.struct(F.col("p_brand").alias("category"), F.col("p_name").alias("name"), E("CASE WHEN p_size % 4 <> 0 THEN p_size END").alias("length_in"), F.lit("ruler").alias("length_basis")).alias("club"))
    return specified(shots).drop("length_basis")


@_R.add("src5_catalog_records", "WITH r AS (SELECT 'g' || (c_custkey % 140) AS id, CAST(c_nationkey AS VARCHAR) AS nation FROM customer) SELECT id, nation, 7 AS revision, count(*) OVER (PARTITION BY id) > 1 AS duplicate FROM r")
def catalog_records(spark, d):
    record = F.create_map(F.lit("golfer_id"), F.concat(F.lit("g"), (F.col("c_custkey") % 140).cast("string")), F.lit("nation"), F.col("c_nationkey").cast("string"))
    c = D.table(spark, d, "customer").groupBy(F.lit(1).alias("schema_version"), F.lit(7).alias("revision"), (F.col("c_custkey") % 16).alias("file")).agg(F.collect_list(record).alias("records"))
    docs = c.select(F.to_json(F.struct("schema_version", "revision", "records")).alias("doc")).unionByName(spark.createDataFrame([(None,)], "doc string"))
    return S.catalog_records(docs, "golfer_id").select("id", F.try_element_at("record", F.lit("nation")).alias("nation"), "revision", "duplicate")


@_R.add("src10_calibration_cameras", "SELECT 'k' || s_suppkey AS calibration_id, 'c' || i AS camera_id, 1920 AS width, (s_suppkey + i) % 5 <> 0 AS rigid FROM supplier, (SELECT unnest([0, 1]) AS i)")
def calibration_cameras(spark, d):
    turn = F.array(*[F.lit(v) for v in (0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0)])
    bent = F.array(*[F.lit(v) for v in (0.6, -0.8, 0.0, 0.8, 0.7, 0.0, 0.0, 0.0, 1.0)])
    camera = lambda i: F.struct(F.lit(f"c{i}").alias("camera_id"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.when((F.col("s_suppkey") + i) % 5 != 0, turn).otherwise(bent).alias("rotation"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("translation"))
    docs = D.table(spark, d, "supplier").select(F.to_json(F.struct(F.concat(F.lit("k"), "s_suppkey").alias("calibration_id"), F.array(camera(0), camera(1)).alias("cameras"))).alias("doc"))
    return S.calibration_cameras(docs).select("calibration_id", "camera_id", "width", "rigid")


_MEMBERS = "me AS (SELECT 'k' || (o_custkey % 50) AS collection_id, 'o' || o_orderkey AS shot_id, 'x' || o_totalprice AS shot, o_orderkey FROM orders WHERE o_orderkey % 4 = 0), co AS (SELECT 'k' || s_suppkey AS collection_id, 'g' || s_nationkey AS golfer_id FROM supplier)"
_FROZEN = f"""{_MEMBERS}, ms AS (SELECT collection_id, list_sort(list({{'shot_id': shot_id, 'shot': 's' || o_orderkey}})) AS shots, coalesce(list_sort(list(DISTINCT CASE o_orderkey % 1000 WHEN 0 THEN 'source missing' WHEN 500 THEN 'labels do not validate' END) FILTER (o_orderkey % 500 = 0)), []) AS problems FROM me GROUP BY collection_id)
, fz AS (SELECT co.collection_id, CASE WHEN ms.collection_id IS NULL THEN ['no shots'] ELSE problems END AS refused, '{{"collection_id":"' || co.collection_id || '","frozen_at":"2024","frozen_by":"ann","golfer_id":"' || golfer_id || '","shots":' || CAST(to_json(list_transform(shots, lambda x: {{'shot': x.shot, 'shot_id': x.shot_id}})) AS VARCHAR) || '}}' AS doc, len(shots) AS n FROM co LEFT JOIN ms ON ms.collection_id = co.collection_id)"""


def _collections(spark, d):
    m = D.table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("k"), (F.col("o_custkey") % 50).cast("string")).alias("collection_id"), F.concat(F.lit("o"), "o_orderkey").alias("shot_id"), F.concat(F.lit("s"), "o_orderkey").alias("shot"))
    problems = D.table(spark, d, "orders").where("o_orderkey % 500 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("shot_id"), E("CASE WHEN o_orderkey % 1000 = 0 THEN 'source missing' ELSE 'labels do not validate' END").alias("problem"))
    c = D.table(spark, d, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("collection_id"), F.concat(F.lit("g"), "s_nationkey").alias("golfer_id"))
    return c, m, problems


@_R.add("c7_frozen_collections", f"WITH {_FROZEN} SELECT collection_id, refused, CASE WHEN len(refused) = 0 THEN sha256(doc) END AS sha256, CASE WHEN len(refused) = 0 THEN 'snapshots/' || collection_id || '-' || substr(sha256(doc), 1, 12) || '.json' END AS path, CASE WHEN len(refused) = 0 THEN n END AS shot_count FROM fz")
def frozen_collections(spark, d):
    return S.frozen(*_collections(spark, d), "ann", "2024").drop("snapshot")


@_R.add("c8_verified_snapshots", f"WITH {_FROZEN} SELECT collection_id, CASE WHEN len(refused) > 0 THEN 'no snapshot' WHEN CAST(substr(collection_id, 2) AS BIGINT) % 3 = 1 THEN 'altered since it was frozen' WHEN CAST(substr(collection_id, 2) AS BIGINT) % 3 = 2 AND EXISTS (SELECT 1 FROM me WHERE me.collection_id = fz.collection_id AND o_orderkey % 16 = 0) THEN 'other shots than the collection''s' END AS problem FROM fz")
def verified_snapshots(spark, d):
    c, m, problems = _collections(spark, d)
    number = F.substring("collection_id", 2, 9).cast("long")
    held = S.frozen(c, m, problems, "ann", "2024").withColumn("snapshot", F.when(number % 3 == 1, F.replace("snapshot", F.lit("ann"), F.lit("bob"))).otherwise(F.col("snapshot")))
    now = m.where((number % 3 != 2) | (F.substring("shot_id", 2, 20).cast("long") % 16 != 0))
    return S.verified(held, now)


_NEEDS = {"stance_width": "down", "knee_flexion": "dtl"}


@_R.add("c10_setup_readiness", """WITH st AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS face, o_orderkey % 5 <> 0 AS p1, o_orderkey % 3 = 0 AS heels, o_orderkey % 7 = 0 AS ankles, o_orderkey % 11 <> 0 AS wrists FROM orders)
, r AS (SELECT o_orderkey, 'stance_width' AS id, face AS seen, p1, CASE WHEN heels OR ankles THEN [] ELSE ['left_heel + right_heel', 'left_ankle + right_ankle'] END AS missing FROM st UNION ALL SELECT o_orderkey, 'shoulder_alignment', NOT face, p1, ['left_shoulder', 'right_shoulder'] FROM st
UNION ALL SELECT o_orderkey, 'hand_position', true, p1, CASE WHEN wrists THEN [] ELSE ['left_wrist', 'right_wrist'] END || CASE WHEN o_orderkey % 4 = 1 THEN [] ELSE ['left_hip + right_hip'] END FROM st)
SELECT o_orderkey AS shot_id, id, CASE WHEN NOT seen THEN 'not_this_view' WHEN NOT p1 THEN 'no_p1' WHEN len(missing) > 0 THEN 'missing_points' ELSE 'observable_2d' END AS status, CASE WHEN seen AND p1 THEN missing ELSE [] END AS missing FROM r""")
def setup_readiness(spark, d):
    some = lambda cond, *names: F.when(E(cond), F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
    points = F.concat(some("o_orderkey % 3 = 0", "left_heel", "right_heel"), some("o_orderkey % 7 = 0", "left_ankle", "right_ankle"), some("o_orderkey % 11 <> 0", "left_wrist", "right_wrist"), some("o_orderkey % 4 = 1", "left_hip", "right_hip"))
    s = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("shot_id"), F.lit("c1").alias("stream_id"), E("CASE WHEN o_orderkey % 2 = 0 THEN 'face_on' ELSE 'down_the_line' END").alias("view"), E("CASE WHEN o_orderkey % 5 <> 0 THEN 1 END").alias("p1"), points.alias("points"))
    return S.setup_readiness(s).where(F.col("id").isin("stance_width", "shoulder_alignment", "hand_position")).drop("stream_id")


@_R.add("snk2_report_errors", f"WITH {D.POSITIONS} SELECT 'v' || video_id AS path, p AS position, predicted AS predicted_frame, labelled AS ground_truth_frame, predicted - labelled AS error_frames, round((predicted - labelled) * 1000 / fps, 6) AS error_ms FROM pos WHERE video_id % 7 <> 3")
def report_errors(spark, d):
    """Documents of an evaluation written to a folder and read back."""
    pos = D.positions(spark, d).withColumn("path", F.concat(F.lit("v"), "video_id"))
    videos = pos.groupBy("path", "video_id", "fps").agg(F.lit(1)).select("path", (F.col("video_id") % 7 != 3).alias("success"), F.lit("no pose").alias("error_message"), "fps")
    off = F.col("predicted") - F.col("labelled")
    errors = pos.select("path", F.col("p").alias("position"), F.col("predicted").alias("predicted_frame"), F.col("labelled").alias("ground_truth_frame"), off.alias("error_frames"), (off * 1000 / F.col("fps")).alias("error_ms"))
    out = scratch_folder(spark, "report")
    S.report_documents(videos, errors).select("doc").write.text(out)
    return rounded(S.report_errors(spark.read.text(out).withColumnRenamed("value", "doc")))


@_R.add("snk6_annotations", f"""WITH {D.POSITIONS}, nw AS (SELECT CASE WHEN i = 0 THEN 'f' ELSE 'd' END || video_id AS path, p, CASE WHEN i = 0 THEN predicted ELSE predicted + 1 END AS frame, CASE WHEN i = 0 THEN 'face_on' ELSE 'dtl' END AS "view", 'p7-impact' AS convention, video_id, predicted, i FROM pos, (SELECT unnest([0, 1]) AS i) WHERE NOT (i = 1 AND predicted % 3 = 0) AND NOT (i = 0 AND video_id % 5 = 2))
SELECT path, p, frame, "view", convention FROM nw UNION ALL SELECT 'f' || o_orderkey, 'P1', 0, 'face_on', 'old' FROM orders WHERE 'f' || o_orderkey NOT IN (SELECT path FROM nw)""")
def annotations(spark, d):
    frames = F.map_from_entries(F.array_compact(F.array(F.when(E("video_id % 5 <> 2"), F.struct(F.lit("face_on").alias("k"), F.col("predicted").cast("int").alias("v"))), F.when(E("predicted % 3 <> 0"), F.struct(F.lit("dtl").alias("k"), (F.col("predicted") + 1).cast("int").alias("v"))))))
    g = D.positions(spark, d).groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct(frames.alias("frames"))))).alias("positions"))
    view = lambda k: F.struct(F.concat(F.lit(k), "video_id").alias("path"))
    docs = g.select(F.to_json(F.struct("positions", F.create_map(F.lit("face_on"), view("f"), F.lit("dtl"), view("d")).alias("views"))).alias("doc"))
    current = D.table(spark, d, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("path"), F.lit("P1").alias("p"), F.lit(0).alias("frame"), F.lit("face_on").alias("view"), F.lit("old").alias("convention"))
    return S.annotations_from_detections(docs, current, "p7-impact")


_TORSO = f"sqrt(power(({x(1)} + {x(2)} - {x(13)} - {x(14)}) / 2 * {{w}}, 2) + power(({y(1)} + {y(2)} - {y(13)} - {y(14)}) / 2 * {{h}}, 2))"


@_R.add("sc20_overlaid_points", f"""WITH {D.POSE}, f0 AS (SELECT * FROM p WHERE frame = 0), q AS (SELECT u.video_id AS pair_id, r.e AS re, ({x(13).replace('e[', 'u.e[')} + {x(14).replace('e[', 'u.e[')}) / 2 * 640 AS ux, ({y(13).replace('e[', 'u.e[')} + {y(14).replace('e[', 'u.e[')}) / 2 * 480 AS uy, {_TORSO.format(w=640, h=480).replace('e[', 'u.e[')} AS ut,
    ({x(13).replace('e[', 'r.e[')} + {x(14).replace('e[', 'r.e[')}) / 2 * 1920 AS rx, ({y(13).replace('e[', 'r.e[')} + {y(14).replace('e[', 'r.e[')}) / 2 * 1080 AS ry, {_TORSO.format(w=1920, h=1080).replace('e[', 'r.e[')} AS rt FROM f0 u JOIN f0 r ON r.video_id = u.video_id + 1)
, g AS (SELECT *, (ux - ut / rt * rx) / 640 AS l, (uy - ut / rt * ry) / 480 AS t, ut / rt AS s FROM q)
SELECT pair_id, round(l, 6) + 0 AS "left", round(t, 6) + 0 AS top, round(s * 1920 / 640, 6) AS width, round(l + CASE WHEN pair_id % 2 = 1 THEN 1 - {x(0).replace('e[', 're[')} ELSE {x(0).replace('e[', 're[')} END * s * 1920 / 640, 6) + 0 AS on_x, round(t + {y(0).replace('e[', 're[')} * s * 1080 / 480, 6) + 0 AS on_y FROM g""")
def overlaid_points(spark, d):
    lm = F.col("lm")

    def side(k, w, h, key):
        a, b, c, e = (P.at(lm, j) for j in (1, 2, 13, 14))
        tx, ty = (P.mid(a, b, "x") - P.mid(c, e, "x")) * w, (P.mid(a, b, "y") - P.mid(c, e, "y")) * h
        return D.pose(spark, d).where("frame = 0").select(key.alias("pair_id"), (P.mid(c, e, "x") * w).alias(f"{k}_x"), (P.mid(c, e, "y") * h).alias(f"{k}_y"), F.hypot(tx, ty).alias(f"{k}_torso"), F.lit(w).alias(f"{k}_width"), F.lit(h).alias(f"{k}_height"), P.at(lm, 0).alias(f"{k}_nose"))

    pairs = side("u", 640, 480, F.col("video_id")).join(side("r", 1920, 1080, F.col("video_id") - 1), "pair_id")
    o = S.overlaid(S.overlay(pairs).withColumns({"mirror": F.col("pair_id") % 2 == 1, "x": F.col("r_nose.x"), "y": F.col("r_nose.y")}))
    return rounded(o.select("pair_id", "left", "top", "width", "on_x", "on_y"))


@_R.add("so6_first_pairs", "WITH q AS (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderdate, n FROM q ORDER BY n DESC, o_custkey, o_orderdate LIMIT 20")
def first_pairs(spark, d):
    """A report of the twenty largest groups, in order."""
    return D.table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey", "o_orderdate").limit(20)
