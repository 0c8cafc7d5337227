"""Label edits by hand: what each edit does to those before it."""

from motion_tables.operators import label_edits as L

EDIT = "stream_id string, seq long, frame long, op string, name string, x double, y double, visible boolean, `by` string, origin string, model string, confidence double, reason string, status string, notes string, image string"


def edit(seq, op, name=None, frame=3, x=1.0, y=2.0, by="ann", origin="manual", model=None, reason=None, status=None, image="i", stream="s"):
    return (stream, seq, frame, op, name, x, y, True, by, origin, model, None, reason, status, None, image)


def run(spark, edits):
    streams = spark.createDataFrame([("s", 100, 50, 10, True), ("t", 100, 50, 10, False)], "stream_id string, width int, height int, frame_count int, same_bytes boolean")
    checked = L.checked(spark.createDataFrame(edits, EDIT), streams, ["head", "grip"])
    frames = L.folded(checked).cache()
    points = {(r.frame, r.name): r for r in L.label_points(frames).collect()}
    return points, {r.seq: r.why for r in L.label_refusals(frames, checked).collect()}, {r.position: r for r in L.label_positions(checked).collect()}


def test_moving_a_proposal_corrects_it_until_another_origin(spark):
    points, refused, _ = run(spark, [edit(1, "point", "head", origin="model_proposed", model="m1"), edit(2, "point", "head", x=4.0), edit(3, "point", "head", x=5.0), edit(4, "point", "grip"), edit(5, "point", "grip", x=6.0)])
    assert not refused
    assert (points[3, "head"].origin, points[3, "head"].model, points[3, "head"].x) == ("corrected", "m1", 5.0)
    assert points[3, "grip"].origin == "manual"
    points, *_ = run(spark, [edit(1, "point", "head", origin="model_proposed", model="m1"), edit(2, "unavailable", "head", reason="occluded"), edit(3, "point", "head")])
    assert points[3, "head"].origin == "manual" and points[3, "head"].reason is None


def test_a_change_undoes_the_review_and_an_empty_frame_is_gone(spark):
    points, refused, _ = run(spark, [edit(1, "review", status="reviewed"), edit(2, "point", "head"), edit(3, "review", status="reviewed"), edit(4, "review", status="reviewed", by=" "), edit(5, "review", status="seen")])
    assert refused == {1: "no labels to review", 4: "review without a reviewer", 5: "unknown status"}
    assert points[3, "head"].review == "reviewed" and points[3, "head"].review_by == "ann"
    points, refused, _ = run(spark, [edit(1, "point", "head"), edit(2, "review", status="reviewed"), edit(3, "remove", "grip"), edit(4, "point", "grip", image="other"), edit(5, "remove", "head"), edit(6, "remove", "head"), edit(7, "point", "grip", image="other"), edit(8, "unavailable", "head", reason="motion_blur", image="i")])
    assert refused == {4: "labels of another image", 8: "labels of another image"}
    assert set(points) == {(3, "grip")} and points[3, "grip"].image == "other" and points[3, "grip"].review == "unreviewed"


def test_refusals_and_positions(spark):
    _, refused, positions = run(spark, [
        edit(1, "point", "nose"), edit(2, "point", "head", x=101.0), edit(3, "point", "head", frame=10), edit(4, "point", "head", stream="t"), edit(5, "point", "head", stream="u"), edit(6, "unavailable", "head", reason="lost"), edit(7, "paint", "head"), edit(8, None),
        edit(9, "position", "P1"), edit(10, "position", "P1", frame=5), edit(11, "position", "P11"), edit(12, "position", "P2", origin="guess"), edit(13, "position", "P3"), edit(14, "clear", "P3"), edit(15, "position", "P1", frame=12), edit(16, "point", "head", x=float("nan")), edit(17, "point", "head", x=None),
    ])
    assert refused == {1: "unknown point", 2: "outside the image", 3: "no such frame", 4: "index of other bytes", 5: "unknown stream", 6: "unknown reason", 7: "unknown edit", 8: "unknown edit", 11: "unknown position", 12: "unknown origin", 15: "no such frame", 16: "outside the image", 17: "outside the image"}
    assert set(positions) == {"P1"} and positions["P1"].frame == 5


def test_a_frame_is_never_gathered(spark, capsys):
    """A frame of very many edits is read in order, not made one array: its plan collects nothing."""
    n = 20_000
    edits = spark.range(n).selectExpr("'s' AS stream_id", "id AS seq", "3L AS frame", "CASE WHEN id % 5 = 4 THEN 'review' ELSE 'point' END AS op", "CASE WHEN id % 2 = 0 THEN 'head' ELSE 'grip' END AS name", "CAST(id % 7 AS DOUBLE) AS x", "2D AS y", "true AS visible",
        "'ann' AS by", "'manual' AS origin", "CAST(NULL AS STRING) AS model", "CAST(NULL AS DOUBLE) AS confidence", "CAST(NULL AS STRING) AS reason", "'reviewed' AS status", "CAST(NULL AS STRING) AS notes", "CASE WHEN id % 3 = 1 THEN 'other' ELSE 'i' END AS image")
    streams = spark.createDataFrame([("s", 100, 50, 10, True)], "stream_id string, width int, height int, frame_count int, same_bytes boolean")
    frames = L.folded(L.checked(edits, streams, ["head", "grip"]))
    frames.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert frames.where("seq is not null").count() == n and frames.where("why = 'labels of another image'").count() == sum(i % 5 != 4 and i % 3 == 1 for i in range(n))
    assert {(r.name, r.x, r.review) for r in L.label_points(frames).collect()} == {("head", float(19_998 % 7), "reviewed"), ("grip", float(19_997 % 7), "reviewed")}
