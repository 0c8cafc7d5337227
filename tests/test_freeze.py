"""What stands against a freeze, and what a shot is frozen with."""

import hashlib
import json

from motion_tables.operators import snapshots as S


def test_problems_come_from_the_checks(spark):
    streams = spark.createDataFrame([("a", "c1", "s1", "h1", 10, 100, 50), ("a", "c2", "s2", "h2", 10, 100, 50), ("b", "c1", "s3", "h3", 10, 100, 50), ("c", "c1", "s4", "h4", 10, 100, 50)], "shot_id string, stream_id string, source_id string, sha256 string, frame_count int, width int, height int")
    states = spark.createDataFrame([("s1", "ok"), ("s2", "relocated"), ("s3", "changed")], "id string, status string")
    point = {"x": 5.0, "y": 5.0, "visible": True, "origin": "manual"}

    def doc(shot, **streams):
        return json.dumps({"shot_id": shot, "streams": {k: {"source_id": s, "source_sha256": h, "positions": {}, "frames": {str(f): {"image_sha1": d, "points": {"head": {**point, "x": x}}, "unavailable": {}, "review": {"status": "unreviewed"}} for f, d, x in frames}} for k, (s, h, frames) in streams.items()}})

    docs = [doc("a", c1=("s1", "h1", [(1, "i1", 5.0), (2, "other", 5.0), (3, "i3", 500.0)]), c2=("s2", "h2", [(9, "i9", 5.0)])), doc("b", c1=("s3", "h3", [(1, "other", 5.0)]))]
    images = spark.createDataFrame([("s1", f, f"i{f}") for f in range(10)], "source_id string, frame int, digest string")
    got = S.freeze_problems(streams, states, spark.createDataFrame([(x,) for x in docs], "doc string"), images, ["head"])
    assert {tuple(r) for r in got.collect()} == {
        ("a", "a c1 2: another image"), ("a", "a c1 3 head: outside the image"), ("a", "a c2 9: frame not in the index"), ("b", "source s3 is changed"), ("c", "source s4 is missing"),
    }


def test_a_shot_is_frozen_with_its_sources_and_labels(spark):
    shots = spark.createDataFrame([("a", '{"shot_id":"a","club":{"name":"x","length_in":null}}'), ("b", '{"shot_id":"b"}')], "shot_id string, record string")
    streams = spark.createDataFrame([("a", "s2"), ("a", "s1"), ("a", "s2")], "shot_id string, source_id string")
    sources = spark.createDataFrame([("s1", '{"z":1,"a":2.50}'), ("s2", '{"source_id":"s2"}')], "source_id string, record string")
    labels = spark.createDataFrame([("a", '{"streams":{},"shot_id":"a"}')], "shot_id string, doc string")
    got = {r.shot_id: r.shot for r in S.shot_texts(shots, streams, sources, labels).collect()}
    own = '{"shot_id":"a","streams":{}}'
    assert got["a"] == '{"annotations":' + own + ',"annotations_sha256":"' + hashlib.sha256(own.encode()).hexdigest() + '","shot":{"club":{"length_in":null,"name":"x"},"shot_id":"a"},"sources":[{"a":2.5,"z":1},{"source_id":"s2"}]}'
    assert got["b"] == '{"annotations":null,"annotations_sha256":null,"shot":{"shot_id":"b"},"sources":[]}'
