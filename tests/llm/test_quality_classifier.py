import zlib

import pandas as pd
import pyarrow as pa
import numpy as np

from motion_tables.llm import quality_classifier as C
from motion_tables.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op7_quality_classifier"](spark, FOLDER).toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]
    m = got.merge(pd.read_parquet(f"{FOLDER}/labels.parquet"), on="doc_id")
    m = m[m["held_out"]]
    assert (m["predicted"] == m["quality"]).mean() > 0.95 and ((m["score"] >= 0) & (m["score"] <= 1)).all()


def test_fold_learns_nothing_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    a = C.fit(docs, labels, epochs=2)
    b = C.fit(docs, labels.where(C.fold() != 1), epochs=2)
    assert all(np.allclose(x, y) for x, y in zip(a.layers, b.layers)) and np.allclose(a.vectors, b.vectors) and a.temperature == b.temperature


def test_pooling_agrees_with_a_loop():
    texts = ["The cat!! sat sat ### 12", "", None, "ÀB c"]
    vectors = np.random.RandomState(0).normal(size=(C.FORMS + C.SHAPES, C.WIDTH)).astype(np.float32)
    column = pa.array(texts)
    form, shape, at = C.types(column)
    got = C.pooled(column, vectors)
    for i in range(len(texts)):
        f, s = form[at[i] : at[i + 1]], shape[at[i] : at[i + 1]]
        want = np.concatenate([vectors[f].mean(axis=0), vectors[C.FORMS + s].mean(axis=0)]) if len(f) else np.zeros(2 * C.WIDTH)
        assert np.allclose(got[i, :-1], want, atol=1e-6) and np.isclose(got[i, -1], np.log1p(len(f)))
    assert form[2] == form[3] and shape[2] != shape[3]  # the repeated word has its own shape


def test_calibration_softens_overconfident_scores():
    y = np.array([1, 0] * 50)
    z = np.where(y > 0, 8.0, -8.0)
    z[:20] *= -1
    assert C.calibrated(z, y) > 2 and C.calibrated(np.zeros(0), np.zeros(0)) == 1.0


def test_edges(edges, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (5, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = C.fit(edges, labels, epochs=2)
    out = C.score(edges, model)
    rows = out.collect()
    assert {*out.columns} == {*edges.columns} and len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert C.score(none, model).count() == 0
    for few, flat in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        assert {r.score for r in C.score(edges, C.fit(edges, few)).collect()} == {flat}
    assert C.accepted(edges, labels, epochs=2).columns == edges.columns
