"""The pipeline against plain Python over its own stages' inputs."""

import re
from collections import defaultdict

import corpus_pipeline as P
import pandas as pd

from motion_tables.llm import quality_classifier as C
from motion_tables.llm.tables import stored

from .test_decontamination import brute
from .test_jaccard_join import shingle_set

FOLDER = "/root/testdata/sf0.001"


def lines_left(rows):
    norm = lambda x: x.strip(" \t\x0b\x0c\r").lower()
    sites, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        for i, x in enumerate(r["text"].split("\n")):
            if len(norm(x)) >= 20:
                sites[norm(x)].add(r["source"])
                first.setdefault(norm(x), (r["doc_id"], i))
    out = {}
    for r in rows:
        keep = [x for i, x in enumerate(r["text"].split("\n")) if len(sites.get(norm(x), ())) < 6 or first[norm(x)] == (r["doc_id"], i)]
        if len(keep) == r["text"].count("\n") + 1 or re.search("[^\x20\x09-\x0d]", "\n".join(keep)):
            out[r["doc_id"]] = "\n".join(keep)
    return out


def one_of_each(rows):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in rows}
    inverted = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            inverted[s].append(i)
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in {j for s in sets[i] for j in inverted[s] if j < i}:
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def test_each_stage_on_its_own_input(spark):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before, after = docs.columns, [], []
    for name, stage in P.STAGES:
        before.append([r.asDict() for r in docs.collect()])
        docs = stored(stage(spark, docs, FOLDER), name)
        after.append([r.asDict() for r in docs.collect()])
        assert docs.columns[: len(columns)] == columns
    ids = lambda rows: {r["doc_id"] for r in rows}
    model = C.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    import pyarrow as pa

    scores = C.scores(pa.array([r["text"] for r in before[0]]), model)
    assert ids(after[0]) == {r["doc_id"] for r, s in zip(before[0], scores) if s >= 0.5}
    assert {r["doc_id"]: r["text"] for r in after[1]} == lines_left(before[1]) and all(r["n_chars"] == len(r["text"]) for r in after[1])
    assert ids(after[2]) == one_of_each(before[2]) and len(after[2]) < len(before[2])
    items = list(pd.read_parquet(f"{FOLDER}/benchmark.parquet").itertuples(index=False, name=None))
    assert ids(after[3]) == {r["doc_id"] for r in before[3] if not brute(r["text"], items)}
    assert ids(after[4]) == ids(before[4]) and all(0 <= r["taken"] <= 3 * r["size"] for r in after[4])
    labels = pd.read_parquet(f"{FOLDER}/labels.parquet").set_index("doc_id")["quality"]
    good = [i for i in ids(before[0]) if labels.get(i) == 1]
    assert sum(i in ids(after[0]) for i in good) >= 0.97 * len(good)


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, FOLDER)
    assert {"doc_id", "text", "taken", "target"} <= {*out.columns} and out.count() > 50


def test_stages_take_edges_and_empty_tables(spark, edges, none):
    from pyspark.sql import functions as F

    plain = edges.select("doc_id", "text", "lang", "source", "n_chars", F.col("score"), F.col("matches"))
    for name, stage in P.STAGES:
        for docs in (plain, plain.limit(0)):
            out = stage(spark, docs, FOLDER)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            out.count()
