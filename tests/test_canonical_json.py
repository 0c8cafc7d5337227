"""Canonical JSON against Python's own writer, keys sorted."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from motion_tables.functions.json import canonical_text
from motion_tables.operators.snapshots import canonical_sha256


def value(r, depth):
    kind = r.randrange(9 if depth else 7)
    if kind == 0:
        return r.choice([True, False, None])
    if kind == 1:
        return r.choice([0, -1, 7, 10**25, -(2**63), r.randrange(-(10**6), 10**6)])
    if kind in (2, 3):
        return r.choice([0.0, -0.0, 1.0, 1e16, 123456789012345680.0, 1e15, 9999999.0, 1e7, 0.001, 0.0001, 0.00012, 1e-5, 1.5e-7, -2.5e22, 1e100, r.uniform(-1, 1), r.uniform(-1e9, 1e9), round(r.uniform(0, 2000), 3)])
    if kind < 7:
        return "".join(r.choice('ab"\\/\n\t\r\b\f\x00\x1f\x7fé ￮\U0001f600 {}[]:,1.0') for _ in range(r.randrange(0, 8)))
    if kind == 7:
        return [value(r, depth - 1) for _ in range(r.randrange(0, 4))]
    return {value(r, 0) if r.random() < 0.3 else f"k{r.randrange(20)}" + r.choice(["", "é", "￮", "\U0001f600", "A"]): value(r, depth - 1) for _ in range(r.randrange(0, 5))}


def shuffled(x, r):
    if isinstance(x, dict):
        items = list(x.items())
        r.shuffle(items)
        return {k: shuffled(v, r) for k, v in items}
    return [shuffled(v, r) for v in x] if isinstance(x, list) else x


def test_random_documents(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        doc = value(r, 3)
        doc = json.loads(json.dumps({"doc": doc, "z": 1, "a": [doc]}))
        want = json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        rows += [(i, json.dumps(shuffled(doc, r), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2])), want) for _ in range(2)]
    df = spark.createDataFrame(rows, "i int, doc string, want string")
    bad = df.select("i", "doc", "want", canonical_text(F.col("doc")).alias("got")).where("not (got <=> want)").take(3)
    assert not bad, bad


def test_spellings_hash_alike_and_other_texts_are_null(spark):
    texts = ['{"b":[1.50,{"y":2,"x":"\\u00e9"}],"a":-0}', ' { "a" : 0 , "b" : [ 15e-1 , { "x" : "é" , "y" : 2 } ] } ', "{", '{"a":1,"a":2}', None, "", '"only a string"', "[1, 1.0]", "1e400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, doc string")
    got = {r.i: (r.text, r.sha) for r in df.select("i", canonical_text(F.col("doc")).alias("text"), canonical_sha256(F.col("doc"), text=True).alias("sha")).collect()}
    want = '{"a":0,"b":[1.5,{"x":"é","y":2}]}'
    assert got[0] == got[1] == (want, hashlib.sha256(want.encode()).hexdigest())
    assert [got[i][0] for i in range(2, 9)] == [None, None, None, None, '"only a string"', "[1,1.0]", "Infinity"]


def test_structs_hash_alike_whatever_the_order_of_their_fields(spark):
    row = spark.range(1).select(canonical_sha256(F.struct(F.lit(1).alias("b"), F.struct(F.lit("x").alias("d"), F.lit(None).cast("int").alias("c")).alias("a"))).alias("p"), canonical_sha256(F.struct(F.struct(F.lit(None).cast("int").alias("c"), F.lit("x").alias("d")).alias("a"), F.lit(1).alias("b"))).alias("q")).first()
    assert row.p == row.q == hashlib.sha256(b'{"a":{"c":null,"d":"x"},"b":1}').hexdigest()
