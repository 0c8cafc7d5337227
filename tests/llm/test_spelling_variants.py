"""Spelling variants against every edit of every word tried in a plain dictionary."""

import random
import re
import zlib
from collections import Counter

import pytest

from motion_tables.llm.queries import ORACLE_SQL, QUERIES
from motion_tables.llm.spelling_variants import spelling_forms, word_counts
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


def counted(rows, damaged_in, least=7):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damaged_in and h % damaged_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return total


def forms(words, ratio=10):
    letters = sorted(set("".join(words)))
    near = {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [e for e in edits - {w} if e in words]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = {w: n for w, n in counted(rows, 31).items() if n >= 2}
    assert result(QUERIES["op12_spelling_variants"](spark, FOLDER)) == forms(want)


def test_query_against_sql(spark):
    same(spark, FOLDER, QUERIES["op12_spelling_variants"], ORACLE_SQL["op12_spelling_variants"])


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_dense_words_over_many_ranges(spark, parts):
    """Every string of two letters up to a length: prefixes and suffixes span the ranges, runs of equal letters are everywhere."""
    r = random.Random(3)
    words = {"".join(r.choice("abé\U0001f600") for _ in range(r.randrange(0, 7))): 0 for _ in range(900)}
    words = {w: 10 ** r.randrange(5) + r.randrange(3) for w in words}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == forms(words)


def test_chains_of_forms(spark):
    words = {"a" * (7 + i): 10**i for i in range(12)} | {"b" * 7: 5, "b" * 8: 49, "b" * 9: 490}
    got = result(spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == forms(words) and {r[2] for r in got if r[0][0] == "a"} == {"a" * 18}


def test_edges(spark, edges, none):
    counts = word_counts(edges, damaged_in=31)
    rows = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert {r.word: r.n for r in counts.collect()} == counted(rows, 31)
    assert result(spelling_forms(counts.where("length(word) < 100"))) == forms({w: n for w, n in counted(rows, 31).items() if len(w) < 100})
    assert word_counts(none).count() == 0 and spelling_forms(word_counts(none)).count() == 0
    long = "x" * 100_000
    words = [(long, 3), (long[:-1] + "y", 40), (long[1:], 1), (None, 2), ("gone", None), ("", 1), ("a", 10)]
    df = spark.createDataFrame([(w, n, "c", 1, 2) for w, n in words], "word string, n int, form string, wid int, grp int")
    assert {r[0][-3:]: (r[1] and r[1][-3:], r[4]) for r in result(spelling_forms(df)) if r[0] != long} == {"xxy": (None, 2), "xxx": ("xxy", 2), "": ("a", 1), "a": (None, 1)}
    with pytest.raises(ValueError):
        spelling_forms(df, ratio=1)
