"""Near-duplicates against all pairs of sets of words."""

import random

import numpy as np
import pytest

from motion_tables.llm.minhash_dedup import LANES, masks, near_duplicates, radius
from motion_tables.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import words
from tests.oracle import same


def shingles(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted(((doc, len(s), c := least.get(top(i)), doc == c) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    assert df.columns == ["rkey", "doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r)[1:] for r in df.collect()), key=str)


def copies(r, groups, most):
    """Groups of texts of which each changes some words of the first or of the one before: similarities on both sides of the threshold, chains and stars."""
    rows = []
    for g in range(groups):
        base = words(r.randrange(60, 300), g).split()
        last = base
        for _ in range(r.randrange(2, most)):
            own = list(last if r.random() < 0.5 else base)
            for _ in range(r.randrange(0, max(2, len(own) // 18))):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(w.upper() if r.random() < 0.1 else w for w in own))
            last = own
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"leaf": 8, "block": 4, "heavy": 2000}, {"errors": 0}, {"errors": 2, "block": 16}])
def test_copies_near_the_threshold(spark, how):
    rows = copies(random.Random(7), 25, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    assert len({r[2] for r in want}) > 30
    assert result(near_duplicates(df, **how)) == want


def test_one_large_group(spark):
    r = random.Random(2)
    base = words(120, 9).split()
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(r.randrange(1, 6)):
            own[r.randrange(len(own))] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(df, leaf=200, block=100)) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    same(spark, f"/root/testdata/{sf}", QUERIES["op13_minhash_dedup"], ORACLE_SQL["op13_minhash_dedup"])


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_signatures_within_the_radius_share_a_key(errors):
    most = radius(0.85)
    keys = masks(most, errors)
    r = np.random.default_rng(4)
    worst = [np.arange(LANES) % (most // (errors + 1) + 1) * LANES + np.arange(LANES)]  # the chunks' first lanes go first
    for order in [np.argsort(w) for w in worst] + [r.permutation(LANES) for _ in range(300)]:
        differ = np.zeros(LANES, bool)
        differ[order[:most]] = True
        assert any(not differ[own].any() for own in keys)


def test_edges(spark, edges, none):
    rows = [tuple(r) for r in edges.select("doc_id", "text").collect()]
    assert result(near_duplicates(edges)) == brute_with_nulls(rows)
    assert near_duplicates(none).count() == 0
    alone = spark.createDataFrame([(None, "a b c"), (None, "A  b\tC"), (4, "d e"), (3, "d E"), (9, "d e f")], "doc_id long, text string")
    assert result(near_duplicates(alone)) == sorted([(None, 1, None, True), (None, 1, None, True), (4, 1, 3, False), (3, 1, 3, True), (9, 1, 9, True)], key=str)


def brute_with_nulls(rows):
    return sorted(((d, n, d if not n else c, d == (d if not n else c)) for d, n, c, _ in brute(rows)), key=str)
