import random
import re

from motion_tables.llm import jaccard_join as J

from .conftest import words

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    """class and links of each row, all pairs compared."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
                if sets[i] != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return sorted(((r[0], ids.get(root(i)) if sets[i] else r[0], len(links[i])) for i, r in enumerate(rows)), key=str)


def got(df, **how):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in J.jaccard_join(df, **how).collect()), key=str)


def test_edges_agree_with_all_pairs(edges):
    assert got(edges) == brute([(r.doc_id, r.text) for r in edges.collect()])


def test_empty_table(none):
    assert got(none) == []


def test_near_copies_and_split_buckets(spark):
    r = random.Random(0)
    rows, i = [], 0
    for g in range(12):
        base = words(r.choice([30, 120, 300]), g).split()
        for _ in range(r.choice([1, 3, 40])):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            rows.append((i, " ".join(w + ["common boilerplate line of eight words stands here"] * (i % 2))))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, leaf=4, block=8) == brute(rows)


def test_sf_documents_agree_with_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_first_of_groups_keeps_columns_and_one_row_a_group(edges):
    kept = J.first_of_groups(edges)
    assert kept.columns == edges.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len([r for r in rows if r[0] in (5, 6, 7)]) == 2 and (9, "one two") in rows and (10, "one two") not in rows
    assert len([r for r in rows if not (r[1] or "").strip()]) == 4


def test_runs_reach_the_recall():
    assert J.runs_for(0.8, 2.0, 0.999) >= 4 and J.runs_for(0.8, 2.0, 0.9) < J.runs_for(0.8, 2.0, 0.9999)


def test_recall_at_the_threshold_with_leaves_that_split(spark):
    """400 pairs of similarity 0.80 to 0.85 among texts that share long passages, so that paths are large; leaves of 16 split at every level."""
    r = random.Random(5)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for g in range(400):
        own = [f"g{g}x{k}" for k in range(160)]
        a = own[:80] + passage + own[80:]
        while True:  # words changed until the similarity is just over the threshold
            b = list(a)
            for _ in range(r.choice([3, 4])):
                b[r.choice([*range(80), *range(120, 200)])] = f"n{r.randrange(10**9)}"
            x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
            if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                break
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {d: c for d, c, n in got(df, leaf=16) if n}
    recall = sum(found.get(2 * g + 1) == 2 * g for g in range(400)) / 400
    assert recall >= 0.99, recall
    assert all(c // 2 == d // 2 for d, c in found.items())
