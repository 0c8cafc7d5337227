import random
import re
from collections import Counter

from motion_tables.llm import decontamination as X

from .conftest import words

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text, items):
    """Best similarity of each item over all windows of its size."""
    out, w = {}, WORD.findall(text or "")
    for i, item in items:
        v = WORD.findall(item or "")
        k = min(5, len(v))
        for p in range(len(w) - len(v) + 1 if v else 0):
            a, b = (Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1)) for x in (w[p : p + len(v)], v))
            s = sum((a & b).values()) / sum((a | b).values())
            if s >= 0.8:
                out[i] = max(out.get(i, 0), s)
    return {k: round(v, 9) for k, v in out.items()}


def test_agrees_with_all_windows(spark):
    r = random.Random(4)
    items = [(i, words(r.choice([3, 5, 6, 15, 30, 60]), 100 + i)) for i in range(25)] + [(90, None), (91, ""), (None, "no id here at all")]
    docs = []
    for i in range(60):
        w = words(r.choice([4, 40, 200]), i).split()
        for _ in range(r.randrange(3)):
            v = items[r.randrange(25)][1].split()
            for _ in range(r.randrange(3)):
                v[r.randrange(len(v))] = "edit"
            p = r.randrange(len(w) + 1)
            w[p:p] = v
        docs.append((i, " ".join(w)))
    got = {r.doc_id: {m.item_id: round(m.similarity, 9) for m in r.matches} for r in X.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: brute(t, [x for x in items if x[0] is not None]) for i, t in docs}
    assert got == want and sum(map(len, want.values())) > 10


def matches(text, items):
    index = X.Index([i for i, _ in items], [t for _, t in items], 5)
    data, at = X.utf8(X.pa.array([text]))
    starts, ends, first = X.spans(data, at)
    h, _ = X.windows(X.hashes(data, starts, ends), first, 5)
    return {i: (round(s, 9), p, n) for i, (s, p, n) in index.search(h, index.hits(h, 5), 5, 0.8).items()}


def test_items_at_every_place_of_a_long_run_of_hits():
    items = [(i, words(60, 100 + i)) for i in range(300)]
    for gap in ("", " between the items"):
        got = matches(gap.join(" " + t for _, t in items), items)  # 16800 hits
        assert {*got} == set(range(300)) and {x[0] for x in got.values()} == {1.0}
        assert [got[i][1] for i in range(300)] == [i * (60 + len(gap.split())) for i in range(300)]


def test_shortened_items_are_found_as_whole_texts():
    items = [(i, words(60, 100 + i)) for i in range(20)]
    for i, t in items:
        assert matches(" ".join(t.split()[:-2]), items) == {i: (round(54 / 56, 9), 0, 58)}
        assert matches(" ".join(t.split()[1:]), items) == {i: (round(55 / 56, 9), 0, 59)}
        assert matches(" ".join(t.split()[:40]), items) == {}


def test_passes_over_many_items_agree(spark):
    items = spark.createDataFrame([(i, words(20, i)) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, words(30, 1000 + i) + " " + words(20, i)) for i in range(30)], "doc_id long, text string")
    one, many = ([[m.item_id for m in r.matches] for r in X.find_items(docs, items, most_words=n).orderBy("doc_id").collect()] for n in (10**6, 60))
    assert one == many == [[i] for i in range(30)]


def test_edges(edges, none, spark):
    items = spark.createDataFrame([(1, words(60, 2)), (2, "one two"), (3, None)], "item_id long, text string")
    found = X.find_items(edges, items)
    assert {*found.columns} == {*edges.columns}
    rows = [(r.doc_id, [m.item_id for m in r.matches]) for r in found.collect()]
    assert len(rows) == edges.count()
    assert [m for i, m in rows if i in (6, 7)] == [[1], [1]] and [m for i, m in rows if i in (9, 10)] == [[2], [2]] and sorted(m for i, m in rows if i == 5) == [[], [1], [1]]
    kept = X.decontaminated(edges, items)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 5, 8, 11, 12}
    assert X.find_items(none, items).count() == 0 and X.find_items(edges, items.limit(0)).where("size(matches) > 0").count() == 0


def test_index_holds_every_fingerprint_within_the_radius():
    import numpy as np

    r = np.random.RandomState(3)
    items = r.randint(0, 2, (60, 64))
    windows = np.concatenate([items[r.randint(0, 60, 400)] ^ (r.rand(400, 64).argsort(axis=1) < r.randint(0, 34, (400, 1))), r.randint(0, 2, (100, 64))])
    far = (windows[:, None, :] != items[None, :, :]).sum(axis=2)
    index = X.Index([1], ["a b c d e f g"], 5)
    x, y = index._near(X.simhash(windows * 2 - 1), X.simhash(items * 2 - 1))
    assert {*zip(x.tolist(), y.tolist())} == {*zip(*(i.tolist() for i in np.nonzero(far <= X.RADIUS)))} and len(x) > 200


def test_ids_of_other_types_and_low_thresholds(spark):
    from .conftest import words

    item, other = words(40, 71), words(40, 72)
    mixed = " ".join(item.split()[:14] + other.split()[:26])
    docs = spark.createDataFrame([(1, f"{words(30, 1)} {item} {words(30, 2)}"), (2, f"{words(30, 3)} {mixed} {words(30, 4)}"), (3, words(100, 5))], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", item), (None, other), ("q-2", words(25, 9))], "item_id string, text string")
    got = {r.doc_id: [(m.item_id, round(m.similarity, 2)) for m in r.matches] for r in X.find_items(docs, items).collect()}
    assert got == {1: [("q-1", 1.0)], 2: [], 3: []}
    low = {r.doc_id: [m.item_id for m in r.matches] for r in X.find_items(docs, items, threshold=0.15).collect()}
    assert low[1] == ["q-1"] and low[3] == []
