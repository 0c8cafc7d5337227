import random

from motion_tables.llm import license_scan as L

from .conftest import words


def found(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[(m.license_id, round(m.coverage, 3), m.first_word, m.words) for m in r.licenses] for r in L.scan_licenses(df, **how).orderBy("doc_id").collect()]


def test_patience_aligns_unique_words_first():
    a, b = list("xabcdyef"), list("abqcdzef")
    pairs = L.patience(a, b)
    assert [a[i] for i, _ in pairs] == list("abcdef") and all(a[i] == b[j] for i, j in pairs)
    assert L.patience([], list("a")) == [] and L.patience(list("aab"), list("aab")) == [(0, 0), (1, 1), (2, 2)]


def test_increasing_run_is_a_longest_one():
    r = random.Random(0)
    for _ in range(50):
        ys = r.sample(range(20), r.randrange(1, 12))
        best = [1] * len(ys)
        for i in range(len(ys)):
            best[i] = 1 + max((best[j] for j in range(i) if ys[j] < ys[i]), default=0)
        run = L.increasing(list(enumerate(ys)))
        assert len(run) == max(best) and run == sorted(run, key=lambda p: p[1])


def test_every_template_is_found_where_it_stands(spark):
    names = list(L.TEMPLATES)
    got = found(spark, [words(30, i) + " " + L.TEMPLATES[n] + " " + words(30, i + 99) for i, n in enumerate(names)])
    for n, g in zip(names, got):
        assert [(n, 1.0, 30)] == [m[:3] for m in g], n


def test_edited_and_repeated_and_absent(spark):
    mit = L.TEMPLATES["MIT"].split()
    edited = " ".join(w for i, w in enumerate(mit) if i % 10)
    notice = L.TEMPLATES["MIT-notice"]
    got = found(spark, [edited, f"{notice} {words(50, 1)} {notice.upper()}###", words(300, 2), "license license license of the the", None, ""])
    assert [m[0] for m in got[0]] == ["MIT"] and 0.8 <= got[0][0][1] < 1
    assert [m[:3] for m in got[1]] == [("MIT-notice", 1.0, 0), ("MIT-notice", 1.0, 55)]
    assert got[2:] == [[], [], [], []]


def test_copies_side_by_side(spark):
    notice, mit = L.TEMPLATES["MIT-notice"], L.TEMPLATES["MIT"]
    one, two = "edit " + mit.split(" ", 1)[1], mit.rsplit(" ", 1)[0] + " edit"
    got = found(spark, [f"{notice} {notice}", f"{notice} " * 5, f"{one} {two}", f"{mit} {mit} {mit}", f"{two} {one}"])
    size = len(L.tokens(L.pa.array([mit]))[0])
    assert [m[2] for m in got[0]] == [0, 5] and [m[2] for m in got[1]] == [0, 5, 10, 15, 20]
    assert [m[::2] for m in got[2]] == [("MIT", 1), ("MIT", size)] and [m[2] for m in got[3]] == [0, size, 2 * size]
    assert [m[::2] for m in got[4]] == [("MIT", 0), ("MIT", size + 1)]


def test_neighbouring_licenses_are_not_taken_for_it(spark):
    got = found(spark, ["Released under the BSD License.", "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC 3.0."])
    assert got == [[]] * 6


def test_scattered_words_are_no_license(spark):
    spread = " ".join(w + " " + words(40, i) for i, w in enumerate(L.TEMPLATES["GPL-3.0-notice"].split()))
    assert found(spark, [spread]) == [[]]


def test_edges(edges, none):
    out = L.scan_licenses(edges)
    assert out.count() == edges.count() and {*out.columns} == {*edges.columns}
    assert L.scan_licenses(none).count() == 0 and L.scan_licenses(edges, templates={"empty": ""}).where("size(licenses) > 0").count() == 0


def test_random_mixtures_give_every_copy(spark):
    """Copies of templates side by side, apart and edited, among other words: each planted copy is found once, where it stands."""
    import random

    r = random.Random(8)
    names = ["MIT-notice", "Apache-2.0-notice", "CC-BY-4.0-notice", "BSD-3-Clause-notice", "MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "GPL-3.0-header", "GPL-2.0-header", "AGPL-3.0-header"]
    rows, planted = [], {}
    for d in range(60):
        words, want = [], []
        for _ in range(r.randrange(1, 6)):
            words += [f"f{r.randrange(10**6)}" for _ in range(r.choice([0, 0, 3, 40]))]
            name = r.choice(names)
            copy = L.TEMPLATES[name].split()
            if len(copy) > 60:  # one word in twenty is another
                for k in range(len(copy)):
                    if r.random() < 0.05 and copy[k].lower() not in ("neither", "the", "name"):
                        copy[k] = f"e{r.randrange(10**6)}"
            want.append(name)
            words += copy
        rows.append((d, " ".join(words)))
        planted[d] = want
    got = {x.doc_id: [f.license_id for f in x.licenses] for x in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == planted


def test_each_text_is_its_own_license(spark):
    rows = [(i, text) for i, text in enumerate(L.TEMPLATES.values())]
    got = {x.doc_id: [(f.license_id, f.coverage) for f in x.licenses] for x in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: [(n, 1.0)] for i, n in enumerate(L.TEMPLATES)}


def test_many_notices_in_one_text_are_found_in_little_time():
    import time

    import pyarrow as pa

    n, scanner = 20_000, L.Scanner(L.TEMPLATES, 0.8, 1.3, L.NAMES)
    began = time.time()
    found = scanner.scan(*L.tokens(pa.array(["Released under the MIT License. " * n], pa.string())))[0]
    assert len(found) == n and time.time() - began < 30
