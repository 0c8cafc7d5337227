from motion_tables.llm import quality_rules as Q
from motion_tables.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same
from .conftest import words


def test_same_as_sql(spark):
    for folder in ("sf0.001", "sf0.01"):
        same(spark, f"/root/testdata/{folder}", QUERIES["op9_quality_rules"], ORACLE_SQL["op9_quality_rules"])


def test_frequent_lines_deplete(spark):
    line = words(12, 1)
    rows = [(i, f"{line}\n{words(30 if i % 2 else 9, 50 + i)}", "a" if i < 20 else "b") for i in range(23)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=5).collect()}
    assert all(got[i].removed_words == (12 if i < 20 else 0) for i in got)
    assert all(got[i].kept == (i >= 20 or i % 2 == 1) for i in got)


def test_counts_of_one_text(spark):
    text = "a b c d e f g h\na b c d e f g h\n \nx #$ <\r\nx #$ <"
    r = Q.quality_rules(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (22, 24, 6, 1, 16)


def test_edges(edges, none):
    rows = Q.quality_rules(edges).collect()
    assert len(rows) == edges.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.kept for r in rows if r.doc_id in (6, 8))
    assert Q.quality_rules(none).count() == 0


def test_short_lines_count_and_a_share_of_the_host_decides(spark):
    rows = [(i, f"ok\n{words(30, i)}" + ("\nyes no" if i < 40 else ""), "a") for i in range(200)]
    got = {r.doc_id: r.removed_words for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=5, min_percent=20).collect()}
    assert set(got.values()) == {1}  # a fifth of the documents is not more than 20 percent
    got = {r.doc_id: r.removed_words for r in Q.quality_rules(spark.createDataFrame(rows + rows[:40], "doc_id long, text string, source string"), min_docs=5, min_percent=19).collect()}
    assert got == {i: 3 if i < 40 else 1 for i in range(200)}  # equal rows count once
