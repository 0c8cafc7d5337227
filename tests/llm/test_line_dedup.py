from motion_tables.llm import line_dedup as L
from motion_tables.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same


def test_same_as_sql(spark):
    for folder in ("sf0.001", "sf0.01"):
        same(spark, f"/root/testdata/{folder}", QUERIES["op4_line_dedup"], ORACLE_SQL["op4_line_dedup"])


def test_near_the_threshold_counts_are_exact(spark):
    line = "this is the line number {} of a site"
    rows = [(s * 1000 + n, line.format(n) + "\nand a line of its own, here it is %d" % (s * 1000 + n), f"site{s}") for n in range(1, 13) for s in range(n)]
    out = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=6).collect()}
    for i, text, _ in rows:
        s, n = divmod(i, 1000)
        assert out[i].lines_removed == (1 if n >= 6 and s > 0 else 0), i
        assert out[i].text == (text.split("\n")[1] if out[i].lines_removed else text)


def test_edges(edges, none):
    out = L.dedup_lines(edges, min_sites=2, min_chars=5)
    rows = out.collect()
    assert len(rows) == edges.count() and {*out.columns} == {*edges.columns}
    by = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3, 6, 9, 10)}
    assert by[1].text is None and by[2].text == "" and not by[3].words_left and by[1].lines_removed == 0
    assert by[9].text == "one two" and by[10].text == "" and not by[10].words_left and by[6].text == ""
    assert [r.text for r in rows if r.doc_id == 5 and r.lines_removed] == []
    assert L.dedup_lines(none).count() == 0
    kept = L.deduped(edges, min_sites=2, min_chars=5)
    assert kept.columns == edges.columns and 10 not in [r.doc_id for r in kept.collect()] and kept.where("doc_id = 1").count() == 1
