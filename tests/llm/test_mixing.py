from pyspark.sql import functions as F

from motion_tables.llm import mixing as M
from motion_tables.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import same

FOLDER = "/root/testdata/sf0.001"


def filled(sizes, weights, repeats=3.0):
    """Targets by resharing until none is above its limit."""
    total, full = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        level = (total - sum(full.values())) / sum(weights[i] for i in rest) if rest else 0
        over = [i for i in rest if weights[i] * level > repeats * sizes[i] + 1e-9]
        if not over:
            return [full.get(i, weights[i] * level) for i in range(len(sizes))]
        full |= {i: repeats * sizes[i] for i in over}


def test_same_as_sql(spark):
    same(spark, FOLDER, QUERIES["op3_source_mixing"], ORACLE_SQL["op3_source_mixing"])


def test_targets_are_those_of_resharing(spark):
    for sizes in ([10, 1000, 5, 0, 70], [0, 0], [7], [1, 1, 1, 5000]):
        df = spark.createDataFrame([(f"={i}", f"{i}", s) for i, s in enumerate(sizes)], "src string, source string, source_size long")
        got = [r.target for r in M.targets(df, (5.0, 2.0, 1.0), 3.0).orderBy("src").collect()]
        want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]) if sum(sizes) else [0] * len(sizes)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, want))


def test_taken_is_near_the_target_and_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.taken(M.mix_sources(docs)).toPandas()
    assert len(rows) == docs.count() and (rows["taken"] <= 3 * rows["size"]).all()
    g = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((g.taken - g.target).abs() <= 0.04 * g.target).all()
    again = M.taken(M.mix_sources(docs.repartition(9))).toPandas()
    assert rows.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_slots_permute_a_source_and_spread_over_shards(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 500), "a" if i % 4 else "b") for i in range(40)], "doc_id long, text string, source string")
    m = M.mix_sources(docs, block_words=10, shards=8)
    slots = m.slots.toPandas()
    blocks = {r.src: r.blocks for r in m.sources.collect()}
    for (src, turn), g in slots.groupby(["src", "turn"]):
        assert g["block"].is_unique and g["block"].between(0, blocks[src] - 1).all()
    assert (slots[slots["turn"] == 0].groupby("src")["block"].nunique() <= [blocks[s] for s in sorted(blocks)]).all()
    per = slots.groupby(["src", "shard"]).size().unstack(fill_value=0)
    assert per.shape[1] == 8 and (per.loc["=a"] > 100).all()


def test_small_sources_meet_their_targets(spark):
    """Sources of 1 to 2,000 words: within a block's words of the target, and exact where that is three times the size."""
    for sizes in ([50, 5000], [130, 9000], [300, 1, 40_000], [1, 50, 130, 300, 2000, 127, 129, 4000]):
        docs = spark.createDataFrame([(100 * i + k, " ".join(["w"] * n), f"s{i}") for i, size in enumerate(sizes) for k, n in enumerate([size // 3, size - size // 3])], "doc_id long, text string, source string")
        g = M.taken(M.mix_sources(docs)).toPandas().groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
        assert ((g.taken - g.target).abs() <= 128).all(), g
        assert (g.taken == g.target)[g.target == 3 * g["size"]].all(), g


def test_shards_have_their_slots_and_draws(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 500), "abc"[i % 7 // 3]) for i in range(140)], "doc_id long, text string, source string")
    m = M.mix_sources(docs, block_words=10, shards=32)
    slots, sources, counts = m.slots.toPandas(), {r.src: r for r in m.sources.collect()}, m.counts.toPandas()
    assert slots.groupby("src").size().to_dict() == {s: r.quota for s, r in sources.items() if r.quota}
    size = -(-len(slots) // 32)
    per = slots.groupby("shard").size()
    assert (per.iloc[:-1] == size).all() and per.sum() == len(slots) == counts["drawn"].sum()
    assert (counts.groupby("shard")["drawn"].sum() == per).all()
    for s, r in sources.items():  # draws spread as those of a multinomial, and settling moves few slots
        p = r.quota / len(slots)
        n = counts[counts.src == s].set_index("shard")["drawn"].reindex(per.index, fill_value=0)
        assert 0.3 < n.var() / (size * p * (1 - p)) < 3
        assert (slots[slots.src == s].groupby("shard").size().reindex(per.index, fill_value=0) - n).abs().sum() < 8 * len(slots) ** 0.5


def test_edges(edges, none):
    rows = M.taken(M.mix_sources(edges)).collect()
    assert len(rows) == edges.count() and all(r.taken <= 3 * r["size"] for r in rows) and all(r.taken == 0 for r in rows if r["size"] == 0)
    assert M.taken(M.mix_sources(none)).count() == 0
    out = M.mixed(edges)
    assert out.count() == edges.count() and {*edges.columns, "taken", "target", "source_size"} == {*out.columns}
    blank = edges.where(F.coalesce(F.trim("text"), F.lit("")) == "")
    assert {r.target for r in M.taken(M.mix_sources(blank)).collect()} == {0.0}


def test_numbers_are_made_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 7)
    df = spark.createDataFrame([(1, 0, 20), (2, 5, 5), (3, 5, 6), (4, 100, 114), (5, 9, 3)], "id int, low long, high long")
    got = sorted((r.id, r.n) for r in M.each(df, df.low, df.high, "n").collect())
    assert got == [(i, n) for i, a, b in ((1, 0, 20), (3, 5, 6), (4, 100, 114)) for n in range(a, b)]


def test_no_plan_holds_the_whole_mix(spark, capsys):
    """The driver plans the mix in parts: the last one has few exchanges."""
    docs = spark.createDataFrame([(i, "a b c " * (i % 9), "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    M.mixed(docs).explain()
    assert capsys.readouterr().out.count("Exchange") <= 14
