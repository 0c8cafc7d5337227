import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from motion_tables.llm import lm_scoring as L
from motion_tables.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def slow_log_prob(p, word, around):
    """One word, by the definition."""
    h = p[1].astype(float).copy()
    for j, n in enumerate(around):
        h += p[0][j][n]
    h = np.tanh(h)
    c, k = divmod(int(word), L.WITHIN)
    soft = lambda z: z - np.log(np.exp(z).sum())
    return soft(h @ p[2] + p[3])[c] + soft(h @ p[4][c] + p[5][c])[k]


def slow_word(m, word, around):
    """log p of a word, byte by byte, given the ids around it."""
    h = L.hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
    seen, said = L.ids(h, np.array([word[0]]), m.words)
    out = slow_log_prob(m.params, said[0], around)
    if said[0] < L.OWN:
        return out
    taken = 0.0
    spell = lambda w: sum(np.log(slow_byte(m.spelling, w[i - 2] if i > 1 else 0x20, w[i - 1], w[i] if i < len(w) else L.END)) for i in range(1, len(w) + 1))
    for other in TOP:
        taken += np.exp(spell(other)) if other[0] == word[0] else 0
    return out + spell(word) - np.log(1 - taken)


def slow_byte(s, second, before, what):
    pair = ((second * 257 + before) * 40_503 >> 4) % L.PAIRS
    lone = (s.ones[before, what] + 0.5) / (s.ones[before].sum() + 0.5 * 257)
    return (s.pairs[pair, what] + 4 * lone) / (s.pairs[pair].sum() + 4)


TOP = [b"the", b"of", b"tea"]


def small_model():
    h = np.concatenate([L.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in TOP])
    words = L.Words(np.sort(h), np.argsort(h))
    data, at = L.utf8(pa.array(["then they thus ton to over often étage x" * 3]))
    starts, ends, _ = L.spans(data, at)
    pair, before, what, _ = L.letters(data, starts, ends)
    counts = np.zeros((L.PAIRS + 256) * 257 + L.VOCABULARY, np.int64)
    np.add.at(counts, pair * 257 + what, 1)
    np.add.at(counts, (L.PAIRS + before) * 257 + what, 1)
    return L.Model(words, L.spelling(counts, TOP), L.Params.fresh())


def test_scores_agree_with_the_definition():
    m = small_model()
    text = "the tea of them toe then unseen é the xxxx"
    value, first = L.word_scores(pa.array([text, None, "", "of"]), m)
    assert first.tolist() == [0, 10, 10, 10, 11]
    words = [w.encode() for w in text.split()] + [b"of"]
    seen, _, first, *_ = L.encoded(pa.array([text, None, "", "of"]), m.words)
    around = L.neighbours(seen, first)
    assert around[:, 0].tolist() == [L.PAD, L.PAD, seen[1], seen[2]] and around[:, 10].tolist() == [L.PAD] * 4
    assert np.allclose(value, [slow_word(m, w, around[:, i]) for i, w in enumerate(words)], atol=1e-4)


def test_probabilities_sum_to_one():
    m = small_model()
    assert np.isclose(np.exp([slow_log_prob(m.params, w, [3, 1, 900, L.PAD]) for w in range(L.VOCABULARY)]).sum(), 1, atol=1e-4)
    for second, before in ((0x20, ord("t")), (ord("t"), ord("h")), (1, 2)):
        assert np.isclose(sum(slow_byte(m.spelling, second, before, w) for w in range(257)), 1)
    spell = lambda w: np.exp(L.spelled(m.spelling._replace(left=np.zeros(256)), np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])))[0]
    assert np.isclose(np.exp(m.spelling.left[ord("t")]), 1 - spell(b"the") - spell(b"tea")) and m.spelling.left[ord("x")] == 0


def test_training_lowers_the_loss():
    r = np.random.RandomState(0)
    word = r.randint(0, 20, 4000)
    word[1::2] = (word[::2] * 7) % 20  # every second word follows from the one before it
    around = L.neighbours(word, np.array([0, len(word)]))
    p, square = L.Params.fresh(), L.Params(np.full(s, 1e-6, np.float32) for s in L._SHAPES)
    before = L.log_probs(p, word, around).mean()
    for _ in range(60):
        L.step(p, square, word, around, 0.1)
    after = L.log_probs(p, word, around)
    counts = np.bincount(word) / len(word)
    assert before < -6 and after.mean() > np.log(counts[word]).mean() + 0.3


def test_every_query_row(spark):
    got = QUERIES["op2_lm_scoring"](spark, FOLDER).toPandas()
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    assert len(got) == len(docs) and np.allclose(got["mean_log_prob"] * got["n_tokens"], got["log_likelihood"])


def test_sums_and_reruns(spark):
    """Sums of words by a loop over the whole table; the same scores from other partitions and another order."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    m = L.fit(docs)
    rows = {r.doc_id: r for r in L.scored(docs, m).collect()}
    for r in docs.collect():
        assert np.isclose(rows[r.doc_id].log_likelihood, L.word_scores(pa.array([r.text], pa.string()), m)[0].sum())
    other = docs.orderBy(F.desc("doc_id")).repartition(7)
    again = L.fit(other)
    assert all(np.array_equal(a, b) for a, b in zip(m.params, again.params)) and np.array_equal(m.spelling.pairs, again.spelling.pairs)
    assert all(np.isclose(rows[r.doc_id].log_likelihood, r.log_likelihood, rtol=1e-6) for r in L.scored(other, again).collect())


def test_held_out_texts_beat_frequencies_of_words_and_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    texts = [pa.array([r.text for r in docs.where(c).select("text").collect()], pa.string()) for c in (fold != 0, fold == 0)]
    m = L.fit(docs.where(fold != 0))
    (seen, said, first, *_), (seen_t, said_t, first_t, *_) = (L.encoded(t, m.words) for t in texts)
    one = np.bincount(said, minlength=L.VOCABULARY) + 0.5
    one = one / one.sum()
    two = np.zeros((L.VOCABULARY + 1, L.VOCABULARY))
    np.add.at(two, (L.neighbours(seen, first)[0], said), 1)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    around = L.neighbours(seen_t, first_t)
    net = L.log_probs(m.params, said_t, around).mean()
    assert net > np.log(one[said_t]).mean() + 0.4 and net > np.log(two[around[0], said_t]).mean() + 0.25


def test_every_position_is_a_target_once():
    assert (sum(L.targets(5000, 3, turn).astype(int) for turn in range(L.ROUNDS)) == 1).all()
    assert L.trained.__kwdefaults__["rounds"] == L.ROUNDS


def test_parameters_survive_their_rows():
    p = L.Params.fresh()
    assert all(np.array_equal(a, b) for a, b in zip(p, L.Params.of(p.rows())))


def test_edges(edges, none):
    out = L.lm_scores(edges, rounds=1)
    rows = out.collect()
    assert len(rows) == edges.count() and {*edges.columns} <= {*out.columns}
    assert all(r.n_tokens == 0 and r.log_likelihood == 0 and r.mean_log_prob is None for r in rows if not (r.text or "").strip())
    assert all(r.mean_log_prob < 0 for r in rows if (r.text or "").strip()) and len({r.log_likelihood for r in rows if r.doc_id in (9, 10)}) == 1
    assert L.lm_scores(none).count() == 0
