"""LM scoring by masked pseudo-likelihood.

A small window network, trained here in numpy, predicts every word from two words on either side: h = tanh(sum of the four neighbours' vectors, one table for each
place), then the word's class and its id within the class, each by a softmax.  The most frequent words have ids of their own.  Every other word has the id of
its first byte, and the rest of it is spelled byte by byte, each from the two before it, up to an end mark; the spellings of words with ids of their own are
left out and the others scaled up to make up for them.  So all words, seen or not, are tokens, and their probabilities at a place sum to 1.  A document's score is the sum over its
words of log p(word | both sides).

1. Word counts over all documents: each task sums its own, one aggregation merges them, and the most frequent words get ids.
2. Each text is turned into ids once.  Texts are dealt into buckets by their keys' hashes, and a bucket is one row: its texts in the keys' order.
3. Training over all documents, in rounds: from the round's parameters on each bucket is worked through with Adagrad over a share of the positions (the masked ones; others
   each round, until each was masked once), and parameters are averaged by words seen, in whole numbers.  So the result depends on
   neither partitions nor the order in which tasks end.  What is gathered grows with the buckets and tasks.
4. One pass scores every word of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, row_key, stored
from .words import hashes, mix, spans, utf8

CLASSES, WITHIN, WIDTH, REACH = 32, 32, 24, 2
VOCABULARY = CLASSES * WITHIN
OWN = 768
ROUNDS = 8
PAD = VOCABULARY
ROW = 32
END, PAIRS = 256, 1 << 12
#: Parameters are summed as whole multiples of this.
GRAIN = 2.0**-20
_SHAPES = [(2 * REACH, VOCABULARY + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,), (CLASSES, WIDTH, WITHIN), (CLASSES, WITHIN)]


class Params(list):
    """Vectors of the neighbours by place, hidden bias, class weights and bias, weights and bias within each class."""

    @classmethod
    def fresh(cls, counts: np.ndarray | None = None, seed: int = 11) -> Params:
        """Random vectors; biases that give the frequencies of ``counts``, one for each id, if there are any."""
        draw = np.random.RandomState(seed)
        out = cls(np.zeros(s, np.float32) for s in _SHAPES)
        out[0][:] = draw.normal(0, 0.1, _SHAPES[0])
        if counts is not None:
            share = (np.asarray(counts, np.float64) + 0.5).reshape(CLASSES, WITHIN)
            out[3][:] = np.log(share.sum(axis=1) / share.sum())
            out[5][:] = np.log(share / share.sum(axis=1, keepdims=True))
        else:
            out[2][:] = draw.normal(0, 0.1, _SHAPES[2])
            out[4][:] = draw.normal(0, 0.1, _SHAPES[4])
        return out

    def rows(self) -> np.ndarray:
        flat = np.concatenate([p.ravel() for p in self])
        return np.pad(flat, (0, -len(flat) % ROW)).reshape(-1, ROW)

    @classmethod
    def of(cls, rows: np.ndarray) -> Params:
        flat, at, out = rows.ravel().astype(np.float32), 0, cls()
        for s in _SHAPES:
            out.append(flat[at : at + int(np.prod(s))].reshape(s).copy())
            at += int(np.prod(s))
        return out


class Spelling(NamedTuple):
    """Counts of the byte after a pair of bytes (the pairs hashed) and after one byte, with their sums; for each first byte log(1 - probability of the spellings of words with own ids)."""

    pairs: np.ndarray
    pair_sums: np.ndarray
    ones: np.ndarray
    left: np.ndarray


class Words(NamedTuple):
    """Words with ids of their own: sorted hashes, and the id of each."""

    known: np.ndarray
    rank: np.ndarray


class Model(NamedTuple):
    words: Words
    spelling: Spelling
    params: Params


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(column)
    starts, ends, first = spans(data, at)
    return hashes(data, starts, ends), first


def ids(h: np.ndarray, begin: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of words with these hashes and first bytes: the ids that others see of them and the ids that are predicted.  They are the same for words with ids of their own; others are seen by a hash."""
    seen = (OWN + mix(h) % np.uint64(VOCABULARY - OWN)).astype(np.int64)
    said = OWN + begin.astype(np.int64)
    if len(words.known):
        place = np.minimum(np.searchsorted(words.known, h), len(words.known) - 1)
        there = words.known[place] == h
        seen[there] = said[there] = words.rank[place[there]]
    return seen, said


def encoded(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seen and predicted ids of all words, each row's first word, the bytes, and each word's first and last place in them."""
    data, at = utf8(column)
    starts, ends, first = spans(data, at)
    seen, said = ids(hashes(data, starts, ends), data[starts], words)
    return seen, said, first, data, starts, ends


def neighbours(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word the ids of the REACH words before and after it in its text, PAD beyond its ends."""
    n = len(word)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((2 * REACH, n), PAD, dtype=np.int64)
    for k in range(1, REACH + 1):
        if n > k:
            same = row[k:] == row[:-k]
            out[k - 1, k:][same] = word[:-k][same]
            out[REACH + k - 1, :-k][same] = word[k:][same]
    return out


def letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each byte of the words after their first, and the end mark after each word: the hashed pair and the byte before it, itself, and the word."""
    n = ends - starts
    word = np.repeat(np.arange(len(n)), n)
    place = np.repeat(starts + 1, n) + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)  # of the byte spelled; a word's end is the place of its end mark
    last = place == ends[word]
    what = np.where(last, END, data[np.minimum(place, len(data) - 1)].astype(np.int64))
    before = data[place - 1].astype(np.int64)
    second = np.where(place - 2 >= starts[word], data[np.maximum(place - 2, 0)], 0x20).astype(np.int64)
    return ((second * 257 + before) * 40_503 >> 4) % PAIRS, before, what, word


def spelled(s: Spelling, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log p(the rest of each word | its first byte), of words without ids of their own."""
    if not len(starts):
        return np.zeros(0)
    pair, before, what, word = letters(data, starts, ends)
    lone = (s.ones[before, what] + 0.5) / (s.ones.sum(axis=1)[before] + 0.5 * 257)
    chance = (s.pairs[pair, what] + 4 * lone) / (s.pair_sums[pair] + 4)
    return np.bincount(word, np.log(chance), minlength=len(starts)) - s.left[data[starts]]


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _by_class(word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the words by class, and each class with its run there."""
    order = np.argsort(word // WITHIN, kind="stable")
    kind = (word // WITHIN)[order]
    at = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, np.int64)
    return order, [(int(kind[a]), int(a), int(b)) for a, b in zip(at, np.append(at[1:], len(kind)))]


def hidden(p: Params, around: np.ndarray) -> np.ndarray:
    z = np.repeat(p[1][None, :], around.shape[1], axis=0)
    for j in range(2 * REACH):
        z += p[0][j][around[j]]
    return np.tanh(z)


def log_probs(p: Params, word: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log p of every word's id given its neighbours."""
    out = np.empty(len(word), dtype=np.float64)
    for low in range(0, len(word), 8192):
        w = word[low : low + 8192]
        order, runs = _by_class(w)
        w, h = w[order], hidden(p, around[:, low : low + 8192][:, order])
        z = h @ p[2] + p[3]
        top = z.max(axis=1)
        value = z[np.arange(len(w)), w // WITHIN] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
        for c, a, b in runs:
            y = h[a:b] @ p[4][c] + p[5][c]
            top = y.max(axis=1)
            value[a:b] += y[np.arange(b - a), w[a:b] % WITHIN] - top - np.log(np.exp(y - top[:, None]).sum(axis=1))
        out[low : low + 8192][order] = value
    return out


def step(p: Params, square: Params, word: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch of masked words."""
    n = len(word)
    order, runs = _by_class(word)
    word, around = word[order], around[:, order]
    h = hidden(p, around)
    error = _soft(h @ p[2] + p[3])
    error[np.arange(n), word // WITHIN] -= 1
    back = error @ p[2].T
    grads = [None, None, h.T @ error / n, error.mean(axis=0)]
    for c, a, b in runs:
        e = _soft(h[a:b] @ p[4][c] + p[5][c])
        e[np.arange(b - a), word[a:b] % WITHIN] -= 1
        back[a:b] += e @ p[4][c].T
        for k, g in ((4, h[a:b].T @ e / n), (5, e.sum(axis=0) / n)):
            square[k][c] += g * g
            p[k][c] -= rate * g / (np.sqrt(square[k][c]) + 1e-6)
    back *= (1 - h * h) / n
    grads[1] = back.sum(axis=0)
    for k in (1, 2, 3):
        square[k] += grads[k] ** 2
        p[k] -= rate * grads[k] / (np.sqrt(square[k]) + 1e-6)
    key = (around + np.arange(2 * REACH)[:, None] * (VOCABULARY + 1)).astype(np.uint16).ravel()  # a vector for each place and id
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[at].astype(np.int64)
    g = np.add.reduceat(back[order % n], at, axis=0)
    vectors, squares = p[0].reshape(-1, WIDTH), square[0].reshape(-1, WIDTH)
    total = squares[key] + g * g
    squares[key] = total
    vectors[key] -= rate * g / (np.sqrt(total) + 1e-6)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            data, at = utf8(batch.column(0).slice(low, 2048))
            starts, ends, _ = spans(data, at)
            _, one, times = np.unique(hashes(data, starts, ends), return_index=True, return_counts=True)
            n = ends[one] - starts[one]
            place = np.repeat(starts[one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            offsets = np.concatenate([[0], np.cumsum(n)])
            word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data[place].tobytes())])
            yield pa.RecordBatch.from_arrays([word.cast(pa.binary()), pa.array(times)], ["word", "n"])


def vocabulary(docs: DataFrame) -> tuple[list[bytes], Words, int]:
    """The OWN most frequent words of all texts (ties by their bytes) in order, their hashes and ids, and the number of all words."""
    counts = stored(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    top = [bytes(r.word) for r in counts.orderBy(F.col("n").desc(), "word").limit(OWN).collect()]
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dropped(counts)
    h = np.concatenate([np.zeros(0, np.uint64), *[hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in top]])
    order = np.argsort(h)
    return top, Words(h[order], order), total


def _encode(words: Words):
    """Rows (rkey, ids): a text's ids, two bytes a seen one and two bytes a predicted one.  Rows (null, null, key, n): how often a byte was spelled after a pair of bytes, after one, or an id was there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (PAIRS + 256) * 257
        total = np.zeros(size + VOCABULARY, dtype=np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                seen, said, first, data, starts, ends = encoded(part.column(1), words)
                rare = said >= OWN
                if rare.any():
                    pair, before, what, _ = letters(data, starts[rare], ends[rare])
                    for key in (pair * 257 + what, (PAIRS + before) * 257 + what):
                        found, times = np.unique(key, return_counts=True)
                        total[found] += times
                total[size:] += np.bincount(said, minlength=VOCABULARY)
                both = np.stack([seen, said], axis=1).astype("<u2")
                rows = [both[first[i] : first[i + 1]].tobytes() for i in range(part.num_rows)]
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary()), none, none], ["rkey", "ids", "key", "n"])
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(total[key])], ["rkey", "ids", "key", "n"])

    return work


def spelling(counts: np.ndarray, top: list[bytes]) -> Spelling:
    """From the counts by pair and byte, and the words that are never spelled."""
    table = counts[: (PAIRS + 256) * 257].reshape(-1, 257).astype(np.float32)
    s = Spelling(table[:PAIRS], table[:PAIRS].sum(axis=1), table[PAIRS:], np.zeros(256))
    taken = np.zeros(256)
    for word in top:
        data = np.frombuffer(word, np.uint8)
        taken[data[0]] += np.exp(spelled(s, data, np.array([0]), np.array([len(data)]))[0])
    return s._replace(left=np.log(np.maximum(1 - taken, 1e-9)))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of a stream sorted by bucket: its texts' ids in order, with REACH places between that are no words."""
    gap = np.full(2 * REACH, PAD, "<u2").tobytes()
    at, held = None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([gap.join([b"", *held, b""])], pa.binary())], ["bucket", "ids"])
    for batch in batches:
        for bucket, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at:
                if held:
                    yield out()
                at, held = bucket, []
            held.append(own)
    if held:
        yield out()


def targets(n: int, bucket: int, turn: int, share: int = ROUNDS) -> np.ndarray:
    """Whether each of n places of a bucket is masked in a round: in ``share`` rounds each is once."""
    return mix(np.arange(n, dtype=np.uint64) ^ (np.uint64(bucket) << np.uint64(40))) % np.uint64(share) == np.uint64(turn % share)


def trained(buckets: DataFrame, p: Params, *, rounds: int = ROUNDS, batch_words: int = 8192, rate: float = 0.3) -> Params:
    """Parameters after ``rounds`` rounds over all buckets; each masks one in ``rounds`` of the positions, so that in all each was masked once."""
    for turn in range(rounds):
        sent = buckets.sparkSession.sparkContext.broadcast(p.rows())

        def work(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            total, all_seen = np.zeros(sent.value.shape, dtype=np.int64), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    both = np.frombuffer(batch.column(1)[i].as_py(), "<u2").reshape(-1, 2).astype(np.int64)
                    own, square = Params.of(sent.value), Params(np.full(s, 1e-6, np.float32) for s in _SHAPES)
                    where = np.flatnonzero(targets(len(both), batch.column(0)[i].as_py(), turn, rounds) & (both[:, 1] != PAD))
                    for low in range(0, len(where), batch_words):
                        at = where[low : low + batch_words]
                        around = np.stack([both[at + k, 0] for k in (-1, -2, 1, 2)])
                        step(own, square, both[at, 1], around, rate * min(1.0, len(at) / batch_words) / (1 + turn) ** 0.5)
                    total += np.rint(own.rows() / GRAIN).astype(np.int64) * len(where)
                    all_seen += len(where)
            if all_seen:
                n = len(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, all_seen)), *[pa.array(total[:, j]) for j in range(ROW)]], ["at", "seen", *[f"c{j}" for j in range(ROW)]])

        parts = buckets.mapInArrow(work, "at int, seen long, " + ", ".join(f"c{j} long" for j in range(ROW)))
        total = parts.groupBy("at").agg(F.sum("seen").alias("seen"), *[F.sum(F.col(f"c{j}").cast("decimal(38,0)")).cast("double").alias(f"c{j}") for j in range(ROW)]).toPandas().sort_values("at")
        if len(total):
            p = Params.of(total[[f"c{j}" for j in range(ROW)]].to_numpy(np.float64) * GRAIN / total[["seen"]].to_numpy())
    return p


def fit(docs: DataFrame, *, bucket_words: int = 1 << 19, **how) -> Model:
    """A model of docs (doc_id, text).  Equal rows are learned from once.  Without words every id is as likely as any other."""
    top, words, total = vocabulary(docs)
    made = stored(docs.select(row_key().alias("rkey"), "text").mapInArrow(_encode(words), "rkey long, ids binary, key long, n long"), "ids")
    sums = made.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most (PAIRS + 256) * 257 + VOCABULARY rows
    counts = np.zeros((PAIRS + 256) * 257 + VOCABULARY, dtype=np.int64)
    counts[sums["key"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    n = max(1, total // bucket_words)
    texts = made.where("rkey is not null").groupBy(F.pmod(F.xxhash64("rkey"), F.lit(n)).alias("bucket"), "rkey").agg(F.first("ids").alias("ids"))
    texts = texts.repartition("bucket").sortWithinPartitions("bucket", "rkey").select("bucket", "ids")
    buckets = stored(texts.mapInArrow(_gather, "bucket long, ids binary"), "buckets")
    dropped(made)
    out = Model(words, spelling(counts, top), trained(buckets, Params.fresh(counts[(PAIRS + 256) * 257 :]), **how))
    dropped(buckets)
    return out


def word_scores(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log p(word | both sides) of all words of a column, and each row's first word."""
    seen, said, first, data, starts, ends = encoded(column, model.words)
    out = log_probs(model.params, said, neighbours(seen, first))
    rare = np.flatnonzero(said >= OWN)
    for low in range(0, len(rare), 1 << 15):
        own = rare[low : low + (1 << 15)]
        out[own] += spelled(model.spelling, data, starts[own], ends[own])
    return out, first


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, log_likelihood and mean_log_prob under a model."""
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.spelling, model.params.rows()))
    new = {"n_tokens": "long", "log_likelihood": "double", "mean_log_prob": "double"}
    out = docs.withColumns({c: F.lit(None).cast(t) for c, t in new.items()})
    names = out.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, spell, rows = sent.value
        own = Model(words, spell, Params.of(rows))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                value, first = word_scores(part.column(names.index("text")), own)
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                score = np.bincount(row, value, minlength=len(n)).astype(np.float64)  # whole numbers if there is no word
                columns = list(part.columns)
                columns[names.index("n_tokens")] = pa.array(n, pa.int64())
                columns[names.index("log_likelihood")] = pa.array(score)
                columns[names.index("mean_log_prob")] = pa.array(score / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays(columns, names)

    return out.mapInArrow(work, out.schema)


def lm_scores(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, text and others) with n_tokens long, log_likelihood double (summed over all words) and mean_log_prob double, from a network trained on docs.

    A null or empty text has 0 tokens, a log-likelihood of 0 and a null mean.  Columns of these names are replaced, others kept.  Equal texts score alike, also in
    another order or other partitions of docs.  An empty table gives an empty result.
    """
    return scored(docs, fit(docs, **how))
