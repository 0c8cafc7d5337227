"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

A word counts as two types: its form (lower-cased bytes, hashed) and its shape (case, symbols, digits, punctuation, whether it repeats
the word before).  Every type has a fixed sparse random index vector; a type's word vector is the normalised sum of the index vectors around
its occurrences.  A document is the mean of its words' vectors.  The vectors and the network are learned from a bounded sample of labelled
rows (``most_rows``); every document is scored from its whole text.  Index vectors are whole numbers, so their sums do not depend on
the order in which tasks finish.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_own_columns
from .words import hashes, series, spans, utf8

FORMS, SHAPES, WIDTH, REACH = 1 << 14, 240, 48, 2
_LOWER = series(256, 1)
_LOWER[ord("A") : ord("Z") + 1] = _LOWER[ord("a") : ord("z") + 1]
_LOWER[[0x20, 9, 10, 11, 12, 13]] = 0


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _of(bytes(range(65, 91))), _of(b"0123456789")
_SYMBOL, _POINT, _BANG = _of(b"#*$%&|<>_~^=+\\/@{}[]"), _of(b".,;:?'\"()-"), _of(b"!")
_LETTER = _of(bytes(range(97, 123)) + bytes(range(128, 256)))

def _index_vectors() -> np.ndarray:
    """Four places of each type's vector are 1 or -1."""
    n = FORMS + SHAPES
    bits = series(n * 4, 6).reshape(n, 4)
    out = np.zeros((n, WIDTH), dtype=np.int8)
    for j in range(4):
        out[np.arange(n), (bits[:, j] >> np.uint64(8)) % np.uint64(WIDTH)] = np.where(bits[:, j] & np.uint64(1), 1, -1)
    return out


INDEX = _index_vectors()


def types(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form and shape of every word, and each row's first word (one more entry than rows)."""
    data, at = utf8(column)
    starts, ends, first = spans(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    h = hashes(data, starts, ends, _LOWER)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
        return total[ends] - total[starts]

    letters, upper, digits, symbols, bangs, points = (count(m) for m in (_LETTER, _UPPER, _DIGIT, _SYMBOL, _BANG, _POINT))
    head = _UPPER[data[starts]]
    case = np.where(letters + upper == 0, 0, np.where(upper == 0, 1, np.where((upper == 1) & head & (letters > 0), 2, np.where(letters == 0, 3, 4))))
    mark = np.where(bangs > 0, 2, np.where(points > 0, 1, 0))
    again = np.concatenate([[False], h[1:] == h[:-1]])
    again[first[:-1][np.diff(first) > 0]] = False
    shape = ((((case * 2 + (symbols > 0)) * 2 + (digits > 0)) * 3 + mark) * 2 + (letters + upper + digits == 0)) * 2 + again
    return (h >> np.uint64(50)).astype(np.int64), shape.astype(np.int64), first


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every type seen in a task: its occurrences and the sums of the index vectors around them."""
    total = np.zeros((FORMS + SHAPES, WIDTH + 1), dtype=np.int64)
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            form, shape, first = types(batch.column(0).slice(low, 64))
            if not len(form):
                continue
            own = INDEX[form].astype(np.int32) + INDEX[FORMS + shape]
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            around = np.zeros_like(own)
            for k in range(1, REACH + 1):
                same = (row[k:] == row[:-k])[:, None]
                around[k:] += own[:-k] * same
                around[:-k] += own[k:] * same
            around = np.concatenate([around, np.ones((len(form), 1), np.int32)], axis=1)
            for kind in (form, FORMS + shape):
                order = np.argsort(kind, kind="stable")
                ids = kind[order]
                begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                total[ids[begin]] += np.add.reduceat(around[order], begin, axis=0)
    seen = np.flatnonzero(total[:, WIDTH])
    yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(total[seen, j]) for j in range(WIDTH + 1)]], ["type", *[f"c{j}" for j in range(WIDTH)], "n"])


class Model(NamedTuple):
    """vectors of all types; the network's layers; the inputs' centre and scale; the temperature.  Without a network every score is ``flat``."""

    vectors: np.ndarray
    layers: list[np.ndarray] | None
    centre: np.ndarray
    scale: np.ndarray
    temperature: float
    flat: float


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Of each text: mean form vector, mean shape vector and the logarithm of its words; texts without words are zero."""
    form, shape, first = types(column)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * WIDTH + 1), dtype=np.float64)
    for a in range(0, len(form), 1 << 15):  # a text of any length in bounded memory
        b = min(len(form), a + (1 << 15))
        row = np.searchsorted(first, np.arange(a, b), side="right") - 1
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[begin], :WIDTH] += np.add.reduceat(vectors[form[a:b]], begin, axis=0)
        out[row[begin], WIDTH : 2 * WIDTH] += np.add.reduceat(vectors[FORMS + shape[a:b]], begin, axis=0)
    out[:, : 2 * WIDTH] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


def logits(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]


def train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int) -> list[np.ndarray]:
    """A two-layer network fitted to 0/1 labels by Adam on the log loss with a small weight penalty."""
    draw = np.random.RandomState(seed)
    layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    mean, square, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for part in np.array_split(order, max(1, len(x) // 128)):
            step += 1
            h = np.tanh(x[part] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, layers[2]) * (1 - h * h)
            slopes = [x[part].T @ back + 1e-4 * layers[0], back.sum(axis=0), h.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            for p, g, m, v in zip(layers, slopes, mean, square):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on rows that the network was not fitted to."""
    if not len(z):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    return float(grid[np.argmin([np.logaddexp(0, -np.where(y > 0, z, -z) / t).mean() for t in grid])])


def fold() -> "F.Column":
    """crc32 of the document's id as text, modulo 3: rows of remainder 1 are held out.  Null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000, hidden: int = 32, epochs: int = 30, seed: int = 7) -> Model:
    """Learns from at most ``most_rows`` labelled rows outside the held-out fold, those of least hash of the id.

    Repeated labels of a document count once, by their least value; null labels and ids are left out.  With labels of one kind only, or
    none, there is no network: every score is the share of label 1, one half without labels.
    """
    known = labels.where("doc_id is not null and quality is not null").where(fold() != 1).groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").cache()  # bounded by most_rows
    sums = rows.select("text").mapInArrow(_contexts, "type long, " + ", ".join(f"c{j} long" for j in range(WIDTH)) + ", n long")
    sums = sums.groupBy("type").agg(*[F.sum(c).alias(c) for c in sums.columns[1:]]).toPandas()
    vectors = INDEX.astype(np.float64) / 2
    if len(sums):
        around = sums[[f"c{j}" for j in range(WIDTH)]].to_numpy(np.float64)
        vectors[sums["type"].to_numpy()] += around / np.maximum(np.sqrt((around**2).sum(axis=1, keepdims=True)), 1)
    vectors = (vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.select(F.crc32(F.col("doc_id").cast("string")).alias("doc_id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(features, "doc_id long, y int, x array<double>").toPandas()
    rows.unpersist()
    got = got.iloc[np.lexsort([got["x"].map(sum), got["doc_id"]])] if len(got) else got
    y = got["y"].to_numpy(np.float64)
    none = np.zeros(2 * WIDTH + 1)
    if len(np.unique(y)) < 2:
        return Model(vectors, None, none, none + 1, 1.0, float(y[0]) if len(y) else 0.5)
    x = np.array(got["x"].tolist())
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = (x - centre) / scale
    aside = (got["doc_id"].to_numpy() // 3) % 5 == 0
    if len(np.unique(y[~aside])) < 2:
        aside[:] = False
    layers = train(x[~aside], y[~aside], hidden, epochs, seed)
    return Model(vectors, layers, centre, scale, calibrated(logits(x[aside], layers), y[aside]), 0.5)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    if model.layers is None:
        return np.full(len(column), model.flat)
    x = (pooled(column, model.vectors) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(logits(np.clip(x, -20, 20), model.layers) / model.temperature, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``score``, the probability of label 1 from the whole text; a column of that name is replaced, others are kept.

    A null or empty text is scored as one without words; equal texts have equal scores.  No shuffle.
    """
    out = docs.withColumn("score", F.lit(None).cast("double"))
    names = out.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at_text, at_score = names.index("text"), names.index("score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at_text)
            done = [scores(text.slice(low, 64), sent.value) for low in range(0, batch.num_rows, 64)]
            columns = list(batch.columns)
            columns[at_score] = pa.array(np.concatenate(done) if done else np.zeros(0))
            yield pa.RecordBatch.from_arrays(columns, names)

    return out.mapInArrow(work, out.schema)


def accepted(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **how) -> DataFrame:
    """The rows of docs, with their own columns, that score at least ``least``."""
    model = fit(docs, labels, **how)
    return with_own_columns(docs, ["score"], lambda d: score(d, model).where(F.col("score") >= least))
