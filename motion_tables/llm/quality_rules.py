"""Quality rules: per-document counts, and a verdict from how often the document's lines stand in other documents of its host.

Lines are normalised to their words with one space between, and hashed.  For each host the distinct documents that hold a line are counted;
lines above the limit are taken out, and a document that they leave depleted is rejected.
One pass over the texts makes the counts and each document's distinct lines; frequencies are one aggregation
of (host, line), summed in every task before the shuffle, and only lines above the limit come back to the documents by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import row_key, stored
from .words import LINE_VALUE, fold, hashes, mix, series, spans, utf8, windows

WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_SCHEMA = "rkey long, doc_id {id}, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
_SALT = series(2, 5) | np.uint64(1)


def _by_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal to it, and whether it is not the first of its value."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.concatenate([[False], same]) if len(keys) else np.zeros(0, bool)
    shared = later.copy()
    shared[:-1] |= later[1:]
    a, b = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    a[order], b[order] = shared, later
    return a, b


def measures(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text; its distinct normalised lines (row of each, hash, words of all its occurrences)."""
    data, at = utf8(column)
    rows = len(at) - 1
    starts, ends, first = spans(data, at)
    words = np.diff(first)
    h = hashes(data, starts, ends)
    ids = np.arange(rows, dtype=np.uint64)
    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[starts] += 1
    in_word[ends] -= 1  # a word's end may be the next text's first byte
    inside = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    out = {"n_words": words, "word_chars": _by_row(inside & ((data & 0xC0) != 0x80), at), "n_symbols": _by_row(SYMBOLS[data], at)}

    w, w_at = windows(h, first, WINDOW)
    w_rows = np.repeat(np.arange(rows), np.diff(w_at))
    shared, _ = _again(mix(w ^ (ids[w_rows] * _SALT[0])))
    begin = (first[:-1][w_rows] + np.arange(len(w)) - w_at[:-1][w_rows])[shared]
    cover = np.zeros(len(h) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    out["n_repeat_words"] = _by_row(np.cumsum(cover)[: len(h)] > 0, first)

    newline = np.flatnonzero(data == 0x0A)
    edge = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], newline + 1]))
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    stop = stop - ((stop > edge) & (data[np.maximum(stop - 1, 0)] == 0x0A)) if len(edge) else stop
    full = stop > edge
    edge, stop = edge[full], stop[full]
    word_at = np.searchsorted(starts, np.append(edge, len(data)))
    held = np.diff(word_at)
    raw = hashes(data, edge, stop, LINE_VALUE)
    has = held > 0
    line_row = (np.searchsorted(at, edge, side="right") - 1)[has]
    _, later = _again(mix(raw[has] ^ (ids[line_row] * _SALT[0])))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=rows)
    text = mix(fold(h, word_at[:-1][has])) if has.any() else np.zeros(0, np.uint64)
    order = np.lexsort((text, line_row))
    text, line_row, held = text[order], line_row[order], held[has][order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (line_row[1:] != line_row[:-1])])) if len(text) else np.zeros(0, np.int64)
    return out, line_row[new], text[new], np.add.reduceat(held, new) if len(new) else np.zeros(0, np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            counts, row, line, words = measures(part.column(3))
            at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(line.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(words, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(counts[c], pa.int64()) for c in names], *lists], ["rkey", "doc_id", "host", *names, "lines", "line_words"])


#: Parts that the documents of a line are dealt into.
SALTS = 32


def _salted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def quality_rules(docs: DataFrame, *, host: str = "source", min_docs: int = 30, min_percent: int = 1, least_left: float = 0.5, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row per row of docs (doc_id, text and the host column are read): rkey, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    removed_words (in lines that more than ``min_percent`` percent of the host's documents hold, and more than ``min_docs`` of them), base_failed, kept.

    A document is kept if it passes the base rules and the lines taken out leave it at least ``least_left`` of its words.  Every line with a
    word counts.  A null text counts as an empty one: no words, base_failed.  A null host
    is a host of its own.  Equal rows are counted as one document and treated alike.  An empty table gives an empty result.
    """
    rows = docs.select(row_key().alias("rkey"), "doc_id", F.xxhash64(host).alias("host"), "text")
    measured = stored(rows.mapInArrow(_measure, _SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())), "measures")
    lines = measured.select("rkey", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("rkey", "host", F.xxhash64("host", "l.lines").alias("line"), F.col("l.line_words").alias("words"), F.pmod("rkey", F.lit(SALTS)).cast("int").alias("salt"))
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    hosts = measured.select("host", "rkey").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    some = often.join(hosts, "host").where(F.col("n") * 100 > F.col("docs") * min_percent)  # equal rows may still be counted twice
    held = stored(lines.join(_salted(some.select("line", "docs")), ["line", "salt"]).select("rkey", "line", "words", "docs").distinct(), "held")
    common = held.groupBy("line").agg(F.count("*").alias("n"), F.first("docs").alias("docs")).where((F.col("n") > min_docs) & (F.col("n") * 100 > F.col("docs") * min_percent))
    removed = held.withColumn("salt", F.pmod("rkey", F.lit(SALTS)).cast("int")).join(_salted(common.select("line")), ["line", "salt"]).groupBy("rkey").agg(F.sum("words").alias("removed_words"))
    out = measured.drop("lines", "line_words", "host").join(removed, "rkey", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words") >= F.col("n_words") * least_left
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & left)
