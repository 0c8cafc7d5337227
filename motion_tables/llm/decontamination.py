"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of L words is looked for in every window of L words of every text.  A window's fingerprint is the SimHash of
its five-word shingles, each counted as often as it stands there.  Fingerprints are cut into four blocks of sixteen
bits; two fingerprints within the radius of 23 bits agree in some block up to five bits, so the blocks' neighbours (6,885 of a block's
65,536 values) hold every item within the radius, and 36 % of the others.  A window and an item within it are then compared exactly: the sum of
the smaller counts of each shingle over the sum of the larger ones.  A text of fewer words than the item is one window, the whole of it.

A window with so few shingles of all items together that it could not reach the similarity with any is not
fingerprinted, which leaves out nothing.  Each text is worked through on its own, in the task that read it: no shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .tables import with_own_columns
from .words import hashes, spans, utf8, windows

BLOCKS, BITS = 4, 16
NEAR = 5
RADIUS = BLOCKS * (NEAR + 1) - 1
_ONES = np.unpackbits(np.arange(1 << BITS, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1).sum(axis=1, dtype=np.uint8)


def matches_of(ids: T.DataType) -> T.ArrayType:
    """The type of matches with item ids of a type."""
    return T.ArrayType(T.StructType([T.StructField("item_id", ids), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())]))


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, four blocks each, of rows of 64 signed sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


class Index:
    """The items by number of words: shingles and fingerprints."""

    def __init__(self, ids: list, texts: list[str], k: int):
        data, at = utf8(pa.array(texts, pa.string()))
        starts, ends, first = spans(data, at)
        h, w_at = windows(hashes(data, starts, ends), first, k)
        n = np.diff(first)
        self.k = k
        self.by_size: dict[int, tuple[list, list[Counter], np.ndarray]] = {}
        groups = defaultdict(list)
        for i in np.flatnonzero(n):
            groups[int(n[i])].append(i)
        for size, own in groups.items():
            sets = [h[w_at[i] : w_at[i + 1]] for i in own]
            prints = simhash(np.stack([_signs(s).sum(axis=0) for s in sets]))
            self.by_size[size] = ([ids[i] for i in own], [Counter(s.tolist()) for s in sets], prints)
        self.shingles = {}  # by shingle length: the sorted shingles and a first sieve by their upper 20 bits
        for m in sorted({min(k, s) for s in self.by_size}):
            held = np.unique(np.concatenate([h[w_at[i] : w_at[i + 1]] for i in np.flatnonzero(np.minimum(n, k) == m)]))
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(held >> np.uint64(44)).astype(np.int64)] = True
            self.shingles[m] = (held, sieve)

    def hits(self, h: np.ndarray, m: int) -> np.ndarray:
        held, sieve = self.shingles[m]
        maybe = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(held, h[maybe]), len(held) - 1)
        return maybe[held[place] == h[maybe]]

    def search(self, h: np.ndarray, hit: np.ndarray, m: int, threshold: float) -> dict:
        """Best window of each item in one text, given the text's m-word shingles and which of them any item has."""
        best: dict = {}
        sizes = [size for size in self.by_size if min(self.k, size) == m]
        most = max(sizes) - m + 1
        cuts = np.flatnonzero(np.diff(hit) > 2 * most) + 1  # hits further apart share no window
        for near_by in np.split(hit, cuts):
            for at in range(0, len(near_by), 4096):  # windows by where they begin: up to the 4096th hit from here, after the hit before
                first = int(near_by[at - 1]) + 1 if at else max(0, int(near_by[0]) - most)
                low, last = max(first, int(near_by[at]) - most), int(near_by[min(at + 4096, len(near_by)) - 1])
                part = near_by[at : np.searchsorted(near_by, last + most)]
                total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(h[low : last + most]), axis=0)])
                for size in sizes:
                    self._search(h, part, low, last, total, size, size - m + 1, threshold, best)
        for size in sizes:
            if len(h) < size - m + 1:
                self._whole(h, hit, m, size, threshold, best)
        return best

    def _near(self, mine: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a fingerprint and an item within the radius, among those that agree in some block up to NEAR bits."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, (1 << 20) // len(prints))
        for low in range(0, len(mine), step):
            part = mine[low : low + step]
            near = _ONES[part[:, :1] ^ prints[:, 0]] <= NEAR
            for b in range(1, BLOCKS):
                near |= _ONES[part[:, b : b + 1] ^ prints[:, b]] <= NEAR
            x, y = np.nonzero(near)
            close = _ONES[part[x] ^ prints[y]].sum(axis=1) <= RADIUS
            found.append((x[close] + low, y[close]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _whole(self, h: np.ndarray, hit: np.ndarray, m: int, size: int, threshold: float, best: dict) -> None:
        """A whole text, shorter than the items of this size."""
        ids, counts, prints = self.by_size[size]
        width = size - m + 1
        if len(hit) * (1 + threshold) < threshold * (len(h) + width) - 1e-9:
            return
        mine = simhash(_signs(h).sum(axis=0)[None, :])
        for y in self._near(mine, prints)[1].tolist():
            self._keep(best, ids[y], similarity(h.tolist(), counts[y], width, threshold), 0, len(h) + m - 1, threshold)

    def _keep(self, best: dict, item, score: float, p: int, words: int, threshold: float) -> None:
        if score >= threshold and (item not in best or (-score, p) < (-best[item][0], best[item][1])):
            best[item] = (score, p, words)

    def _search(self, h: np.ndarray, hit: np.ndarray, low: int, last: int, total: np.ndarray, size: int, width: int, threshold: float, best: dict) -> None:
        """The windows of one size that hold a hit and begin from ``low`` to ``last``; hit: all hits in them; total: the sums of the signs of the shingles from ``low`` on."""
        ids, counts, prints = self.by_size[size]
        first = max(low, int(hit[0]) - width + 1)
        last = min(last, len(h) - width)
        if last < first:
            return
        hit = hit[hit < last + width]
        inside = np.zeros(last - first + 2, dtype=np.int32)
        np.add.at(inside, np.maximum(hit - width + 1, first) - first, 1)
        np.add.at(inside, np.minimum(hit, last) + 1 - first, -1)
        held = np.cumsum(inside)[: last - first + 1]  # hits in each window: at least its shingles in common with any item
        begin = np.flatnonzero((held > 0) & (held * (1 + threshold) >= 2 * threshold * width - 1e-9)) + first
        if not len(begin):
            return
        mine = simhash(total[begin - low + width] - total[begin - low])
        for x, y in zip(*(i.tolist() for i in self._near(mine, prints))):
            p = int(begin[x])
            self._keep(best, ids[y], similarity(h[p : p + width].tolist(), counts[y], width, threshold), p, size, threshold)


def similarity(window: list[int], item: Counter, total: int, least: float = 0.0) -> float:
    """Weighted Jaccard similarity of a window and an item of ``total`` shingles; 0 where it can't reach ``least``."""
    both = len(window) + total
    common = sum(s in item for s in window)
    if common * (1 + least) < least * both - 1e-9:
        return 0.0
    common = sum(min(c, item[s]) for s, c in Counter(window).items() if s in item)
    return common / (both - common)


def _find(broadcast, names: list[str], threshold: float, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = broadcast.value
        at_text, at_found = names.index("text"), names.index("matches")
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                data, at = utf8(part.column(at_text))
                starts, ends, first = spans(data, at)
                words = hashes(data, starts, ends)
                found: dict[int, dict] = defaultdict(dict)
                for m in index.shingles:
                    h, w_at = windows(words, first, m)
                    if m > 1:  # a text shorter than a shingle holds no window of an item
                        real = np.diff(first) >= m
                    else:
                        real = np.diff(first) > 0
                    hit = index.hits(h, m)
                    rows = np.searchsorted(w_at, hit, side="right") - 1
                    for r in np.unique(rows).tolist():
                        if real[r]:
                            found[r] |= index.search(h[w_at[r] : w_at[r + 1]], hit[rows == r] - w_at[r], m, threshold)
                before = part.column(at_found).to_pylist()
                for r, best in found.items():
                    before[r] = sorted((before[r] or []) + [{"item_id": i, "similarity": s, "first_word": p, "words": n} for i, (s, p, n) in best.items()], key=lambda x: x["item_id"])
                columns = list(part.columns)
                columns[at_found] = pa.array([x or [] for x in before], kind)
                yield pa.RecordBatch.from_arrays(columns, names)

    return work


def find_items(docs: DataFrame, items: DataFrame, *, words: int = 5, threshold: float = 0.8, most_words: int = 1_000_000) -> DataFrame:
    """docs with ``matches``: for each item of ``items`` (item_id, text) that a window of the text reaches, the best similarity and where it begins.

    At most ``most_words`` words of items are sent to the executors at once: more are taken in passes over the same rows.  A
    text shorter than an item is compared with it as a whole.  A null or empty text has no matches; an item without words, or with a null id, is never found.  An item of fewer words than a shingle is
    found as those words in a row.  Items that share an id are both looked for, and the better one reported; ids may be of any type that has an order, and keep it.  Other columns of docs
    are kept; a column ``matches`` is replaced.  An empty table on either side gives no matches.
    """
    kind = matches_of(items.schema["item_id"].dataType)
    out = docs.withColumn("matches", F.lit(None).cast(kind))
    known = items.select("item_id", "text").where("item_id is not null and text is not null").withColumn("n", F.size(F.split("text", r"\s+")))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    passes = max(1, -(-total // most_words))
    for i in range(passes):
        part = known.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).select("item_id", "text").collect()
        index = Index([r[0] for r in part], [r[1] for r in part], words)
        if index.by_size:
            sent = docs.sparkSession.sparkContext.broadcast(index)
            out = out.mapInArrow(_find(sent, out.columns, threshold, to_arrow_type(kind)), out.schema)
    return out.withColumn("matches", F.coalesce("matches", F.array().cast(kind)))


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs, with their own columns, in which no item is found."""
    return with_own_columns(docs, ["matches"], lambda d: find_items(d, items, **how).where(F.size("matches") == 0))
