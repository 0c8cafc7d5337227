"""Spelling variants grouped by a dictionary of trie-node pairs.

Two words are near if one inserted, deleted or replaced code point makes one of the other.  A rare word whose most frequent near word
occurs far more often takes it as its form; forms are followed to a root.

1. Words are counted once, in tasks first; the sorted words and the sorted reversed words number the nodes of a forward and a reversed trie.
   In a sorted range of words a word shares the nodes of its common prefix with the word before it, and the rest are new, so numbers come from
   one pass.  Where a range begins, its first word's common prefix with the range before keeps the numbers it has there: one word and
   its nodes for each range is all that the driver sees.
2. A word is, at each of its positions, the pair (node of what stands before, node of what stands after): with the position
   skipped, and with nothing skipped, where another word may have a code point more.
3. Equal pairs meet.  All words that meet by skipping differ in that place alone; a word that skips nothing lacks the place of those that do.
   A pair has at most a word for each code point of the alphabet and one without, so no group grows with the words.
   A code point of a run of equal ones counts as inserted in the run's last place only, so that each near pair is found once.
4. Of each word, the counts are summed and the best near word is kept; roots are found by jumping to the form's form until nothing changes,
   which ends as each step raises the count ``ratio`` times.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import changes, whole_groups
from .tables import stored

# The letters of a run, all of them bytes of Latin-1; every other character becomes one that is none
RUN = rb"[A-Za-z\xc0-\xff]"

_HELD = 1 << 18
_RANGE = 40  # bits of a number within its range of words


def _counter(least: int, damaged_in: int | None):
    run = re.compile(RUN + b"{%d,}" % least)

    def batch(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for part in batches:
            for doc, text in zip(part.column(0), part.column(1)):
                if not text.is_valid:
                    continue
                begun = zlib.crc32(f"{'' if not doc.is_valid else doc.as_py()}:".encode())
                for word, times in Counter(run.findall(text.as_py().encode("latin-1", "replace").lower())).items():
                    if damaged_in:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                        if not h % damaged_in:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    total[word] = total.get(word, 0) + times
                if len(total) > _HELD:
                    yield batch(total)
                    total = {}
        yield batch(total)

    return work


def word_counts(docs: DataFrame, *, least: int = 7, damaged_in: int | None = None) -> DataFrame:
    """Maximal runs of letters of whole texts, A-Z in lower case, of at least ``least`` code points: columns word, n (occurrences).

    With ``damaged_in`` a run whose crc32 of ``doc_id:run`` it divides loses its code point at that value modulo its length, before lengths
    count.  (A shorter run can't become long enough, so only long ones are looked at.)  A null doc_id counts as an empty one; a null text has no runs.
    """
    return docs.select("doc_id", "text").mapInArrow(_counter(least, damaged_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted words (column 0) each word's place and the numbers of its prefixes' nodes, the root left out, within this range."""
    part, place, made = TaskContext.get().partitionId(), 0, 0
    before, path = "", array("q")
    for batch in batches:
        for low in range(0, batch.num_rows, 8192):
            piece = batch.slice(low, 8192)
            nodes, ends = array("q"), array("q", [0])
            for word in piece.column(0).to_pylist():
                same = _common(before, word)
                path = path[:same]
                path.extend(range(made + 1, made + 1 + len(word) - same))
                made += len(word) - same
                nodes.extend(path)
                ends.append(len(nodes))
                before = word
            lists = pa.LargeListArray.from_arrays(pa.array(np.frombuffer(ends, np.int64)), pa.array(np.frombuffer(nodes, np.int64) if len(nodes) else np.zeros(0, np.int64))).cast(pa.list_(pa.int64()))
            places = pa.array(np.arange(place, place + piece.num_rows))
            place += piece.num_rows
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(piece.num_rows, part, np.int64)), places, lists], [*piece.schema.names, "part", "place", "nodes"])


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _carried(numbered: DataFrame, key: str) -> dict[int, np.ndarray]:
    """For each range, the numbers that the first prefixes of its first word have in the ranges before it.  Collects two words of each range."""
    edge = numbered.groupBy("part").agg(F.min_by(key, "place").alias("first"), F.max_by(key, "place").alias("last"), F.max_by("nodes", "place").alias("nodes"))
    out, before, path = {}, "", np.zeros(0, np.int64)
    for row in sorted(edge.collect(), key=lambda r: r.part):
        out[row.part] = path[: _common(before, row.first)]
        before, path = row.last, _global(np.array(row.nodes, np.int64), np.full(len(row.nodes), row.part), out)
    return out


def _global(nodes: np.ndarray, part: np.ndarray, carried: dict[int, np.ndarray]) -> np.ndarray:
    """Numbers that hold in all ranges: a range's first word has the nodes 1, 2, ..., so the carried ones are the least of it."""
    out = (part << _RANGE) + nodes
    for k in np.unique(part).tolist():
        mine = np.flatnonzero((part == k) & (nodes <= len(carried[k])))
        out[mine] = carried[k][nodes[mine] - 1]
    return out


def _pairs(carried: dict[int, np.ndarray], reverse: dict[int, np.ndarray]):
    """Rows (before, after, tag, n): tag is the word's number, whether the place is skipped, and whether it is its run's last."""

    def path(lists: pa.Array, parts: pa.Array, known: dict[int, np.ndarray], size: np.ndarray) -> np.ndarray:
        """Each word's nodes after a root of number 0, all in one."""
        own = lists.flatten().to_numpy()
        out = np.zeros(len(own) + len(size), np.int64)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(size + 1) - size - 1] = False
        out[inside] = _global(own, np.repeat(parts.to_numpy(), size), known)
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                word, wid, n = batch.column("word").to_pylist(), batch.column("wid").to_numpy(), batch.column("n").to_numpy()
                size = np.array([len(w) for w in word], np.int64)
                before = path(batch.column("nodes"), batch.column("part"), carried, size)
                after = path(batch.column("back"), batch.column("back_part"), reverse, size)
                point = np.frombuffer("".join(word).encode("utf-32-le", "surrogatepass"), np.uint32)
                start = np.cumsum(size + 1) - size - 1
                own = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                last = at == size[own] - 1
                last[:-1] |= point[1:] != point[:-1]
                skip = [before[start[own] + at], after[start[own] + size[own] - at - 1], wid[own] * 4 + 2 + last, n[own]]
                own = np.repeat(np.arange(len(size)), size + 1)
                at = np.arange(len(own)) - start[own]
                full = [before[start[own] + at], after[start[own] + size[own] - at], wid[own] * 4, n[own]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(skip, full)], ["before", "after", "tag", "n"])

    return work


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word that meets others at a pair: how many it is near to there, and the best of them."""
    for table in whole_groups(batches, most=1 << 16):
        before, after, tag, n = (table.column(c).to_numpy() for c in ("before", "after", "tag", "n"))
        first = changes(before, after)
        size = np.diff(np.append(first, len(tag)))
        some = np.repeat(size > 1, size)
        group, tag, n = np.repeat(np.arange(len(first)), size)[some], tag[some], n[some]
        if not len(tag):
            continue
        order = np.lexsort((tag, -n, group))  # within a group the best comes first
        group, tag, n = group[order], tag[order], n[order]
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
        skipped, last, row = tag % 4 >= 2, tag % 4 == 3, np.arange(len(tag))
        none = len(tag)

        def best(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The first and the second of these rows in each group."""
            out = np.full((2, group[-1] + 1), none)
            head = rows[changes(group[rows])] if len(rows) else rows
            out[0, group[head]] = head
            rest = rows[~np.isin(rows, head)]
            head = rest[changes(group[rest])] if len(rest) else rest
            out[1, group[head]] = head
            return out[0], out[1]

        one, two = best(row[skipped])
        ends, _ = best(row[last])
        full, _ = best(row[~skipped])
        n_skipped, n_last, n_full = (np.bincount(group[x], minlength=group[-1] + 1) for x in (skipped, last, ~skipped))
        count = np.where(skipped, n_skipped[group] - 1 + last * n_full[group], n_last[group])
        other = np.where(one[group] == row, two[group], one[group])
        chosen = np.where(skipped, np.where(last, np.minimum(other, full[group]), other), ends[group])
        out = np.flatnonzero(count > 0)
        chosen = chosen[out]
        yield pa.RecordBatch.from_arrays([pa.array(tag[out] >> 2), pa.array(count[out].astype(np.int64)), pa.array(n[chosen]), pa.array(tag[chosen] >> 2)], ["wid", "n_near", "best_n", "best"])


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (wid, root) of rows (wid, form): the last word that forms lead to."""
    now = stored(forms.select("wid", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(on, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("wid", "root")
        now = step.select("wid", "root")


def spelling_forms(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """The form and root of every word of ``words`` (columns word, n; others are not read; words stand once).

    Columns: word; form (of the words near to it the one of largest n, of equal ones the least by code points, if its n is at least ``ratio`` times
    the word's; else null); root (the last that forms lead to, the word itself without a form); n; n_near (near words, 0 without); form_n.

    Words are any strings, compared by code points; an empty word is near to every word of one code point.  Rows with a null word or n are left out.
    An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, else forms can lead in a circle")
    words = words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n"))
    forward = words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_numbered, "word string, n long, part long, place long, nodes array<long>")
    forward = stored(forward.withColumn("wid", F.shiftleft("part", _RANGE) + F.col("place")), "forward")
    backward = forward.select(F.reverse("word").alias("drow"), "wid").repartitionByRange("drow").sortWithinPartitions("drow")
    backward = stored(backward.mapInArrow(_numbered, "drow string, wid long, part long, place long, nodes array<long>"), "backward")
    both = forward.select("wid", "word", "n", "part", "nodes").join(backward.select("wid", F.col("part").alias("back_part"), F.col("nodes").alias("back")), "wid")
    pairs = both.mapInArrow(_pairs(_carried(forward, "word"), _carried(backward, "drow")), "before long, after long, tag long, n long")
    met = pairs.repartition("before", "after").withColumn("grp", F.xxhash64("before", "after")).sortWithinPartitions("grp", "before", "after")
    found = met.mapInArrow(_near, "wid long, n_near long, best_n long, best long")
    found = found.groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("behind"))).alias("b"))
    found = stored(found.select("wid", "n_near", F.col("b.best_n").alias("best_n"), (-F.col("b.behind")).alias("best")), "near")
    own = forward.select("wid", "word", "n").join(found, "wid", "left").withColumn("form", F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best")))
    own = stored(own.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(own.where("form is not null").select("wid", "form"))
    names = own.select("wid", "word")
    led = own.where("form is not null").select("wid", "form").join(roots, "wid")
    led = led.join(names.select(F.col("wid").alias("form"), F.col("word").alias("form_word")), "form").join(names.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root")
    out = own.drop("form").join(led.select("wid", "form_word", "root_word"), "wid", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
