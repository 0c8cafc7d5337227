"""MinHash near-duplicates by a multi-index Hamming join.

Texts are sets of word shingles; two are linked if their Jaccard similarity reaches the threshold.  Equal sets form one class.

1. A class's signature is, for each of 64 lanes, the lowest 8 bits of the least hash of its shingles.  A lane of two sets differs with
   a probability of at most one less their similarity, so a pair at the threshold differs in more than ``radius`` lanes with probability under 10^-6.
2. Signatures are split into chunks so many that a pair within the radius has one chunk with at most ``errors`` different lanes (the pigeonhole).
   A class has a key for each chunk and each choice of ``errors`` lanes left out of it: all pairs within the radius share a key, whatever the lanes that differ.
3. The classes of a key are compared with its least class, the hub, by signature.  Keys whose classes are not all joined by that are compared whole,
   in blocks dealt over tasks.  A class near to a block's first needs no other comparison there.  Only one edge a class leaves a block.
4. Groups so joined are checked on whole sets: classes with their hubs first, then, where a group is not one component of exact links, all classes outside its
   largest component with all of the group, in pairs of blocks.  A pair of one component is never compared, so groups of near copies cost what they have rows.

Exact links alone make the components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard_join import overlaps
from .streams import changes, whole_groups
from .tables import components, dropped, row_key, stored
from .words import SPACE, fold, hashes, mix, series, spans, utf8, windows

LANES = 64
_LANE = series(LANES, 14) | np.uint64(1)
_SPREAD = series(LANES, 15)
_VALUE = series(256, 1)
_VALUE[SPACE] = 0
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def radius(threshold: float, miss: float = 1e-6) -> int:
    """Lanes in which two sets at the threshold differ, exceeded with a probability of at most ``miss``."""
    p, over = 1 - threshold, 1.0
    for t in range(LANES):
        over -= comb(LANES, t) * p**t * (1 - p) ** (LANES - t)
        if over <= miss:
            return t
    return LANES


def masks(within: int, errors: int) -> list[list[int]]:
    """The lanes of every key: each chunk without each choice of ``errors`` lanes; two signatures that differ in ``within`` lanes or fewer agree on one of these."""
    chunks = within // (errors + 1) + 1
    out = []
    for i in range(chunks):
        lanes = range(i, LANES, chunks)
        if len(lanes) <= errors:
            raise ValueError("the radius leaves no lane in a chunk; take fewer errors or a higher threshold")
        out += [sorted(set(lanes) - set(gone)) for gone in itertools.combinations(lanes, errors)]
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles, A-Z in lower case."""
    data, at = utf8(column)
    starts, ends, first = spans(data, at)
    h, at = windows(hashes(data, starts, ends, _VALUE), first, words)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def signature(tokens: np.ndarray) -> np.ndarray:
    out = np.full(LANES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(tokens), 1 << 12):
        h = tokens[None, i : i + (1 << 12)] * _LANE[:, None]
        out = np.minimum(out, (h ^ (h >> np.uint64(31))).min(axis=1))
    return (mix(out) >> np.uint64(56)).astype(np.uint8)


def _signatures(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sets = _sets(part.column(1), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                there = np.flatnonzero(sizes)
                node = [fold(mix(sets[i]), np.array([0]))[0] if len(sets[i]) else 0 for i in there]
                sketch = [signature(sets[i]).tobytes() for i in there]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(there)), pa.array(_signed(mix(np.array(node, np.uint64)))), pa.array(sizes[there]), pa.array(sketch, pa.binary())], ["rkey", "node", "size", "sketch"])

    return work


def _probes(lanes: list[list[int]]):
    """Rows (deal, key, node, hub, many) of every class and key.

    Classes that share a key within a batch meet at once: the least of them stands for the others (hub), and is alone dealt out by
    the key; so a key that very many classes share sends a row a batch to its task.
    """

    salt = series(len(lanes), 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                node = batch.column("node").to_numpy()
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, LANES)
                term = mix((sketch.astype(np.uint64) + np.uint64(1)) * _SPREAD[None, :])
                keys = np.concatenate([mix(term[:, own].sum(axis=1, dtype=np.uint64) ^ salt[i : i + 1]) for i, own in enumerate(lanes)])
                nodes = np.tile(node, len(lanes))
                order = np.lexsort((nodes, keys))
                keys, nodes = keys[order], nodes[order]
                first = changes(keys)
                size = np.diff(np.append(first, len(keys)))
                hub = np.repeat(nodes[first], size)
                many = np.repeat(size > 1, size)
                own = np.zeros(len(keys), bool)
                own[first] = True
                deal = np.where(own, keys, mix(keys ^ nodes.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(deal)), pa.array(_signed(keys)), pa.array(nodes), pa.array(hub, mask=own), pa.array(many)], ["deal", "key", "node", "hub", "many"])

    return work


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, hub) of keys that two classes or more share, of a stream sorted by deal and node."""
    for table in whole_groups(batches, "deal", 1 << 16):
        table = table.combine_chunks()
        key, node, many = (table.column(c).to_numpy() for c in ("key", "node", "many"))
        inner = ~table.column("hub").is_null().to_numpy(zero_copy_only=False)
        hub = table.column("hub").fill_null(0).to_numpy()
        rows = np.flatnonzero(~inner)
        order = rows[np.lexsort((node[rows], key[rows]))]
        if len(order):
            first = changes(key[order])
            size = np.diff(np.append(first, len(order)))
            hub = hub.copy()
            hub[order] = np.repeat(node[order[first]], size)
            many = many.copy()
            many[order] |= np.repeat(size > 1, size)
        keep = inner | many
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(hub[keep])], ["key", "node", "hub"])


def _within(most: int):
    """Of rows (node, hub, sketch, other): those whose sketches differ in at most so many lanes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LANES) for c in ("sketch", "other"))
            near = np.flatnonzero((a != b).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(near)), batch.column("hub").take(pa.array(near))], ["a", "b"])

    return work


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n members' component."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for x in (a, b):
            np.minimum.at(label, x, low)
            np.minimum.at(label, before[x], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(most: int):
    """Of each group the edges (a, b) that join a member to the least of its local group; groups of members within so many lanes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            grp, node = table.column("grp").to_numpy(), table.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, LANES)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            first = changes(grp)
            for s, e in zip(first, np.append(first[1:], len(grp))):
                own = sketch[s:e]
                near = (own != own[0]).sum(axis=1) <= most
                a.append(np.flatnonzero(near) + s)
                b.append(np.full(int(near.sum()), s))
                for i in np.flatnonzero(~near):  # near to the first or not, each of the rest may be near to it
                    found = np.flatnonzero((own != own[i]).sum(axis=1) <= most) + s
                    a.append(found)
                    b.append(np.full(len(found), s + i))
            label = _roots(len(node), np.concatenate(a), np.concatenate(b))
            moved = np.flatnonzero(node[label] != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return work


def _linked(least: int):
    """Of each group the exact links between its side 0 and its side 1, as edges (a, b) to the least of each local component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, most=64):
            table = table.combine_chunks()
            grp, node, side = (table.column(c).to_numpy() for c in ("grp", "node", "side"))
            column = table.column("shingles")
            first = changes(grp)
            out_a, out_b = [], []
            for s, e in zip(first, np.append(first[1:], len(grp))):
                sets = [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in range(s, e)]
                size = np.array([len(x) for x in sets], np.int64)
                left, right = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
                if not len(left) or not len(right):
                    continue
                if len(left) == 1:
                    mine, others = sets[left[0]], [sets[i] for i in right]
                    every = np.concatenate(others)
                    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                    hit = np.concatenate([[0], np.cumsum(mine[at] == every)])
                    ends = np.cumsum([len(x) for x in others])
                    common = (hit[ends] - hit[ends - size[right]])[None, :]
                else:
                    common = overlaps(sets).astype(np.int64)[np.ix_(left, right)]
                near = common * (100 + least) >= least * (size[left][:, None] + size[right][None, :])
                near &= node[s:e][left][:, None] != node[s:e][right][None, :]
                x, y = np.nonzero(near)
                # a class may stand on both sides: its rows are one member
                name, member = np.unique(node[s:e], return_inverse=True)
                label = _roots(len(name), member[left[x]], member[right[y]])
                moved = np.flatnonzero(label != np.arange(len(name)))
                out_a.append(name[moved])
                out_b.append(name[label[moved]])
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + out_a)), pa.array(np.concatenate(none + out_b))], ["a", "b"])

    return work


def _whole_sets(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in _sets(part.column(1), words)], pa.binary())], ["node", "shingles"])

    return work


def _parts(n: str | Column, weight: str | Column, block: int, heavy: int) -> Column:
    """How many blocks a group is dealt into."""
    n, weight = (F.col(x) if isinstance(x, str) else x for x in (n, weight))
    return F.greatest(F.ceil(n / block), F.ceil(weight / heavy), F.lit(1)).cast("int")


def _dealt(key: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(13)), F.col(parts)).cast("int")


def _each(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _check(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Exact links of members (grp, side, node)."""
    with_sets = members.join(sets, "node").select("grp", "side", "node", "shingles")
    return with_sets.repartition("grp").sortWithinPartitions("grp").mapInArrow(_linked(least), "a long, b long")


def _near_classes(own: DataFrame, most: int, errors: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of classes near to a hub by signature; and edges that with them join all that are within ``most`` lanes."""
    sketches = own.select("node", "sketch")
    probes = sketches.mapInArrow(_probes(masks(most, errors)), "deal long, key long, node long, hub long, many boolean")
    met = stored(probes.repartition("deal").sortWithinPartitions("deal").mapInArrow(_met, "key long, node long, hub long"), "met")
    stars = met.where("node <> hub").select("node", "hub").distinct()
    stars = stars.join(sketches, "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("other")), "hub")
    stars = stored(stars.select("node", "hub", "sketch", "other").mapInArrow(_within(most), "a long, b long"), "stars")
    joined = stored(components(stars), "joined")
    labelled = met.select("key", "node").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    keys = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low <> high")
    dealt = met.select("key", "node").join(keys.select("key", _parts("n", F.lit(0), leaf, 1).alias("parts")), "key")
    mine, other = _dealt("node", "parts"), F.col("other")
    dealt = dealt.withColumn("mine", mine).withColumn("other", _each("parts"))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", other), F.greatest("mine", other)).alias("grp"), "node").join(sketches, "node")
    more = dealt.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(_compare(most), "a long, b long")
    more = stored(more.distinct(), "more")
    dropped(met, joined)
    return stars, more


def near_duplicates(docs: DataFrame, *, words: int = 3, percent: int = 85, errors: int = 1, leaf: int = 4096, block: int = 256, heavy: int = 1 << 20) -> DataFrame:
    """Components of near-equal texts: one row per row of ``docs`` (columns doc_id and text; others are not read).

    Columns: rkey long (a key of the row, equal for equal rows), doc_id, n_shingles long, component_id (the smallest doc_id of the row's component,
    nulls left out), kept boolean (doc_id is component_id).

    Words are split at white space, A-Z in lower case.  Two texts are linked if 100 times the shingles they share reach ``percent`` times those of both.  A text of
    fewer words than a shingle has one shingle of all its words; a null, empty or blank text has none, is linked with nothing, and is a component of its own.  A row with a null doc_id takes part;
    component_id is null, and kept true, where the whole component has none.  Rows that share a doc_id but not their text are separate.  An
    empty table gives an empty result.
    """
    most = radius(percent / 100)
    rows = docs.select(row_key().alias("rkey"), "doc_id", "text")
    signed = stored(rows.select("rkey", "text").mapInArrow(_signatures(words), "rkey long, node long, size long, sketch binary"), "signed")
    own = stored(signed.groupBy("node").agg(F.min(F.struct("rkey", "size", "sketch")).alias("s")).select("node", "s.*"), "classes")
    stars, more = _near_classes(own, most, errors, leaf)
    groups = stored(components(stars.union(more)), "groups")

    some = own.select("node", "rkey", "size").join(groups, "node")
    texts = rows.select("rkey", "text").join(some.select("rkey", "node"), "rkey").dropDuplicates(["rkey"])
    sets = stored(texts.select("node", "text").mapInArrow(_whole_sets(words), "node long, shingles binary"), "sets")

    sizes = own.select(F.col("node").alias("a"), "size")
    hubs = stars.join(sizes, "a").groupBy("b").agg(F.count("*").alias("n"), F.sum("size").alias("w")).select("b", _parts("n", "w", block, heavy).alias("parts"))
    named = F.xxhash64("b", "part", F.lit(1)).alias("grp")
    arms = stars.join(hubs, "b").withColumn("part", _dealt("a", "parts")).select(named, F.lit(1).alias("side"), F.col("a").alias("node"))
    tops = hubs.withColumn("part", _each("parts")).select(named, F.lit(0).alias("side"), F.col("b").alias("node"))
    links = stored(_check(arms.union(tops), sets, percent), "links")
    joined = stored(components(links), "joined")

    labelled = stored(some.join(joined.withColumnRenamed("comp", "own"), "node", "left").select("node", "size", F.col("comp").alias("grp_id"), F.coalesce("own", "node").alias("own")), "labelled")
    counts = labelled.groupBy("grp_id", "own").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    whole = counts.groupBy("grp_id").agg(F.max(F.struct("n", "own", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    whole = whole.select("grp_id", F.col("top.own").alias("main"), _parts("n", "w", block, heavy).alias("across"), _parts(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"), block, heavy).alias("down"))
    apart = labelled.join(whole, "grp_id")
    named = F.xxhash64("grp_id", "row", "column", F.lit(2)).alias("grp")
    right = apart.withColumn("column", _dealt("node", "across")).withColumn("row", _each("down")).select(named, F.lit(1).alias("side"), "node")
    left = apart.where("own <> main").withColumn("row", _dealt("node", "down")).withColumn("column", _each("across")).select(named, F.lit(0).alias("side"), "node")
    rest = stored(_check(left.union(right), sets, percent), "links")
    comps = stored(components(links.union(rest)), "components")
    dropped(stars, more, groups, sets, joined, labelled, links, rest)

    by_row = rows.select("rkey", "doc_id").join(signed.select("rkey", "node", "size").dropDuplicates(["rkey"]), "rkey", "left").join(comps, "node", "left")
    by_row = by_row.withColumn("grp", F.coalesce("comp", "node"))
    least = by_row.where("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("least"))
    out = by_row.join(least, "grp", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("rkey", "doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
