"""N-gram Jaccard join by chosen paths.

Texts are sets of word shingles; two texts are linked if their sets' Jaccard similarity reaches
the threshold.  Texts with equal sets form one class, and only classes take part in the join.

1. One pass over the texts makes, for every text, a digest of its set, a minhash sketch of one
   byte a lane, and for every run the paths it takes: a set goes down a path's child for each of
   its shingles whose hash under (run, path) is under ``branch / size``.  So two sets share a child
   for about ``branch * overlap / larger size`` of their common shingles.
2. Level by level, a path that no more than ``leaf`` classes took is a leaf; a larger one is split by its children.
   At the last level a bucket of any size is a leaf, in blocks.
3. Leaves are compared all against all by sketch, in blocks of bounded size, and each leaf gives
   its members' local groups (one row a member, never its pairs).  Their union over all leaves and
   runs gives candidate groups.
4. Each candidate group is gathered once with whole sets and checked exactly, block by block: each
   class gets its number of links, and each block the groups that exact links make.

A pair at the threshold shares no path of a run with probability q, the extinction probability of
a branching process with Poisson(branch * B) children, B = 2 t / (1 + t); ``runs_for`` repeats runs until
1 - q^runs reaches the target recall.  Step 4 compares all pairs of a candidate group, so what it links is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import components, dropped, row_key, stored
from .words import mix, series, shingles

LEVELS = 3
LANES = 64
_RUN = series(64, 3)
_LANE = series(LANES, 4) | np.uint64(1)
_SCHEMA = "rkey long, node long, size int, sketch binary, l1 array<long>, l2 array<struct<parent:long,path:long>>, l3 array<struct<parent:long,path:long>>"


def runs_for(threshold: float, branch: float, recall: float) -> int:
    """Runs after which a pair at the threshold has shared a path with at least this probability."""
    mean, q = branch * 2 * threshold / (1 + threshold), 0.0
    for _ in range(LEVELS):
        q = math.exp(-mean * (1 - q))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def _digest(tokens: np.ndarray) -> np.uint64:
    """Of a set: equal sets have equal digests, others differ but for one chance in 2^64."""
    return mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) ^ (np.array([len(tokens)], np.uint64) * _LANE[0]))[0]


def _children(tokens: np.ndarray, paths: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Which path each child comes from, and the children's own paths."""
    if not len(paths):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    under = np.uint64(min(1.0, branch / len(tokens)) * (2**64 - 2**11))
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    step = max(1, (1 << 20) // len(tokens))
    for i in range(0, len(paths), step):
        h = (tokens[None, :] ^ paths[i : i + step, None]) * _LANE[1]
        h = (h ^ (h >> np.uint64(29))) * _LANE[2]
        h ^= h >> np.uint64(32)
        which, what = np.nonzero(h <= under)
        parts.append((which + i, mix(mix(tokens[what]) ^ (paths[which + i] * _LANE[3]))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sketch(tokens: np.ndarray) -> bytes:
    out = np.full(LANES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(tokens), 1 << 13):
        h = tokens[None, i : i + (1 << 13)] * _LANE[:, None]
        out = np.minimum(out, (h ^ (h >> np.uint64(31))).min(axis=1))
    return (mix(out) >> np.uint64(56)).astype(np.uint8).tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _signatures(words: int, branch: float, runs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("parent", pa.int64()), ("path", pa.int64())])
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, batch.num_rows, 512):
                h, at = shingles(batch.column(1).slice(low, 512), words)
                rows = []
                for i in range(len(at) - 1):
                    tokens = np.unique(h[at[i] : at[i + 1]])
                    if not len(tokens):
                        continue
                    root, one = _children(tokens, _RUN[:runs], branch)
                    up2, two = _children(tokens, one, branch)
                    up3, three = _children(tokens, two, branch)
                    pairs = [[{"parent": a, "path": b} for a, b in zip(_signed(p[u]).tolist(), _signed(c).tolist())] for p, u, c in ((one, up2, two), (two, up3, three))]
                    rows.append((keys[low + i], int(_digest(tokens).view(np.int64)), len(tokens), _sketch(tokens), _signed(one).tolist(), *pairs))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(kind), pa.list_(kind)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["rkey", "node", "size", "sketch", "l1", "l2", "l3"])

    return work


def _blocks(members: DataFrame, key: str, block: int, weight: Column, most: int) -> DataFrame:
    """Members of each key of two or more, in pairs of blocks: columns grp, side (which of the two blocks) and the rest.

    A key of more than ``block`` members, or of more than ``most`` weight, is dealt into blocks by
    its members' hashes; every pair of blocks is a group of its own, so a task never holds a large key whole.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w")).where("_n > 1")
    many = F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_w") / most)).cast("int")
    dealt = members.join(sizes.select(key, many.alias("_k")), key).withColumn("_b", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    dealt = dealt.withColumn("_o", other)
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    return dealt.select(F.xxhash64(F.col(key), low, high).alias("grp"), (F.col("_b") > F.col("_o")).cast("int").alias("side"), (F.col("_b") != F.col("_o")).alias("two"), *[c for c in members.columns if c != key])


def _groups(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream that is sorted by grp; as many small groups together as make about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        table = pa.Table.from_batches(held)
        grp = table.column("grp").to_numpy()
        cut = int(np.searchsorted(grp, grp[-1]))
        if cut:
            yield table.slice(0, cut)
        held, count = table.slice(cut).to_batches(), 0
    if held:
        yield pa.Table.from_batches(held)


def _local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within consecutive groups of these sizes."""
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.arange(sizes.sum())
    after = np.repeat(firsts + sizes, sizes) - left - 1
    a = np.repeat(left, after)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)


def _compare(least: float):
    """Local groups of each leaf, by sketch: rows (a, b) that join a member to the smallest of its group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = int(least * LANES)
        for table in _groups(batches):
            grp, node, side, two = (table.column(c).to_numpy() for c in ("grp", "node", "side", "two"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, LANES)
            order = np.lexsort((node, grp))
            grp, node, side, two, sketch = grp[order], node[order], side[order], two[order], sketch[order]
            starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            sizes = np.diff(np.append(starts, len(grp)))
            small = np.repeat(sizes <= 128, sizes)
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            rows = np.flatnonzero(small)
            kept = sizes[sizes <= 128]
            for i in range(0, len(kept), 512):  # bounded: at most 512 groups of at most 8,128 pairs at a time
                part = kept[i : i + 512]
                own = rows[kept[:i].sum() : kept[:i].sum() + part.sum()]
                a, b = _pairs(part)
                a, b = own[a], own[b]
                for j in range(0, len(a), 1 << 20):
                    x, y = a[j : j + (1 << 20)], b[j : j + (1 << 20)]
                    good = ((sketch[x] == sketch[y]).sum(axis=1) >= need) & (~two[x] | (side[x] != side[y]))
                    found_a.append(x[good])
                    found_b.append(y[good])
            for s, n in zip(starts[sizes > 128], sizes[sizes > 128]):
                for i in range(s, s + n):
                    same = np.flatnonzero((sketch[i + 1 : s + n] == sketch[i]).sum(axis=1) >= need) + i + 1
                    same = same[~two[same] | (side[same] != side[i])]
                    # a member that an earlier one already holds adds nothing but its own further links
                    found_a.append(np.full(len(same), i))
                    found_b.append(same)
            label = _local(len(node), np.concatenate(found_a), np.concatenate(found_b))
            moved = np.flatnonzero(node[label] != node)
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return work


def _exact(threshold: float):
    """Exact links of each block pair: per class its links there, and the smallest class of its local group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 256):
            grp = table.column("grp").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts, np.append(starts[1:], len(grp))):
                part = table.slice(s, e - s)
                node, first = np.unique(part.column("node").to_numpy(), return_index=True)
                side, two = (part.column(c).to_numpy()[first] for c in ("side", "two"))
                column = part.column("shingles")
                sets = [np.frombuffer(column[int(i)].as_py(), dtype=np.uint64) for i in first]
                size = np.array([len(x) for x in sets], dtype=np.int64)
                common = overlaps(sets)
                near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
                np.fill_diagonal(near, False)
                if two.any():
                    near &= side[:, None] != side[None, :]
                a, b = np.nonzero(np.triu(near))
                out.append((node, near.sum(axis=1), node[_local(len(node), a, b)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], ["node", "links", "root"])

    return work


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, in blocks of shared shingles."""
    n = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((n, n))
    np.fill_diagonal(common, [len(x) for x in sets])
    if not len(column):
        return common
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    common[:] = 0
    width = max(1, (1 << 22) // n)
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        there = np.zeros((n, min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
        there[owner[a:b], column[a:b] - low] = 1
        common += there @ there.T
    return common


def jaccard_join(
    docs: DataFrame, *, words: int = 5, threshold: float = 0.8, recall: float = 0.999, branch: float = 2.0, leaf: int = 4096, block: int = 512, block_shingles: int = 1 << 21
) -> DataFrame:
    """Links of near-equal texts: one row per row of ``docs`` (columns doc_id and text; others are not read).

    Columns: rkey long (a key of the row, equal for equal rows), doc_id, class_id (the smallest doc_id of the
    row's group of linked texts), n_links long (other classes linked to the row's class: a class is the texts of one
    shingle set), n_copies long (rows in its class), is_first boolean (the group's first row by doc_id, nulls last,
    then rkey).

    Words are split at white space and kept as they are.  A text of fewer words than a shingle has one
    shingle of all its words.  A null or empty text has no shingles: it is a group of its own, with class_id its
    doc_id, no links, n_copies 1 and is_first true.  Rows with a null doc_id take part like others; class_id is null only if the whole
    group has none.  Equal rows share every column.  An empty table gives an empty result.
    """
    runs = runs_for(threshold, branch, recall)
    rows = docs.select(row_key().alias("rkey"), "doc_id", "text")
    signed = rows.select("rkey", "text").mapInArrow(_signatures(words, branch, runs), _SCHEMA)
    signed = stored(signed, "signatures")
    own = signed.groupBy("node").agg(F.min(F.struct("rkey", "size", "sketch", "l1", "l2", "l3")).alias("s")).select("node", "s.*")
    own = stored(own, "classes")

    leaves = None
    level = own.select(F.explode("l1").alias("path"), "node")
    for depth in range(1, LEVELS + 1):
        counts = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        taken = counts if depth == LEVELS else counts.where(F.col("n") <= leaf)
        found = level.join(taken.select("path"), "path")
        leaves = found if leaves is None else leaves.union(found)
        if depth < LEVELS:
            large = counts.where(F.col("n") > leaf).select(F.col("path").alias("parent"))
            below = own.select(F.explode(f"l{depth + 1}").alias("c"), "node").select("c.parent", "c.path", "node")
            level = below.join(large, "parent").select("path", "node")
    leaves = stored(leaves, "leaves")
    members = leaves.join(own.select("node", "sketch"), "node")
    blocks = _blocks(members, "path", leaf, F.lit(0), 1)  # a sketch is 64 bytes
    near = blocks.repartition("grp").sortWithinPartitions("grp").mapInArrow(_compare(threshold - 0.2), "a long, b long")
    near = stored(near.distinct(), "candidates")
    groups = stored(components(near), "groups")
    dropped(leaves, near)

    first = own.select("node", "rkey").join(groups, "node")
    texts = rows.join(first, "rkey")
    sets = texts.select("comp", "node", "text").mapInArrow(_sets(words), "comp long, node long, shingles binary")
    sets = stored(sets, "sets")
    dropped(own, groups)
    size = F.length("shingles") / 8
    blocks = _blocks(sets, "comp", block, size, block_shingles)
    checked = blocks.repartition("grp").sortWithinPartitions("grp").mapInArrow(_exact(threshold), "node long, links long, root long")
    checked = stored(checked, "checked")
    dropped(sets)
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = stored(components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "linked")

    by_row = rows.select("rkey", "doc_id").join(signed.select("rkey", "node").distinct(), "rkey", "left")
    by_row = by_row.join(linked, "node", "left").join(links, "node", "left")
    group = F.coalesce("comp", "node")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rkey")
    by_row = by_row.withColumn("grp", F.when(F.col("node").isNull(), F.col("rkey")).otherwise(group)).withColumn("empty", F.col("node").isNull())
    best = by_row.where("not empty").groupBy("grp").agg(F.min(order).alias("best"))
    copies = by_row.where("not empty").groupBy("node").agg(F.count("*").alias("n_copies"))
    out = by_row.join(best, "grp", "left").join(copies, "node", "left")
    return out.select(
        "rkey",
        "doc_id",
        F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.col("empty") | (F.col("best.rkey") == F.col("rkey"))).alias("is_first"),
    )


def _sets(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                h, at = shingles(part.column(2), words)
                sets = [np.unique(h[at[i] : at[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["comp", "node", "shingles"])

    return work


def first_of_groups(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their group; equal rows count once.  Rows without words stay."""
    keep = jaccard_join(docs, **how).where("is_first").select("rkey").distinct()
    keyed = docs.withColumn("rkey_of_join", row_key())
    return keyed.join(keep.withColumnRenamed("rkey", "rkey_of_join"), "rkey_of_join").dropDuplicates(["rkey_of_join"]).drop("rkey_of_join")
