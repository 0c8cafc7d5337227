"""Alignment of two recordings: piecewise between key positions, or by dynamic time warping of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.functions import pose as P
from motion_tables.operators import windows as W

KEY = "video_id"


def piecewise(pairs: DataFrame, names: list[str]) -> DataFrame:
    """pair_id, user_frame, ref_frame: straight lines between the named positions u_<name> and r_<name>, which both sides pass; a phase that is empty on a side is left out."""
    phases = []
    for i, (a, b) in enumerate(zip(names, names[1:])):
        u, r = F.col(f"u_{b}") - F.col(f"u_{a}"), F.col(f"r_{b}") - F.col(f"r_{a}")
        phases.append(F.struct(F.lit(0 if i == 0 else 1).alias("first"), F.col(f"u_{a}").alias("u0"), F.col(f"r_{a}").alias("r0"), u.alias("u"), r.alias("r")))
    p = pairs.select("pair_id", F.explode(F.array(*phases)).alias("s")).select("pair_id", "s.*").where("u > 0 and r > 0")
    p = p.select("*", F.explode(F.sequence("first", "u")).alias("i"))
    return p.select("pair_id", (F.col("u0") + F.col("i")).alias("user_frame"), (F.col("r0") + F.floor(F.col("i") / F.col("u") * F.col("r")).cast("int")).alias("ref_frame"))


def two_phase(pairs: DataFrame) -> DataFrame:
    """pair_id, user_frame, ref_frame of pairs (pair_id, u_frames, u_impact, r_frames, r_impact) in two straight lines, up to the impact and after it; a phase that is empty on a side is left out."""
    frame = F.col("user_frame")
    before = pairs.where("u_impact > 0 and r_impact > 0").select("pair_id", "u_impact", "r_impact", F.explode(F.sequence(F.lit(0).cast("long"), F.col("u_impact").cast("long"))).alias("user_frame"))
    before = before.select("pair_id", "user_frame", F.floor(frame / F.col("u_impact") * F.col("r_impact")).cast("long").alias("ref_frame"))
    rest = lambda k: F.col(f"{k}_frames") - 1 - F.col(f"{k}_impact")
    after = pairs.where((rest("u") > 0) & (rest("r") > 0)).select("pair_id", "u_impact", "r_impact", rest("u").alias("u"), rest("r").alias("r"), F.explode(F.sequence(F.lit(1).cast("long"), rest("u").cast("long"))).alias("i"))
    after = after.select("pair_id", (F.col("u_impact") + F.col("i")).alias("user_frame"), (F.col("r_impact") + F.floor(F.col("i") / F.col("u") * F.col("r"))).cast("long").alias("ref_frame"))
    return before.unionByName(after)


#: Rows 0 to 3 of the projection of seven values on a quadratic, times 42.
_QUADRATIC = [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6], [-4, 6, 12, 14, 12, 6, -4]]


def smoothed(p: DataFrame) -> DataFrame:
    """Landmarks after Savitzky-Golay smoothing (window 7, order 2) of each coordinate; the ends come from the fit of the first or last seven frames, and a recording under seven stays.

    A frame's coordinates stay together as one array: six frames before and after it are all that one window over the recording looks at.
    """
    w = W.by()
    s = p.select(KEY, "frame", "t_ms", "lm", F.flatten(F.transform("lm", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("_0"))
    s = s.withColumns({f"_{k}": F.lag("_0", -k).over(w) for k in range(-6, 7) if k})
    there = sum((F.col(f"_{k}").isNotNull().cast("int") for k in range(-6, 7)), F.lit(0))

    def fit(first: int, step: int, row: int) -> Column:
        return F.array(*[F.struct(F.lit(float(c)).alias("c"), F.col(f"_{first + step * k}").alias("v")) for k, c in enumerate(_QUADRATIC[row])])

    seven = F.when(there < 7, None)
    for i in range(3):
        seven = seven.when(F.col(f"_{-1 - i}").isNull(), fit(-i, 1, i)).when(F.col(f"_{1 + i}").isNull(), fit(i, -1, i))
    s = s.withColumn("_s", seven.otherwise(fit(-3, 1, 3)))
    value = lambda at: F.aggregate("_s", F.lit(0.0), lambda total, x: total + F.get(x["v"], at) * x["c"]) / 42
    lm = F.transform("lm", lambda _, j: F.struct(*[value(j * 3 + i).alias(a) for i, a in enumerate("xyz")]))
    return s.select(KEY, "frame", "t_ms", F.when(F.col("_s").isNull(), F.transform("lm", lambda q: F.struct(*[q[a].cast("double").alias(a) for a in "xyz"]))).otherwise(lm).alias("lm"))


def features(p: DataFrame) -> DataFrame:
    """video_id, frame, features: normalised coordinates of all landmarks, the seven angles and the wrist speed of smoothed poses."""
    s = W.wrist_velocity(smoothed(p))
    coordinates = F.flatten(F.transform(P.normalized(F.col("lm")), lambda q: F.array(q["x"], q["y"], q["z"])))
    rest = F.array(*P.angles(F.col("lm")).values(), F.col("velocity"))
    return s.select(KEY, "frame", F.concat(coordinates, rest).alias("features"))


#: Columns whose costs a band works out at once, rows of a band of a pair that is kept whole, and what blocks of costs are filled up to multiples of.
WIDE, BAND, EVEN = 128, 512, 64


def _costs(a: np.ndarray, b: np.ndarray, square_a: np.ndarray, square_b: np.ndarray) -> np.ndarray:
    """Distances of all vectors of a from all of b, as one product of matrices; where that would cancel, from the differences, so that equal vectors are at 0.

    Blocks are filled up, so that equal pairs of vectors cost the same at every place: ties stay ties.
    """
    n, m = len(a), len(b)
    fill = lambda v: np.concatenate([v, np.zeros((-len(v) % EVEN, v.shape[1]))])
    gap = (fill(-2 * a) @ fill(b).T)[:n, :m]
    gap += square_a[:, None]
    gap += square_b
    i, j = np.nonzero(gap <= 1e-3 * square_a[:, None])
    for k in range(0, len(i), 4096):
        one, other = i[k : k + 4096], j[k : k + 4096]
        gap[one, other] = ((a[one] - b[other]) ** 2).sum(1)
    return np.sqrt(gap, out=gap)


def _band(a: np.ndarray, b: np.ndarray, square_a: np.ndarray, square_b: np.ndarray, above: np.ndarray, corner: float, came: np.ndarray | None) -> np.ndarray:
    """Totals of the last of these rows, from those of the row above them (``above``, by column) and what stands left of it; came (n + m - 1 anti-diagonals by n rows) gets where each cell's path comes from."""
    n, m = len(a), len(b)
    last, best = np.empty(m), np.empty(n)
    totals = np.full((WIDE + 2, n + 1), np.inf)  # of the two diagonals before these and of these; place 0 is the row above
    totals[0, 0] = corner
    costs = np.full((WIDE + n, n), np.inf)  # a row for each diagonal; those past the columns at hand wait for the next ones
    step = costs.itemsize
    for left in range(0, n + m - 1, WIDE):
        here = min(WIDE, n + m - 1 - left)
        if left < m:
            block = _costs(b[left : left + WIDE], a, square_b[left : left + WIDE], square_a)
            np.lib.stride_tricks.as_strided(costs, block.shape, (n * step, (n + 1) * step))[...] = block  # column j, row i to diagonal i + j, place i
            totals[1 : 1 + min(here, m - left), 0] = above[left : left + here]
        for k in range(here):
            up = totals[k + 1]
            np.minimum(up[:-1], up[1:], out=best)
            np.minimum(best, totals[k, :-1], out=best)
            np.add(best, costs[k], out=totals[k + 2, 1:])
        if came is not None:  # the first of the least, as argmin has it, with nan less than all
            diagonal, up, aside = totals[:here, :-1], totals[1 : here + 1, :-1], totals[1 : here + 1, 1:]
            straight = (diagonal <= np.minimum(up, aside)) | (diagonal != diagonal)
            way = came[left : left + here]
            way[...] = (up <= aside) | (up != up)
            np.subtract(2, way, out=way)
            way[straight] = 0
        low = max(left, n - 1)
        if low < left + here:
            last[low - n + 1 : left + here - n + 1] = totals[low - left + 2 : here + 2, n]
        totals[:2] = totals[here : here + 2].copy()
        costs[:n] = costs[WIDE:].copy()
        costs[n:] = np.inf
    return last


def dtw(a: np.ndarray, b: np.ndarray, most_bytes: int = 1 << 28) -> tuple[float, np.ndarray]:
    """Exact dynamic time warping of two series of vectors: the distance and the path.  Ties prefer the diagonal, then a step in the first series.

    Rows are worked through in bands, by anti-diagonals, costs as products of matrices.  A pair of up to ``most_bytes`` cells keeps a byte a cell for where its path comes from, and is done once.  Of a larger one only the last
    totals of each band are kept; then bands are done again from the last one back, each with those bytes, and the path is followed through them.  A band has about the square root of 8 x rows, so that memory
    grows as columns times that root, and the time is twice that of one pass.
    """
    n, m = len(a), len(b)
    square_a, square_b = (a**2).sum(1), (b**2).sum(1)
    whole = n * m <= most_bytes
    cuts = list(range(0, n, BAND if whole else max(16, int(np.sqrt(8 * n))))) + [n]
    final = len(cuts) - 2
    start = np.full(m, np.inf)  # nothing stands above the first row, but for the corner
    tops, totals, ways = [start], start, {}
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if whole or k == final:
            ways[k] = np.zeros((high - low + m - 1, high - low), dtype=np.uint8)
        totals = _band(a[low:high], b, square_a[low:high], square_b, totals, 0.0 if not k else np.inf, ways.get(k))
        if k < final:
            tops.append(totals)
    distance, i, j, path = float(totals[-1]), n, m, []
    for k in range(final, -1, -1):
        low, high = cuts[k], cuts[k + 1]
        came = ways.pop(k, None)
        if came is None:
            came = np.zeros((high - low + j - 1, high - low), dtype=np.uint8)
            _band(a[low:high], b[:j], square_a[low:high], square_b[:j], tops[k][:j], 0.0 if not k else np.inf, came)
        while i > low and j:
            path.append((i - 1, j - 1))
            way = came[i - 1 - low + j - 1, i - 1 - low]
            i, j = i - (way != 2), j - (way != 1)
        del came
    return distance, np.array(path[::-1])


def dtw_paths(feature_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, step, user_frame, ref_frame, distance of each pair (pair_id, user_id, ref_id) of recordings, features as z-scores of their recording.

    A recording is gathered once as an array of its frames (a clip, not a stream); pairs are dealt out by their id over a set number of tasks, so that one pair is one unit of work.
    """
    clips = feature_rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("frame", "features"))).alias("f")).select(KEY, F.col("f")["frame"].alias("frames"), F.col("f")["features"].alias("rows"))
    side = lambda s: clips.select(F.col(KEY).alias(f"{s}_id"), F.col("frames").alias(f"{s}_frames"), F.col("rows").alias(f"{s}_rows"))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, for pairs take more time than their size lets adaptive execution expect
    both = pairs.join(side("user"), "user_id").join(side("ref"), "ref_id").repartition(tasks, "pair_id")

    def scaled(rows) -> np.ndarray:
        x = np.array([np.asarray(r, float) for r in rows])
        std = x.std(axis=0)
        return (x - x.mean(axis=0)) / np.where(std < 1e-8, 1, std)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                distance, path = dtw(scaled(r.user_rows), scaled(r.ref_rows))
                yield pd.DataFrame({"pair_id": r.pair_id, "step": np.arange(len(path)), "user_frame": np.asarray(r.user_frames)[path[:, 0]], "ref_frame": np.asarray(r.ref_frames)[path[:, 1]], "distance": distance})

    return both.mapInPandas(work, "pair_id long, step int, user_frame int, ref_frame int, distance double")


def transferred(path: DataFrame, positions: DataFrame) -> DataFrame:
    """pair_id, p, user_frame of each reference position (pair_id, p, ref_frame): the first user frame of its frame, or of the nearest one that the path has."""
    first = path.groupBy("pair_id", "ref_frame").agg(F.min("user_frame").alias("user_frame"))
    both = positions.select("pair_id", "p", F.col("ref_frame").alias("want")).join(first, "pair_id")
    best = F.min_by("user_frame", F.struct(F.abs(F.col("ref_frame") - F.col("want")).alias("gap"), "ref_frame"))
    return both.groupBy("pair_id", "p").agg(best.alias("user_frame"))


def label_transfer(poses: DataFrame, pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """pair_id, p, frame, confidence, method: the reference's positions (pair_id, p, ref_frame, at least P1, P4, P6 and P9) on the user's recording of each pair, by warping, then put right by what is seen around them."""
    from motion_tables.operators.shaft import local_refinements

    moved = transferred(dtw_paths(features(poses), pairs), positions)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("user_frame"))).cast("long").alias(p.lower())
    wide = moved.groupBy("pair_id").agg(*[at(p) for p in ("P1", "P4", "P6", "P9")]).dropna()
    own = poses.join(pairs.select("pair_id", F.col("user_id").alias(KEY)), KEY).drop(KEY).withColumnRenamed("pair_id", KEY)
    return local_refinements(own, wide.withColumnRenamed("pair_id", KEY)).withColumnRenamed(KEY, "pair_id")


def playback(alignment: DataFrame, slow: int = 4, fps: float = 30.0) -> DataFrame:
    """Every aligned pair as ``slow`` output frames: pair_id, out_frame, user_frame, ref_frame, fraction (of the way to the next pair), out_seconds."""
    w = Window.partitionBy("pair_id").orderBy("user_frame", "ref_frame")
    p = alignment.withColumn("n", F.row_number().over(w) - 1).withColumn("last", F.lead("user_frame").over(w).isNull())
    p = p.select("*", F.explode(F.when(F.col("last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(slow - 1)))).alias("k"))
    out = F.col("n") * slow + F.col("k")
    return p.select("pair_id", out.alias("out_frame"), "user_frame", "ref_frame", (F.col("k") / F.lit(float(slow))).alias("fraction"), (out / F.lit(fps)).alias("out_seconds"))
