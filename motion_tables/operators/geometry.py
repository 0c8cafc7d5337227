"""Cameras, projection, triangulation and what is measured from points in space.

A camera is a row: rig_id, camera_id, fx, fy, cx, cy, dist array<double>(5), r array<double>(9, row by row) and t array<double>(3) from the rig to the camera.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motion_tables.functions import pose as P

# Limits of a valid point.
MAX_REPROJECTION_PX = 3.0
MIN_PARALLAX_DEG = 5.0
OUT = "point_id long, x double, y double, z double, cov array<double>, reprojection_px double, parallax_deg double, in_front boolean, n_views int"


def to_camera(x: Column, y: Column, z: Column, r: Column, t: Column) -> list[Column]:
    return [F.get(r, F.lit(3 * i)) * x + F.get(r, F.lit(3 * i + 1)) * y + F.get(r, F.lit(3 * i + 2)) * z + F.get(t, F.lit(i)) for i in range(3)]


def is_rigid(r: Column) -> Column:
    """Whether nine numbers, row by row, are a rotation."""
    row = lambda i: [F.get(r, F.lit(3 * i + k)) for k in range(3)]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    near = lambda c, v: F.abs(c - v) < 1e-6
    a, b, c = row(0), row(1), row(2)
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return near(dot(a, a), 1) & near(dot(b, b), 1) & near(dot(c, c), 1) & near(dot(a, b), 0) & near(dot(a, c), 0) & near(dot(b, c), 0) & near(det, 1)


def projected(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every point (rig_id, point_id, x, y, z) in every camera of its rig: u, v in pixels and depth; points behind a camera have no pixels."""
    c = cameras.select("rig_id", F.struct("camera_id", "fx", "fy", "cx", "cy", "dist", "r", "t").alias("c"))
    j = points.join(c, "rig_id")
    x, y, z = to_camera(F.col("x"), F.col("y"), F.col("z"), F.col("c.r"), F.col("c.t"))
    k = lambda i: F.get(F.col("c.dist"), F.lit(i))

    def pixels(n: Column) -> Column:
        a, b, r2 = n["a"], n["b"], n["r2"]
        radial = 1 + k(0) * r2 + k(1) * r2 * r2 + k(4) * r2 * r2 * r2
        u = a * radial + 2 * k(2) * a * b + k(3) * (r2 + 2 * a * a)
        v = b * radial + k(2) * (r2 + 2 * b * b) + 2 * k(3) * a * b
        return F.struct((F.col("c.fx") * u + F.col("c.cx")).alias("u"), (F.col("c.fy") * v + F.col("c.cy")).alias("v"), n["z"].alias("depth"))

    def normal(q: Column) -> Column:
        ahead = lambda c: F.when(q["z"] > 0, c / q["z"])
        return P.let(F.struct(ahead(q["x"]).alias("a"), ahead(q["y"]).alias("b"), q["z"].alias("z")), lambda n: P.let(F.struct(n["a"].alias("a"), n["b"].alias("b"), (n["a"] * n["a"] + n["b"] * n["b"]).alias("r2"), n["z"].alias("z")), pixels))

    seen = P.let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), normal)
    return j.select("point_id", "c.camera_id", seen.alias("p")).select("point_id", "camera_id", "p.*")


def _distorted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    x, y = n[..., 0], n[..., 1]
    k1, k2, p1, p2, k3 = (d[..., i] for i in range(5))
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    return np.stack([x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y], axis=-1)


def undistorted(n: np.ndarray, d: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The inverse of the distortion, by fixed point."""
    out = n.copy()
    for _ in range(rounds):
        out = out - (_distorted(out, d) - n)
    return out


def _triangulate(px: np.ndarray, k: np.ndarray, dist: np.ndarray, r: np.ndarray, t: np.ndarray, sigma: float, rounds: int = 12):
    """Points from (N, V, 2) pixels in V views: linear start, then Gauss-Newton on the pixels, all points of a batch together."""

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.einsum("nvij,nj->nvi", r, x) + t
        return _distorted(c[..., :2] / c[..., 2:], dist) * k[..., :2] + k[..., 2:], c[..., 2]

    n = undistorted((px - k[..., 2:]) / k[..., :2], dist)
    m = np.concatenate([r, t[..., None]], axis=-1)
    rows = np.concatenate([n[..., :1, None] * m[..., 2:3, :] - m[..., 0:1, :], n[..., 1:, None] * m[..., 2:3, :] - m[..., 1:2, :]], axis=2)
    h = np.linalg.svd(rows.reshape(len(px), -1, 4))[2][:, -1]
    x = h[:, :3] / h[:, 3:]

    def jacobian(x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(3):
            step = np.zeros_like(x)
            step[:, i] = 1e-6 * np.maximum(1, np.abs(x[:, i]))
            out.append((project(x + step)[0] - project(x - step)[0]) / (2 * step[:, i])[:, None, None])
        return np.stack(out, axis=-1).reshape(len(x), -1, 3)

    for _ in range(rounds):
        j, e = jacobian(x), (project(x)[0] - px).reshape(len(x), -1, 1)
        x = x - (np.linalg.pinv(j) @ e)[..., 0]
    seen, depth = project(x)
    j = jacobian(x)
    cov = sigma**2 * np.linalg.pinv(np.swapaxes(j, 1, 2) @ j)
    centre = -np.einsum("nvji,nvj->nvi", r, t)
    ray = x[:, None] - centre
    ray /= np.linalg.norm(ray, axis=-1, keepdims=True)
    cos = np.clip(np.einsum("nvi,nwi->nvw", ray, ray), -1, 1)
    return x, cov, np.linalg.norm(seen - px, axis=-1).max(axis=1), np.degrees(np.arccos(cos.min(axis=(1, 2)))), (depth > 0).all(axis=1)


def triangulated(observations: DataFrame, cameras: DataFrame, sigma_px: float = 0.5) -> DataFrame:
    """Each point (point_id, camera_id, u, v) seen by two cameras or more: place, covariance, worst reprojection, widest parallax, whether it is in front of all views.

    One shuffle gathers the few views of each point; points with the same number of views are solved together in stacked arrays.
    """
    seen = observations.dropna().join(cameras, "camera_id")
    view = F.struct("camera_id", "u", "v", "fx", "fy", "cx", "cy", "dist", "r", "t")
    g = seen.groupBy("point_id").agg(F.array_sort(F.collect_list(view)).alias("views")).where(F.size("views") > 1)
    flat = lambda *names: F.flatten(F.transform("views", lambda q: F.array(*[q[n] for n in names])))
    g = g.select("point_id", F.size("views").alias("n"), flat("u", "v").alias("px"), flat("fx", "fy", "cx", "cy").alias("k"), F.flatten(F.col("views")["dist"]).alias("dist"), F.flatten(F.col("views")["r"]).alias("r"), F.flatten(F.col("views")["t"]).alias("t"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                a = {c: np.stack(part[c].to_numpy()).astype(float) for c in ("px", "k", "dist", "r", "t")}
                x, cov, error, parallax, front = _triangulate(a["px"].reshape(-1, n, 2), a["k"].reshape(-1, n, 4), a["dist"].reshape(-1, n, 5), a["r"].reshape(-1, n, 3, 3), a["t"].reshape(-1, n, 3), sigma_px)
                yield pd.DataFrame({"point_id": part["point_id"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "cov": list(cov.reshape(-1, 9)), "reprojection_px": error, "parallax_deg": parallax, "in_front": front, "n_views": n})

    return g.mapInPandas(work, OUT)


def point_reasons(p: DataFrame) -> DataFrame:
    """p with reasons why a triangulated point is no valid measurement; none if it is."""
    checks = [(~F.col("in_front"), "behind a camera"), (F.col("reprojection_px") > MAX_REPROJECTION_PX, "views disagree"), (F.col("parallax_deg") < MIN_PARALLAX_DEG, "rays too close together")]
    return p.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks])))


def segment_rigidity(ends: DataFrame) -> DataFrame:
    """Frames (shot_id, frame, ax..az, bx..bz) whose segment differs from the shot's median length by more than 10 mm and 5 %, in shots of three frames or more."""
    d = [F.col(f"a{k}") - F.col(f"b{k}") for k in "xyz"]
    s = ends.withColumn("length", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    m = s.groupBy("shot_id").agg(F.median("length").alias("median"), F.count("*").alias("n")).where("n >= 3")
    return s.join(m, "shot_id").where(F.abs(F.col("length") - F.col("median")) > F.greatest(F.lit(0.01), 0.05 * F.col("median"))).select("shot_id", "frame", "length", "median")


def speeds(path: DataFrame) -> DataFrame:
    """Central-difference speed of each shot's points (shot_id, t_ms, x, y, z); the ends, and points beside a gap of over 1.6 median steps, have none."""
    from pyspark.sql import Window

    w, all_ = Window.partitionBy("shot_id").orderBy("t_ms"), Window.partitionBy("shot_id")
    gap = F.lead("t_ms").over(w) - F.lag("t_ms").over(w)
    p = path.withColumn("_step", F.col("t_ms") - F.lag("t_ms").over(w)).withColumn("_gap", gap)
    for k in "xyz":
        p = p.withColumn(f"_d{k}", F.lead(k).over(w) - F.lag(k).over(w))
    p = p.withColumn("_median", F.median("_step").over(all_))
    v = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2 + F.col("_dz") ** 2) / F.col("_gap") * 1000
    return p.withColumn("speed", F.when(F.col("_gap") <= 3.2 * F.col("_median"), v)).drop("_step", "_gap", "_median", "_dx", "_dy", "_dz")


def low_points(path: DataFrame) -> DataFrame:
    """The lowest observed point of each shot (z up), if points before and after it are higher."""
    from pyspark.sql import Window

    w = Window.partitionBy("shot_id").orderBy("t_ms")
    p = path.withColumn("_before", F.lag("z").over(w)).withColumn("_after", F.lead("z").over(w)).withColumn("_k", F.row_number().over(Window.partitionBy("shot_id").orderBy("z", "t_ms")))
    return p.where("_k = 1 and _before > z and _after > z").select("shot_id", "t_ms", "x", "y", "z")
