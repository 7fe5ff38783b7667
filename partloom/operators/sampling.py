"""Sampling and noise that a repeated task draws again alike: all randomness is a digest of ids and a seed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.schemas import NOISE_MM


def uniform(*key: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 digest of seed and key: the same in every engine."""
    text = F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def normal(*key: Column, seed: str) -> Column:
    """A standard normal number, by the Box-Muller transform of two uniforms."""
    u, v = uniform(*key, seed=seed + "u"), uniform(*key, seed=seed + "v")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def downsample(points: DataFrame, n: int, seed: str = "down", group: str = "cloud") -> DataFrame:
    """n points of each group without replacement; smaller groups whole."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(uniform(F.col(group), F.col("pid"), seed=seed), "pid"))
    return points.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def triangle_area(p1: Column, p2: Column, p3: Column) -> Column:
    """Half the length of the cross product of two sides."""
    u, v = [p2[k] - p1[k] for k in range(3)], [p3[k] - p1[k] for k in range(3)]
    c = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2]) / 2


def triangle_quota(triangles: DataFrame, per_face: int = 500, least: int = 5, group: str = "face_id") -> DataFrame:
    """Points that each triangle of a face gets: its share by area, `least` at the lowest."""
    out = triangles.withColumn("area", triangle_area(F.col("p1"), F.col("p2"), F.col("p3")))
    total = out.groupBy(group).agg(F.sum("area").alias("total"))
    share = F.floor(F.lit(per_face) * F.col("area") / F.col("total")).cast("int")
    return out.join(total, group).withColumn("quota", F.greatest(F.lit(least), F.coalesce(share, F.lit(least)))).drop("total")


def sample_faces(triangles: DataFrame, per_face: int = 500, least: int = 5, seed: str = "mesh") -> DataFrame:
    """Points spread evenly over the triangles of each face, as `face_id, tri_id, k, x, y, z`."""
    rows = triangle_quota(triangles, per_face, least).select("face_id", "tri_id", "p1", "p2", "p3", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("k"))
    r1, r2 = F.sqrt(uniform(F.col("tri_id"), F.col("k"), seed=seed + "1")), uniform(F.col("tri_id"), F.col("k"), seed=seed + "2")
    return rows.select("face_id", "tri_id", "k", *(((1 - r1) * F.col("p1")[i] + r1 * (1 - r2) * F.col("p2")[i] + r1 * r2 * F.col("p3")[i]).alias(c) for i, c in enumerate("xyz")))


def gaussian_noise(points: DataFrame, sigma: Column | float, seed: str = "noise", group: str = "cloud") -> DataFrame:
    s = F.lit(sigma) if isinstance(sigma, (int, float)) else sigma
    return points.withColumns({c: F.col(c) + s * normal(F.col(group), F.col("pid"), seed=seed + c) for c in "xyz"})


def noise_variants(points: DataFrame) -> DataFrame:
    """The cloud three times: without noise, within and beyond the tolerance."""
    sigma = F.create_map(*(F.lit(v) for kv in NOISE_MM.items() for v in kv))
    rows = points.withColumn("variant", F.explode(F.array(*map(F.lit, NOISE_MM))))
    return gaussian_noise(rows, F.element_at(sigma, F.col("variant")), seed="variant")


def outliers(points: DataFrame, share: float = 0.05, seed: str = "out", group: str = "cloud") -> DataFrame:
    """int(share * n) points of each group are moved by up to 1 along every axis."""
    w = Window.partitionBy(group)
    place = F.row_number().over(w.orderBy(uniform(F.col(group), F.col("pid"), seed=seed), "pid"))
    rows = points.withColumn("_hit", place <= F.floor(F.count("*").over(w) * F.lit(share) + 1e-9))
    move = lambda c: 2 * uniform(F.col(group), F.col("pid"), seed=seed + c) - 1
    return rows.withColumns({c: F.when(F.col("_hit"), F.col(c) + move(c)).otherwise(F.col(c)) for c in "xyz"}).drop("_hit")


def occlusions(points: DataFrame, chance: float = 0.1, low: float = 0.05, high: float = 0.15, seed: str = "occ", group: str = "cloud") -> DataFrame:
    """With `chance` a group loses a share between low and high of its points."""
    w = Window.partitionBy(group)
    lost = F.when(uniform(F.col(group), seed=seed) < chance, low + (high - low) * uniform(F.col(group), seed=seed + "s")).otherwise(0.0)
    place = F.row_number().over(w.orderBy(uniform(F.col(group), F.col("pid"), seed=seed + "p"), "pid"))
    return points.withColumn("_keep", place > F.floor(F.count("*").over(w) * lost + 1e-9)).where("_keep").drop("_keep")


def deviations(points: DataFrame, most: float, kind: str, seed: str = "dev", group: str = "cloud") -> DataFrame:
    """Noise whose three-sigma reach is 50-80 % (in_tolerance) or 150-300 % (out_of_tolerance) of `most`."""
    low, high = {"in_tolerance": (0.5, 0.8), "out_of_tolerance": (1.5, 3.0)}.get(kind, (0.0, 0.0))
    return gaussian_noise(points, (low + (high - low) * uniform(F.col(group), seed=seed)) * most / 3, seed=seed, group=group)


def realistic(points: DataFrame, most: float, kind: str, sigma: float = 0.05) -> DataFrame:
    return occlusions(outliers(gaussian_noise(deviations(points, most, kind), sigma)))


def tolerance_draw(nominals: DataFrame, low: float = 0.01, high: float = 0.03, seed: str = "42") -> DataFrame:
    """Kind and value of a tolerance per nominal rounded to two places; rows `(seq, nominal)` that share the rounded
    nominal get the limits of the first of them."""
    key = F.round("nominal", 2)
    first = nominals.groupBy(key.alias("key")).agg(F.min_by("nominal", "seq").alias("first"))
    tol = F.col("first") * (low + (high - low) * uniform(F.format_string("%.2f", "key"), seed=seed + "v"))
    kind = F.element_at(F.array(*map(F.lit, ("bilateral", "unilateral_upper", "unilateral_lower"))), (F.floor(uniform(F.format_string("%.2f", "key"), seed=seed + "k") * 3) + 1).cast("int"))
    first = first.withColumn("tol", tol).withColumn("kind", kind)
    out = nominals.withColumn("key", key).join(first, "key")
    up, down = F.col("kind") != "unilateral_lower", F.col("kind") != "unilateral_upper"
    return out.select("seq", "nominal", "kind", F.col("tol").alias("value"), F.when(up, F.col("first") + F.col("tol")).otherwise(F.col("first")).alias("upper_limit"), F.when(down, F.col("first") - F.col("tol")).otherwise(F.col("first")).alias("lower_limit"))


def farthest_points(points: DataFrame, n: int, group: str = "cloud") -> DataFrame:
    """n points of each group, each the farthest from those before, from the smallest pid on; ties by pid. Every step
    needs the one before it, so a group is one pandas frame."""
    kind = points.schema[group].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid").reset_index(drop=True)
        xyz, far, got = pdf[["x", "y", "z"]].to_numpy(), np.full(len(pdf), np.inf), [0]
        for _ in range(min(n, len(pdf)) - 1):
            far = np.minimum(far, ((xyz - xyz[got[-1]]) ** 2).sum(axis=1))
            got.append(int(far.argmax()))
        return pd.DataFrame({group: pdf[group].iloc[got].to_numpy(), "pid": pdf["pid"].iloc[got].to_numpy(), "place": np.arange(1, len(got) + 1)})

    return points.groupBy(group).applyInPandas(pick, f"{group} {kind}, pid long, place int")
