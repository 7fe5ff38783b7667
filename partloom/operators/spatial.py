"""Neighbour joins over point clouds and what is computed from neighbourhoods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.linear import covariance, eigenvalues
from partloom.plans.runtime import cutter

DOUBLINGS = 10  # of the reach of a neighbour join
PAIRS = 4_000_000  # about, that one task of a neighbour join makes
TILE = 8_192  # rows of a side, about, that meet in one task where cells are dealt in tiles
PARTS = 20_000  # partitions of a join at most
SHARES = 16  # tasks that share a group which is compared whole


def parts_of(points: DataFrame, each: int) -> int:
    """Partitions for a join that makes `each` pairs of a point. Spark would size them by what goes into the join."""
    return max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(points.count() * each / PAIRS))


def _pairs_in(points: DataFrame, radius, group: str, others: DataFrame | None = None, side: int = 1, parts: int = 0) -> DataFrame:
    """All ordered pairs of one group (a point and one of `others`, else of the points) at most `radius` (a number, or a
    column that is the same for the whole group) apart, and others near by, with squared distance `d2`.

    Each point is sent to the cells of side `radius` around its own, 27 in all, and meets the points of that cell by an
    equi join, so a point is compared with its surroundings only; no nested loop over a cloud. With cells of `side`
    radii it is sent to those that its ball touches, (1 + 2 / side)^3 on average, and compared with more points: that
    is for thin clouds, where the copies are what costs. With `parts`, the cells are dealt to as many tasks.
    """
    cell = [F.floor(F.col(c) / (radius * side)).cast("long") for c in "xyz"]
    right = (points if others is None else others).select(F.col(group), *(c.alias(f"c{n}") for c, n in zip(cell, "xyz")), *(F.col(c).alias(f"{c}2") for c in ("pid", *"xyz")))
    own = [F.col(group), *([] if isinstance(radius, (int, float)) else [radius.alias("reach")]), *(F.col(c).alias(f"{c}1") for c in ("pid", *"xyz"))]
    if side == 1:
        around = F.array(*(F.struct(*(F.lit(v).alias(f"d{n}") for v, n in zip((i, j, k), "xyz"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
        left = points.select("*", F.explode(around).alias("o")).select(*own, *((c + F.col(f"o.d{n}")).alias(f"c{n}") for c, n in zip(cell, "xyz")))
    else:
        left = points.select(*own, *(F.col(c).alias(f"_{c}") for c in "xyz"), *([] if isinstance(radius, (int, float)) else [radius.alias("_r")]))
        r = radius if isinstance(radius, (int, float)) else F.col("_r")
        for c in "xyz":  # a little more than the radius, for what rounding takes
            ends = [F.floor((F.col(f"_{c}") + sign * (r + 1e-9 * (r + F.abs(f"_{c}")))) / (r * side)).cast("long") for sign in (-1, 1)]
            left = left.select("*", F.explode(F.sequence(*ends)).alias(f"c{c}"))
        left = left.drop("_x", "_y", "_z", "_r")
    d2 = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "yz"), (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")))
    if parts:
        left, right = (side.repartition(parts, group, "cx", "cy", "cz") for side in (left.hint("merge"), right))
    return left.join(right, [group, "cx", "cy", "cz"]).withColumn("d2", d2)


def radius_join(points: DataFrame, radius, group: str = "cloud", side: int = 1, others: DataFrame | None = None, each: int = 0) -> DataFrame:
    """Ordered pairs `(group, pid1, pid2, d2)` of points (or a point and one of `others`) at most `radius` apart, a point with
    itself included. `radius` is a number or a column of the points that is the same for a whole group; `side`: see
    `_pairs_in`; with `each`, the pairs are dealt to tasks as for so many of one of the others."""
    limit = radius * radius if isinstance(radius, (int, float)) else F.col("reach") * F.col("reach")
    parts = parts_of(points if others is None else others, each) if each else 0
    return _pairs_in(points, radius, group, others, side, parts).where(F.col("d2") <= limit).select(group, "pid1", "pid2", "x2", "y2", "z2", "d2")


def knn_join(points: DataFrame, k: int, group: str = "cloud", reach: float | None = None, whole: int = 64) -> DataFrame:
    """The k nearest points of every point in its group, itself included, ties by pid: `(group, pid1, pid2, rank, d2)`.
    See `knn_between`."""
    return knn_between(points, points, k, group, reach, whole)


def knn_between(points: DataFrame, others: DataFrame, k: int, group: str = "cloud", reach: float | None = None, whole: int = 64) -> DataFrame:
    """The k nearest of `others` of every point in its group, ties by pid: `(group, pid1, pid2, rank, d2)`.

    Points that have k neighbours within a reach are settled by the grid join, whose cost grows with the local density;
    the rest go on with twice the reach, so that a point in a thin place meets its surroundings and not its group, whose
    comparison would be quadratic. Each round is written once. Only what has no k neighbours within DOUBLINGS doublings
    is compared with its whole group. Without a given `reach` a group's reach is what would hold k / 2 points if nine
    tenths of them filled their box evenly, and groups of up to `whole` * k points, for which 27 cells gain nothing, are
    compared whole; if all are, which one count tells, there is no other path in the plan. Spark keeps k rows of a
    point on the map side of the ranking window.
    """
    rank = F.row_number().over(Window.partitionBy(group, "pid1").orderBy("d2", "pid2"))
    cols = [group, "pid1", "pid2", "x2", "y2", "z2", "d2"]
    xyz = lambda df: df.select(group, "pid", "x", "y", "z")
    first = lambda df: df.select(*cols).withColumn("rank", rank).where(F.col("rank") <= k)

    if reach:
        todo, field, found = xyz(points).withColumn("reach", F.lit(float(reach))), xyz(others).withColumn("reach", F.lit(float(reach))), []
    else:
        if not others.groupBy(group).count().where(F.col("count") > whole * k).take(1):
            return first(knn_join_of(points, others, group))
        # of nine tenths of the points on each axis, so that a few far ones do not widen the reach
        ends = {c: F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.95)), F.lit(1000)) for c in "xyz"}
        box = others.groupBy(group).agg(F.count("*").alias("n"), *(e.alias(f"q{c}") for c, e in ends.items())).where(F.col("n") > whole * k)
        box = box.select("*", *((F.col(f"q{c}")[1] - F.col(f"q{c}")[0]).alias(f"s{c}") for c in "xyz"))
        widest = F.greatest("sx", "sy", "sz")
        volume = F.greatest("sx", widest / 1000) * F.greatest("sy", widest / 1000) * F.greatest("sz", widest / 1000)
        box = box.select(group, F.when(widest > 0, F.cbrt(volume * k / 2 / (F.col("n") * 0.9**3))).otherwise(1.0).alias("reach"))
        # a row for a group of many points: the points are dealt to tasks, not the groups
        box = F.broadcast(cutter(points.sparkSession)(box))
        small = [xyz(rows).join(box, group, "left_anti") for rows in (points, others)]
        todo, field, found = xyz(points).join(box, group), xyz(others).join(box, group), [first(knn_join_of(*small, group))]
    cut = cutter(points.sparkSession)
    todo, field = cut(todo), cut(field)
    for doubled in range(DOUBLINGS + 1):
        wide = F.col("reach") * float(2**doubled)
        close = cut(first(_pairs_in(todo, wide, group, field, parts=parts_of(todo, 10 * k)).where(F.col("d2") <= F.col("reach") * F.col("reach"))))
        full = close.where(F.col("rank") == k).select(group, "pid1").hint("merge")
        found.append(close.join(full, [group, "pid1"], "left_semi").select(*cols, "rank"))
        todo = cut(todo.join(full.withColumnRenamed("pid1", "pid"), [group, "pid"], "left_anti").select(*todo.columns))
        if todo.isEmpty():
            break
    else:
        found.append(first(knn_join_of(todo, others, group)))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def knn_join_of(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Every point of `left` with every point of its group in `right` and their squared distance. The points of a group are
    shared by SHARES tasks, to each of which the others go."""
    a = left.select(F.col(group), *(F.col(c).alias(f"{c}1") for c in ("pid", *"xyz"))).withColumn("_share", F.pmod(F.xxhash64("pid1"), F.lit(SHARES)).cast("int"))
    b = right.select(F.col(group), *(F.col(c).alias(f"{c}2") for c in ("pid", *"xyz")), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    d = [F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]
    parts = parts_of(left, 640)
    a, b = (side.repartition(parts, group, "_share") for side in (a.hint("merge"), b))
    return a.join(b, [group, "_share"]).drop("_share").withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def curvature(points: DataFrame, k: int = 15, eps: float = 1e-12, group: str = "cloud") -> DataFrame:
    """Smallest eigenvalue's share of the variance of the k nearest points; 0 with fewer than three."""
    near = knn_join(points, k, group)
    fit = near.groupBy(group, F.col("pid1").alias("pid")).agg(F.count("*").alias("n"), *covariance("x2", "y2", "z2")).withColumn("e", eigenvalues())
    value = F.col("e.e2") / (F.col("e.e0") + F.col("e.e1") + F.col("e.e2") + eps)
    return fit.select(group, "pid", F.when(F.col("n") >= 3, value).otherwise(0.0).alias("curvature"))


def spacing(points: DataFrame, k: int, group: str = "cloud") -> DataFrame:
    """Per group the mean distance to the last of the k nearest, the point itself among them."""
    far = knn_join(points, k, group).groupBy(group, "pid1").agg(F.sqrt(F.max("d2")).alias("far"))
    return far.groupBy(group).agg(F.avg("far").alias("spacing"))


def outliers_removed(points: DataFrame, k: int = 20, stds: float = 2.0, group: str = "cloud") -> DataFrame:
    """Points whose mean distance to their k nearest (themselves included) is at most the group's mean of that plus
    `stds` sample deviations; groups of up to k points stay whole."""
    mean = knn_join(points, k, group).groupBy(group, F.col("pid1").alias("pid")).agg(F.avg(F.sqrt("d2")).alias("m"))
    w = Window.partitionBy(group)
    kept = mean.withColumn("limit", F.avg("m").over(w) + stds * F.stddev_samp("m").over(w)).withColumn("size", F.count("*").over(w))
    return points.join(kept.where((F.col("m") <= F.col("limit")) | (F.col("size") <= k)).select(group, "pid"), [group, "pid"], "left_semi")


def descriptors(points: DataFrame, k: int = 10, group: str = "cloud", near: DataFrame | None = None) -> DataFrame:
    """Per point with unit normal (nx, ny, nz): density, eigenvalue shares, normal variation and mean normal angle.
    `near`: the points' `knn_join`, if it is there."""
    near = knn_join(points, k, group) if near is None else near
    n2 = points.select(group, F.col("pid").alias("pid2"), F.col("nx").alias("mx"), F.col("ny").alias("my"), F.col("nz").alias("mz"))
    n1 = points.select(group, F.col("pid").alias("pid1"), "nx", "ny", "nz")
    near = near.join(n2, [group, "pid2"]).join(n1, [group, "pid1"])
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))))
    fit = near.groupBy(group, F.col("pid1").alias("pid")).agg(
        F.count("*").alias("n"), F.sqrt(F.max("d2")).alias("far"), F.avg(turn).alias("angle"),
        (F.var_pop("mx") + F.var_pop("my") + F.var_pop("mz")).alias("normal_variation"), *covariance("x2", "y2", "z2"),
    ).withColumn("e", eigenvalues())
    total = F.col("e.e0") + F.col("e.e1") + F.col("e.e2") + 1e-10
    return fit.select(
        group, "pid", "angle", "normal_variation",
        F.when(F.col("far") > 0, F.col("n") / (4 / 3 * math.pi * F.pow("far", F.lit(3.0)))).otherwise(0.0).alias("density"),
        ((F.col("e.e0") - F.col("e.e1")) / total).alias("planarity"), ((F.col("e.e1") - F.col("e.e2")) / total).alias("linearity"), (F.col("e.e2") / total).alias("sphericity"),
    )


def two_scale_curvature(points: DataFrame, radius: float, group: str = "cloud") -> DataFrame:
    """0.7 of the curvature within `radius` plus 0.3 of that within twice the radius; 0 with fewer than five within."""

    def within(r, name):
        fit = radius_join(points, r, group).groupBy(group, F.col("pid1").alias("pid")).agg(F.count("*").alias("n"), *covariance("x2", "y2", "z2")).withColumn("e", eigenvalues())
        return fit.select(group, "pid", F.col("n").alias(f"n_{name}"), (F.col("e.e2") / (F.col("e.e0") + F.col("e.e1") + F.col("e.e2") + 1e-12)).alias(name))

    both = within(radius, "small").join(within(2 * radius, "large"), [group, "pid"])
    return both.select(group, "pid", F.when(F.col("n_small") >= 5, 0.7 * F.col("small") + 0.3 * F.col("large")).otherwise(0.0).alias("curvature"))


def neighbour_edges(points: DataFrame, k: int = 10, reach: float = 0.1, group: str = "cloud", near: DataFrame | None = None) -> DataFrame:
    """Undirected edges `(a < b, distance)` between k nearest neighbours less than `reach` apart. `near`: the points'
    `knn_join`, if it is there."""
    near = (knn_join(points, k, group) if near is None else near).where((F.col("pid1") != F.col("pid2")) & (F.sqrt("d2") < reach))
    return near.select(group, F.least("pid1", "pid2").alias("a"), F.greatest("pid1", "pid2").alias("b"), F.sqrt("d2").alias("distance")).distinct()


def interpolate(targets: DataFrame, sources: DataFrame, value: str, group: str = "cloud", k: int = 3) -> DataFrame:
    """`value` at the targets from the k nearest sources, weighted by inverse squared distance."""
    near = knn_between(targets.select(group, "pid", "x", "y", "z"), sources.select(group, "pid", "x", "y", "z"), k, group).select(group, F.col("pid1").alias("pid"), "pid2", "d2")
    near = near.join(sources.select(group, F.col("pid").alias("pid2"), F.col(value).alias("v")), [group, "pid2"])
    w = 1 / F.greatest("d2", F.lit(1e-10))
    return near.groupBy(group, "pid").agg((F.sum(w * F.col("v")) / F.sum(w)).alias(value))


def near_centroids(segments: DataFrame, reach: float, group: str = "cloud") -> DataFrame:
    """Ordered pairs of segments whose centroids (x, y, z) are less than `reach` apart, self excluded. Beyond TILE
    segments, a cell and what is around it meet in tiles of about TILE rows a side, so that many segments in few cells
    are dealt to tasks and each holds one tile."""
    near = _pairs_in(segments, reach, group) if segments.count() <= TILE else _tiled_pairs(segments, reach, group)
    return near.where((F.col("d2") < reach * reach) & (F.col("pid1") != F.col("pid2"))).select(group, "pid1", "pid2", "d2")


def _tiled_pairs(points: DataFrame, radius: float, group: str) -> DataFrame:
    """Pairs of points in cells of side `radius` around each other, with `d2`."""
    cut, key = cutter(points.sparkSession), [group, "cx", "cy", "cz"]
    cell = {f"c{c}": F.floor(F.col(c) / radius).cast("long") for c in "xyz"}
    around = F.array(*(F.struct(*(F.lit(v).alias(f"d{n}") for v, n in zip((i, j, k), "xyz"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    spread = lambda rows: rows.withColumn("o", F.explode(around)).withColumns({f"c{n}": F.col(f"c{n}") + F.col(f"o.d{n}") for n in "xyz"}).drop("o")
    named = lambda n: [F.col(group), *cell, *(F.col(c).alias(f"{c}{n}") for c in ("pid", *"xyz"))]
    placed = points.withColumns(cell)
    held = cut(placed.groupBy(*key).agg(F.count("*").alias("n")))
    met = spread(held).groupBy(*key).agg(F.sum("n").alias("m"))
    tiles = cut(held.join(met.hint("merge"), key).select(*key, F.ceil(F.col("m") / TILE).cast("int").alias("_p"), F.ceil(F.col("n") / TILE).cast("int").alias("_q")))
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles.agg(F.sum(F.col("_p").cast("long") * F.col("_q"))).first()[0] * 2)
    parts = min(parts, PARTS)
    shares = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread(placed.select(*named(1))).join(tiles.hint("merge"), key).withColumn("_i", F.pmod(F.xxhash64("pid1"), F.col("_p")).cast("int")).withColumn("_j", shares("_q"))
    right = placed.select(*named(2)).join(tiles.hint("merge"), key).withColumn("_j", F.pmod(F.xxhash64("pid2"), F.col("_q")).cast("int")).withColumn("_i", shares("_p"))
    left, right = (rows.drop("_p", "_q").repartition(parts, *key, "_i", "_j") for rows in (left, right))
    d = [F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]
    return left.hint("merge").join(right, [*key, "_i", "_j"]).withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _met(points: DataFrame, shapes: DataFrame, spans: dict, group: str) -> DataFrame:
    """Points with the shapes whose box (`spans`: axis to the columns of its ends) touches their cell. A group's cells are
    as wide as its widest box, so that a box lies in two cells of an axis at most."""
    wide = F.greatest(*(hi - lo for lo, hi in spans.values())) if len(spans) > 1 else [hi - lo for lo, hi in spans.values()][0]
    cells = shapes.groupBy(group).agg(F.max(wide).alias("_w")).select(group, F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0).alias("_cell"))
    at = lambda c: F.floor(c / F.col("_cell")).cast("long")
    placed = shapes.join(cells, group)
    for axis, (lo, hi) in spans.items():
        placed = placed.withColumn(f"_c{axis}", F.explode(F.sequence(at(lo), at(hi))))
    keyed = points.join(cells, group).select(*points.columns, *(at(F.col(axis)).alias(f"_c{axis}") for axis in spans))
    return keyed.join(placed.drop("_cell"), [group, *(f"_c{axis}" for axis in spans)])


def in_shell(points: DataFrame, cylinders: DataFrame, width: float = 0.1, group: str = "cloud") -> DataFrame:
    """Points whose distance from an axis along z differs from the radius by less than `width`."""
    reach = F.col("radius") + width
    met = _met(points, cylinders, {"x": (F.col("cx") - reach, F.col("cx") + reach), "y": (F.col("cy") - reach, F.col("cy") + reach)}, group)
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    return met.where(F.abs(d - F.col("radius")) < width).select(group, "feature", "pid")


def in_box(points: DataFrame, boxes: DataFrame, margin: float = 0.1, group: str = "cloud") -> DataFrame:
    """Points inside a box grown by `margin` on all sides, bounds included."""
    ok, spans = F.lit(True), {c: (F.col(f"{c}0") - margin, F.col(f"{c}1") + margin) for c in "xyz"}
    for c, (lo, hi) in spans.items():
        ok = ok & F.col(c).between(lo, hi)
    return _met(points, boxes, spans, group).where(ok).select(group, "feature", "pid")
