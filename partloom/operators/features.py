"""Whole features of a model: normals, measured values, configurations, correspondences, training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.linear import covariance, eigenvalues, eigenvector
from partloom.functions.records import dimensions_of
from partloom.operators import segments as G
from partloom.operators import spatial as S


def normal_statistics(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Mean normal of unit length ([0, 0, 1] where the normals cancel out) and the mean over the axes of the normals'
    population deviation. Points have normals (nx, ny, nz)."""
    out = points.groupBy(group).agg(*(F.avg(f"n{c}").alias(f"m{c}") for c in "xyz"), ((F.stddev_pop("nx") + F.stddev_pop("ny") + F.stddev_pop("nz")) / 3).alias("normal_std"))
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    unit = lambda c, none: F.when(size > 1e-10, F.col(f"m{c}") / (size + 1e-10)).otherwise(none)
    return out.select(group, unit("x", 0.0).alias("normal_x"), unit("y", 0.0).alias("normal_y"), unit("z", 1.0).alias("normal_z"), "normal_std")


def point_normals(points: DataFrame, k: int = 10, toward: str = "centroid", group: str = "cloud", near: DataFrame | None = None) -> DataFrame:
    """Unit normal (nx, ny, nz) of every point: the shortest axis of its k nearest, turned so that it does not point
    against the neighbours' centroid or (`toward` "point") against the point itself, both seen from the origin.
    [0, 0, 1] where the axis is not unique or there are fewer than three points. `near`: their `knn_join`, if it is there."""
    near = S.knn_join(points, k, group) if near is None else near
    fit = near.groupBy(group, F.col("pid1").alias("pid")).agg(F.count("*").alias("k"), *covariance("x2", "y2", "z2"), *(F.avg(f"{c}2").alias(f"m{c}") for c in "xyz"))
    fit = fit.withColumn("e", eigenvalues()).withColumn("v", F.when(F.col("k") >= 3, eigenvector(F.col("e.e2"))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    if toward == "point":
        fit = fit.join(points.select(group, "pid", "x", "y", "z"), [group, "pid"])
    to = [F.col(c if toward == "point" else f"m{c}") for c in "xyz"]
    against = sum((F.col("v")[i] * to[i] for i in (1, 2)), F.col("v")[0] * to[0]) < 0
    return fit.select(group, "pid", *(F.when(against, -F.col("v")[i]).otherwise(F.col("v")[i]).alias(f"n{c}") for i, c in enumerate("xyz")))


def with_dimensions(segments: DataFrame, dimensions: DataFrame, by: str = "seg_id") -> DataFrame:
    """Segments with the measures of their id, where there are any."""
    return segments.join(dimensions, by, "left")


def normal_deviation(points: DataFrame, k: int, group: str = "cloud") -> DataFrame:
    """Mean distance of the normals of the k nearest points from their mean."""
    near = S.knn_join(points.select(group, "pid", "x", "y", "z"), k, group).select(group, "pid1", "pid2")
    near = near.join(points.select(group, F.col("pid").alias("pid2"), "nx", "ny", "nz"), [group, "pid2"])
    mean = near.groupBy(group, "pid1").agg(*(F.avg(f"n{c}").alias(f"m{c}") for c in "xyz"))
    d = [F.col(f"n{c}") - F.col(f"m{c}") for c in "xyz"]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return near.join(mean, [group, "pid1"]).groupBy(group, F.col("pid1").alias("pid")).agg(F.avg(far).alias("curvature"))


def percentiles(rows: DataFrame, value: Column, shares: list[int], group: str = "cloud") -> DataFrame:
    """Columns `p01` ... of the value's percentiles per group, with linear interpolation."""
    out = rows.groupBy(group).agg(F.percentile(value, F.array(*(F.lit(s / 100) for s in shares))).alias("p"))
    return out.select(group, *(F.col("p")[i].alias(f"p{s:02d}") for i, s in enumerate(shares)))


def neighbour_angles(points: DataFrame, k: int = 10, group: str = "cloud") -> DataFrame:
    """Angles in degrees between the lines of a point's normal and those of its k - 1 nearest others."""
    near = S.knn_join(points.select(group, "pid", "x", "y", "z"), k, group).where("pid1 <> pid2").select(group, "pid1", "pid2")
    a = points.select(group, F.col("pid").alias("pid1"), *(F.col(f"n{c}").alias(f"a{c}") for c in "xyz"))
    b = points.select(group, F.col("pid").alias("pid2"), *(F.col(f"n{c}").alias(f"b{c}") for c in "xyz"))
    dot = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")
    return near.join(a, [group, "pid1"]).join(b, [group, "pid2"]).select(group, F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot)))).alias("angle"))


def measured_values(points: DataFrame, kinds: DataFrame, group: str = "cloud") -> DataFrame:
    """What is measured of each group by its kind (`kinds`: group, type, radius of a sphere or null): diameter and
    depth of holes and cylinders, radius of spheres, height and radii of cones, sides of pockets and slots, the longest
    side of all others; null where it does not apply. Every fit is one aggregation over all groups."""
    box = points.groupBy(group).agg(*((F.max(c) - F.min(c)).alias(f"s{c}") for c in "xyz"))
    fit = G.cylinder_fit(points, group).select(group, F.col("diameter").alias("fit"))
    cone = G.cone_parameters(points, group)
    all_ = kinds.join(box, group).join(fit, group).join(cone, group)
    kind, widest = F.col("type"), F.greatest("sx", "sy", "sz")
    round_, sides = kind.isin("through_hole", "blind_hole", "cylinder"), kind.isin("pocket", "slot")
    known = (kind == "sphere") & F.col("radius").isNotNull()
    other = ~round_ & ~sides & (kind != "cone") & ~known
    return all_.select(
        group, "type", F.when(round_, F.col("fit")).alias("diameter"), F.when(round_, F.col("sz")).when(sides, F.col("sz")).alias("depth"), F.when(known, F.col("radius")).alias("radius"),
        *(F.when(kind == "cone", F.col(c)).alias(c) for c in ("height", "base_radius", "top_radius")), F.when(sides, F.col("sx")).alias("length"), F.when(sides, F.col("sy")).alias("width"),
        F.when(other, widest).alias("max_dimension"),
    )


def dimension_of(points: DataFrame, kinds: DataFrame, group: str = "cloud") -> DataFrame:
    """One number per group: the diameter of holes and cylinders, a slot's length along its longest axis, else the
    longest side of the box."""
    fit = G.cylinder_fit(points, group).select(group, "diameter", F.col("height").alias("along"))
    box = points.groupBy(group).agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("widest"))
    out = kinds.join(fit, group).join(box, group)
    return out.select(group, "type", F.when(F.col("type").isin("hole", "cylinder"), F.col("diameter")).when(F.col("type") == "slot", F.col("along")).otherwise(F.col("widest")).alias("dimension"))


def feature_config(points: DataFrame, kinds: DataFrame, group: str = "cloud", least: int = 10) -> DataFrame:
    """A row for each feature of at least `least` points: id, type, centroid, box, mean normal, normal deviation,
    curvature statistics, measured values, confidence.

    Ids count all features in the order of `kinds.pos`, also those that are left out. points: group, pid, x, y, z, nx,
    ny, nz; kinds: group, pos, type, radius."""
    ids = kinds.withColumn("id", F.format_string("seg_%03d", F.row_number().over(Window.partitionBy("model_id").orderBy("pos")) - 1))
    xyz = points.select(group, "pid", "x", "y", "z")
    size = G.summary(xyz, group).where(F.col("n") >= least).select(group, "n", *(f"{a}_{c}" for a in ("c", "min", "max") for c in "xyz"))
    bend = S.curvature(xyz, 15, group=group).groupBy(group).agg(F.avg("curvature").alias("curvature_mean"), F.stddev_pop("curvature").alias("curvature_std"), F.max("curvature").alias("curvature_max"))
    values = measured_values(xyz, kinds.select(group, "type", "radius"), group).drop("type")
    out = ids.select("model_id", group, "id", "type").join(size, group).join(normal_statistics(points, group), group).join(bend, group).join(values, group)
    return out.withColumn("confidence", F.when(F.col("type") == "unknown", 0.5).otherwise(0.9))


def correspondences(features: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Each feature with the first dimension of its model that may describe it, or a made-up one of the feature's own
    nominal value and 2 % tolerance; deviation of the measured value. The rule sees kinds only, so the first dimension of
    each kind of a model stands for all of that kind: features meet as many rows as there are kinds.

    features: model_id, id, type, nominal, measured; dimensions: model_id, dim_id, pos, dimension_type, value, tol."""
    firsts = dimensions.groupBy("model_id", "dimension_type").agg(F.min(F.struct("pos", "dim_id", "value", "tol")).alias("d"))
    fits = features.select("model_id", "type").distinct().select("model_id", "type", F.explode(dimensions_of(F.col("type"))).alias("dimension_type")).join(firsts, ["model_id", "dimension_type"])
    first = fits.groupBy("model_id", "type").agg(F.min("d").alias("d"))
    out = features.join(first, ["model_id", "type"], "left").withColumn("nominal", F.coalesce("d.value", F.col("nominal")))
    tol = F.coalesce("d.tol", F.col("nominal") * 0.02)
    return out.select("model_id", "id", F.coalesce("d.dim_id", F.concat(F.lit("synthetic_"), F.col("id"))).alias("dim_id"), "nominal", tol.alias("tol"), F.abs(F.col("measured") - F.col("nominal")).alias("deviation"))


def pair_dataset(edges: DataFrame) -> DataFrame:
    """Edges whose status is known, with label 1.0 for those in tolerance; of repeated edges the last (by `o`)."""
    return labelled(edges.groupBy("model_id", "src", "dst").agg(F.max_by("status", "o").alias("status")))


def labelled(edges: DataFrame, *more: str) -> DataFrame:
    """`pair_dataset` of edges of which none is repeated; `more`: further columns to keep."""
    return edges.where("status <> 'UNKNOWN'").select("model_id", "src", "dst", F.when(F.col("status") == "IN_TOLERANCE", 1.0).otherwise(0.0).alias("label"), *more)


def label_groups(points: DataFrame, least: int = 30, group: str = "cloud") -> DataFrame:
    """Points per predicted label with the label's mean probability; groups of at least `least` points."""
    return points.groupBy(group, "label").agg(F.count("*").alias("n"), F.avg("probability").alias("confidence")).where(F.col("n") >= least)


def means_of(descriptors: DataFrame, group: str = "cloud") -> DataFrame:
    """Means over a segment's points of density, planarity, linearity and normal variation."""
    return descriptors.groupBy(group).agg(*(F.avg(c).alias(c) for c in ("density", "planarity", "linearity", "normal_variation")))


def descriptor_means(points: DataFrame, k: int = 10, group: str = "cloud") -> DataFrame:
    return means_of(S.descriptors(points, k, group), group)


def distinct_labels(points: DataFrame, first: int = 6, group: str = "cloud") -> DataFrame:
    """How many labels of at least 0 a cloud has, and the `first` largest of them."""
    p = points.where("label >= 0").select(group, "label").distinct()
    top = p.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("label")))).where(F.col("_k") <= first)
    top = top.groupBy(group).agg(F.sort_array(F.collect_list("label"), False).alias("first"))
    return p.groupBy(group).agg(F.count("*").alias("labels")).join(top, group)


def positive(rows: DataFrame, measure: str = "measured") -> DataFrame:
    """Rows that measure something."""
    return rows.where(F.col(measure) > 0)
