"""Segmenters composed of clustering, curvature and fits: which method a cloud takes depends on what the last one found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.operators.clusters import dbscan, grow_regions
from partloom.operators.communities import louvain
from partloom.operators.features import dimension_of, point_normals
from partloom.operators.segments import all_primitives, graph_segment_class, local_primitive, manufacturing_feature, measurements, point_segment_class, shape_properties, summary, unit_ball, whole_measure
from partloom.operators.spatial import curvature, descriptors, knn_join, near_centroids, neighbour_edges, outliers_removed, spacing, two_scale_curvature

FACTORS = (2.5, 2.0, 1.5, 1.2, 1.0)  # fixed values: reaches to try again with, times the spacing
PRIMITIVES = ("plane", "cylinder", "sphere", "cone", "torus")


def found(labels: DataFrame, group: str = "cloud") -> DataFrame:
    """`(group, clusters, noise)` of labels that number clusters from 0 and noise -1."""
    return labels.groupBy(group).agg((F.max("label") + 1).alias("clusters"), F.count(F.when(F.col("label") < 0, 1)).alias("noise"))


def curvature_parts(points: DataFrame, k: int = 20, least: int = 10, group: str = "cloud") -> DataFrame:
    """Points `(group, pid, segment)` by curvature: from the 80th percentile on, from the median on, and below; parts
    below `least` points are left out, the others numbered in that order. Curvatures count to twelve places, as points with
    the same neighbours differ by rounding only."""
    c = curvature(points, k, 1e-10, group).withColumn("curvature", F.round("curvature", 12))
    q = c.groupBy(group).agg(F.percentile("curvature", F.array(F.lit(0.5), F.lit(0.8))).alias("q"))
    band = F.when(F.col("curvature") >= F.col("q")[1], 0).when(F.col("curvature") >= F.col("q")[0], 1).otherwise(2)
    rows = c.join(q, group).select(group, "pid", band.alias("band"))
    kept = rows.groupBy(group, "band").count().where(F.col("count") >= least)
    number = kept.select(group, "band", (F.row_number().over(Window.partitionBy(group).orderBy("band")) - 1).alias("segment"))
    return rows.join(number, [group, "band"]).select(group, "pid", "segment")


def adaptive_clusters(points: DataFrame, cut, *, k: int = 10, first: float = 3.5, factors=FACTORS, floor: float = 2.0, ceiling: float = 100.0, core: int = 5, least: int = 10, group: str = "cloud") -> DataFrame:
    """Density clusters whose reach follows each cloud's spacing: `(group, pid, segment, path)`.

    The spacing is the mean distance to the k-th neighbour; the first reach is `first` times that, within `floor` and
    `ceiling`. A cloud that comes out as one cluster without noise is clustered again with `factors` times its
    spacing, one after the other, until it has more than one; a cloud that ends with one cluster is cut by curvature
    instead. Clouds that are settled leave the round, so later rounds hold the open ones only. Noise and clusters
    below `least` points are left out, the others numbered by their label. `path` names what settled the cloud: `first`, the factor, or `curvature`."""
    size = points.groupBy(group).agg(F.count("*").alias("_n"))
    wide = size.join(spacing(points, k + 1, group), group).select(group, "spacing", F.greatest(F.lit(core), F.least(F.lit(k), F.col("_n") - 1)).cast("int").alias("_core"))
    rows = cut(points.select(group, "pid", "x", "y", "z").join(wide, group))

    def clustered(some, reach):
        return cut(dbscan(some.withColumn("_eps", reach), F.col("_eps"), F.col("_core"), cut, group))

    labels = clustered(rows, F.least(F.greatest(F.col("spacing") * first, F.lit(floor)), F.lit(ceiling)))
    counts = found(labels, group)
    open_ = cut(counts.where("clusters = 1 and noise = 0").select(group))
    out = [labels.join(open_, group, "left_anti").withColumn("path", F.lit("first"))]
    for i, factor in enumerate(factors):
        if open_.isEmpty():
            break
        labels = clustered(rows.join(open_, group, "left_semi"), F.col("spacing") * factor)
        counts = found(labels, group)
        last = i == len(factors) - 1
        still = cut(counts.where("clusters = 1" if last else "clusters <= 1").select(group))
        out.append(labels.join(still, group, "left_anti").withColumn("path", F.lit(str(factor))))
        open_ = still
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    every = every.where("label >= 0")
    big = every.groupBy(group, "label").count().where(F.col("count") >= least)
    number = big.select(group, "label", (F.row_number().over(Window.partitionBy(group).orderBy("label")) - 1).alias("segment"))
    every = every.join(number, [group, "label"]).select(group, "pid", "segment", "path")
    bent = curvature_parts(points.join(open_, group, "left_semi"), least=10, group=group)
    return every.union(bent.select(group, "pid", "segment", F.lit("curvature").alias("path")))


def classified(points: DataFrame, group: str) -> DataFrame:
    """Class, confidence and primitive ratios of each group of points: `(group, n, feature_type, confidence, best, plane,
    cylinder, sphere, cone, torus)`."""
    fits = all_primitives(points, group)
    shape = shape_properties(points, curvature(points.select(group, "pid", "x", "y", "z"), 20, 1e-10, group), group)
    kind, confidence = manufacturing_feature(F.col("best"))
    n = points.groupBy(group).agg(F.count("*").alias("n"))
    both = fits.select(group, "best", *PRIMITIVES).join(shape, group).join(n, group)
    return both.select(group, "n", kind.alias("feature_type"), confidence.alias("confidence"), "best", *PRIMITIVES)


def _parts(points: DataFrame, number, level: int, group: str) -> DataFrame:
    return points.select(group, "pid", "x", "y", "z", F.col("segment_id").alias("parent_id"), F.concat_ws("_", F.col("segment_id"), F.lit(str(level)), number.cast("string")).alias("segment_id"))


def level_hierarchy(points: DataFrame, cut, *, least: int = 30, bend: float = 0.1, group: str = "cloud") -> DataFrame:
    """Points in the segments of up to three levels: `(group, pid, x, y, z, segment_id, parent_id, hierarchy_level)`.

    Level 0 is the cloud, `seg_0_0`. A cloud of over 2 `least` points is cut into points more and less curved than
    `bend` (k = 20), parts of over `least` points stay. Parts of over 3 `least` points are clustered by density (2.5
    times their own spacing, cores of a twentieth of the part, five at least); clusters and the noise of at least
    `least` points stay. Numbers count the parts that stay on level 1, and all labels, noise first, on level 2. Levels
    run on all parts of all clouds at once."""
    sized = lambda df, by: df.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    base = points.select(group, "pid", "x", "y", "z", F.lit("seg_0_0").alias("segment_id"))
    coarse = base.withColumn("parent_id", F.lit(None).cast("string"))
    key = [group, "segment_id"]

    large = sized(base, [group]).where(F.col("_n") > 2 * least).drop("_n")
    bent = large.join(curvature(large.select(group, "pid", "x", "y", "z"), 20, 1e-10, group), [group, "pid"]).withColumn("_low", (F.col("curvature") <= bend).cast("int"))
    bent = sized(bent, [group, "_low"]).where(F.col("_n") > least)
    first = F.min("_low").over(Window.partitionBy(group))
    medium = cut(_parts(bent, F.col("_low") - first, 1, group))

    some = sized(medium.select(group, "pid", "x", "y", "z", "segment_id"), key).where(F.col("_n") > 3 * least)
    some = some.withColumn("_key", F.struct(group, "segment_id"))
    wide = spacing(some.select("_key", "pid", "x", "y", "z"), 11, "_key")
    some = cut(some.join(wide, "_key").withColumn("_eps", F.col("spacing") * 2.5).withColumn("_core", F.greatest(F.lit(5), F.floor(F.col("_n") / 20)).cast("int")))
    labels = cut(dbscan(some.select("_key", "pid", "x", "y", "z", "_eps", "_core"), F.col("_eps"), F.col("_core"), cut, "_key"))
    near = some.join(labels, ["_key", "pid"])
    near = near.withColumn("_first", F.min("label").over(Window.partitionBy("_key"))).withColumn("_m", F.count("*").over(Window.partitionBy("_key", "label"))).where(F.col("_m") >= least)
    fine = _parts(near, F.col("label") - F.col("_first"), 2, group)

    out = coarse.select(group, "pid", "x", "y", "z", "segment_id", "parent_id", F.lit(0).alias("hierarchy_level"))
    for level, rows in ((1, medium), (2, fine)):
        out = out.union(rows.select(group, "pid", "x", "y", "z", "segment_id", "parent_id", F.lit(level).alias("hierarchy_level")))
    return out


def children(levels: DataFrame, group: str = "cloud") -> DataFrame:
    """Segments `(group, segment_id, parent_id, hierarchy_level, n, children_ids)` of `level_hierarchy`."""
    seg = levels.groupBy(group, "segment_id", "parent_id", "hierarchy_level").agg(F.count("*").alias("n"))
    below = seg.where("parent_id is not null").groupBy(group, F.col("parent_id").alias("segment_id")).agg(F.array_sort(F.collect_list("segment_id")).alias("children_ids"))
    return seg.join(below, [group, "segment_id"], "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def finest(levels: DataFrame, group: str = "cloud") -> DataFrame:
    """Of each cloud the segments of its finest level."""
    return levels.withColumn("_top", F.max("hierarchy_level").over(Window.partitionBy(group))).where("hierarchy_level = _top").drop("_top")


def routed_segments(points: DataFrame, cut, *, least: int = 30, bend: float = 0.1, group: str = "cloud", **clusters) -> DataFrame:
    """Every cloud by the first method that settles it: `(group, pid, x, y, z, segment_id, parent_id, hierarchy_level, path)`.

    Adaptive clusters (`adaptive_clusters`, clusters of at least max(10, `least` / 3)) of at least `least` points are the
    segments of a cloud; a cloud without any takes the finest level of `level_hierarchy`. `path` says which way it went."""
    found_ = adaptive_clusters(points, cut, least=max(10, least // 3), group=group, **clusters)
    found_ = found_.withColumn("_n", F.count("*").over(Window.partitionBy(group, "segment"))).where(F.col("_n") >= least)
    direct = cut(points.select(group, "pid", "x", "y", "z").join(found_, [group, "pid"]).select(group, "pid", "x", "y", "z", F.concat(F.lit("segment_"), F.col("segment")).alias("segment_id"), "path"))
    rest = cut(points.select(group, "pid", "x", "y", "z").join(direct.select(group).distinct(), group, "left_anti"))
    other = finest(level_hierarchy(rest, cut, least=least, bend=bend, group=group), group)
    none = F.lit(None).cast("string").alias("parent_id")
    return direct.select(group, "pid", "x", "y", "z", "segment_id", none, F.lit(0).alias("hierarchy_level"), "path").union(
        other.select(group, "pid", "x", "y", "z", "segment_id", "parent_id", "hierarchy_level", F.concat(F.lit("level_"), F.col("hierarchy_level")).alias("path"))
    )


def described(segments: DataFrame, cut, group: str = "cloud") -> DataFrame:
    """Segments of `routed_segments` with class, confidence, best primitive and its ratios (`geometric_params`), merged
    with the local fit's parameters, the ratios winning on equal names, and their measures."""
    rows = cut(segments.withColumn("_key", F.struct(group, "segment_id")))
    p = rows.select("_key", "pid", "x", "y", "z")
    kind, local = classified(p, "_key"), local_primitive(p, "_key")
    centre = p.groupBy("_key").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    far = p.join(centre, "_key").groupBy("_key").agg(F.avg(F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "yz"), (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))))).alias("radius"))
    head = rows.groupBy("_key", "parent_id", "hierarchy_level", "path").agg(F.count("*").alias("n_points"))
    own = ("planarity", "linearity", "sphericity")
    params = F.map_zip_with(F.create_map(*(x for c in own for x in (F.lit(c), F.col(c)))), F.create_map(*(x for c in PRIMITIVES for x in (F.lit(c), F.col(c)))), lambda k, a, b: F.coalesce(b, a))
    both = head.join(kind, "_key").join(local.select("_key", *own, "height", "diameter", "thickness"), "_key").join(far, "_key")
    return both.select(
        F.col(f"_key.{group}").alias(group), F.col("_key.segment_id").alias("segment_id"), "parent_id", "hierarchy_level", "path", F.col("n_points").alias("n"), "feature_type", "confidence", "best",
        params.alias("geometric_params"), measurements(F.col("feature_type"), F.col("height"), F.col("diameter"), F.col("thickness"), F.col("radius")).alias("measures"),
    )


def extracted_features(points: DataFrame, cut, *, k: int = 10, least: int = 30, cosine: float = 0.9659258262890683, outlier_k: int = 20, outlier_stds: float = 2.0, near: float = 2.0, group: str = "cloud") -> DataFrame:
    """Clouds to feature nodes: `(group, node_id, segment, feature_type, confidence, n, measured, surface_area, aspect_ratio,
    quadrant, layer_index, cx, cy, cz, curvature, adjacent)`.

    Outliers go, the rest is centred and scaled into the unit ball; clouds of under ten points give nothing. Normals
    (15 nearest) and two-scale curvatures within three times the cloud's spacing follow; regions grow over the `k` nearest others
    within four times the spacing and 15 degrees, the curvature within 0.35 of the cloud's 75th percentile. A cloud below `least`
    points, or without a region, is one unknown segment. Nodes are numbered by their segment's place; segments that measure nothing take a
    number and are left out. `adjacent` lists the segments whose centroids are less than `near` away."""
    kept = cut(unit_ball(outliers_removed(points, outlier_k, outlier_stds, group), group))
    kept = kept.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where("_n >= 10")
    wide = spacing(kept.select(group, "pid", "x", "y", "z"), k + 1, group)
    rows = cut(kept.join(wide, group))
    xyz = rows.select(group, "pid", "x", "y", "z")
    bends = two_scale_curvature(rows.select(group, "pid", "x", "y", "z", "spacing"), F.col("spacing") * 3.0, group)
    rows = cut(rows.join(point_normals(xyz, 15, group=group), [group, "pid"]).join(bends, [group, "pid"]))
    gap = rows.groupBy(group).agg((F.percentile("curvature", F.lit(0.75)) * 0.35).alias("_gap"))
    grown = rows.where(F.col("_n") >= least).join(gap, group)
    found_ = grow_regions(grown, knn_join(xyz, k + 1, group), F.col("spacing") * 4.0, cosine, F.col("_gap"), least, group, cut, whole=-2)
    small = rows.where(F.col("_n") < least).select(group, "pid", F.lit(-2).alias("segment"))
    placed = found_.where("segment <> -1").union(small).select(group, "pid", F.greatest("segment", F.lit(0)).alias("segment"), (F.col("segment") == -2).alias("_whole"))
    rows = cut(rows.join(placed, [group, "pid"]).withColumn("_key", F.struct(group, "segment")))

    p = rows.select("_key", "pid", "x", "y", "z")
    mean = rows.groupBy("_key").agg(F.avg("curvature").alias("curvature"), *(F.avg(f"n{c}").alias(f"m{c}") for c in "xyz"), F.max("_whole").alias("_whole"))
    even = rows.join(mean.select("_key", "mx", "my", "mz"), "_key").groupBy("_key").agg(F.avg(F.abs(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))).alias("even"))
    shape = summary(p, "_key").select("_key", "n", F.col("c_x").alias("cx"), F.col("c_y").alias("cy"), F.col("c_z").alias("cz"), "linearity", "planarity", "scattering")
    both = shape.join(mean, "_key").join(even, "_key").join(whole_measure(p, "_key"), "_key")
    whole = F.col("_whole")
    kind = F.when(whole, "unknown").otherwise(point_segment_class(F.col("n"), F.col("linearity"), F.col("planarity"), F.col("scattering"), F.col("curvature"), F.col("even")))
    segs = cut(both.select(F.col(f"_key.{group}").alias(group), F.col("_key.segment").alias("segment"), kind.alias("feature_type"), F.when(whole, 0.3).otherwise(0.85).alias("confidence"), "n", "measured", "surface_area", "aspect_ratio", "quadrant", "layer_index", "cx", "cy", "cz", "curvature"))
    pairs = near_centroids(segs.select(group, F.col("segment").alias("pid"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), near, group)
    adjacent = pairs.groupBy(group, F.col("pid1").alias("segment")).agg(F.array_sort(F.collect_list("pid2")).alias("adjacent"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("segment")) - 1
    out = segs.withColumn("node_id", F.format_string("node3d_%03d", place)).join(adjacent, [group, "segment"], "left").where("measured > 0")
    return out.select(group, "node_id", *(c for c in segs.columns if c != group), F.coalesce("adjacent", F.array().cast("array<int>")).alias("adjacent"))


def community_features(points: DataFrame, cut, *, k: int = 10, reach: float = 0.1, least: int = 10, most: int = 10_000, group: str = "cloud") -> tuple[DataFrame, DataFrame]:
    """Bare clouds to classified communities: (members `(group, pid, community)`, features `(group, community, n,
    feature_type, confidence, mean_curvature, max_curvature, normal_variation, planarity, linearity, aspect_ratio, dimension)`).

    Normals and the mean angle to the neighbours' normals (the curvature here) from `k` nearest points, a graph of
    neighbours less than `reach` apart, its Louvain communities of `least` to `most` points, classes by curvature,
    normals and box, descriptor means, and one dimension by the class. All clouds run through every step together; the
    nearest points are looked for once."""
    xyz = cut(points.select(group, "pid", "x", "y", "z"))
    near = cut(knn_join(xyz, k, group))
    faced = cut(xyz.join(point_normals(xyz, k, group=group, near=near), [group, "pid"]))
    desc = cut(descriptors(faced, k, group, near))
    edges = neighbour_edges(xyz, k, reach, group, near)
    found_ = louvain(edges, xyz.select(group, F.col("pid").alias("node")), cut, group=group).select(group, F.col("node").alias("pid"), "community")
    n = F.count("*").over(Window.partitionBy(group, "community"))
    members = cut(found_.withColumn("_n", n).where(F.col("_n").between(least, most)).select(group, "pid", "community"))
    rows = members.join(faced, [group, "pid"]).join(desc.select(group, "pid", "angle", "normal_variation", "planarity", "linearity"), [group, "pid"])
    seg = rows.groupBy(group, "community").agg(
        F.count("*").alias("n"), F.avg("angle").alias("mean_curvature"), F.max("angle").alias("max_curvature"), F.array(*(F.var_pop(f"n{c}") for c in "xyz")).alias("variances"),
        F.array(*(F.max(c) - F.min(c) for c in "xyz")).alias("sides"), *(F.avg(c).alias(c) for c in ("normal_variation", "planarity", "linearity")),
    )
    aspect = F.array_max("sides") / (F.coalesce(F.array_min(F.filter("sides", lambda v: v > 0)), F.lit(0.0)) + 1e-10)
    kind, confidence = graph_segment_class(F.col("n"), F.col("mean_curvature"), F.col("variances"), aspect)
    seg = cut(seg.select(group, "community", "n", kind.alias("feature_type"), confidence.alias("confidence"), "mean_curvature", "max_curvature", "normal_variation", "planarity", "linearity", aspect.alias("aspect_ratio")))
    keyed = members.join(xyz, [group, "pid"]).select(F.struct(group, "community").alias("_key"), "pid", "x", "y", "z")
    size = dimension_of(keyed, seg.select(F.struct(group, "community").alias("_key"), F.col("feature_type").alias("type")), "_key")
    return members, seg.join(size.select(F.col(f"_key.{group}").alias(group), F.col("_key.community").alias("community"), "dimension"), [group, "community"])
