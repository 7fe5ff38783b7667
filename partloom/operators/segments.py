"""Shape statistics, primitive fits and rule cascades per segment (a group of points)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.linear import covariance, distance_to_axis, eigenvalues, eigenvector
from partloom.schemas import SURFACES

EPS = 1e-10


def summary(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Count, centroid, box and the three variances along the principal axes, with their shape ratios."""
    out = points.groupBy(group).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"c_{c}") for c in "xyz"), *(F.min(c).alias(f"min_{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in "xyz"), *covariance()
    )
    out = out.withColumn("e", eigenvalues())
    e0, e1, e2 = F.col("e.e0"), F.col("e.e1"), F.col("e.e2")
    return out.select(
        group, "n", *(f"c_{c}" for c in "xyz"), *(f"min_{c}" for c in "xyz"), *(f"max_{c}" for c in "xyz"), *(f"c{n}" for n in ("xx", "yy", "zz", "xy", "xz", "yz")),
        e0.alias("e0"), e1.alias("e1"), e2.alias("e2"),
        ((e0 - e1) / (e0 + 1e-9)).alias("linearity"), ((e1 - e2) / (e0 + 1e-9)).alias("planarity"), (e2 / (e0 + 1e-9)).alias("scattering"),
    )


def distribution(points: DataFrame, value: str, group: str = "cloud") -> DataFrame:
    """min, max, mean, population deviation and the quartiles (linear interpolation) of a value."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = points.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q"))
    return out.select(group, "min", "max", "mean", "std", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))


def centred(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Points with centred coordinates dx dy dz, the group's size, covariances, eigenvalues and longest and shortest
    axes. One aggregation and one join back on the group."""
    stats = points.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyz"), *covariance()).withColumn("e", eigenvalues())
    stats = stats.withColumn("long_axis", eigenvector(F.col("e.e0"))).withColumn("short_axis", eigenvector(F.col("e.e2")))
    return points.join(stats, group).select("*", *((F.col(c) - F.col(f"m{c}")).alias(f"d{c}") for c in "xyz"))


def _length(*c: Column) -> Column:
    return F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))


def cylinder_fit(points: DataFrame, group: str = "cloud", axis: str = "long_axis") -> DataFrame:
    """Radius (mean distance to the axis through the centroid), its deviation, and the extent along the axis."""
    c = centred(points, group)
    d = [F.col(f"d{k}") for k in "xyz"]
    along = sum((F.col(axis)[k] * d[k] for k in (1, 2)), F.col(axis)[0] * d[0])
    c = c.select(group, distance_to_axis(F.col(axis), *d).alias("r"), along.alias("t"))
    return c.groupBy(group).agg((2 * F.avg("r")).alias("diameter"), F.avg("r").alias("radius"), F.stddev_pop("r").alias("diameter_std"), (F.max("t") - F.min("t")).alias("height"))


def sphere_dimensions(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Mean and deviation of the distance to the centroid and how even it is."""
    c = centred(points, group).select(group, _length(F.col("dx"), F.col("dy"), F.col("dz")).alias("r"))
    out = c.groupBy(group).agg(F.avg("r").alias("radius"), F.stddev_pop("r").alias("std"))
    return out.select(group, (2 * F.col("radius")).alias("diameter"), F.col("std").alias("diameter_std"), "radius", (1 - F.col("std") / (F.col("radius") + EPS)).alias("sphericity"))


def box_dimensions(points: DataFrame, group: str = "cloud") -> DataFrame:
    out = points.groupBy(group).agg(*((F.max(c) - F.min(c)).alias(n) for c, n in zip("xyz", ("length", "width", "height"))))
    return out


def plane_dimensions(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Twice the deviations along the two longer axes, and 1 minus the shortest one's share."""
    e = points.groupBy(group).agg(*covariance()).withColumn("e", eigenvalues())
    total = F.col("e.e0") + F.col("e.e1") + F.col("e.e2")
    return e.select(
        group, (2 * F.sqrt("e.e0")).alias("primary_dimension"), (2 * F.sqrt(F.greatest(F.col("e.e1"), F.lit(0.0)))).alias("secondary_dimension"), (1 - F.col("e.e2") / (total + EPS)).alias("planarity")
    )


def cone_parameters(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Height along the longest axis and the mean axis distances of the lowest and highest tenth, the larger one as
    base. Zeros with fewer than ten points; a tenth of fewer than three points has radius 0."""
    c = centred(points, group)
    d = [F.col(f"d{k}") for k in "xyz"]
    t = sum((F.col("long_axis")[k] * d[k] for k in (1, 2)), F.col("long_axis")[0] * d[0])
    c = c.select(group, "n", t.alias("t"), distance_to_axis(F.col("long_axis"), *d).alias("r"))
    cut = c.groupBy(group).agg(F.percentile("t", F.array(F.lit(0.1), F.lit(0.9))).alias("q"), (F.max("t") - F.min("t")).alias("height"), F.max("n").alias("size"))
    c = c.join(cut, group)
    part = c.groupBy(group, "height", "size").agg(
        *(F.when(F.count(F.when(cond, 1)) >= 3, F.avg(F.when(cond, F.col("r")))).otherwise(0.0).alias(name) for name, cond in (("low", F.col("t") <= F.col("q")[0]), ("high", F.col("t") >= F.col("q")[1])))
    )
    ok = lambda v: F.when(F.col("size") >= 10, v).otherwise(0.0)
    return part.select(group, ok(F.col("height")).alias("height"), ok(F.greatest("low", "high")).alias("base_radius"), ok(F.least("low", "high")).alias("top_radius"))


def primitive_ratios(points: DataFrame, group: str = "cloud", share: float = 0.01) -> DataFrame:
    """Share of points within 1 % of the box diagonal of a plane, cylinder (shortest axis), cone (1.5 times the
    tolerance) and torus (2 times, and an even ring), and mean residuals; the best primitive, the first on ties.

    The plane, cylinder, cone and torus come from one join of points with their group's statistics; for the sphere see
    `all_primitives`."""
    box = points.groupBy(group).agg(*((F.max(c) - F.min(c)).alias(f"s{c}") for c in "xyz"))
    c = centred(points, group).join(box, group)
    d = [F.col(f"d{k}") for k in "xyz"]
    limit = share * _length(F.col("sx"), F.col("sy"), F.col("sz"))
    off = F.abs(sum((F.col("short_axis")[k] * d[k] for k in (1, 2)), F.col("short_axis")[0] * d[0]))
    c = c.select(group, "n", limit.alias("limit"), off.alias("plane"), distance_to_axis(F.col("short_axis"), *d).alias("axis"), _length(*d).alias("ring"))
    means = c.groupBy(group).agg(F.avg("axis").alias("radius"), F.avg("ring").alias("major"), (F.stddev_pop("ring") / (F.avg("ring") + EPS)).alias("uneven"))
    c = c.join(means, group)
    shell = F.abs(F.col("axis") - F.col("radius"))
    near = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    plane, tube, cone = F.col("plane") < F.col("limit"), shell < F.col("limit"), shell < 1.5 * F.col("limit")
    torus = (F.abs(F.col("ring") - F.col("major")) < 2 * F.col("limit")) & (F.col("uneven") < 0.3) & (F.col("n") >= 10)
    out = c.groupBy(group).agg(
        near(plane).alias("plane"), near(tube).alias("cylinder"), near(cone).alias("cone"), near(torus).alias("torus"),
        F.coalesce(F.avg(F.when(plane, F.col("plane"))), F.lit(999.0)).alias("plane_residual"), F.coalesce(F.avg(F.when(tube, shell)), F.lit(999.0)).alias("cylinder_residual"),
    )
    return out.withColumn("best", best_primitive(("plane", "cylinder", "cone", "torus")))


def best_primitive(names: tuple[str, ...]) -> Column:
    """The column with the largest ratio above 0, the first of equals, else 'unknown'."""
    best = F.greatest(*(F.col(n) for n in names))
    out = F.lit("unknown")
    for n in reversed(names):
        out = F.when((F.col(n) == best) & (best > 0), F.lit(n)).otherwise(out)
    return out


def sphere_fit(points: DataFrame, group: str = "cloud", share: float = 0.01) -> DataFrame:
    """Algebraic least-squares sphere of groups of at least four points, and the share of their points within `share` of
    the box diagonal of it. About the centroid the normal equations fall apart into a mean and a symmetric 3x3 system,
    whose sums are one combinable aggregation and whose solution is a quotient of determinants. Points of one plane have
    no single sphere: their centre and radius are null and no point is near."""
    c = centred(points, group)
    d = {k: F.col(f"d{k}") for k in "xyz"}
    q = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    m = c.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(q).alias("mq"), *(F.first(f"m{k}").alias(f"m{k}") for k in "xyz"), *((F.max(k) - F.min(k)).alias(f"s{k}") for k in "xyz"),
        *(F.sum(d[i] * d[j]).alias(i + j) for i, j in ("xx", "xy", "xz", "yy", "yz", "zz")), *((F.sum(d[k] * q) / 2).alias(f"r{k}") for k in "xyz"),
    ).where("n >= 4")
    det = lambda r0, r1, r2: f"({r0[0]} * ({r1[1]} * {r2[2]} - {r1[2]} * {r2[1]}) - {r0[1]} * ({r1[0]} * {r2[2]} - {r1[2]} * {r2[0]}) + {r0[2]} * ({r1[0]} * {r2[1]} - {r1[1]} * {r2[0]}))"
    rows = [["xx", "xy", "xz"], ["xy", "yy", "yz"], ["xz", "yz", "zz"]]
    put = lambda k: [[f"r{'xyz'[i]}" if j == k else v for j, v in enumerate(row)] for i, row in enumerate(rows)]
    m = m.withColumn("det", F.expr(det(*rows))).withColumn("flat", F.expr("abs(det) <= 1e-12 * pow(xx + yy + zz, 3)"))
    m = m.select("*", *(F.expr(f"if(flat, null, {det(*put(k))} / if(flat, 1, det))").alias(f"u{c}") for k, c in enumerate("xyz")))
    fit = m.select(group, "sx", "sy", "sz", *((F.col(f"m{k}") + F.col(f"u{k}")).alias(f"o{k}") for k in "xyz"), F.sqrt(F.expr("mq + ux * ux + uy * uy + uz * uz")).alias("radius"))
    gap = F.abs(_length(*(F.col(k) - F.col(f"o{k}") for k in "xyz")) - F.col("radius"))
    limit = share * _length(F.col("sx"), F.col("sy"), F.col("sz"))
    return points.join(fit, group).groupBy(group, "ox", "oy", "oz", "radius").agg(F.avg(F.when(gap < limit, 1.0).otherwise(0.0)).alias("sphere"))


def all_primitives(points: DataFrame, group: str = "cloud", share: float = 0.01) -> DataFrame:
    """`primitive_ratios` with the sphere's ratio (0 below four points) and the best of all five, the first on ties."""
    ball = sphere_fit(points, group, share).select(group, "sphere")
    out = primitive_ratios(points, group, share).drop("best").join(ball, group, "left").withColumn("sphere", F.coalesce("sphere", F.lit(0.0)))
    return out.withColumn("best", best_primitive(("plane", "cylinder", "sphere", "cone", "torus")))


def shape_properties(points: DataFrame, curvatures: DataFrame, group: str = "cloud") -> DataFrame:
    """Aspect, planarity, circularity, thickness and length ratios and mean curvature of each segment."""
    c = centred(points, group)
    ring = _length(F.col("dx"), F.col("dy"), F.col("dz"))
    out = c.withColumn("ring", ring).groupBy(group).agg(
        *((F.max(k) - F.min(k)).alias(f"s{k}") for k in "xyz"), F.max("e").alias("e"), (F.stddev_pop("ring") / (F.avg("ring") + EPS)).alias("uneven")
    )
    size = F.sort_array(F.array("sx", "sy", "sz"), False)
    out = out.withColumn("size", size).join(curvatures.groupBy(group).agg(F.avg("curvature").alias("curvature")), group)
    return out.select(
        group, "curvature", (F.col("size")[1] / (F.col("size")[0] + EPS)).alias("aspect_ratio"), ((F.col("e.e1") - F.col("e.e2")) / (F.col("e.e0") + EPS)).alias("planarity"),
        (1 - F.least(F.col("uneven"), F.lit(1.0))).alias("circularity"), (F.col("size")[2] / (F.col("size")[1] + EPS)).alias("thickness"), (F.col("size")[0] / (F.col("size")[1] + EPS)).alias("length"),
    )


def cascade(rules: list[tuple[Column, str, float]], other: tuple[str, float]) -> tuple[Column, Column]:
    """First rule that holds gives the label and confidence."""
    label, confidence = F.lit(other[0]), F.lit(other[1])
    for cond, name, conf in reversed(rules):
        label, confidence = F.when(cond, F.lit(name)).otherwise(label), F.when(cond, F.lit(conf)).otherwise(confidence)
    return label, confidence


def manufacturing_feature(best: Column) -> tuple[Column, Column]:
    """Feature and confidence from `shape_properties` and the best primitive. Thresholds and confidences."""
    curv, plan, circ, aspect, thick, long = (F.col(c) for c in ("curvature", "planarity", "circularity", "aspect_ratio", "thickness", "length"))
    tube, ball = best == "cylinder", best == "sphere"
    return cascade(
        [
            (tube & (thick > 0.7) & (long < 2), "hole", 0.85),
            (tube & (long > 2), "cylinder", 0.85),
            (tube & (circ > 0.8) & (aspect < 0.5), "hole", 0.8),
            (tube, "cylinder", 0.7),
            ((best == "plane") & (plan > 0.8), "plane", 0.9),
            (ball & (circ > 0.6) & (thick > 0.6) & (long < 1.5), "hole", 0.75),
            (ball & (circ > 0.6), "sphere", 0.8),
            (ball, "unknown", 0.4),
            (best == "cone", "cone", 0.7),
            (best == "torus", "torus", 0.7),
            ((curv > 0.3) & (thick < 0.5) & (circ > 0.6), "hole", 0.75),
            ((curv > 0.3) & (thick < 0.5), "pocket", 0.7),
            ((curv > 0.2) & (aspect > 0.3) & (aspect < 0.7), "slot", 0.7),
            ((curv > 0.15) & (long > 2), "fillet", 0.65),
            ((plan > 0.6) & (long > 1.5), "step", 0.6),
            ((curv < 0.05) & (plan > 0.5), "plane", 0.7),
        ],
        ("unknown", 0.3),
    )


def point_segment_class(n: Column, linearity: Column, planarity: Column, scattering: Column, curvature: Column, consistency: Column) -> Column:
    """Class of a grown segment. Thresholds."""
    return cascade(
        [
            (n < 5, "unknown", 0.0),
            ((planarity > 0.55) & (curvature < 0.03), "plane", 0.0),
            ((linearity < 0.4) & (planarity > 0.2) & (scattering < 0.12) & (consistency > 0.85), "hole", 0.0),
            ((curvature > 0.03) & (curvature < 0.08) & (planarity > 0.3) & (scattering < 0.15), "chamfer", 0.0),
            (scattering > 0.12, "pocket", 0.0),
        ],
        ("unknown", 0.0),
    )[0]


def graph_segment_class(n: Column, curvature: Column, variances: Column, aspect: Column, curvature_limit: float = 0.5, variance_limit: float = 0.1) -> tuple[Column, Column]:
    """Class of a segment of the neighbour graph. Thresholds and confidences."""
    flat, rough = F.forall(variances, lambda v: v < variance_limit), F.exists(variances, lambda v: v > 0.5)
    return cascade(
        [
            ((curvature > curvature_limit) & (aspect > 2), "taper_hole", 0.7),
            (curvature > curvature_limit, "hole", 0.8),
            (flat & (aspect > 3), "slot", 0.75),
            (flat, "pocket", 0.7),
            (rough & (curvature > 0.3), "fillet", 0.6),
            (rough, "chamfer", 0.65),
            ((n > 100) & (aspect > 1.5), "step", 0.6),
            ((curvature < 0.1) & F.forall(variances, lambda v: v < 0.05), "plane", 0.9),
            ((curvature > 0.2) & (curvature < 0.5), "cylinder", 0.75),
        ],
        ("unknown", 0.5),
    )


def local_primitive(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Kind from variances and box sizes. Thresholds; with variances in falling order the ratio called
    planarity is never positive, so the plane and cone rules cannot fire, as the source of the rules has it."""
    out = points.groupBy(group).agg(F.count("*").alias("n"), *((F.max(c) - F.min(c)).alias(f"s{c}") for c in "xyz"), *covariance()).withColumn("e", eigenvalues())
    e0, e1, e2 = F.col("e.e0"), F.col("e.e1"), F.col("e.e2")
    out = out.withColumn("size", F.sort_array(F.array("sx", "sy", "sz"), False))
    plan, lin, sph = (e1 - e0) / (e0 + EPS), (e0 - e1) / (e0 + EPS), e2 / (e0 + EPS)
    aspect = F.col("size")[1] / (F.col("size")[0] + EPS)
    label, _ = cascade(
        [
            (F.col("n") < 10, "unknown", 0.3),
            ((plan > 5) & (e0 < 0.01), "plane", 0.9),
            ((sph > 0.5) & (F.abs(e0 - e2) < 0.1), "sphere", 0.85),
            (lin > 0.5, "cylinder", 0.8),
            ((plan > 1) & (plan < 5), "cone", 0.6),
            ((aspect > 0.8) & (F.col("size")[2] < 0.1), "hole", 0.7),
            (aspect < 0.3, "slot", 0.65),
            (F.col("size")[2] < 0.2, "pocket", 0.6),
        ],
        ("unknown", 0.3),
    )
    return out.select(group, "n", plan.alias("planarity"), lin.alias("linearity"), sph.alias("sphericity"), F.col("size")[1].alias("diameter"), F.col("size")[0].alias("height"), F.col("size")[2].alias("thickness"), label.alias("feature_type"))


def measurements(kind: Column, length: Column, width: Column, thickness: Column, radius: Column) -> Column:
    """Named millimetre measures of a kind from its sorted box sizes and mean centroid distance, as a map."""
    tube = F.create_map(F.lit("diameter_mm"), width, F.lit("height_mm"), length, F.lit("depth_mm"), length)
    return (
        F.when(kind.isin("cylinder", "hole", "counterbore", "countersink"), tube)
        .when(kind.isin("cone", "taper_hole"), F.create_map(F.lit("base_diameter_mm"), width, F.lit("height_mm"), length, F.lit("depth_mm"), length))
        .when(kind == "sphere", F.create_map(F.lit("radius_mm"), radius, F.lit("diameter_mm"), radius * 2))
        .when(kind == "plane", F.create_map(F.lit("area_mm2"), length * width, F.lit("thickness_mm"), thickness))
        .when(kind.isin("slot", "pocket"), F.create_map(F.lit("length_mm"), length, F.lit("width_mm"), width, F.lit("depth_mm"), thickness))
        .otherwise(F.create_map().cast("map<string,double>"))
    )


def face_group(faces: DataFrame, group: list[str]) -> DataFrame:
    """Dominant surface kind (smallest on ties), area, histogram of ten kinds, whether kinds are mixed, and a label."""
    by = faces.groupBy(*group, "surface_type").agg(F.count("*").alias("n"), F.sum("area_mm2").alias("area"))
    out = by.groupBy(*group).agg(
        F.max_by("surface_type", F.struct("n", -F.col("surface_type"))).alias("dominant_type"), F.sum("area").alias("area"), (F.count("*") > 1).alias("mixed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface_type", "n")))).alias("h"),
    )
    kind = F.col("dominant_type")
    label = (
        F.when(kind == SURFACES["cylinder"], "hole_or_boss").when((kind == SURFACES["torus"]) & (F.col("area") < 100), "fillet").when(kind == SURFACES["torus"], "revolved_surface")
        .when(kind == SURFACES["plane"], "plane_patch").when(kind == SURFACES["bspline"], "freeform").otherwise("unknown")
    )
    hist = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.coalesce(F.element_at("h", i), F.lit(0)))
    return out.select(*group, "dominant_type", "area", "mixed", hist.alias("type_hist"), label.alias("label"))


def segment_face_class(n: Column, kinds: Column, adjacent: Column) -> Column:
    """Class of a segment from its size, its set of surface kinds and its number of neighbours. Thresholds."""
    has = lambda k: F.array_contains(kinds, SURFACES[k])
    plane_only = has("plane") & (F.size(kinds) == 1)
    return cascade(
        [
            (has("cylinder") & (adjacent >= 2), "hole", 0.0),
            (plane_only & (n > 200), "pocket", 0.0),
            (plane_only, "planar_face", 0.0),
            (has("cylinder") & has("plane"), "slot", 0.0),
            (has("plane") & (n < 200), "chamfer", 0.0),
            (has("torus") | has("cone"), "fillet", 0.0),
        ],
        ("unknown", 0.0),
    )[0]


def curvature_bands(curvatures: DataFrame, group: str = "cloud", least: int = 10) -> DataFrame:
    """Points in the bands below the median curvature, up to the 80th percentile, and above; bands of at least `least`."""
    q = curvatures.groupBy(group).agg(F.percentile("curvature", F.array(F.lit(0.5), F.lit(0.8))).alias("q"))
    band = F.when(F.col("curvature") >= F.col("q")[1], "high").when(F.col("curvature") >= F.col("q")[0], "medium").otherwise("low")
    return curvatures.join(q, group).groupBy(group, band.alias("band")).agg(F.count("*").alias("n"), F.avg("curvature").alias("mean")).where(F.col("n") >= least)


def whole_measure(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Twice the mean distance of the uncentred points from the shortest axis through the origin, box, aspect and layer."""
    c = centred(points, group)
    axis = F.col("short_axis")
    out = c.select(group, distance_to_axis(axis, F.col("x"), F.col("y"), F.col("z")).alias("r"), "x", "y", "z").groupBy(group).agg(
        (2 * F.avg("r")).alias("measured"), F.count("*").alias("n"), *((F.max(k) - F.min(k)).alias(f"s{k}") for k in "xyz"), *(F.avg(k).alias(f"c{k}") for k in "xyz")
    )
    sizes = F.array("sx", "sy", "sz")
    quad = F.when((F.col("cx") >= 0) & (F.col("cy") >= 0), "Q1").when((F.col("cx") < 0) & (F.col("cy") >= 0), "Q2").when((F.col("cx") < 0) & (F.col("cy") < 0), "Q3").otherwise("Q4")
    return out.select(
        group, "measured", (F.col("n") * F.lit(0.1)).alias("surface_area"), (F.array_max(sizes) / (F.array_min(F.filter(sizes, lambda v: v > 0)) + 1e-9)).alias("aspect_ratio"),
        quad.alias("quadrant"), F.floor(F.col("cz") / 10).cast("int").alias("layer_index"),
    )


def normalised(points: DataFrame, group: str = "cloud", eps: float = 1e-10) -> DataFrame:
    """Coordinates scaled to 0..1 per axis and group."""
    s = points.groupBy(group).agg(*(F.min(c).alias(f"lo{c}") for c in "xyz"), *(F.max(c).alias(f"hi{c}") for c in "xyz"))
    return points.join(s, group).select(group, "pid", *(((F.col(c) - F.col(f"lo{c}")) / (F.col(f"hi{c}") - F.col(f"lo{c}") + eps)).alias(c) for c in "xyz"))


def unit_ball(points: DataFrame, group: str = "cloud") -> DataFrame:
    """Points centred per group and divided by the largest distance from the centre."""
    m = points.groupBy(group).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = points.join(m, group).select(group, "pid", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))
    r = d.groupBy(group).agg(F.max(_length(F.col("x"), F.col("y"), F.col("z"))).alias("r"))
    return d.join(r, group).select(group, "pid", *((F.col(c) / F.when(F.col("r") > 0, F.col("r")).otherwise(1.0)).alias(c) for c in "xyz"))

