"""Face adjacency, feature recognition over it, components and segment relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.schemas import SURFACES

PLANE, CYLINDER = SURFACES["plane"], SURFACES["cylinder"]


def face_adjacency(edge_faces: DataFrame) -> DataFrame:
    """Both directions of every pair of faces that share an edge with exactly two faces."""
    two = edge_faces.groupBy("model_id", "edge_id").agg(F.count("*").alias("n"), F.min("face_id").alias("a"), F.max("face_id").alias("b")).where("n = 2")
    return two.select("model_id", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")).select("model_id", "s.a", "s.b").distinct()


def neighbour_kinds(adjacency: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the kinds of their neighbours counted: planes and others."""
    kind = faces.select("model_id", F.col("face_id").alias("b"), F.col("surface_type").alias("other"))
    near = adjacency.join(kind, ["model_id", "b"]).groupBy("model_id", F.col("a").alias("face_id"))
    return near.agg(F.count(F.when(F.col("other") == PLANE, 1)).alias("planes"), F.count(F.when(F.col("other") != PLANE, 1)).alias("others"))


def holes(adjacency: DataFrame, faces: DataFrame) -> DataFrame:
    """Cylinders next to planes: through (two or more) or blind (one)."""
    both = faces.where(F.col("surface_type") == CYLINDER).join(neighbour_kinds(adjacency, faces), ["model_id", "face_id"]).where("planes > 0")
    return both.select("model_id", "face_id", F.when(F.col("planes") >= 2, "through_hole").otherwise("blind_hole").alias("type"), "planes")


def recognise(adjacency: DataFrame, faces: DataFrame) -> DataFrame:
    """Features `(model_id, feat_idx, type, face_ids)` of the rule cascade.

    Holes take their planes even if taken before; planes with three or more other neighbours are pockets; planes with
    exactly two planes still free are slots, then, over again, chamfers; what is left keeps its surface kind. A stage
    walks the faces that were free when it began, in ascending order, so it is sequential within a model: one pandas
    group per model, a few hundred faces.
    """
    near = adjacency.groupBy("model_id", F.col("a").alias("face_id")).agg(F.array_sort(F.collect_list("b")).alias("near"))
    rows = faces.select("model_id", "face_id", "surface_type").join(near, ["model_id", "face_id"], "left")
    rest_names = {v: k for k, v in SURFACES.items() if k in ("plane", "cylinder", "cone", "sphere")}

    def cascade(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = dict(zip(pdf["face_id"], pdf["surface_type"]))
        near = {f: [] if n is None else list(n) for f, n in zip(pdf["face_id"], pdf["near"])}
        free, found = set(kind), []

        def take(label, members):
            found.append((label, [int(m) for m in members]))
            free.difference_update(members)

        planes = {f: [g for g in near[f] if kind.get(g) == PLANE] for f in kind}
        for f in sorted(free):
            if kind[f] == CYLINDER and planes[f]:
                take("through_hole" if len(planes[f]) >= 2 else "blind_hole", [f, *planes[f]])
        for f in sorted(free):
            if kind[f] == PLANE and len(near[f]) - len(planes[f]) >= 3:
                take("pocket", [f, *(g for g in near[f] if kind.get(g) != PLANE)])
        for label in ("slot", "chamfer"):
            for f in sorted(free):
                two = [g for g in planes[f] if g in free]
                if kind[f] == PLANE and len(two) == 2:
                    take(label, [f, *two] if label == "slot" else [f])
        for f in sorted(free):
            take(rest_names.get(kind[f], "unknown"), [f])
        return pd.DataFrame({"model_id": pdf["model_id"].iat[0], "feat_idx": range(len(found)), "type": [t for t, _ in found], "face_ids": [m for _, m in found]})

    return rows.groupBy("model_id").applyInPandas(cascade, "model_id long, feat_idx int, type string, face_ids array<long>")


def point_labels(points: DataFrame, features: DataFrame) -> DataFrame:
    """Points with the index of the last feature that lists their face, -1 without one."""
    of = features.select("model_id", "feat_idx", F.explode("face_ids").alias("face_id")).groupBy("model_id", "face_id").agg(F.max("feat_idx").alias("label"))
    return points.join(of, ["model_id", "face_id"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def segment_points(points: DataFrame, features: DataFrame, least: int = 10) -> DataFrame:
    """Points of every feature, a point of a face in two features in both; features below `least` points left out."""
    of = features.select("model_id", "feat_idx", F.explode(F.array_distinct("face_ids")).alias("face_id"))
    out = points.join(of, ["model_id", "face_id"])
    big = out.groupBy("model_id", "feat_idx").count().where(F.col("count") >= least)
    return out.join(big.drop("count"), ["model_id", "feat_idx"], "left_semi")


def components(edges: DataFrame, nodes: DataFrame, cut, group: str = "model_id") -> DataFrame:
    """Connected components of the nodes `(group, face_id)` under edges `(group, a, b)`: ids by smallest node from 0.

    Every round takes the smallest label around and then the label of that label, so the rounds grow with the
    logarithm of a component's length; `cut(df)` writes a round's labels out. The loop ends when a count of changes,
    the only value that reaches the driver, is 0.
    """
    labels = cut(nodes.select(group, "face_id", F.col("face_id").alias("label")))
    while True:
        near = edges.join(labels.select(group, F.col("face_id").alias("b"), F.col("label").alias("other")), [group, "b"]).groupBy(group, F.col("a").alias("face_id")).agg(F.min("other").alias("other"))
        step = labels.join(near, [group, "face_id"], "left").select(group, "face_id", "label", F.least("label", F.coalesce("other", "label")).alias("next"))
        jump = labels.select(group, F.col("face_id").alias("next"), F.col("label").alias("far"))
        new = cut(step.join(jump, [group, "next"]).select(group, "face_id", F.col("label").alias("old"), F.least("next", "far").alias("label")))
        labels = new.select(group, "face_id", "label")
        if new.where("old <> label").isEmpty():
            break
    number = F.dense_rank().over(Window.partitionBy(group).orderBy("label")) - 1
    return labels.withColumn("component", number).select(group, "face_id", "component")


def segment_adjacency(features: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Per segment its neighbouring segments with the face pair that is met first: faces in the segment's order, then
    neighbouring faces ascending. A face belongs to the last segment that lists it."""
    placed = features.select("model_id", F.col("feat_idx").alias("seg"), F.posexplode("face_ids").alias("place", "a"))
    owner = placed.groupBy("model_id", F.col("a").alias("b")).agg(F.max("seg").alias("other"))
    met = placed.join(adjacency, ["model_id", "a"]).join(owner, ["model_id", "b"]).where("seg <> other")
    first = met.groupBy("model_id", "seg", "other").agg(F.min(F.struct("place", "b", "a")).alias("f"))
    return first.select("model_id", "seg", "other", F.col("f.a").alias("face"), F.col("f.b").alias("other_face"))


def containment(pairs: DataFrame) -> DataFrame:
    """contains / inside flags of segment pairs with boxes (x0..z1), centroids (cx..cz) and areas of both sides
    (the other side's columns have the prefix `o_`)."""
    inside = lambda c, box: F.expr(" and ".join(f"{c}c{k} between {box}{k}0 and {box}{k}1" for k in "xyz"))
    return pairs.withColumn("contains", inside("o_", "") & (F.col("o_area") < 0.8 * F.col("area"))).withColumn("inside", inside("", "o_") & (F.col("area") < 0.8 * F.col("o_area")))


def distinct_edges(edge_faces: DataFrame) -> DataFrame:
    """Edges of a model, each once however many faces list it, with the number of faces."""
    return edge_faces.groupBy("model_id", "edge_id").agg(F.countDistinct("face_id").alias("faces"))


def incidence_counts(edge_faces: DataFrame) -> DataFrame:
    """Faces, edges and edges per face of a model, from its incidence table."""
    return edge_faces.groupBy("model_id").agg(F.countDistinct("face_id").alias("faces"), F.countDistinct("edge_id").alias("edges"), (F.count("*") / F.countDistinct("face_id")).alias("edges_per_face"))
