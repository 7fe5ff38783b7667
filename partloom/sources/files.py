"""Readers and writers for the document formats around part data; schemas are given, never inferred."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.functions.text import is_symbol_only, stem
from partloom.schemas import GRAPH, NODE_2D, NODE_3D, _struct


def discover(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.step", "*.stp"), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Files under `root` in the order of patterns, then paths: `path, length, stem`. Contents are not read."""
    found = None
    for i, p in enumerate(patterns):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(root).select(F.lit(i).alias("rank"), "path", "length")
        found = one if found is None else found.union(one)
    out = found.orderBy("rank", "path").offset(offset)
    out = out.limit(limit) if limit is not None else out
    return out.select("path", "length", stem(F.col("path")).alias("stem"))


def not_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose stem has no result yet: what a restarted batch has left."""
    return files.join(done.select("stem"), "stem", "left_anti")


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """`.npy` clouds as rows `cloud, pid, x, y, z`; a file that is no (N, 3) array gives one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    a = np.load(io.BytesIO(raw), allow_pickle=False).astype(float)
                    if a.ndim != 2 or a.shape[1] != 3:
                        raise ValueError(f"shape {a.shape}")
                    yield pd.DataFrame({"path": p, "pid": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "error": None})
                except Exception as e:  # one poisoned file must not end the batch
                    yield pd.DataFrame({"path": [p], "pid": [-1], "x": [None], "y": [None], "z": [None], "error": [str(e)]})

    out = files.mapInPandas(parse, "path string, pid int, x double, y double, z double, error string")
    return out.select(stem(F.col("path")).alias("cloud"), "pid", "x", "y", "z", "error")


def read_svg_text(spark: SparkSession, path: str) -> DataFrame:
    """Text elements of drawings: `doc, pos, text, x, y, rotation`; empty texts and bare symbols are left out."""
    rows = spark.read.format("xml").option("rowTag", "text").schema("_VALUE string, _x string, _y string, _transform string").load(path)
    rows = rows.withColumn("doc", stem(F.col("_metadata.file_path"))).withColumn("text", F.trim("_VALUE")).where("text <> ''")
    kept = rows.where(~is_symbol_only(F.col("text"))).withColumn("_at", F.monotonically_increasing_id())
    angle = F.regexp_extract("_transform", r"rotate\(([-\d.]+)", 1).try_cast("double")
    return kept.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("_at")) - 1).alias("pos"), "text", F.col("_x").try_cast("double").alias("x"), F.col("_y").try_cast("double").alias("y"), F.coalesce(angle, F.lit(0.0)).alias("rotation"))


def read_nodes_2d(spark: SparkSession, path: str) -> DataFrame:
    """`{num_features, features: [...]}` documents as one row per label node."""
    docs = spark.read.option("multiLine", "true").schema(f"num_features long, features array<struct<{_struct(NODE_2D)}>>").json(path)
    return docs.select(stem(F.input_file_name()).alias("doc"), F.explode("features").alias("f")).select("doc", "f.*")


def read_nodes_3d(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.option("multiLine", "true").schema(f"num_features long, features array<struct<{_struct(NODE_3D)}>>").json(path)
    return docs.select(stem(F.input_file_name()).alias("doc"), F.explode("features").alias("f")).select("doc", "f.*")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph documents as label nodes, measured nodes and edges; documents without nodes on both sides are left out."""
    docs = spark.read.option("multiLine", "true").schema(GRAPH).json(path).withColumn("graph", stem(F.input_file_name()))
    docs = docs.where((F.size("nodes_2d") > 0) & (F.size("nodes_3d") > 0))
    two = docs.select("graph", F.explode("nodes_2d").alias("key", "n")).select("graph", "key", "n.*")
    three = docs.select("graph", F.explode("nodes_3d").alias("key", "n")).select("graph", "key", "n.*")
    return two, three, docs.select("graph", F.explode("edges").alias("e")).select("graph", "e.*")


def read_view_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """`{view: {dimensions: [...]}}` documents as one row per dimension, defaults filled in and missing ids counted."""
    dim = "struct<id:string,type:string,value:double,text:string,x:double,y:double,confidence:double,dimension_type:string>"
    docs = spark.read.option("wholetext", "true").text(path).select(stem(F.input_file_name()).alias("doc"), F.from_json("value", f"map<string,struct<dimensions:array<{dim}>>>").alias("views"))
    rows = docs.select("doc", F.explode("views").alias("view", "v")).select("doc", "view", F.posexplode("v.dimensions").alias("k", "d"))
    count = F.row_number().over(Window.partitionBy("doc").orderBy("view", "k")) - 1
    return rows.select(
        "doc", "view", F.coalesce("d.id", F.format_string("node2d_%03d", count)).alias("id"), F.coalesce("d.type", F.lit("dimension")).alias("type"), F.coalesce("d.value", F.lit(0.0)).alias("value"),
        F.coalesce("d.text", F.lit("")).alias("text"), F.coalesce("d.x", F.lit(0.0)).alias("x"), F.coalesce("d.y", F.lit(0.0)).alias("y"), F.coalesce("d.confidence", F.lit(1.0)).alias("confidence"),
    )


def write_nodes(nodes: DataFrame, path: str, by: str = "doc") -> None:
    """One JSON line per document: `{doc, num_features, features}`."""
    fields = [c for c in nodes.columns if c != by]
    nodes.groupBy(by).agg(F.count("*").alias("num_features"), F.sort_array(F.collect_list(F.struct(*fields))).alias("features")).write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("variant").parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).coalesce(1).write.mode("overwrite").json(path)


def read_annotations(spark: SparkSession, path: str, kind: str = "drawings") -> DataFrame:
    """The files that annotation documents list under `kind` (`drawings` or `pointclouds`), as one row each:
    `model_id, step_file, file`."""
    docs = spark.read.option("multiLine", "true").schema("model_id string, step_file string, drawings array<string>, pointclouds array<string>").json(path)
    return docs.select("model_id", "step_file", F.explode(kind).alias("file"))


def existing(listed: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """Listed files that are among those found (`discover`), told by their paths without a scheme."""
    bare = lambda c: F.regexp_replace(c, r"^[a-z]+:/+", "/")
    return listed.join(files.select(bare(F.col("path")).alias("_at")), bare(F.col(column)) == F.col("_at"), "left_semi")


def both_sides(two: DataFrame, three: DataFrame, by: str = "model_id") -> DataFrame:
    """Pairs of files of one part that has both a label file and a feature file; a graph needs either."""
    return two.join(three, by)


def write_annotations(models: DataFrame, path: str) -> None:
    """One JSON line per model: files with their counts. models: model_id, step_file, drawings, pointclouds."""
    counts = F.struct(
        F.size("drawings").alias("num_drawings"), F.size("pointclouds").alias("num_pointclouds"),
        F.array(*map(F.lit, ("front", "top", "side"))).alias("views"), F.array(*map(F.lit, ("ideal", "in_tolerance", "out_of_tolerance"))).alias("deviation_types"),
    )
    models.select("model_id", "step_file", "drawings", "pointclouds", counts.alias("metadata")).write.mode("overwrite").json(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """`{segment: {nodes, feature_type, confidence}}` documents as one row per segment."""
    docs = spark.read.option("wholetext", "true").text(path).select(stem(F.input_file_name()).alias("doc"), F.from_json("value", "map<string,struct<nodes:array<int>,feature_type:string,confidence:double>>").alias("m"))
    return docs.select("doc", F.explode("m").alias("segment", "s")).select("doc", "segment", "s.*")


def write_segments(segments: DataFrame, path: str) -> None:
    """One JSON document per `doc`, a text file each: `{segment: {nodes, feature_type, confidence}}`."""
    body = F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", F.struct("nodes", "feature_type", "confidence")))))
    segments.groupBy("doc").agg(F.to_json(body).alias("value")).select("doc", "value").write.mode("overwrite").partitionBy("doc").text(path)


def write_config(config: DataFrame, path: str, by: str = "model_id") -> None:
    """A model's features as one JSON line, in the order of their ids; of a correspondence's or feature's columns those
    that begin with an underscore are left out."""
    kept = [c for c in config.columns if c != by and not c.startswith("_")]
    config.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("id", *(c for c in kept if c != "id")))).alias("features")).write.mode("overwrite").json(path)
