"""A directory of clouds as a batch: one bad file costs its own row, and a run that is started again does what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.operators.metrics import run_statistics
from partloom.operators.segmentation import community_features
from partloom.sources.files import discover, not_done, read_clouds

STATUS = "cloud string, ok boolean, error string, num_points long, num_segments long, run int"


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def latest(status: DataFrame) -> DataFrame:
    """Of every file the row of its last run."""
    return status.withColumn("_place", F.row_number().over(Window.partitionBy("cloud").orderBy(F.desc("run")))).where("_place = 1").drop("_place")


def process_directory(spark: SparkSession, source: str, target: str, cut, *, segment=community_features, neighbours: int = 10, limit: int | None = None) -> DataFrame:
    """Segments every `.npy` cloud under `source` that has no result under `target` yet; returns the run's status rows.

    Written are `target/segments/doc=<cloud>/` (a JSON document each: `{segment: {nodes, feature_type, confidence}}`)
    and, after them, `target/status`, a row for each file: whether it went well, the error, its points and segments. A file
    that is no (N, 3) array, has entries that are not finite, or no more points than `neighbours` is an error row and takes no further part;
    all other files go through `segment` together, as one set of Spark jobs. Files with a good row are left out
    of the next run, so a run that was broken off, or had bad files that were mended since, takes up what is missing;
    results are written by file and may be written twice."""
    before = _written(spark, f"{target}/status", STATUS)
    files = discover(spark, source, ("*.npy",), limit)
    run = 0
    if before is not None:
        files = not_done(files, before.where("ok").select(F.col("cloud").alias("stem")))
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
    todo = cut(files.select(F.col("stem").alias("cloud")))
    points = cut(read_clouds(spark, source).join(todo, "cloud", "left_semi"))
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    state = points.groupBy("cloud").agg(F.max("error").alias("error"), F.count(F.when(F.col("error").isNull(), 1)).alias("num_points"), F.count(F.when(F.col("error").isNull() & ~finite, 1)).alias("odd"))
    why = F.coalesce("error", F.when(F.col("odd") > 0, F.format_string("%d points are not finite", "odd")), F.when(F.col("num_points") <= neighbours, F.format_string("only %d points", "num_points")))
    # an array without points has no row at all
    state = cut(todo.join(state.select("cloud", "num_points", why.alias("error")), "cloud", "left").select("cloud", F.coalesce("num_points", F.lit(0)).alias("num_points"), F.when(F.col("num_points").isNull(), "no points").otherwise(F.col("error")).alias("error")))
    good = points.join(state.where("error is null").select("cloud"), "cloud", "left_semi").select("cloud", F.col("pid").cast("long").alias("pid"), "x", "y", "z")

    members, features = segment(good, cut)
    nodes = members.groupBy("cloud", "community").agg(F.array_sort(F.collect_list(F.col("pid").cast("int"))).alias("nodes"))
    found = cut(features.select("cloud", "community", "feature_type", "confidence").join(nodes, ["cloud", "community"]))
    number = F.row_number().over(Window.partitionBy("cloud").orderBy("community")) - 1
    named = found.withColumn("segment", F.format_string("seg_%03d", number))
    body = F.map_from_entries(F.sort_array(F.collect_list(F.struct("segment", F.struct("nodes", "feature_type", "confidence")))))
    docs = named.groupBy(F.col("cloud").alias("doc")).agg(F.to_json(body).alias("value")).select("doc", "value")
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").text(f"{target}/segments")

    counts = found.groupBy("cloud").agg(F.count("*").alias("num_segments"))
    rows = state.join(counts, "cloud", "left").select(
        "cloud", F.col("error").isNull().alias("ok"), "error", "num_points", F.when(F.col("error").isNull(), F.coalesce("num_segments", F.lit(0))).cast("long").alias("num_segments"), F.lit(run).alias("run")
    )
    rows = cut(rows)
    rows.write.mode("append").parquet(f"{target}/status")
    return rows


def summary(spark: SparkSession, target: str) -> DataFrame:
    """Files, successes, failures, their share, segments made and their mean, over the last row of every file."""
    return run_statistics(latest(spark.read.schema(STATUS).parquet(f"{target}/status")), F.col("ok"), F.col("num_segments"))
