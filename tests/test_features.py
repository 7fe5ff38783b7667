"""Whole features, records and document formats."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.functions import records as R
from partloom.operators import features as P
from partloom.operators import matching as M
from partloom.operators import metrics as Q
from partloom.operators import sampling as K
from partloom.operators import segments as G
from partloom.operators import spatial as S
from partloom.sources import files


def test_clean_json_is_recursive(spark):
    text = '{" a ": [" x ", {"b  ": "  y z "}], "n": 3, "q": " say \\"hi\\" "}'
    got = json.loads(spark.createDataFrame([(text,)], "t string").select(R.clean_json(F.col("t")).alias("t")).first()["t"])
    assert got == {"a": ["x", {"b": "y z"}], "n": 3, "q": 'say "hi"'}


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("7",), ('{"feature_id": 3}',), ('{"label": 4}',)], "t string").select(R.label_number(F.col("t")).alias("n"))
    assert [x["n"] for x in df.collect()] == [7, 3, 4]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([('{"other": 1}',)], "t string").select(R.label_number(F.col("t")).alias("n")).collect()


def test_nearest_points_of_large_clouds(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    xyz = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(20, 3)) * 0.01 + 4, np.zeros((5, 3))])
    rows = [(1, i, *map(float, p)) for i, p in enumerate(xyz)] + [(2, i, 1.0, 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "cloud long, pid long, x double, y double, z double")
    one = lambda whole: sorted((r["cloud"], r["pid1"], r["rank"], r["pid2"]) for r in S.knn_join(df, 4, whole=whole).collect())
    assert one(2) == one(10_000) and len(one(2)) == 4 * 365


def test_scores_with_odd_values(spark):
    """Value 0, wide tolerances, negative and missing values: buckets lose no pair."""
    labels = [(1, f"l{i}", i, v, t, "R5" if i % 3 == 0 else "⌀5", None, "hole", 1.0, 2.0) for i, (v, t) in enumerate([(0.0, 0.0), (10.0, 9.0), (10.0, 0.1), (-3.0, 0.5), (None, None), (100.0, None), (8.0, 0.0)])]
    values = [[], [("radius", 5.0)], [("diameter", 10.0), ("depth", 3.0)], [("diameter", 101.0)], [("radius", 0.0)], [("depth", -3.0)]]
    features = [(1, f"f{i}", i, "cylinder", v, 1.0, 2.0, i) for i, v in enumerate(values)]
    a = spark.createDataFrame(labels, "model_id long, id string, pos long, value double, tol double, text string, raw_text string, category string, px double, py double")
    b = spark.createDataFrame(features, "model_id long, id string, pos long, type string, values array<struct<key:string,value:double>>, sx double, sy double, n_adjacent int")
    want = set()
    for _, li, i, v, t, text, *_ in labels:
        if v is None:
            continue
        t = v * 0.05 if not t and v > 0 else t or 0.0
        for _, fi, j, _, held, *_, n in features:
            wants_d, wants_r = "⌀" in text, "r" in text.lower() and "⌀" not in text
            c = [x * 2 if k == "radius" and wants_d else x / 2 if k == "diameter" and wants_r else x for k, x in held] or [0.0]
            err = min(abs(v - x) for x in c)
            geom = 0.5 if v == 0 else 1.0 if err <= t else 0.7 if err <= 2 * t else max(0.0, 0.7 - (err - 2 * t) / v)
            if 0.2 + 0.75 * geom + 0.01 + 0.04 * (min(1.0, 0.5 + 0.1 * n) if n else 0.5) >= 0.6:
                want.add((li, fi))
    got = [(r["src"], r["dst"]) for r in M.scores(a, b).collect()]
    assert sorted(got) == sorted(want) and len(want) > 8


def test_positional_split_of_many_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = {r["k"]: r["split"] for r in Q.positional_split(rows, "k", parts=13).collect()}
    assert all(got[k] == ("train" if k < 800 else "val") for k in range(1000))


def test_deviations_stay_within_their_reach(spark):
    points = spark.range(2000).select((F.col("id") % 2).alias("cloud"), F.col("id").alias("pid"), *(F.lit(0.0).alias(c) for c in "xyz"))
    std = lambda df: df.agg(F.stddev_pop("x")).first()[0]
    assert 0.15 < std(K.deviations(points, 1.0, "in_tolerance")) < 0.28 and 0.45 < std(K.deviations(points, 1.0, "out_of_tolerance")) < 1.05
    assert std(K.deviations(points, 1.0, "ideal")) == 0
    out = K.realistic(points, 1.0, "in_tolerance")
    assert 1700 <= out.count() <= 2000 and out.columns == points.columns


def test_graph_segment_classes_and_measurements(spark):
    rows = [(200, 0.6, [0.3, 0.3, 0.3], 3.0), (200, 0.6, [0.3, 0.3, 0.3], 1.0), (20, 0.0, [0.05, 0.05, 0.05], 4.0), (20, 0.35, [0.6, 0.3, 0.3], 1.0), (20, 0.05, [0.2, 0.2, 0.2], 1.0)]
    df = spark.createDataFrame(rows, "n int, c double, v array<double>, a double")
    got = [r["k"] for r in df.select(G.graph_segment_class(F.col("n"), F.col("c"), F.col("v"), F.col("a"))[0].alias("k")).collect()]
    assert got == ["taper_hole", "hole", "slot", "fillet", "unknown"]
    kinds = spark.createDataFrame([("hole",), ("sphere",), ("plane",), ("slot",), ("other",)], "k string")
    m = [r["m"] for r in kinds.select(G.measurements(F.col("k"), F.lit(6.0), F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("m")).collect()]
    assert m[0]["diameter_mm"] == 3 and m[1]["diameter_mm"] == 4 and m[2]["area_mm2"] == 18 and m[3]["depth_mm"] == 1 and m[4] == {}


def test_annotations_and_segments(spark, tmp_path):
    for name in ("a_front.svg", "a_top.svg"):
        (tmp_path / name).write_text("<svg/>")
    models = spark.createDataFrame([("a", "a.step", [f"{tmp_path}/a_front.svg", f"{tmp_path}/gone.svg"], ["a_pc_ideal.npy"])], "model_id string, step_file string, drawings array<string>, pointclouds array<string>")
    files.write_annotations(models, f"{tmp_path}/annotations")
    listed = files.read_annotations(spark, f"{tmp_path}/annotations")
    found = files.existing(listed, files.discover(spark, str(tmp_path), ("*.svg",)))
    assert [r["file"] for r in found.collect()] == [f"{tmp_path}/a_front.svg"] and listed.count() == 2
    segments = spark.createDataFrame([("d", "seg_000", [1, 2], "hole", 0.8), ("d", "seg_001", [3], "slot", 0.5)], "doc string, segment string, nodes array<int>, feature_type string, confidence double")
    files.write_segments(segments, f"{tmp_path}/segments")
    back = files.read_segments(spark, f"{tmp_path}/segments/doc=d")
    assert sorted((r["segment"], r["nodes"], r["feature_type"]) for r in back.collect()) == [("seg_000", [1, 2], "hole"), ("seg_001", [3], "slot")]
    files.write_config(segments.select(F.col("doc").alias("model_id"), F.col("segment").alias("id"), "feature_type", F.lit(1).alias("_tmp")), f"{tmp_path}/config")
    assert [f.asDict() for f in spark.read.json(f"{tmp_path}/config").first()["features"]] == [{"id": "seg_000", "feature_type": "hole"}, {"id": "seg_001", "feature_type": "slot"}]


def test_graphs_splits_and_statistics_are_written(spark, tmp_path):
    edges = spark.createDataFrame([("ideal", "a", "b", 1.0), ("in_tol", "a", "c", 0.5)], "variant string, src string, dst string, weight double")
    files.write_graph(edges, f"{tmp_path}/graph")
    assert spark.read.parquet(f"{tmp_path}/graph").where("variant = 'ideal'").select("src", "dst").first() == ("a", "b")
    files.write_splits(Q.part_split(spark.range(50).withColumnRenamed("id", "part"), "part"), f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits").count() == 50
    files.write_statistics(spark.createDataFrame([(3, 2)], "total int, succeeded int"), f"{tmp_path}/stats")
    assert spark.read.json(f"{tmp_path}/stats").first()["total"] == 3


def test_normals_that_cancel_out(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 0.0), (1, 0.0, -1.0, 0.0), (2, 0.0, 3.0, 4.0)], "cloud long, nx double, ny double, nz double")
    got = {r["cloud"]: (r["normal_x"], round(r["normal_y"], 6), round(r["normal_z"], 6)) for r in P.normal_statistics(df).collect()}
    assert got == {1: (0.0, 0.0, 1.0), 2: (0.0, 0.6, 0.8)}


def _equal_sides(spark, n):
    labels = spark.range(n).select(
        F.lit(1).alias("model_id"), F.format_string("l%d", "id").alias("id"), F.col("id").alias("pos"), F.lit(10.0).alias("value"), F.lit(0.5).alias("tol"), F.lit("10").alias("text"), F.lit("").alias("raw_text"), F.lit("hole").alias("category"),
        (F.col("id") % 7 * 20).cast("double").alias("px"), F.lit(0.0).alias("py"),
    )
    values = F.array(F.struct(F.lit("depth").alias("key"), F.when(F.col("id") % 2 == 0, 10.0).otherwise(13.0).alias("value")))
    features = spark.range(n).select(F.lit(1).alias("model_id"), F.format_string("f%d", "id").alias("id"), F.col("id").alias("pos"), F.lit("cylinder").alias("type"), values.alias("values"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), (F.col("id") % 6).cast("int").alias("n_adjacent"))
    return labels, features


def test_counts_and_best_labels_equal_the_scored_pairs(spark):
    a, b = _equal_sides(spark, 600)
    scored = M.scores(a, b).toPandas()
    assert 0 < len(scored) == M.score_counts(a, b).first()["listed"]
    assert not 600 * 600 == len(scored)  # the least score cuts through a pair of classes
    want = {r.dst: r.src for r in scored.assign(s=scored["score"].round(9)).sort_values(["s", "i"], ascending=[False, True]).drop_duplicates("dst").itertuples()}
    assert {r["dst"]: r["src"] for r in M.best_labels(a, b).collect()} == want


def test_pairs_of_equal_rows_are_counted_by_class(spark):
    """40,000 x 20,000 pairs, which no machine makes in a test."""
    a, b = _equal_sides(spark, 40_000)
    assert M.score_counts(a, b.where("pos % 2 = 0")).first()["listed"] == 40_000 * 20_000
    plan = M.scores(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "NestedLoop" not in plan
