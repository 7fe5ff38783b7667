"""Joins that must not compare all with all, and matching by components."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.operators import features, matching, spatial
from partloom.plans.runtime import cutter
from partloom.sources import files

XYZ = "cloud int, pid long, x double, y double, z double"


def test_far_point_does_not_widen_the_reach(spark):
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    x[7] = [10_000, 0, 0]
    p = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)], XYZ)
    met = []
    pairs = spatial._pairs_in
    spatial._pairs_in = lambda *a, **k: met.append(pairs(*a, **k)) or met[-1]
    try:
        near = spatial.knn_join(p, 8).collect()
    finally:
        spatial._pairs_in = pairs
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(d[i], kind="stable")[:8]}
    assert {(n["pid1"], n["pid2"]) for n in near} == want and met[0].count() < 1_500_000


def test_nearest_of_others_and_interpolation(spark):
    r = np.random.default_rng(2)
    rows = lambda n, first: [(c, first + i, *map(float, v)) for c in (0, 1) for i, v in enumerate(r.random((n if c else 20, 3)))]
    a, b = rows(60, 0), rows(900, 1000)
    got = {}
    for x in spatial.knn_between(spark.createDataFrame(a, XYZ), spark.createDataFrame(b, XYZ), 3).collect():
        got.setdefault((x["cloud"], x["pid1"]), []).append((x["rank"], x["pid2"]))
    for c, i, *v in a:
        others = sorted((sum((p - q) ** 2 for p, q in zip(v, w)), j) for e, j, *w in b if e == c)
        assert [j for _, j in sorted(got[c, i])] == [j for _, j in others[:3]]
    value = spark.createDataFrame([(*row, float(row[1])) for row in b], XYZ + ", v double")
    out = {(x["cloud"], x["pid"]): x["v"] for x in spatial.interpolate(spark.createDataFrame(a, XYZ), value, "v").collect()}
    c, i, *v = a[-1]
    others = sorted((sum((p - q) ** 2 for p, q in zip(v, w)), j) for e, j, *w in b if e == c)[:3]
    assert len(out) == len(a) and out[c, i] == pytest.approx(sum(j / d for d, j in others) / sum(1 / d for d, _ in others))


def test_shapes_meet_points_of_their_cells(spark):
    r = np.random.default_rng(3)
    points = [(c, i, *map(float, v)) for c in (0, 1) for i, v in enumerate(r.random((300, 3)) * 10)]
    boxes = [(c, f, *(float(v) for a, s in zip(r.random(3) * 10, r.random(3)) for v in (a, a + s * (f % 3)))) for c in (0, 1) for f in range(20)]
    tubes = [(c, f, *map(float, r.random(2) * 10), float(r.random() * 2)) for c in (0, 1, 2) for f in range(20)]
    p = spark.createDataFrame(points, XYZ)
    got = {tuple(x) for x in spatial.in_box(p, spark.createDataFrame(boxes, "cloud int, feature int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"), 0.1).collect()}
    assert got == {(c, f, i) for c, f, *b in boxes for d, i, *v in points if c == d and all(b[2 * k] - 0.1 <= v[k] <= b[2 * k + 1] + 0.1 for k in range(3))} and got
    got = {tuple(x) for x in spatial.in_shell(p, spark.createDataFrame(tubes, "cloud int, feature int, cx double, cy double, radius double"), 0.2).collect()}
    assert got == {(c, f, i) for c, f, cx, cy, rad in tubes for d, i, *v in points if c == d and abs(np.hypot(v[0] - cx, v[1] - cy) - rad) < 0.2} and got


@pytest.mark.parametrize("kind", ["long", "string"])
def test_optimal_matches_by_components(spark, kind):
    """Against all permutations: models of several components, unequal sides, sides that cannot be matched whole."""
    r = np.random.default_rng(5)
    rows, sides, want = [], [], {}
    for m in range(24):
        key = m if kind == "long" else f"m{m}"
        n2, n3 = int(r.integers(2, 6)), int(r.integers(2, 6))
        mine = {(i, j): round(float(r.random()), 6) for i in range(n2) for j in range(n3) if r.random() < (0.3 if m % 2 else 0.9)}
        if not mine:
            mine = {(0, 0): 0.5}
        rows += [(key, i, j, s) for (i, j), s in mine.items()]
        sides.append((key, n2, n3))
        small, large = sorted((n2, n3))
        totals = [sum(mine[(i, p[i]) if n2 <= n3 else (p[i], i)] for i in range(small)) for p in itertools.permutations(range(large), small) if all(((i, p[i]) if n2 <= n3 else (p[i], i)) in mine for i in range(small))]
        want[key] = (small, max(totals)) if totals else None
    scored = spark.createDataFrame(rows, f"model_id {kind}, i long, j long, score double")
    got = matching.optimal_matches(scored, cutter(spark), spark.createDataFrame(sides, f"model_id {kind}, n2 long, n3 long")).collect()
    by = {}
    for x in got:
        by.setdefault(x["model_id"], []).append(x)
    assert sum(v is not None for v in want.values()) >= 3 and sum(v is None for v in want.values()) >= 2
    for key, v in want.items():
        assert len({x["i"] for x in by[key]}) == len({x["j"] for x in by[key]}) == len(by[key])
        if v:
            assert (len(by[key]), sum(x["score"] for x in by[key])) == (v[0], pytest.approx(v[1]))


def test_first_dimension_of_each_kind(spark):
    f = spark.createDataFrame([(1, "a", "hole", 5.0, 5.5), (1, "b", "nothing known", 2.0, 2.0), (2, "c", "hole", 4.0, 4.0)], "model_id long, id string, type string, nominal double, measured double")
    d = spark.createDataFrame([(1, f"d{i}", 10 - i, t, float(i), 0.1) for i, t in enumerate(("diameter", "linear", "radius", "diameter"))], "model_id long, dim_id string, pos long, dimension_type string, value double, tol double")
    got = {x["id"]: x for x in features.correspondences(f, d).collect()}
    from partloom.functions.records import DIMENSIONS_OF

    fits = [x for x in d.collect() if x["dimension_type"] in DIMENSIONS_OF.get("hole", ())]
    first = min(fits, key=lambda x: x["pos"])["dim_id"] if fits else "synthetic_a"
    assert got["a"]["dim_id"] == first and got["b"]["dim_id"] == "synthetic_b" and got["c"]["dim_id"] == "synthetic_c" and got["b"]["tol"] == pytest.approx(0.04)


def test_node_documents_and_kinds(spark, tmp_path):
    """Nodes written and read again are the same, nulls and all; the first name that is not blank."""
    from partloom.functions.text import first_kind
    from partloom.schemas import NODE_2D, NODE_3D, _struct

    for schema, read in ((NODE_2D, files.read_nodes_2d), (NODE_3D, files.read_nodes_3d)):
        names = spark.createDataFrame([], f"s struct<{_struct(schema)}>").select("s.*").schema
        empty = [None] * len(names)
        rows = spark.createDataFrame([tuple(["one" if f.dataType.typeName() == "string" else None for f in names]), tuple(empty)], names)
        doc = rows.select(F.collect_list(F.struct(*rows.columns)).alias("features")).select(F.lit(2).alias("num_features"), "features")
        path = str(tmp_path / schema.__class__.__name__ / str(len(names)))
        doc.coalesce(1).write.json(path)
        back = read(spark, path)
        assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect())) and back.select("doc").distinct().count() == 1
    t = spark.createDataFrame([(None, " ", "hole"), (" slot ", "x", None), (None, None, "")], "a string, b string, c string")
    assert [x[0] for x in t.select(first_kind(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["hole", "slot", "unknown"]


@pytest.mark.parametrize("band", [20, 100_000])
def test_greedy_bands_are_the_greedy_result(spark, band):
    """Labels and features of all ways of reading, several values, tied scores and one model with a value of 0: the result
    over all pairs, however large a band is."""
    r = np.random.default_rng(8)
    texts, categories = ["5", "⌀5", "R5", "diameter 5", "⌀5 r"], ["dimension", "hole", "datum", "slot width", "chamfer"]
    labels = [
        (m, f"l{i}", i, float(r.integers(30, 60)) if (m, i) != (2, 4) else 0.0, [None, 0.0, 0.5, 2.0][i % 4], texts[int(r.integers(5))], "", categories[m % 5], float(r.integers(0, 200)), float(r.integers(0, 200)))
        for m in range(5) for i in range(40)
    ]
    kinds, keys = ["plane", "cylinder", "through_hole", "pocket", "slot", "cone", "sphere", "chamfer"], ["diameter", "radius", "length"]
    measured = [
        (m, f"f{j}", j, kinds[int(r.integers(8))], [(keys[int(r.integers(3))], float(r.integers(15, 70))) for _ in range(int(r.integers(0, 4)))], float(r.integers(0, 200)), float(r.integers(0, 200)), j % 7)
        for m in range(5) for j in range(40)
    ]
    a = spark.createDataFrame(labels, "model_id long, id string, pos long, value double, tol double, text string, raw_text string, category string, px double, py double")
    b = spark.createDataFrame(measured, "model_id long, id string, pos long, type string, values array<struct<key: string, value: double>>, sx double, sy double, n_adjacent int")
    key = lambda df: sorted(tuple(x) for x in df.select("model_id", "src", "dst", "i", "j", "score", "deviation", "status").collect())
    want = key(matching.greedy_matches(matching.scores(a, b), cutter(spark)))
    assert key(matching.greedy_bands(a, b, cutter(spark), band)) == want and len(want) > 40


def test_models_that_cannot_be_matched_whole_make_no_pairs(spark, sf, monkeypatch):
    """No model of the fixture has partners for all of its smaller side, which kinds alone tell."""
    from partloom.plans import graph_queries as G

    a, b = G._labels(spark, sf), G._measured(spark, sf)
    sides = a.groupBy("model_id").agg(F.count("*").alias("n2")).join(b.groupBy("model_id").agg(F.count("*").alias("n3")), "model_id")
    pick = lambda df: sorted(tuple(x) for x in df.select("model_id", "src", "dst", "score").collect())
    want = pick(matching.optimal_matches(matching.scores(a, b), cutter(spark), sides))
    monkeypatch.setattr(matching, "scores", None)
    assert pick(matching.best_matches(a, b, cutter(spark))) == want and want


def test_vectors_meet_as_blocks(spark, monkeypatch):
    """Groups of several blocks, ties to nine places, a vector with a null, and a group without keys."""
    from partloom.operators import metrics

    monkeypatch.setattr(metrics, "BLOCK", 16)
    monkeypatch.setattr(metrics, "STRIP", 5)
    r = np.random.default_rng(6)
    v = {(c, i): [float(x) for x in r.integers(-2, 3, 3) + 0.5] for c in range(3) for i in range(90)}
    null = {(1, 7)}
    at = lambda c, i: [None, 1.0, 1.0] if (c, i) in null else v[c, i]
    queries = spark.createDataFrame([(c, i, at(c, i), i + 1) for c, i in v if i % 2 == 0], "cloud int, qid long, v array<double>, truth long")
    keys = spark.createDataFrame([(c, i, at(c, i)) for c, i in v if i % 2 and c < 2], "cloud int, kid long, v array<double>")
    unit = {k: np.array(x) / np.linalg.norm(x) for k, x in v.items()}
    want = {}
    for c in (0, 1):
        hits = []
        for i in range(0, 90, 2):
            hits.append(max((k for k in range(1, 90, 2) if (c, k) not in null), key=lambda k: (round(float(unit[c, i] @ unit[c, k]), 9), -k)) == i + 1)
        want[c] = (45, pytest.approx(np.mean(hits)))
    met = metrics.recall_at_1(queries, keys)
    assert {x["cloud"]: (x["n"], x["recall_at_1"]) for x in met.collect()} == want
    assert "InArrow" in met._jdf.queryExecution().toString()

    pairs = spark.createDataFrame([(c, i, v[c, i], v[c, i + 1]) for c, i in v if i % 2 == 0], "cloud int, eid long, a array<double>, b array<double>")
    got = {x["cloud"]: x["loss"] for x in metrics.contrastive_loss(pairs, 0.2).collect()}
    for c in range(3):
        s = np.array([[unit[c, i] @ unit[c, j + 1] / 0.2 for j in range(0, 90, 2)] for i in range(0, 90, 2)])
        both = [np.log(np.exp(m).sum(1)) - np.diag(m) for m in (s, s.T)]
        assert got[c] == pytest.approx(np.mean(both))


@pytest.mark.parametrize("whole", [1, 64])
def test_neighbour_joins_are_dealt_to_tasks(spark, monkeypatch, whole):
    """Few large groups: their points go to as many tasks as asked for, and not with the group's row to one."""
    r = np.random.default_rng(9)
    points = [(c, i, *map(float, v)) for c in range(2) for i, v in enumerate(r.random((400, 3)))]
    p, met = spark.createDataFrame(points, XYZ).repartition(1), []
    for name in ("_pairs_in", "knn_join_of"):
        join = getattr(spatial, name)
        monkeypatch.setattr(spatial, name, lambda *a, join=join, **k: met.append(join(*a, **k)) or met[-1])
    near = spatial.knn_join(p, 5, whole=whole).select("cloud", "pid1", "pid2").collect()
    dealt = [m.rdd.getNumPartitions() for m in met if not m.isEmpty()]
    assert dealt and min(dealt) >= 4
    xyz = np.array([q[2:] for q in points if q[0] == 1])
    order = np.argsort(((xyz[:, None] - xyz[None]) ** 2).sum(2), axis=1, kind="stable")[:, :5]
    assert {(x["pid1"], x["pid2"]) for x in near if x["cloud"] == 1} == {(i, int(j)) for i in range(400) for j in order[i]}


def test_near_centroids_meet_in_tiles(spark, monkeypatch, tmp_path):
    """Many segments in one cell are dealt to tasks; the pairs are those of a plain comparison. Rows go to their cloud once."""
    from partloom.plans import shape_queries

    monkeypatch.setattr(spatial, "TILE", 16)
    rng = np.random.default_rng(5)
    p = rng.normal(0, 1.2, (150, 3))
    points = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(p)], "cloud int, pid long, x double, y double, z double")
    got = sorted(map(tuple, spatial.near_centroids(points, 2.0).select("cloud", "pid1", "pid2").collect()))
    assert got == sorted((i % 2, i, j) for i in range(150) for j in range(150) if i != j and i % 2 == j % 2 and ((p[i] - p[j]) ** 2).sum() < 4)
    met = spatial._tiled_pairs(points, 2.0, "cloud")
    most = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < met.count() / 8
    rows = [(i % 3, float(i % 7), float(i), 0.01 * (i % 4)) for i in range(60)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert shape_queries._centroids(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("low", [0, -20])
def test_only_features_without_a_label_in_tolerance_meet_all_classes(spark, monkeypatch, low):
    """All ways of reading, several values, tied scores, places that fit one number with the score and such that do not."""
    r = np.random.default_rng(12)
    texts, categories = ["5", "⌀5", "R5", "diameter 5", "⌀5 r"], ["dimension", "hole", "datum", "slot width", "chamfer"]
    labels = [(m, f"l{i}", i + low, float(r.integers(30, 60)) if (m, i) != (2, 4) else 0.0, [None, 0.0, 0.5, 2.0][i % 4], texts[int(r.integers(5))], "", categories[m % 5], 20.0 * int(r.integers(0, 6)), 0.0) for m in range(5) for i in range(40)]
    kinds, keys = ["plane", "cylinder", "through_hole", "pocket", "slot", "cone", "sphere", "chamfer"], ["diameter", "radius", "length"]
    measured = [
        (m, f"f{j}", j, kinds[int(r.integers(8))], [(keys[int(r.integers(3))], float(r.integers(15, 70))) for _ in range(int(r.integers(0, 4)))], 20.0 * int(r.integers(0, 6)), 0.0, j % 7)
        for m in range(5) for j in range(40)
    ]
    a = spark.createDataFrame(labels, "model_id long, id string, pos long, value double, tol double, text string, raw_text string, category string, px double, py double")
    b = spark.createDataFrame(measured, "model_id long, id string, pos long, type string, values array<struct<key: string, value: double>>, sx double, sy double, n_adjacent int")
    scored = matching.scores(a, b).toPandas()
    want = {(x.model_id, x.dst): x.src for x in scored.assign(s=scored["score"].round(9)).sort_values(["s", "i"], ascending=[False, True]).drop_duplicates(["model_id", "dst"]).itertuples()}
    met, real = [], matching._best_by_classes
    monkeypatch.setattr(matching, "_best_by_classes", lambda x, y, n: met.extend((v["model_id"], v["id"]) for v in y.collect()) or real(x, y, n))
    assert {(x["model_id"], x["dst"]): x["src"] for x in matching.best_labels(a, b).collect()} == want
    sure = {(x.model_id, x.dst) for x in scored.itertuples() if x.geom == 1.0}
    assert sure and sure.isdisjoint(met) and len(sure) + len(met) == len(measured)
