"""Operators that SQL cannot follow, and small cases with answers worked out by hand."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.functions import text as T
from partloom.functions import vectors as V
from partloom.functions.linear import covariance, eigenvalues, eigenvector
from partloom.operators import clusters, matching, metrics, sampling, segments, spatial, topology
from partloom.plans.runtime import cutter
from partloom.sources import files, fixtures


def one(spark, col):
    return spark.range(1).select(col.alias("c")).first()["c"]


@pytest.mark.parametrize(
    "text,kind,nominal,upper,lower",
    [
        ("207.26±5.63", "symmetric", 207.26, 212.89, 201.63), ("207.260/-7.66", "asymmetric", 207.26, 207.26, 199.6), ("205.23+5.20/0", "asymmetric", 205.23, 210.43, 205.23),
        ("⌀0.5", "nominal_only", 0.5, 0.5, 0.5), ("A", "unknown", 0, 0, 0), ("", "unknown", 0, 0, 0), (None, "unknown", 0, 0, 0),
    ],
)
def test_dimension(spark, text, kind, nominal, upper, lower):
    p = one(spark, T.dimension(F.lit(text).cast("string")))
    assert p["type"] == kind and [p["nominal"], p["upper_limit"], p["lower_limit"]] == pytest.approx([nominal, upper, lower])


def test_tolerance_legacy_eats_digits(spark):
    assert one(spark, T.tolerance(F.lit("10"), True))["nominal"] == 0 and one(spark, T.tolerance(F.lit("12.5"), True))["nominal"] == 2.5
    assert one(spark, T.tolerance(F.lit("12.5")))["nominal"] == 12.5 and one(spark, T.tolerance(F.lit("10 H7")))["type"] == "fit"


def test_datums_and_symbols(spark):
    assert one(spark, T.datum_letters(F.lit("A - B C"))) == ["A", "B", "C"] and one(spark, T.datum_letters(F.lit("AB"))) == []
    assert one(spark, T.is_symbol_only(F.lit("⌖"))) and not one(spark, T.is_symbol_only(F.lit("A")))
    assert one(spark, T.part_of(T.stem(F.lit("/x/M_1_front_features.json")))) == "M_1"


def test_eigen_agrees_with_numpy(spark):
    x = np.random.default_rng(1).normal(size=(60, 3)) @ np.diag([3, 2, 1])
    df = spark.createDataFrame([(0, *map(float, r)) for r in x], "g int, x double, y double, z double")
    e = df.groupBy("g").agg(*covariance()).withColumn("e", eigenvalues()).withColumn("v", eigenvector(F.col("e.e0"))).first()
    val, vec = np.linalg.eigh(np.cov(x.T))
    assert [e["e"]["e0"], e["e"]["e1"], e["e"]["e2"]] == pytest.approx(val[::-1])
    assert abs(np.dot(e["v"], vec[:, 2])) == pytest.approx(1)
    flat = spark.range(3).selectExpr("0 g", "1.0D x", "1.0D y", "1.0D z").groupBy("g").agg(*covariance()).select(eigenvalues().alias("e")).first()["e"]
    assert tuple(flat) == (0, 0, 0)


def _brute_cascade(near, kind):
    planes = {f: [g for g in near[f] if kind[g] == 0] for f in kind}
    free, out = set(kind), []
    for f in [f for f in sorted(free) if kind[f] == 1 and planes[f]]:
        out.append("through_hole" if len(planes[f]) > 1 else "blind_hole")
        free -= {f, *planes[f]}
    for f in [f for f in sorted(free) if kind[f] == 0 and len(near[f]) - len(planes[f]) >= 3]:
        out.append("pocket")
        free -= {f, *(g for g in near[f] if kind[g])}
    for name in ("slot", "chamfer"):
        for f in sorted(free):
            two = [g for g in planes[f] if g in free]
            if kind[f] == 0 and len(two) == 2:
                out.append(name)
                free -= {f, *two} if name == "slot" else {f}
    return out + [("plane", "cylinder", "cone", "sphere", "unknown")[kind[f]] for f in sorted(free)]


def test_cascade(spark, sf):
    adj, faces = topology.face_adjacency(fixtures.edge_faces(spark, sf)), fixtures.faces(spark, sf)
    got = {}
    for r in topology.recognise(adj, faces).orderBy("model_id", "feat_idx").collect():
        got.setdefault(r["model_id"], []).append(r["type"])
    kind, near = {}, {}
    for r in faces.collect():
        kind.setdefault(r["model_id"], {})[r["face_id"]] = r["surface_type"]
        near.setdefault(r["model_id"], {})[r["face_id"]] = []
    for r in adj.orderBy("a", "b").collect():
        near[r["model_id"]][r["a"]].append(r["b"])
    assert got == {m: _brute_cascade(near[m], kind[m]) for m in kind}


def test_greedy_is_greedy_and_one_to_one(spark):
    rng = np.random.default_rng(3)
    rows = [(m, i, j, float(rng.integers(60, 70)) / 100) for m in range(3) for i in range(7) for j in range(9) if rng.random() < 0.6]
    got = matching.greedy_matches(spark.createDataFrame(rows, "model_id long, i long, j long, score double"), cutter(spark)).collect()
    want, used = set(), set()
    for m, i, j, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (m, "i", i) not in used and (m, "j", j) not in used:
            used |= {(m, "i", i), (m, "j", j)}
            want.add((m, i, j))
    assert {(r["model_id"], r["i"], r["j"]) for r in got} == want and len(got) == len(want)


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 3), (6, 6)):
        for _ in range(20):
            c = rng.random((n, m))
            got = matching.assignment(c)
            small = min(n, m)
            best = min(sum(c[i, p[i]] if n <= m else c[p[i], i] for i in range(small)) for p in itertools.permutations(range(max(n, m)), small))
            assert sum(c[i, j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == small
    assert matching.assignment(np.array([[1.0, np.inf], [1.0, np.inf]])) is None


def test_optimal_falls_back_to_greedy(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.89), (2, 0, 0, 0.9), (2, 1, 0, 0.8)]
    sides = spark.createDataFrame([(1, 2, 2), (2, 2, 2)], "model_id long, n2 long, n3 long")
    got = matching.optimal_matches(spark.createDataFrame(rows, "model_id long, i long, j long, score double"), cutter(spark), sides).collect()
    assert {(r["model_id"], r["i"], r["j"]) for r in got} == {(1, 0, 1), (1, 1, 0), (2, 0, 0)}


def test_sphere_fit_finds_sphere(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(size=(50, 3))
    x = d / np.linalg.norm(d, axis=1)[:, None] * 2.5 + [1, 2, 3]
    r = segments.sphere_fit(spark.createDataFrame([(0, *map(float, p)) for p in x], "cloud int, x double, y double, z double")).first()
    assert [r["ox"], r["oy"], r["oz"], r["radius"], r["sphere"]] == pytest.approx([1, 2, 3, 2.5, 1])


def test_farthest_points(spark):
    p = spark.createDataFrame([(0, i, float(i), 0.0, 0.0) for i in range(11)], "cloud int, pid long, x double, y double, z double")
    assert [r["pid"] for r in sampling.farthest_points(p, 4).orderBy("place").collect()] == [0, 10, 5, 2]


def test_grown_regions(spark):
    pts = [(0, i, i * 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0) for i in range(6)] + [(0, 10 + i, 100.0 + i, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0) for i in range(3)]
    p = spark.createDataFrame(pts, "cloud int, pid long, x double, y double, z double, nx double, ny double, nz double, curvature double")
    near = spatial.knn_join(p.select("cloud", "pid", "x", "y", "z"), 3)
    got = {r["pid"]: r["segment"] for r in clusters.grow_regions(p, near, 2.0, 0.9, 0.1, least=4).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{10 + i: -1 for i in range(3)}}


def test_first_claim_and_best_epoch(spark):
    m = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (0, 2, 6)], "cloud int, pid long, label int")
    n = spark.createDataFrame([(0, 5, 10), (0, 6, 3)], "cloud int, label int, n long")
    assert {(r["pid"], r["label"]) for r in clusters.first_claim(m, n).collect()} == {(1, 6), (2, 6)}
    e = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, f1 double")
    assert metrics.best_epoch(e, "f1").first()["epoch"] == 2


def test_relation_and_projection(spark):
    z = tuple(map(F.lit, (0.0, 0.0, 0.0)))
    rel = lambda n, b: one(spark, V.relation(tuple(map(F.lit, n)), z, tuple(map(F.lit, b))))
    assert rel((0.0, 0.0, 1.0), (0.0, 0.0, 5.0)) == "convex" and rel((0.0, 0.0, 1.0), (0.0, 0.0, -5.0)) == "concave" and rel((0.0, 0.0, 1.0), (3.0, 0.0, 0.0)) == "orthogonal"
    assert one(spark, V.projected(*map(F.lit, (1.0, 2.0, 3.0)), "top", legacy=True)[0]) is None


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("b.step", "a.step", "c.stp"):
        (tmp_path / "in" / n).write_text("x")
    found = files.discover(spark, str(tmp_path / "in"))
    assert [r["stem"] for r in found.collect()] == ["a", "b", "c"]
    assert [r["stem"] for r in files.not_done(found, spark.createDataFrame([("a",)], "stem string")).orderBy("stem").collect()] == ["b", "c"]
    (tmp_path / "npy").mkdir()
    np.save(tmp_path / "npy" / "ok.npy", np.arange(6.0).reshape(2, 3))
    (tmp_path / "npy" / "bad.npy").write_bytes(b"nothing")
    rows = files.read_clouds(spark, str(tmp_path / "npy")).collect()
    assert sum(r["error"] is not None for r in rows) == 1 and sorted(r["x"] for r in rows if r["x"] is not None) == [0, 3]
    (tmp_path / "v.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg"><text x="1" y="2" transform="rotate(-90 1 2)">12.50±0.10</text><text x="3" y="4">⌖</text><text x="5" y="6">A</text></svg>')
    got = files.read_svg_text(spark, str(tmp_path / "v.svg")).orderBy("pos").collect()
    assert [(r["text"], r["x"], r["rotation"]) for r in got] == [("12.50±0.10", 1.0, -90.0), ("A", 5.0, 0.0)]
    (tmp_path / "g.json").write_text(json.dumps({"nodes_2d": {"n": {"id": "n", "value": 2.0}}, "nodes_3d": {"s": {"id": "s", "type": "plane", "measured_value": {"length": 2.0}}}, "edges": [{"src": "n", "dst": "s", "type": "correspondence", "weight": 0.9, "features": {"tolerance_status": "IN_TOLERANCE"}}]}))
    two, three, edges = files.read_graphs(spark, str(tmp_path / "g.json"))
    assert two.first()["value"] == 2.0 and three.first()["measured_value"] == {"length": 2.0} and edges.first()["features"]["tolerance_status"] == "IN_TOLERANCE"
    (tmp_path / "d.json").write_text(json.dumps({"front": {"dimensions": [{"value": 3.0}, {"id": "k", "text": "5"}]}}))
    dims = files.read_view_dimensions(spark, str(tmp_path / "d.json")).collect()
    assert {(r["id"], r["value"], r["confidence"]) for r in dims} == {("node2d_000", 3.0, 1.0), ("k", 0.0, 1.0)}
    files.write_nodes(spark.createDataFrame([("x", 1), ("x", 2)], "doc string, v int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["num_features"] == 2


def test_stream_equals_batch(spark, tmp_path):
    from partloom.streaming import arrivals

    schema = "cloud int, pid long, x double, y double, z double, ts timestamp"
    df = spark.sql("select cast(id % 2 as int) cloud, id pid, 0.0D x, 0.0D y, cast(id as double) z, timestamp'2024-01-01 00:00:00' ts from range(10)")
    df.write.parquet(str(tmp_path / "in"))
    s = arrivals.point_stream(spark, str(tmp_path / "in"), schema)
    q = arrivals.run_batches(s, lambda b: b.groupBy("cloud").count(), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {(r["cloud"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, 5), (1, 5)}
    assert arrivals.cloud_counts(s).isStreaming


def test_optimal_matches_take_all_rows(spark, sf):
    """Every model's labels and features: a least assignment where the smaller side fits whole, greedy matches elsewhere."""
    import numpy as np
    from partloom.plans import graph_queries as G

    labels, measured = G._labels(spark, sf), G._measured(spark, sf)
    sides = [{r["model_id"]: r["count"] for r in x.groupBy("model_id").count().collect()} for x in (labels, measured)]
    scored, got, greedy = G.M.scores(labels, measured).toPandas(), G.optimal_matches(spark, sf).toPandas(), G.greedy_matches(spark, sf).toPandas()
    assert set(got["model_id"]) == set(scored["model_id"])
    for m, s in scored.groupby("model_id"):
        i, j = sorted(s["i"].unique()), sorted(s["j"].unique())
        cost = np.full((len(i), len(j)), np.inf)
        cost[np.searchsorted(i, s["i"]), np.searchsorted(j, s["j"])] = 1 - s["score"]
        whole = min(sides[0][m], sides[1][m]) <= min(cost.shape)
        found = G.M.assignment(cost) if whole else None
        want = sum(1 - cost[a, b] for a, b in found) if found is not None else greedy[greedy["model_id"] == m]["score"].sum()
        mine = got[got["model_id"] == m]["score"]
        assert abs(mine.sum() - want) < 1e-4 * max(1, len(mine))


def test_neighbours_of_thin_places_meet_no_whole_group(spark):
    """Points with no k neighbours in reach go on with twice the reach: all neighbours right, few rows made."""
    from partloom.operators import spatial

    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.normal(size=(2500, 3)), rng.normal(size=(20, 3)) * 40, [[1e5, 0, 0]]])
    points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "cloud int, pid long, x double, y double, z double")
    joined = []
    whole = spatial.knn_join_of
    try:
        spatial.knn_join_of = lambda left, right, group: joined.append(left.count()) or whole(left, right, group)
        got = spatial.knn_join(points, 5).collect()
    finally:
        spatial.knn_join_of = whole
    assert sum(joined) <= 1
    d2 = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2)
    want = {(i, int(j), n + 1) for i in range(len(xyz)) for n, j in enumerate(np.lexsort((np.arange(len(xyz)), d2[i]))[:5])}
    assert {(r["pid1"], r["pid2"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_radius_join_in_wide_cells(spark):
    """Cells of several radii send few copies and lose no pair, also of points exactly one radius apart."""
    from partloom.operators import spatial

    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.integers(-30, 30, (300, 3)) / 2, rng.normal(size=(200, 3)) * 9])
    points = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)], "cloud int, pid long, x double, y double, z double")
    pairs = lambda side: sorted((r["pid1"], r["pid2"]) for r in spatial.radius_join(points, 1.5, side=side).collect())
    assert pairs(1) == pairs(8) == pairs(2) and len(pairs(1)) > 550  # 500 with themselves
    assert spatial._pairs_in(points, 1.5, "cloud", side=8)._jdf.queryExecution().analyzed().toString().count("Generate") == 3
