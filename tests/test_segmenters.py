"""Communities, composed segmenters and region growing against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.operators import clusters, communities, segmentation, segments, spatial
from partloom.plans.runtime import cutter

XYZ = "cloud int, pid long, x double, y double, z double"


def plain_louvain(n, edges):
    """Nodes in order, levels until nothing moves."""
    adj = {v: {} for v in range(n)}
    for a, b in edges:
        adj[a][b] = adj[a].get(b, 0) + 1
        adj[b][a] = adj[b].get(a, 0) + 1
    loop, of, nodes = dict.fromkeys(range(n), 0), {v: v for v in range(n)}, list(range(n))
    while True:
        com, k = {v: v for v in nodes}, {v: loop[v] + sum(adj[v].values()) for v in nodes}
        total, moved, m2 = dict(k), False, 2 * len(edges)
        changed = True
        while changed:
            changed = False
            for v in nodes:
                total[com[v]] -= k[v]
                w = {}
                for u, x in adj[v].items():
                    w[com[u]] = w.get(com[u], 0) + x
                best, score = com[v], w.get(com[v], 0) - k[v] * total[com[v]] / m2
                for c, x in w.items():
                    if x - k[v] * total[c] / m2 > score + 1e-12:
                        best, score = c, x - k[v] * total[c] / m2
                changed, moved = changed or best != com[v], moved or best != com[v]
                com[v] = best
                total[best] += k[v]
        if not moved:
            return of
        of = {v: com[c] for v, c in of.items()}
        new, loops = {}, {}
        for v in nodes:
            loops[com[v]] = loops.get(com[v], 0) + loop[v] + sum(x for u, x in adj[v].items() if com[u] == com[v])
            row = new.setdefault(com[v], {})
            for u, x in adj[v].items():
                if com[u] != com[v]:
                    row[com[u]] = row.get(com[u], 0) + x
        nodes, adj, loop = sorted(new), new, loops


def plain_modularity(edges, of):
    total = {}
    for a, b in edges:
        total[of[a]] = total.get(of[a], 0) + 1
        total[of[b]] = total.get(of[b], 0) + 1
    return sum(of[a] == of[b] for a, b in edges) / len(edges) - sum((t / 2 / len(edges)) ** 2 for t in total.values())


def test_louvain_of_many_graphs(spark):
    """20 random graphs, separated cliques, a ring of cliques, a path, a node without an edge, in one call."""
    r, graphs = random.Random(1), {}
    for g in range(20):
        n, p, inside = r.randrange(12, 40), r.choice([3, 4, 5]), r.choice([0.5, 0.7, 0.9])
        graphs[g] = (n, [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < (inside if a % p == b % p else 0.08)])
    cliques = [(a, b) for a, b in itertools.combinations(range(15), 2) if a // 5 == b // 5]
    graphs[20], graphs[21], graphs[22] = (15, cliques), (15, [*cliques, (0, 5), (5, 10), (10, 0)]), (3, [(0, 1)])
    edges = [(g, *(e if r.random() < 0.5 else e[::-1])) for g, (_, es) in graphs.items() for e in es]
    nodes = [(g, v) for g, (n, _) in graphs.items() for v in range(n)] + [(23, 7)]
    found = communities.louvain(spark.createDataFrame(edges, "cloud int, a long, b long"), spark.createDataFrame(nodes, "cloud int, node long").repartition(3), cutter(spark)).collect()
    of = {}
    for x in found:
        of.setdefault(x["cloud"], {})[x["node"]] = x["community"]
    assert sum(map(len, of.values())) == len(nodes) == len(found)
    gain = [plain_modularity(es, of[g]) - plain_modularity(es, plain_louvain(n, es)) for g, (n, es) in graphs.items()]
    assert min(gain) > -0.01 and sum(gain) > 0 and sum(x > -1e-9 for x in gain) >= 20  # either may end in another local optimum
    assert of[20] == {v: v // 5 * 5 for v in range(15)} == of[21] and of[22] == {0: 0, 1: 0, 2: 2} and of[23] == {7: 7}
    assert all(c == min(v for v, d in m.items() if d == c) for m in of.values() for c in m.values())


def test_louvain_of_small_graphs_takes_few_tables(spark):
    """A graph that a task can hold is solved in one; the rounds over tables, with or without the levels above, end alike."""
    edges = [(g, a, b, 1.0 + (a * b) % 3) for g, n in ((0, 12), (1, 9)) for a, b in itertools.combinations(range(n), 2) if a % 3 == b % 3 or (a + b + g) % 7 == 0]
    e, nodes = spark.createDataFrame(edges, "cloud int, a long, b long, w double"), spark.createDataFrame([(g, v) for g in (0, 1) for v in range(13)], "cloud int, node long")
    number = 0

    def counted(df, cut=cutter(spark)):
        nonlocal number
        number += 1
        return cut(df)

    want = sorted(map(tuple, communities.louvain(e, nodes, counted, weight="w").collect()))
    assert number <= 5 and len(want) == 26 and len({x[2] for x in want if x[0] == 0}) < 13
    assert want == sorted(map(tuple, communities.louvain(e, nodes, cutter(spark), weight="w", whole=40).collect()))
    assert (communities._odd_digests(np.arange(-50, 50), 3) == [r[0] for r in spark.range(-50, 50).select(F.xxhash64("id", F.lit(3)) % 2 != 0).collect()]).all()


def test_community_features_look_for_neighbours_once(spark, monkeypatch):
    calls, real = [], spatial.knn_between
    monkeypatch.setattr(spatial, "knn_between", lambda *a, **b: calls.append(1) or real(*a, **b))
    r = random.Random(4)
    points = spark.createDataFrame([(0, i, r.random() + 5 * (i % 2), r.random(), r.random()) for i in range(60)], XYZ)
    members, found = segmentation.community_features(points, cutter(spark), reach=0.9, least=4)
    assert len(calls) == 1 and members.count() == sum(x["n"] for x in found.collect()) > 0


def test_weights_and_gains(spark):
    """Three nodes in a row: the heavy edge decides; its gain by the definition of modularity."""
    e = spark.createDataFrame([(0, 1, 2, 3.0), (0, 2, 3, 1.0), (0, 2, 2, 1.0)], "cloud int, a long, b long, weight double")
    links = communities.both_ways(e, weight="weight")
    nodes = communities.weighted_nodes(spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "cloud int, node long"), links).withColumn("community", F.col("node"))
    assert sorted((r["node"], r["k"], r["loop"], r["m2"]) for r in nodes.collect()) == [(1, 3, 0, 10), (2, 6, 2, 10), (3, 1, 0, 10)]
    moves = {r["node"]: (r["to"], r["gain"]) for r in communities.best_moves(nodes, links).collect()}
    assert moves[2] == (1, pytest.approx(2 * (3 - 6 * 3 / 10) / 10)) and moves[3] == (2, pytest.approx(2 * (1 - 1 * 6 / 10) / 10))
    before, after = (communities.modularity(nodes.withColumn("c", c), links, community="c").first()["q"] for c in (F.col("node"), F.when(F.col("node") == 2, 1).otherwise(F.col("node"))))
    assert after - before == pytest.approx(moves[2][1])


def plain_regions(points, near, reach, cosine, gap, least):
    p = {r[1]: r for r in points}
    seen, out, number = set(), {}, 0
    for seed in sorted(p, key=lambda i: (round(p[i][8], 12), i)):
        if seed in seen:
            continue
        queue, members = [seed], []
        while queue:
            at = queue.pop(0)
            if at in seen:
                continue
            seen.add(at)
            members.append(at)
            for q in near[at]:
                a, b = np.array(p[at][2:]), np.array(p[q][2:])
                if q not in seen and np.linalg.norm(a[:3] - b[:3]) <= reach and abs(a[3:6] @ b[3:6]) >= cosine and abs(a[6] - b[6]) <= gap:
                    queue.append(q)
        if len(members) >= least:
            out.update(dict.fromkeys(members, number))
            number += 1
    return {i: out.get(i, -1 if number else 0) for i in p}


def test_regions_equal_the_plain_loop(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for cloud, (n, least) in enumerate([(60, 4), (40, 4), (9, 4), (120, 4), (12, 4)]):
        x, v = r.random((n, 3)) * 3, r.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1)[:, None]
        mine = [(cloud, i, *map(float, x[i]), *map(float, v[i]), float(c)) for i, c in enumerate(np.round(r.random(n) * 0.3, 1))]
        if cloud == 4:
            mine = [(*row[:8], float(i)) for i, row in enumerate(mine)]  # nothing joins
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        near = {i: [int(j) for j in np.argsort(d[i], kind="stable")[1:7]] for i in range(n)}
        want.update({(cloud, k): s for k, s in plain_regions(mine, near, 0.9, 0.5, 0.15, least).items()})
        rows += mine
    p = spark.createDataFrame(rows, XYZ + ", nx double, ny double, nz double, curvature double").repartition(3)
    near = spatial.knn_join(p.select("cloud", "pid", "x", "y", "z"), 7)
    wide = p.withColumn("reach", F.lit(0.9))
    for frame, reach in ((p, 0.9), (wide, F.col("reach"))):
        got = clusters.grow_regions(frame, near, reach, 0.5, 0.15, least=4, cut=cutter(spark)).collect()
        assert {(x["cloud"], x["pid"]): x["segment"] for x in got} == want
    assert len({s for (c, _), s in want.items() if c == 3}) > 2 and all(s == 0 for (c, _), s in want.items() if c == 4)


def lump(r, n, at, scale=1.0):
    return (r.normal(size=(n, 3)) * scale + at).tolist()


def test_adaptive_clusters_by_every_path(spark):
    """Two far lumps settle at once; lumps at growing distances need smaller reaches; one lump ends by curvature."""
    r = np.random.default_rng(7)
    clouds = {0: lump(r, 40, [0, 0, 0]) + lump(r, 40, [60, 0, 0]), 9: lump(r, 60, [0, 0, 0]), 8: lump(r, 3, [0, 0, 0])}
    clouds |= {i: lump(r, 40, [0, 0, 0]) + lump(r, 40, [4 + i, 0, 0]) for i in range(1, 8)}
    rows = [(c, i, *p) for c, ps in clouds.items() for i, p in enumerate(ps)]
    got = segmentation.adaptive_clusters(spark.createDataFrame(rows, XYZ), cutter(spark), floor=0.1).collect()
    path = {x["cloud"]: x["path"] for x in got}
    assert path[0] == "first" and path[9] == "curvature" and 8 not in path and len(set(path.values())) >= 4
    assert all(len({y["path"] for y in got if y["cloud"] == c}) == 1 for c in path)
    both = {(x["pid"] < 40, x["segment"]) for x in got if x["cloud"] == 0}
    assert both == {(True, 0), (False, 1)}
    assert {x["segment"] for x in got if x["cloud"] == 9} == {0, 1, 2}
    # a floor above every distance leaves one cluster at first, and smaller reaches find two
    floored = segmentation.adaptive_clusters(spark.createDataFrame([x for x in rows if x[0] == 0], XYZ), cutter(spark), floor=100.0, ceiling=1000.0).collect()
    assert {x["path"] for x in floored} == {"2.5"} and {x["segment"] for x in floored} == {0, 1}


def test_levels_nest(spark):
    r = np.random.default_rng(8)
    flat = [[float(x), float(y), 0.0] for x in range(10) for y in range(10)]
    rows = [(1, i, *p) for i, p in enumerate(flat + lump(r, 60, [40, 0, 0]))] + [(2, i, *p) for i, p in enumerate(lump(r, 20, [0, 0, 0]))]
    levels = segmentation.level_hierarchy(spark.createDataFrame(rows, XYZ), cutter(spark), least=12).cache()
    points = {}
    for x in levels.collect():
        points.setdefault((x["cloud"], x["segment_id"]), set()).add(x["pid"])
    seg = {(x["cloud"], x["segment_id"]): x for x in segmentation.children(levels).collect()}
    assert set(seg) == set(points) and {x["hierarchy_level"] for k, x in seg.items() if k[0] == 1} == {0, 1, 2} and {k for k in seg if k[0] == 2} == {(2, "seg_0_0")}
    for (cloud, name), x in seg.items():
        assert x["n"] == len(points[cloud, name]) and all(seg[cloud, c]["parent_id"] == name for c in x["children_ids"])
        if x["parent_id"]:
            assert points[cloud, name] <= points[cloud, x["parent_id"]] and name in seg[cloud, x["parent_id"]]["children_ids"]
    assert {x["hierarchy_level"] for x in segmentation.finest(levels).where("cloud = 1").collect()} == {2}


def test_routes_and_descriptions(spark):
    r = np.random.default_rng(9)
    d = r.normal(size=(150, 3))
    ball = (d / np.linalg.norm(d, axis=1)[:, None] * 5).tolist()
    rows = [(1, i, *p) for i, p in enumerate(ball + lump(r, 60, [90, 0, 0]))] + [(2, i, *p) for i, p in enumerate(lump(r, 20, [0, 0, 0]))]
    routed = segmentation.routed_segments(spark.createDataFrame(rows, XYZ), cutter(spark), least=30)
    out = {(x["cloud"], x["segment_id"]): x for x in segmentation.described(routed, cutter(spark)).collect()}
    assert {k: (x["path"], x["n"] > 0) for k, x in out.items() if k[0] == 2} == {(2, "seg_0_0"): ("level_0", True)}
    a = out[1, "segment_0"]
    assert a["path"] == "first" and a["n"] == 150 and a["best"] == "sphere" and a["geometric_params"]["sphere"] == pytest.approx(1.0) and a["feature_type"] in ("sphere", "hole")
    assert {"plane", "planarity", "linearity", "sphericity"} <= set(a["geometric_params"]) and a["measures"]


def test_sphere_of_flat_and_few_points(spark):
    flat = [(1, i, float(i % 4), float(i // 4), 2.0) for i in range(16)]
    few = [(2, i, float(i), float(i * i), 1.0) for i in range(3)]
    p = spark.createDataFrame(flat + few, XYZ)
    got = {x["cloud"]: x for x in segments.all_primitives(p).collect()}
    assert got[1]["best"] == "plane" and got[1]["sphere"] == 0 == got[2]["sphere"]
    fit = segments.sphere_fit(p).collect()
    assert [x["cloud"] for x in fit] == [1] and fit[0]["radius"] is None and fit[0]["sphere"] == 0


def test_extracted_features(spark):
    """Two plates: two regions whose numbers follow their places; a small cloud is one unknown node; nine points give none."""
    r = np.random.default_rng(11)
    plate = lambda at, axis: [tuple(at[k] + (r.normal() * 0.02 if k == axis else (i % 9 if k == (axis + 1) % 3 else i // 9) + r.normal() * 0.1) for k in range(3)) for i in range(81)]
    rows = [(1, i, *map(float, p)) for i, p in enumerate(plate((0.0, 0.0, 0.0), 2) + plate((30.0, 0.0, 0.0), 0))] + [(2, i, float(i), float(i % 3), float(i % 5)) for i in range(12)] + [(3, i, float(i), 0.0, 0.0) for i in range(9)]
    got = segmentation.extracted_features(spark.createDataFrame(rows, XYZ), cutter(spark), cosine=0.5, least=25).collect()
    by = {c: sorted((x for x in got if x["cloud"] == c), key=lambda x: x["node_id"]) for c in (1, 2, 3)}
    assert [x["node_id"] for x in by[1]] == [f"node3d_{i:03d}" for i in range(len(by[1]))] and [x["segment"] for x in by[1]] == list(range(len(by[1]))) and len(by[1]) >= 2
    assert {x["cx"] > 0 for x in by[1]} == {True, False} and all(x["n"] >= 25 and x["confidence"] == 0.85 for x in by[1]) and not by[3]
    assert all(x["segment"] not in x["adjacent"] and all(x["segment"] in by[1][j]["adjacent"] for j in x["adjacent"]) for x in by[1]) and any(x["adjacent"] for x in by[1])
    assert [(x["feature_type"], x["confidence"]) for x in by[2]] == [("unknown", 0.3)]


def plain_dbscan(rows, eps, least):
    d2 = ((rows[:, None, :] - rows[None, :, :]) ** 2).sum(axis=2)
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= least
    of = np.where(core, np.arange(len(rows)), len(rows))
    while True:
        new = np.where(core, np.where(near & core[None, :], of[None, :], len(rows)).min(axis=1), len(rows))
        if (new == of).all():
            break
        of = new
    number = {v: i for i, v in enumerate(sorted(set(of[core].tolist())))}
    around = np.where(near & core[None, :], of[None, :], len(rows)).min(axis=1)
    return [number[v] if v < len(rows) else -1 for v in around.tolist()]


def test_dense_clusters_make_few_pairs(spark):
    """Two dense lumps a little more, or a little less, than eps apart, a thin bridge, thin points and copies."""
    rng, eps = np.random.default_rng(4), 0.2
    for gap in (eps * 0.999, eps * 1.05):
        left, right = rng.uniform(0, 0.3, (700, 3)), rng.uniform(0, 0.3, (700, 3))
        left[:, 0] -= left[:, 0].max()
        right[:, 0] += gap - right[:, 0].min()
        right[:5, 1:] = left[left[:, 0].argmax(), 1:]
        right[:5, 0] = gap
        rows = np.concatenate([left, right, rng.uniform(-1, 1, (200, 3)) + [0, 3, 0], np.full((60, 3), 5.0), np.full((60, 3), 5.0) + [eps, 0, 0], rng.uniform(0, 0.1, (3, 3)) - 4])
        points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(rows)] + [(2, i, *map(float, p)) for i, p in enumerate(rows[:150])], XYZ)
        counts, cut = [], cutter(spark)

        def counted(df):
            out = cut(df)
            counts.append(out.count())
            return out

        got = {(r["cloud"], r["pid"]): r["label"] for r in clusters.dbscan(points, eps, 5, counted).collect()}
        for cloud, some in ((1, rows), (2, rows[:150])):
            assert [got[cloud, i] for i in range(len(some))] == plain_dbscan(some, eps, 5)
        assert max(counts) < 25_000  # the pairs within eps are over 600,000
    null = points.withColumn("x", F.when(F.col("pid") > 0, F.col("x")))
    assert {r["label"] for r in clusters.dbscan(null, eps, 5, cutter(spark)).where("pid = 0").collect()} == {-1}


def test_moves_send_no_nodes_by_way_of_the_driver(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(8)], "cloud int, node long")
    edges = spark.createDataFrame([(1, i, (i + 1) % 8) for i in range(8)], "cloud int, a long, b long")
    cut = cutter(spark)
    links = cut(communities.both_ways(edges))
    state = cut(communities.weighted_nodes(nodes, links).withColumn("community", F.col("node")))
    moves = communities.best_moves(state, links)
    assert moves.where("k = 2 and m2 = 16 and gain > 0").count() == 8
    plan = moves._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
