"""Closures, wires, running numbers and directory runs against plain versions."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.operators import metrics, traversal
from partloom.plans.runtime import cutter
from partloom.sources import batch


def test_closure_equals_recursive_sql(spark):
    r = random.Random(3)
    rows = [(m, f"{a}", f"{b}") for m in range(4) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.2] + [(9, f"v{i}", f"v{i + 1}") for i in range(40)]
    links = spark.createDataFrame(rows + rows[:5], "model_id int, parent string, child string")
    links.createOrReplaceTempView("closure_links")
    want = spark.sql("""with recursive w(model_id, top, bottom, depth) as (select model_id, parent, child, 1 from closure_links union all
        select w.model_id, w.top, l.child, w.depth + 1 from w join closure_links l on l.model_id = w.model_id and l.parent = w.bottom) select model_id, top, bottom, min(depth) from w group by all""")
    got = traversal.closure(links, cutter(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ring = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "a")], "model_id int, parent string, child string")
    assert sorted((x["top"], x["bottom"], x["depth"]) for x in traversal.closure(ring, cutter(spark)).collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)]


def test_shapes_of_a_box(spark):
    """A cube: 6 faces, 12 edges, 8 vertices; every edge on two faces, every vertex on three."""
    corner = lambda p: p[0] * 4 + p[1] * 2 + p[2]
    points = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    edges = [(p, q) for p in points for q in points if corner(p) < corner(q) and sum(a != b for a, b in zip(p, q)) == 1]
    rows = [(0, "solid:0", "shell:0")] + [(0, "shell:0", f"face:{k}{v}") for k in range(3) for v in (0, 1)] + [(0, f"face:{k}{v}", f"wire:{k}{v}") for k in range(3) for v in (0, 1)]
    rows += [(0, f"wire:{k}{v}", f"edge:{i}") for k in range(3) for v in (0, 1) for i, (p, q) in enumerate(edges) if p[k] == q[k] == v]
    rows += [(0, f"edge:{i}", f"vertex:{corner(p)}") for i, e in enumerate(edges) for p in e]
    ways = traversal.closure(spark.createDataFrame(rows, "model_id int, parent string, child string"), cutter(spark))
    counts = {(x["top_kind"], x["bottom_kind"]): (x["ways"], x["tops"], x["bottoms"]) for x in traversal.shape_counts(ways).collect()}
    assert counts["face", "edge"] == (24, 6, 12) and counts["solid", "vertex"] == (8, 1, 8) and counts["face", "vertex"] == (24, 6, 8) and counts["edge", "vertex"] == (24, 12, 8)
    assert {x["n"] for x in traversal.within(ways, "face", "vertex").groupBy("bottom").agg(F.count("*").alias("n")).collect()} == {3}


def test_wires_in_order(spark):
    """A closed wire, an open one, one of a single edge, a fork, two pieces, and 10,000 edges in about 14 rounds."""
    ring = [(1, 1, e, s, t) for e, s, t in ((30, "a", "b"), (10, "b", "c"), (20, "c", "a"))]
    line = [(1, 2, e, s, t) for e, s, t in ((5, "x", "y"), (3, "y", "z"), (4, "z", "w"))]
    one = [(1, 3, 7, "p", "q"), (2, 3, 8, "p", "p")]
    fork = [(2, 4, e, s, t) for e, s, t in ((1, "a", "b"), (3, "b", "c"), (2, "b", "d"), (4, "d", "e"))]
    pieces = [(2, 5, e, s, t) for e, s, t in ((1, "a", "b"), (2, "b", "c"), (3, "k", "l"))]
    order = list(range(10_000))
    random.Random(5).shuffle(order)
    long = [(3, 6, order[i], f"v{i}", f"v{i + 1}") for i in range(10_000)]
    rounds = []
    cut = cutter(spark)
    frame = spark.createDataFrame(ring + line + one + fork + pieces + long, "model_id int, wire int, edge long, start string, end string").repartition(4)
    got = traversal.ordered_wires(frame, lambda df: rounds.append(1) or cut(df)).collect()
    place = {(x["model_id"], x["wire"], x["edge"]): x["place"] for x in got}
    assert [place[1, 1, e] for e in (10, 20, 30)] == [0, 1, 2] and [place[1, 2, e] for e in (5, 3, 4)] == [0, 1, 2] and place[1, 3, 7] == 0 == place[2, 3, 8]
    assert [place[2, 4, e] for e in (1, 2, 4, 3)] == [0, 1, 2, None] and [place[2, 5, e] for e in (1, 2, 3)] == [0, 1, None]
    assert all(place[3, 6, e] == i for i, e in enumerate(order)) and len(rounds) <= 20


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_running_numbers(spark, parts):
    """Strings, dates, ties over a third of the rows, nulls, infinities and NaN; few rows and none."""
    r = random.Random(parts)
    day = datetime.date(2024, 1, 1)
    rows = [(("same" if r.random() < 0.4 else r.choice("abcé")) if r.random() < 0.95 else None, day + datetime.timedelta(r.randrange(5)), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc string, day date, pos long").repartition(5)
    got = {x["pos"]: x["number"] for x in metrics.running_numbers(frame, ["doc", "day", "pos"], cutter(spark), parts=parts).collect()}
    want = sorted(rows, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1], x[2]))
    assert got == {x[2]: i for i, x in enumerate(want)}
    odd = spark.createDataFrame([(float(v),) for v in (3, math.inf, -math.inf, 0, math.nan)] + [(None,)], "v double")
    assert [str(x["v"]) for x in sorted(metrics.running_numbers(odd, ["v"], cutter(spark), first=1, parts=parts).collect(), key=lambda x: x["number"])] == ["None", "-inf", "0.0", "3.0", "inf", "nan"]
    assert metrics.running_numbers(odd.limit(0), ["v"], cutter(spark), parts=parts).collect() == []
    split = metrics.positional_split(frame.select("doc", "day", F.concat("doc", F.col("pos").cast("string")).alias("key")).where("doc is not null"), "key", parts=parts).collect()
    keys = sorted((x["key"].encode(), x["split"]) for x in split)
    assert [s for _, s in keys] == ["train"] * int(len(keys) * 0.8 + 1e-9) + ["val"] * (len(keys) - int(len(keys) * 0.8 + 1e-9))


def test_directory_with_a_poisoned_file(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    r = np.random.default_rng(4)
    for i in range(7):
        np.save(source / f"part{i}_none.npy", r.normal(size=(40, 3)) * 0.05)
    (source / "bad_none.npy").write_bytes(b"no array")
    np.save(source / "flat_none.npy", np.zeros((5, 2)))
    np.save(source / "odd_none.npy", np.array([[0.0, 1.0, np.nan]] * 30))
    np.save(source / "few_none.npy", np.zeros((4, 3)))
    np.save(source / "empty_none.npy", np.zeros((0, 3)))
    seen = []

    def segment(points, cut):
        seen.append(sorted(x["cloud"] for x in points.select("cloud").distinct().collect()))
        members = points.select("cloud", "pid", (F.col("pid") % 2).alias("community"))
        return members, members.groupBy("cloud", "community").agg(F.lit("plane").alias("feature_type"), F.lit(0.5).alias("confidence"))

    first = {x["cloud"]: x for x in batch.process_directory(spark, str(source), target, cutter(spark), segment=segment).collect()}
    assert len(first) == 12 and {c for c, x in first.items() if not x["ok"]} == {"bad_none", "flat_none", "odd_none", "few_none", "empty_none"}
    assert all(first[c]["error"] for c in ("bad_none", "flat_none", "odd_none", "few_none", "empty_none")) and {x["num_segments"] for x in first.values() if x["ok"]} == {2}
    np.save(source / "bad_none.npy", r.normal(size=(40, 3)))
    second = {x["cloud"]: x["ok"] for x in batch.process_directory(spark, str(source), target, cutter(spark), segment=segment).collect()}
    assert second == {"bad_none": True, "flat_none": False, "odd_none": False, "few_none": False, "empty_none": False} and seen == [[f"part{i}_none" for i in range(7)], ["bad_none"]]
    docs = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "out" / "segments").glob("doc=*/*.txt")}
    assert len(docs) == 8 and docs["doc=part3_none"]["seg_001"]["nodes"] == list(range(1, 40, 2))
    total = batch.summary(spark, target).first()
    assert (total["total"], total["succeeded"], total["failed"]) == (12, 8, 4) and total["average_made"] == 2


def test_directory_end_to_end(spark, tmp_path):
    """Two flat patches, far apart, become communities of their own."""
    (tmp_path / "in").mkdir()
    grid = np.array([[x * 0.02, y * 0.02, 0.0] for x in range(5) for y in range(5)])
    np.save(tmp_path / "in" / "a.npy", np.concatenate([grid, grid + [5, 0, 0]]))
    rows = batch.process_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), cutter(spark)).collect()
    assert [(x["cloud"], x["ok"]) for x in rows] == [("a", True)] and rows[0]["num_segments"] >= 2
    doc = json.loads(next((tmp_path / "out" / "segments").glob("doc=a/*.txt")).read_text())
    assert all(max(s["nodes"]) < 25 or min(s["nodes"]) >= 25 for s in doc.values())


def test_ways_are_made_right_below_their_top(spark):
    """100 edges of a wire at one vertex: doubling made ways at every shape between; a way is made once for each shape
    right below its top."""
    rows = [(0, "solid:0", "shell:0"), (0, "shell:0", "face:0"), (0, "face:0", "wire:0"), *((0, "wire:0", f"edge:{i}") for i in range(100)), *((0, f"edge:{i}", "vertex:0") for i in range(100))]
    cut, written = cutter(spark), []
    ways = traversal.closure(spark.createDataFrame(rows, "model_id int, parent string, child string"), lambda df: written.append(cut(df)) or written[-1])
    assert {(x["top"], x["depth"]) for x in ways.where("bottom = 'vertex:0'").collect()} == {("solid:0", 5), ("shell:0", 4), ("face:0", 3), ("wire:0", 2)} | {(f"edge:{i}", 1) for i in range(100)}
    assert ways.count() == 203 + 300 + 4 + 3 and sum(w.count() for w in written) < 3 * ways.count()
