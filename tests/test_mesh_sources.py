"""Binary clouds and meshes against NumPy."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from partloom.operators import sampling
from partloom.sources import mesh


@pytest.fixture
def formats(spark):
    mesh.register(spark)
    return spark


def stl(path, triangles):
    t = np.zeros(len(triangles), mesh.TRIANGLE)
    if len(triangles):
        t["p"] = triangles
        n = np.cross(t["p"][:, 1] - t["p"][:, 0], t["p"][:, 2] - t["p"][:, 0])
        t["n"] = n / np.linalg.norm(n, axis=1)[:, None]
    path.write_bytes(b"made by a test".ljust(80) + struct.pack("<I", len(t)) + t.tobytes())
    return t


@pytest.mark.parametrize("kind,order", [("<f4", "C"), ("<f8", "F"), ("<i2", "C"), (">f8", "C")])
def test_clouds_equal_numpy(formats, tmp_path, kind, order):
    want = {}
    for name, n in (("a", 1000), ("b", 1), ("empty", 0), ("deep/c", 77)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        x = np.asarray(np.random.default_rng(n).normal(size=(n, 3)) * 100, dtype=kind, order=order)
        np.save(tmp_path / f"{name}.npy", x)
        want |= {(name.split("/")[-1], i): tuple(map(float, row)) for i, row in enumerate(x)}
    got = formats.read.format("npy_cloud").option("bytesPerPartition", "4000").load(str(tmp_path))
    assert {(r["cloud"], r["pid"]): (r["x"], r["y"], r["z"]) for r in got.collect()} == want
    assert got.rdd.getNumPartitions() >= 3 and got.where("cloud = 'a'").select(F.spark_partition_id()).distinct().count() >= 2
    some = formats.read.format("npy_cloud").schema("z double, cloud string").load(f"file://{tmp_path}/a.npy")
    assert some.columns == ["z", "cloud"] and sorted(r["z"] for r in some.collect()) == sorted(v[2] for k, v in want.items() if k[0] == "a")


def test_meshes_equal_numpy(formats, tmp_path):
    r = np.random.default_rng(1)
    t = stl(tmp_path / "part.stl", r.normal(size=(500, 3, 3)).astype("<f4"))
    got = formats.read.format("stl_mesh").option("bytesPerPartition", "15000").load(str(tmp_path / "part.stl"))
    assert got.rdd.getNumPartitions() == 2
    rows = sorted(got.collect(), key=lambda x: x["tri_id"])
    assert np.array_equal(np.array([[x["p1"], x["p2"], x["p3"]] for x in rows], "<f4"), t["p"]) and np.allclose([[x["nx"], x["ny"], x["nz"]] for x in rows], t["n"]) and {x["mesh"] for x in rows} == {"part"}
    area = got.select(F.sum(sampling.triangle_area(F.col("p1"), F.col("p2"), F.col("p3")))).first()[0]
    assert area == pytest.approx(np.linalg.norm(np.cross(t["p"][:, 1] - t["p"][:, 0], t["p"][:, 2] - t["p"][:, 0]).astype(float), axis=1).sum() / 2, rel=1e-5)


def test_bad_files_raise(formats, tmp_path):
    stl(tmp_path / "empty.stl", np.zeros((0, 3, 3)))
    (tmp_path / "text.stl").write_bytes(b"solid part\nendsolid part\n")
    np.save(tmp_path / "flat.npy", np.zeros((4, 2)))
    whole = tmp_path / "whole.npy"
    np.save(whole, np.zeros((40, 3)))
    (tmp_path / "short.npy").write_bytes(whole.read_bytes()[:-50])
    for form, name, words in (("stl_mesh", "empty.stl", "without triangles"), ("stl_mesh", "text.stl", "no binary mesh"), ("npy_cloud", "flat.npy", "is no cloud"), ("npy_cloud", "short.npy", "shorter than its 40 points")):
        with pytest.raises(PySparkException, match=words):
            formats.read.format(form).load(str(tmp_path / name)).collect()
