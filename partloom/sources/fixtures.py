"""Views with the shapes of part data over the supplied tables, in Spark and, word for word, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pts_small(spark, d) -> DataFrame:
    v = F.col("embedding")
    return _read(spark, d, "embeddings").select(
        F.col("label").alias("cloud"), F.col("vec_id").alias("pid"), *(v[i].cast("double").alias(n) for i, n in enumerate("xyz"))
    )


def pts_lumps(spark, d) -> DataFrame:
    """Points in two lumps, 0 to 1.2 apart by cloud."""
    return pts_small(spark, d).withColumn("x", F.col("x") + (F.col("pid") % 2) * (F.col("cloud") % 5) * 0.3)


def normals_small(spark, d) -> DataFrame:
    """Points with unit normals taken from the next three components."""
    v = F.col("embedding")
    n = [v[i].cast("double") for i in (3, 4, 5)]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return _read(spark, d, "embeddings").select(
        F.col("label").alias("cloud"), F.col("vec_id").alias("pid"), *(v[i].cast("double").alias(c) for i, c in enumerate("xyz")), *((n[i] / size).alias(f"n{c}") for i, c in enumerate("xyz"))
    )


def rows_big(spark, d) -> DataFrame:
    """Rows of `pts_big`, repeated ones too."""
    return _read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("cloud"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), ((F.col("l_discount") + F.lit(0.0)) * 100).alias("z")
    )


def pts_big(spark, d) -> DataFrame:
    return rows_big(spark, d).distinct()


def edge_faces(spark, d) -> DataFrame:
    return (
        _read(spark, d, "lineitem")
        .select((F.col("l_orderkey") % 40).alias("model_id"), F.col("l_orderkey").alias("edge_id"), (F.col("l_partkey") % 50).alias("face_id"))
        .distinct()
    )


def faces(spark, d) -> DataFrame:
    kind = ((F.col("face_id") * 7 + F.col("model_id")) % 5).cast("int")
    return edge_faces(spark, d).select("model_id", "face_id").distinct().withColumn("surface_type", kind).withColumn("area_mm2", (F.col("face_id") * 13 % 37 + 1).cast("double"))


def labels_2d(spark, d) -> DataFrame:
    """Dimension labels: nominal, tolerance of 2 %, and the label's text in one of three forms."""
    nominal = F.col("p_retailprice")
    tol = F.round(F.col("p_partkey") % 17 + 1) / 4
    shown = F.format_string("%.2f", nominal)
    text = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(shown, F.lit("±"), F.format_string("%.2f", tol)))
        .when(F.col("p_partkey") % 3 == 1, F.concat(shown, F.lit("+"), F.format_string("%.2f", tol), F.lit("/0")))
        .otherwise(F.concat(shown, F.lit("/-"), F.format_string("%.2f", tol)))
    )
    return _read(spark, d, "part").select(
        (F.col("p_partkey") % 20).alias("model_id"),
        F.format_string("node2d_%05d", F.col("p_partkey")).alias("id"),
        F.col("p_partkey").alias("pos"),
        nominal.alias("nominal"),
        tol.alias("tol"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("⌀"), text)).otherwise(text).alias("text"),
        F.element_at(F.array(*map(F.lit, ("dimension", "hole", "datum", "slot width", "chamfer"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("category"),
        (F.col("p_partkey") * 37 % 211).cast("double").alias("px"),
        (F.col("p_partkey") * 53 % 197).cast("double").alias("py"),
    )


KINDS_3D = ("plane", "cylinder", "through_hole", "blind_hole", "pocket", "slot", "cone", "sphere", "chamfer")


def measured_3d(spark, d) -> DataFrame:
    """Measured features: a value near the nominal of some label, under a key that depends on the kind."""
    kind = F.element_at(F.array(*map(F.lit, KINDS_3D)), (F.col("p_partkey") % 9 + 1).cast("int"))
    value = F.col("p_retailprice") + (F.col("p_size") - 25) / 10
    key = F.when(kind.isin("cylinder", "through_hole", "blind_hole"), "diameter").when(kind.isin("sphere", "cone"), "radius").otherwise("length")
    return _read(spark, d, "part").select(
        (F.col("p_partkey") % 20).alias("model_id"),
        F.format_string("seg_%05d", F.col("p_partkey")).alias("id"),
        F.col("p_partkey").alias("pos"),
        kind.alias("type"),
        key.alias("key"),
        F.when(key == "radius", value / 2).otherwise(value).alias("value"),
        (F.col("p_partkey") * 41 % 199).cast("double").alias("sx"),
        (F.col("p_partkey") * 59 % 193).cast("double").alias("sy"),
        (F.col("p_partkey") % 6).cast("int").alias("n_adjacent"),
    )


def triangles(spark, d) -> DataFrame:
    """Triangles whose corners are the points with ids 3i, 3i + 1 and 3i + 2 of a cloud's order."""
    p = pts_small(spark, d)
    corner = lambda k: F.array(F.max(F.when(F.col("pid") % 3 == k, F.col("x"))), F.max(F.when(F.col("pid") % 3 == k, F.col("y"))), F.max(F.when(F.col("pid") % 3 == k, F.col("z"))))
    out = p.groupBy(F.floor(F.col("pid") / 3).cast("long").alias("tri_id")).agg(F.count("*").alias("n"), corner(0).alias("p1"), corner(1).alias("p2"), corner(2).alias("p3"))
    return out.where("n = 3").select((F.col("tri_id") % 7).alias("face_id"), "tri_id", "p1", "p2", "p3")


SQL = {
    "pts_small": "select label as cloud, vec_id as pid, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings",
    "pts_lumps": "select label as cloud, vec_id as pid, embedding[1]::double + (vec_id%2)*(label%5)*0.3::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings",
    "normals_small": """select label as cloud, vec_id as pid, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z,
        embedding[4]::double / sqrt(embedding[4]::double*embedding[4]::double + embedding[5]::double*embedding[5]::double + embedding[6]::double*embedding[6]::double) as nx,
        embedding[5]::double / sqrt(embedding[4]::double*embedding[4]::double + embedding[5]::double*embedding[5]::double + embedding[6]::double*embedding[6]::double) as ny,
        embedding[6]::double / sqrt(embedding[4]::double*embedding[4]::double + embedding[5]::double*embedding[5]::double + embedding[6]::double*embedding[6]::double) as nz from embeddings""",
    "pts_big": "select distinct l_suppkey as cloud, l_quantity as x, l_extendedprice/1000 as y, (l_discount+0.0)*100 as z from lineitem",
    "edge_faces": "select distinct l_orderkey%40 as model_id, l_orderkey as edge_id, l_partkey%50 as face_id from lineitem",
    "faces": "select distinct l_orderkey%40 as model_id, l_partkey%50 as face_id, ((l_partkey%50*7 + l_orderkey%40)%5)::int as surface_type, (l_partkey%50*13%37 + 1)::double as area_mm2 from lineitem",
    "labels_2d": """select p_partkey%20 as model_id, printf('node2d_%05d', p_partkey) as id, p_partkey as pos, p_retailprice as nominal, (p_partkey%17 + 1)/4.0::double as tol,
        (case when p_partkey%4 = 0 then '⌀' else '' end) || printf('%.2f', p_retailprice) || case p_partkey%3 when 0 then '±' || printf('%.2f', (p_partkey%17 + 1)/4.0::double)
          when 1 then '+' || printf('%.2f', (p_partkey%17 + 1)/4.0::double) || '/0' else '/-' || printf('%.2f', (p_partkey%17 + 1)/4.0::double) end as text,
        (['dimension', 'hole', 'datum', 'slot width', 'chamfer'])[(p_partkey%5 + 1)::int] as category, (p_partkey*37%211)::double as px, (p_partkey*53%197)::double as py from part""",
    "measured_3d": """select model_id, id, pos, type, key, case when key = 'radius' then v/2 else v end as value, sx, sy, n_adjacent from (select *,
        case when type in ('cylinder', 'through_hole', 'blind_hole') then 'diameter' when type in ('sphere', 'cone') then 'radius' else 'length' end as key from (
        select p_partkey%20 as model_id, printf('seg_%05d', p_partkey) as id, p_partkey as pos, (['plane', 'cylinder', 'through_hole', 'blind_hole', 'pocket', 'slot', 'cone', 'sphere', 'chamfer'])[(p_partkey%9 + 1)::int] as type,
        p_retailprice + (p_size - 25)/10.0::double as v, (p_partkey*41%199)::double as sx, (p_partkey*59%193)::double as sy, (p_partkey%6)::int as n_adjacent from part))""",
    "triangles": """select tri_id%7 as face_id, tri_id, p1, p2, p3 from (select vec_id//3 as tri_id, count(*) as n,
        [max(case when vec_id%3=0 then embedding[1]::double end), max(case when vec_id%3=0 then embedding[2]::double end), max(case when vec_id%3=0 then embedding[3]::double end)] as p1,
        [max(case when vec_id%3=1 then embedding[1]::double end), max(case when vec_id%3=1 then embedding[2]::double end), max(case when vec_id%3=1 then embedding[3]::double end)] as p2,
        [max(case when vec_id%3=2 then embedding[1]::double end), max(case when vec_id%3=2 then embedding[2]::double end), max(case when vec_id%3=2 then embedding[3]::double end)] as p3
        from embeddings group by 1) where n = 3""",
}


def with_views(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
