"""3x3 symmetric linear algebra as Column expressions: no Python per row, everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("xx", "yy", "zz", "xy", "xz", "yz")


def covariance(x: str = "x", y: str = "y", z: str = "z", prefix: str = "c") -> list[Column]:
    """Sample covariances as six aggregates `cxx cyy czz cxy cxz cyz`."""
    axis = {"x": x, "y": y, "z": z}
    return [F.covar_samp(axis[n[0]], axis[n[1]]).alias(prefix + n) for n in NAMES]


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it. Without it the expressions below
    would be copied into each other and grow beyond what Spark compiles."""
    return F.transform(F.array(value), body)[0]


def eigenvalues(prefix: str = "c") -> Column:
    """Struct `e0 >= e1 >= e2` of the symmetric matrix in the six columns, by the trigonometric solution."""
    m = F.struct(*(F.coalesce(F.col(prefix + n), F.lit(0.0)).alias(n) for n in NAMES))

    def shifted(m):
        q = (m["xx"] + m["yy"] + m["zz"]) / 3
        return F.struct(q.alias("q"), (m["xx"] - q).alias("a"), (m["yy"] - q).alias("b"), (m["zz"] - q).alias("c"), *(m[n].alias(n) for n in ("xy", "xz", "yz")))

    def angle(s):
        a, b, c, xy, xz, yz = (s[n] for n in ("a", "b", "c", "xy", "xz", "yz"))
        p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
        det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
        return F.struct(s["q"].alias("q"), p.alias("p"), det.alias("det"))

    def values(s):
        ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["det"] / (2 * s["p"] * s["p"] * s["p"])))
        phi = F.when(s["p"] > 0, F.acos(ratio) / 3).otherwise(0.0)
        return F.struct(s["q"].alias("q"), (s["q"] + 2 * s["p"] * F.cos(phi)).alias("top"), (s["q"] + 2 * s["p"] * F.cos(phi + 2 * math.pi / 3)).alias("low"))

    out = let(let(let(m, shifted), angle), values)
    return let(out, lambda v: F.struct(v["top"].alias("e0"), (3 * v["q"] - v["top"] - v["low"]).alias("e1"), v["low"].alias("e2")))


def eigenvector(value: Column, prefix: str = "c") -> Column:
    """Unit vector `array(x, y, z)` of an eigenvalue: the longest cross product of two rows of A - value; the component
    of largest size is positive. [0, 0, 1] where the eigenvalue is not simple."""
    m = F.struct(*(F.coalesce(F.col(prefix + n), F.lit(0.0)).alias(n) for n in NAMES), value.alias("v"))

    def products(m):
        rows = ((m["xx"] - m["v"], m["xy"], m["xz"]), (m["xy"], m["yy"] - m["v"], m["yz"]), (m["xz"], m["yz"], m["zz"] - m["v"]))
        cross = lambda u, w: F.array(u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
        return F.array(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))

    sized = F.transform(let(m, products), lambda c, k: F.struct((c[0] * c[0] + c[1] * c[1] + c[2] * c[2]).alias("s"), (-k).alias("k"), c.alias("c")))
    best = F.array_max(sized)  # the first of equals
    unit = lambda b: F.when(b["s"] > 0, F.transform(b["c"], lambda x: x / F.sqrt(b["s"]))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return let(let(best, unit), signed)


def signed(v: Column) -> Column:
    """The vector or its opposite, so that the first component of largest size is positive."""
    big = F.array_max(F.transform(v, lambda x: F.abs(x)))
    lead = F.element_at(F.filter(v, lambda x: F.abs(x) >= big), 1)
    return F.when(lead < 0, F.transform(v, lambda x: -x)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def distance_to_axis(axis: Column, *centred: Column) -> Column:
    """Distance of a centred point from the line through the origin along the unit `axis`."""
    along = sum((axis[k] * c for k, c in enumerate(centred[1:], 1)), axis[0] * centred[0])
    return F.sqrt(F.greatest(F.lit(0.0), sum((c * c for c in centred[1:]), centred[0] * centred[0]) - along * along))


# The same eigenvalues in DuckDB, over a relation with columns cxx .. cyz.
EIGEN_SQL = """
  eig0 as (select *, (cxx + cyy + czz) / 3 as q,
      cxy*cxy + cxz*cxz + cyz*cyz as off from {cov}),
  eig1 as (select *, sqrt(((cxx-q)*(cxx-q) + (cyy-q)*(cyy-q) + (czz-q)*(czz-q) + 2*off) / 6) as p from eig0),
  eig2 as (select *, case when p <= 0 then 0 else acos(greatest(-1.0, least(1.0,
      ((cxx-q)*((cyy-q)*(czz-q) - cyz*cyz) - cxy*(cxy*(czz-q) - cyz*cxz) + cxz*(cxy*cyz - (cyy-q)*cxz)) / (2*p*p*p)))) / 3 end as phi from eig1),
  eig as (select *, q + 2*p*cos(phi) as e0, 3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)) as e1,
      q + 2*p*cos(phi + 2*pi()/3) as e2 from eig2)
"""
