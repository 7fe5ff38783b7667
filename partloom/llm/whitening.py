"""Whitening of embeddings: covariance by column aggregates over the upper triangle, eigenvectors by LAPACK."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, small_batches, table

SCALE, SHIFT = 64, 1_000_000
FARTHEST = 1 << 53  # entries beyond this after scaling count as this: whole numbers that doubles and longs both hold
AT_ONCE = 4096  # aggregates of one pass: vectors of up to 90 dimensions take one


def number(i: int) -> F.Column:
    """x = floor(64 c) + 1000000 of entry i, as a long."""
    scaled = f"floor(cast(get(v, {i}) as double) * {SCALE}D)"
    return F.expr(f"cast(greatest(least(cast({scaled} as double), {float(FARTHEST)}D), -{float(FARTHEST)}D) as long) + {SHIFT}L").alias(f"x{i}")


def upper_triangle(rows: DataFrame, columns: list[str], means: list[float], n: int) -> np.ndarray:
    """Covariance (divisor n) of the columns: a sum of centred products for every pair i <= j, `AT_ONCE` in a pass."""
    d = len(columns)
    centred = rows.select(*((F.col(c) - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, means))))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for k in range(0, len(pairs), AT_ONCE):
        some = pairs[k : k + AT_ONCE]
        got = centred.agg(*(F.expr(f"sum(c{i} * c{j}) as p{i}_{j}") for i, j in some)).first()
        for (i, j), v in zip(some, got):
            out[i, j] = out[j, i] = (v or 0.0) / n
    return out


def principal_axes(v: np.ndarray, most: int):
    """(unit eigenvectors as columns, eigenvalues), largest first; each one's largest entry is positive. Axes along which
    the rows do not differ, to rounding, have no scale and are left out."""
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    axes = axes * np.sign(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None, :], axis=0))
    some = e > max(e[0], 0) * len(v) * 1e-14 if len(e) else np.zeros(0, bool)
    return axes[:, some], e[some]


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list:
    """Sum over the dimensions of (n x - S)^2, exact; null where that is no long."""
    far = np.abs(x.astype(np.float64) * n - sums.astype(np.float64)).max(axis=1, initial=0)
    if (np.abs(x).max(initial=0) * float(n) < 2.0**62) and x.shape[1] * far.max(initial=0) ** 2 < 2.0**62:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Whitened coordinates of every vector: `id_col, component, n, deviation, whitened, explained, identity_error`.

    The first aggregation gives the number n of vectors and the sum of every dimension, exactly; the second one all
    centred products of the upper triangle; the driver holds a d x d matrix and no rows. A third and a fourth do the
    same for the whitened coordinates, which gives `identity_error`. The rows themselves are read, projected and returned
    by their tasks; no row is shuffled.

    Left out are vectors that are null, empty, hold null or non-finite entries, or have another length than the most
    frequent one (the longer one of two). Ids may be null or repeat, repeated rows all count; other columns are not
    read. Entries beyond 2^53 after scaling count as 2^53. `deviation` is null where it does not fit a long. Where
    the vectors span fewer dimensions, there are as many components; equal vectors or an empty table give no rows.
    Axes of equal eigenvalues are any basis of their plane, the same one for all rows.
    """
    spark = rows.sparkSession
    small_batches(spark, 5000)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(
        F.expr("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(cast(c as double)) and abs(cast(c as double)) < double('infinity'))")
    )
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    whole = good.where(F.size("v") == d)
    columns = whole.select(*map(number, range(d)))
    n, *sums = columns.agg(F.count("*"), *(F.sum(F.col(f"x{i}").cast("decimal(20, 0)")) for i in range(d))).first()
    sums = [int(s) for s in sums]
    means = [s / n for s in sums]
    v = upper_triangle(columns, columns.columns, means, n)
    axes, e = principal_axes(v, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    to, explained, k = axes / np.sqrt(e), e / np.trace(v), len(e)
    exact, centre = np.array(sums, object), np.array(means)

    def project(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, d)
            w = (x - centre) @ to
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviations(x, exact, n), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), k).cast(pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    done = Scratch(spark).cut(whole.select("id", F.array(*map(number, range(d))).alias("x")).mapInArrow(project, f"id {rows.schema[id_col].dataType.simpleString()}, deviation long, w array<double>"))
    white = done.select(*(F.get("w", F.lit(i)).alias(f"w{i}") for i in range(k)))
    middle = white.agg(*(F.avg(c) for c in white.columns)).first()
    error = float(np.abs(upper_triangle(white, white.columns, list(middle), n) - np.eye(k)).max())
    shares = F.array(*(F.lit(float(s)) for s in explained))
    out = done.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark, sf_dir) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
