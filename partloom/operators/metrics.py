"""Matching metrics, run statistics and splits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.linear import unit


BLOCK = 4096  # vectors of a group on one side of a matrix product
STRIP = 512  # rows of a product that are held at once


def _met_blocks(left: DataFrame, right: DataFrame, group: str, product, schema: str) -> DataFrame:
    """`product(left, right)` (Arrow tables) of every pair of blocks of two sides of a group. left: group, lid, lv and more;
    right: group, rid, rv and more. Blocks are dealt by a digest, so a task holds two of them and no group."""
    parts = lambda rows, name: rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = parts(left, "_lefts").join(parts(right, "_rights"), group)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    plain = lambda rows, v: rows.withColumn("_known", F.coalesce(~F.exists(v, lambda x: x.isNull()), F.lit(False)))
    a = plain(left, "lv").join(sizes, group).withColumn("_a", at("lid", "_lefts")).withColumn("_b", each("_rights")).drop("_lefts", "_rights")
    b = plain(right, "rv").join(sizes, group).withColumn("_b", at("rid", "_rights")).withColumn("_a", each("_lefts")).drop("_lefts", "_rights")
    key = [group, "_a", "_b"]
    b = b.select(*(F.col(c).alias(c) for c in b.columns))  # sides of one table must not share columns
    a = a.select(*(F.col(c).alias(c) for c in a.columns))
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(product, schema)


def _matrix(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them are known; others are zero."""
    known = table["_known"].to_numpy()
    rows = table.filter(table["_known"])[name].combine_chunks()
    flat = pc.list_flatten(rows).to_numpy(zero_copy_only=False)
    out = np.zeros((table.num_rows, len(flat) // len(rows) if len(rows) else 0))
    out[known] = flat.reshape(len(rows), -1) if len(rows) else 0
    return out, known


def recall_at_1(queries: DataFrame, keys: DataFrame, truth: str = "truth", group: str = "cloud") -> DataFrame:
    """Share of queries (group, qid, v, truth) whose nearest key (group, kid, v) of the group by cosine, to nine places, is
    the true one; ties go to the smaller key. All keys of a group are compared, as matrix products of blocks; a query
    sends one row for each block of keys."""
    q = queries.select(group, F.col("qid").alias("lid"), F.col(truth).alias("truth"), unit(F.col("v")).alias("lv"))
    k = keys.select(group, F.col("kid").alias("rid"), unit(F.col("v")).alias("rv"))
    kinds = {c: q.schema[c].dataType.simpleString() for c in (group, "lid", "truth")} | {"rid": k.schema["rid"].dataType.simpleString()}

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("rid")
        (a, known_a), (b, known_b) = _matrix(left, "lv"), _matrix(right, "rv")
        best, value = np.zeros(len(a), np.int64), np.full(len(a), -np.inf)
        for at in range(0, len(a) if len(b) else 0, STRIP):
            s = a[at : at + STRIP] @ b.T if a.shape[1] == b.shape[1] else np.zeros((len(a[at : at + STRIP]), len(b)))
            s[np.isnan(s)] = np.inf  # as Spark orders them
            s[~known_a[at : at + STRIP]] = -np.inf
            s[:, ~known_b] = -np.inf
            top = s.max(1)
            row, col = np.nonzero(s >= (top - 2e-9)[:, None])
            near = np.round(s[row, col], 9)
            order = np.lexsort((col, -near, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            best[at : at + STRIP], value[at : at + STRIP] = col[first], near[first]
        rid = right["rid"].take(pa.array(best)) if len(b) else pa.nulls(0, right.schema.field("rid").type)
        out = left.select([group, "lid", "truth"]) if len(b) else left.select([group, "lid", "truth"]).slice(0, 0)
        return out.append_column("s", pa.array(value[: out.num_rows])).append_column("rid", rid)

    met = _met_blocks(q, k, group, nearest, f"{group} {kinds[group]}, lid {kinds['lid']}, truth {kinds['truth']}, s double, rid {kinds['rid']}")
    best = met.groupBy(group, "lid", "truth").agg(F.max_by("rid", F.struct("s", -F.col("rid"))).alias("best"))
    return best.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col("best") == F.col("truth")).cast("double")).alias("recall_at_1"))


def precision_recall_f1(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """Of 0/1 columns; a ratio with nothing below the line is 0."""
    out = rows.agg(F.sum(label * predicted).alias("tp"), F.sum((1 - label) * predicted).alias("fp"), F.sum(label * (1 - predicted)).alias("fn"), F.sum(label).alias("positives"), F.sum(1 - label).alias("negatives"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def contrastive_loss(pairs: DataFrame, temperature: float = 0.1, group: str = "cloud") -> DataFrame:
    """Mean over a group's pairs (eid, a, b) of the cross entropy of their cosine logits with the true partner, both ways.
    The logits of all pairs are matrix products of blocks; a vector sends one partial sum for each block it meets."""
    a = pairs.select(group, F.col("eid").alias("lid"), unit(F.col("a")).alias("lv"))
    b = pairs.select(group, F.col("eid").alias("rid"), unit(F.col("b")).alias("rv"))
    kinds = {c: a.schema[c].dataType.simpleString() for c in (group, "lid")}

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, known_x), (y, known_y) = _matrix(left, "lv"), _matrix(right, "rv")
        i, j = (pd.factorize(np.concatenate([left["lid"].to_numpy(), right["rid"].to_numpy()]))[0][s] for s in (slice(0, len(x)), slice(len(x), None)))
        side, own = [np.zeros(len(x)), np.zeros(len(y))], [np.full(len(x), np.nan), np.full(len(y), np.nan)]
        both = np.isin(i, j)
        for at in range(0, len(x) if len(y) and x.shape[1] == y.shape[1] else 0, STRIP):
            rows = np.arange(at, min(at + STRIP, len(x)))
            l = x[rows] @ y.T / temperature
            e = np.exp(l)
            e[~known_x[rows]] = 0.0
            e[:, ~known_y] = 0.0
            side[0][rows] = e.sum(1)
            side[1] += e.sum(0)
            for r in np.flatnonzero(both[rows] & known_x[rows]):
                col = np.flatnonzero((j == i[at + r]) & known_y)
                own[0][at + r] = l[r, col].max() if len(col) else np.nan
                own[1][col] = np.fmax(own[1][col], l[r, col])
        if not len(x) or not len(y):
            left, right, side, own = left.slice(0, 0), right.slice(0, 0), [np.zeros(0)] * 2, [np.zeros(0)] * 2
        ids = pa.chunked_array(left["lid"].chunks + right["rid"].chunks, left["lid"].type)
        groups = pa.chunked_array(left[group].chunks + right[group].chunks, left[group].type)
        which = pa.array(np.repeat([0, 1], [left.num_rows, right.num_rows]).astype(np.int32))
        return pa.table([groups, which, ids, pa.array(np.concatenate(side)), pa.array(np.concatenate(own), from_pandas=True)], names=[group, "side", "k", "total", "same"])

    met = _met_blocks(a, b, group, sums, f"{group} {kinds[group]}, side int, k {kinds['lid']}, total double, same double")
    loss = met.groupBy(group, "side", "k").agg((F.log(F.sum("total")) - F.max("same")).alias("loss"))
    return loss.groupBy(group).agg(F.avg("loss").alias("loss"))


def run_statistics(rows: DataFrame, ok: Column, made: Column) -> DataFrame:
    out = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(ok.cast("int")), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(made), F.lit(0)).alias("made"))
    return out.select(
        "total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"), F.when(F.col("total") > 0, F.col("succeeded") * 100.0 / F.col("total")).otherwise(0.0).alias("success_rate"),
        F.when(F.col("succeeded") > 0, F.col("made") / F.col("succeeded")).otherwise(0.0).alias("average_made"),
    )


def best_epoch(rows: DataFrame, metric: str, epoch: str = "epoch") -> DataFrame:
    """The earliest epoch with the largest metric."""
    return rows.agg(F.max_by(epoch, F.struct(metric, -F.col(epoch))).alias("epoch"), F.max(metric).alias(metric))


def _numbered(rows: DataFrame, order: list[str], cut, name: str, first: int, parts: int | None) -> tuple[DataFrame, int]:
    """`running_numbers` and the number of rows."""
    if cut is None:
        from partloom.plans.runtime import cutter

        cut = cutter(rows.sparkSession)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the high bits of this id are the range, the low 33 bits the place in it; written once, so that a task that runs again changes nothing
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).count().collect()
    before, at = first, []
    for part, n in sorted(sizes):
        at.append((part, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(at, "_part long, _before long"))
    out = placed.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at"), before - first


def running_numbers(rows: DataFrame, order: list[str], cut=None, *, name: str = "number", first: int = 0, parts: int | None = None) -> DataFrame:
    """`rows` with their place, counted from `first`, in the order of the columns `order` over the whole table.

    Spark samples splitters of the composite key, ranges (`parts`, else as many as shuffles have partitions) go to tasks and are sorted there, and a row's number is its place
    in its range plus the sizes of the ranges before, of which the driver sees `parts` at most. Any orderable types will
    do; nulls come first, NaN last; where the first columns tie the next ones divide a range. Rows that are equal in all
    of `order` take consecutive numbers in any order, so name a unique column last where that matters."""
    return _numbered(rows, order, cut, name, first, parts)[0]


def positional_split(rows: DataFrame, order: str, share: float = 0.8, group: str | None = None, parts: int | None = None) -> DataFrame:
    """The first int(n * share) rows in `order` train, the others validate, in each group or over all rows (by
    `running_numbers`: any orderable type)."""
    if group:
        w = Window.partitionBy(group)
        place = F.row_number().over(w.orderBy(order))
        return rows.withColumn("split", F.when(place <= F.floor(F.count("*").over(w) * F.lit(share) + 1e-9), "train").otherwise("val"))
    placed, n = _numbered(rows, [order], None, "_place", 1, parts)
    return placed.withColumn("split", F.when(F.col("_place") <= math.floor(n * share + 1e-9), "train").otherwise("val")).drop("_place")


def part_split(rows: DataFrame, part: str, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """Whole parts to train, val and test by the digest of their id: no part is in two splits, and a new part moves
    no other."""
    u = F.conv(F.substring(F.md5(F.col(part).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """Of each label the first int(n * share) rows by the digest of their key train. Rows are numbered over all labels at
    once, so a label that holds most of them is no task of its own."""
    placed = running_numbers(rows.withColumn("_digest", F.md5(F.col(key).cast("string"))), [label, "_digest", key], name="_place")
    sizes = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    both = placed.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    train = F.col("_place") - F.col("_first") < F.floor(F.col("_n") * F.lit(share) + 1e-9)
    return both.withColumn("split", F.when(train, "train").otherwise("val")).drop("_digest", "_place", "_label", "_first", "_n")


def split_manifest(splits: DataFrame, member: str) -> DataFrame:
    """Rows `(split, num_files, file)`: every member with its split and the size of that split."""
    counts = splits.groupBy("split").agg(F.count("*").alias("num_files"))  # a row for each split
    return splits.select("split", F.col(member).alias("file")).join(F.broadcast(counts), "split")
