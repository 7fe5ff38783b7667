"""Approximate nearest neighbours by balanced posting lists, a centroid graph and distance-ratio pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, literal_array, table


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more component that makes all norms equal: then the largest inner product is the nearest point."""
    rest = np.maximum(largest * largest - (x * x).sum(axis=1), 0)
    return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)


def scaled(q: np.ndarray, largest: float) -> np.ndarray:
    """Queries at the data's norm, which changes no ranking, with the additional component 0."""
    q = q * (largest / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300))
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0))


def balanced_centroids(x: np.ndarray, n: int, rounds: int = 12, weight: float = 0.3) -> np.ndarray:
    """k-means whose assignment pays for a cluster's size, so that no posting list swallows the data."""
    rng = np.random.Generator(np.random.PCG64(10))
    c = x[rng.permutation(len(x))[:n]].copy()
    size = np.ones(len(c))
    for _ in range(rounds):
        owner = np.empty(len(x), np.int64)
        for a in range(0, len(x), 4096):
            d = distances(x[a : a + 4096], c) ** 2
            owner[a : a + 4096] = (d + weight * d.mean() * (size / size.mean() - 1)).argmin(axis=1)
        size = np.bincount(owner, minlength=len(c)).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, owner, x)
        empty = size == 0
        c = np.where(empty[:, None], x[rng.integers(0, len(x), len(c))], total / np.maximum(size, 1)[:, None])
        size = np.maximum(size, 1)
    return c


class CentroidGraph:
    """Centroids linked to their nearest ones in both directions and to a ring through all, which keeps it connected."""

    def __init__(self, centroids: np.ndarray, links: int = 16):
        n = len(centroids)
        self.c = centroids
        near = np.concatenate([np.argsort(distances(centroids[a : a + 512], centroids), axis=1, kind="stable")[:, 1 : links + 1] for a in range(0, n, 512)])
        out = [set(r.tolist()) | {(i + 1) % n} for i, r in enumerate(near)]
        for i, r in enumerate(near):
            for j in r:
                out[j].add(i)
        width = max(map(len, out))
        self.links = np.array([sorted(s) + [i] * (width - len(s)) for i, s in enumerate(out)], np.int64)
        self.entry = np.arange(0, n, max(1, n // 8))

    def within(self, q: np.ndarray, ratio: float, least: int = 16) -> np.ndarray:
        """For every query which centroids are no farther than `ratio` times the nearest found: best-first search of
        the graph, all queries of the block in step; a query ends when its nearest unvisited node is beyond the ratio
        and `least` nodes are expanded."""
        rows = np.arange(len(q))
        dist = np.full((len(q), len(self.c)), np.inf)
        open_ = np.zeros(dist.shape, bool)
        dist[:, self.entry] = distances(q, self.c[self.entry])
        open_[:, self.entry] = True
        done = 0
        while len(rows):
            d = np.where(open_[rows], dist[rows], np.inf)
            pick = d.argmin(axis=1)
            at = d[np.arange(len(rows)), pick]
            go = np.isfinite(at) & ((at <= ratio * dist[rows].min(axis=1)) | (done < least))
            rows, pick = rows[go], pick[go]
            open_[rows, pick] = False
            to = self.links[pick]
            new = ~np.isfinite(dist[rows[:, None], to])
            d = np.linalg.norm(q[rows][:, None, :] - self.c[to], axis=2)
            dist[rows[:, None], to] = np.where(new, d, dist[rows[:, None], to])
            open_[rows[:, None], to] |= new
            done += 1
        return dist <= ratio * dist.min(axis=1, keepdims=True)

    def filled(self, q: np.ndarray, taken: np.ndarray, held: np.ndarray, least: int) -> np.ndarray:
        """`taken`, and where its centroids' lists hold (`held`) fewer than `least` ids the nearest ones that do."""
        short = np.flatnonzero(taken @ held < least)
        if len(short):
            order = np.argsort(distances(q[short], self.c), axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            more = np.zeros((len(short), len(self.c)), bool)
            np.put_along_axis(more, order, before < least, axis=1)
            taken[short] |= more
        return taken


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    sample: int = 20_000,
    list_size: int = 512,
    max_lists: int = 4096,
    replicas: int = 4,
    boundary: float = 1.03,
    ratio: float = 1.15,
    group_rows: int = 20_000,
) -> DataFrame:
    """For every query the `k` rows of largest inner product found, itself (by id) excluded, ties to the smaller id.

    Equal vectors are one entry with its k + 1 smallest ids, which are all that can be among anyone's k nearest; so a
    vector that a third of all rows share is one entry too. Entries get one component more (`augmented`), which turns
    the inner product into a distance. Centroids, one for `list_size` entries and `max_lists` at most, are fitted on a
    bounded `sample` drawn by hash with a size penalty. Every entry goes to the list of its nearest centroid and, near
    a boundary, to up to `replicas` lists whose centroid is within `boundary` times that distance. A query searches
    the centroid graph and takes the lists within `ratio` times the nearest distance, however many, and further ones
    in order of distance until they hold k + 1 ids, each counted at its nearest centroid only. Lists and their queries are cut into pieces of at most about `group_rows` and multiplied block by block in double precision.

    Returns `query_id, rank, id_col, score`. Vectors that are null, zero, of another length than the most frequent
    one, or have null or non-finite components take no part, on either side; null ids take no part. Of repeated rows
    (same id and vector) one counts. An empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)

    def usable(df):
        v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
        ok = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
        return ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).withColumn("key", F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), "v")), F.hex(F.xxhash64(F.lit(2), "v"))))

    schema = "query_id long, rank int, id long, score double"
    have, want = usable(rows), usable(queries)
    lengths = have.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dim = lengths["n"]
    have, want = have.where(F.size("v") == dim), want.where(F.size("v") == dim)

    # the k + 1 smallest ids of each vector, in two steps: a hot vector's rows are first thinned out in 64 parts
    some = have.dropDuplicates(["key", "id"]).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["key", "part"], ["key"]):
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("place") <= k + 1)
    entries = scratch.cut(some.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    asked = scratch.cut(want.groupBy("key").agg(F.first("v").alias("v")))

    count, largest = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    rate = min(1.0, sample / count)
    drawn = entries.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 30)) < rate * (1 << 30)).orderBy(F.xxhash64(F.lit(3), "key"), "key").limit(2 * sample).select("v").toArrow()
    x = augmented(_matrix(drawn.column("v")), largest) if drawn.num_rows else np.zeros((1, dim + 1))
    shared = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, min(len(x), max_lists, max(1, -(-count // list_size))))))

    def place(batches):
        c = shared.value.c
        for b in batches:
            x = augmented(_matrix(b.column("v")), largest)
            owner, to, home = [], [], []
            for a in range(0, len(x), 1024):
                d = distances(x[a : a + 1024], c)
                near = np.argsort(d, axis=1, kind="stable")[:, :replicas]
                take = np.take_along_axis(d, near, 1) <= boundary * d.min(axis=1, keepdims=True)
                take[:, 0] = True
                i, j = np.nonzero(take)
                owner.append(i + a)
                to.append(near[i, j])
                home.append(j == 0)
            o = pa.array(np.concatenate(owner)) if owner else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32) if to else [], pa.int32()), pa.array(np.concatenate(home) if home else [], pa.bool_()), b.column("key").take(o), b.column("v").take(o), b.column("ids").take(o)], names=["list", "home", "key", "v", "ids"])

    def select(batches):
        g = shared.value
        for b in batches:
            q = scaled(_matrix(b.column("v")), largest)
            owner, to = [], []
            for a in range(0, len(q), 256):
                block = q[a : a + 256]
                i, j = np.nonzero(g.filled(block, g.within(block, ratio), held_ids.value, k + 1))
                owner.append(i + a)
                to.append(j)
            o = pa.array(np.concatenate(owner)) if owner else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32) if to else [], pa.int32()), b.column("key").take(o), b.column("v").take(o)], names=["list", "key", "v"])

    posted = scratch.cut(entries.mapInArrow(place, "list int, home boolean, key string, v array<double>, ids array<long>"))
    held = np.zeros(len(shared.value.c), np.int64)
    for r in posted.where("home").groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["list"]] = r["n"]
    held_ids = spark.sparkContext.broadcast(held)
    posted = posted.drop("home")
    probes = scratch.cut(asked.mapInArrow(select, "list int, key string, v array<double>"))
    n_lists = len(shared.value.c)
    pieces = {}
    for name, df in (("p", posted), ("q", probes)):
        sizes = dict(df.groupBy("list").count().collect())
        pieces[name] = [max(1, -(-sizes.get(i, 0) // group_rows)) for i in range(n_lists)]

    def cut_up(df, mine, other):
        own, all_ = F.get(literal_array(pieces[mine], "int"), F.col("list")), F.get(literal_array(pieces[other], "int"), F.col("list"))
        return df.withColumn(mine, F.pmod(F.xxhash64("key"), own).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), all_ - 1)))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"key": [], "scores": [], "found": []}, dtype=object)
        x, ids, scores, found = np.stack(left["v"].to_numpy()), left["ids"].to_numpy(), [], []
        for a in range(0, len(right), 256):
            q = np.stack(right["v"].iloc[a : a + 256].to_numpy())
            s = q @ x.T
            m = min(k + 1, len(x))
            bar = np.partition(s, len(x) - m, axis=1)[:, len(x) - m] - 1e-9 * (1 + np.abs(s).max(axis=1))
            for i in range(len(q)):
                near = np.flatnonzero(s[i] >= bar[i])  # ties and rounding included
                exact = (x[near] * q[i]).sum(axis=1)
                got = sorted((-float(e), int(v)) for e, n in zip(exact, near) for v in ids[n])[: k + 1]
                scores.append([-g[0] for g in got])
                found.append([g[1] for g in got])
        return pd.DataFrame({"key": right["key"].to_numpy(), "scores": scores, "found": found})

    keys = ["list", "p", "q"]
    found = cut_up(posted, "p", "q").groupBy(*keys).cogroup(cut_up(probes, "q", "p").groupBy(*keys)).applyInPandas(lambda a, b: search(a, b), "key string, scores array<double>, found array<long>")
    found = found.withColumn("found", F.arrays_zip(F.col("scores").alias("score"), F.col("found").alias("id")))
    ranked = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    best = found.groupBy("key").agg(F.slice(ranked, 1, k + 1).alias("best"))
    out = want.select("id", "key").distinct().withColumnRenamed("id", "query_id").join(best, "key")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.col("b.score").alias("score"))


def op10_nearest(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 20 == 0))
