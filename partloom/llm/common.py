"""Helpers shared by the corpus operators: table access, lineage cuts, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a session on one machine, such as tests
    run in, gets a local one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="partloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive any executor. `drop` deletes one early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n, self.paths = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", 0, set()

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        # Spark deletes the shuffle files of a plan when the driver's collector finds the plan dead, by default every 30
        # minutes (spark.cleaner.periodicGC.interval). The plan just written is dead now, so ask for it here.
        gc.collect()
        self.spark._jvm.System.gc()
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(getattr(df, "_scratch_path", None))

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables written so far but those that a result still reads."""
        for path in self.paths - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, path: str | None) -> None:
        if path in self.paths:
            self.paths.discard(path)
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def literal_array(values, kind: str = "bigint") -> Column:
    """A constant array from plain numbers (one expression, folded once)."""
    values = list(values)
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)`: rows `(node, root)`, root being the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each one a group-by and a written table, until
    an edge set repeats. A star's centre is found by a combinable minimum, so that a hub with a third of all edges
    costs one row per map task; the edges of a hub are not gathered anywhere. Nodes without an edge are not returned.
    """
    pairs = scratch.cut(edges.select("a", "b").where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    seen = None
    while True:
        both = pairs.union(pairs.selectExpr("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.where("b > a").join(low, "a").selectExpr("b a", "m b").where("a <> b")
        nxt = large.selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
        low = nxt.groupBy("a").agg(F.min("b").alias("m"))
        small = nxt.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m")
        done = scratch.cut(small.selectExpr("m a", "s.x b").where("a <> b").distinct())
        mark = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        scratch.drop(pairs)
        pairs = done
        if mark == seen or mark[0] == mark[2]:  # every node hangs on one centre, which may still be a leaf
            roots = done.select("a").intersect(done.select("b"))
            if mark == seen or roots.isEmpty():
                break
        seen = mark
    return done.selectExpr("b node", "a root").union(done.selectExpr("a node", "a root").distinct())


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows in one Arrow batch: texts are long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_groups(batches, key: str, most: int = 20_000):
    """From Arrow batches sorted by `key`: tables that hold whole runs of equal keys, with the runs' bounds."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < most:
            continue
        k = held.column(key).to_numpy()
        cut = int(np.flatnonzero(k[1:] != k[:-1])[-1]) + 1 if (k[1:] != k[:-1]).any() else 0
        if cut:
            yield held.slice(0, cut).combine_chunks(), _runs(k[:cut])
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), _runs(held.column(key).to_numpy())


def _runs(k):
    import numpy as np

    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


def bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """Which of `bits` places the hashes `h` take, as a table of words of 64 places: its size is `bits` / 64 rows at most."""
    place = F.pmod("h", F.lit(bits))
    return hashes.groupBy(F.shiftright(place, 6).alias("bucket")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {bits}L) % 64 as int))")).alias("bits"))


def in_bitmap(df: DataFrame, places: DataFrame, bits: int, among: bool = True) -> DataFrame:
    """Rows whose `h` may be among the bitmap's hashes, without a shuffle of `df`; or else (not `among`) the others.

    Join the result by inner or outer joins: Spark moves a semi or anti join below this one, to all rows."""
    rows = df.withColumn("bucket", F.shiftright(F.pmod("h", F.lit(bits)), 6)).join(F.broadcast(places), "bucket", "inner" if among else "left")
    bit = F.expr(f"coalesce(shiftrightunsigned(bits, cast(pmod(h, {bits}L) % 64 as int)) & 1L, 0L)")
    return rows.where(bit == int(among)).select(*df.columns)


def packed(hashes_of, buckets: int, most: int = 1 << 21):
    """A mapInArrow function: the hashes (arrays of int64, from `hashes_of(batch)`) of a task, distinct and packed by
    bucket: `one` holds those that came once, `many` the others. Hashes, not rows, are what a shuffled row consists of."""
    import numpy as np
    import pyarrow as pa

    def pack(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        to = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        to = (to % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        h, n, to = h[order], n[order], to[order]
        cut = np.searchsorted(to, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        blob = lambda b, keep: h[cut[b] : cut[b + 1]][keep(n[cut[b] : cut[b + 1]])].tobytes()
        columns = [pa.array([blob(b, k) for b in some], pa.binary()) for k in (lambda n: n == 1, lambda n: n > 1)]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *columns], names=["bucket", "one", "many"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in hashes_of(batch):
                held.append(part)
                size += len(part)
                if size >= most:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return run


def repeated_in(batches):
    """Of sorted buckets of `packed`: the hashes `h` that came more than once."""
    import numpy as np
    import pyarrow as pa

    for t, bounds in whole_groups(batches, "bucket", 1):
        one, many = t.column("one").to_pylist(), t.column("many").to_pylist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            h, n = np.unique(np.frombuffer(b"".join(one[a:b]), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.union1d(h[n > 1], np.frombuffer(b"".join(many[a:b]), np.int64)))], names=["h"])
