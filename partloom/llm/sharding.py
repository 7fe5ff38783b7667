"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, subdivided ranges."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, literal_array, table


def _range_of(key: Column, bounds: list[int], step: int = 64) -> Column:
    """How many bounds are <= key, by a two-level search over constant arrays."""
    if not bounds:
        return F.lit(0)
    top = literal_array(bounds[::step])
    first = F.greatest(F.size(F.filter(top, lambda b: b <= key)) - 1, F.lit(0))
    near = F.slice(literal_array(bounds), first * step + 1, F.lit(step))
    return first * step + F.size(F.filter(near, lambda b: b <= key))


def _dealt(sizes: list[int], heavy: set[int], shards: int) -> list[int]:
    """A shard for each range: the heavy ones to the emptiest shard, heaviest first; the others, in their order, fill
    the shards up to the level at which all of them are used up."""
    load, out = [0] * shards, [0] * len(sizes)
    for p in sorted(heavy, key=lambda p: (-sizes[p], p)):
        out[p] = min(range(shards), key=lambda s: (load[s], s))
        load[out[p]] += sizes[p]
    rest = sum(b for p, b in enumerate(sizes) if p not in heavy)
    level, below = 0.0, 0
    for n, low in enumerate(sorted(load)):
        below += low
        level = (rest + below) / (n + 1)
        if n + 1 == shards or level <= sorted(load)[n + 1]:
            break
    room, ends = 0.0, []
    for s in range(shards):
        room += max(0.0, level - load[s])
        ends.append(room)
    run = 0
    for p, b in enumerate(sizes):
        if p not in heavy:
            out[p] = min(bisect_right(ends, run + b / 2), shards - 1)
            run += b
    return out


def shard_by_bytes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    ranges_per_shard: int = 128,
    samples_per_range: int = 16,
) -> DataFrame:
    """Deal all rows into `shards` shards of nearly equal bytes.

    The key is the hash of the text, so that equal texts lie side by side. A row's size is the UTF-8 length of its
    text plus one. (1) Row sizes are summed per key; (2) rows are drawn with a chance in proportion to their size and
    the drawn keys' quantiles become `shards * ranges_per_shard` range boundaries; a key that alone outweighs a range
    gets a range of its own; if it outweighs a whole shard, the range is subdivided by a hash of the row's number, so
    that rows which agree in everything part as well. (3) The exact bytes of the ranges are a bounded list. Ranges of
    heavy keys go to the emptiest shard, heaviest first; the others fill all shards to one level in the order of their
    keys. No group of equal texts that fits into a shard is ever divided; shards differ by about one range unless
    groups of nearly a shard's size leave no other way.

    Returns `id_col, size, text_crc32, shard, slot`: slots count from 0 without gaps in each shard, in the order of
    the ranges and of (key, id) within them. The slot is the range's offset plus the rank in the range; a range of over
    10,000 rows and four times the mean, which holds very small rows, is ranked in pieces by a hash of the row's number,
    so no task sorts more than that many rows, whatever their size.

    Null text: size 1, checksum 0, dealt as the empty text. Null ids are dealt like others and sort first. Repeated
    rows each get a slot of their own. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = scratch.cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("k"),
            F.xxhash64(F.lit(8), F.col(id_col), text).alias("h"),
            F.monotonically_increasing_id().alias("u"),  # settled by the table that is written here
        )
    )
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_ranges = shards * ranges_per_shard
    fair = max(1, total // n_ranges)

    # chance of a row: size * samples / total, by a hash of the row, so that a repeated task draws the same rows
    chance = F.col("size") * F.lit(float(n_ranges * samples_per_range) / max(1, total))
    drawn = keyed.where(F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40)) < chance)
    cuts = drawn.agg(F.percentile_approx("k", [i / n_ranges for i in range(1, n_ranges)], 100 * n_ranges).alias("q")).first()["q"]
    hot = keyed.groupBy("k").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > fair).collect()  # at most n_ranges rows
    bounds = sorted({*(cuts or []), *(r["k"] for r in hot), *(r["k"] + 1 for r in hot if r["k"] < (1 << 63) - 1)})
    parts, heavy = [1] * (len(bounds) + 1), set()
    for r in hot:
        at = bisect_right(bounds, r["k"])
        heavy.add(at)
        if r["bytes"] * shards > total:
            parts[at] = -(-r["bytes"] // fair)
    base = [0]
    for p in parts:
        base.append(base[-1] + p)

    r = _range_of(F.col("k"), bounds)
    piece = F.pmod(F.xxhash64(F.lit(8), "u"), F.get(literal_array(parts), F.col("r")))
    part = keyed.withColumn("r", r).withColumn("part", F.get(literal_array(base), F.col("r")) + piece)
    weights = {x["part"]: (x["bytes"], x["n"]) for x in part.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # a bounded number of rows a range
    shard = _dealt([weights.get(p, (0, 0))[0] for p in range(base[-1])], {p for x in heavy for p in range(base[x], base[x + 1])}, shards)
    offset, rows = [], [0] * shards
    for p, s in enumerate(shard):
        offset.append(rows[s])
        rows[s] += weights.get(p, (0, 0))[1]
    # a part of many small rows, such as empty texts, is ranked in pieces
    most = max(10_000, 4 * sum(n for _, n in weights.values()) // n_ranges)
    cut = [max(1, -(-weights.get(p, (0, 0))[1] // most)) for p in range(base[-1])]
    begin = [0]
    for n in cut:
        begin.append(begin[-1] + n)
    part = part.withColumn("piece", F.get(literal_array(begin), F.col("part")) + F.pmod(F.xxhash64(F.lit(12), "u"), F.get(literal_array(cut), F.col("part"))))
    where_from = [0] * begin[-1]
    counted = dict(part.where(F.get(literal_array(cut), F.col("part")) > 1).groupBy("piece").count().collect()) if max(cut, default=1) > 1 else {}
    for p in range(base[-1]):
        run = offset[p]
        for x in range(begin[p], begin[p + 1]):
            where_from[x] = run
            run += counted.get(x, 0)
    order = Window.partitionBy("piece").orderBy("k", "id", "crc", "size")
    return part.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.get(literal_array(shard, "int"), F.col("part")).alias("shard"),
        (F.row_number().over(order) - 1 + F.get(literal_array(where_from), F.col("piece"))).alias("slot"),
    )


def op8_sharding(spark, sf_dir) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
