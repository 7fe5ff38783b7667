"""N-gram Jaccard join by chosen paths: split sets on sampled shared tokens, brute-force what is small, repeat."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, bitmap, components, in_bitmap, small_batches, table, whole_groups
from partloom.llm.tokens import in_chunks, mix, shingles, words_of

U = np.uint64
COORDINATES = 64
DENSE = 0.75  # of a node's sets: if a child holds as many, its sets are near copies that a split does not part
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | U(1)


def sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    """The distinct shingles of every text, sorted."""
    s, at = shingles(*words_of(texts), n)
    return [np.unique(s[at[i] : at[i + 1]]) for i in range(len(texts))]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set and coordinate the upper half of the smallest token under that coordinate's order."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.int32)
    for j in range(COORDINATES):
        out[:, j] = (np.minimum.reduceat(flat * _FACTORS[j], at) >> U(32)).astype(np.uint32).view(np.int32)
    return out


def _describe(n: int):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys, sizes, sigs = [None] * len(texts), np.zeros(len(texts), np.int64), [None] * len(texts)
            base = 0
            for chunk in in_chunks(texts):
                sets = sets_of(chunk, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    sig = signatures([sets[i] for i in some])
                    for i, g in zip(some, sig):
                        s = sets[i]
                        keys[base + i] = f"{int(s.sum(dtype=np.uint64)):016x}{int(mix(s).sum(dtype=np.uint64)):016x}"
                        sizes[base + i] = len(s)
                        sigs[base + i] = g.tobytes()
                base += len(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), pa.array(keys, pa.string()), pa.array(sizes), pa.array(sigs, pa.binary())], names=["id", "tkey", "key", "size", "sig"])

    return run


def _children(node: Column, sig: Column) -> Column:
    """One sampled coordinate for every node and, for a quarter of them, a second one: 1.25 = 1 / 0.8 on average.
    All sets in the node sample the same ones; their children are told apart by the token found there."""
    at = lambda j: F.substring(sig, j * 4 + 1, F.lit(4))
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(3)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
    child = lambda j: F.xxhash64(node, j, at(j))
    return F.when(F.pmod(F.xxhash64(node, F.lit(2)), F.lit(4)) == 0, F.array(child(first), child(second))).otherwise(F.array(child(first)))


def owned(leaf: int, leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of pairs that may share several leaves, those whose smallest common leaf is this one."""
    out = np.empty(len(i), bool)
    for a in range(0, len(i), 20_000):
        x, y = leaves[i[a : a + 20_000]], leaves[j[a : a + 20_000]]
        common = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x != 0)
        out[a : a + 20_000] = np.where(common, x, np.iinfo(np.int64).max).min(axis=1) == leaf
    return out


def _padded(column) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists))), np.int64)
    for r, x in enumerate(lists):
        out[r, : len(x)] = x
    return out


def _promising(least: float):
    """Rows (leaf, key) of the sets that have, in a leaf that owns the pair, a partner of sufficient estimated similarity."""

    def run(batches):
        for t, bounds in whole_groups(batches, "leaf"):
            leaf = t.column("leaf").to_numpy()
            take = np.zeros(len(leaf), bool)
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(leaf), COORDINATES)
            leaves = _padded(t.column("leaves"))
            for a, b in zip(bounds[:-1], bounds[1:]):
                for r in range(a, b, 64):
                    same = (sk[r : min(b, r + 64), None, :] == sk[None, a:b, :]).sum(axis=2)
                    i, j = np.nonzero(same >= least * COORDINATES)
                    i, j = i + r, j + a
                    i, j = i[i < j], j[i < j]
                    own = owned(leaf[a], leaves, i, j)
                    take[i[own]] = True
                    take[j[own]] = True
            yield t.select(["leaf", "key"]).filter(pa.array(take)).combine_chunks().to_batches()[0] if take.any() else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["leaf", "key"])

    return run


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the tokens that two sets have at least."""
    token, n = np.unique(np.concatenate(sets), return_counts=True)
    token = token[n > 1]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.searchsorted(token, flat)
    ok = at < len(token)
    ok[ok] = token[at[ok]] == flat[ok]
    row, at = row[ok], at[ok]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for c in range(0, len(token), width):
        lo, hi = np.searchsorted(at, [c, c + width])
        m = np.zeros((len(sets), min(width, len(token) - c)), np.float32)
        m[row[lo:hi], at[lo:hi] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(threshold: float):
    """For each group of one leaf (or of two blocks of a large leaf): links per set, and each set's local root."""

    def run(batches):
        for t, bounds in whole_groups(batches, "group", 2000):
            key, leaf, weight = t.column("key").to_pylist(), t.column("leaf").to_numpy(), t.column("weight").to_numpy()
            side, raw, leaves = t.column("side").to_numpy(), t.column("tokens").to_pylist(), _padded(t.column("leaves"))
            keys, counts, roots = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                size = np.array([len(s) for s in sets])
                both = common_counts(sets)
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                if (side[a:b] != side[a]).any():  # two blocks: only pairs across
                    linked &= side[a:b, None] != side[None, a:b]
                i, j = np.nonzero(np.triu(linked, 1))
                if not len(i):
                    continue
                own = owned(leaf[a], leaves, i + a, j + a)
                w = weight[a:b]
                n = np.bincount(i[own], w[j[own]], b - a) + np.bincount(j[own], w[i[own]], b - a)
                root = np.arange(b - a)
                while True:  # smallest position that can be reached
                    new = root.copy()
                    np.minimum.at(new, i, root[j])
                    np.minimum.at(new, j, root[i])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                for r in np.unique(np.concatenate([i, j])):
                    keys.append(key[a + r])
                    counts.append(int(n[r]))
                    roots.append(key[a + root[r]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(roots, pa.string())], names=["key", "n", "root"])

    return run


def runs_for(recall: float, threshold: float, depth: int = 2) -> int:
    """Runs after which a pair at the threshold has met with chance `recall`, if every run goes `depth` levels deep: a
    node has one child, or two for a quarter of them, and the pair goes on in each with the chance `threshold`."""
    met = 1.0
    for _ in range(depth):
        lost = 1 - threshold * met
        met = 1 - (0.75 * lost + 0.25 * lost * lost)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def _classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    leaf_sets: int = 400,
    max_depth: int = 6,
    broadcast_leaves: int = 100_000,
) -> DataFrame:
    """`similar_classes` by row: `id, tkey` (hash of the text), `root` (the same for all rows of a class and no others;
    null without a shingle), `class_id, n_links`."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tkey", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    described = scratch.cut(rows.select("id", "tkey", "text").mapInArrow(_describe(words), f"id {id_type}, tkey long, key string, size long, sig binary"))
    sets = scratch.cut(
        described.where("key is not null")
        .groupBy("key")
        .agg(F.count("*").alias("weight"), F.min("id").alias("min_id"), F.min(F.struct("id", "tkey")).alias("of"), F.max("sig").alias("sig"))
    )

    level = None
    leaves = None
    for depth in range(max_depth):
        if depth == 0:
            roots = F.transform(F.sequence(F.lit(1), F.lit(runs_for(recall, threshold, max_depth))), lambda r: F.xxhash64(r, F.lit(31)))
            nodes = sets.select("key", F.lit(None).cast("long").alias("whole"), F.explode(F.flatten(F.transform(roots, lambda r: _children(r, F.col("sig"))))).alias("node"))
        else:
            nodes = level.join(sets.select("key", "sig"), "key").select("key", "whole", F.explode(_children(F.col("node"), F.col("sig"))).alias("node"))
        sized = nodes.groupBy("node").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).where("n > 1")
        sized = sized.select("node", "n", (F.col("n") > leaf_sets) & (F.coalesce(F.col("n") < DENSE * F.col("whole"), F.lit(True))))
        sized = sized.toDF("node", "n", "split")
        kept = scratch.cut(nodes.drop("whole").join(sized, "node").dropDuplicates(["node", "key"]))
        last = depth == max_depth - 1
        part = kept.drop("split") if last else kept.where("not split").drop("split")
        leaves = part if leaves is None else leaves.union(part)
        if last:
            break
        level = kept.where("split").select("node", "key", F.col("n").alias("whole"))
        if level.isEmpty():
            break

    members = leaves.selectExpr("node leaf", "key", "n").distinct()
    of = members.groupBy("key").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    sketch = F.expr(f"unhex(concat_ws('', transform(sequence(0, {COORDINATES - 1}), j -> hex(substring(sig, j * 4 + 1, 1)))))")
    known = scratch.cut(of.join(sets, "key").select("key", "leaves", "weight", "of", sketch.alias("sketch")))
    most, floor = 4 * leaf_sets, 1 - 2.5 * (1 - threshold)
    sides = members.where(F.col("n") <= most).join(known.select("key", "leaves", "sketch"), "key")
    promising = sides.select("leaf", "key", "leaves", "sketch").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_promising(floor), "leaf long, key string")
    active = scratch.cut(promising.union(members.where(F.col("n") > most).select("leaf", "key")))

    def tokens(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [s.tobytes() for chunk in in_chunks(texts) for s in sets_of(chunk, words)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "tokens"])

    wanted = active.select("key").distinct().join(known, "key").select("key", F.col("of.id").alias("of_id"), F.col("of.tkey").alias("of_tkey"))
    texts = rows.join(wanted, F.col("tkey").eqNullSafe(F.col("of_tkey")) & F.col("id").eqNullSafe(F.col("of_id"))).select("key", "text")
    tokened = texts.mapInArrow(tokens, "key string, tokens binary").dropDuplicates(["key"])
    blocks = active.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(2.0 * leaf_sets)).cast("int").alias("blocks")).where("blocks > 1")
    blocks = scratch.cut(blocks)
    blocks = F.broadcast(blocks) if blocks.limit(broadcast_leaves + 1).count() <= broadcast_leaves else blocks
    dealt = active.join(blocks, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(F.lit(6), "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "leaf", "key", F.xxhash64("leaf", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"), (F.col("mine") > F.col("other")).cast("int").alias("side")
    )
    full = dealt.join(known.select("key", "leaves", "weight"), "key").join(tokened, "key")
    found = scratch.cut(full.repartition("group").sortWithinPartitions("group").mapInArrow(_verify(threshold), "key string, n long, root string"))

    counted = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(scratch, found.selectExpr("key a", "root b"))
    classes = sets.select("key", "weight", "min_id").join(roots.withColumnRenamed("node", "key"), "key", "left").join(counted, "key", "left")
    classes = classes.withColumn("root", F.coalesce("root", "key"))
    named = classes.groupBy("root").agg(F.min("min_id").alias("class_id"))
    per_set = scratch.cut(classes.join(named, "root").select("key", "root", "class_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    scratch.keep_only(described, per_set)
    out = described.select("id", "tkey", "key").join(per_set, "key", "left")
    class_id = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id")
    return out.select("id", "tkey", "root", class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row's class of near-duplicates and its number of links.

    A text is the set of its `words`-word shingles (lower-case runs of letters and digits; a shorter text is one
    shingle). Two rows are linked if the Jaccard similarity of their sets is at least `threshold`; classes are the
    connected components. Equal sets are one entry with a weight, so copies are never paired.

    Chosen paths: in each run all sets start in one node. A node of more than `leaf_sets` sets is split: it samples
    1.25 of 64 min-hash coordinates on average, the same for all its sets, and a set goes to the child that the token
    found there names. Nodes that are small enough, hold `DENSE` of their parent's sets, or are `max_depth` deep, are leaves. `runs_for` gives the number of
    runs for the target `recall` of pairs whose nodes are split down to `max_depth`. In a leaf, pairs are first estimated from one byte of each coordinate (half the
    threshold's distance below it is kept: at 0.8 a pair is lost with a chance below 1e-8), then the exact sets of
    those left are compared in blocks. A pair that shares several leaves belongs to the smallest of them, so links are
    counted once. A leaf of over 4 * `leaf_sets` sets is neither gathered nor estimated, and one of which over twice
    `leaf_sets` are left is cut into blocks and dealt out as pairs of blocks; the names of such leaves are broadcast
    while there are at most `broadcast_leaves`. A leaf returns one row a set, its count and local root, never pairs.

    Returns `id_col, class_id, n_links`: class_id is the smallest id of the class; n_links the number of other rows
    linked with this one, copies included. Null, empty and wordless texts have no shingle: class_id is their own id,
    n_links 0. A null id is nobody's class id unless the whole class has none. Repeated rows count as copies. An empty
    table gives no rows. Other columns are ignored.
    """
    out = _classes(docs, id_col=id_col, text_col=text_col, **options)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 26, **options) -> DataFrame:
    """One row of `docs` for each class, that with the smallest (id, text hash), null ids last; of rows that agree in
    both, one. Rows without a shingle all stay.

    Only rows that may have to go, by a bitmap of `filter_bits` bits, are shuffled; the others pass as they are."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.cut(_classes(docs, id_col=id_col, text_col=text_col, **options).where("root is not null").groupBy("root", "id", "tkey").agg(F.count("*").alias("n")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey")).alias("first"))
    doubt = rows.join(first, "root").withColumn("stays", F.expr("id <=> first.id and tkey = first.tkey")).where("not stays or n > 1")
    doubt = scratch.cut(doubt.select("id", "tkey", "stays"))
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tkey"))
    held = held.withColumn("h", F.xxhash64("id", "tkey"))
    places = bitmap(doubt.select(F.xxhash64("id", "tkey").alias("h")), filter_bits)
    same = F.expr("h.id <=> d.id and h.tkey = d.tkey")
    among = in_bitmap(held, places, filter_bits).alias("h")
    untouched = in_bitmap(held, places, filter_bits, among=False).select("_row.*").union(among.join(doubt.alias("d"), same, "left").where("d.tkey is null").select("_row.*"))
    kept = among.join(doubt.where("stays").alias("d"), same).select("h.*").dropDuplicates(["id", "tkey"])
    return untouched.union(kept.select("_row.*"))


def op3_jaccard_join(spark, sf_dir) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))
