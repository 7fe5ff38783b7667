"""Removal of long repeated byte strings with suffix arrays built by two-stage sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, bitmap, in_bitmap, packed, repeated_in, small_batches, table, whole_groups
from partloom.llm.tokens import _BASE, _BYTE, _UNBASE, in_chunks, mix, powers

U = np.uint64
GRAM = 128
PLACE_BITS = 24
SEGMENT = 1 << 23


# --- suffix arrays -----------------------------------------------------------------------------------------------


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one. The empty suffix is the smallest."""
    step = np.zeros(len(t), np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    step[-1:] = -1
    at = np.where(step != 0, np.arange(len(t)), len(t))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def sort_directly(t: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """`places` ordered by their first `depth` bytes: by eight bytes at once, then each tied group by the rest."""
    wide = np.concatenate([t, np.zeros(8, np.uint8)])
    head = np.ndarray((len(t),), ">u8", wide.tobytes(), strides=(1,))[places].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    places, head = places[order], head[order]
    bounds = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1], [True]]))
    s, out = t.tobytes().decode("latin-1"), places.tolist()
    for a in np.flatnonzero(np.diff(bounds) > 1):
        i, j = bounds[a], bounds[a + 1]
        out[i:j] = sorted(out[i:j], key=lambda p: s[p + 8 : p + depth])
    return np.array(out, np.int64)


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of the bytes `t`, ordered by at least their first `depth` bytes.

    Two stages: the suffixes smaller than their successors are sorted directly; then the buckets of first bytes are
    scanned from the smallest on, and each entry p of a bucket appends p - 1 to the bucket of its byte if that suffix
    is not smaller than its successor. A bucket is scanned as a whole: first what smaller buckets have appended, in
    rounds for runs of its own byte, then its directly sorted suffixes.
    """
    if not len(t):
        return np.zeros(0, np.int64)
    small = smaller_than_successor(t)
    direct = sort_directly(t, np.flatnonzero(small), depth)
    first = np.searchsorted(t[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in range(256):
        mine = direct[first[c] : first[c + 1]]
        if not queue[c] and not len(mine):
            continue
        parts, last = queue[c], np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        while len(last):
            last = last[last > 0] - 1
            last = last[t[last] == c]
            parts.append(last)
        bucket = np.concatenate([*parts, mine])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = t[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            queue[t[part[0]]].append(part)
    return np.concatenate(out)


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths, up to `depth` (a multiple of 8), of neighbours in `order`."""
    wide = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(wide) - 7,), "<u8", wide.tobytes(), strides=(1,))
    out = np.full(max(0, len(order) - 1), depth, np.int64)
    alive = np.arange(len(out))
    for at in range(0, depth, 8):
        x = words[order[alive] + at] ^ words[order[alive + 1] + at]
        off = x != 0
        low = x[off] & (~x[off] + U(1))
        out[alive[off]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        alive = alive[~off]
        if not len(alive):
            break
    return out


# --- anchors: which strings can meet -----------------------------------------------------------------------------


def runs_of(buf: np.ndarray, ends: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number, anchor) of runs of consecutive start places whose `length`-byte strings have the same anchor.

    The anchor of a string is the place in it of the 128-byte gram with the least hash, the leftmost on a tie: equal
    strings have equal anchors at equal places. `ends`: where the texts in `buf` end; no string crosses them.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)))])
    h = mix((total[GRAM:] - total[:-GRAM]) * powers(_UNBASE, len(buf))[: len(buf) - GRAM + 1])
    width = length - GRAM + 1
    key = (h >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    n = len(key) - width + 1
    place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    valid = np.ones(n, bool)
    for e in ends:
        valid[max(0, e - length + 1) : e] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]])])
    start = at[new]
    number = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
    return start, number, h[place[start]]


def _runs(batch: pa.RecordBatch, length: int):
    """Per group of texts: (text, its start in the group, start, number, anchor) of `runs_of`, and the group's bytes."""
    base = 0
    for chunk in in_chunks(batch.column("text").to_pylist()):
        raw = [t.encode("utf-8", "replace") for t in chunk]
        pieces = [(i, a, r[a : a + SEGMENT + length - 1]) for i, r in enumerate(raw) for a in range(0, max(1, len(r) - length + 1), SEGMENT)]
        groups = [pieces] if len(raw) > 1 else [[p] for p in pieces]
        for group in groups:
            joined = b"".join(p[2] for p in group)
            size = np.array([len(p[2]) for p in group], np.int64)
            ends = np.cumsum(size)
            start, number, anchor = runs_of(np.frombuffer(joined, np.uint8), ends.tolist(), length)
            of = np.searchsorted(ends, start, "right")
            text, offset = (np.array([p[k] for p in group], np.int64) for k in (0, 1))
            yield base + text[of], start - (ends - size)[of] + offset[of], start, number, anchor, joined
        base += len(chunk)


def _describe(length: int):
    schema = pa.schema([("tkey", pa.binary()), ("id", pa.string()), ("start", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("slice", pa.binary())])

    def run(batches):
        for batch in batches:
            for text, place, start, number, anchor, joined in _runs(batch, length):
                own = [xxhash.xxh3_128_digest(joined[s : s + n + length - 1]) for s, n in zip(start.tolist(), number.tolist())]
                text = pa.array(text)
                columns = [batch.column("tkey").take(text), batch.column("id").take(text), pa.array(place), pa.array(number.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _anchors(length: int, buckets: int):
    """The anchors of all runs of a task, packed by bucket."""
    return packed(lambda batch: [r[4].view(np.int64) for r in _runs(batch, length)], buckets)


def _repeats(length: int, most_bytes: int):
    """Of sorted slices: the start places whose string also starts at another place of the same anchor's slices."""

    def sort_and_mark(slices, numbers, heavy):
        at = np.cumsum([0] + [len(s) + 1 for s in slices])
        t = np.zeros(at[-1], np.uint8)
        own = np.zeros(at[-1], bool)
        for a, s, n in zip(at, slices, numbers):
            t[a : a + len(s)] = np.frombuffer(s, np.uint8) + 1
            own[a : a + n] = True
        order = suffix_array(t, length)
        order = order[own[order]]
        equal = np.flatnonzero(adjacent_prefixes(t, order, length) >= length)
        marked = np.zeros(len(t), bool)
        marked[order[equal]] = True
        marked[order[equal + 1]] = True
        for k, (a, n) in enumerate(zip(at, numbers)):
            if not heavy[k]:
                m = np.concatenate([[False], marked[a : a + n], [False]])
                edge = np.flatnonzero(m[1:] != m[:-1])
                for b, e in zip(edge[::2], edge[1::2]):
                    yield k, int(b), int(e - b)

    def run(batches):
        for t, bounds in whole_groups(batches, "anchor", 500):
            raw, n, heavy, start = t.column("bytes").to_pylist(), t.column("n").to_pylist(), t.column("heavy").to_pylist(), t.column("start").to_numpy()
            took, begin, count = [], [], []
            a = 0
            while a < len(bounds) - 1:
                b, size = a, 0
                while b < len(bounds) - 1 and (b == a or size < most_bytes):  # several anchors make one text
                    size += sum(map(len, raw[bounds[b] : bounds[b + 1]]))
                    b += 1
                lo, hi = bounds[a], bounds[b]
                for k, s, c in sort_and_mark(raw[lo:hi], n[lo:hi], heavy[lo:hi]):
                    took.append(lo + k)
                    begin.append(start[lo + k] + s)
                    count.append(c)
                a = b
            yield pa.RecordBatch.from_arrays([t.column("tkey").combine_chunks().take(pa.array(took, pa.int64())) if took else pa.array([], pa.binary()), pa.array(begin, pa.int64()), pa.array(count, pa.int64())], names=["tkey", "start", "n"])

    return run


def _each_string(length: int):
    """Every start place of a slice with the hash of its string: for anchors with too many slices for one task."""

    def run(batches):
        for batch in batches:
            tkeys, starts, own, raw, heavy = (batch.column(c).to_pylist() for c in ("tkey", "start", "n", "bytes", "heavy"))
            for k in range(len(raw)):
                h = [xxhash.xxh3_128_digest(raw[k][i : i + length]) for i in range(own[k])]
                yield pa.RecordBatch.from_arrays([pa.array([tkeys[k]] * own[k], pa.binary()), pa.array(range(starts[k], starts[k] + own[k]), pa.int64()), pa.array(h, pa.binary()), pa.array([heavy[k]] * own[k])], names=["tkey", "start", "h", "heavy"])

    return run


def covered(ranges, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs [begin, end) of strings that start in the ranges (start, n)."""
    out: list[list[int]] = []
    for s, n in sorted(ranges):
        e = s + n + length - 1
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _cut_out(length: int):
    def run(batches):
        for batch in batches:
            removed, spans, digest, kept = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                raw, gone = text.encode("utf-8", "replace"), covered([(r["start"], r["n"]) for r in ranges or ()], length)
                rest = b"".join(raw[a:b] for a, b in zip([0] + [e for _, e in gone], [s for s, _ in gone] + [len(raw)]))
                removed.append(len(raw) - len(rest))
                spans.append([{"begin": a, "end": b} for a, b in gone])
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(digest)],
                names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, task_slices: int = 4096, sort_bytes: int = 1 << 18, filter_bits: int = 1 << 26) -> DataFrame:
    """What is left of every text when each byte covered by a repeated `length`-byte string goes.

    A string is repeated if it also starts anywhere else in the table, the same text included; overlaps count; all is
    judged on the input. (1) Start places are put in runs by the anchor of their string (`runs_of`): equal strings have
    equal anchors, so only runs of one anchor can hold a repeat, and the run's slice is all that its strings cover.
    Anchors are counted first, packed by bucket, and runs are written only where their anchor occurs again (or shares
    one of `filter_bits` places with such an anchor). (2) Equal slices are counted; those that occur twice are repeated whole. (3) Anchors with several different slices
    have one of each dealt to a task, which joins the slices into texts of about `sort_bytes`, builds their suffix
    arrays by two-stage sorting, and marks the neighbours with a common prefix of `length`. An anchor with more than
    `task_slices` different slices, which one task should not hold, has the strings of its slices counted by hash
    instead. (4) The places found meet their text once more; texts without any are not shuffled. A text that occurs twice is repeated whole, so of copies
    only counts are moved.

    Returns `id_col, n_bytes, n_removed, spans, kept_sha256`; spans: the maximal removed runs as byte offsets. Null
    texts count as empty. Ids may be null or repeat. Texts shorter than `length` stay whole. Empty table: no rows.
    Other columns are ignored. `length` is a multiple of 8, and above 128.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("tkey"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    long = rows.where(F.col("n_bytes") >= length)

    own = long.select("tkey", F.col("id").cast("string").alias("id"), "text")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.select("text").mapInArrow(_anchors(length, buckets), "bucket int, one binary, many binary").repartition("bucket").sortWithinPartitions("bucket")
    again = bitmap(dealt.mapInArrow(repeated_in, "h long"), filter_bits)
    runs = own.mapInArrow(_describe(length), "tkey binary, id string, start long, n int, h long, slice binary")
    runs = scratch.cut(in_bitmap(runs, again, filter_bits).withColumnRenamed("h", "anchor"))
    slices = scratch.cut(runs.groupBy("anchor", "slice").agg(F.count("*").alias("copies"), F.min(F.struct("tkey", "id", "start", "n")).alias("of")))
    met = slices.groupBy("anchor").agg(F.count("*").alias("slices")).where("slices > 1")
    unsure = slices.join(met, "anchor").select("anchor", "slice", "slices", (F.col("copies") > 1).alias("heavy"), "of.*")
    wanted = scratch.cut(unsure.groupBy("tkey", "id").agg(F.collect_list(F.struct("anchor", "slice", "slices", "heavy", "start", "n")).alias("parts")))  # bounded by one text
    repeated = scratch.cut(slices.where("copies > 1").select("anchor", "slice"))
    scratch.drop(slices)

    text_of = in_bitmap(own.withColumn("h", F.xxhash64("tkey")), bitmap(wanted.select(F.xxhash64("tkey").alias("h")), filter_bits), filter_bits)
    w, x = wanted.alias("w"), text_of.select("tkey", "id", F.encode("text", "UTF-8").alias("bytes")).alias("x")
    part = lambda p: F.struct(*(p[c].alias(c) for c in ("anchor", "slice", "slices", "heavy", "start", "n")), F.substring("x.bytes", p["start"].cast("int") + 1, p["n"] + (length - 1)).alias("bytes"))
    joined = w.join(x, F.expr("w.tkey = x.tkey and w.id <=> x.id")).select("w.tkey", F.explode_outer(F.transform("w.parts", part)).alias("p"))
    cut = scratch.cut(joined.select("tkey", "p.*").dropDuplicates(["anchor", "slice"]))
    scratch.drop(wanted)
    few, many = cut.where(F.col("slices") <= task_slices), cut.where(F.col("slices") > task_slices)
    cols = ["tkey", "anchor", "start", "n", "heavy", "bytes"]
    sorted_ = few.select(cols).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats(length, sort_bytes), "tkey binary, start long, n long")
    each = many.select(cols).mapInArrow(_each_string(length), "tkey binary, start long, h binary, heavy boolean")
    twice = each.groupBy("h").agg(F.count("*").alias("c"), F.max("heavy").alias("heavy")).where("c > 1 or heavy").select("h")
    hashed = each.join(twice, "h").select("tkey", "start", F.lit(1).cast("long").alias("n"))

    whole = runs.join(repeated, ["anchor", "slice"]).select("tkey", "start", F.col("n").cast("long").alias("n"))
    counts = scratch.cut(rows.groupBy("tkey").agg(F.count("*").alias("texts")).where("texts > 1"))
    found = whole.union(sorted_).union(hashed).join(counts, "tkey", "left_anti").groupBy("tkey").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    ranges = scratch.cut(found)
    scratch.keep_only(ranges, counts)

    light = rows.select("id", "tkey", "n_bytes", F.sha2("text", 256).alias("whole"))
    copies = light.join(counts, "tkey")
    span = F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end"))
    nothing = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    copies = copies.select(
        "id",
        "n_bytes",
        F.when(F.col("n_bytes") >= length, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("n_bytes") >= length, F.array(span)).otherwise(nothing).alias("spans"),
        F.when(F.col("n_bytes") >= length, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    marked = bitmap(counts.select(F.xxhash64("tkey").alias("h")).union(ranges.select(F.xxhash64("tkey").alias("h"))), filter_bits)
    keyed = rows.withColumn("h", F.xxhash64("tkey"))
    touched = in_bitmap(keyed, marked, filter_bits).join(counts, "tkey", "left").where("texts is null").join(ranges, "tkey", "left").select("id", "n_bytes", "text", "ranges")
    clean = in_bitmap(keyed, marked, filter_bits, among=False).select("id", "n_bytes", "text", F.lit(None).cast("array<struct<start:bigint,n:bigint>>").alias("ranges"))
    result = f"id {id_type}, n_bytes long, n_removed long, spans array<struct<begin:bigint,end:bigint>>, kept_sha256 string"
    once = touched.mapInArrow(_cut_out(length), result).union(clean.mapInArrow(_cut_out(length), result))
    return once.union(copies).withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
