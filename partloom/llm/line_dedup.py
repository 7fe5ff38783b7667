"""Fuzzy line dedup: join of normalised lines on their longest word runs, edit similarity, one occurrence per group."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import Scratch, bitmap, components, in_bitmap, small_batches, table, whole_groups
from partloom.llm.tokens import _BASE, in_chunks, mix, powers, words_and_bytes

U = np.uint64
BITS = 64
LANES = 3  # counters of 21 bits in one long
RUN = 3  # words in a run, at most
HASH_BITS = 46
LENGTH_BITS = 12  # of a short line number, which hold the line's number of words
FULL = (1 << LENGTH_BITS) - 1
SKETCH = ("s", "t", "u", "v")  # columns of a line's sketch
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])")  # scripts without spaces


def simhash(lines: DataFrame, key: str, words: Column) -> DataFrame:
    """`(key, sim)`: bit b of sim is set if more than half of the key's words have it set in their hash.

    The words are exploded and counted per key; the 64 counters travel as 22 sums, three counters of 21 bits in each,
    so that the whole count is one generated aggregation that combines on the map side.
    """
    h = lines.select(key, F.explode(words).alias("w")).select(key, F.xxhash64("w").alias("h"))
    sums = []
    for b in range(0, BITS, LANES):
        spread = None
        for lane in range(min(LANES, BITS - b)):
            bit = F.shiftrightunsigned("h", b + lane).bitwiseAND(F.lit(1))
            bit = F.shiftleft(bit, 21 * lane) if lane else bit
            spread = bit if spread is None else spread.bitwiseOR(bit)
        sums.append(F.sum(spread).alias(f"s{b}"))
    counted = h.groupBy(key).agg(F.count("*").alias("n"), *sums)
    sim = None
    for b in range(BITS):
        lane = F.shiftrightunsigned(f"s{b - b % LANES}", 21 * (b % LANES)).bitwiseAND(F.lit((1 << 21) - 1))
        bit = F.shiftleft((lane * 2 > F.col("n")).cast("long"), b)
        sim = bit if sim is None else sim.bitwiseOR(bit)
    return counted.select(key, sim.alias("sim"))


class Lines:
    """Lines of text as arrays: words (hashes) of all lines one after the other, and per line where they begin (`at`),
    128 bits of hash (`line`), a short number (`lid`, which holds the number of words) and the bytes of its normal form."""

    def __init__(self, texts: list[str]):
        spaced = [UNSPACED.sub(r" \1 ", t) if not t.isascii() and len(t.encode("utf-8", "replace")) > 2 * len(t) else t for t in texts]
        self.words, self.bytes, self.at = words_and_bytes(spaced)
        self.n = np.diff(self.at)
        place = np.arange(len(self.words)) - np.repeat(self.at[:-1], self.n)
        weight = powers(_BASE, int(self.n.max(initial=0)) + 1)[place]
        some = np.flatnonzero(self.n)
        one, two = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        self.chars = np.maximum(self.n - 1, 0)
        if len(some):
            one[some] = np.add.reduceat(self.words * weight, self.at[some])
            two[some] = np.add.reduceat((mix(self.words ^ U(_BASE)) | U(1)) * mix(weight), self.at[some])
            self.chars[some] += np.add.reduceat(self.bytes, self.at[some])
        self.line = np.stack([mix(one ^ self.n.astype(np.uint64)), mix(two + self.n.astype(np.uint64))], axis=1)
        short = (self.line[:, 0] >> U(LENGTH_BITS) << U(LENGTH_BITS)) | np.minimum(self.n, FULL).astype(np.uint64)
        self.lid = short.view(np.int64)

    def blocks(self, able: np.ndarray, edits: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(line, block) of the first run * edits + 1 runs of `run` words of the able lines, longest first and then
        by their hash."""
        count = np.where(able, np.maximum(self.n - run + 1, 0), 0)
        of = np.repeat(np.arange(len(self.n)), count)
        if not len(of):
            return of, np.zeros(0, np.int64)
        start = self.at[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        h, size = self.words[start], self.bytes[start].copy()
        for k in range(1, run):
            h = h * U(_BASE) + self.words[start + k]
            size += self.bytes[start + k]
        key = ((1 << 16) - np.minimum(size, 1 << 16)) << HASH_BITS | (mix(h) >> U(64 - HASH_BITS)).astype(np.int64)
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        first = np.searchsorted(of, np.arange(len(self.n)))
        take = np.arange(len(of)) - first[of] < (edits * run + 1)[of]
        return of[take], key[take]

    def sketches(self) -> np.ndarray:
        """256 bits a line in four numbers: a bit tells whether an odd number of the line's words has its place in their
        hash. A replaced word changes at most two bits."""
        out = np.zeros((len(SKETCH), len(self.n)), np.uint64)
        some = np.flatnonzero(self.n)
        if len(some):
            place = mix(self.words) >> U(56)
            bit = U(1) << (place & U(63))
            for k in range(len(SKETCH)):
                out[k, some] = np.bitwise_xor.reduceat(np.where(place >> U(6) == k, bit, U(0)), self.at[some])
        return out.view(np.int64)

    def codes(self) -> list[str]:
        """Each line as a string with one character for each word, by the word's hash: its edit distance is that of the
        words."""
        places = (self.words % U(0x100000)).astype("<u4") + np.uint32(0x10000)
        s, at = places.tobytes().decode("utf-32-le"), self.at.tolist()
        return [s[a:b] for a, b in zip(at, at[1:])]


def _binary(pairs: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binary values."""
    at = np.arange(0, 16 * len(pairs) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(pairs), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(pairs).tobytes())])


def _split(texts: list[str]):
    """The texts' lines in order, in lists of about a million characters."""
    return in_chunks(line for text in texts for line in text.split("\n"))


def _describe(similarity: float, run: int, min_chars: int, min_equal: int):
    """Every line that is compared with its blocks; `raw` is the hash of the line as it stands."""

    def out(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
            place = np.concatenate([np.arange(t.count("\n") + 1) for t in texts]) if texts else rows
            raw = batch.column("raws").flatten()
            a = 0
            for chunk in _split(texts):
                x = Lines(chunk)
                edits = np.floor(x.n * ((1 - similarity) / similarity) + 1e-9).astype(np.int64)
                of, block = x.blocks((edits > 0) & (x.n > run) & (x.chars >= max(min_chars, min_equal)), edits, run)
                keep = np.flatnonzero((x.n > 0) & (x.chars >= min_equal))
                at = np.searchsorted(of, keep).tolist() + [len(of)]
                # lines that are left out have no blocks, so those of the others follow one another
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(block))
                row = pa.array(rows[a : a + len(chunk)][keep])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("th").take(row), pa.array(place[a : a + len(chunk)][keep].astype(np.int32)), _binary(x.line[keep]), pa.array(x.lid[keep]), raw.slice(a, len(chunk)).take(pa.array(keep)), lists],
                    names=["id", "th", "pos", "line", "lid", "raw", "blocks"],
                )
                a += len(chunk)

    return out


def _coded(batches):
    for batch in batches:
        for chunk in in_chunks(batch.column("text").to_pylist()):
            x = Lines(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(x.lid), _binary(x.line), pa.array(x.codes(), pa.string()), *map(pa.array, x.sketches())], names=["lid", "line", "words", *SKETCH])


def _within(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether lines of n and m words can be similar."""
    most = np.maximum(n, m)
    return (most == FULL) | (np.abs(n - m) <= np.floor(most * (1 - similarity) + 1e-9))


def _distinct(h: np.ndarray, lid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (h, lid) in order, and the bounds of the runs of equal h."""
    order = np.lexsort((lid, h))
    h, lid = h[order], lid[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (lid[1:] != lid[:-1])])
        h, lid = h[new], lid[new]
    return h, lid, np.concatenate([np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else [], [len(h)]]).astype(np.int64)


def _dealt(buckets: int, small: int, most: int = 1 << 21):
    """The blocks' members of a task, packed by bucket: `members` holds (block, lid) of blocks with up to `small` lines
    in the task, `large` the blocks with more. A block takes at most small * 16 bytes from a task."""

    def pack(h, lid):
        h, lid, at = _distinct(h, lid)
        size = np.diff(at)
        many = h[at[:-1][size > small]]
        few = np.repeat(size <= small, size)
        h, lid = h[few], lid[few]
        to, to_many = (mix(x.view(np.uint64)) % U(buckets) for x in (h, many))
        order, order_many = np.argsort(to, kind="stable"), np.argsort(to_many, kind="stable")
        rows = np.stack([h, lid], axis=1)[order]
        cut, cut_many = (np.searchsorted(x, np.arange(buckets + 1)) for x in (to[order], to_many[order_many]))
        some = np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_many) > 0))
        many = many[order_many]
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([rows[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()), pa.array([many[cut_many[b] : cut_many[b + 1]].tobytes() for b in some], pa.binary())],
            names=["bucket", "members", "large"],
        )

    def out(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column("blocks")
            size = np.diff(lists.offsets.to_numpy())
            held.append((lists.flatten().to_numpy(), np.repeat(batch.column("lid").to_numpy(), size)))
            n += len(held[-1][0])
            if n >= most:
                yield pack(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield pack(*map(np.concatenate, zip(*held)))

    return out


def _met(small: int, similarity: float):
    """Of sorted buckets: the pairs (a, b) in blocks of up to `small` lines, and the blocks `h` that have more."""

    def out(batches):
        for t, bounds in whole_groups(batches, "bucket", 1):
            members, large = t.column("members").to_pylist(), t.column("large").to_pylist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                rows = np.frombuffer(b"".join(members[a:b]), np.int64).reshape(-1, 2)
                h, lid, at = _distinct(rows[:, 0], rows[:, 1])
                size, block = np.diff(at), h[at[:-1]]
                many = np.isin(block, np.frombuffer(b"".join(large[a:b]), np.int64)) | (size > small)
                many_h = np.union1d(block[many], np.frombuffer(b"".join(large[a:b]), np.int64))
                pairs = [np.zeros((0, 2), np.int64)]
                for k in np.unique(size[~many]):
                    if k > 1:
                        of = lid[at[:-1][~many & (size == k)][:, None] + np.arange(k)]
                        i, j = np.triu_indices(k, 1)
                        x, y = of[:, i].ravel(), of[:, j].ravel()
                        ok = _within(x & FULL, y & FULL, similarity)
                        pairs.append(np.stack([x[ok], y[ok]], axis=1))
                found = np.unique(np.concatenate(pairs), axis=0)
                null = lambda n: pa.nulls(n, pa.int64())
                join = lambda x, y: pa.concat_arrays([x, y])
                yield pa.RecordBatch.from_arrays(
                    [join(null(len(found)), pa.array(many_h)), join(pa.array(found[:, 0]), null(len(many_h))), join(pa.array(found[:, 1]), null(len(many_h)))], names=["h", "a", "b"]
                )

    return out


def _run_words(similarity: float) -> int:
    """Words in a run: so few that the edits which `similarity` allows cannot break all runs of a line."""
    free = similarity / (1 - similarity)  # words of a line for one edit
    return max(1, min(RUN, math.ceil((free + 1) / 2 - 1e-9) - 1))


def _close(a: str, b: str, similarity: float) -> Column:
    """Whether the numbers of words in two short line numbers can be those of similar lines."""
    most = F.greatest(_length(a), _length(b))
    return (most == FULL) | (F.abs(_length(a) - _length(b)) <= F.floor(most * F.lit(1 - similarity) + 1e-9))


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether the sketches of two lines (columns with the suffixes of their numbers) differ by no more bits than
    the edits of similar lines can change. Exact: no pair of similar lines is lost."""
    most = F.greatest(_length(a), _length(b))
    bits = sum((F.bit_count(F.col(f"{k}_{a}").bitwiseXOR(F.col(f"{k}_{b}"))) for k in SKETCH), F.lit(0))
    return (most == FULL) | (bits <= 2 * F.floor(most * F.lit(1 - similarity) + 1e-9))


def _sketch(lid: str) -> list[Column]:
    return [F.col(k).alias(f"{k}_{lid}") for k in SKETCH]


def _length(lid: str) -> Column:
    return F.col(lid).bitwiseAND(F.lit(FULL))


def _similar(pairs: DataFrame, coded: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of short line numbers the lines (la, lb) whose word edit similarity is high enough. Sketches
    are compared first, so that texts travel for pairs only that can be similar."""
    for k in "ab":
        pairs = pairs.join(coded.select(F.col("lid").alias(k), *_sketch(k)), k)
    pairs = pairs.where(_alike("a", "b", similarity)).select("a", "b")
    x = coded.select(F.col("lid").alias("a"), F.col("line").alias("la"), F.col("words").alias("x"))
    y = coded.select(F.col("lid").alias("b"), F.col("line").alias("lb"), F.col("words").alias("y"))
    most = F.expr(f"cast(floor(greatest(length(x), length(y)) * {1 - similarity:.6f}D + 1e-9) as int)")
    both = pairs.join(x, "a").join(y, "b").withColumn("most", most).where("abs(length(x) - length(y)) <= most and la <> lb")
    return both.where(F.expr("levenshtein(x, y, most) >= 0")).select("la", "lb")


def repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.9,
    min_chars: int = 30,
    min_equal: int = 6,
    small: int = 32,
    part_lines: int = 2048,
    filter_bits: int = 1 << 26,
    broadcast_blocks: int = 100_000,
) -> DataFrame:
    """Which lines of every document go, so that one occurrence of each group of equal or nearly equal lines stays.

    A line is what stands between line ends; its normal form is its lower-case runs of letters and digits (a character
    of a script that sets no spaces is a run of its own) and needs `min_equal` bytes, single spaces between the words
    included, to be compared. Lines of equal normal form are one. Others, if they have `min_chars` bytes, are linked if
    the edit similarity of their words, 1 - distance / words of the longer one, is at least `similarity`. Of every
    connected group the occurrence with the smallest (id, text hash, line number) stays; nulls come first.

    Which lines can be similar: one of n words is at most n * (1 - similarity) / similarity = k edits from a partner,
    and an edit breaks as many runs of words as a run has words, w. Put in any order that is the same for all lines,
    of the first w * k + 1 runs of two similar lines at least one is the same, because else one of the two had
    w * k + 1 runs the other has not. The order here is by length, so that the blocks are made of rare words without
    a count of any. Three words make a run, or fewer where `similarity` is low. A line that is too short
    for one edit has no blocks.

    A task packs its blocks' members by bucket, so that a shuffled row holds thousands of them; of a block with more
    than `small` lines it sends the block's name only, so a block that a third of all lines share costs each task one
    entry. Where a bucket comes together, lines of a block of up to `small` lines become pairs. In larger blocks one
    line is compared with all lines of the block, and then all lines of the block that are not connected yet with
    each other: similarity is not transitive, so a settled line may still be the only link to others. A block of near
    copies thus takes one row a line, and only lines that are not connected are compared in pairs, dealt out in parts
    of about `part_lines` lines, each of which meets the block's lines once.
    Pairs are dropped at once whose numbers of words differ too much or whose sketches (parities of hashed words)
    differ in more bits than the allowed edits can change. Texts of lines are read again, from the
    documents, for those lines only that can be in a pair, which are told by the hash of the line as it stands before
    any of them is taken apart; words are compared as one character each. The names of large
    blocks are broadcast while there are at most `broadcast_blocks`, else joined by a shuffle; the numbers of lines
    that can be in a pair are thinned out by a bitmap of `filter_bits` bits before their join.

    Returns one row per row of `docs`: `id_col, text_hash, n_lines, removed` (array of line numbers from 0). Null text:
    no lines. Empty text: one empty line. Rows that agree in id and text count as one document and get equal rows.
    Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, run = Scratch(spark), _run_words(similarity)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = rows.where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    raws = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("raws")
    described = f"id {kind}, th long, pos int, line binary, lid long, raw long, blocks array<long>"
    lines = scratch.cut(texts.select("*", raws).mapInArrow(_describe(similarity, run, min_chars, min_equal), described))

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select("lid", "blocks").mapInArrow(_dealt(buckets, small), "bucket int, members binary, large binary")
    met = scratch.cut(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met(small, similarity), "h long, a long, b long"))
    pairs, big = met.where("a is not null").select("a", "b"), met.where("h is not null").select("h")
    known_size = big.limit(broadcast_blocks + 1).count()
    crowded = None
    if known_size:
        names = F.broadcast(big) if known_size <= broadcast_blocks else big
        held = scratch.cut(lines.select("lid", F.explode_outer("blocks").alias("h")).join(names, "h").distinct())
        centre = held.groupBy("h").agg(F.min("lid").alias("a"))
        star = held.withColumnRenamed("lid", "b").join(centre, "h").where("a <> b").where(_close("a", "b", similarity))
        pairs = pairs.union(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        crowded = held.select("lid")
    pairs = scratch.cut(pairs.distinct())
    need = pairs.select(F.explode(F.array("a", "b")).alias("lid"))
    need = scratch.cut((need if crowded is None else need.union(crowded)).distinct())
    scratch.drop(met)
    hashed = F.xxhash64("lid").alias("h")  # the low bits of the number itself are no hash
    among = in_bitmap(lines.select("lid", "raw", hashed), bitmap(need.select(hashed), filter_bits), filter_bits)
    some = in_bitmap(texts.select(F.explode(F.split("text", "\n")).alias("text")).select("text", F.xxhash64("text").alias("h")), bitmap(among.select(F.col("raw").alias("h")), filter_bits), filter_bits)
    some = some.select("text").mapInArrow(_coded, "lid long, line binary, words string, " + ", ".join(f"{k} long" for k in SKETCH)).select("*", hashed)
    some = in_bitmap(some, bitmap(need.select(hashed), filter_bits), filter_bits)
    coded = scratch.cut(some.drop("h").join(need, "lid").groupBy("lid", "line").agg(*(F.max(c).alias(c) for c in ("words", *SKETCH))))

    links = scratch.cut(_similar(pairs, coded, similarity))
    scratch.drop(pairs)
    known = components(scratch, links.selectExpr("la a", "lb b")).withColumnRenamed("node", "line")
    if crowded is not None:
        of = coded.select("lid", "line", *SKETCH).join(known, "line", "left").select("lid", *SKETCH, F.xxhash64(F.coalesce("root", "line")).alias("root"))
        apart = held.join(of, "lid")
        mixed = apart.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("last"), F.ceil(F.count("*") / F.lit(float(part_lines))).cast("int").alias("parts")).where("r <> last")
        apart = scratch.cut(apart.join(mixed.select("h", "parts"), "h"))
        part = F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int")
        x = apart.select("h", part.alias("part"), F.col("lid").alias("a"), F.col("root").alias("p"), *_sketch("a"))
        y = apart.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lid").alias("b"), F.col("root").alias("q"), *_sketch("b"))
        near = scratch.cut(x.join(y, ["h", "part"]).where("a < b and p <> q").where(_close("a", "b", similarity) & _alike("a", "b", similarity)).select("a", "b").distinct())
        if not near.isEmpty():
            more = scratch.cut(_similar(near, coded, similarity))
            if not more.isEmpty():
                known = components(scratch, links.union(more).selectExpr("la a", "lb b")).withColumnRenamed("node", "line")

    copies = lines.groupBy("line").agg(F.count("*").alias("copies"))
    several = copies.where("copies > 1").select("line").join(known, "line", "full").select("line", F.coalesce("root", "line").alias("root"))
    again = scratch.cut(lines.select("line", "id", "th", "pos").join(several, "line").drop("line"))
    scratch.keep_only(again)
    keep = again.groupBy("root").agg(F.min(F.struct("id", "th", "pos")).alias("keep"))
    gone = again.join(keep, "root").where(~F.struct("id", "th", "pos").eqNullSafe(F.col("keep")))
    removed = gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    r, g = rows.select("id", "th", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n"))).otherwise(0).alias("n_lines")).alias("r"), removed.alias("g")
    out = r.join(g, F.expr("r.id <=> g.id and r.th = g.th"), "left")
    return out.select(F.col("r.id").alias(id_col), F.col("r.th").alias("text_hash"), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with the text of what `repeated_lines` leaves. Rows that lose lines and keep only blank ones are
    dropped; rows that lose none stay as they are, whatever their lines. All columns are kept."""
    found = repeated_lines(docs, id_col=id_col, text_col=text_col, **options)
    lost = found.where("size(removed) > 0").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_th"), F.col("removed").alias("_removed")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_of"), F.col(text_col).alias("_text"))
    both = held.join(lost, F.col("_of").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_th")), "left")
    numbered = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.transform(F.filter(numbered, lambda s: ~F.array_contains("_removed", s["i"])), lambda s: s["x"])
    both = both.withColumn("_left", F.when(F.col("_removed").isNotNull(), left))
    worth = F.exists("_left", lambda x: x.rlike(r"\S"))
    both = both.where(F.col("_removed").isNull() | worth)
    text = F.coalesce(F.array_join("_left", "\n"), F.col("_text")).alias(text_col)
    return both.select(*(text if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def op6_line_dedup(spark, sf_dir) -> DataFrame:
    """Every line with a word in it counts, however short."""
    out = repeated_lines(table(spark, sf_dir, "documents"), min_chars=1, min_equal=1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.transform("removed", lambda x: x.cast("string"))).alias("removed"))
