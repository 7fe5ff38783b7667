"""Phrase collocations by hierarchical pair naming: a phrase of k words is a pair of overlapping phrases of k - 1."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from partloom.llm.common import Scratch, bitmap, in_bitmap, small_batches, table, whole_groups

ENDS = b".,;:!?\x0a\x0b\x0c\x0d"  # between pieces, which no phrase crosses
BLANKS = b"\x20\x09"  # between the words of a piece
BITS = 1 << 26
PLACES = 1 << 21  # of a sequence for each bucket
PACK = zstandard.ZstdCompressor(level=1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END, WORD = np.zeros(256, np.int32), np.ones(256, bool)
END[list(ENDS)] = 1
WORD[list(ENDS + BLANKS)] = False


def words_of(texts: pa.Array):
    """Words of the texts in order: (their UTF-8 bytes as an Arrow array, each one's text, and whether the next word
    follows it within its piece)."""
    raw = texts.cast(pa.large_binary())
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = LOWER[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    first = first[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    piece = np.cumsum(END[data] + first, dtype=np.int64)[starts]
    letters = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    near = np.zeros(len(starts), np.uint8)
    near[:-1] = piece[1:] == piece[:-1]
    return words, np.searchsorted(bounds, starts, side="right") - 1, near


def coded(keys):
    """(code of each key, the distinct keys, how often each comes); codes follow the first occurrence."""
    d = (keys if isinstance(keys, pa.Array) else pa.array(keys)).dictionary_encode()
    codes = d.indices.to_numpy()
    return codes.astype(np.int32), d.dictionary, np.bincount(codes, minlength=len(d.dictionary))


def packed(*arrays) -> bytes:
    """Arrays of one length as one compressed value; sorted ones take a byte or two a number."""
    return PACK.compress(b"".join(np.diff(x, prepend=x.dtype.type(0)).tobytes() for x in arrays))


def unpacked(value: bytes, *kinds):
    raw = zstandard.ZstdDecompressor().decompress(value)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.cumsum(np.frombuffer(raw, k, n, at), dtype=k))
        at += out[-1].nbytes
    return out


def sequence_row(chunk: int, codes, near, others: dict) -> pa.RecordBatch:
    """A chunk's sequence of numbers, and nulls in the columns of its names."""
    own = [pa.array([chunk]), pa.array([PACK.compress(codes.astype(np.int32).tobytes())], pa.binary()), pa.array([PACK.compress(np.packbits(near).tobytes())], pa.binary()), pa.array([len(codes)], pa.int64())]
    return pa.RecordBatch.from_arrays([*own, *(pa.nulls(1, k) for k in others.values())], names=["chunk", "codes", "near", "length", *others])


def sequence_of(codes: bytes, near: bytes, length: int):
    open_ = zstandard.ZstdDecompressor()
    return np.frombuffer(open_.decompress(codes), np.int32), np.unpackbits(np.frombuffer(open_.decompress(near), np.uint8), count=length)


def name_rows(chunk: int, names: dict) -> pa.RecordBatch:
    """Rows of a chunk's names, and nulls in the columns of its sequence."""
    n = len(next(iter(names.values())))
    none = [pa.array(np.full(n, chunk, np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays([*none, *names.values()], names=["chunk", "codes", "near", "length", *names])


def split_words(batches, chunk_bytes: int):
    """Chunks of whole texts, of `chunk_bytes` or little more: their words, numbered within the chunk."""
    held, size, n = [], 0, 0

    def chunk():
        texts, langs = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
        words, text, near = words_of(texts)
        codes, vocabulary, _ = coded(words)
        lang, langs, _ = coded(langs)
        codes, both, c = coded(codes.astype(np.int64) * max(1, len(langs)) + lang[text])
        both = both.to_numpy()
        spelt = vocabulary.take(pa.array(both // max(1, len(langs)))).cast(pa.string())
        names = {"j": pa.array(np.arange(len(c), dtype=np.int32)), "lang": langs.take(pa.array(both % max(1, len(langs)))), "word": spelt, "c": pa.array(c.astype(np.int64))}
        number = (TaskContext.get().partitionId() << 32) + n
        yield name_rows(number, names)
        yield sequence_row(number, codes, near, {k: v.type for k, v in names.items()})

    for b in batches:
        held.append((b.column("text").cast(pa.large_string()), b.column("lang").cast(pa.string())))
        size += b.column("text").nbytes
        if size >= chunk_bytes:
            yield from chunk()
            held, size, n = [], 0, n + 1
    if held:
        yield from chunk()


def found_ids(found):
    """(numbers, ids) of a chunk's names, from rows of them or from packed ones."""
    if pa.types.is_struct(found.type):
        return found.field("j").to_numpy(), found.field("id").to_numpy()
    both = [unpacked(v.as_py(), np.int32, np.int64) for v in found]
    return np.concatenate([j for j, _ in both]), np.concatenate([i for _, i in both])


def bucket_of(left, right, buckets: int):
    h = (left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)


PAIRS = {"bucket": pa.int32(), "first": pa.int32(), "pairs": pa.binary()}


def pair_names(batches, buckets: int, last: bool):
    """Chunks whose numbers got global ids (`found`; the others go): the pairs of ids that stand side by side there, counted,
    numbered by (bucket, left, right) and packed by bucket, and the sequence of their numbers (not at the `last` level)."""
    for b in batches:
        for i in range(b.num_rows):
            j, ids = found_ids(b.column("found")[i].values)
            chunk, *blobs = (b.column(k)[i].as_py() for k in ("chunk", "codes", "near", "length"))
            codes, near = sequence_of(*blobs)
            local = np.full(int(codes.max(initial=-1)) + 1, -1, np.int64)
            local[j] = np.arange(len(ids))
            at = np.flatnonzero(local[codes] >= 0)
            here = local[codes[at]]
            pairs = np.flatnonzero((near[at[:-1]] > 0) & (np.diff(at) == 1))
            codes, distinct, c = coded(here[pairs] * len(ids) + here[pairs + 1])
            distinct = distinct.to_numpy()
            left, right = ids[distinct // len(ids)], ids[distinct % len(ids)]
            to = bucket_of(left, right, buckets)
            order = np.lexsort((right, left, to))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            left, right, c, to = left[order], right[order], c[order].astype(np.int64), to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=np.uint64(buckets)))
            blobs = [packed(left[x:y], right[x:y], c[x:y]) for x, y in zip(cuts, [*cuts[1:], len(to)])]
            yield name_rows(chunk, {"bucket": pa.array(to[cuts].astype(np.int32)), "first": pa.array(cuts.astype(np.int32)), "pairs": pa.array(blobs, pa.binary())})
            if not last:
                follows = np.zeros(len(pairs), np.uint8)
                follows[:-1] = np.diff(pairs) == 1
                yield sequence_row(chunk, place[codes], follows, PAIRS)


def named_pairs(batches, least: int):
    """Of sorted buckets: each pair that comes `least` times over all chunks with its count and its id, and for every chunk
    the ids of those of its pairs, packed."""
    nothing = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
    columns = ["chunk", "found", "l", "r", "a", "id"]
    for t, bounds in whole_groups(batches, "bucket", 1):
        chunks, firsts, blobs, keys = (t.column(k).to_pylist() for k in ("chunk", "first", "pairs", "bucket"))
        for x, y in zip(bounds[:-1], bounds[1:]):
            parts = [unpacked(v, np.int64, np.int64, np.int64) for v in blobs[x:y]]
            left, right, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((right, left))
            new = np.flatnonzero(np.append(True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)))
            total = np.add.reduceat(c[order], new)
            often = np.flatnonzero(total >= least)
            if not len(often):
                continue
            id_of = np.full(len(new), -1, np.int64)
            id_of[often] = (keys[x] << 32) + np.arange(len(often))
            own = np.empty(len(order), np.int64)
            own[order] = np.repeat(id_of, np.diff(np.append(new, len(order))))
            at = order[new[often]]
            yield pa.RecordBatch.from_arrays([*nothing(len(at), pa.int64(), pa.binary()), *map(pa.array, (left[at], right[at], total[often], id_of[often]))], names=columns)
            blob, of, run = [], [], 0
            for k, p in enumerate(parts):
                ids = own[run : run + len(p[0])]
                run += len(ids)
                some = np.flatnonzero(ids >= 0)
                if len(some):
                    of.append(chunks[x + k])
                    blob.append(packed((some + firsts[x + k]).astype(np.int32), ids[some]))
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(blob, pa.binary()), *nothing(len(of), *[pa.int64()] * 4)], names=columns)


def phrases(docs: DataFrame, scratch: Scratch, *, text_col: str = "text", lang_col: str | None = "lang", least: int = 100, longest: int = 5, chunk_bytes: int = 1 << 23) -> list[DataFrame]:
    """Frequent words and phrases, a table for each length: `id, lang, phrase, last, a, n, pre, suf` and, from two words
    on, `l, r`, the ids of the parents: its first and its last k - 1 words. `a` counts its occurrences in the language,
    `n` all words of the language; `pre[i]` and `suf[i]` count its first and its last i + 1 words. Ids are those of a length.

    Texts become chunks of word numbers once, a written table. Each level then sends the distinct pairs of every chunk,
    packed by a hash of the pair, to where the same pairs of all chunks meet; those that come `least` times there get an
    id, and the ids go back to the chunks that asked. So a pair is named by the ids of its halves, and every level is the
    same join of numbers, whatever the length of the phrase. What is sent stands for all occurrences in a chunk, so
    the commonest pair sends one entry a chunk; the buckets grow in number with the text, about two million places each.
    """
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")) if lang_col else F.lit("und")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    head = "chunk long, codes binary, near binary, length long"
    chunks = scratch.cut(rows.mapInArrow(partial(split_words, chunk_bytes=chunk_bytes), f"{head}, j int, lang string, word string, c long"))

    key = ["lang", "word"]
    words = chunks.where("j is not null")
    total = words.groupBy("lang").agg(F.sum("c").alias("n"))
    counts = words.groupBy(*key).agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    level = counts.join(total, "lang").select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", "n", F.array("a").alias("pre"), F.array("a").alias("suf"), F.col("word"))
    out = [scratch.cut(level)]
    ids = out[0].select("id", *key)
    hashed = F.xxhash64(*key).alias("h")
    asked = in_bitmap(words.select("chunk", "j", *key, hashed), bitmap(ids.select(hashed), BITS), BITS)  # rows of rare words stay away from the join
    found = asked.join(ids, key).groupBy("chunk").agg(F.collect_list(F.struct("j", "id")).alias("found"))
    for k in range(2, longest + 1):
        size = chunks.agg(F.sum("length")).first()[0] or 0
        sequences = chunks.where("codes is not null").select("chunk", "codes", "near", "length")
        pairs = partial(pair_names, buckets=max(1, -(-size // PLACES)), last=k == longest)
        nxt = scratch.cut(sequences.join(found, "chunk").mapInArrow(pairs, f"{head}, bucket int, first int, pairs binary"))
        scratch.drop(chunks)
        chunks = nxt
        met = chunks.where("bucket is not null").select("chunk", "bucket", "first", "pairs").repartition("bucket").sortWithinPartitions("bucket")
        named = scratch.cut(met.mapInArrow(partial(named_pairs, least=least), "chunk long, found binary, l long, r long, a long, id long"))
        found = named.where("chunk is not null").groupBy("chunk").agg(F.collect_list("found").alias("found"))
        left = out[-1].select(F.col("id").alias("l"), "lang", "phrase", "n", "pre")
        right = out[-1].select(F.col("id").alias("r"), "last", "suf")
        both = named.where("id is not null").select("id", "l", "r", "a").join(left, "l").join(right, "r")
        longer = both.select(
            "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", "n",
            F.array_append("pre", F.col("a")).alias("pre"), F.array_append("suf", F.col("a")).alias("suf"), "l", "r",
        )
        out.append(scratch.cut(longer))
        if k > 2:
            scratch.drop(before)
        before = named
    scratch.drop(before)
    scratch.drop(chunks)
    return out


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str | None = "lang", least: int = 100, longest: int = 5, top: int = 2000, chunk_bytes: int = 1 << 23) -> DataFrame:
    """The `top` phrases of each language: `lang, rank, phrase, a, l, r, n, score`.

    Letters A-Z are lower-cased, other letters stay; pieces end at `.,;:!?` and line ends, words at spaces and tabs.
    Candidates have 2 to `longest` words and come `least` times or more in the language, overlaps included. Of the cuts
    into a first and a last part with counts l and r the one with the least floor(1000 a n / (l r)) counts, ties to the
    shorter first part; these counts are those of a phrase's ancestors by the parent ids. Arithmetic is exact (decimals
    of 38 digits). A candidate goes if a longer one that holds it comes as often; one word more is enough to look at, as
    counts between the two lie between theirs, and that phrase names it as a parent. Ranked by score and a, both
    descending, then by the phrase's bytes.

    A null text is empty, a null language is `und`; repeated rows count as often as they come; rows without words and
    empty tables give nothing. Ids and other columns are not read. A word may be as long as its text.
    """
    scratch = Scratch(docs.sparkSession)
    levels = phrases(docs, scratch, text_col=text_col, lang_col=lang_col, least=least, longest=longest, chunk_bytes=chunk_bytes)
    big = lambda x: f"cast({x} as decimal(19, 0))"
    parts = []
    for k in range(2, longest + 1):
        rows = levels[k - 1]
        if k < longest:
            held = levels[k].select(F.col("l").alias("id"), "a").union(levels[k].select(F.col("r").alias("id"), "a"))
            rows = rows.join(held.distinct(), ["id", "a"], "left_anti")
        cuts = [f"struct((1000 * {big('a')} * {big('n')}) div ({big(f'pre[{j - 1}]')} * {big(f'suf[{k - j - 1}]')}) as score, {j} as k, pre[{j - 1}] as l, suf[{k - j - 1}] as r)" for j in range(1, k)]
        parts.append(rows.select("lang", "phrase", "a", "n", F.expr(f"array_min(array({', '.join(cuts)}))").alias("cut")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = every.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: its parts are thinned out first
    some = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with texts as (
  select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from texts),
numbered as (select lang, row_number() over () piece, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
words as (select lang, piece, unnest(w) w1, unnest(range(1, len(w) + 1)) i from numbered),
leads as (
  select lang, w1, lead(w1, 1) over o w2, lead(w1, 2) over o w3, lead(w1, 3) over o w4, lead(w1, 4) over o w5
  from words window o as (partition by piece order by i)),
grams as (
  select lang, 1 k, w1 phrase from leads
  union all select lang, 2, w1 || ' ' || w2 from leads where w2 is not null
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from leads where w3 is not null
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 from leads where w4 is not null
  union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from leads where w5 is not null),
f as (select lang, k, phrase, count(*)::bigint a from grams group by all),
n as (select lang, sum(a)::bigint n from f where k = 1 group by all),
candidates as (select lang, k, phrase, a, n, string_split(phrase, ' ') w from f join n using (lang) where k >= 2 and a >= 100),
cuts as (
  select c.*, j, x.a l, y.a r, (1000::hugeint * c.a * n) // (x.a::hugeint * y.a) score
  from candidates c join range(1, 5) s(j) on j < c.k
  join f x on x.lang = c.lang and x.k = j and x.phrase = array_to_string(w[1:j], ' ')
  join f y on y.lang = c.lang and y.k = c.k - j and y.phrase = array_to_string(w[j + 1:], ' ')),
least as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
kept as (
  select * from least c where not exists (
    select 1 from candidates d where d.lang = c.lang and d.k > c.k and d.a >= c.a and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score::bigint score
from kept qualify "rank" <= 2000
"""
