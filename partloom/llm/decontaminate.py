"""Benchmark decontamination by spaced-seed hashing and substitution-tolerant verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from partloom.llm.common import small_batches, table
from partloom.llm.tokens import in_chunks, mix, words_of

U = np.uint64
# Fixed masks over nine tokens: 1 is hashed, 0 is ignored.
MASKS = ("110101101", "101110011", "111001011", "110011011")
SPAN = 9
WHOLE_RUN = 6  # equal tokens in a row that align a text and an item beside the masks: next to a replaced phrase
SHORTEST = 5


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every place where all of it fits into `words`."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, U(int(mask, 2) | len(mask) << 32))
    for k in (i for i, c in enumerate(mask) if c == "1"):
        h = h * U(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(h)


class SeedIndex:
    """Sorted seed hashes of the benchmark items with the places they come from, behind a bit table."""

    def __init__(self, items: list[tuple], bits: int = 22):
        self.ids = [i for i, _ in items]
        self.words, self.at = words_of([t for _, t in items])
        self.parts = []
        for mask in [*MASKS, *("1" * n for n in range(SHORTEST, SPAN))]:
            keys, item, place = [], [], []
            for i in range(len(items)):
                w = self.words[self.at[i] : self.at[i + 1]]
                if (len(w) >= SPAN and len(mask) in (SPAN, WHOLE_RUN)) or len(w) == len(mask) < SPAN:
                    h = seed_hashes(w, mask)
                    keys.append(h)
                    item.append(np.full(len(h), i, np.int64))
                    place.append(np.arange(len(h)))
            if keys:
                k = np.concatenate(keys)
                order = np.argsort(k, kind="stable")
                table = np.zeros(1 << bits, bool)
                table[(k >> U(64 - bits)).astype(np.int64)] = True
                self.parts.append((mask, k[order], np.concatenate(item)[order], np.concatenate(place)[order], table, U(64 - bits)))
        self.short: dict[bytes, list[int]] = {}
        for i, n in enumerate(np.diff(self.at)):
            if 0 < n < SHORTEST:
                self.short.setdefault(self.words[self.at[i] : self.at[i + 1]].tobytes(), []).append(i)

    def short_lines(self, texts: list[str]):
        """(text, item, first token, tokens) of lines that are, as a whole, an item of fewer than SHORTEST tokens."""
        if not self.short:
            return
        lines = [x for t in texts for x in t.split("\n")]
        of = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
        words, at = words_of(lines)
        begin = at[np.searchsorted(of, np.arange(len(texts)))]
        for k in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SHORTEST)).tolist():
            for i in self.short.get(words[at[k] : at[k + 1]].tobytes(), ()):
                yield int(of[k]), i, int(at[k] - begin[of[k]]), int(at[k + 1] - at[k])

    def hits(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed matches; diagonal: place in `words` minus place in the item."""
        out = []
        for mask, keys, item, place, bits, shift in self.parts:
            h = seed_hashes(words, mask)
            i = np.flatnonzero(bits[(h >> shift).astype(np.int64)])
            i = i[row[i] == row[i + len(mask) - 1]]
            a, b = np.searchsorted(keys, h[i], "left"), np.searchsorted(keys, h[i], "right")
            n = b - a
            if n.sum():
                j = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = np.repeat(i, n)
                out.append(np.stack([row[at], item[j], at - place[j]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def best_segment(same: np.ndarray, miss: int = 3) -> tuple[int, int]:
    """The run with the highest score, equal tokens counting 1 and others -miss; the earliest and shortest on ties."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -miss))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.flatnonzero(total[:end] == low[end - 1])[-1])
    return start, end


def longest_segment(same: np.ndarray, share: float) -> tuple[int, int]:
    """The longest run that starts and ends with equal tokens and has at least a `share` of them; the earliest on ties."""
    at = np.flatnonzero(same)
    total = np.concatenate([[0], np.cumsum(same - share)])
    low = np.minimum.accumulate(total[at])
    first = np.searchsorted(-low, -(total[at + 1] + 1e-9), "left")  # the earliest start that lies no higher than the end
    n = at + 1 - at[first]
    k = int(np.argmax(n))
    return int(at[first[k]]), int(at[k]) + 1


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = 10,
    min_share: float = 0.8,
    block_chars: int = 2_000_000,
) -> DataFrame:
    """The best overlap of every (document, benchmark item) that have one.

    Tokens are the lower-case runs of letters and digits. Four fixed masks over nine tokens ignore three of them each;
    a document and an item that agree under a mask, or in six tokens in a row, are aligned there and compared along the
    whole alignment. An overlap has at least `min_tokens` tokens, a `min_share` of them equal, and equal ones at both
    ends: the segment with the highest score (equal token +1, other -3) or, if that one is none, the longest. Substituted words are thus tolerated, inside and outside the seed. An item of
    fewer tokens than a mask, but at least five, must occur whole; a shorter one, which running text contains by
    chance, must be a whole line of the document.

    Benchmark rows are split into blocks of about `block_chars` characters by their hash. A block's index, whose size
    is thereby bounded, is broadcast and joined with all documents in one scan; a benchmark that needs several blocks
    costs as many scans. Nothing is shuffled, so a document or passage that occurs in a third of all rows is no hot
    key.

    Returns `id_col, item_col, n_tokens, n_equal, doc_token, item_token` (the last two: where the segment starts).
    Null and empty texts overlap with nothing; null ids are returned as such; equal benchmark rows count once; repeated
    documents repeat their rows; an empty table on either side gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, n_tokens int, n_equal int, doc_token int, item_token int"
    item_type = to_arrow_type(items.schema["item"].dataType)

    def scan(block: int) -> DataFrame:
        found = items.where(F.pmod(F.xxhash64(F.lit(4), "item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        index = spark.sparkContext.broadcast(SeedIndex([(r["item"], r["text"]) for r in found]))

        def overlaps(batches):
            ix = index.value
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                took, out, base = [], [], 0
                for chunk in in_chunks(texts):
                    words, at = words_of(chunk)
                    row = np.repeat(np.arange(len(chunk)), np.diff(at))
                    best: dict = {}
                    for t, i, d in ix.hits(words, row).tolist():
                        lo, hi = max(d, at[t]), min(d + ix.at[i + 1] - ix.at[i], at[t + 1])
                        same = words[lo:hi] == ix.words[ix.at[i] + lo - d : ix.at[i] + hi - d]
                        least = min(min_tokens, ix.at[i + 1] - ix.at[i])
                        a, b = best_segment(same)
                        if b - a < least or same[a:b].sum() < min_share * (b - a):
                            a, b = longest_segment(same, min_share)
                        n, eq = b - a, int(same[a:b].sum())
                        if n >= least:
                            new = (eq, -n, -int(lo + a - at[t]), -int(lo + a - d))
                            best[t, i] = max(best.get((t, i), new), new)
                    for t, i, p, n in ix.short_lines(chunk):
                        best[t, i] = max(best.get((t, i), (0,)), (n, -n, -p, 0))
                    for (t, i), (eq, n, p, q) in sorted(best.items()):
                        took.append(base + t)
                        out.append((ix.ids[i], -n, eq, -p, -q))
                    base += len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(took, pa.int64())), pa.array([o[0] for o in out], item_type), *(pa.array([int(o[k]) for o in out], pa.int32()) for k in range(1, 5))],
                    names=["id", "item", "n_tokens", "n_equal", "doc_token", "item_token"],
                )

        return rows.mapInArrow(overlaps, kinds)

    result = scan(0)
    for b in range(1, blocks):
        result = result.union(scan(b))
    return result.withColumnsRenamed({"id": id_col, "item": item_col})


def op4_decontaminate(spark, sf_dir) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
