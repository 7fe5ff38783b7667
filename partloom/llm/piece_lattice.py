"""SentencePiece encoding with N-best segmentation (forward Viterbi, backward A*) and decoding."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain, repeat
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import small_batches, table

SPACE = "▁"
UNIT = 10_000  # scores are whole ten-thousandths, so that equal sums are equal
NONE = 1 << 60
GROUP = 250  # texts whose new words are solved together
CELLS = 1 << 14  # characters of the atoms that are solved in one array
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = re.compile(r"\n| *[^ \n]+| +")


ONE, BASE = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def codes(strings: list[str], n: int) -> np.ndarray:
    """The characters of strings of length n as rows of numbers."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), n).astype(np.uint64)


class PieceModel:
    """Pieces, scores and byte pieces of a SentencePiece model.

    A unigram model's log probabilities are the scores. A BPE model stores merge ranks instead: they are read as ranks
    of frequency by Zipf's law, score = -log(rank + 2). The text's characters that no piece covers become byte pieces
    (or the unknown piece, where the model has no bytes), ten below the least score, as in the library.
    """

    def __init__(self, proto: bytes):
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        own = [m.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        ranked = all(own[i] == int(own[i]) for i in plain)
        self.score = [0] * n
        self.ids: dict[str, int] = {}  # pieces, and with -1 the beginnings of pieces
        for i in plain:
            self.score[i] = round((-log(min(-own[i], n) + 2) if ranked else own[i]) * UNIT)
            p = m.id_to_piece(i)
            self.ids[p] = i
            for k in range(1, len(p)):
                self.ids.setdefault(p[:k], -1)
        self.unknown = min(self.score[i] for i in plain) - 10 * UNIT
        pairs = {p[k : k + 2] for p in (m.id_to_piece(i) for i in plain) for k in range(len(p) - 1)}
        self.pair_keys = np.sort(np.array([ord(p[0]) << 21 | ord(p[1]) for p in pairs], np.uint64))
        self.pairs = pairs  # no piece spans two characters that are not a pair, so a lattice falls apart between them
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unk_id = m.unk_id()
        self.splits = not any(SPACE in m.id_to_piece(i).lstrip(SPACE) or "\n" in m.id_to_piece(i) for i in plain)
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        is_plain = set(plain)
        self.text = [byte_of.get(i) or (m.id_to_piece(i).replace(SPACE, " ").encode() if i in is_plain else b"") for i in range(n)]

        self.longest = max(map(len, self.ids))
        by: dict[int, list[str]] = {}
        for s in self.ids:
            by.setdefault(len(s), []).append(s)
        keys, ids = [], []
        for k, group in by.items():
            h = np.zeros(len(group), np.uint64)
            for column in codes(group, k).T:
                h = (h + column + ONE) * BASE
            keys.append(h)
            ids.append(np.array([self.ids[s] for s in group], np.int64))
        order = np.argsort(flat := np.concatenate(keys))
        self.keys, self.key_ids = flat[order], np.concatenate(ids)[order]
        self.scores = np.array(self.score, np.int64)

    def lattice(self, s: str) -> list[tuple[int, int, int, int]]:
        """Edges (from, to, score, id) in order of their start; id -1: the character as bytes. A SPACE in the lattice
        stands for a space; the character itself is marked by its caller as U+FFFF and has only its bytes."""
        get, score, n, out = self.ids.get, self.score, len(s), []
        for i in range(n):
            single, j = False, i + 1
            while j <= n:
                p = get(s[i:j])
                if p is None:
                    break
                if p >= 0:
                    out.append((i, j, score[p], p))
                    single = single or j == i + 1
                j += 1
            if not single:
                out.append((i, i + 1, self.unknown, -1))
        return out

    def spell(self, s: str, path) -> list[int]:
        out: list[int] = []
        for i, j, _, p in path:
            if p >= 0:
                out.append(p)
            elif self.bytes:
                out += [self.bytes[b] for b in (SPACE if s[i:j] == "￿" else s[i:j]).encode("utf-8", "replace")]
            else:
                out.append(self.unk_id)
        return out

    def decode(self, ids) -> str:
        """The text of the pieces, without the space that encoding puts before it."""
        raw = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def forward(edges, n: int) -> tuple[list, list]:
    """Best score of reaching each place, and the edge that reaches it."""
    best, via = [None] * (n + 1), [None] * (n + 1)
    best[0] = 0
    for e in edges:
        v = best[e[0]] + e[2]
        if best[e[1]] is None or v > best[e[1]]:
            best[e[1]], via[e[1]] = v, e
    return best, via


def best_and_gap(m: PieceModel, s: str) -> tuple[int, int, list]:
    """Score and edges of the best path, and by how much the second-best path is worse (NONE: there is one path).

    Every other path has an edge off the best one; forward plus backward scores give the best path through it. The
    edges are those of `PieceModel.lattice`; here they are made, and walked forward, in one loop, and hold the forward
    score of the path that they end instead of their own.
    """
    get, score, n = m.ids.get, m.score, len(s)
    f, via, edges = [-NONE] * (n + 1), [0] * (n + 1), []
    f[0] = 0
    for i in range(n):
        here, single = f[i], False
        for j in range(i + 1, n + 1):
            p = get(s[i:j])
            if p is None:
                break
            if p >= 0:
                if j == i + 1:
                    single = True
                v = here + score[p]
                if v > f[j]:
                    f[j], via[j] = v, len(edges)
                edges.append((i, j, v, p))
        if not single:
            v = here + m.unknown
            if v > f[i + 1]:
                f[i + 1], via[i + 1] = v, len(edges)
            edges.append((i, i + 1, v, -1))
    path, at, on = [], n, set()
    while at:
        on.add(via[at])
        path.append(edges[via[at]])
        at = path[-1][0]
    path.reverse()
    if len(edges) == len(path):
        return f[n], NONE, path
    back, second = [-NONE] * (n + 1), -NONE
    back[n] = 0
    for k in range(len(edges) - 1, -1, -1):
        i, j, v, _ = edges[k]
        v += back[j]
        if v > second and k not in on:
            second = v
        v -= f[i]
        if v > back[i]:
            back[i] = v
    return f[n], f[n] - second, path


def best_and_gap_of(m: PieceModel, strings: list[str]) -> list[tuple[int, int, bytes] | None]:
    """`best_and_gap`, with the ids spelled out, for many strings of one length at once: the same recurrences, each
    step over all strings. None for a string in which a character needs its bytes."""
    n, rows = len(strings[0]), len(strings)
    top = min(m.longest, n)
    chars, none = np.ascontiguousarray(codes(strings, n).T), np.int64(-NONE)  # a place's values of all strings side by side
    score, ids = [np.full((n, rows), none)], [np.full((n, rows), -1, np.int32)]
    cell, flat = np.arange(n * rows), chars.ravel()
    h = np.zeros(n * rows, np.uint64)
    for k in range(1, top + 1):  # places that begin a piece of k characters, among those that begin a longer one
        if not len(cell):
            top = k - 1  # no piece is longer
            break
        h = (h + flat[cell + (k - 1) * rows] + ONE) * BASE
        at = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
        ok = m.keys[at] == h
        cell, h, p = cell[ok], h[ok], m.key_ids[at[ok]]
        whole = p >= 0
        score.append(np.full((n, rows), none))
        ids.append(np.full((n, rows), -1, np.int32))
        score[k].ravel()[cell[whole]] = m.scores[p[whole]]
        ids[k].ravel()[cell[whole]] = p[whole]
        inside = cell < (n - k) * rows
        cell, h = cell[inside], h[inside]
    known = (ids[1] >= 0).all(axis=0)
    score[1][ids[1] < 0] = m.unknown
    f, via = np.full((n + 1, rows), none), np.zeros((n + 1, rows), np.int64)
    f[0] = 0
    for j in range(1, n + 1):
        for k in range(min(top, j), 0, -1):  # of equals the edge that starts first
            v = f[j - k] + score[k][j - k]
            np.copyto(via[j], k, where=v > f[j])
            np.maximum(f[j], v, out=f[j])
    b = np.full((n + 1, rows), none)
    b[n] = 0
    for i in range(n - 1, -1, -1):
        for k in range(1, min(top, n - i) + 1):
            np.maximum(b[i], score[k][i] + b[i + k], out=b[i])
    on = np.zeros((top + 1, n, rows), bool)
    every = np.stack(ids)
    path, row, at = np.full((rows, n), -1, np.int32), np.arange(rows), np.full(rows, n)
    for step in range(n - 1, -1, -1):
        k = via[at, row]
        at = at - k
        on[k, at, row] = True
        path[row, step] = every[k, at, row]
        more = at > 0
        row, at = row[more], at[more]
        if not len(row):
            break
    second = np.full(rows, none)
    for k in range(1, top + 1):
        w = score[k][: n - k + 1]
        through = f[: n - k + 1] + w + b[k:]
        through[on[k, : n - k + 1] | (w == none)] = none
        np.maximum(second, through.max(axis=0), out=second)
    used = path >= 0
    ends = np.cumsum(used.sum(axis=1)) * 4
    spelt = path[used].tobytes()
    gaps = np.where(second == none, NONE, f[n] - second)
    out = zip(f[n].tolist(), gaps.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), known.tolist())
    return [(s, g, spelt[x:y]) if ok else None for s, g, x, y, ok in out]


def n_best(edges, n: int, most: int) -> list[tuple[int, list]]:
    """The `most` best paths (score, edges), best first: A* from the end of the lattice to its start.

    A hypothesis is a path's tail; its priority is the tail's score plus the forward Viterbi score of the place where
    it starts, which is exactly the best score it can still have. So hypotheses reach the start in order of their
    scores, and the search stops with the last one asked for.
    """
    best, _ = forward(edges, n)
    into: list[list] = [[] for _ in range(n + 1)]
    for e in edges:
        into[e[1]].append(e)
    agenda, out, count = [(-best[n], 0, n, 0, None)], [], 0
    while agenda and len(out) < most:
        _, _, at, tail, rest = heapq.heappop(agenda)
        if at == 0:
            path = []
            while rest is not None:
                path.append(rest[0])
                rest = rest[1]
            out.append((tail, path))
            continue
        for e in into[at]:
            count += 1
            heapq.heappush(agenda, (-(tail + e[2] + best[e[0]]), count, e[0], tail + e[2], (e, rest)))
    return out


class Results:
    """Best segmentations by number: score, gap to the second best, and piece ids, in arrays that grow."""

    def __init__(self):
        self.n = self.used = 0
        self.score, self.gap, self.begin, self.size, self.uses = (np.zeros(1024, np.int64) for _ in range(5))
        self.flat = np.zeros(4096, np.int32)

    def add(self, score: np.ndarray, gap: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(score), self.used + len(ids)
        if n > len(self.score):
            self.score, self.gap, self.begin, self.size, self.uses = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.score, self.gap, self.begin, self.size, self.uses))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.int32)])
        self.score[self.n : n], self.gap[self.n : n], self.size[self.n : n] = score, gap, size
        self.begin[self.n : n] = self.used + np.cumsum(size) - size
        self.flat[self.used : used] = ids
        self.n, self.used = n, used

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the results `at`, one after the other, and where each begins."""
        size = self.size[at]
        begin = np.cumsum(size) - size
        return self.flat[np.repeat(self.begin[at] - begin, size) + np.arange(size.sum())], begin

    def count(self, at: np.ndarray) -> None:
        """Notes a use of each of the results `at`."""
        self.uses[: self.n] += np.bincount(at, minlength=self.n)

    def most_used(self, names: dict[str, int], most: int, places: int) -> tuple[dict[str, int], Results]:
        """The results that were used more than once, the most used first: `most` of them, with `places` ids in all."""
        uses = self.uses[: self.n]
        at = np.flatnonzero(uses > 1)
        at = at[np.argsort(-uses[at], kind="stable")][:most]
        at = np.sort(at[np.cumsum(self.size[at]) <= places])
        out, number = Results(), np.full(self.n, -1)
        number[at] = np.arange(len(at))
        out.add(self.score[at], self.gap[at], self.size[at], self.ids(at)[0])
        out.uses[: out.n] = uses[at] // 2
        new = number.tolist()
        return {name: new[k] for name, k in names.items() if new[k] >= 0}, out


class Encoder:
    """Encodes whole texts. Where no piece holds a space after another character, or a line end, the lattice of a text
    falls into one part per word; the words' results are kept in a table of at most about `cache` words. A word's
    lattice falls apart again between characters that no piece joins; its atoms have a table of their own. A full table
    keeps the entries that were used again, the most used first, up to half its size."""

    def __init__(self, model: PieceModel, most: int, cache: int = 400_000):
        self.m, self.most, self.cache = model, most, cache
        self.near: dict[str, list] = {}
        self.words, self.atoms = {}, {}
        self.of_words, self.of_atoms = Results(), Results()

    def _thin(self) -> None:
        most, places = self.cache // 2, 8 * self.cache
        self.words, self.of_words = self.of_words.most_used(self.words, most, places)
        self.atoms, self.of_atoms = self.of_atoms.most_used(self.atoms, most, places)

    def parts(self, text: str) -> list[str]:
        return SEGMENT.findall(" " + text) if self.m.splits else [" " + text]

    def prepare(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The texts' parts and their numbers in the table, after all new ones are solved together."""
        if len(self.words) > self.cache or self.of_words.used > 16 * self.cache:
            self._thin()
        split = [self.parts(t) for t in texts]
        flat = list(chain.from_iterable(split))
        at = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0)
        new = [flat[i] for i in missing.tolist()]
        self._solve(list(dict.fromkeys(new)))
        at[missing] = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
        self.of_words.count(at)
        return list(zip(split, np.split(at, np.cumsum([len(p) for p in split[:-1]]))))

    def _solve(self, new: list[str]) -> None:
        if not new:
            return
        s = "".join(new).replace(SPACE, "\uffff").replace(" ", SPACE)
        c = codes([s], len(s))[0]
        size = np.array([len(p) for p in new])
        ends = np.cumsum(size)
        pair = c[:-1] << np.uint64(21) | c[1:]
        at = np.minimum(np.searchsorted(self.m.pair_keys, pair), len(self.m.pair_keys) - 1)
        cuts = np.union1d(np.flatnonzero(self.m.pair_keys[at] != pair) + 1, ends)
        starts = np.concatenate([[0], cuts[:-1]])
        atoms = [s[a:b] for a, b in zip(starts.tolist(), cuts.tolist())]
        self._solve_atoms(list(set(atoms) - self.atoms.keys()))
        of = np.fromiter(map(self.atoms.__getitem__, atoms), np.int64, len(atoms))
        self.of_atoms.count(of)
        first, a = np.searchsorted(starts, ends - size), self.of_atoms
        self.words.update(zip(new, range(self.of_words.n, self.of_words.n + len(new))))
        self.of_words.add(np.add.reduceat(a.score[of], first), np.minimum.reduceat(a.gap[of], first), np.add.reduceat(a.size[of], first), a.ids(of)[0])

    def _solve_atoms(self, new: list[str]) -> None:
        """Atoms of up to 32 characters are solved length by length; longer ones, and those with bytes, one by one."""
        by: dict[int, list[str]] = {}
        for p in new:
            by.setdefault(len(p), []).append(p)
        for n, group in by.items():
            rows = max(1, CELLS // n)
            for a in range(0, len(group), rows):
                some = group[a : a + rows]
                found = best_and_gap_of(self.m, some) if n <= 32 else [None] * len(some)
                for i, f in enumerate(found):
                    if f is None:
                        score, gap, path = best_and_gap(self.m, some[i])
                        found[i] = (score, gap, np.array(self.m.spell(some[i], path), np.int32).tobytes())
                score, gap, ids = zip(*found)
                self.atoms.update(zip(some, range(self.of_atoms.n, self.of_atoms.n + len(some))))
                self.of_atoms.add(np.array(score), np.array(gap), np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), np.int32))

    def _paths(self, part: str) -> list[tuple[int, bytes]]:
        """How much worse than its best, and ids, of the part's best paths."""
        found = self.near.get(part)
        if found is None:
            s = part.replace(SPACE, "\uffff").replace(" ", SPACE)
            paths = n_best(self.m.lattice(s), len(s), self.most)
            found = [(paths[0][0] - v, np.array(self.m.spell(s, p), np.int32).tobytes()) for v, p in paths]
            if len(part) <= 64:
                if len(self.near) >= 20_000:
                    self.near.clear()
                self.near[part] = found
        return found

    def encode(self, text: str, prepared: tuple[list[str], np.ndarray] | None = None) -> list[tuple[int, bytes]]:
        """The `most` best segmentations of the whole text, best first: (score, piece ids as int32 bytes).

        A segmentation that is not the best differs from it in some words. With the words ordered by the gap between
        their two best paths, ties by place, only the first most - 1 can differ in the `most` best: a text that
        changes another word is no better than as many texts that change one of these. A* gives these words' paths.
        """
        parts, at = prepared or self.prepare([text])[0]
        known = self.of_words
        score, (ids, begin) = int(known.score[at].sum()), known.ids(at)
        best = ids.tobytes()
        out = [(score, best)]
        if self.most > 1:
            gap = known.gap[at]
            bar = np.partition(gap, self.most - 2)[self.most - 2] if len(gap) >= self.most else NONE - 1
            able = np.flatnonzero(gap <= min(bar, NONE - 1))
            near = able[np.argsort(gap[able], kind="stable")][: self.most - 1].tolist()
            sums: list[tuple[int, tuple]] = [(0, ())]
            for w in near:
                paths = self._paths(parts[w])
                sums = heapq.nsmallest(self.most, [(d + v, (*c, (w, k))) if k else (d, c) for d, c in sums for k, (v, _) in enumerate(paths)])
            for d, changes in sums[1:]:
                pieces, last = [], 0
                for w, k in sorted(changes):
                    pieces += [best[last : 4 * int(begin[w])], self._paths(parts[w])[k][1]]
                    last = 4 * int(begin[w] + known.size[at[w]])
                out.append((score - d, b"".join([*pieces, best[last:]])))
        return out


@lru_cache(maxsize=1)
def encoder_of(proto: bytes, most: int) -> Encoder:
    """The encoder of a Python worker, with what it has solved for its earlier tasks."""
    return Encoder(PieceModel(proto), most)


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 4, model_path: str = MODEL, digests: bool = False) -> DataFrame:
    """Per row `id_col` and the `most` best segmentations of the whole text, best first; the best is decoded again as a check.

    `scores array<double>`, `pieces array<array<int>>` and `decoded boolean`: whether decoding the best one gives the
    text back. With `digests`, `n_pieces array<int>` and `xxh64 array<long>` (of the ids as little-endian int32)
    stand for the ids. Spaces are pieces, a space is put before the text, nothing else is normalised; the character
    U+2581 of a text is kept apart from the space by its bytes, so every text survives the round trip.

    A null text has null results; the empty text is one space. Fewer segmentations are returned where there are fewer.
    Ties keep the order of the search, which depends on the text and model alone. The model file is read by the driver
    and broadcast; its size is that of the vocabulary. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = encoder_of(proto.value, most)
        m = encoder.m
        for batch in batches:
            scores, ids, ok = [], [], []
            for k, text in enumerate(texts := batch.column("text").to_pylist()):
                if k % GROUP == 0:
                    split = encoder.prepare([x or "" for x in texts[k : k + GROUP]])
                if text is None:
                    scores.append(None), ids.append(None), ok.append(None)
                    continue
                found = encoder.encode(text, split[k % GROUP])
                arrays = [np.frombuffer(x, np.int32) for _, x in found]
                scores.append([s / UNIT for s, _ in found])
                ok.append(m.decode(arrays[0].tolist()) == text)
                ids.append([(len(a), xxhash.xxh64_intdigest(x) - (1 << 63)) for a, (_, x) in zip(arrays, found)] if digests else arrays)
            own = [pa.array(scores, pa.list_(pa.float64())), pa.array(ok)]
            if digests:
                more = [pa.array([x and [y[k] for y in x] for x in ids], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *own, *more], names=["id", "scores", "decoded", "n_pieces", "xxh64"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *own, pa.array(ids, pa.list_(pa.list_(pa.int32())))], names=["id", "scores", "decoded", "pieces"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = "n_pieces array<int>, xxh64 array<long>" if digests else "pieces array<array<int>>"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, scores array<double>, decoded boolean, {kind}").withColumnRenamed("id", id_col)


def op1_sentencepiece(spark, sf_dir) -> DataFrame:
    """The segmentations themselves, with the length and a hash of each derived from them."""
    most = 4
    out = encode_texts(table(spark, sf_dir, "documents"), most=most)
    hashes = F.array(*(F.xxhash64(F.get("pieces", F.lit(k))) for k in range(most)))  # a lambda would hash number by number, not in generated code
    hashes = F.when(F.col("pieces").isNotNull(), F.slice(hashes, F.lit(1), F.size("pieces")))
    return out.withColumn("n_pieces", F.transform("pieces", F.size)).withColumn("xxh64", hashes)
