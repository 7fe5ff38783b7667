"""The corpus operators against brute force, exact round trips and held-out labels, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partloom.llm import (
    common, decontaminate, jaccard_join, language_id, license_scan, line_dedup, nearest, piece_lattice, quality, queries, sharding, suffix_dedup, tokens,
)

CLASH = ["id", "key", "tkey", "size", "leaf", "score", "lang_pred", "shard", "slot", "part", "digest", "norm", "line", "sim", "v", "_removed", "_key", "root", "removed"]


def prose(seed, words=120):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "on", "an", "ea", "st") for b in ("ti", "nd", "ou", "re") for c in ("", "ly", "ing", "ble")]
    return " ".join(r.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="module")
def nasty(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "\n".join(prose(i, 60) for i in range(400)) + " " + "x" * 100_000
    rows = [
        (1, None, "en"), (2, "", "en"), (3, long, "en"), (4, prose(1), None), (4, prose(1), None), (5, prose(1), "en"), (None, prose(2), "fr"), (None, None, None),
        (6, "!!! ???", "en"), (7, "é ü ▁ 𐍈 \u0000 \t\n\n", "fr"), (8, "one", "en"), (9, prose(2) + " more", "fr"), (10, long, "en"),
    ]
    df = spark.createDataFrame([(i, t, g, None, None) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"clash-{c}").alias(c) for c in CLASH)).repartition(3)


def empty(df):
    return df.limit(0)


# --- 1 ---


def brute_paths(m, text):
    s = (" " + text).replace(piece_lattice.SPACE, "￿").replace(" ", piece_lattice.SPACE)
    by = collections.defaultdict(list)
    for e in m.lattice(s):
        by[e[0]].append(e)
    out = []

    def go(at, score):
        if at == len(s):
            out.append(score)
        for e in by[at] if at < len(s) else ():
            go(e[1], score + e[2])

    go(0, 0)
    return sorted(out, reverse=True)


@pytest.fixture(scope="module")
def pieces():
    with open(piece_lattice.MODEL, "rb") as f:
        return f.read()


def test_n_best_equals_all_paths(pieces):
    m = piece_lattice.PieceModel(pieces)
    for most in (1, 2, 5):
        e = piece_lattice.Encoder(m, most, cache=3)
        for text in ("", "a", "the cat", "no on", "é 𐍈", "a▁b", "  x", "a\nb", "on, on."):
            got = e.encode(text)
            assert [s for s, _ in got] == brute_paths(m, text)[:most]
            assert len({x for _, x in got}) == len(got)
            for s, x in got:
                ids = np.frombuffer(x, np.int32).tolist()
                assert m.decode(ids) == text


def test_atoms_are_solved_in_small_arrays(pieces, monkeypatch):
    import tracemalloc

    m, rng = piece_lattice.PieceModel(pieces), random.Random(3)
    texts = [" ".join("".join(rng.choices("aeinorst", k=31)) for _ in range(20)) for _ in range(150)]
    e = piece_lattice.Encoder(m, 4)
    tracemalloc.start()
    split = e.prepare(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
    found = [e.encode(t, s) for t, s in zip(texts, split)]
    monkeypatch.setattr(piece_lattice, "CELLS", 40)
    few = piece_lattice.Encoder(m, 4)
    assert [few.encode(t) for t in texts] == found


def test_n_best_equals_library(pieces):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, proto = piece_lattice.PieceModel(pieces), pb.ModelProto()
    proto.ParseFromString(pieces)
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = m.score[i] / piece_lattice.UNIT
    lib, e = sp.SentencePieceProcessor(model_proto=proto.SerializeToString()), piece_lattice.Encoder(m, 4)
    for text in ("Thing of the onesen erblest", "le ouè eauenaux", "worthless erreingor###"):
        assert [s for s, _ in e.encode(text)] == [sum(m.score[i] for i in ids) for ids in lib.nbest_encode_as_ids(text, 4)]


def test_encode_edges(nasty):
    got = piece_lattice.encode_texts(nasty, digests=True).collect()
    assert len(got) == nasty.count()
    assert all(r["decoded"] for r in got if r["scores"] is not None) and sum(r["scores"] is None for r in got) == 2
    assert all(a >= b for r in got for a, b in zip(r["scores"] or [], (r["scores"] or [])[1:]))
    assert piece_lattice.encode_texts(empty(nasty)).count() == 0


def test_query_returns_the_pieces(spark, nasty, tmp_path):
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    got = piece_lattice.op1_sentencepiece(spark, str(tmp_path)).collect()
    known = piece_lattice.encode_texts(nasty).collect()
    assert sorted(str((r["doc_id"], r["pieces"])) for r in got) == sorted(str((r["doc_id"], r["pieces"])) for r in known)
    for r in got:
        assert r["n_pieces"] == (r["pieces"] and [len(p) for p in r["pieces"]])
        assert r["xxh64"] is None or len(set(r["xxh64"])) == len({tuple(p) for p in r["pieces"]})


def test_a_full_table_keeps_what_is_used_again():
    with open(piece_lattice.MODEL, "rb") as f:
        proto = f.read()
    e = piece_lattice.encoder_of(proto, 3)
    assert piece_lattice.encoder_of(proto, 3) is e  # a worker's later tasks find what earlier ones solved
    e = piece_lattice.Encoder(e.m, 3, cache=40)
    texts = [f"again and again comes w{k}x{k * 7919 % 1009} über {chr(0x4E00 + k)}" for k in range(300)]
    found = [e.encode(t, p) for k in range(0, 300, 20) for t, p in zip(texts[k : k + 20], e.prepare(texts[k : k + 20]))]
    e._thin()
    assert " again" in e.words and " comes" in e.words and len(e.words) <= 20 and e.of_words.n == len(e.words)
    assert found == [piece_lattice.Encoder(e.m, 3).encode(t) for t in texts]
    assert e.encode(texts[7]) == found[7]


# --- 2 ---


@pytest.mark.parametrize("n,letters", [(0, 1), (1, 3), (50, 2), (3000, 3), (2000, 1)])
def test_suffix_array(n, letters):
    t = np.random.default_rng(n).integers(1, 1 + letters, n).astype(np.uint8)
    raw, order = t.tobytes(), suffix_dedup.suffix_array(t, 400)
    assert sorted(order.tolist()) == list(range(n))
    keys = [raw[i : i + 400] for i in order]
    assert keys == sorted(keys)
    lcp = suffix_dedup.adjacent_prefixes(t, order, 400)
    for x, y, k in zip(keys, keys[1:], lcp):
        same = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert k == same or same == min(len(x), len(y))


def brute_repeats(texts, n):
    raw, count = [(t or "").encode() for t in texts], collections.Counter()
    for b in raw:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("task_slices,segment", [(4096, 1 << 23), (1, 1 << 23), (4096, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, task_slices, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    r, base = random.Random(5), prose(0, 400)
    texts = [prose(i, 90) for i in range(10)] + [base, base, None, "", "short", "ab" * 600, "z" * 900]
    for i in range(12):  # near copies and shared passages, byte-shifted
        w = base.split()
        w[r.randrange(len(w))] = f"edit{i}"
        texts.append(prose(100 + i, 20) + " ".join(w)[r.randrange(300) :])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], len(x["spans"]), x["kept_sha256"]) for x in suffix_dedup.remove_repeats(df, task_slices=task_slices, sort_bytes=3000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 400)


def test_repeats_edges(nasty):
    got = suffix_dedup.remove_repeats(nasty).collect()
    want = collections.Counter(zip([r["doc_id"] for r in nasty.collect()], brute_repeats([r["text"] for r in nasty.collect()], 400)))
    assert collections.Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"])) for r in got) == want
    assert suffix_dedup.remove_repeats(empty(nasty)).count() == 0


# --- 3 ---


def brute_classes(rows):
    sets = [set(s.tolist()) for s in jaccard_join.sets_of([t or "" for _, t in rows], 5)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [(rows[find(i)][0], links[i]) for i in range(len(rows))]


@pytest.mark.parametrize("leaf_sets,max_depth", [(400, 6), (3, 3)])
def test_classes_equal_brute_force(spark, leaf_sets, max_depth):
    r, rows = random.Random(7), []
    for c in range(12):
        w = prose(c, 200).split()
        for k in range(1 + c):
            v = list(w)
            for _ in range(r.randrange(5)):
                v[r.randrange(len(v))] = f"w{r.randrange(9)}"
            rows.append((len(rows), " ".join(v)))
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999, leaf_sets=leaf_sets, max_depth=max_depth).collect()}
    assert [got[i] for i, _ in rows] == brute_classes(rows)


def test_runs_reach_the_recall_at_any_depth(spark, monkeypatch):
    """Drawn splits of a pair at the threshold; and the join asks for the runs of its deepest level."""
    rng = np.random.default_rng(4)
    for depth in (2, 4, 6):
        nodes = np.ones(40_000, np.int64)
        for _ in range(depth):
            nodes = rng.binomial(nodes + rng.binomial(nodes, 0.25), 0.8)
        missed = (nodes == 0).mean()
        assert missed ** jaccard_join.runs_for(0.999, 0.8, depth) <= 0.0012
    asked, plain = [], jaccard_join.runs_for
    monkeypatch.setattr(jaccard_join, "runs_for", lambda *a: asked.append(plain(*a)) or asked[-1])
    jaccard_join.similar_classes(spark.createDataFrame([(1, prose(1)), (2, prose(1))], "doc_id long, text string"))
    assert asked == [plain(0.999, 0.8, 6)]


def test_classes_edges(nasty):
    got = jaccard_join.similar_classes(nasty).collect()
    assert len(got) == nasty.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert by[1] == {(1, 0)} and by[2] == {(2, 0)} and by[4] == {(4, 2)} and by[5] == {(4, 2)} and by[10] == {(3, 1)} and by[9] == {(9, 1)}
    assert jaccard_join.similar_classes(empty(nasty)).count() == 0
    left = jaccard_join.one_of_each(nasty)
    assert left.columns == nasty.columns and sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201)]
    got = {r["node"]: r["root"] for r in common.components(common.Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200}
    assert common.components(common.Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_are_not_split_on(spark, monkeypatch):
    levels, cut = [], common.Scratch.cut

    def watched(self, df):
        out = cut(self, df)
        if "node" in df.columns and "n" in df.columns:
            levels.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "cut", watched)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard_join.similar_classes(docs, leaf_sets=20).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 199)}
    assert len(levels) <= 4 and sum(levels[1:]) < 1.5 * levels[0]


# --- 4 ---


def test_overlaps(spark, nasty):
    item = prose(50, 40)
    w = item.split()
    for k in (5, 14, 22, 33):
        w[k] = "swapped"
    docs = spark.createDataFrame([(1, prose(1) + " " + item.upper() + "! " + prose(2)), (2, prose(3) + " " + " ".join(w)), (3, prose(4)), (4, " ".join(item.split()[:9]) + " " + prose(5)), (5, "alpha beta gamma delta epsilon zeta"), (6, None), (1, prose(1) + " " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, prose(51, 30)), (12, "beta gamma delta epsilon zeta"), (13, "one two"), (14, None), (10, item)], "item_id long, text string")
    for block in (2_000_000, 50):
        got = decontaminate.find_overlaps(docs, bench, block_chars=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 10), (1, 10), (2, 10), (5, 12)]
        assert {(r["n_tokens"], r["n_equal"]) for r in got if r["doc_id"] == 1} == {(40, 40)}
        assert [r["n_equal"] for r in got if r["doc_id"] == 2] == [36]
    found = decontaminate.find_overlaps(nasty, bench).collect()  # the long text holds what these seeds make
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(3, 10), (3, 11), (10, 10), (10, 11)]
    assert decontaminate.find_overlaps(empty(docs), bench).count() == 0 and decontaminate.find_overlaps(docs, empty(bench)).count() == 0


def test_replaced_phrases(spark):
    """Adjacent replaced words: the best-scoring run alone is too short, the overlap is not."""
    items, docs = [], []
    for i, (left, gap, right) in enumerate(((8, 3, 8), (6, 2, 6), (7, 2, 7), (8, 4, 8))):
        w = [f"{prose(60 + i, 1)}{k}i{i}" for k in range(left + gap + right)]
        items.append((i, " ".join(w)))
        docs.append((i, " ".join([*prose(70 + i, 9).split(), *w[:left], *(f"new{k}" for k in range(gap)), *w[left + gap :], "tail"])))
    got = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_tokens"], r["n_equal"]) for r in got) == [(0, 0, 19, 16), (1, 1, 14, 12), (2, 2, 16, 14), (3, 3, 20, 16)]
    r = np.random.default_rng(3)
    for _ in range(300):
        same = r.random(r.integers(1, 25)) < 0.7
        if same.any():
            on = np.flatnonzero(same)
            want = max(b + 1 - a for a in on for b in on if b >= a and same[a : b + 1].sum() >= 0.8 * (b + 1 - a) - 1e-9)
            a, b = decontaminate.longest_segment(same, 0.8)
            assert b - a == want and same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * want - 1e-9


def test_seeds_skip_ignored_places():
    a, b = np.arange(1, 10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    for mask in decontaminate.MASKS:
        c = b.copy()
        c[[i for i, x in enumerate(mask) if x == "0"]] = 99
        assert decontaminate.seed_hashes(a, mask) == decontaminate.seed_hashes(c, mask)
        c[0] = 99
        assert decontaminate.seed_hashes(a, mask) != decontaminate.seed_hashes(c, mask)


# --- 5 ---


def test_licenses(spark, nasty):
    mit = license_scan.KNOWN["MIT"]
    other = "MIT License text\n\n" + mit
    spelled = "Copyright (c) 2020 Some One\n\n  " + mit.upper().replace("SUBLICENSE", "sublicence").replace(",", " ;").replace('"', "“") + "\nAll rights reserved."
    docs = spark.createDataFrame([(1, mit), (2, spelled), (3, other), (4, "text\nReleased under the MIT license!\nmore"), (5, None), (6, ""), (2, spelled)], "doc_id long, text string")
    got = license_scan.scan_licenses(docs, license_scan.known_digests(spark)).collect()
    assert sorted((r["doc_id"], r["license_id"], r["n_notices"]) for r in got if r["license_id"]) == [(1, "MIT", 0), (2, "MIT", 0), (2, "MIT", 0)]
    assert [r["notices"] for r in got if r["doc_id"] == 4] == [["MIT-notice"]]
    assert len(got) == 7 and license_scan.scan_licenses(nasty, license_scan.known_digests(spark), broadcast_rows=1).count() == nasty.count()
    assert license_scan.scan_licenses(empty(nasty), license_scan.known_digests(spark)).count() == 0


# --- 6 ---


def test_lines(spark):
    line = prose(1, 40)
    near = line.replace(line.split()[20], line.split()[20] + "s", 1)
    docs = spark.createDataFrame([(1, f"Alpha.\n{line}\n{prose(2, 30)}"), (2, f"Alpha.\n{line.upper()}!\n{prose(3, 30)}"), (3, f"{near}\n{near}"), (4, prose(4, 30)), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.repeated_lines(docs).collect()}
    assert got[1] == (3, []) and got[2] == (3, [1]) and got[4] == (1, []) and got[5] == (0, []) and got[6] == (1, [])
    assert got[3][1] == [0, 1]
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
    assert left[2] == f"Alpha.\n{prose(3, 30)}" and left[6] == "" and left[5] is None and left[1].startswith("Alpha")


def test_large_blocks_find_the_same_groups(spark):
    r, rows = random.Random(11), []
    for c in range(4):
        w = prose(c, 60).split()
        for k in range(30):
            v = list(w)
            v[r.randrange(60)] += r.choice("abc")
            rows.append((len(rows), " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda small: sorted(x["doc_id"] for x in line_dedup.repeated_lines(docs, small=small).collect() if not x["removed"])
    assert kept(1) == kept(1000) and len(kept(1000)) < 120


def word_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def brute_lines(lines):
    """Which of the lines stay: the first of every group connected by a word edit similarity of 0.9."""
    w, root = [x.split(" ") for x in lines], list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(w)):
        for j in range(i):
            most = max(len(w[i]), len(w[j])) // 10
            if abs(len(w[i]) - len(w[j])) <= most and word_distance(w[i], w[j]) <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [i for i in range(len(w)) if find(i) == i]


def test_near_lines_equal_brute_force(spark):
    """One word in ten to fifty replaced, left out or added."""
    r, lines = random.Random(13), []
    for n, edits in ((10, 1), (20, 1), (20, 2), (30, 3), (50, 1), (50, 5), (9, 1), (19, 2), (12, 2)):
        for _ in range(6):
            w = [f"{prose(r.randrange(10**6), 1)}{r.randrange(40)}" for _ in range(n)]
            v = list(w)
            for e in range(edits):
                at, kind = r.randrange(len(v)), r.randrange(3)
                v[at : at + (kind != 2)] = [] if kind == 1 else [f"edit{e}"]
            lines += [" ".join(w), " ".join(v)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in line_dedup.repeated_lines(docs, min_chars=1).collect() if not x["removed"])
    assert kept == brute_lines(lines) and len(kept) < len(lines) - 30


def linked_groups(seed):
    """Two groups of lines; the first two lines, which are no centres, are the only link between the groups."""
    zone = [2 * i for i in range(8)]
    one, two = ([f"{c}{i}" if i in zone else f"word{seed}x{i}" for i in range(60)] for c in "pq")
    b, d = list(one), list(two)
    b[0], b[8], b[59], d[4], d[12], d[59] = two[0], two[8], "mine", one[4], one[12], "other"
    return [" ".join(b), " ".join(d)] + [" ".join(f"own{k}" if i == 18 + k % 40 else x for i, x in enumerate(w)) for w in (one, two) for k in range(60)]


def test_large_blocks_keep_a_single_link(spark):
    lines = linked_groups(0)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert brute_lines(lines) == [0] and brute_lines(lines[1:]) == [0, 1]
    kept = sorted(x["doc_id"] for x in line_dedup.repeated_lines(docs, small=8).collect() if not x["removed"])
    assert kept == [0]


def test_equal_short_lines_go(spark):
    docs = spark.createDataFrame([(1, "The end of it\none"), (2, "the end, of it!\ntwo"), (3, "Theand thble"), (4, "theand thble")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0]}


def test_sketches_lose_no_similar_line():
    r = random.Random(29)
    for n in (9, 25, 80, 300):
        w = [f"{r.choice('abc')}{r.randrange(50)}" for _ in range(n)]
        v, edits = list(w), max(1, n // 10)
        for e in range(edits):
            at, kind = r.randrange(len(v)), r.randrange(3)
            v[at : at + (kind != 2)] = [] if kind == 1 else [f"edit{e}"]
        x, y, z = line_dedup.Lines([" ".join(w), " ".join(v), " ".join(f"z{k}" for k in range(n))]).sketches().T.tolist()
        differ = lambda a, b: sum(((p ^ q) % (1 << 64)).bit_count() for p, q in zip(a, b))
        assert differ(x, y) <= 2 * edits < differ(x, z)


def test_words_below_six_bytes_count_in_the_query(spark, tmp_path):
    spark.createDataFrame([(1, "ok go\n"), (2, "fine\nOK, go!"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 0, ""), 2: (2, 1, "1"), 3: (0, 0, "")}


def test_short_lines_outlive_a_repeated_one(spark):
    line = prose(1, 40)
    docs = spark.createDataFrame([(1, line), (2, f"{line}\na rose\nis red"), (3, f"{line}\n  \n")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()} == {1: line, 2: "a rose\nis red"}


def test_simhash_equals_plain(spark):
    lines = [(i, prose(i, 1 + 7 * i)) for i in range(8)]
    df = spark.createDataFrame(lines, "line long, norm string")
    h = {r["w"]: r["h"] for r in df.select(F.explode(F.split("norm", " ")).alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    for r in line_dedup.simhash(df, "line", F.split("norm", " ")).collect():
        words = dict(lines)[r["line"]].split(" ")
        want = sum(1 << b for b in range(64) if 2 * sum(h[w] >> b & 1 for w in words) > len(words))
        assert r["sim"] % (1 << 64) == want


def test_line_edges(nasty):
    got = line_dedup.repeated_lines(nasty).collect()
    assert len(got) == nasty.count() and all(r["removed"] == [] for r in got if r["doc_id"] == 1)
    assert line_dedup.repeated_lines(empty(nasty)).count() == 0
    left = line_dedup.without_repeated_lines(nasty)
    assert left.columns == nasty.columns and {r["doc_id"] for r in left.collect()} >= {1, 2, 3, 6, 7, 8}
    assert {r["source"] for r in left.collect()} == {None} and {r["removed"] for r in left.collect()} == {"clash-removed"}


# --- 7 and 9 ---


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.queries()["op7_quality"](spark, sf).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in truth if crc(i, 5) == 0]
    assert all(got[i]["held_out"] == (crc(i, 5) == 0) for i in got) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95


def test_quality_scores_equal_plain():
    rng = np.random.default_rng(2)
    z, v, y = rng.normal(size=(20, 8)).astype(np.float32), rng.normal(size=(300, 8)).astype(np.float32), rng.integers(0, 2, 300).astype(np.float32)
    m = quality.QualityModel(None, None, v, y)
    s = z @ v.T
    for block in (7, 64, 1000):
        got = m.score(z, 9, 4, block)
        for i in range(20):
            near = np.argsort(-s[i])[:9]
            w = np.maximum(s[i][near], 0) ** 4
            assert got[i] == pytest.approx((w * y[near]).sum() / w.sum(), rel=1e-4)


def test_quality_edges(spark, nasty):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(nasty, quality.fit_quality(nasty, labels)).collect()
    assert len(got) == nasty.count() and all(r["score"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert quality.classify(empty(nasty), quality.fit_quality(empty(nasty), labels)).count() == 0
    assert {r["score"] for r in quality.classify(nasty, quality.fit_quality(nasty, empty(labels))).collect()} == {0}


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.queries()["op9_language_id"](spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in truth if crc(i, 4) == 2]
    assert len(got) == len(truth) and all(got[i]["held_out"] == (crc(i, 4) == 2) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.98


def test_language_backs_off():
    m = language_id.LanguageModel(["a", "b"], [{"known": 0}, {"x": 0}, {"kn": 0, "xy": 1}, {}, {}, {}], [np.array([[-1.0, -2.0]]), np.array([[-3.0, -4.0]]), np.array([[-5.0, -6.0], [-7.0, -1.0]]), *[np.zeros((0, 2))] * 3])
    assert m.row("known").tolist() == [-1, -2] and m.row("xy").tolist() == [-7, -1] and m.row("xkn").tolist() == [-5, -6] and m.row("qx").tolist() == [-3, -4]
    assert m.row("qqq").tolist() == [-2, -2]


def test_language_edges(nasty):
    model = language_id.fit_languages(nasty)
    got = language_id.identify(nasty, model).collect()
    assert len(got) == nasty.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 6))
    assert {r["lang_pred"] for r in got if r["doc_id"] == 8} <= {"en", "fr"}
    none = language_id.fit_languages(empty(nasty))
    assert {r["lang_pred"] for r in language_id.identify(nasty, none).collect()} == {"und"} and language_id.identify(empty(nasty), model).count() == 0


# --- 8 ---


def test_shards(spark, sf, nasty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = docs.union(docs.where("doc_id = 0").select(F.explode(F.sequence(F.lit(10_000), F.lit(10_099))).alias("doc_id"), *docs.columns[1:]))
    for df in (docs, hot):
        got = sharding.shard_by_bytes(df).toPandas()
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        assert sorted(got["doc_id"]) == sorted(text)
        assert all(s == len(text[i].encode()) + 1 and c == zlib.crc32(text[i].encode()) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
        weight = got.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
        largest = max(got["size"].max(), got["size"].sum() // 2048)
        assert weight.max() - weight.min() <= 2 * largest + 0.02 * got["size"].sum() / 16
    assert sharding.shard_by_bytes(nasty).count() == nasty.count() and sharding.shard_by_bytes(empty(nasty)).count() == 0
    a, b = (sorted(map(tuple, sharding.shard_by_bytes(docs.repartition(n)).collect())) for n in (2, 5))
    assert a == b


# --- 10 ---


def brute_nearest(rows, k):
    rows = {i: v for i, v in rows if v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in rows:
        s = sorted(((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q))
        out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_edges(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(60)] + [(100 + i, [1.0, 0.0, -0.0, 2.0]) for i in range(50)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (7, dict(rows)[7])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, key string").repartition(3)
    want = brute_nearest([x for x in rows if x[0] is not None], 20)
    for lists in (512, 8):
        got = collections.defaultdict(list)
        for x in nearest.nearest_neighbours(df, df, list_size=lists, ratio=1e9, group_rows=10).collect():
            got[x["query_id"]].append((x["rank"], x["vec_id"]))
        assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items()}
    assert nearest.nearest_neighbours(empty(df), df).count() == 0 and nearest.nearest_neighbours(df, empty(df)).count() == 0
    few = df.where("vec_id < 5")
    assert nearest.nearest_neighbours(few, few).groupBy("query_id").count().select("count").distinct().collect()[0][0] <= 4


def test_nearest_recall(spark):
    """Recall with the production settings on unclustered vectors, many lists."""
    x = np.random.default_rng(8).normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest.nearest_neighbours(df, df.where("vec_id % 100 = 0"), list_size=100).collect()
    s = x.astype(np.float32).astype(np.float64) @ x.astype(np.float32).astype(np.float64)[::100].T
    hits = 0
    for c in range(40):
        s[c * 100, c] = -9
        top = set(np.argsort(-s[:, c])[:20].tolist())
        hits += len(top & {r["vec_id"] for r in got if r["query_id"] == c * 100})
    assert hits / 800 >= 0.9


def test_nearest_in_small_clusters(spark):
    """Tight, isolated groups of five: every query still gets twenty rows, its own group first."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(40, 16))
    x = (centre[:, None, :] + 1e-3 * rng.normal(size=(40, 5, 16))).reshape(200, 16)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(dict)
    for r in nearest.nearest_neighbours(df, df, list_size=5).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert len(got) == 200 and all(sorted(v) == list(range(1, 21)) for v in got.values())
    assert all({v[r] // 5 for r in range(1, 5)} == {q // 5} for q, v in got.items())


# --- all ---


def test_word_hashes():
    h, at = tokens.words_of(["The cat, the CAT", "", "día 12 dia", "x_y"])
    assert np.diff(at).tolist() == [4, 0, 3, 2] and h[0] == h[2] and h[1] == h[3] and h[4] != h[6]
    s, sat = tokens.shingles(h, at, 3)
    assert np.diff(sat).tolist() == [2, 0, 1, 1]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, cur = common.Scratch(spark), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = scratch.cut(stage(spark, cur, sf))
        assert nxt.columns == docs.columns, name
        before, after = {r["doc_id"] for r in cur.collect()}, {r["doc_id"] for r in nxt.collect()}
        assert after <= before and after
        if name == "jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in cur.orderBy("doc_id").collect()]
            assert after == {c for c, _ in brute_classes(rows)}
        if name == "decontaminate":
            hit = {r["doc_id"] for r in decontaminate.find_overlaps(cur, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert after == before - hit
        cur = nxt
    out = corpus_pipeline.STAGES[-1][1](spark, cur, sf).collect()
    assert len(out) == cur.count() and all(r["decoded"] for r in out)


def test_pipeline_takes_nasty_rows(spark, sf, nasty):
    cur = nasty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        cur = common.Scratch(spark).cut(stage(spark, cur, sf))
        assert cur.columns == nasty.columns
    assert corpus_pipeline.STAGES[-1][1](spark, cur, sf).count() == cur.count()


def test_near_lines_are_found_at_any_place(spark):
    """One word of 10, 25 and 50 changed: all pairs meet."""
    r, lines = random.Random(29), []
    for n in (10, 25, 50):
        for _ in range(100):
            w = [f"{prose(r.randrange(10**6), 1)}{r.randrange(999)}" for _ in range(n)]
            at = r.randrange(n)
            lines += [" ".join(w), " ".join([*w[:at], prose(r.randrange(10**6), 1) + "z", *w[at + 1 :]])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {x["doc_id"] for x in line_dedup.repeated_lines(docs).collect() if x["removed"]}
    assert gone == set(range(1, len(lines), 2))


def test_words_of_scripts_without_spaces(spark):
    one, two = "日本語の文章は空白なしで書かれるので一文字ごとに比べる", "日本語の文章は空白なしで書かれるので一文字ごとに比ぶる"
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {x["doc_id"]: x["removed"] for x in line_dedup.repeated_lines(docs).collect()} == {1: [], 2: [0]}


# --- what the rounds found ---


def test_license_spelling_over_a_line_end(spark):
    known = license_scan.known_digests(spark)
    bsd = license_scan.KNOWN["BSD-2-Clause"]
    wrapped = "The BSD 2-Clause License\n\n" + bsd.replace("COPYRIGHT HOLDERS AND", "COPYRIGHT\nOWNERS AND").replace("\nfollowing", " following")
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + license_scan.KNOWN["MIT"].replace("\n", " ")
    docs = spark.createDataFrame([(1, wrapped), (2, mit), (3, "favour favour licence licence"), (4, "favor favor license license"), (5, "MIT License")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs, known).collect()}
    assert got[1]["license_id"] == "BSD-2-Clause" and got[2]["license_id"] == "MIT" and got[3]["digest"] == got[4]["digest"] and got[5]["license_id"] is None


def test_one_row_of_each_class(spark):
    a, b = prose(1), prose(2)
    rows = [(2, a), (4, a), (4, b), (9, b), (None, a), (None, b), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect()), key=str)
    assert got == sorted([(2, a), (4, b), (5, None), (6, "")], key=str)
    twice = spark.createDataFrame([(4, a), (4, b), (4, a)], "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard_join.one_of_each(twice).collect()) == sorted([a, b])


def test_items_of_any_type_and_length(spark):
    docs = spark.createDataFrame([(1, "first line\nFour words, in all!\nlast"), (2, "we have four words in all here"), (3, prose(5, 40))], "doc_id long, text string")
    items = spark.createDataFrame([(7, "four words in all"), (8, prose(5, 40))], "item_id int, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_tokens"], r["doc_token"]) for r in decontaminate.find_overlaps(docs, items).collect())
    assert got == [(1, 7, 4, 2), (3, 8, 40, 0)]


def test_overlaps_equal_brute_force(spark):
    """Copies of items with replaced words, among clean texts."""
    r = random.Random(17)
    items = [(i, prose(900 + i, 30)) for i in range(12)]
    docs = [(i, prose(100 + i, 60)) for i in range(20)]
    for i, (_, t) in enumerate(items):
        w = t.split()
        w[r.randrange(12, 18)] = "changed"
        docs.append((100 + i, prose(300 + i, 20) + " " + " ".join(w) + " " + prose(500 + i, 20)))

    def overlaps(d, t, least=10, share=0.8):
        x, y = d.split(), t.split()
        for k in range(-len(y) + 1, len(x)):
            same = [x[k + j] == y[j] for j in range(len(y)) if 0 <= k + j < len(x)]
            for p in range(len(same)):
                for q in range(p + least, len(same) + 1):
                    if same[p] and same[q - 1] and sum(same[p:q]) >= share * (q - p):
                        return True
        return False

    want = {(a, b) for a, d in docs for b, t in items if overlaps(d, t)}
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == want and len(want) >= 12


def test_shards_of_repeated_rows(spark):
    heavy, half = "h" * 2000, "k" * 600
    rows = [(1, heavy)] * 300 + [(1000 + i, half) for i in range(30)] + [(i, prose(i, 40)) for i in range(600)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, shards_of = collections.Counter(), collections.defaultdict(set)
    for x in out:
        size[x["shard"]] += x["size"]
        shards_of[x["text_crc32"]].add(x["shard"])
    assert len(size) == 16 and max(size.values()) < 1.15 * min(size.values())
    assert all(len(s) == 1 for c, s in shards_of.items() if c != zlib.crc32(heavy.encode()))


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ 12"), (2, "x² the")], "doc_id long, text string")
    learn = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "le chat est sur le tapis", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.fit_languages(learn)).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en"


def test_predictions_equal_plain(spark):
    """Mean log frequency of known words, of the longest known n-grams for others."""
    learn = [(i, prose(i, 60), "a") for i in range(4)] + [(i + 10, prose(i, 60).replace("th", "zu").replace("er", "ok"), "b") for i in range(4, 8)]
    model = language_id.fit_languages(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    counts = [{}, {}]
    for _, t, g in learn:
        for w in t.split():
            counts[g == "b"][w] = counts[g == "b"].get(w, 0) + 1
    text = "thti zuti okndly erou thti"
    want = [sum(np.log10(c[w] / sum(c.values())) if w in c else -7.0 for w in text.split() if w in counts[0] or w in counts[1]) for c in counts]
    rows = np.array([model.row(w) for w in text.split() if w in counts[0] or w in counts[1]])
    assert np.allclose(rows.sum(axis=0), want, atol=1e-4)
    got = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == model.langs[int(np.argmax(np.mean([model.row(w) for w in text.split()], axis=0)))]


def test_language_of_few_texts_is_learned(spark):
    """Copies do not lower a language's chance: the rate follows the distinct texts."""
    few = ["un texte que tout le monde copie", "un autre texte encore"]
    for seed in range(4):
        texts = [f"{t} {seed}" for t in few]
        rows = [(i, texts[i % 2], "fr") for i in range(3000)] + [(i, f"a text with words of number {i}", "en") for i in range(50)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.fit_languages(docs)
        got = language_id.identify(docs.where("doc_id < 2 and lang = 'fr'"), model).collect()
        assert {r["lang_pred"] for r in got} == {"fr"} and all(r["score"] > 0.9 for r in got)


def test_quality_does_not_follow_the_partitions(spark):
    """Ids with several texts, and equal vectors with different labels."""
    rows = [(i % 40, prose(i % 60, 30)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    found = []
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = quality.classify(docs, quality.fit_quality(docs, labels)).collect()
        found.append(sorted((r["doc_id"], round(r["score"], 4)) for r in got))
    assert found[0] == found[1] == found[2]


def test_quality_ties_go_to_smaller_numbers():
    v, y = np.ones((50, 1), np.float32), np.array([1] * 9 + [0] * 41, np.float32)
    m = quality.QualityModel(None, None, v, y)
    for block in (4, 7, 50):
        assert m.score(np.ones((3, 1), np.float32), 12, 4, block) == pytest.approx([9 / 12] * 3)


def test_shards_of_many_empty_texts(spark):
    rows = [(i, "") for i in range(30_000)] + [(100_000 + i, prose(i, 1500)) for i in range(400)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    assert len(out) == len(rows) and sorted(out["doc_id"]) == sorted(i for i, _ in rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert out[out["size"] == 1]["shard"].nunique() == 1  # equal texts that fit a shard stay together


def test_copyright_lines_without_a_year(spark):
    """Initials, placeholders and the like make a copyright line; a line of the licence that begins with the word does not."""
    mit = license_scan.KNOWN["MIT"]
    heads = ["Copyright A. Person", "Copyright <YEAR> <COPYRIGHT HOLDER>", "Copyright [yyyy] [name of copyright owner]", "# Copyright: Some One", "Copyright by Some One", "Copyright the authors of it"]
    docs = spark.createDataFrame([(i, f"{h}\n\n{mit}") for i, h in enumerate(heads)] + [(99, "Some words of their own\n\n" + mit)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan_licenses(docs, license_scan.known_digests(spark)).collect()}
    assert all(got[i] == "MIT" for i in range(len(heads))) and got[99] is None


def test_overlaps_with_a_tenth_to_a_fifth_replaced(spark):
    """Items of 12 to 60 words with 10 to 20 % of the words replaced at random places: found wherever the rule holds."""
    r = random.Random(23)
    items = [(i, prose(2000 + i, r.randrange(12, 61))) for i in range(60)]
    docs = [(1000 + i, prose(100 + i, 60)) for i in range(20)]
    for i, t in items:
        w = t.split()
        for at in r.sample(range(len(w)), round(len(w) * r.uniform(0.1, 0.2))):
            w[at] = f"changed{at}"
        docs.append((i, prose(300 + i, 20) + " " + " ".join(w) + " " + prose(500 + i, 20)))

    def holds(d, t, least=10, share=0.8):
        x, y = d.split(), t.split()
        for k in range(-len(y) + 1, len(x)):
            same = [x[k + j] == y[j] for j in range(len(y)) if 0 <= k + j < len(x)]
            if any(same[p] and same[q - 1] and sum(same[p:q]) >= share * (q - p) for p in range(len(same)) for q in range(p + least, len(same) + 1)):
                return True
        return False

    text = dict(docs)
    want = {(i, i) for i, t in items if holds(text[i], t)}
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]) for x in found}
    assert want <= got and len(want) >= 50 and not any(d >= 1000 for d, _ in got)
