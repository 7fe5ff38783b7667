"""Collocations, whitening and secret scans against brute force and SQL, and their edge cases."""

import base64
import bz2
import collections
import glob
import gzip
import hashlib
import lzma
import os
import random
import re
import urllib.parse
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from partloom.llm import collocations, secrets, whitening

CLASH = ["id", "lang_", "chunk", "codes", "near", "j", "l", "r", "c", "a", "n", "phrase", "rank", "score", "part", "h", "v", "x", "w", "base", "added", "spans", "component"]


def clash(df):
    return df.select("*", *(F.lit(f"clash-{c}").alias(c) for c in CLASH if c not in df.columns))


# --- 11 ---


def brute_collocations(rows, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) if i + k <= len(w))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) >= 2 and a >= least}
        mine = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (count[p[:j]] * count[p[j:]]), j, count[p[:j]], count[p[j:]]) for j in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrase_rows(seed, n=150):
    r = random.Random(seed)
    words = ["Of", "the", "é", "ÉT", "state", "x-y", " ", "art", "nul\u0000l", "z" * 300]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " ; "]
    text = lambda: "".join(r.choice(words[: r.choice([3, 6, 10])]) + r.choice(ends if r.random() < 0.3 else ends[:3]) for _ in range(r.randrange(40)))
    rows = [(text(), r.choice(["en", "fr", None, "und"])) for _ in range(n)]
    return rows + [(None, "en"), ("", "fr"), (" \t. ", None), ("the the the the the the the", "en"), ("lonely words", "it")] + [("state of the art, state of the art", "en")] * 20


@pytest.mark.parametrize("chunk_bytes", [1, 700, 1 << 23])
def test_collocations_equal_brute_force(spark, chunk_bytes):
    rows = phrase_rows(chunk_bytes)
    docs = clash(spark.createDataFrame(rows, "text string, lang string")).repartition(3)
    for least, longest, top in ((3, 5, 2000), (12, 3, 5)):
        got = collocations.collocations(docs, least=least, longest=longest, top=top, chunk_bytes=chunk_bytes)
        assert sorted(tuple(r[c] for c in FIELDS) for r in got.collect()) == brute_collocations(rows, least, longest, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert collocations.collocations(docs.limit(0)).collect() == [] and collocations.collocations(docs).collect() == []


def test_scores_beyond_64_bits(spark):
    """Counts of 10^12 in 10^15 words: 1000 a n is about 10^30."""
    a, n, left, right = 10**12 + 39, 10**15 + 37, 3 * 10**12 + 1, 7 * 10**12 + 9
    big = lambda x: f"cast({x}L as decimal(19, 0))"
    got = spark.sql(f"select (1000 * {big(a)} * {big(n)}) div ({big(left)} * {big(right)}) x").first()["x"]
    assert got == 1000 * a * n // (left * right)


def test_collocations_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = collocations.op11_collocations(spark, sf)
    want = con.sql(collocations.ORACLE)
    assert set(got.columns) == set(want.columns)
    assert sorted(map(tuple, got.select(FIELDS).collect())) == sorted(want.select(*(f'"{c}"' for c in FIELDS)).fetchall()) != []


def test_longest_phrase_names_its_parents(spark):
    from partloom.llm.common import Scratch

    docs = spark.createDataFrame([("a b c a b c. a b c", "en")] * 5, "text string, lang string")
    levels = collocations.phrases(docs, Scratch(spark), least=10, longest=3)
    ids = {r["id"]: r["phrase"] for r in levels[1].collect()}
    assert {r["phrase"]: (ids[r["l"]], ids[r["r"]], r["a"], list(r["pre"]), list(r["suf"])) for r in levels[2].collect()} == {"a b c": ("a b", "b c", 15, [15, 15, 15], [15, 15, 15])}


# --- 12 ---


def brute_whitening(vectors, most=32):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), [sum(int(v) for v in col) for col in x.T]
    centred = np.array([[float(Fraction(n * int(v) - s, n)) for v, s in zip(row, sums)] for row in x])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:most]
    return x, sums, centred, v, e[order], axes[:, order], [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]


def check_whitening(got, vectors, most=32):
    """`got`: rows by (vec_id, component); vectors by vec_id."""
    ids = sorted(vectors)
    x, sums, centred, v, e, axes, deviation = brute_whitening([vectors[i] for i in ids], most)
    k = len({r["component"] for r in got})
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    w = np.zeros((len(ids), k))
    at = {i: p for p, i in enumerate(ids)}
    for r in got:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]]
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(v)) <= 1e-9 * r["explained"]
    want = centred @ axes[:, :k] / np.sqrt(e[:k])
    assert np.allclose(np.abs(w), np.abs(want), atol=1e-8)
    assert np.allclose(w * np.sign((w * want).sum(axis=0)), want, atol=1e-8)
    error = np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert {r["identity_error"] for r in got} and all(abs(r["identity_error"] - error) < 1e-9 and r["identity_error"] < 1e-4 for r in got)
    return k


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(3)
    good = {i: (r.normal(size=6) * [1, 2, 3, 4, 5, 6] + [0, 0, 9, 0, -3, 0]).astype(np.float32).tolist() for i in range(80)}
    rows = list(good.items()) + [(900, None), (901, [1.0, None] * 3), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0] * 5)]
    docs = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(3)
    for most in (32, 4):
        assert check_whitening(whitening.whiten(docs, components=most).collect(), good, most) == min(most, 6)


def test_whitening_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "AT_ONCE", 4)
    r = np.random.default_rng(4)
    good = {i: r.normal(size=5).tolist() for i in range(40)}
    assert check_whitening(whitening.whiten(spark.createDataFrame(list(good.items()), "vec_id long, embedding array<double>")).collect(), good) == 5


def test_whitening_of_flat_equal_and_far_vectors(spark):
    r = np.random.default_rng(5)
    flat = {i: [a, b, a + b, 7.0] for i, (a, b) in enumerate(r.integers(-9, 9, (30, 2)).astype(float).tolist())}
    frame = lambda d: spark.createDataFrame(list(d.items()), "vec_id long, embedding array<double>")
    assert check_whitening(whitening.whiten(frame(flat)).collect(), flat) == 2
    assert whitening.whiten(frame({1: [1.0, 2.0], 2: [1.0, 2.0]})).collect() == [] == whitening.whiten(frame({1: [1.0]}).limit(0)).collect()
    far = whitening.whiten(frame({1: [1e300, 0.0], 2: [-1e300, 1.0], 3: [0.0, 2.0]})).collect()
    assert all(np.isfinite(x["whitened"]) for x in far) and {x["vec_id"]: x["deviation"] for x in far} == {1: None, 2: None, 3: 36864}
    twice = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert sorted([(x["vec_id"], x["n"]) for x in whitening.whiten(twice).collect()], key=str) == [(3, 3), (None, 3), (None, 3)]


def test_whitening_query(spark, sf):
    got = whitening.op12_whitening(spark, sf)
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert check_whitening(got.collect(), rows) == 32


# --- 13 ---

SECRET = "password = hunter2hunter2"


def brute_base(text):
    out = []
    for kind, pattern, least in (
        ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
        ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32),
    ):
        for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else re.A):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), secrets.KINDS.index(kind), m.end()))
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


@pytest.mark.parametrize(
    "inner,path",
    [
        (b64(SECRET), "base64"), (base64.urlsafe_b64encode(("?>~" * 9 + SECRET).encode()).decode(), "base64"), ("dir/" + b64(SECRET), "base64"), ("ab" + b64("é ü " + SECRET), "base64"),
        (base64.encodebytes(("words and words " * 20 + SECRET).encode()).decode(), "base64"),
        (urllib.parse.quote(SECRET), "url"), (urllib.parse.quote(urllib.parse.quote("é" + SECRET)), "url>url"), ("".join(f"%{b:02x}" for b in SECRET.encode()), "url"),
        ("".join(f"\\u{ord(c):04X}" for c in SECRET), "unicode"), ("\\ud83d\\ude00\\ud83d" + "".join(f"\\x{ord(c):02x}" for c in SECRET), "unicode"), ("".join(f"&#x{ord(c):x};" for c in SECRET), "unicode"), ("\\u{70}assword&#61;hunter2hunter2", "unicode"),
        (b64(gzip.compress(SECRET.encode())), "base64>compressed"), (b64(zlib.compress(SECRET.encode())), "base64>compressed"), (b64(bz2.compress(SECRET.encode())), "base64>compressed"),
        (b64(lzma.compress((SECRET * 9).encode())), "base64>compressed"), (b64(zstandard.ZstdCompressor().compress((SECRET * 9).encode())), "base64>compressed"),
        (urllib.parse.quote(gzip.compress(SECRET.encode())), "url>compressed"), (b64(gzip.compress(gzip.compress(SECRET.encode()))), "base64>compressed>compressed"),
        (urllib.parse.quote("\\u0070assword=" + "hunter2hunter2"), "url>unicode"), (b64(b64(urllib.parse.quote(SECRET))), "base64>base64>url"), (b64(gzip.compress(b64("\\u0074oken: abcdefgh12").encode())), "base64>compressed>base64>unicode"),
    ],
)
def test_secrets_in_layers(inner, path):
    text = f"é𐍈 before {inner} after."
    base, added, unread = secrets.scan(text)
    assert [(secrets.KINDS[k], s, e) for s, e, k in base] == brute_base(text) and unread == 0
    (start, end, kind, way), *more = [x for x in added if x[3] == path]
    first, last = text.index(inner), text.index(inner) + len(inner)
    assert kind == 0 and way == path and not more and first <= start < end <= last
    if "compressed" not in path:  # the characters found are enough to read it again
        again, _, _ = secrets.scan(text[:start] + "?" * (end - start) + text[end:])
        assert not again and not secrets.scan(text[:start] + "?" * (end - start) + text[end:])[1]


def test_layer_spans_are_exact():
    text = "x " + b64("ab " + SECRET + " z") + " y token%3Dabc%64efgh12%20"
    assert [(text[s:e], p) for s, e, _, p in secrets.scan(text)[1]] == [(b64("ab " + SECRET + " z")[4:38], "base64"), ("token%3Dabc%64efgh12", "url")]


def test_scanning_ends():
    """A cycle, data that swells beyond the bound, broken codes, and plain texts."""
    swelling = b64(gzip.compress(b"a" * 5_000_000 + SECRET.encode()))
    _, added, unread = secrets.scan(swelling, most_bytes=100_000)
    assert unread == 1 and [(s, e, secrets.KINDS[k]) for s, e, k, _ in added] == [(0, len(swelling.rstrip("=")), "hex")]
    assert secrets.scan(swelling)[2] == 0 and {k for _, _, k, _ in secrets.scan(swelling)[1]} == {0, 2}
    for text in ("", "%", "%zz %4", "\\u12 \\ud800 &#99999999;", "x^ BZh1 \x1f\x8b\x08", "A" * 5000, "%25" * 300, b64(bytes(range(256)))):
        assert secrets.scan(text)[0] == [] and secrets.scan(text)[2] == 0

    class Self(secrets.Layer):  # what unwraps to itself is seen once
        pass

    layer = Self("same text as before", lambda s, e: (0, 9))
    assert layer.key() == secrets.Layer("same text as before", lambda s, e: (0, 9)).key() != secrets.Layer("same text as before", lambda s, e: (1, 9)).key()


def nasty_texts():
    r = random.Random(13)
    bits = ["password", "PassWd", "sEcret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abcdefgh", "abc", "AKIA", "AKIAABCD12345678", "0123456789abcdef" * 2, "beef", "ſecret", "toKen", "\n", "é", "token=token= abcdefghij", "%3D", "\\u003d", b64(SECRET)]
    return [None, "", "x" * 200_000 + " secret=" + "y" * 100_000, "plain words only"] + ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(400)]


def test_secrets_equal_brute_force(spark):
    texts = nasty_texts()
    docs = clash(spark.createDataFrame([(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")).repartition(3)
    got = collections.Counter(str([(s["kind"], s["start"], s["end"]) for s in r["base"]]) for r in secrets.scan_secrets(docs).collect())
    assert got == collections.Counter(str(brute_base(t)) for t in texts)
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


def test_secrets_query(spark, tmp_path):
    texts = nasty_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op13_secrets(spark, str(tmp_path)).collect()}
    written = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, r = brute_base(t), got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in base) for kind in secrets.KINDS)
        assert r["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        own, added, _ = secrets.scan(t or "")
        every = sorted({(s, k, e) for s, e, k in own} | {(s, k, e) for s, e, k, _ in added})
        assert r["spans"] == written((secrets.KINDS[k], s, e) for s, k, e in every)
        assert set(written(base).split(",")) <= set(r["spans"].split(","))
    assert any(r["spans"].count(":") > 2 * sum(r[f"n_{k}"] for k in secrets.KINDS) for r in got.values())


def test_new_queries_run_over_whole_tables(spark, sf):
    rows = spark.read.parquet(*glob.glob(os.path.join(sf, "documents.parquet")))
    assert secrets.op13_secrets(spark, sf).count() == rows.count()
