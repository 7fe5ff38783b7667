"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import small_batches, table
from partloom.llm.language_id import fold
from partloom.llm.tokens import in_chunks, words_of

# Classes of bytes: lower, upper, digit, space, line end, every ASCII mark, lead and trail bytes of other characters.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
for _i, _c in enumerate(".,!?|*#$%&"):
    _CLASS[ord(_c)] = 6 + _i
_CLASS[[i for i in range(33, 127) if _CLASS[i] == 0]] = 16
_CLASS[128:192] = 17
_CLASS[192:] = 18
CLASSES = 19
TRIGRAMS = CLASSES**3
LAGS = 4
WORDS = 4096
DIM = TRIGRAMS + LAGS + WORDS


def features(texts: list[str]) -> np.ndarray:
    """Rows of square-rooted shares: byte-class trigrams, words that equal the word 1 to 4 places before, hashed words."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):  # one text at a time: a row of counts, whatever the length
        c = _CLASS[np.frombuffer(b"\n" + t.encode("utf-8", "replace") + b"\n", np.uint8)]
        out[i, :TRIGRAMS] = np.bincount(c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:], minlength=TRIGRAMS)
    h, at = words_of(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    for lag in range(1, LAGS + 1):
        same = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        out[:, TRIGRAMS + lag - 1] = np.bincount(row[lag:][same], minlength=len(texts))
    flat = row * WORDS + (h >> np.uint64(52)).astype(np.int64)
    out[:, TRIGRAMS + LAGS :] = np.bincount(flat, minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    size = np.maximum(np.array([len(t) for t in texts], np.float32), 1)[:, None]
    words = np.maximum(np.diff(at).astype(np.float32), 1)[:, None]
    out[:, :TRIGRAMS] /= size
    out[:, TRIGRAMS:] /= words
    return np.sqrt(out, out=out)


class QualityModel:
    """Feature weights, the projection to latent space, unit vectors of the labelled rows and their labels."""

    def __init__(self, weights, axes, vectors, labels):
        self.weights, self.axes, self.vectors, self.labels = weights, axes, vectors, labels

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.weights) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, z: np.ndarray, k: int, power: int, block: int) -> np.ndarray:
        """Exact cosines with all labelled vectors, block by block, keeping the k largest so far of every row, of equal ones
        those of the smaller numbers."""
        best, of = np.full((len(z), k), -2.0, np.float32), np.zeros((len(z), k), np.float32)
        for a in range(0, len(self.vectors), block):
            sims = np.concatenate([best, z @ self.vectors[a : a + block].T], axis=1)
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
            tied = np.flatnonzero((sims >= np.take_along_axis(sims, near, 1).min(axis=1, keepdims=True)).sum(axis=1) > k)
            if len(tied):
                near = near.copy()
                near[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
            near = np.sort(near, axis=1)  # columns stay in the order of the vectors' numbers
            labels = np.concatenate([of, np.broadcast_to(self.labels[a : a + block], (len(z), len(self.labels[a : a + block])))], axis=1)
            best, of = np.take_along_axis(sims, near, 1), np.take_along_axis(labels, near, 1)
        w = np.maximum(best, 0) ** power
        total = w.sum(axis=1)
        return np.where(total > 0, (w * of).sum(axis=1) / np.maximum(total, 1e-12), 0.0)


def _extract(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for i in range(0, len(texts), 64):
            x = features(texts[i : i + 64])
            idx = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("label").to_pylist()[i : i + 64], pa.float64()), pa.array([j.astype(np.int32) for j in idx], pa.list_(pa.int32())), pa.array([r[j] for r, j in zip(x, idx)], pa.list_(pa.float32()))],
                names=["label", "idx", "val"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 5000, rank: int = 64) -> QualityModel:
    """Latent-semantic vectors of a bounded sample of the labelled rows.

    About `sample` labelled ids, drawn by their hash, are used: the number of vectors that every task compares with,
    and so the model's size, does not grow. Several labels of one id are averaged; of an id's several texts the one
    with the smallest hash is taken; null ids and labels are left out. Vectors are numbered in the order of their ids.
    The axes are the `rank` leading right singular vectors (randomised, two power steps, fixed seed) of the sample's
    feature rows weighted by inverse document frequency.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    n = max(1, known.count())
    drawn = known.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    drawn = drawn.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(2 * sample)  # at most this many rows are broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("id", "label", "text")
    one = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    found = one.orderBy("id").select("label", F.col("t.text").alias("text")).mapInArrow(_extract, "label double, idx array<int>, val array<float>").toLocalIterator()
    idx, val, y = [], [], []
    for r in found:
        idx.append(np.array(r["idx"], np.int32))
        val.append(np.array(r["val"], np.float32))
        y.append(r["label"])
    if not y:
        return QualityModel(np.ones(DIM, np.float32), np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    df = np.bincount(np.concatenate(idx), minlength=DIM)
    weights = np.log((1 + len(y)) / (1 + df)).astype(np.float32) + 1

    def blocks():
        for a in range(0, len(y), 256):
            x = np.zeros((len(y[a : a + 256]), DIM), np.float32)
            for i in range(len(x)):
                x[i, idx[a + i]] = val[a + i]
            yield x * weights

    rank = min(rank, len(y))
    q = np.random.Generator(np.random.PCG64(3)).standard_normal((DIM, rank + 8)).astype(np.float32)
    for _ in range(3):
        z = np.zeros_like(q)
        for x in blocks():
            z += x.T @ (x @ q)
        q = np.linalg.qr(z)[0].astype(np.float32)
    small = sum((x @ q).T @ (x @ q) for x in blocks())
    axes = (q @ np.linalg.eigh(small.astype(np.float64))[1][:, ::-1][:, :rank]).astype(np.float32)
    model = QualityModel(weights, axes, None, np.array(y, np.float32))
    model.vectors = np.concatenate([model.project(x / weights) for x in blocks()]).astype(np.float32)
    return model


def classify(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 15, power: int = 8, block: int = 4096, keep_from: float = 0.3) -> DataFrame:
    """`id_col, score, predicted` for every row: the similarity-weighted mean label of the nearest labelled vectors.

    Cosines with all labelled vectors are computed, in blocks; the weight of each of the `neighbours` nearest is its
    cosine, 0 if negative, to the power `power`. score lies in 0 to 1; predicted is 1 from `keep_from` on. A text
    without features (null or empty), and any text if nothing was labelled, has score 0. The whole text is read.
    Repeated rows give equal rows, an empty table none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores = np.zeros(len(texts))
            at = 0
            for chunk in in_chunks(texts):
                for i in range(0, len(chunk), 128):
                    part = chunk[i : i + 128]
                    if len(m.labels):
                        s = m.score(m.project(features(part)), min(neighbours, len(m.labels)), power, block)
                        scores[at : at + len(part)] = np.where([bool(t) for t in part], np.clip(s, 0, 1), 0)
                    at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(predict, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= keep_from).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    out = classify(docs, fit_quality(docs, labels))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
