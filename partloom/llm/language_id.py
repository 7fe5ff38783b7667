"""Language identification by known words first, with back-off to ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import small_batches, table

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
BLOCK = 1 << 18


def _letters(word: str) -> list[str]:
    """The runs of letters of a word that holds other numeric characters, such as fractions and raised digits."""
    return "".join(c if c.isalpha() else " " for c in word).split()


def _words(text: str):
    """Lists of at most BLOCK lower-case words, so that no list grows with the text."""
    found = (w for m in WORD.finditer(text.lower()) for w in ((m.group(),) if m.group().isalpha() else _letters(m.group())))
    while block := list(islice(found, BLOCK)):
        yield block


def _grams(word: str, n: int) -> list[str]:
    """n-grams of the word between two boundary marks; a unigram is a letter."""
    w = word if n == 1 else f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count(batches):
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("c", pa.int64())])
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for block in _words(text):
                counts.setdefault(lang, Counter()).update(block)
        rows = Counter()
        for lang, words in counts.items():
            for w, c in words.items():
                rows[lang, 0, w] += c
                for n in range(1, LONGEST + 1):
                    for g in _grams(w, n):
                        rows[lang, n, g] += c
        keys = list(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(rows.values()), pa.int64())],
            schema=schema,
        )


class LanguageModel:
    """Per unit (n = 0: word, else n-gram) one row of log10 relative frequencies, a column per language."""

    def __init__(self, langs: list[str], units: list[dict[str, int]], logs: list[np.ndarray]):
        self.langs, self.units, self.logs = langs, units, logs

    def row(self, word: str) -> np.ndarray:
        """The word's own log frequencies if any language knows it, else the mean over its n-grams of the longest
        length of which one is known, else what an unseen unit costs, the same for all languages."""
        if (i := self.units[0].get(word)) is not None:
            return self.logs[0][i]
        for n in range(LONGEST, 0, -1):
            known = [i for g in _grams(word, n) if (i := self.units[n].get(g)) is not None]
            if known:
                return self.logs[n][known].mean(axis=0)
        return np.full(len(self.langs), self.logs[0].min() if self.logs[0].size else 0.0, np.float32)


def fit_languages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_lang: int = 400,
    unseen: float = -7.0,
) -> LanguageModel:
    """Learn word and n-gram frequencies from a bounded sample of the labelled rows.

    Rows with null text or language are left out. About `sample_per_lang` distinct texts of a language, all if it has no
    more, are drawn by their hash, so copies of one text count once and a repeated task draws the same. All words and n-grams (of 1 to 5
    letters) of the drawn texts are kept: the sample alone bounds the model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    # distinct texts of each language: a language whose rows are copies of a few texts gives all of these
    sizes = rows.select("lang", F.xxhash64(F.lit(9), "text").alias("h")).distinct().groupBy("lang").count().collect()  # a row for each language
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return LanguageModel([], [{} for _ in range(LONGEST + 1)], [np.zeros((0, 0), np.float32)] * (LONGEST + 1))
    rates = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, sample_per_lang / r["count"]) * (1 << 30)) for r in sizes], "lang string, rate double"))
    drawn = rows.join(rates, "lang").where(F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(1 << 30)) < F.col("rate")).select("lang", "text").distinct()
    counts = drawn.mapInArrow(_count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    found = counts.toArrow()  # bounded by the sample
    units: list[dict[str, int]] = []
    logs = []
    for n in range(LONGEST + 1):
        own = found.filter(pc.equal(found["n"], n)).combine_chunks()
        grams, column = own["gram"].combine_chunks().dictionary_encode(), own["lang"].to_pylist()
        column = np.searchsorted(np.array(langs, dtype=object), column) if column else np.zeros(0, np.int64)
        c = own["c"].to_numpy().astype(np.float64)
        m = np.full((len(grams.dictionary), len(langs)), unseen, np.float32)
        if len(c):
            m[grams.indices.to_numpy(), column] = np.log10(c / np.bincount(column, c, len(langs))[column])
        units.append({g: i for i, g in enumerate(grams.dictionary.to_pylist())})
        logs.append(m)
    return LanguageModel(langs, units, logs)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", words_that_count: int = 20, cache_words: int = 200_000) -> DataFrame:
    """The input with columns `lang_pred` and `score` in place of any columns of these names.

    A text's languages are ranked by the mean over its words of `LanguageModel.row`; ties go to the language that
    sorts first. score: the winner's share when these means, taken as the log likelihood of at most
    `words_that_count` words, are normalised. `und` and score 0 where the text is null, has no letter, or the model
    has no language. The words of the whole text count. Repeated rows and empty tables need no care.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])

    def predict(batches):
        m = shared.value
        cache: dict[str, int] = {}
        rows = np.zeros((1024, len(m.langs)), np.float64)
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            sums, counts = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), np.int64)
            for t, text in enumerate(texts):
                for block in _words(text) if text and m.langs else ():
                    if len(cache) > cache_words:
                        cache.clear()
                    new = [w for w in set(block) if w not in cache]
                    if len(cache) + len(new) > len(rows):
                        rows = np.concatenate([rows, np.zeros((len(rows) + len(new), len(m.langs)))])
                    for w in new:
                        rows[len(cache)] = m.row(w)
                        cache[w] = len(cache)
                    sums[t] += rows[np.fromiter(map(cache.__getitem__, block), np.int64, len(block))].sum(axis=0)
                    counts[t] += len(block)
            best, score = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
            some = np.flatnonzero(counts)
            if len(some):
                mean = np.round(sums[some] / counts[some, None], 9)
                best[some] = mean.argmax(axis=1)
                power = np.log(10) * np.minimum(counts[some], words_that_count)[:, None]
                score[some] = 1 / np.exp((mean - mean.max(axis=1, keepdims=True)) * power).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(predict, f"{ddl}, lang_pred string, score double")


def fold(id_col: str, folds: int):
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds


def op9_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
