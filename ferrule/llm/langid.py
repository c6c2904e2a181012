"""Language identification by known words, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import materialize

#: Bounds of the model, each for one language: labelled documents it is fitted on, and words and n-grams of each length that are kept.
SAMPLE, WORDS, GRAMS = 5_000, 20_000, 5_000
#: Longest n-gram; what is added to every count; and words beyond which more text makes a score no surer.
LONGEST, SMOOTH, SURE = 4, 0.5, 20
UNDETERMINED = "und"
_TOKEN = re.compile(r"[^\W\d_]+")

Batches = Iterator[pa.RecordBatch]


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Batches) -> Batches:
    """Words and n-grams of this task's documents by language; n is 0 for words."""
    counts: Counter[tuple[str, int, str]] = Counter()

    def flush() -> pa.RecordBatch:
        words: Counter[tuple[str, int, str]] = Counter()
        for (lang, _, word), c in counts.items():
            for n in range(1, LONGEST + 1):
                for gram in _grams(word, n):
                    words[lang, n, gram] += c
        words.update(counts)
        counts.clear()
        lang, n, gram = zip(*words, strict=True) if words else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "n", "gram", "c"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for word, c in Counter(_TOKEN.findall((text.as_py() or "").lower())).items():
                counts[lang, 0, word] += c
        if len(counts) > 50_000:
            yield flush()
    yield flush()


@dataclass
class Model:
    """Languages in order, and the kept grams with their log frequencies, as far as they exceed those of a gram that a language never had.

    ``index`` has, for each n (0: whole words), the row of every gram; row r has the entries ``first[r]`` to ``first[r + 1]`` of
    ``column``, languages, and ``excess``. ``base`` has for each n the log frequencies of an unseen gram. So the size of the
    model is that of what is kept, whatever the number of languages.
    """

    languages: list[str]
    index: list[dict[str, int]]
    first: np.ndarray
    column: np.ndarray
    excess: np.ndarray
    base: np.ndarray

    def scorer(self) -> Callable[[str | None], tuple[str, float]]:
        first, column, excess, base, n_languages = self.first, self.column, self.excess, self.base, len(self.languages)

        @lru_cache(1 << 13)
        def unseen(word: str) -> tuple[int, list[int]]:
            """The longest n of which the model knows n-grams of the word, and their rows."""
            for n in range(LONGEST, 0, -1):
                known = self.index[n]
                if rows := [known[g] for g in _grams(word, n) if g in known]:
                    return n, rows
            return 0, []

        def score(text: str | None) -> tuple[str, float]:
            tokens = _TOKEN.findall((text or "").lower())
            if not self.languages or not any(c.isalpha() for w in tokens for c in w):
                return UNDETERMINED, 0.0
            rows: list[int] = []
            weights: list[float] = []
            by_n = [0.0] * (LONGEST + 1)
            known = self.index[0]
            for word, c in Counter(tokens).items():
                i = known.get(word)
                if i is not None:
                    rows.append(i)
                    weights.append(c)
                    by_n[0] += c
                else:
                    n, found = unseen(word)
                    if found:
                        rows += found
                        weights += [c / len(found)] * len(found)
                        by_n[n] += c
            at = np.array(rows, np.int64)
            sizes = first[at + 1] - first[at]
            entries = np.arange(sizes.sum()) + np.repeat(first[at] - np.cumsum(sizes) + sizes, sizes)
            total = np.array(by_n) @ base + np.bincount(column[entries], np.repeat(np.array(weights), sizes) * excess[entries], n_languages)
            mean = total / len(tokens) * min(len(tokens), SURE)
            odds = np.exp(mean - mean.max())
            best = int(odds.argmax())
            return self.languages[best], float(odds[best] / odds.sum())

        return score


def _frequent(counts: DataFrame) -> DataFrame:
    """Of each language the most frequent words, ``WORDS`` of them, and n-grams of each length, ``GRAMS``; about as many where the last ones tie.

    What ranks is the histogram of the counts, which has few rows: it gives the count from which on grams are kept, and of
    those with just that count the share, which a hash picks. So no task ever sorts a language.
    """
    key = ["lang", "n"]
    levels = counts.groupBy(*key, "c").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*key).orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    most = F.when(F.col("n") == 0, WORDS).otherwise(GRAMS)
    share = F.when(F.col("before") < most, F.least(F.lit(1.0), (most - F.col("before")) / F.col("size")))
    cuts = levels.withColumn("share", share).where("share is not null").groupBy(*key).agg(F.min_by("share", "c").alias("share"), F.min("c").alias("least"))
    picked = F.pmod(F.xxhash64("gram"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    joined = counts.join(F.broadcast(cuts), key)  # a row for each language and n
    return joined.where((F.col("c") > F.col("least")) | ((F.col("c") == F.col("least")) & picked)).select(*key, "gram", "c")


def fit(labelled: DataFrame) -> Model:
    """Fit on documents (doc_id, text, lang), about ``SAMPLE`` of every language at most, picked by a hash of the doc_id.

    Counts are summed by Spark; only the most frequent words and n-grams of each language, bounded numbers of them, come
    to the driver. Every language that a document is labelled with is learned, however rare. Rows with null text or lang are
    not learned from; rows that repeat count as often; without rows the model knows no language.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < F.ceil(SAMPLE * 1e6 / F.col("size"))
    sample = labelled.join(F.broadcast(sizes), "lang").where(drawn)  # a row for each language
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, n int, gram string, c long")
    counts = materialize(counts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    rows = _frequent(counts).collect()
    languages = sorted({r.lang for r in rows})
    column = {lang: k for k, lang in enumerate(languages)}
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    rows.sort(key=lambda r: (r.n, r.gram, r.lang))
    first: list[int] = []
    sums = np.zeros((LONGEST + 1, len(languages)))
    for k, r in enumerate(rows):
        if r.gram not in index[r.n]:
            index[r.n][r.gram] = len(first)
            first.append(k)
        sums[r.n, column[r.lang]] += r.c
    grams = np.array([[max(len(x), 1)] for x in index])
    base = np.log(SMOOTH) - np.log(sums + SMOOTH * grams)
    excess = np.log(np.array([r.c for r in rows], np.float64) + SMOOTH) - np.log(SMOOTH)
    return Model(languages, index, np.array([*first, len(rows)], np.int64), np.array([column[r.lang] for r in rows], np.int64), excess, base)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score, the posterior of that language, to all columns of ``docs`` that are not named so.

    The whole text counts. ``und`` with score 0 stands for null text, text without a letter, and any text if the model knows
    no language. Equal scores go to the language first in code-point order. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Batches) -> Batches:
        score = shared.value.scorer()
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, of which ``model`` knows the language: not ``und``, and a score of ``least`` or more.

    Null and empty texts go, as do texts without a letter; a null doc_id is kept like any other; rows that repeat stay or go
    together; an empty table stays empty; columns of any name are kept, for none is added.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        score = shared.value.scorer()
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for null."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % folds
