"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialize

#: Labelled documents to fit on, about; terms of the lexicon; documents a term must be in, and how sure its sign must be.
SAMPLE, TERMS, SEEN, SURE = 20_000, 400, 5, 4.0
#: Partitions that hold the labelled sample.
PARTS = 16
#: Lengths of word beginnings that are terms beside whole words.
STEMS = range(3, 8)
#: Trees and their depth.
TREES, DEPTH = 20, 4
#: Words between a term and a second person that is near it.
NEAR = 3
#: Words for the person spoken to, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
STAND_INS = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARK = re.compile(r"[^\w\s]")
_SHOUT = re.compile(r"[!?]")
# A match starts where its letters do, and neither letters nor marks give any back: no word is read more than once.
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[013457@$!|*]++[^\W\d_][\w@$!|*]*")
_STAND_IN = re.compile(r"[013457@$!|*][^\W\d_]")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
FEATURES = ["words", "terms", "weight", "strongest", "distinct", "near_you", "you", "capitals", "marks", "shouts", "mixed", "disguised", "drawn"]

Batches = Iterator[pa.RecordBatch]


def _terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _count(batches: Batches) -> Batches:
    """In how many of this task's documents each term is, and in how many toxic ones."""
    counts: Counter[tuple[str, int]] = Counter()

    def flush() -> pa.RecordBatch:
        term, toxic = zip(*counts, strict=True) if counts else ((), ())
        batch = pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "toxic", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts.update((t, toxic) for t in {t for w in set(_WORD.findall((text or "").lower())) for t in _terms(w)})
            if len(counts) > 500_000:
                yield flush()
    yield flush()


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """The terms that toxic documents of ``labelled`` (text, toxic) hold more often, with their log odds: at most ``TERMS``."""
    total = {r.toxic: r.c for r in labelled.groupBy("toxic").agg(F.count("*").alias("c")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    counts = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_count, "term string, toxic int, c long")
    a, b = (F.sum(F.when(F.col("toxic") == k, F.col("c")).otherwise(0)) for k in (1, 0))
    both = counts.groupBy("term").agg(a.alias("a"), b.alias("b")).where(F.col("a") >= SEEN)
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5) + 1 / (n1 - F.col("a") + 0.5) + 1 / (n0 - F.col("b") + 0.5))
    sure = both.select("term", odds.alias("odds"), (odds / error).alias("z")).where(F.col("z") >= SURE)
    return {r.term: r.odds for r in sure.orderBy(F.desc("z"), "term").limit(TERMS).collect()}


def _features(terms: dict[str, float]) -> Callable[[str | None], list[float]]:
    known: dict[str, float] = {}

    def weight(word: str) -> float:
        w = known.get(word)
        if w is None:
            if len(known) > 200_000:
                known.clear()
            w = known[word] = max((terms[t] for t in _terms(word) if t in terms), default=0.0)
        return w

    def features(text: str | None) -> list[float]:
        text = text or ""
        words = _WORD.findall(text.lower())
        n, chars = max(len(words), 1), max(len(text), 1)
        distinct = set(words)
        weights = {w: x for w in distinct if (x := weight(w)) > 0}
        hits = [k for k, w in enumerate(words) if w in weights] if weights else []
        you = [] if distinct.isdisjoint(SECOND_PERSON) else [k for k, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if hits and you:
            at = np.searchsorted(you, hits)
            near = sum(min((abs(you[j] - h) for j in (i - 1, i) if 0 <= j < len(you)), default=n) <= NEAR for i, h in zip(at.tolist(), hits, strict=True))
        mixed = _MIXED.findall(text) if _STAND_IN.search(text) else []
        disguised = sum(weight(m.lower().translate(STAND_INS).replace("*", "")) > 0 for m in mixed)
        return [
            math.log1p(len(words)),
            100 * len(hits) / n,
            sum(weights[words[k]] for k in hits) / math.sqrt(n),
            max(weights.values(), default=0.0),
            float(len(weights)),
            float(near),
            100 * len(you) / n,
            len(_CAPITAL.findall(text)) / chars,
            len(_MARK.findall(text)) / chars,
            len(_SHOUT.findall(text)) / chars,
            100 * len(mixed) / n,
            float(disguised),
            100 * len(_DRAWN.findall(text)) / n,
        ]

    return features


def featurize(docs: DataFrame, terms: dict[str, float]) -> DataFrame:
    """doc_id and the ``FEATURES`` of every whole text: densities of lexicon terms, their nearness to the person spoken to, capitals, punctuation and obfuscation."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Batches) -> Batches:
        features = _features(shared.value)
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", *[f"{f} double" for f in FEATURES]]))


@dataclass
class Model:
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    rate: float


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def grow(rows: DataFrame) -> GBTClassificationModel | None:
    """Trees on features with ``toxic``; none if the rows have fewer than two classes."""
    if rows.agg(F.countDistinct("toxic")).first()[0] < 2:
        return None
    trained = _vectors(rows.withColumn("label", F.col("toxic").cast("double")))
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=7).fit(trained)


def raw_scores(rows: DataFrame, trees: GBTClassificationModel | None) -> DataFrame:
    """label and p, the trees' own score, of features with ``toxic``; no rows without trees."""
    label = F.col("toxic").cast("double").alias("label")
    if trees is None:
        return rows.select(label, F.lit(0.0).alias("p")).limit(0)
    return trees.transform(_vectors(rows)).select(label, vector_to_array("probability")[1].alias("p"))


def fit(rows: DataFrame, apart: DataFrame) -> Model:
    """Fit trees on features with ``toxic``, and on ``apart`` (label, p), scores of trees that did not see the row, the curve from a score to a probability.

    With fewer than two classes among the rows the model is their rate, or 0 without any.
    """
    counts = {r.toxic: r.c for r in rows.groupBy("toxic").agg(F.count("*").alias("c")).collect()}
    rate = counts.get(1, 0) / max(sum(counts.values()), 1)
    trees = grow(rows)
    if trees is None or apart.agg(F.countDistinct("label")).first()[0] < 2:
        return Model(trees, None, rate)
    return Model(trees, IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(apart), rate)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, the calibrated probability; a thousandth of it is the trees' own, which orders what the curve holds equal."""
    if model.trees is None:
        return rows.withColumn("score", F.lit(model.rate))
    raw = model.trees.transform(_vectors(rows)).withColumn("p", vector_to_array("probability")[1])
    if model.curve is None:
        return raw.withColumn("score", F.col("p"))
    curve = model.curve.transform(raw)
    return curve.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("score") + 0.001 * F.col("p"))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The toxicity of every document of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic): doc_id, score.

    About ``SAMPLE`` labelled documents, picked by a hash of the doc_id, give the lexicon and the trees. The curve is set by
    scores that each half of them gets from a lexicon and trees of the other half, so no row is calibrated by what learned it.
    That sample, being bounded, is broadcast to the documents: no text is shuffled.
    A doc_id labelled both ways counts as toxic. Null and empty texts have features of 0 and are scored like others; rows
    that repeat are scored alike; without labels the score is 0; other columns are ignored.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = 1_000_000 if n <= SAMPLE else math.ceil(SAMPLE * 1e6 / n)
    sample = labels.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share)
    sample = materialize(sample.withColumn("half", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(2))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample is bounded, so few partitions hold it, however many the documents have; each pass of the trees starts a task for each.
    learned = materialize(docs.join(F.broadcast(sample), "doc_id").repartition(PARTS))
    scored = []
    for half in (0, 1):
        terms = lexicon(learned.where(F.col("half") != half).select("text", "toxic"))
        # Trees read their rows many times over: the features are taken once.
        rows = materialize(featurize(learned, terms).join(F.broadcast(sample), "doc_id"))
        scored.append(raw_scores(rows.where(F.col("half") == half), grow(rows.where(F.col("half") != half))))
    rows = materialize(featurize(docs, lexicon(learned.select("text", "toxic"))))
    model = fit(materialize(rows.join(F.broadcast(sample), "doc_id").repartition(PARTS)), scored[0].unionByName(scored[1]))
    return score(rows, model).select("doc_id", "score")
