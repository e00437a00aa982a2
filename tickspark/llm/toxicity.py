"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, small_batches

#: Buckets that terms are hashed into; the documented bounds of training: labelled rows, and buckets with a weight.
BUCKETS, TRAIN_ROWS, FEATURES, FACTORS = 1 << 20, 20_000, 2_048, 8
#: A term is a word of letters, or how it begins: word stems carry what endings hide.
PREFIXES = (4, 5, 6)
_WORDS = re.compile(r"[^\W\d_]+")
_CACHE = 200_000
#: Terms of the rows whose gradients are taken at a time.
STRETCH = 200_000


def term_buckets(word: str) -> set[int]:
    terms = {word, *(word[:k] + "-" for k in PREFIXES if len(word) >= k)}
    return {zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in terms}


def document_words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


@dataclass
class Model:
    """score = sigmoid(bias + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the buckets present."""

    index: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, present: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(p) for p in present])
        flat = np.array([i for p in present for i in p], np.int64)
        raw = np.full(len(present), self.bias)
        if len(flat):
            owner = np.repeat(np.arange(len(present)), sizes)
            v = self.factors[flat]
            total = np.zeros((len(present), self.factors.shape[1]))
            np.add.at(total, owner, v)
            raw += np.bincount(owner, self.weights[flat] - 0.5 * (v**2).sum(axis=1), len(present)) + 0.5 * (total**2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, buckets) of at most ``rows`` labelled documents outside the held-out fold.

    The sample is the ids with the smallest hashes, so reruns and any partitioning take the same; its bound makes
    it fit for a broadcast. Labels that are null or contradict each other are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    picked = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    met = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted(set().union(*map(term_buckets, document_words(t)))) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "buckets": found})

    return met.mapInPandas(run, "doc_id long, toxic int, buckets array<int>")


def select_buckets(rows: DataFrame, features: int = FEATURES) -> list[int]:
    """The buckets whose presence says most about the label, by chi-square over the whole training table."""
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    n, p = float(total["n"]), float(total["p"] or 0)
    if p in (0.0, n):
        return []
    seen, hit = F.col("n"), F.col("p")
    apart = hit * F.lit(n) - seen * F.lit(p)
    chi = F.try_divide(F.lit(n) * (apart / F.lit(n)) * (apart / F.lit(n)), seen * (F.lit(n) - seen) * F.lit(p) / F.lit(n) * F.lit(n - p) / F.lit(n))
    counts = rows.select(F.explode("buckets").alias("bucket"), "toxic").groupBy("bucket").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("p"))
    best = counts.where("n >= 3").select("bucket", chi.alias("chi")).where("chi > 6").orderBy(F.desc("chi"), "bucket").limit(features)
    return [r["bucket"] for r in best.collect()]


def fit(rows: DataFrame, features: int = FEATURES, factors: int = FACTORS, epochs: int = 120, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Trains on what ``training_rows`` gives; the driver sees only labels and chosen buckets of that bounded sample.

    Without both labels the score is the smoothed share of label 1 for every text.
    """
    rows = cut(rows)
    chosen = select_buckets(rows, features)
    index = {b: i for i, b in enumerate(chosen)}
    count = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    share = ((count["p"] or 0) + 1) / (count["n"] + 2)
    if not chosen:
        return Model({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    known = rows.sparkSession.sparkContext.broadcast(index)

    def present(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [[known.value[b] for b in bs if b in known.value] for bs in pdf["buckets"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "b": own})

    table = rows.mapInPandas(present, "doc_id long, toxic int, b array<int>").orderBy("doc_id").toArrow().combine_chunks()
    y = table.column("toxic").to_numpy().astype(float)
    lists = table.column("b").combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    item, owner = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(y)), np.diff(bounds))
    del table, lists
    # Gradients are added up over stretches of rows, so that the driver holds one stretch's factors at a time.
    cuts = [0]
    while cuts[-1] < len(y):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bounds, bounds[cuts[-1]] + STRETCH, "right")) - 1))
    rng = np.random.default_rng(11)
    w, v, bias = np.zeros(len(index)), rng.normal(0, 0.01, (len(index), factors)), float(np.log(share / (1 - share)))
    weight = np.where(y == 1, min(5.0, (1 - share) / share), 1.0)
    weight /= weight.mean()
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0]
    for t in range(1, epochs + 1):
        gw, gv, gb = decay * w, decay * v, 0.0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            some = slice(bounds[lo], bounds[hi])
            of, what = owner[some] - lo, item[some]
            own = v[what]
            total = np.stack([np.bincount(of, own[:, f], hi - lo) for f in range(factors)], axis=1)
            raw = bias + np.bincount(of, w[what] - 0.5 * (own**2).sum(axis=1), hi - lo) + 0.5 * (total**2).sum(axis=1)
            slope = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[lo:hi]) / len(y)
            each = slope[of]
            gw += np.bincount(what, each, len(w))
            pull = each[:, None] * (total[of] - own)
            gv += np.stack([np.bincount(what, pull[:, f], len(w)) for f in range(factors)], axis=1)
            gb += float(slope.sum())
        for k, (value, g) in enumerate(((w, gw), (v, gv), (None, gb))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * g**2
            step = rate * (moments[2 * k] / (1 - 0.9**t)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**t)) + 1e-8)
            if value is None:
                bias -= float(step)
            else:
                value -= step
    return Model(index, bias, w, v)


def held_out(doc_id: Column) -> Column:
    """The fold that training never reads: crc32 of the id's text divisible by 5 (a null id is not in it)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_score(spark: SparkSession, model: Model, text: Column) -> Column:
    """A column with the score of each whole text; null and empty texts get the score of no terms."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        cache: dict[str, tuple[int, ...]] = {}
        for texts in parts:
            present = []
            for t in texts:
                found: set[int] = set()
                for word in document_words(t):
                    got = cache.get(word)
                    if got is None:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        got = cache[word] = tuple(own.index[b] for b in term_buckets(word) if b in own.index)
                    found.update(got)
                present.append(sorted(found))
            yield pd.Series(own.score(present), dtype="float64")

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, score: str = "toxic_score", predicted: str = "toxic_predicted") -> DataFrame:
    """``docs`` with two columns, ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` and above); older ones of these names go.

    Trained on labels outside the held-out fold; the score reads the text alone. Null and empty texts have the score
    of no terms; rows that repeat are scored alike; a null doc_id is only never trained on; other columns stay as
    they are; an empty table gives an empty one, and without labels of both kinds the score is one share for all.
    """
    model = fit(training_rows(docs, labels))
    scored = docs.withColumn(score, toxicity_score(docs.sparkSession, model, F.col("text").cast("string")))
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``, with the columns it came with, whatever their names."""
    model = fit(training_rows(docs, labels))
    return docs.where(toxicity_score(docs.sparkSession, model, F.col("text").cast("string")) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


ORACLES: dict[str, str] = {}
QUERIES = {"op6_toxicity": op6_toxicity}
