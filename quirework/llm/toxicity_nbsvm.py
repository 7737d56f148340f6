"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

An n-gram is a feature if it is in at least MIN_DOCS toxic documents of the
training rows and its share of toxic documents lies MIN_Z standard deviations
off the mean. Its value in a text is its log-count ratio where it occurs, else
zero; logistic regression with a quadratic penalty learns a weight for each.
Features are told by 32-bit hashes, so that in long texts, too, hardly any
occur by chance.

The model is fitted on max_rows labelled rows at most, the first by hash of
their id, and ids that many rows share last. Everything is scored, over whole texts.

Results for odd input: null and empty texts have no n-grams and get the score
of the intercept; rows whose label is null or whose id is held out teach
nothing; of several labels of one id the greatest counts; without labelled
rows of both kinds the score is the share of toxic rows seen, or zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import bounded, fields, held_out, load, map_rows, ngram_hashes, shared, staged, table

ORDERS = (3, 4, 5, 6, 8)
MAX_ROWS, MIN_DOCS, MIN_Z = 20_000, 5, 6.0
THRESHOLD = 0.3
STEPS, RATE, PENALTY = 300, 0.1, 1e-3


def hashes(text: str | None) -> np.ndarray:
    return ngram_hashes(f" {text.lower()} ", ORDERS) if text else np.empty(0, np.uint32)


class Lookup:
    """Which of a sorted array of hashes occur in a text. A bitmap turns most places away."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.near = np.zeros(1 << 20, bool)
        self.near[known >> np.uint32(12)] = True

    def __call__(self, text: str | None) -> np.ndarray:
        h = hashes(text)
        h = np.unique(h[self.near[h >> np.uint32(12)]])
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return at[self.known[at] == h] if len(self.known) else at[:0]


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most max_rows labelled rows that may be learnt from."""
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counted = documents.groupBy("doc_id").agg(F.count("*").alias("__n")).join(seen, "doc_id")
    return documents.select("doc_id", "text").join(bounded(counted, max_rows), "doc_id").select("text", "toxic")


def toxic_ngrams(rows: DataFrame) -> np.ndarray:
    """The hashes, in order, that at least MIN_DOCS toxic documents hold."""

    def start():
        def batch(rows: dict) -> dict:
            got = np.unique(np.concatenate([np.unique(hashes(t)) for t in rows["text"]]), return_counts=True)
            return {"h": got[0].astype(np.int64), "n": got[1]}

        return batch

    counts = map_rows(rows.where("toxic = 1"), ["text"], start, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= MIN_DOCS).select("h").toArrow()["h"].to_numpy().astype(np.uint32))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, ratios included, and intercept of logistic regression by Adam on all rows at once."""
    size = np.array([len(r) for r in rows])
    cols, of = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), size)
    w, m, v = np.zeros(len(ratio) + 1), 0.0, 0.0
    w[-1] = np.log(labels.mean() / (1 - labels.mean()))
    for step in range(1, STEPS + 1):
        score = np.bincount(of, (w[:-1] * ratio)[cols], len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        grad = np.append(np.bincount(cols, error[of], len(ratio)) * ratio / len(rows) + PENALTY * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1] * ratio, float(w[-1])


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Known hashes in order, the weight of each, and the intercept. max_rows bounds the rows that are learnt from."""
    rows = staged(training_rows(documents, labels, max_rows), "toxicity")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    none = np.empty(0, np.uint32), np.empty(0)
    if not (n.get(0) and n.get(1)):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return *none, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    known = toxic_ngrams(rows)
    held = shared(rows.sparkSession, known)

    def start():
        look = Lookup(load(held))
        return lambda rows: {"toxic": rows["toxic"], "at": [look(t) for t in rows["text"]]}

    found = map_rows(rows, ["text", "toxic"], start, "toxic int, at array<int>")
    pos, neg = np.zeros(len(known)), np.zeros(len(known))
    counts = found.select("toxic", F.explode("at").alias("at")).groupBy("at").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).toArrow()
    at = counts["at"].to_numpy()
    pos[at], neg[at] = counts["pos"].to_numpy(), counts["neg"].to_numpy()
    share = n[1] / (n[0] + n[1])
    every = np.maximum(pos + neg, 1)
    chosen = np.flatnonzero(np.abs(pos - every * share) / np.sqrt(every * share * (1 - share)) >= MIN_Z)
    if not len(chosen):
        return *none, float(np.log(share / (1 - share)))
    ratio = np.log((pos[chosen] + 1) / (n[1] + 2)) - np.log((neg[chosen] + 1) / (n[0] + 2))
    held_chosen = shared(rows.sparkSession, known[chosen])

    def again():
        look = Lookup(load(held_chosen))
        return lambda rows: {"toxic": rows["toxic"], "at": [look(t) for t in rows["text"]]}

    got = map_rows(rows, ["text", "toxic"], again, "toxic int, at array<int>").toArrow()
    weights, intercept = fit_weights([np.asarray(x, np.int64) for x in got["at"].to_pylist()], got["toxic"].to_numpy().astype(float), ratio)
    return known[chosen], weights, intercept


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row. The model has a weight for each hash, of which fit() finds a bounded number."""
    held = shared(documents.sparkSession, model)

    def start():
        known, weights, intercept = load(held)
        look = Lookup(known)

        def batch(rows: dict) -> dict:
            z = np.clip([intercept + weights[look(t)].sum() for t in rows["text"]], -500, 500)
            return {"doc_id": rows["doc_id"], "score": 1 / (1 + np.exp(-z))}

        return batch

    got = map_rows(documents, ["doc_id", "text"], start, fields(documents, ["doc_id"], "score double"))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
