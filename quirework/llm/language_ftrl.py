"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learnt from. The
regression is trained by follow-the-regularised-leader with elastic-net
penalties on max_rows of those rows at most, the first by hash of id; every
fifth of them is held back, and on these a temperature is fitted that
calibrates the scores. The max_langs most frequent languages are learnt, which
bounds the model; rows in rarer ones teach nothing.

Results for odd input: und with score zero if a text is null or has no letter (category L),
or if there was nothing to learn from; rows with a null lang teach nothing;
repeated rows are judged each for itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import bounded, fields, held_out, load, map_rows, ngram_hashes, shared, table

ORDERS, BITS = (1, 2, 3), 15
MAX_ROWS, MAX_LANGS = 4_000, 256
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-4


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a text in order, and how often each occurs."""
    total = np.bincount(ngram_hashes(f" {text.lower()} ", ORDERS) >> np.uint32(32 - BITS), minlength=1 << BITS) if text else np.zeros(1, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt((x**2).sum()), 1e-12)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and, for each bucket, of rows that hold it: fixed in size, summed by Spark."""

    def start():
        def batch(rows: dict) -> dict:
            df = np.zeros((1 << BITS) + 1, np.int64)
            for text in rows["text"]:
                df[counts(text)[0]] += 1
            df[-1] = len(rows["text"])
            at = np.flatnonzero(df)
            return {"at": at, "n": df[at]}

        return batch

    got = map_rows(rows, ["text"], start, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return int(out[-1]), out[:-1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, size: int) -> np.ndarray:
    z, n = np.zeros((classes, size)), np.zeros((classes, size))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels):
            za, na = z[:, at], n[:, at]
            w = weights(za, na)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            z[:, at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[:, at] = na + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What logits are divided by for the least log loss."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(documents: DataFrame, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, idf of each bucket, and weights divided by the temperature. max_rows bounds the rows of the regression, max_langs its classes."""
    rows = documents.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    langs = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect())
    rows = rows.where(F.col("lang").isin(langs)) if langs else rows
    n, df = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not langs:
        return langs, idf, np.zeros((0, 1 << BITS))
    counted = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("__n"))
    some = rows.join(bounded(counted, max_rows), "doc_id")
    held = shared(documents.sparkSession, idf)

    def start():
        idf = load(held)

        def batch(rows: dict) -> dict:
            got = [tf_idf(t, idf) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "lang": rows["lang"], "at": [a.astype("<u2").tobytes() for a, _ in got], "x": [x.astype("<f4").tobytes() for _, x in got]}

        return batch

    got = map_rows(some, ["doc_id", "lang", "text"], start, fields(some, ["doc_id"], "lang string, at binary, x binary"))
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "at", "x").toArrow().to_pydict()
    number = {k: i for i, k in enumerate(langs)}
    data = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for a, x in zip(got["at"], got["x"])]
    labels = [number[k] for k in got["lang"]]
    w = ftrl([d for i, d in enumerate(data) if i % 5], [y for i, y in enumerate(labels) if i % 5], len(langs), 1 << BITS)
    logits = np.array([w[:, at] @ x for at, x in data[::5]]).reshape(-1, len(langs))
    return langs, idf, w / temperature(logits, np.array(labels[::5]))


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row. The model's size is fixed by BITS and MAX_LANGS."""
    held = shared(documents.sparkSession, model)

    def start():
        langs, idf, weights = load(held)
        weights = weights.T.copy()

        def one(text: str | None) -> tuple[str, float]:
            if not text or not langs or not any(map(str.isalpha, text)):
                return "und", 0.0
            at, x = tf_idf(text, idf)
            p = softmax(x @ weights[at])
            best = int(np.argmax(p))
            return langs[best], float(p[best])

        def batch(rows: dict) -> dict:
            got = [one(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

        return batch

    got = map_rows(documents, ["doc_id", "text"], start, fields(documents, ["doc_id"], "lang_pred string, score double"))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, fit(documents))
