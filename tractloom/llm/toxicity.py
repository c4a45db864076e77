"""Toxicity by a linear classifier on character n-grams scaled with naive Bayes log-count ratios.

Features are the hashed n-grams of a text's distinct words, word ends marked, each scaled by the smoothed log ratio of its
share among toxic and among clean labelled texts. A logistic regression on them, divided by a power of the number of
distinct words, gives the score. The fit runs in one task on a bounded sample of labelled rows; scoring covers every text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, packed, quoted, ranges, words

FEATURES = 1 << 18
NGRAMS = (2, 3, 4, 5)
POWER = 0.5


def word_features(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word code, feature) of all n-grams of "<word>", repeats included."""
    text = "".join(f"\x01{w}\x02" for w in names)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.cumsum(np.concatenate([[0], code[:-1] == 2])) if len(code) else np.zeros(0, np.int64)
    rows, features = [], []
    key = np.zeros(len(code), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        key = (key[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + code[n - 1 :]
        if n in NGRAMS:
            inside = word[: len(key)] == word[n - 1 :]
            rows.append(word[: len(key)][inside])
            features.append((mixed(key[inside] + np.uint64(n << 56)) % np.uint64(FEATURES)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, word code) of each text's distinct lower-case words, and the words. Marks used at word ends are taken out."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "[\x01\x02]", " ")
    codes, offsets, names = words(plain, lower=False)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs = np.unique(row * max(1, len(names)) + codes)
    return pairs // max(1, len(names)), pairs % max(1, len(names)), names


def fit(texts: pa.Array, toxic: np.ndarray, smoothing: float = 1.0, penalty: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Feature weights, the ratio multiplied in, and the intercept at the end. One class only: the smoothed share for all."""
    row, code, names = distinct_words(texts)
    word, feature = word_features(names)
    n = len(toxic)
    size = np.maximum(1, np.bincount(row, minlength=n)).astype(float) ** POWER
    spread = lambda by_row: np.bincount(feature, np.bincount(code, by_row[row], len(names))[word], FEATURES)
    share = min(max(toxic.mean(), 0.5 / n), 1 - 0.5 / n) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    if n == 0 or toxic.min() == toxic.max():
        return np.concatenate([np.zeros(FEATURES), [bias]])
    bad, good = spread(toxic.astype(float)) + smoothing, spread(1.0 - toxic) + smoothing
    ratio = np.log(bad / bad.sum()) - np.log(good / good.sum())

    def loss(w):
        weights = ratio * w[:-1]
        z = np.bincount(row, np.bincount(word, weights[feature], len(names))[code], n) / size + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        value = np.mean(np.logaddexp(0, z) - toxic * z) + penalty * (w[:-1] @ w[:-1]) / 2
        back = (p - toxic) / n
        return value, np.concatenate([ratio * spread(back / size) + penalty * w[:-1], [back.sum()]])

    w = np.concatenate([np.zeros(FEATURES), [bias]])
    w = _descend(loss, w, steps)
    return np.concatenate([ratio * w[:-1], [w[-1]]])


def _descend(loss, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving."""
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, used = -slope.copy(), []
        for s, y, rho in reversed(past):
            used.append(a := rho * (s @ d))
            d -= a * y
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, rho), a in zip(past, reversed(used), strict=True):
            d += (a - rho * (y @ d)) * s
        length = 1.0 if past else min(1.0, 1 / (np.abs(slope).sum() + 1e-12))
        for _ in range(25):
            new, at = loss(w + length * d)
            if new <= value + 1e-4 * length * (slope @ d):
                break
            length /= 2
        else:
            break
        s, y = length * d, at - slope
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        if value - new < 1e-7 * max(1, abs(value)):
            return w + s
        w, value, slope = w + s, new, at
    return w


def score(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    row, code, names = distinct_words(texts)
    word, feature = word_features(names)
    size = np.maximum(1, np.bincount(row, minlength=len(texts))).astype(float) ** POWER
    by_word = np.bincount(word, model[feature], len(names)) if len(names) else np.zeros(0)
    z = np.bincount(row, by_word[code], len(texts)) / size + model[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(
    docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int = 8000, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic",
) -> np.ndarray:
    """Fit on the documents of at most max_rows labels (label 0 or 1, `allowed` holds), those first by a hash of the id.

    The sample is drawn from the labels before texts are touched, so only its texts move.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    marked = labels.filter(allowed).select(quoted(id_column).alias("k"), quoted(label_column).cast("int").alias("toxic"))
    marked = marked.filter(F.col("toxic").isin(0, 1) & F.col("k").isNotNull()).orderBy(F.xxhash64(F.col("k").cast("string")), "k", "toxic").limit(max_rows)
    texts = docs.select(quoted(id_column).alias("k"), quoted(text_column).alias("text"))
    sample = texts.join(marked, "k").orderBy("k", F.xxhash64("text")).limit(max_rows)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "text"], na_position="first")
        model = fit(pa.array(rows["text"], pa.string(), from_pandas=True), rows["toxic"].to_numpy())
        return pd.DataFrame({"model": [model.astype("<f4").tobytes()]})

    found = sample.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, StructType([StructField("model", BinaryType())])).collect()
    return np.frombuffer(found[0][0], "<f4").astype(float) if found else fit(pa.array([], pa.string()), np.zeros(0))


def toxicity(docs: DataFrame, model: np.ndarray, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Score between 0 and 1 of every text: `row` (struct of the carried columns), score, predicted (score >= 0.5).

    The whole text counts. Null and empty texts get the score of the intercept. Repeated rows are scored each; an empty table
    gives no rows. The model is a vector of fixed length, broadcast to the tasks.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    given = docs.select(packed(docs, carry).alias("row"), quoted(text_column).alias("text"))
    out = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())])
    schema, held = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(model.astype("<f4"))

    def run(batches):
        weights = held.value.astype(float)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score(b.column("text"), weights))], schema=schema)

    return given.mapInArrow(run, out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
