"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1-, 2- and 3-grams of the lower-cased text, every run of characters that aren't
letters counting as one space. Document frequencies are gathered over all training rows. The weights
are trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
rows (SAMPLE_ROWS, the rows with the smallest hashes), and a temperature is fitted on part of that
sample which the weights have not seen.

Defined results: a null text or one without a letter is "und" with score 0, as is everything when there
is nothing to learn from; rows are judged one by one, so repeated rows get repeated results; ties go to
the language first in order; a null doc_id is never learnt from, and counts as not held out; an empty
table gives an empty result; other columns are ignored by predict() and kept by keep_known().
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, map_rows, read, trimmed

FEATURES = 1 << 15
SAMPLE_ROWS = 3000
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(text: str) -> np.ndarray:
    """The features of a text, one for each place and length 1 to 3."""
    x = np.frombuffer(NOT_LETTERS.sub(" ", text.lower()).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        one = x * np.uint64(0x9E3779B97F4A7C15)
        parts = [one]
        if len(x) > 1:
            two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[1:] * np.uint64(0x94D049BB133111EB)
            parts.append(two)
        if len(x) > 2:
            parts.append((two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + x[2:] * np.uint64(0xD6E8FEB86659FD93))
        return (np.concatenate(parts) >> np.uint64(49)).astype(np.int64)


def counts_of(text: str) -> np.ndarray:
    return np.bincount(grams(text), minlength=FEATURES)


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # features x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        counts = counts_of(text)
        at = np.flatnonzero(counts)
        x = counts[at] * self.idf[at]
        return x @ self.weights[at] / max(np.sqrt((x * x).sum()), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, max(0.0, p[k])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with a letter, and in how many of them each feature is: over all rows, summed by Spark.

    The driver gets one row for each of the FEATURES + 1 places at most.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        seen = np.zeros(FEATURES + 1, dtype=np.int8)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and has_letter(text):
                    at = grams(text)
                    seen[at], seen[FEATURES] = 1, 1
                    total += seen
                    seen[at] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["f", "n"])

    sums = docs.select("text").mapInArrow(trimmed(run), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    df[sums["f"].to_numpy()] = sums["n"].to_numpy()
    return int(df[FEATURES]), df[:FEATURES]


def sampled(docs: DataFrame, rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, features, counts) of the rows with the smallest hashes; features are counted by executors."""
    key = F.xxhash64(F.col("doc_id"), F.lit(17))
    picked = docs.select("doc_id", "lang", "text").withColumn("k", key)
    total = docs.count()
    if total > 2 * rows:  # a first cut by the hash's range, so that only about twice the rows are ordered
        picked = picked.where(F.col("k") < -(2**63) + 2**64 * 2 * rows // total)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"lang": batch.column(1), "k": batch.column(3), "at": [], "n": []}
            for text in batch.column(2).to_pylist():
                counts = counts_of(text) if text and has_letter(text) else np.zeros(1, dtype=np.int64)
                at = np.flatnonzero(counts)
                out["at"].append(at.astype("<i4").tobytes())
                out["n"].append(counts[at].astype("<i4").tobytes())
            return out

        return work

    table = map_rows(picked, make, "lang string, k long, at binary, n binary").orderBy("k", "lang", "at").limit(rows).toArrow()
    found = [(x["lang"], np.frombuffer(x["at"], "<i4"), np.frombuffer(x["n"], "<i4")) for x in table.to_pylist()]
    return [x for x in found if len(x[1])]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> LanguageModel:
    """Learns from docs (doc_id, text, lang), rows of null lang or doc_id aside."""
    docs = docs.where("lang is not null and doc_id is not null")
    n, df = document_frequencies(docs)
    sample = sampled(docs, sample_rows)
    labels = tuple(sorted({x[0] for x in sample}))
    idf = (np.log((1 + n) / (1 + df)) + 1.0) if n else np.ones(FEATURES)
    w = np.zeros((FEATURES + 1, len(labels)))
    if len(labels) < 2:
        return LanguageModel(labels, w[:-1], w[-1], idf, 1.0)
    rows = []
    for lang, at, counts in sample:
        x = counts * idf[at]
        rows.append((labels.index(lang), np.append(at, FEATURES), np.append(x / np.sqrt((x * x).sum()), 1.0)))
    train = [r for i, r in enumerate(rows) if i % 5]
    held = [r for i, r in enumerate(rows) if not i % 5]
    z, s = np.zeros_like(w), np.zeros_like(w)
    for _ in range(epochs):
        for y, at, x in train:
            za, sa = z[at], s[at]
            step = (beta + np.sqrt(sa)) / alpha + l2
            wa = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / step)
            p = softmax(x @ wa)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(sa + g * g) - np.sqrt(sa)) / alpha
            z[at] = za + g - sigma * wa
            s[at] = sa + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))
    return LanguageModel(labels, w[:-1], w[-1], idf, temperature([(y, x @ w[at]) for y, at, x in held]))


def temperature(held: list[tuple[int, np.ndarray]]) -> float:
    """The divisor of the logits that makes the held-out labels most likely, by golden section."""
    if not held:
        return 1.0
    y, z = np.array([k for k, _ in held]), np.array([v for _, v in held])

    def loss(log_t: float) -> float:
        return float(-np.log(softmax(z / np.exp(log_t))[np.arange(len(y)), y] + 1e-12).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of docs (doc_id, text): lang_pred and its calibrated probability."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

        return work

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least_score: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known with least_score at least."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                lang, score = model.predict(text)
                good.append(lang != UNKNOWN and score >= least_score)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def held_out() -> F.Column:
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 10: learns from rows that aren't held out, predicts every whole text."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
