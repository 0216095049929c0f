"""Quality rules: fixed rules, and gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (SAMPLE_ROWS, those with the smallest hashes),
flattened into numpy node arrays and scored a batch at a time. Some features carry monotonic constraints:
more symbols, repeats, duplicate lines or capitals never raise the score.

Defined results: a null text has no words, and so fails the base rules; rows are judged one by one, so
repeated rows get repeated results; several labels of one document count by their least; without labels
of both kinds the trees keep everything; an empty table gives an empty result; other columns are ignored
by judge() and kept by keep_good().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, map_rows, read, trimmed

SAMPLE_ROWS = 10_000
# Fixed values of the contract.
SYMBOLS = [ord(c) for c in "#*$%&|<>"]
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Share of repeated windows that very long clean texts reach by chance; the trees see what lies above.
CHANCE_REPEATS = 0.08
PUNCTUATION = [i for i in range(33, 127) if not chr(i).isalnum()]
#: name and sign of the constraint: the score never falls (+1), never rises (-1), or is free (0) as it grows
FEATURES = (
    ("word_length", 0),
    ("symbols_a_word", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("capital_share", -1),
    ("digit_share", -1),
    ("punctuation_a_word", -1),
    ("distinct_in_block", 0),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    size = len(numbers)
    if size**WINDOW < 2**63:
        key = ids[:n].copy()
        for k in range(1, WINDOW):
            key = key * size + ids[k : k + n]
    else:
        key = ids
        for k in range(1, WINDOW):  # ranks of windows one word longer each time
            _, key = np.unique(key[:-1] * size + ids[k:], return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def distinct_in_block(words: list[bytes], size: int = 100) -> float:
    """Mean share of distinct words over blocks: unlike the share in all, it doesn't fall with length. The last
    block is the last size words, and weighs as many of them as no block before has."""
    n = len(words)
    starts = [*range(0, n - size, size), max(n - size, 0)]
    shares = [len(set(b)) / max(len(b), 1) for b in (words[i : i + size] for i in starts)]
    new = [*(size for _ in starts[1:]), n - size * (len(starts) - 1)]
    return float(np.average(shares, weights=new)) if n else 0.0


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    word_chars = len(text) - int(hist[32] + hist[9:14].sum())
    symbols = int(hist[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines, repeats = len(lines) - len(set(lines)), repeat_words(words)
    letters = int(hist[65:91].sum() + hist[97:123].sum())
    m = max(n, 1)
    features = (
        word_chars / m,
        symbols / m,
        dup_lines / max(len(lines), 1),
        max(repeats / m - CHANCE_REPEATS, 0.0),
        int(hist[65:91].sum()) / max(letters, 1),
        int(hist[48:58].sum()) / max(word_chars, 1),
        int(hist[PUNCTUATION].sum()) / m,
        distinct_in_block(words),
    )
    return (n, word_chars, symbols, dup_lines, repeats), features


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth as node arrays: feature and threshold of inner nodes, leaf values."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.leaf) else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at[0:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += leaf[at - inner]
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on histograms; a constrained feature splits only where the
    children keep its order, and the bound between them is passed down."""
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 10.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    z = np.full(len(y), bias)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        leaf = np.zeros(leaves)
        for node in range(inner + leaves):
            rows = np.flatnonzero(at == node)
            low, high = bounds.get(node, (-np.inf, np.inf))
            if node >= inner:
                v = -g[rows].sum() / (h[rows].sum() + ridge)
                leaf[node - inner] = rate * min(max(v, low), high)
                continue
            best = (1e-6, None)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - total_g**2 / (total_h + ridge)
                ok = (hl >= least) & (hr >= least) & (signs[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, (vl[k] + vr[k]) / 2))
            left, right = (low, high), (low, high)
            if best[1]:
                j, k, middle = best[1]
                feature[node], threshold[node] = j, cuts[j][k]
                if signs[j] > 0:
                    left, right = (low, middle), (middle, high)
                elif signs[j] < 0:
                    left, right = (middle, high), (low, middle)
            bounds[2 * node + 1], bounds[2 * node + 2] = left, right
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        z += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), bias)


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of at most rows labelled documents; the driver gets numbers only. If an id that was drawn is
    on many rows, those of the smallest hashes of their text are taken, as many as rows too."""
    spark = docs.sparkSession
    of = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = of.orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(rows).toArrow()
    if not picked.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    few = spark.createDataFrame(picked)  # at most rows rows of two numbers: safe to broadcast
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(few), "doc_id").select("quality", "text", F.xxhash64("text").alias("k"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"quality": [int(q) for q in batch.column(0).to_pylist()], "x": [list(statistics(t)[1]) for t in batch.column(1).to_pylist()], "k": batch.column(2)}

        return work

    got = map_rows(texts, make, "quality int, x array<double>, k long").orderBy("k", "quality", "x").limit(rows).toArrow()
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return x, got["quality"].to_numpy().astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    x, y = labelled(docs, labels, sample_rows)
    order = np.lexsort([*x.T, y])  # rows come in any order; the fit must not depend on it
    return fit_trees(x[order], y[order], tuple(s for _, s in FEATURES))


JUDGED_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > REPEAT_PERCENT * n_words


def judge(docs: DataFrame, trees: Trees, least_score: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text): the statistics, whether the fixed rules fail, and the verdict."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            score = trees.score(np.array([x for _, x in found]))
            failed = np.array([base_failed(c[0], c[4]) for c, _ in found])
            out = {name: [c[k] for c, _ in found] for k, name in enumerate(COUNTS)}
            return out | {"doc_id": batch.column(0), "base_failed": failed, "kept": ~failed & (score >= least_score), "quality_score": score}

        return work

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, JUDGED_SCHEMA)


def keep_good(docs: DataFrame, trees: Trees, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that pass the fixed rules and the trees."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = [statistics(t) for t in batch.column(at).to_pylist()]
                score = trees.score(np.array([x for _, x in found]))
                good = [not base_failed(c[0], c[4]) and s >= least_score for (c, _), s in zip(found, score, strict=True)]
                yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 8: trees learnt from labels, every whole text of documents judged."""
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))
