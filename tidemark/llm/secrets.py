"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two order-2 character models are trained on labelled samples: random strings (keys, digests, tokens)
and ordinary identifiers. What spans of the fixed patterns leave of a token of the text is a span of kind
"markov" if its mean log-likelihood ratio exceeds the threshold; else each of its parts between delimiters
that does, and each stretch of it that exceeds the threshold for the best stretch of an identifier.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so repeated
rows give repeated results and ties can't arise; a null doc_id is kept; an empty table gives an empty
result; other columns of the input are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import bounded_batches, map_rows, read, trimmed

# Fixed values of the contract: the three base patterns and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ with the short ones dropped
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "markov")
LEAST = 8  # characters that a candidate or a part of it can have at all: fewer can't bring ODDS together
STRETCH = 20  # characters of a stretch inside a longer string
ODDS = 16.0  # nats against a string being a secret, before its characters are read
WORD_ODDS = 30.0  # against one that has the form of a word: letters of one case, but the first
WORD_FORM = re.compile("[A-Za-z]?(?:[a-z]+|[A-Z]+)")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART = re.compile(rf"[A-Za-z0-9]{{{LEAST},}}")
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")  # a name, not a secret

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET) + 1  # and one symbol for the start of a string
CODE = np.zeros(128, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, N)

# Ordinary words, of which the default negative samples are made.
WORDS = """get set is has read write load save open close file path name user item list map key value index count
size type data base table column row query result error message code state status config option param request
response server client session cache buffer stream batch job task worker thread event handler factory manager
service controller provider builder parser format encode decode convert update delete insert select create remove
find search match filter sort group merge split join start stop run test check valid default max min sum average
time date year month day hour minute second image video audio text document page site link http www com net org
html index article news world house water people number about other their there which would could first after
great place right small every found those never under might while along next hard life always both paper often
information international development environment government university management organization straight through
nicht eine einen werden wurde haben sein durch zwischen geschwindigkeit verantwortung gesellschaft entwicklung
avec dans pour cette comme mais tout plus entre gouvernement developpement connaissance para como pero desde
sobre entre cuando tambien informacion desarrollo gobierno conocimiento""".split()
PLATFORM = """x86_64 amd64 arm64 aarch64 i686 pc linux gnu musl unknown toolchain darwin windows msvc apple none eabi armv7 riscv64 utf8 utf-16 sha256
md5 base64 http2 ipv4 ipv6 mp3 mp4 h264 x264 rgb24 int32 uint64 float32 py3 cp313 manylinux2014 stable nightly rc1 beta2 jdk17 gcc12 clang18""".split()
SEQUENCES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "qwertyuiopasdfghjklzxcvbnm", "QWERTYUIOPASDFGHJKLZXCVBNM", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Default labelled samples, made from a seed: (string, 1) for random ones, (string, 0) for identifiers."""
    rng = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", lower + digits, upper + digits, "0123456789abcdef", "0123456789ABCDEF"]
    out = []
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(alphabets), k=rng.randint(10, 64))), 1))
        words = rng.choices(WORDS, k=rng.randint(1, 7))
        style = rng.randrange(10)
        if style == 0:
            s = "_".join(words)
        elif style == 1:
            s = "-".join(words)
        elif style == 2:
            s = "".join(w.title() for w in words)
        elif style == 3:
            s = words[0] + "".join(w.title() for w in words[1:])
        elif style == 4:
            s = "/" + "/".join(words)
        elif style == 5:
            s = "".join(words)
        elif style == 6:  # numbers, dates, addresses
            s = rng.choice(["", "-", "/"]).join(str(rng.randrange(10 ** rng.randint(1, 8))) for _ in range(rng.randint(2, 8)))
        elif style == 7:
            s = rng.choice("-_").join(rng.choices(PLATFORM, k=rng.randint(2, 5)) + words[: rng.randint(0, 2)])
        elif style == 8:
            run = rng.choice(SEQUENCES) * 2
            k = rng.randrange(len(run) // 2)
            s = run[k : k + rng.randint(8, 40)]
        else:
            s = "_".join(words).upper()
        if rng.random() < 0.3:
            s += rng.choice(["_", "-", "/", ""]) + str(rng.randint(0, 9999))
        if rng.random() < 0.1:
            s = rng.choice(["2019-04-12", "20240131", "v1", "000000000000", "1234567890"]) + "-" + s
        if rng.random() < 0.05:
            s = rng.choice("=-_/0") * rng.randint(20, 60)
        out.append((s, 0))
    return out


def _codes(s: str) -> np.ndarray:
    return CODE[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]


@dataclass(frozen=True)
class MarkovPair:
    """ratio[a, b, c]: log P(c | a, b, random) - log P(c | a, b, identifier)."""

    ratio: np.ndarray
    threshold: float
    inner: float = np.inf  # the threshold of stretches inside a string

    def ratios(self, s: str) -> np.ndarray:
        x = np.concatenate([[0, 0], _codes(s)])
        return self.ratio[x[:-2], x[1:-1], x[2:]]

    def score(self, s: str) -> float:
        return float(self.ratios(s).mean())

    def stretch_scores(self, s: str) -> np.ndarray:
        """The mean over each stretch of STRETCH characters, by its start."""
        sums = np.concatenate([[0.0], np.cumsum(self.ratios(s))])
        return (sums[STRETCH:] - sums[:-STRETCH]) / STRETCH

    def is_secret(self, s: str) -> bool:
        """A mean log-likelihood ratio over the threshold and a sum over the odds, which asks the more of a character the
        fewer there are."""
        return self.decides(s, self.score(s) * len(s))

    def decides(self, s: str, total: float) -> bool:
        return total > self.threshold * len(s) and total > ODDS and (total > WORD_ODDS or not WORD_FORM.fullmatch(s))

    def running(self, text: str) -> np.ndarray:
        """Sums of the ratios of a text's characters, each candidate being a string of its own."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        x = np.concatenate([[0, 0], np.where(raw < 128, CODE[np.minimum(raw, 127)], 0)])
        one = x[1:-1]
        return np.concatenate([[0.0], np.cumsum(self.ratio[np.where(one == 0, 0, x[:-2]), one, x[2:]])])

    def secrets_in(self, s: str) -> list[tuple[int, int]]:
        """The whole of s if it is a secret, else the parts and stretches that are, these to the delimiters around them."""
        if len(s) < LEAST:
            return []
        if self.is_secret(s) and not UUID.search(s):
            return [(0, len(s))]
        if UUID.search(s):
            return _joined([(a + x, a + y) for a, b in _outside([m.span() for m in UUID.finditer(s)], len(s)) for x, y in self.secrets_in(s[a:b])])
        found = [m.span() for m in PART.finditer(s) if m.end() - m.start() < len(s) and self.is_secret(m.group())]
        cuts = [-1, *(i for i, c in enumerate(s) if c in "+/_=-"), len(s)]
        end = 0
        for a in np.flatnonzero(self.stretch_scores(s) > self.inner).tolist():
            if a + STRETCH > end:
                start, end = cuts[bisect_left(cuts, a + 1) - 1] + 1, cuts[bisect_left(cuts, a + STRETCH)]
                found.append((start, end))
        return _joined(found)


def _outside(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """What spans, in order, leave of size characters."""
    return list(zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), size], strict=True))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _log_model(strings: list[str], smoothing: float) -> np.ndarray:
    """Order-2 model, each context backed off to the order-1 model and that to the order-0 model."""
    three = np.zeros((N, N, N))
    for s in strings:
        x = np.concatenate([[0, 0], _codes(s)])
        np.add.at(three, (x[:-2], x[1:-1], x[2:]), 1)
    two, one = three.sum(0), three.sum((0, 1))
    p0 = (one + 0.5) / (one.sum() + 0.5 * N)
    p1 = (two + smoothing * p0) / (two.sum(-1, keepdims=True) + smoothing)
    return np.log((three + smoothing * p1) / (three.sum(-1, keepdims=True) + smoothing))


def train(samples: list[tuple[str, int]] | None = None, smoothing: float = 20.0, quantile: float = 0.995) -> MarkovPair:
    """Fits both models on all samples but each fifth; the threshold is the given quantile of the
    held-out identifiers' scores, and at least 0.25 nats a character. For stretches it is that quantile of
    the held-out identifiers' best stretches, and at least 1 nat, as it is the best of many."""
    samples = labelled_samples() if samples is None else samples
    fit, held = [x for i, x in enumerate(samples) if i % 10 > 1], [x for i, x in enumerate(samples) if i % 10 <= 1]
    models = [_log_model([s for s, y in fit if y == k], smoothing) for k in (0, 1)]
    pair = MarkovPair(models[1] - models[0], 0.0)
    scores = [pair.score(s) for s, y in held if not y and s]
    threshold = max(0.25, float(np.quantile(scores, quantile)) if scores else 0.25)
    best = [float(pair.stretch_scores(s).max()) for s, y in held if not y and len(s) >= STRETCH]
    return MarkovPair(pair.ratio, threshold, max(1.0, float(np.quantile(best, quantile)) if best else 1.0))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, model: MarkovPair) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    taken = _joined([(a, b) for a, _, b in base])
    more, k, sums = [], 0, None
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if end - a < STRETCH and m[0].isalnum() and (k >= len(taken) or end <= taken[k][0]):  # a word, most often: no part, no stretch
            sums = model.running(text) if sums is None else sums
            if model.decides(m[0], sums[end] - sums[a]):
                more.append((a, 3, end))
            continue
        free, i = [], k
        while i < len(taken) and taken[i][0] < end:
            free.append((a, taken[i][0]))
            a, i = taken[i][1], i + 1
        for a, b in [*free, (a, end)]:
            more += [(a + x, 3, a + y) for x, y in model.secrets_in(text[a:b])]
    return base, sorted(base + more) if more else base


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long, n_secret_chars long"


def scan(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): counts by kind and all spans. One pass, no shuffle."""
    model = model or train()

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k.split()[0]: [] for k in SCAN_SCHEMA.split(", ")}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", model)
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    out[n].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
                out["spans"].append(_written(spans))
                out["n_markov"].append(len(spans) - len(base))
                end = n = 0
                for a, _, b in spans:
                    n, end = n + max(0, b - max(a, end)), max(end, b)
                out["n_secret_chars"].append(n)
            return out

        return work

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, SCAN_SCHEMA)


def redact(docs: DataFrame, model: MarkovPair | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns as they are, each secret span of text replaced by mark and n_chars (if there)
    set to the new length. Overlapping spans become one mark."""
    model = model or train()
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at_text, at_n = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            columns, texts, changed = list(batch.columns), batch.column(at_text).to_pylist(), {}
            for i, text in enumerate(texts):
                spans = all_spans(text, model)[1] if text else []
                if spans:
                    parts, end, done = [], 0, 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [text[done:a], mark]
                        end = done = max(end, b)
                    texts[i] = "".join(parts) + text[done:]
                    changed[i] = len(texts[i])
            if changed:
                columns[at_text] = pa.array(texts, columns[at_text].type)
                if at_n is not None:
                    n = columns[at_n].to_pylist()
                    columns[at_n] = pa.array([changed.get(i, x) for i, x in enumerate(n)], columns[at_n].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 1: every whole text of documents."""
    return scan(read(spark, sf_dir, "documents"))
