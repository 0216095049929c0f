"""Language-model scoring by prediction by partial matching, beside a smoothed unigram score.

The model is a trie of byte contexts up to ORDER bytes, counted over all training documents. A symbol (a byte,
or the end of the text) is looked for in the longest context; where that has not seen it, an escape is paid
(method C: as many escapes as distinct symbols) and the next shorter context is asked, without the symbols
that the longer one could have given. Last comes an even share among symbols never seen. Texts begin in a
context of start marks.

Nothing of the model is broadcast but its first two orders (66,049 counts at most), and its size has no bound.
Rows of documents are gathered into chunks of some CHUNK_BYTES (whole documents), written once; a chunk asks once
for each of its distinct ORDER + 1 grams and words, and says how often its training documents hold it. Grams are
dealt by the last two bytes of their contexts, so that all longer contexts of a branch of the trie are together
(at most 257 ** 3 entries): a task adds up, and gives each gram the log of its probability. Words are added up by a
window over equal words. The answers go back to their chunks, where documents are scored.

Defined results: a null text is empty; the empty text is scored for its end; a null doc_id is held out from
training and reported as such; repeated rows are learnt from and scored each; without anything to learn from, all
counts are 0, score shares evenly among 257 symbols, and base_score too is log10(0.1 / 0.1) a token, so 0; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, bounded_batches, let_go, read, tidied, trimmed, written

ORDER = 4
CHUNK_BYTES = 16 << 20
#: Entries of a row that lists what a chunk asks for.
LISTED = 1 << 16
#: Grams that a task computes at a time, to the end of a branch.
HELD = 1 << 20
SYMBOLS = 257  # 0: start before a text, end after it; then bytes
BITS = 9
DENSE = 1 << 24
PIECE_BYTES = 4 << 20


def held_out() -> Column:
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"), F.lit(True))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes, only A-Z


# --- grams ---


def dense(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes (below size) in order, and each one's place among them."""
    if size > DENSE:
        distinct, place = np.unique(codes, return_inverse=True)
        return distinct, place
    seen = np.zeros(size, bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(size, np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[codes]


#: (number of its text, the symbols before it, bytes, whether the text ends with it).
Piece = tuple[int, list[int], bytes, bool]


def pieces(texts: list[bytes], order: int) -> Iterator[list[Piece]]:
    """Texts as lists of pieces of some PIECE_BYTES together."""
    now, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), PIECE_BYTES):
            head = [0] * max(0, order - a) + [b + 1 for b in t[max(0, a - order) : a]]
            now.append((i, head, t[a : a + PIECE_BYTES], a + PIECE_BYTES >= len(t)))
            size += len(now[-1][2])
            if size >= PIECE_BYTES:
                yield now
                now, size = [], 0
    if now:
        yield now


def grams(parts: list[Piece], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams (order symbols before, and the symbol, BITS each) in order, the place among them of each
    symbol, ends of texts included, and where each piece begins in those."""
    sizes = np.array([len(t) + last for _, _, t, last in parts])
    starts = np.cumsum(sizes) - sizes
    begins = np.cumsum(sizes + order) - sizes  # behind the symbols before
    where = np.arange(int(sizes.sum())) + np.repeat(begins - starts, sizes)
    stream = np.zeros(int((sizes + order).sum()), np.int64)
    letters = np.ones(len(where), bool)
    letters[(starts + sizes - 1)[[last for *_, last in parts]]] = False
    stream[where[letters]] = np.frombuffer(b"".join(t for _, _, t, _ in parts), np.uint8).astype(np.int64) + 1
    for j in range(order):
        stream[begins - order + j] = [head[j] for _, head, _, _ in parts]
    symbols, codes = dense(stream, SYMBOLS)
    n = len(stream) - order
    names, place = symbols, codes[:n]
    for j in range(1, order + 1):  # longer by a symbol each time
        distinct, place = dense(place * len(symbols) + codes[j : n + j], len(names) * len(symbols))
        names = (names[distinct // len(symbols)] << BITS) | symbols[distinct % len(symbols)]
    used, place = dense(place[where - order], len(names))
    return names[used], place, starts


class Asked:
    """Distinct grams and words of a chunk, and how often training documents hold them."""

    def __init__(self, order: int) -> None:
        self.order, self.keys, self.counts, self.held, self.words = order, [], [], 0, {}

    def add(self, texts: list[bytes], learn: list[bool]) -> None:
        for parts in pieces(texts, self.order):
            keys, place, starts = grams(parts, self.order)
            sizes = np.diff(np.append(starts, len(place)))
            self.keys.append(keys)
            self.counts.append(np.bincount(place, np.repeat([learn[i] for i, *_ in parts], sizes), len(keys)).astype(np.int64))
            self.held += len(keys)
            if self.held > HELD:
                self.merge()
        for t, told in zip(texts, learn, strict=True):
            for w, n in Counter([*t.split(), b""]).items():
                self.words[w] = self.words.get(w, 0) + n * told

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)]
        self.keys, self.held = [keys], len(keys)

    def rows(self) -> Iterator[dict]:
        """What is asked, in order, LISTED entries a row."""
        self.merge()
        words = sorted(self.words)
        for a in range(0, max(len(words), len(self.keys[0])), LISTED):
            b = a + LISTED
            yield {"base": a, "key": self.keys[0][a:b], "key_n": self.counts[0][a:b], "word": words[a:b], "word_n": [self.words[w] for w in words[a:b]]}


CHUNKED = {"chunk": pa.int64(), "doc_id": pa.int64(), "held": pa.bool_(), "text": pa.string(), "base": pa.int64(), "key": pa.list_(pa.int64()), "key_n": pa.list_(pa.int64()), "word": pa.list_(pa.binary()), "word_n": pa.list_(pa.int64())}
CHUNKED_DDL = "chunk long, doc_id long, held boolean, text string, base long, key array<long>, key_n array<long>, word array<binary>, word_n array<long>"


def chunked(docs: DataFrame, order: int, chunk_bytes: int) -> DataFrame:
    """Rows of documents with the number of their chunk, and rows of what each chunk asks for."""

    def batch(columns: dict) -> pa.RecordBatch:
        n = len(columns["chunk"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in CHUNKED.items()], names=list(CHUNKED))

    def run(batches) -> Iterator[pa.RecordBatch]:
        chunk, size, asked = TaskContext.get().partitionId() << 24, 0, Asked(order)
        for rows in batches:
            held, whole = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            texts, a = [lowered(t) for t in whole], 0
            while a < len(texts):
                b = a
                while b < len(texts) and size < chunk_bytes:
                    size += len(texts[b]) + 1
                    b += 1
                asked.add(texts[a:b], [not h for h in held[a:b]])
                yield batch({"chunk": [chunk] * (b - a), "doc_id": rows.column(0).slice(a, b - a), "held": held[a:b], "text": whole[a:b]})
                a = b
                if size >= chunk_bytes:
                    yield from (batch({"chunk": [chunk]} | {c: [v] for c, v in r.items()}) for r in asked.rows())
                    chunk, size, asked = chunk + 1, 0, Asked(order)
        if size:
            yield from (batch({"chunk": [chunk]} | {c: [v] for c, v in r.items()}) for r in asked.rows())

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held"), F.col("text").cast("string")).mapInArrow(trimmed(run), CHUNKED_DDL)


# --- the model ---


def log_probabilities(key: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of each gram's last symbol after the rest of it.

    key: distinct grams, all of each branch (the last two symbols of the context) that occurs; n: how often each
    one was in training; pairs: counts of (context of one symbol, symbol), over all grams."""
    low, levels = (1 << BITS) - 1, {}
    for k in range(order, 1, -1):
        names, first, to = np.unique(key & ((1 << BITS * (k + 1)) - 1), return_index=True, return_inverse=True)
        count, (_, ctx) = np.bincount(to, n, len(names)), np.unique(names >> BITS, return_inverse=True)
        levels[k] = {"count": count, "first": first, "ctx": ctx, "of": ctx[to], "n": count[to], "total": np.bincount(ctx, count), "kinds": np.bincount(ctx, count > 0)}
    one, symbol, single = key >> BITS & low, key & low, pairs.sum(0)
    levels[1] = {"of": one, "n": pairs[one, symbol], "total": pairs.sum(1), "kinds": (pairs > 0).sum(1)}
    levels[0] = {"of": np.zeros(len(key), np.int64), "n": single[symbol], "total": single.sum(keepdims=True), "kinds": (single > 0).sum(keepdims=True)}
    out, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    gone_n = gone_d = np.zeros(len(key))
    for k in range(order, -1, -1):
        x = levels[k]
        left_d = x["kinds"][x["of"]] - gone_d
        room = x["total"][x["of"]] - gone_n + left_d
        hit, miss = open_ & (x["n"] > 0), open_ & (x["n"] == 0) & (room > 0)
        out[hit] += np.log10(x["n"][hit] / room[hit])
        out[miss] += np.log10(left_d[miss] / room[miss])
        open_ &= x["n"] == 0
        if k > 1:  # what the symbols that this context knows count in the next shorter one
            known = np.bincount(x["ctx"], levels[k - 1]["n"][x["first"]] * (x["count"] > 0))
        elif k == 1:
            known = (pairs > 0) @ single
        if k:
            gone_n, gone_d = known[x["of"]], x["kinds"][x["of"]]
    out[open_] -= np.log10(max(1, SYMBOLS - int(levels[0]["kinds"][0])))
    return out


ANSWER = "chunk long, is_word boolean, i long, value double"


def gram_answers(asked: DataFrame, order: int) -> DataFrame:
    """To each chunk and gram it asks for (chunk, i, key, n): the log10 of its probability."""
    spark, low = asked.sparkSession, (1 << 2 * BITS) - 1
    pairs = np.zeros((1 << BITS) * SYMBOLS, np.int64).reshape(1 << BITS, SYMBOLS)
    sums = asked.groupBy(F.col("key").bitwiseAND(F.lit(low)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # SYMBOLS ** 2 rows at most
    pairs[sums["pair"].to_numpy() >> BITS, sums["pair"].to_numpy() & ((1 << BITS) - 1)] = sums["n"].to_numpy()
    branch = F.shiftright("key", BITS).bitwiseAND(F.lit(low))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.withColumn("branch", branch).repartition(parts, "branch").sortWithinPartitions("branch").select("branch", "key", "n", "chunk", "i")

    def answered(rows: list[np.ndarray]) -> pa.RecordBatch:
        _, key, n, chunk, i = rows
        names, at = np.unique(key, return_inverse=True)
        value = log_probabilities(names, np.bincount(at, n, len(names)), pairs, order)[at]
        return batch_of({"chunk": chunk, "is_word": np.zeros(len(i), bool), "i": i, "value": value}, ANSWER)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > HELD and held[0][0][0] != held[-1][0][-1]:  # all branches but the last one are whole
                now = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1
                yield answered([c[:end] for c in now])
                held, size = [[c[end:] for c in now]], len(now[0]) - end
        if size:
            yield answered([np.concatenate(c) for c in zip(*held, strict=True)])

    return rows.mapInArrow(trimmed(run), ANSWER)


def word_answers(asked: DataFrame) -> DataFrame:
    """To each chunk and word it asks for (chunk, i, word, n): its count, and on one row of each counted word, lead."""
    same = Window.partitionBy("word")
    first = F.min(F.when(F.col("n") > 0, F.col("chunk"))).over(same)
    return asked.select("chunk", F.lit(True).alias("is_word"), "i", F.sum("n").over(same).cast("double").alias("value"), F.coalesce(first == F.col("chunk"), F.lit(False)).alias("lead"))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: pa.Table, answers: pa.Table, order: int, total: int, distinct: int) -> pa.Table:
    """The rows of a chunk, scored by its answers."""
    texts = [lowered(t) for t in docs["text"].to_pylist()]
    is_word, i, value = (answers[c].to_numpy() for c in ("is_word", "i", "value"))
    counts, logs = np.zeros(int(is_word.sum())), np.zeros(int((~is_word).sum()))
    counts[i[is_word]], logs[i[~is_word]] = value[is_word], value[~is_word]
    words: dict[bytes, int] = {}
    tokens = [np.array([words.setdefault(w, len(words)) for w in [*t.split(), b""]]) for t in texts]
    of_word = np.empty(len(words))
    of_word[[words[w] for w in sorted(words)]] = counts
    starts = np.cumsum([0, *map(len, tokens)])
    count = of_word[np.concatenate(tokens)]
    base = np.add.reduceat(np.log10((count + 0.1) / (total + 0.1 * (distinct + 1))), starts[:-1])
    known = np.add.reduceat(count > 0, starts[:-1], dtype=np.int64)
    parts = [(p, *grams(p, order)) for p in pieces(texts, order)]
    keys = np.unique(np.concatenate([x[1] for x in parts]))
    score = np.zeros(len(texts))
    for p, mine, place, begins in parts:
        np.add.at(score, [i for i, *_ in p], np.add.reduceat(logs[np.searchsorted(keys, mine)][place], begins))
    columns = {"doc_id": docs["doc_id"].combine_chunks(), "held_out": docs["held"].combine_chunks(), "n_tokens": np.diff(starts), "n_known": known, "train_tokens": np.full(len(texts), total), "base_score": base, "score": score}
    return pa.Table.from_batches([batch_of(columns, SCORED)])


def score(documents: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per document: tokens, known tokens, training tokens, unigram score and log10 probability by the model."""
    spark = documents.sparkSession
    table = written(chunked(documents, order, chunk_bytes), "chunked")
    lists = table.where("base is not null")
    asked = lambda name: lists.select("chunk", "base", F.posexplode(F.arrays_zip(F.col(name).alias("x"), F.col(f"{name}_n").alias("n")))).select("chunk", (F.col("base") + F.col("pos")).alias("i"), F.col("col.x").alias(name), F.col("col.n").alias("n"))
    words = written(word_answers(asked("word")), "words")
    let_go(spark)
    logs = written(gram_answers(asked("key"), order), "grams")
    let_go(spark)
    total, distinct = words.where("lead").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long"), F.count(F.lit(1))).first()
    answers = words.select("chunk", "is_word", "i", "value").unionByName(logs)
    docs = table.where("base is null").select("chunk", "doc_id", "held", "text")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda d, a: scored(d, a, order, total, distinct), SCORED)


def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 11: all documents, by a model of those that aren't held out."""
    return tidied(lambda: score(read(spark, sf_dir, "documents")), "scores")
