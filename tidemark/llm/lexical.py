"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

An item's score is a sum over its terms, so what items share are sums over sets of terms. mine() finds them:
as long as two symbols stand together in two items or more, the pair that most items share becomes a symbol of
its own. The symbols form a graph without cycles: terms at the bottom, shared sets above, items on top. For each
block of documents the accumulators (one number a document) of all terms and all shared sets are filled once,
level by level, and each item adds up the few that its terms were reduced to.

Items go in blocks of some BLOCK_ENTRIES (item, term) pairs, by hash; a block's terms and graph are all that tasks
and the driver hold of the items. For a block the texts are read once: what documents hold of its terms is
written, document frequencies are summed from that, then documents are scored where they are. A task
keeps TOP documents an item, which meet by item and by part of the tasks first, then by item.

Defined results: rows of one item_id are one item with the terms of all of them; items without a term, or null,
get no rows; each row of documents is a document of its own, so repeated rows rank side by side; among equal
scores a null doc_id comes last; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, bounded_batches, map_rows, read, trimmed, written

TOP = 10
BLOCK_ENTRIES = 1 << 15
#: Numbers that the accumulators of one block of documents hold.
CELLS = 1 << 22
PARTS = 64
#: Bytes between terms become spaces, A-Z small letters.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def mine(items: list[Counter]) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int]]]:
    """Leaves (term, repeat), each item as a list of symbols, and the pair of symbols that each shared set adds up.

    A term's second occurrence in an item is another symbol than its first, with the same value, so items that
    hold a term unlike often still share it. Symbols are numbered: leaves, then shared sets as they arise."""
    leaves: dict[tuple[int, int], int] = {}
    sets = [{leaves.setdefault((t, r), len(leaves)) for t, n in sorted(x.items()) for r in range(n)} for x in items]
    holds = defaultdict(set)  # symbol -> items
    pairs: Counter = Counter()
    for i, x in enumerate(sets):
        order = sorted(x)
        for k, a in enumerate(order):
            holds[a].add(i)
            pairs.update((a, b) for b in order[k + 1 :])
    heap = [(-n, p) for p, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    made, fresh = [], len(leaves)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        if pairs[a, b] != -n:  # an old entry; there is another one, if the pair still counts
            continue
        shared = holds[a] & holds[b]
        touched: set[tuple[int, int]] = set()
        for i in shared:
            x = sets[i]
            x -= {a, b}
            for s in x:
                for old in (a, b):
                    p = (s, old) if s < old else (old, s)
                    pairs[p] -= 1
                    touched.add(p)
                pairs[s, fresh] += 1
                touched.add((s, fresh))
            x.add(fresh)
            pairs[a, b] -= 1
        holds[a] -= shared
        holds[b] -= shared
        holds[fresh] = shared
        made.append((a, b))
        fresh += 1
        for p in touched:
            if pairs[p] > 1:
                heapq.heappush(heap, (-pairs[p], p))
    return list(leaves), [sorted(x) for x in sets], made


class Plan:
    """The graph of a block of items, ready to be evaluated."""

    def __init__(self, item_ids: list, vocabulary: list[bytes], leaves: list[tuple[int, int]], sums: list[list[int]], made: list[tuple[int, int]]) -> None:
        self.item_ids, self.vocabulary = item_ids, vocabulary
        self.leaves = np.array([t for t, _ in leaves], np.int64)
        depth = [0] * len(leaves)
        for a, b in made:
            depth.append(1 + max(depth[a], depth[b]))
        pairs, at = np.array(made, np.int64).reshape(-1, 2), np.array(depth[len(leaves) :], np.int64)
        self.levels = [(np.flatnonzero(at == d) + len(leaves), pairs[at == d, 0], pairs[at == d, 1]) for d in range(1, max(depth, default=0) + 1)]
        self.symbols = len(depth)
        self.flat = np.array([s for x in sums for s in x], np.int64)
        self.begins = np.cumsum([0, *map(len, sums)])[:-1]

    def scores(self, weighed: np.ndarray) -> np.ndarray:
        """Items x documents, of what each term adds to each document (terms x documents)."""
        acc = np.empty((self.symbols, weighed.shape[1]), np.int64)
        acc[: len(self.leaves)] = weighed[self.leaves]
        for to, a, b in self.levels:
            acc[to] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.flat], self.begins, axis=0)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, term, n."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"item_id": [], "term": [], "n": []}
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(terms(raw or b""))
                out["item_id"] += [item] * len(found)
                out["term"] += found.keys()
                out["n"] += found.values()
            return out

        return work

    rows = map_rows(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")), make, "item_id long, term binary, n long")
    return rows.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


PLAN = "block long, item_ids array<long>, vocabulary array<binary>, leaf_term array<long>, leaf_repeat array<long>, sums array<array<long>>, made array<array<long>>"


def plans_of(items: DataFrame, blocks: int) -> DataFrame:
    """A row per block of items: its graph, mined in a task."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["term"]))
        words = sorted({r["term"] for r in rows})
        place, held = {w: i for i, w in enumerate(words)}, {}
        for r in rows:
            held.setdefault(r["item_id"], Counter())[place[r["term"]]] = r["n"]
        leaves, sums, made = mine(list(held.values()))
        columns = {"block": [rows[0]["block"]], "item_ids": [list(held)], "vocabulary": [words], "leaf_term": [[t for t, _ in leaves]], "leaf_repeat": [[r for _, r in leaves]], "sums": [sums], "made": [[list(p) for p in made]]}
        many = pa.list_(pa.int64())
        kinds = [pa.int64(), many, pa.list_(pa.binary()), many, many, pa.list_(many), pa.list_(many)]
        return pa.table([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], names=list(columns))

    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("long")).groupBy("block").applyInArrow(run, PLAN)


def held_terms(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats) and which terms of the vocabulary, how often, of each document with a term."""

    def make():
        place = {w: i for i, w in enumerate(vocabulary)}.get

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": [], "n": [], "at": [], "tf": []}
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(raw or b"")
                if words:
                    found = Counter(map(place, words))
                    found.pop(None, None)
                    for name, x in zip(out, (doc, len(words), np.fromiter(found.keys(), "<i4").tobytes(), np.fromiter(found.values(), "<i8").tobytes()), strict=True):
                        out[name].append(x)
            return out

        return work

    return map_rows(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, n long, at binary, tf binary")


def statistics(held: DataFrame, terms_n: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and how many documents hold each term. The driver gets a row a term at most."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms_n + 2, np.int64)
        for batch in batches:
            total[terms_n] += batch.num_rows
            total[terms_n + 1] += sum(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"), minlength=terms_n + 2)
        at = np.flatnonzero(total)
        yield batch_of({"term": at, "n": total[at]}, "term long, n long")

    bounded_batches(held.sparkSession)
    rows = held.select("n", "at").mapInArrow(trimmed(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(terms_n + 2, np.int64)
    total[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(total[terms_n]), int(total[terms_n + 1]), total[:terms_n]


def best(rows: tuple[np.ndarray, ...], items: int) -> tuple[np.ndarray, ...]:
    """The TOP of each item, of (item, score, no doc_id, doc_id), in order."""
    item, score, none, doc = rows
    order = np.lexsort((doc, none, -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, np.arange(items))[item]
    order = order[place < TOP]
    return tuple(x[order] for x in rows)


def ranked(held: DataFrame, plan: Plan, n_docs: int, n_terms: int, df: np.ndarray) -> DataFrame:
    """item (its place in the plan), doc_id, score: the TOP of each task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items, words = len(plan.item_ids), len(plan.vocabulary)
    step = max(16, CELLS // max(1, plan.symbols))

    def run(batches) -> Iterator[pa.RecordBatch]:
        top = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        for batch in batches:
            doc, n, at, tf = (batch.column(i) for i in range(4))
            none, ids = np.array(doc.is_null()), np.array(doc.fill_null(0), np.int64)
            long = np.array([25 + 75 * x * n_docs // n_terms for x in n.to_pylist()], np.int64)
            ats, tfs = [np.frombuffer(x, "<i4") for x in at.to_pylist()], [np.frombuffer(x, "<i8") for x in tf.to_pylist()]
            for a in range(0, batch.num_rows, step):
                mine_at, mine_tf = ats[a : a + step], tfs[a : a + step]
                here = np.repeat(np.arange(len(mine_at)), [len(x) for x in mine_at])
                t, f = np.concatenate(mine_at), np.concatenate(mine_tf)
                weighed = np.zeros((words, len(mine_at)), np.int64)
                weighed[t, here] = weight[t] * (1_000_000_000 * f // (1000 * f + 8 * long[a : a + step][here]))
                scores = plan.scores(weighed)
                floor = np.ones(items, np.int64)
                if len(top[0]):
                    full = np.bincount(top[0], minlength=items) >= TOP
                    least = np.full(items, np.iinfo(np.int64).max)
                    np.minimum.at(least, top[0], top[1])
                    floor[full] = least[full]
                item, col = np.nonzero(scores >= floor[:, None])
                found = (item, scores[item, col], none[a + col], ids[a + col])
                top = best(tuple(np.concatenate(x) for x in zip(top, found, strict=True)), items)
        yield batch_of({"item": top[0], "doc_id": pa.array(top[3], mask=top[2]), "score": top[1]}, "item long, doc_id long, score long")

    bounded_batches(held.sparkSession)
    return held.select("doc_id", "n", "at", "tf").mapInArrow(trimmed(run), "item long, doc_id long, score long")


def search(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of each item."""
    spark = documents.sparkSession
    items = written(items_of(benchmark), "items")
    blocks = -(-items.count() // BLOCK_ENTRIES)
    plans = written(plans_of(items, blocks), "plans") if blocks else None
    out = None
    for block in range(blocks):
        for row in plans.where(F.col("block") == block).collect():  # one row, of a bounded size
            plan = Plan(row["item_ids"], [bytes(x) for x in row["vocabulary"]], list(zip(row["leaf_term"], row["leaf_repeat"], strict=True)), row["sums"], row["made"])
            held = written(held_terms(documents, plan.vocabulary), "held")
            n_docs, n_terms, df = statistics(held, len(plan.vocabulary))
            if not n_docs:
                continue
            found = ranked(held, plan, n_docs, n_terms, df).withColumn("part", F.spark_partition_id() % PARTS)
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            for by in (["item", "part"], ["item"]):
                found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= TOP)
            named = spark.createDataFrame(list(enumerate(plan.item_ids)), "item long, item_id long")
            ready = written(found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
            out = ready if out is None else out.unionByName(ready)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 13: the ten best documents of each benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _terms_sql(table: str, key: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM {table}"


ORACLE = f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM ({_terms_sql("documents", "doc_id")}) WHERE len(ts) > 0
), g AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), p AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term
), i AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS q FROM (SELECT item_id, unnest(ts) AS term FROM ({_terms_sql("benchmark", "item_id")})) GROUP BY item_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(g.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g WHERE term IN (SELECT term FROM i) GROUP BY term
), s AS (
  SELECT i.item_id, p.r, CAST(sum(i.q * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * d.n * g.docs) // g.terms)))) AS BIGINT) AS score
  FROM i JOIN w ON w.term = i.term JOIN p ON p.term = i.term JOIN d ON d.r = p.r, g GROUP BY i.item_id, p.r
), o AS (
  SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST) AS INTEGER) AS rank, d.doc_id, s.score
  FROM s JOIN d ON d.r = s.r WHERE s.score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}"""
