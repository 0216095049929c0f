"""Exact top-k by inner product, with a pivot table for elimination.

Vectors become integers, floor(64 x). Distances are angles, for which the triangle inequality holds: an inner
product is |q| |x| cos(angle), so a lower bound of the angle is an upper bound of the score. The angles of
each candidate to PIVOTS pivots are computed once, when its block is made, and kept in steps of a 255th of a
half turn, a byte each. A pair's largest lower bound is taken over the pivots that say most: the TELLING ones whose
angles to the query are farthest from a right angle, and those of the candidate. The candidates of a block are put in
cells by their nearest pivot; a query goes through the cells in order of their best bounds and stops when none
reaches its k-th best score, and within a cell candidates whose own bounds don't reach it are left out.
What is left is scored by matrix products. A query's k-th best score among the sampled rows is a lower
bound of the final one, so no block begins without one; it is computed once, when the queries' block is made.

Queries and candidates meet in blocks: pairs of (block of queries, block of candidates) are dealt over
the cluster, and each task holds one pair. Per pair and query at most k rows leave, and a window keeps
the best k. Nothing is broadcast but the sample, whose first rows are the pivots: a fixed number of rows.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a shorter
vector counts as filled up with zeros; ties go to the smaller vec_id; rows of the query's own vec_id are
no candidates for it, rows repeated otherwise count each; a vec_id on several rows queries once, with its
smallest vector; a null vec_id takes no part; scores beyond 64 bits are held at the end of the range; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, bounded_batches, read, trimmed

SCALE = 64
PIVOTS = 512
PIVOT_SAMPLE = 2048  # rows, those with the smallest hashes
TELLING = 8
CELL_PIVOTS = 64  # of which the nearest one gives the cell
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
CANDIDATES_A_SALT = 4096
STRIP = 512  # queries whose bounds are held at a time
STEPS = 255  # of a half turn
SLACK = 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """id and v, the integer vector as doubles, of the rows that take part."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("double"))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, filled up with zeros to the longest or to width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


BLOCKS = "ids binary, n long, short boolean, v binary, far binary, reach binary"


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of the rows to the pivots, in STEPS; a vector of zeros has a right angle to everything."""
    x, p = fit_width(x, pivots)
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None, :]
    cos = np.divide(x @ p.T, size, out=np.zeros(size.shape), where=(size > 0) & np.isfinite(size))
    return np.rint(np.arccos(np.clip(cos, -1, 1)) * (STEPS / np.pi)).astype(np.uint8)


def packed(df: DataFrame, size: int, pivots: np.ndarray, reach_of: Callable | None = None) -> DataFrame:
    """Blocks of at most size rows: ids, vectors and angles to the pivots, in order of their cells, and what
    reach_of(ids, vectors) says of each row, if given."""

    def block(ids: list, vs: list) -> dict:
        width = max(v.shape[1] for v in vs)
        v = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in vs])
        far = angles(v, pivots)
        order = np.argsort(nearest(far), kind="stable")
        ids, v, short = np.concatenate(ids)[order], v[order], bool(np.abs(v).max(initial=0) < 2**15)
        reach = reach_of(ids, v).astype("<f8").tobytes() if reach_of else None
        return {"ids": ids.astype("<i8").tobytes(), "n": len(v), "short": short, "v": v.astype(KINDS[short]).tobytes(), "far": far[order].tobytes(), "reach": reach}

    def run(batches):
        ids, vs, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                if held and held + part.num_rows > size:
                    yield batch_of({c: [x] for c, x in block(ids, vs).items()}, BLOCKS)
                    ids, vs, held = [], [], 0
                ids.append(part.column(0).to_numpy())
                vs.append(matrix(part.column(1)))
                held += part.num_rows
        if held:
            yield batch_of({c: [x] for c, x in block(ids, vs).items()}, BLOCKS)

    return df.select("id", "v").mapInArrow(trimmed(run), BLOCKS)


#: How vectors are written, by whether all components are short.
KINDS = {True: "<i2", False: "<f8"}


def unpacked(row: dict, head: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors and angles of a block."""
    n = row[f"{head}n"]
    v = np.frombuffer(row[f"{head}v"], KINDS[row[f"{head}short"]]).reshape(n, -1).astype(np.float64)
    return np.frombuffer(row[f"{head}ids"], "<i8"), v, np.frombuffer(row[f"{head}far"], np.uint8).reshape(n, -1)


def nearest(far: np.ndarray) -> np.ndarray:
    return far[:, :CELL_PIVOTS].argmin(1)


def fit_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1])))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows; doubles hold them unless the components are huge."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(x.shape[1], 1) < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(r, t, strict=True)) for t in x] for r in q]
    return np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in r] for r in exact], dtype=np.int64).reshape(len(q), len(x))


def best(who: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each asker: highest score, then smallest id."""
    order = np.lexsort((ids, ~found, who))
    who, ids, found = who[order], ids[order], found[order]
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    place = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    return who[place < k], ids[place < k], found[place < k]


#: At an angle of at least so many steps between two rounded ones, the largest cosine: each may be off by half a step.
COSINES = np.cos(np.maximum((np.arange(STEPS + 1) - 1) * (np.pi / STEPS) - SLACK, 0)) + 1e-9


def telling(far: np.ndarray) -> np.ndarray:
    """Of each row the pivots whose angles are farthest from a right one."""
    n = far.shape[1]
    if n <= TELLING:
        return np.tile(np.arange(n), (len(far), 1))
    return np.argpartition(-np.abs(2 * far.astype(np.int16) - STEPS), TELLING - 1, axis=1)[:, :TELLING]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b) - np.minimum(a, b)  # of bytes


class Cells:
    """Candidates of a block in order of their nearest pivots, as cells."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray):
        self.ids, self.x, self.norm = ids, x, np.linalg.norm(x, axis=1)
        self.by_pivot, self.telling = np.ascontiguousarray(far.T), telling(far)
        near = nearest(far)
        self.begin = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        self.end = np.append(self.begin[1:], len(ids))

    def least_angles(self, q_far: np.ndarray) -> np.ndarray:
        """Lower bounds of the angles of queries and candidates, in STEPS, by the pivots that say most of either."""
        low = np.empty((len(q_far), len(self.ids)), np.uint8)
        for i, p in enumerate(telling(q_far)):
            low[i] = apart(self.by_pivot[p], q_far[i, p, None]).max(0)
        by_pivot, other = np.ascontiguousarray(q_far.T), np.empty(low.shape[::-1], np.uint8)
        for j, p in enumerate(self.telling):
            other[j] = apart(by_pivot[p], self.by_pivot[p, j, None]).max(0)
        return np.maximum(low, other.T, out=low)

    def bounds(self, q: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of all candidates."""
        size = np.linalg.norm(q, axis=1)[:, None] * self.norm[None, :]
        with np.errstate(invalid="ignore"):
            bound = size * COSINES[low] + 1e-3
        bound[~np.isfinite(size)] = np.inf
        return bound


def best_of_block(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, cells: Cells, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place of the query, id, score) of the best candidates of a block that reach a query's k-th best score
    so far (reach, floats), and how many pairs were scored."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)]
    low = cells.least_angles(q_far)
    for a in range(0, len(q), STRIP):
        b = a + STRIP
        who, *found = _best_of_strip(q_ids[a:b], q[a:b], cells.bounds(q[a:b], low[a:b]), cells, k, reach[a:b])
        parts.append((who + a, *found))
    who, ids, found = (np.concatenate([p[c] for p in parts]) for c in range(3))
    return who, ids, found, sum(p[3] for p in parts)


def _best_of_strip(q_ids, q, bound, cells, k, reach):
    first = np.maximum.reduceat(bound, cells.begin, axis=1)
    turn, n_cells = np.argsort(-first, axis=1, kind="stable"), len(cells.begin)
    who, ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach, scored, at, step = reach.copy(), 0, 0, 1
    while at < n_cells:
        now = turn[:, at : at + step]
        rows, places = np.nonzero(np.take_along_axis(first, now, 1) >= reach[:, None])
        if not len(rows):
            break  # bounds only fall from here on
        chosen, parts = now[rows, places], [(who, ids, found)]
        for c in np.unique(chosen).tolist():
            group, inside = rows[chosen == c], slice(int(cells.begin[c]), int(cells.end[c]))
            pick = (bound[group, inside] >= reach[group, None]).any(0)
            near = cells.ids[inside][pick]
            s = scores(q[group], cells.x[inside][pick])
            i, j = np.nonzero((s >= reach[group, None]) & (near[None, :] != q_ids[group, None]))
            parts.append((group[i], near[j], s[i, j]))
            scored += s.size
        who, ids, found = best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
        full = np.flatnonzero(np.bincount(who, minlength=len(q)) == k)
        last = np.searchsorted(who, full, side="right") - 1
        reach[full] = np.maximum(reach[full], found[last].astype(np.float64))
        at, step = at + step, max(1, at + step)
    return who, ids, found, scored


def choose_pivots(df: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled rows' ids and vectors, and the first n different ones of these as pivots."""
    rows = df.orderBy(F.xxhash64("id", F.lit(5)), "id", "v").limit(sample).select("id", "v").toArrow()
    ids, x = rows["id"].to_numpy(), matrix(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))
    if not len(x):
        return ids, x, np.zeros((1, 1))
    return ids, x, x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:n]]


def first_reach(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th best score among these rows, as a float that isn't above it; else minus infinity."""
    if len(ids) <= k:
        return np.full(len(q), -np.inf)
    a, b = fit_width(q, x)
    s = np.where(ids[None, :] == q_ids[:, None], -np.inf, scores(a, b).astype(np.float64))
    return np.sort(s, axis=1)[:, -k]


#: Columns of a block, of candidates or of queries.
PACKED = ["ids", "n", "short", "v", "far"]


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """For each row of vectors (vec_id, embedding) that is_query holds for, the k best of all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = usable(vectors)
    sample_ids, sample, pivots = choose_pivots(base)
    asked = usable(vectors.where(is_query)).groupBy("id").agg(F.min("v").alias("v"))
    n, m = base.count(), asked.count()
    blocks, salts = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATES_A_SALT))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * salts, 100_000))
    candidates = packed(base, CANDIDATE_BLOCK, pivots).drop("reach").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts).cast("long")))
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "block", "salt")
    dealt = asked.repartition(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)))
    queries = packed(dealt, QUERY_BLOCK, pivots, lambda ids, q: first_reach(ids, q, sample_ids, sample, k))
    queries = queries.select(F.spark_partition_id().alias("block"), "reach", *(F.col(c).alias(f"q_{c}") for c in PACKED))
    queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).repartition(tasks, "block", "salt")
    pairs = candidates.join(queries.hint("shuffle_merge"), ["block", "salt"]).select("reach", *PACKED, *(f"q_{c}" for c in PACKED))

    def run(batches):
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                (ids, x, far), (q_ids, q, q_far) = unpacked(row), unpacked(row, "q_")
                reach = np.frombuffer(row["reach"], "<f8")
                x, q = fit_width(x, q)
                who, found_ids, found, _ = best_of_block(q_ids, q, q_far, Cells(ids, x, far), k, reach)
                yield batch_of({"query_id": q_ids[who], "vec_id": found_ids, "score": found}, "query_id long, vec_id long, score long")

    hits = pairs.mapInArrow(trimmed(run), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 4: the 20 best of every row whose id is divisible by 20, among all rows."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH e AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.id AS query_id, x.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e x ON q.id % 20 = 0 AND q.id <> x.id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
