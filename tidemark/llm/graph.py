"""Connected components of a graph given by its edges, and joins with small sides of a checked size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import trimmed, written

#: A side of at most so many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 16 << 20
#: Bytes of a value; a string must be a hash in hexadecimal digits.
WIDTHS = {"bigint": 8, "int": 4, "double": 8, "boolean": 1, "string": 80}
ONE_TASK = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, of values of WIDTHS only, marked for broadcast if it is counted to be small. df should be cheap to count."""
    width = 16 + sum(WIDTHS[kind] for _, kind in df.dtypes)
    return F.broadcast(df) if df.count() * width <= most else df


class Forest:
    """Links as they come, and what they have connected so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        """The smallest node that x is connected with, x itself if it has no link."""
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def add(self, links: np.ndarray) -> np.ndarray:
        """Which of the links (rows of two) connect what was apart before them."""
        kept = []
        for i, (a, b) in enumerate(links.tolist()):
            ra, rb = self.root(a), self.root(b)
            self.parent.setdefault(a, ra)
            self.parent.setdefault(b, rb)
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.parent.setdefault(min(ra, rb), min(ra, rb))
                kept.append(i)
        return np.array(kept, dtype=np.int64)


def forest(links: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """Which of the links (rows of two) are needed to connect what all of them connect, and the root of
    each node, the smallest one next to it by links."""
    trees = Forest()
    return trees.add(links), {x: trees.root(x) for x in list(trees.parent)}


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), written; root is the component's smallest node.

    The edges are written and counted. Up to ONE_TASK edges (16 MB of numbers) are settled by union-find
    in one task; more take distributed rounds, which give the same.
    """
    e = written(edges.where("a <> b").select("a", "b"), "edges")
    return written(_by_union(e) if e.count() <= ONE_TASK else _by_rounds(e), "components")


def _by_union(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
        _, roots = forest(np.concatenate([np.zeros((0, 2), np.int64), *parts]))
        yield pa.RecordBatch.from_pydict({"node": pa.array(list(roots), pa.int64()), "root": pa.array(list(roots.values()), pa.int64())})

    return edges.coalesce(1).mapInArrow(trimmed(run), "node long, root long")


def _by_rounds(edges: DataFrame) -> DataFrame:
    """Alternates large-star and small-star steps until nothing changes: each step rewires every node to the
    smallest node next to it, and the number of rounds grows with the logarithm of the diameter. Each
    round's edges are a written table, so plans and lineage stay short.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        star = large.join(small(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(star.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaf = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaf.union(leaf.select(F.col("root").alias("node"), "root").distinct())
