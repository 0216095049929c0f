"""Prefix trie of conversations: SQL ROLLUP over positional columns of turn ids.

A conversation's turns become rows of BLOCK columns t1..t8, block after block. GROUP BY block, prior,
ROLLUP (t1, ..., t8) with grouping_id() then has one group for each prefix that ends in the block, all of them
at once; `prior` is the key of the node that the blocks before lead to, so that longer conversations go on in
further blocks without a loop. A turn's id is 128 bits of SHA-256 over role and text, a block's key 96 bits of
hashes, which blocks add up: among 10^11 nodes the chance of any two alike is under 1 in 10^6.

Sums over subtrees need no walk. A conversation is the smallest member of the nodes from some depth of its path
down to its end (or of none). So a leaf counts once, at its smallest member, and each member of a node but the
smallest adds to the bytes shared in the subtree what lies between the node and that depth. Both are values of
a conversation, which a second ROLLUP adds up.

No task holds a whole group: sums along a conversation go by stretches, ids of conversations that end at a
node are joined in spans of 4096 ids, and the digest reads those strings one after the other. Hot parents (with
a thousandth of all nodes as children, so at most 1000 of them) meet their children by broadcast.

Defined results: turns are ordered by turn (null first), then by id, so by content; repeated rows are turns of
their own; rows without conv_id take no part; c%5 is SQL's remainder, which has the sign of c; other columns
are ignored; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, bounded_batches, read, tidied, trimmed, written

BLOCK = 8
#: A rebuilt conversation begins with fewer turns of another one than this.
HEADS = 9
STRETCH_BITS = SPAN_BITS = 12
SHARE = 1000
IDS = [f"t{j}" for j in range(1, BLOCK + 1)]
BYTES = [f"b{j}" for j in range(1, BLOCK + 1)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (16 bytes) and bytes (of the text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat_ws(":", F.length(role).cast("string"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("id"), F.octet_length(text).cast("long").alias("bytes"),
    )


def with_earlier(rows: DataFrame, order: Column, ties: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, by name, the sum of each column over the rows of the same conv_id that come before.

    A stretch of the order is summed in a task, and the sums of stretches one level above."""
    cut = rows.withColumn("_at", F.shiftright(order, STRETCH_BITS)).withColumns({f"_{n}": c for n, c in sums.items()})
    near = Window.partitionBy("conv_id", "_at").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("conv_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy("conv_id", "_at").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums]).select("conv_id", "_at", *[F.sum(f"_{n}").over(far).alias(f"_far_{n}") for n in sums])
    here = cut.withColumns({f"_near_{n}": F.sum(f"_{n}").over(near) for n in sums}).join(ahead, ["conv_id", "_at"])
    return here.select(*rows.columns, *[(F.coalesce(F.col(f"_near_{n}"), F.lit(0)) + F.coalesce(F.col(f"_far_{n}"), F.lit(0))).alias(n) for n in sums])


def heads_of(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), id and bytes of rebuilt conversations; each has a row of pos -1 besides."""
    first = F.coalesce(F.col("turn"), F.lit(-(2**63)))
    own = with_earlier(turns_of(conversations), first, [F.col("turn").isNotNull(), F.col("id")], {"pos": F.lit(1)}).drop("turn")
    own = written(own, "turns")
    base, mine = (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), F.col("base") == F.col("conv_id")
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", base, heads_of(F.col("conv_id")).alias("h"), "n")
    led = convs.join(convs.select(F.col("conv_id").alias("_c"), F.col("n").alias("_n")), F.col("base") == F.col("_c"), "left")
    led = led.select("conv_id", "base", "h", F.when(mine, F.col("h")).otherwise(F.least("h", F.coalesce(F.col("_n"), F.lit(0)))).alias("lead"))
    begun = led.where(~mine).join(own.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "id", "bytes"), "base").where(F.col("pos") < F.col("h"))
    kept = own.join(led, "conv_id").where(mine | (F.col("pos") >= F.col("h"))).withColumn("pos", F.when(mine, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("lead")))
    here = ["conv_id", "pos", "id", "bytes"]
    marks = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("bytes"))
    return begun.select(here).unionByName(kept.select(here)).unionByName(marks)


def hashed(level: Column, ids: list[Column]) -> Column:
    """96 bits of the block's number, the level and the ids that aren't null."""
    one, two = (F.xxhash64(F.lit(s), F.col("block"), level.cast("long"), *ids) for s in (1, 2))
    return one.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(10,0)") + F.pmod(two, F.lit(2**32)).cast("decimal(10,0)")


def blocks_of(turns: DataFrame) -> DataFrame:
    """A row per conversation and block: t1..t8, b1..b8, n (its turns), prior (of the node before), bytes before."""
    at = F.greatest(F.col("pos"), F.lit(0))
    cells = [F.max(F.when(F.col("pos") % BLOCK == j, F.col(c))).alias(name) for c, names in (("id", IDS), ("bytes", BYTES)) for j, name in enumerate(names)]
    wide = turns.groupBy("conv_id", F.call_function("div", at, F.lit(BLOCK)).alias("block")).agg(*cells, F.count("id").alias("n"))
    wide = wide.withColumns({b: F.coalesce(F.col(b), F.lit(0)) for b in BYTES})
    return with_earlier(wide, F.col("block"), [], {"prior": hashed(F.lit(BLOCK), [F.col(t) for t in IDS]), "start": sum((F.col(b) for b in BYTES), F.lit(0))}).withColumn("prior", F.col("prior").cast("decimal(38,0)"))


ROLLUP = f"""SELECT block, prior, {", ".join(IDS)}, {BLOCK} - bit_count(grouping_id()) AS level, min(conv_id) AS conv_id,
  count(*) AS n_convs, min(start) AS start, {", ".join(f"max({b}) AS {b}" for b in BYTES)}, {{more}}
FROM {{{{blocks}}}} GROUP BY block, prior, ROLLUP ({", ".join(IDS)})"""


def nodes_of(blocks: DataFrame, more: dict[str, str]) -> DataFrame:
    """depth, key, up (the parent's key), conv_id (smallest member), n_convs, before (bytes of the turns before
    the node's own) and more sums of each node."""
    found = blocks.sparkSession.sql(ROLLUP.format(more=", ".join(f"{x} AS {n}" for n, x in ({"one": "count(*)"} | more).items())), blocks=blocks)
    level = F.col("level")
    own = F.coalesce(*[F.when(level == j + 1, F.col(t)) for j, t in enumerate(IDS)])
    found = found.where(own.isNotNull() | (level == 0) & (F.col("block") == 0))
    to = lambda at: F.when(at <= 0, F.col("prior")).otherwise(F.col("prior") + hashed(at, [F.when(at > j, F.col(t)) for j, t in enumerate(IDS)]))
    before = F.col("start") + sum((F.when(level > j + 1, F.col(b)).otherwise(0) for j, b in enumerate(BYTES)), F.lit(0))
    return found.select((F.col("block") * BLOCK + level).cast("long").alias("depth"), to(level).cast("decimal(38,0)").alias("key"), to(level - 1).cast("decimal(38,0)").alias("up"), "conv_id", "n_convs", before.cast("long").alias("before"), *more)


def last_nodes(blocks: DataFrame) -> DataFrame:
    """depth, key, conv_id: where each conversation ends."""
    full = [F.col(t) for t in IDS]
    ends = blocks.withColumn("key", F.when(F.col("n") == 0, F.col("prior")).otherwise(F.col("prior") + hashed(F.col("n"), full)).cast("decimal(38,0)"))
    return ends.where(F.col("n").between(1, BLOCK - 1) | (F.col("n") == 0) & (F.col("block") == 0)).select((F.col("block") * BLOCK + F.col("n")).alias("depth"), "key", "conv_id").unionByName(full_ends(ends))


def full_ends(ends: DataFrame) -> DataFrame:
    """Of the conversations whose last block is full."""
    top = ends.where(F.col("n") == BLOCK).groupBy("conv_id").agg(F.max("block").alias("_top"), F.max_by("key", "block").alias("key"))
    rest = ends.where(F.col("n").between(1, BLOCK - 1)).select("conv_id").distinct()
    return top.join(rest, "conv_id", "left_anti").select((F.col("_top") * BLOCK + BLOCK).alias("depth"), "key", "conv_id")


def digests(ends: DataFrame) -> DataFrame:
    """depth, key (as text) and ends_sha256 of the nodes at which conversations end."""
    spans = ends.groupBy("depth", F.col("key").cast("string").alias("key"), F.shiftright("conv_id", SPAN_BITS).alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spans.repartition(parts, "depth", "key").sortWithinPartitions("depth", "key", "span").select("depth", "key", "ids")
    schema = "depth long, key string, ends_sha256 string"

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out: dict[str, list] = {"depth": [], "key": [], "ends_sha256": []}
            for depth, key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, key) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    for name, x in zip(out, (*now, digest.hexdigest()), strict=True):
                        out[name].append(x)
                now, digest = (depth, key), hashlib.sha256(ids.encode())
            yield batch_of(out, schema)
        if now:
            yield batch_of({"depth": [now[0]], "key": [now[1]], "ends_sha256": [digest.hexdigest()]}, schema)

    bounded_batches(ends.sparkSession)
    return rows.mapInArrow(trimmed(run), schema)


def with_parents(nodes: DataFrame, total: int) -> DataFrame:
    """Adds parent_conv_id to nodes (depth, key, up, conv_id, n_children)."""
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") * SHARE >= total).drop("n_children")
    met = nodes.join(F.broadcast(hot), ["depth", "up"], "left")  # SHARE rows at most
    cold = met.where("parent_conv_id is null and depth > 0").drop("parent_conv_id").join(parents.where(F.col("n_children") * SHARE < total).drop("n_children"), ["depth", "up"])
    return met.where("parent_conv_id is not null or depth = 0").unionByName(cold)


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = written(blocks_of(rebuilt(conversations)), "blocks")
    nodes = written(nodes_of(blocks, {}), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(kids, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")
    owned = nodes.groupBy("conv_id").agg(F.min("before").alias("top"), F.count_if(F.col("n_children") == 0).alias("leaf"))
    sizes = blocks.groupBy("conv_id").agg(F.sum(sum((F.col(b) for b in BYTES), F.lit(0))).alias("size"))
    values = sizes.join(owned, "conv_id", "left").select("conv_id", F.coalesce("top", "size").alias("top"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = nodes_of(blocks.join(values, "conv_id"), {"tops": "sum(top)", "least": "min(top)", "n_leaves": "sum(leaf)"})
    sums = sums.select("depth", "key", "n_leaves", (F.col("tops") - F.col("least") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"))
    named = with_parents(nodes, nodes.count()).join(sums, ["depth", "key"]).withColumn("key", F.col("key").cast("string"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named.join(digests(last_nodes(blocks)), ["depth", "key"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )


def op12_convtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 12: the trie of all rebuilt conversations."""
    return tidied(lambda: trie(read(spark, sf_dir, "conversations")), "trie")


ORACLE = f"""WITH t AS (
  SELECT conv_id, bytes, sha256(told) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(told)) - 1 AS pos
  FROM (SELECT conv_id, turn, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS told
        FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, t.pos, t.id, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos + 1000000, t.id, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h
), p AS (
  SELECT conv_id, bytes, list(id) OVER (PARTITION BY conv_id ORDER BY pos) AS path, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM r
), m AS (
  SELECT conv_id, depth, CAST(path AS VARCHAR) AS path, CAST(path[1:depth - 1] AS VARCHAR) AS up, bytes FROM p
  UNION ALL SELECT conv_id, 0, '[]', NULL, 0 FROM c
), n AS (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY depth, path
), k AS (
  SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up
), s AS (
  SELECT a.depth, a.path, sum(CASE WHEN k.up IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM n JOIN m b ON b.conv_id = n.conv_id AND b.depth <= n.depth JOIN n a ON a.depth = b.depth AND a.path = b.path LEFT JOIN k ON k.up = n.path GROUP BY a.depth, a.path
), e AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (depth, path) LEFT JOIN k ON k.up = n.path LEFT JOIN n u ON u.path = n.up LEFT JOIN e ON e.path = n.path"""
