"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a target weight, and with it a mean repetition rate: the rows it shall have over the rows
it has. Each document draws its count from a Poisson distribution of that mean by inverting it at a
uniform number hashed from seed and doc_id; the document is exploded by its count and the copies are
shuffled globally by a hash of seed, doc_id and copy. A mean above SPLIT is the sum of several draws, so
that the distribution function never underflows.

One aggregation over documents gives a row a source, written as a small table: sizes, totals and the number
of sources are read from it. It is broadcast if it has at most BROADCAST_ROWS rows, else joined by shuffling,
hot sources being split by adaptive execution.

Defined results: null is a source of its own, and so is the empty text; a source without a target weight
gets weight 0 where weights are given; repeated rows draw the same count, each for itself; a null doc_id
draws as the empty text; null texts are copied as they are; an empty table gives an empty result; other
columns are kept, whatever their names, but for copy and order_key where with_copy makes these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, written

SEED = "mix-1"
SPLIT = 16.0
TERMS = 80  # P(X > 80) for a mean of 16 is below the 2^-52 steps of the uniform number
POWER = 0.5
BROADCAST_ROWS = 50_000


def hashed(*parts: Column) -> Column:
    """The first 52 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """Per source (_source) its rows (_n), as a written table."""
    return written(docs.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n")), "sources")


def rates(counts: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, size: float = 1.0) -> DataFrame:
    """Per source of counts (sizes()): its mean repetition rate, number of draws and distribution function.

    The default weights are row counts to the given power; size is the length of the mix in input lengths.
    """
    if weights is None:
        counts = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)) if power != 0.5 else F.sqrt(F.col("_n").cast("double")))
    else:
        named = {k: float(v) for k, v in weights.items()}
        w = F.lit(named.get(None, 0.0)) if None in named else F.lit(0.0)
        plain = [(k, v) for k, v in named.items() if k is not None]
        if plain:
            given = F.create_map(*[F.lit(x) for kv in plain for x in kv])
            w = F.when(F.col("_source").isNull(), w).otherwise(F.coalesce(given[F.col("_source")], F.lit(0.0)))
        counts = counts.withColumn("_w", w)
    total = counts.agg(F.sum("_n").alias("n"), F.sum("_w").alias("w")).first()  # one row
    n, w = float(total["n"] or 0), float(total["w"] or 0)
    mean = F.lit(n) * F.lit(float(size)) * (F.col("_w") / F.lit(w or 1.0)) / F.col("_n").cast("double")
    out = counts.withColumn("_rate", mean).withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / F.lit(SPLIT)).cast("int")))
    out = out.withColumn("_mean", F.col("_rate") / F.col("_draws").cast("double"))
    start = F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("_mean") / k.cast("double")
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["cdf"])
    return out.withColumn("_cdf", cdf).select("_source", "_rate", "_draws", "_cdf")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, size: float = 1.0, seed: str = SEED, with_copy: bool = False) -> DataFrame:
    """docs (doc_id, source, ...) replicated to the target weights and shuffled globally, all columns as
    they are. with_copy adds copy (from 1) and order_key, the hash that orders the shuffle."""
    spark, names = docs.sparkSession, docs.columns
    counts = sizes(docs)
    per_source = rates(counts, weights, power, size)
    few = counts.count() <= BROADCAST_ROWS
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    own = inner.withColumn("_of", F.col("_row")["source"])
    met = own.join(F.broadcast(per_source) if few else per_source, F.col("_of").eqNullSafe(F.col("_source")))
    doc = F.col("_row")["doc_id"]

    def drawn(j: Column) -> Column:
        u = (hashed(F.lit(seed), doc, j) + F.lit(0.5)) / F.lit(float(2**52))
        return F.size(F.filter(F.col("_cdf"), lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda acc, j: acc + drawn(j))
    met = met.withColumn("_copies", copies).where("_copies > 0")
    out = met.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    out = out.withColumn("_order", hashed(F.lit(seed + "-order"), doc, F.col("_copy")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartition(n, "_order").sortWithinPartitions("_order")
    kept = [F.col("_row")[c].alias(c) for c in names if not (with_copy and c.lower() in ("copy", "order_key"))]
    return out.select(*kept, *([F.col("_copy").cast("long").alias("copy"), F.col("_order").alias("order_key")] if with_copy else []))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, drawn to weights that are the square roots of the sources' sizes."""
    return mix(read(spark, sf_dir, "documents"), with_copy=True)


ORACLE = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rn, * FROM documents), s AS (
  SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY source
), r AS (
  SELECT source, CAST((SELECT sum(n) FROM s) AS DOUBLE) * 1.0::DOUBLE * (w / (SELECT sum(w) FROM s)) / CAST(n AS DOUBLE) AS rate FROM s
), d AS (
  SELECT source, greatest(1, CAST(ceil(rate / {SPLIT}::DOUBLE) AS INT)) AS draws, rate / CAST(greatest(1, CAST(ceil(rate / {SPLIT}::DOUBLE) AS INT)) AS DOUBLE) AS mean FROM r
), c AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM d
  UNION ALL
  SELECT source, mean, k + 1, p * mean / CAST(k + 1 AS DOUBLE), cdf + p * mean / CAST(k + 1 AS DOUBLE) FROM c WHERE k < {TERMS}
), l AS (
  SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source
), u AS (
  SELECT rn, doc_id, x.source, (CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM t x JOIN d ON x.source IS NOT DISTINCT FROM d.source, unnest(range(1, draws + 1)) t(j)
), k AS (
  SELECT rn, doc_id, u.source, CAST(sum(len(list_filter(cdf, lambda c: c <= u.u))) AS BIGINT) AS copies FROM u JOIN l ON u.source IS NOT DISTINCT FROM l.source GROUP BY ALL
)
SELECT t.doc_id, t.text, t.lang, t.source, t.n_chars, CAST(copy AS BIGINT) AS copy,
  CAST(('0x' || substr(md5('{SEED}-order|' || coalesce(CAST(t.doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)), 1, 13)) AS BIGINT) AS order_key
FROM k JOIN t USING (rn), unnest(range(1, copies + 1)) c(copy)
"""
