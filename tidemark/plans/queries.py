"""The registered queries of the change-log engine, each with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import decode, stats
from tidemark.functions.keys import lsn_number, murmur2, partition_for, record_key
from tidemark.operators import delivery, envelope, merge, reconcile, recovery, shared
from tidemark.operators import fold as folding
from tidemark.operators.stretches import SHIFTS, numbered
from tidemark.plans.streams import PAYLOAD, SLOT, change_stream
from tidemark.sources import tables
from tidemark.sources.logs import frame_counts, frame_volume, table_as_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARTITIONS = 6
COLUMNS = [*SLOT, *PAYLOAD]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cs(key: str = "row", order: str = "shuffled", ties: bool = False) -> str:
    """Common table expressions: c, the changes, and ev, the events with tombstones."""
    of = "'{\"user_id\":' || user_id || ',\"line_no\":' || line_no || '}'" if key == "row" else "'{\"user_id\":' || user_id || '}'"
    arrival = "(seq % 1000003 * 7919) % 1000003 * 8796093022208 + seq // 1000003" if order == "shuffled" else "seq"
    return f"""c AS (
  SELECT CAST({"event_id // 2" if ties else "event_id"} AS BIGINT) AS lsn, event_id, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
    user_id, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) % 10 AS line_no, CAST(floor(value * 100) AS BIGINT) AS cents, event_type FROM events
), e0 AS (
  SELECT lsn, op, user_id, line_no, cents, event_type, {of} AS record_key, false AS tombstone, event_id * 2 AS seq FROM c
  UNION ALL SELECT lsn, op, user_id, line_no, NULL, NULL, {of}, true, event_id * 2 + 1 FROM c WHERE op = 'd'
), ev AS (SELECT *, {arrival} AS arrival FROM e0)"""


def dense(events: DataFrame, order: str = "shuffled") -> DataFrame:
    """arrival as a rank from 1; no two rows have the same arrival."""
    met = numbered(events, [], "arrival", "_rank", shifts=delivery.SCATTERED if order == "shuffled" else SHIFTS)
    return met.withColumn("arrival", F.col("_rank") + 1).drop("_rank")


RANKED = ", rk AS (SELECT * EXCLUDE (arrival), row_number() OVER (ORDER BY arrival) AS arrival FROM ev)"


def batched(spark: SparkSession, sf_dir: str, key: str = "row", order: str = "shuffled", size: int = 250) -> DataFrame:
    return delivery.batches(dense(change_stream(spark, sf_dir, key, order), order), size)


def bt(key: str = "row", order: str = "shuffled", size: int = 250) -> str:
    return f"WITH {cs(key, order)}{RANKED}, bt AS (SELECT *, (arrival - 1) // {size} + 1 AS batch FROM rk)"


# --- the fold ---

FOLDED = """, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line_no ORDER BY {by}) AS n FROM ev WHERE NOT tombstone) WHERE n = 1)
SELECT user_id, line_no, event_type, cents, lsn FROM w WHERE op <> 'd'{more}"""
AFTER = " AND NOT EXISTS (SELECT 1 FROM ev t WHERE t.tombstone AND t.record_key = w.record_key AND t.arrival > w.arrival{gate})"
GATE = " AND t.lsn >= w.lsn"


def folded(spark, sf_dir, key="row", order="shuffled", ties=False, **options):
    return folding.fold(change_stream(spark, sf_dir, key, order, ties), SLOT, **options).select(*COLUMNS, "lsn")


@query(f"WITH {cs()}" + FOLDED.format(by="lsn DESC, arrival DESC", more=AFTER.format(gate=GATE)))
def fold_guarded_shuffled(spark, sf_dir):
    return folded(spark, sf_dir)


@query(f"WITH {cs(order='log')}" + FOLDED.format(by="lsn DESC, arrival DESC", more=AFTER.format(gate=GATE)))
def fold_log_order(spark, sf_dir):
    return folded(spark, sf_dir, order="log")


LOG_FOLD = f"WITH {cs(order='log')}" + FOLDED.format(by="lsn DESC, arrival DESC", more=AFTER.format(gate=GATE))


def interleaved(spark, sf_dir, key="row"):
    """Places among hashes take several passes, so what they are taken of is written between."""
    root = shared.folder(spark, "interleaved")
    routed = shared.kept(delivery.route(change_stream(spark, sf_dir, key), PARTITIONS), f"{root}/routed")
    mixed = shared.kept(delivery.interleave(routed, seed=11).drop("arrival"), f"{root}/mixed")
    return shared.kept(numbered(mixed, [], "arrival_key", "arrival", then=["partition", "offset"]), f"{root}/placed")


@query(LOG_FOLD)
def fold_interleaved(spark, sf_dir):
    """Partitions keep their order, so any interleaving gives what log order gives."""
    return folding.fold(interleaved(spark, sf_dir), SLOT).select(*COLUMNS, "lsn")


@query(LOG_FOLD)
def fold_interleaved_open(spark, sf_dir):
    """Even without the guard, while the record key is the row's key."""
    return folding.fold(interleaved(spark, sf_dir), SLOT, guard=False).select(*COLUMNS, "lsn")


@query(LOG_FOLD)
def fold_compacted(spark, sf_dir):
    return folding.fold(delivery.compact(change_stream(spark, sf_dir, order="log")), SLOT).select(*COLUMNS, "lsn")


@query(f"WITH {cs(ties=True)}" + FOLDED.format(by="lsn DESC, arrival DESC", more=AFTER.format(gate=GATE)))
def fold_ties(spark, sf_dir):
    return folded(spark, sf_dir, ties=True)


@query(f"WITH {cs()}" + FOLDED.format(by="arrival DESC", more=AFTER.format(gate="")))
def fold_open_shuffled(spark, sf_dir):
    return folded(spark, sf_dir, guard=False)


@query(f"WITH {cs('order')}" + FOLDED.format(by="lsn DESC, arrival DESC", more=AFTER.format(gate=GATE)))
def tombstone_delete_wide_key(spark, sf_dir):
    return folded(spark, sf_dir, key="order")


@query(f"WITH {cs('order')}" + FOLDED.format(by="lsn DESC, arrival DESC", more=""))
def tombstone_ignore(spark, sf_dir):
    return folded(spark, sf_dir, key="order", on_tombstone="ignore")


@query(f"WITH {cs('order')}" + """, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY lsn DESC, arrival DESC) AS n FROM ev WHERE NOT tombstone) WHERE n = 1)
SELECT user_id, line_no, event_type, cents, lsn FROM w WHERE op <> 'd'""")
def fold_record_key_shortcut(spark, sf_dir):
    return folding.fold(change_stream(spark, sf_dir, "order"), ["record_key"], on_tombstone="ignore").select(*COLUMNS, "lsn")


COUNTERS = """, r AS (
  SELECT user_id, line_no, lsn, arrival AS pos, op AS act FROM ev WHERE NOT tombstone{marks}
), h AS (
  SELECT *, max(CASE WHEN act <> 't' THEN lsn END) OVER (PARTITION BY user_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM r
), a AS (SELECT *, CASE WHEN hw IS NULL THEN act <> 't' ELSE lsn >= hw END AS ok FROM h),
p AS (SELECT *, last_value(CASE WHEN ok THEN act END IGNORE NULLS) OVER (PARTITION BY user_id, line_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM a)
SELECT (SELECT count(*) FROM ev) AS records, (SELECT count(*) FROM ev WHERE tombstone) AS tombstones, CAST(0 AS BIGINT) AS changes_with_no_merge_key,
  count(*) FILTER (act <> 't' AND NOT ok) AS stale_dropped, count(*) FILTER (act <> 't' AND lsn = hw) AS same_position,
  count(*) FILTER (act = 'd' AND ok) AS deletes, count(*) FILTER (act = 'd' AND ok AND coalesce(prior, 'd') IN ('d', 't')) AS deletes_of_a_row_not_held,
  count(*) FILTER (act = 'u' AND ok AND coalesce(prior, 'd') IN ('d', 't')) AS updates_of_a_row_not_held, count(*) FILTER (act IN ('c', 'u') AND ok) AS upserts,
  count(*) FILTER (act = 't' AND ok AND prior IN ('c', 'u')) AS rows_removed_by_tombstones FROM p"""
MARKS = """
  UNION ALL SELECT s.user_id, s.line_no, t.lsn, t.arrival, 't' FROM (SELECT DISTINCT user_id, line_no, record_key FROM ev WHERE NOT tombstone) s JOIN ev t ON t.tombstone AND t.record_key = s.record_key"""


@query(f"WITH {cs()}" + COUNTERS.format(marks=MARKS))
def fold_counters(spark, sf_dir):
    return folding.counters(change_stream(spark, sf_dir), SLOT)


@query(f"WITH {cs(ties=True)}" + COUNTERS.format(marks=MARKS))
def fold_counters_ties(spark, sf_dir):
    return folding.counters(change_stream(spark, sf_dir, ties=True), SLOT)


@query(f"WITH {cs('order')}" + COUNTERS.format(marks=MARKS))
def fold_counters_wide_key(spark, sf_dir):
    return folding.counters(change_stream(spark, sf_dir, "order"), SLOT)


@query(f"WITH {cs('order')}" + COUNTERS.format(marks=""))
def fold_counters_tombstones_ignored(spark, sf_dir):
    return folding.counters(change_stream(spark, sf_dir, "order"), SLOT, on_tombstone="ignore")


# --- envelopes, keys, routing ---


@query(f"WITH {cs()} SELECT record_key, op, event_type, cents, lsn, tombstone, seq FROM ev")
def envelope_with_tombstones(spark, sf_dir):
    return change_stream(spark, sf_dir).select("record_key", "op", "event_type", "cents", "lsn", "tombstone", "seq")


REUSE = """ SELECT count(*) AS keys, count(*) FILTER (n > 1) AS keys_carrying_more_than_one_row, max(n) AS max_rows_under_one_key
FROM (SELECT record_key, count(DISTINCT (user_id, line_no)) AS n FROM ev WHERE NOT tombstone GROUP BY 1)"""


@query(f"WITH {cs()}" + REUSE)
def key_reuse_row(spark, sf_dir):
    return envelope.key_reuse(change_stream(spark, sf_dir), SLOT)


@query(f"WITH {cs('order')}" + REUSE)
def key_reuse_order(spark, sf_dir):
    return envelope.key_reuse(change_stream(spark, sf_dir, "order"), SLOT)


def murmur_sql(source: str) -> str:
    """source has rk, ASCII text; gives rk and h."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF

    def b(i: str) -> str:
        return f"CAST(ascii(substr(rk, CAST({i} AS INT) + 1, 1)) AS BIGINT)"

    k1 = f"(({b('j * 4')} + {b('j * 4 + 1')} * 256 + {b('j * 4 + 2')} * 65536 + {b('j * 4 + 3')} * 16777216) * {m}) & {mask}"
    return f"""m0 AS (SELECT rk, length(rk) AS n FROM {source}),
m1 AS (SELECT rk, n, list_transform(range(0, n // 4), lambda j: (xor({k1}, ({k1}) >> 24) * {m}) & {mask}) AS ks FROM m0),
m2 AS (SELECT rk, n, list_reduce(ks, lambda h, k: xor((h * {m}) & {mask}, k), xor(CAST({0x9747B28C} AS BIGINT), CAST(n AS BIGINT))) AS h FROM m1),
m3 AS (SELECT rk, CASE WHEN n % 4 = 0 THEN h ELSE (xor(xor(h, CASE WHEN n % 4 = 3 THEN {b('n - n % 4 + 2')} * 65536 ELSE 0 END), xor(CASE WHEN n % 4 >= 2 THEN {b('n - n % 4 + 1')} * 256 ELSE 0 END, {b('n - n % 4')})) * {m}) & {mask} END AS h FROM m2),
m4 AS (SELECT rk, (xor(h, h >> 13) * {m}) & {mask} AS h FROM m3),
mh AS (SELECT rk, xor(h, h >> 15) AS h FROM m4)"""


@query(f"WITH {cs()}, k AS (SELECT DISTINCT record_key AS rk FROM ev), {murmur_sql('k')} SELECT rk AS record_key, h AS hash, CAST((h & 2147483647) % {PARTITIONS} AS INT) AS \"partition\" FROM mh")
def murmur2_partition(spark, sf_dir):
    keys = change_stream(spark, sf_dir).select("record_key").distinct()
    return keys.select("record_key", murmur2(F.col("record_key")).alias("hash"), partition_for(F.col("record_key"), PARTITIONS).alias("partition"))


ROUTED = f"""WITH {cs()}, k AS (SELECT DISTINCT record_key AS rk FROM ev), {murmur_sql('k')},
rt AS (SELECT ev.*, CAST((h & 2147483647) % {PARTITIONS} AS INT) AS p FROM ev JOIN mh ON rk = record_key)"""


@query(ROUTED + " SELECT seq, p AS \"partition\", row_number() OVER (PARTITION BY p ORDER BY seq) - 1 AS \"offset\" FROM rt")
def route_offsets(spark, sf_dir):
    return delivery.route(change_stream(spark, sf_dir), PARTITIONS).select("seq", "partition", "offset")


@query(ROUTED + f" SELECT CAST(r.p AS INT) AS \"partition\", count(rt.p) AS records FROM range({PARTITIONS}) r(p) LEFT JOIN rt ON rt.p = r.p GROUP BY 1")
def partition_spread(spark, sf_dir):
    return delivery.partition_spread(delivery.route(change_stream(spark, sf_dir), PARTITIONS), PARTITIONS)


@query(ROUTED + " SELECT count(*) AS records, CAST(0 AS BIGINT) AS out_of_order FROM rt")
def interleave_offsets(spark, sf_dir):
    """An interleaving keeps every partition's order: no record comes before one of a lower offset."""
    routed = shared.kept(delivery.route(change_stream(spark, sf_dir), PARTITIONS), shared.folder(spark, "routed"))
    mixed = delivery.interleave(routed, seed=11)
    w = Window.partitionBy("partition").orderBy("arrival_key", "offset")
    return mixed.withColumn("_prev", F.lag("offset").over(w)).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("_prev") > F.col("offset")).alias("out_of_order"))


@query(f"WITH {cs()}{RANKED} SELECT seq, arrival FROM rk")
def shuffle_order(spark, sf_dir):
    return dense(change_stream(spark, sf_dir)).select("seq", "arrival")


@query(bt() + " SELECT batch, count(*) AS records, min(arrival) AS first_arrival, max(arrival) AS last_arrival FROM bt GROUP BY 1")
def batch_assign(spark, sf_dir):
    return batched(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("records"), F.min("arrival").alias("first_arrival"), F.max("arrival").alias("last_arrival"))


COMPACT = " SELECT seq, record_key, op, lsn FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY arrival DESC) AS n FROM ev) WHERE n = 1 AND NOT tombstone"


@query(f"WITH {cs(order='log')}" + COMPACT)
def compaction_row(spark, sf_dir):
    return delivery.compact(change_stream(spark, sf_dir, order="log")).select("seq", "record_key", "op", "lsn")


@query(f"WITH {cs('order')}" + COMPACT)
def compaction_order(spark, sf_dir):
    return delivery.compact(change_stream(spark, sf_dir, "order")).select("seq", "record_key", "op", "lsn")


@query(f"WITH {cs('order')} SELECT count(*) AS same_key FROM ev a JOIN ev b ON a.record_key = b.record_key AND a.arrival < b.arrival AND a.lsn > b.lsn")
def disorder_same_key(spark, sf_dir):
    return delivery.same_key_inversions(change_stream(spark, sf_dir, "order"))


@query(f"""WITH {cs()}, i AS (SELECT count(*) AS n FROM ev a JOIN ev b ON a.arrival < b.arrival AND a.lsn > b.lsn),
k AS (SELECT count(*) AS n FROM ev a JOIN ev b ON a.record_key = b.record_key AND a.arrival < b.arrival AND a.lsn > b.lsn)
SELECT (SELECT count(*) FROM ev) AS records, i.n AS inversions, k.n AS same_key, i.n - k.n AS cross_key FROM i, k""")
def disorder_total(spark, sf_dir):
    return delivery.disorder(dense(change_stream(spark, sf_dir)))


LINES = """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
k AS (SELECT DISTINCT {key} AS rk FROM l), """


def split_sql(key: str) -> str:
    return LINES.format(key=key) + murmur_sql("k") + f""", p AS (SELECT l_orderkey, (h & 2147483647) % {PARTITIONS} AS p FROM l JOIN mh ON rk = {key}),
f AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT p) AS ps FROM p GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (n > 1) AS splittable, count(*) FILTER (n > 1 AND ps > 1) AS split, round(count(*) FILTER (n > 1 AND ps > 1)::DOUBLE / nullif(count(*) FILTER (n > 1), 0), 4) AS rate FROM f"""


def split_of(spark, sf_dir, *key):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    return delivery.split_rate(lines.withColumn("partition", partition_for(record_key(*key), PARTITIONS)), ["l_orderkey"])


@query(split_sql("'{\"l_orderkey\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || '}'"))
def split_rate_default(spark, sf_dir):
    return split_of(spark, sf_dir, "l_orderkey", "l_linenumber")


@query(split_sql("'{\"l_orderkey\":' || l_orderkey || '}'"))
def split_rate_routed(spark, sf_dir):
    return split_of(spark, sf_dir, "l_orderkey")


# --- batches and merge ---

REDUCED = ", rd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, user_id, line_no ORDER BY lsn DESC, arrival DESC) AS n FROM bt WHERE NOT tombstone) WHERE n = 1)"


@query(bt() + REDUCED + " SELECT batch, user_id, line_no, op, lsn, arrival FROM rd")
def reduce_batch_rows(spark, sf_dir):
    return merge.reduce_batch(batched(spark, sf_dir), SLOT, per=["batch"]).select("batch", *SLOT, "op", "lsn", "arrival")


@query(bt() + REDUCED + """, a AS (SELECT batch, count(*) AS records, count(*) FILTER (tombstone) AS tombstones, count(DISTINCT CASE WHEN tombstone THEN record_key END) AS tombstoned_keys FROM bt GROUP BY 1),
s AS (SELECT batch, count(*) AS staged FROM rd GROUP BY 1)
SELECT a.batch, records, tombstones, CAST(0 AS BIGINT) AS no_merge_key, tombstoned_keys, coalesce(staged, 0) AS staged_rows, records - tombstones - coalesce(staged, 0) AS superseded FROM a LEFT JOIN s USING (batch)""")
def reduce_batch_counters(spark, sf_dir):
    return merge.reduction_counters(batched(spark, sf_dir), SLOT)


def merged_sql(by: str) -> str:
    return REDUCED + f""", l AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY user_id, line_no ORDER BY {by}) AS n FROM rd) WHERE n = 1),
tb AS (SELECT batch AS b, record_key AS k, max(lsn) AS t FROM bt WHERE tombstone GROUP BY ALL),
st AS (SELECT user_id, line_no, event_type, cents, record_key AS cdc_record_key, lsn AS cdc_lsn, op = 'd' OR hit IS NOT NULL AS cdc_deleted, coalesce(hit, batch) AS cdc_batch FROM
  (SELECT l.*, (SELECT min(b) FROM tb WHERE k = l.record_key AND b >= l.batch AND t >= l.lsn AND l.op <> 'd') AS hit FROM l))"""


MERGED = merged_sql("lsn DESC, batch")


def merged(spark, sf_dir, key="row", order="shuffled", size=250, **options):
    return merge.merged_state(batched(spark, sf_dir, key, order, size), SLOT, COLUMNS, **options)


@query(bt() + MERGED + " SELECT * FROM st")
def merge_final_state(spark, sf_dir):
    return merged(spark, sf_dir)


@query(bt("order") + MERGED + " SELECT * FROM st")
def merge_wide_key(spark, sf_dir):
    return merged(spark, sf_dir, "order")


@query(bt() + merged_sql("batch DESC") + " SELECT * FROM st")
def merge_open(spark, sf_dir):
    return merged(spark, sf_dir, guard=False)


@query(bt(order="log") + MERGED + " SELECT * FROM st")
def merge_log_order(spark, sf_dir):
    return merged(spark, sf_dir, order="log")


@query(bt() + " SELECT user_id, line_no, event_type, cents, record_key AS cdc_record_key, lsn AS cdc_lsn, op = 'd' AS cdc_deleted, batch AS cdc_batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line_no, lsn ORDER BY batch, arrival DESC) AS n FROM bt WHERE NOT tombstone) WHERE n = 1")
def merge_versioned(spark, sf_dir):
    return merge.versioned_state(batched(spark, sf_dir), SLOT, COLUMNS)


PURGED = REDUCED + """, mk AS (SELECT batch, record_key, max(lsn) AS t FROM bt WHERE tombstone GROUP BY ALL),
al AS (SELECT coalesce(rd.record_key, mk.record_key) AS record_key, coalesce(rd.batch, mk.batch) AS batch, lsn, op, user_id, line_no, event_type, cents, t FROM rd FULL JOIN mk ON rd.record_key = mk.record_key AND rd.batch = mk.batch),
sq AS (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY batch) AS k FROM al),
go AS (
  SELECT record_key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS lsn, CAST(NULL AS BIGINT) AS src FROM (SELECT DISTINCT record_key FROM sq)
  UNION ALL SELECT record_key, k, CASE WHEN gone THEN NULL ELSE lsn END, CASE WHEN gone THEN NULL ELSE src END FROM
    (SELECT record_key, k, lsn, src, coalesce((src = k AND op = 'd') OR t >= lsn, false) AS gone FROM
      (SELECT s.record_key, s.k, s.op, s.t, CASE WHEN s.lsn IS NOT NULL AND (g.lsn IS NULL OR s.lsn > g.lsn) THEN s.lsn ELSE g.lsn END AS lsn, CASE WHEN s.lsn IS NOT NULL AND (g.lsn IS NULL OR s.lsn > g.lsn) THEN s.k ELSE g.src END AS src
       FROM go g JOIN sq s ON s.record_key = g.record_key AND s.k = g.k + 1))
), la AS (SELECT record_key, max(k) AS k FROM sq GROUP BY 1),
pu AS (SELECT s.user_id, s.line_no, s.event_type, s.cents, s.record_key AS cdc_record_key, s.lsn AS cdc_lsn, s.op = 'd' AS cdc_deleted, s.batch AS cdc_batch FROM la JOIN go ON go.record_key = la.record_key AND go.k = la.k JOIN sq s ON s.record_key = go.record_key AND s.k = go.src)"""


@query(bt().replace("WITH", "WITH RECURSIVE", 1) + PURGED + " SELECT * FROM pu")
def merge_hard_delete_shuffled(spark, sf_dir):
    """The losing arm: flagged rows are deleted after every batch of a shuffled stream."""
    return merge.purged_state(batched(spark, sf_dir), SLOT, COLUMNS)


@query(bt().replace("WITH", "WITH RECURSIVE", 1) + PURGED + MERGED.removeprefix(REDUCED) + " SELECT count(*) AS brought_back FROM pu WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.cdc_record_key = pu.cdc_record_key AND NOT st.cdc_deleted)")
def merge_brought_back(spark, sf_dir):
    """Rows that are there although their last change was a delete, because its position had been deleted."""
    events = batched(spark, sf_dir)
    live = merge.purge(merge.merged_state(events, SLOT, COLUMNS)).select("cdc_record_key")
    return merge.purged_state(events, SLOT, COLUMNS).join(live, "cdc_record_key", "left_anti").agg(F.count(F.lit(1)).alias("brought_back"))


@query(bt() + ", d AS (SELECT batch, user_id, line_no, count(*) AS n FROM bt WHERE NOT tombstone GROUP BY ALL HAVING count(*) > 1) SELECT batch, count(*) AS slots, CAST(sum(n - 1) AS BIGINT) AS rows_too_many FROM d GROUP BY 1")
def merge_unreduced(spark, sf_dir):
    """The losing arm that merge() refuses: what an unreduced stage would hold twice."""
    return merge.staged_twice(batched(spark, sf_dir), SLOT)


@query("SELECT true AS same_rows, true AS same_hash")
def replay_twice(spark, sf_dir):
    """All batches again, after all of them: not a row and not a batch number changes."""
    once = batched(spark, sf_dir)
    last = once.agg(F.max("batch")).first()[0] or 0  # one number
    twice = once.unionByName(once.withColumn("batch", F.col("batch") + last))
    a, b = (merge.fingerprint(merge.merged_state(x, SLOT, COLUMNS)) for x in (once, twice))
    return a.crossJoin(b.select(F.col("rows").alias("r"), F.col("hash").alias("h"))).select((F.col("rows") == F.col("r")).alias("same_rows"), (F.col("hash") == F.col("h")).alias("same_hash"))


@query(f"WITH {cs()} SELECT count(*) AS records, count(*) FILTER (user_id % 10 = 3) AS unknown_topic FROM ev")
def unknown_topics(spark, sf_dir):
    """Events of users ending in 3 come on a topic that no target has."""
    events = change_stream(spark, sf_dir).withColumn("topic", F.when(F.col("user_id") % 10 == 3, "cdc.shop.other").otherwise(F.col("topic")))
    return merge.topic_counts(events, spark.createDataFrame([("cdc.shop.event",), ("cdc.shop.user",)], "topic string"))


@query(bt(order="log") + MERGED + " SELECT * FROM st WHERE NOT cdc_deleted")
def merge_hard_delete(spark, sf_dir):
    """In log order hard deletes lose nothing, so what they leave are the live rows."""
    return merge.purge(merged(spark, sf_dir, order="log"))


@query(bt() + MERGED + " SELECT count(*) AS total, count(*) FILTER (NOT cdc_deleted) AS live, count(*) FILTER (cdc_deleted) AS soft_deleted FROM st")
def merge_counts(spark, sf_dir):
    return merge.counts(merged(spark, sf_dir))


@query(bt("order") + MERGED + " SELECT count(*) FILTER (hit) AS removed FROM (SELECT st.cdc_deleted AND l.op <> 'd' AS hit FROM st JOIN l USING (user_id, line_no))")
def merge_removed_by_tombstone(spark, sf_dir):
    """Rows whose last change is no delete and that a tombstone of their record key has flagged."""
    rows = batched(spark, sf_dir, "order")
    with_marks, without = (merge.merged_state(rows, SLOT, COLUMNS, on_tombstone=t).select(*SLOT, F.col("cdc_deleted").alias(t)) for t in ("delete", "ignore"))
    return with_marks.join(without, SLOT).agg(F.count_if(F.col("delete") & ~F.col("ignore")).alias("removed"))


@query("SELECT true AS same_rows, true AS same_hash")
def fingerprint_equal(spark, sf_dir):
    """Batch sizes decide nothing but batch numbers."""
    a, b = (merge.fingerprint(merged(spark, sf_dir, size=n), include_batch=False) for n in (37, 1000))
    return a.crossJoin(b.select(F.col("rows").alias("r"), F.col("hash").alias("h"))).select((F.col("rows") == F.col("r")).alias("same_rows"), (F.col("hash") == F.col("h")).alias("same_hash"))


@query(bt() + MERGED + " SELECT user_id, line_no, event_type, cents FROM st WHERE NOT cdc_deleted")
def live_rows(spark, sf_dir):
    return merge.live_rows(merged(spark, sf_dir), COLUMNS)


# --- recovery ---

GAP = """WITH {cs}, o AS (SELECT seq, row_number() OVER (ORDER BY arrival) AS x, row_number() OVER (ORDER BY (seq % 1000003 * {factor}) % 1000003, seq) AS y FROM ev),
i AS (SELECT (x - 1) // 250 + 1 AS b, (y - 1) // {size} + 1 AS a FROM o)"""
GAP_ROW = " SELECT {extra}count(*) AS records, count(*) FILTER (b < 7) AS applied, count(*) FILTER (a >= 7) AS replayed, count(*) FILTER (b >= 7 AND a < 7) AS dropped, count(*) FILTER (b < 7 AND a >= 7) AS applied_twice, count(*) FILTER (b < 7) = count(*) FILTER (a < 7) AS prefix_sizes_agree FROM i"
SIZES = (100, 180, 250, 320, 400, 600)
FACTORS = (7919, 104729, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301)


def gap(spark, sf_dir, factor: int, size: int) -> DataFrame:
    first = dense(change_stream(spark, sf_dir)).select("seq", F.expr("(arrival - 1) div 250 + 1").alias("before"))
    again = dense(change_stream(spark, sf_dir).withColumn("arrival", delivery.scattered(F.col("seq"), factor=factor))).select("seq", F.expr(f"(arrival - 1) div {size} + 1").alias("after"))
    return recovery.resume_gap(first.join(again, "seq"), 7)


@query(GAP.format(cs=cs(), factor=104729, size=250) + GAP_ROW.format(extra=""))
def resume_gap(spark, sf_dir):
    return gap(spark, sf_dir, 104729, 250)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("\nUNION ALL ".join("SELECT * FROM (" + GAP.format(cs=cs(), factor=7919, size=n) + GAP_ROW.format(extra=f"CAST({n} AS INT) AS size, ") + ")" for n in SIZES))
def resume_gap_sizes(spark, sf_dir):
    return union_all([gap(spark, sf_dir, 7919, n).withColumn("size", F.lit(n)) for n in SIZES])


@query("\nUNION ALL ".join("SELECT * FROM (" + GAP.format(cs=cs(), factor=f, size=250) + GAP_ROW.format(extra=f"CAST({f} AS INT) AS factor, ") + ")" for f in FACTORS))
def resume_gap_seeds(spark, sf_dir):
    return union_all([gap(spark, sf_dir, f, 250).withColumn("factor", F.lit(f)) for f in FACTORS])


@query(bt() + ", lost AS (SELECT * FROM bt WHERE batch <> 7)" + MERGED.replace("FROM bt", "FROM lost") + " SELECT * FROM st")
def offset_before_merge(spark, sf_dir):
    """An offset committed before a merge that crashed skips batch 7."""
    return merge.merged_state(batched(spark, sf_dir).where("batch <> 7"), SLOT, COLUMNS)


# --- reconciliation ---

LAG = """WITH {cs}{ranked}, z AS (SELECT count(*) AS n FROM rk), ap AS (SELECT rk.* FROM rk, z WHERE arrival <= round_even(n * {f}, 0)), hb AS (SELECT rk.* FROM rk, z WHERE arrival > round_even(n * {f}, 0)),
src AS (SELECT user_id, line_no, event_type, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line_no ORDER BY lsn DESC) AS n FROM ev WHERE NOT tombstone) WHERE n = 1 AND op <> 'd'),
tg AS (SELECT user_id, line_no, event_type, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line_no ORDER BY lsn DESC) AS n FROM ap WHERE NOT tombstone) WHERE n = 1 AND op <> 'd'),
fl AS (SELECT DISTINCT user_id, line_no FROM hb WHERE NOT tombstone),
m AS (SELECT coalesce(s.user_id, t.user_id) AS user_id, coalesce(s.line_no, t.line_no) AS line_no, s.user_id IS NOT NULL AS l, t.user_id IS NOT NULL AS r, s.event_type AS se, t.event_type AS te, s.cents AS sc, t.cents AS tc,
  {held} AS held FROM src s FULL JOIN tg t ON s.user_id = t.user_id AND s.line_no = t.line_no)"""
HELD = "EXISTS (SELECT 1 FROM fl WHERE fl.user_id = coalesce(s.user_id, t.user_id) AND fl.line_no = coalesce(s.line_no, t.line_no))"
REPORT = """, rp AS (SELECT count(*) AS keys_either_side, count(*) FILTER (NOT held) AS keys_checked, count(*) FILTER (NOT held AND l AND r AND se IS NOT DISTINCT FROM te AND sc IS NOT DISTINCT FROM tc) AS matching,
  count(*) FILTER (NOT held AND l AND NOT r) AS missing_in_target, count(*) FILTER (NOT held AND NOT l AND r) AS extra_in_target,
  count(*) FILTER (NOT held AND l AND r AND (se IS DISTINCT FROM te OR sc IS DISTINCT FROM tc)) AS differing, CAST(0 AS BIGINT) AS duplicate_in_source, CAST(0 AS BIGINT) AS duplicate_in_target FROM m),
rv AS (SELECT *, round(keys_checked::DOUBLE / nullif(keys_either_side, 0), 4) AS coverage, CASE WHEN missing_in_target + extra_in_target + differing + duplicate_in_target > 0 THEN 'drift' WHEN keys_checked = 0 THEN 'no_coverage' WHEN keys_checked < keys_either_side THEN 'clean_partial' ELSE 'clean' END AS verdict FROM rp)"""


def lag_sql(f: float, excluded: bool, tail: str = " SELECT * FROM rv") -> str:
    return LAG.format(cs=cs(order="log"), ranked=RANKED, f=f, held=HELD if excluded else "false") + REPORT + tail


def lagged(spark, sf_dir, f: float):
    events = dense(change_stream(spark, sf_dir, order="log"), "log")
    n = events.count()
    applied, back = delivery.prefix_cut(events, f, n)
    source = folding.fold(events, SLOT, on_tombstone="ignore").select(*COLUMNS)
    target = folding.fold(applied, SLOT, on_tombstone="ignore").select(*COLUMNS)
    return source, target, reconcile.keys_in_flight(back, SLOT)[0]


def report(spark, sf_dir, f: float, excluded: bool) -> DataFrame:
    source, target, flight = lagged(spark, sf_dir, f)
    return reconcile.reconcile(source, target, COLUMNS, SLOT, flight if excluded else None)


for _name, _f in (("quiesced", 1.0), ("lag25", 0.75), ("lag50", 0.5), ("lag75", 0.25)):
    for _excluded in (False, True):
        _key = f"reconcile_{_name}" + "_excluded" * _excluded
        QUERIES[_key] = lambda spark, sf_dir, f=_f, x=_excluded: report(spark, sf_dir, f, x)
        ORACLE_SQL[_key] = lag_sql(_f, _excluded)


@query(lag_sql(0.75, False, " SELECT 'event_type' AS \"column\", count(*) AS keys FROM m WHERE l AND r AND se IS DISTINCT FROM te HAVING count(*) > 0 UNION ALL SELECT 'cents', count(*) FROM m WHERE l AND r AND sc IS DISTINCT FROM tc HAVING count(*) > 0"))
def reconcile_columns_moved(spark, sf_dir):
    source, target, _ = lagged(spark, sf_dir, 0.75)
    return reconcile.columns_differing(source, target, COLUMNS, SLOT)


def several(spark, sf_dir):
    return union_all([report(spark, sf_dir, f, True) for f in (1.0, 0.5)])


SEVERAL = "WITH ra AS (" + lag_sql(1.0, True) + "), rb AS (" + lag_sql(0.5, True) + "), rs AS (SELECT * FROM ra UNION ALL SELECT * FROM rb)"


@query(SEVERAL + " SELECT CASE min(CASE verdict WHEN 'drift' THEN 1 WHEN 'no_coverage' THEN 2 WHEN 'clean_partial' THEN 3 ELSE 4 END) WHEN 1 THEN 'drift' WHEN 2 THEN 'no_coverage' WHEN 3 THEN 'clean_partial' ELSE 'clean' END AS verdict FROM rs")
def reconcile_rollup(spark, sf_dir):
    return reconcile.rollup(several(spark, sf_dir))


ONE = """, ol AS (SELECT CAST(sum(keys_either_side) AS BIGINT) AS keys_either_side, CAST(sum(keys_checked) AS BIGINT) AS keys_checked, CAST(sum(missing_in_target) AS BIGINT) AS missing_in_target, CAST(sum(extra_in_target) AS BIGINT) AS extra_in_target, CAST(sum(differing) AS BIGINT) AS differing, CAST(sum(duplicate_in_target) AS BIGINT) AS duplicate_in_target FROM rs),
o2 AS (SELECT *, round(keys_checked::DOUBLE / nullif(keys_either_side, 0), 4) AS coverage, missing_in_target + extra_in_target + differing + duplicate_in_target AS mismatched FROM ol)"""


@query("SELECT 'no_coverage' AS verdict")
def reconcile_rollup_of_nothing(spark, sf_dir):
    """No report at all is no coverage, never clean."""
    return reconcile.rollup(report(spark, sf_dir, 1.0, False).where("keys_either_side < 0"))


@query("SELECT 'even' AS \"table\", * FROM (" + lag_sql(0.5, True).replace("FROM src s FULL JOIN tg t", "FROM (SELECT * FROM src WHERE user_id % 2 = 0) s FULL JOIN (SELECT * FROM tg WHERE user_id % 2 = 0) t") + ") UNION ALL SELECT 'odd', * FROM (" + lag_sql(0.5, False).replace("FROM src s FULL JOIN tg t", "FROM (SELECT * FROM src WHERE user_id % 2 = 1) s FULL JOIN (SELECT * FROM tg WHERE user_id % 2 = 1) t") + ")")
def reconcile_run(spark, sf_dir):
    """Two targets at once, users by parity; of the odd ones keys in flight are not left out."""
    source, target, flight = lagged(spark, sf_dir, 0.5)
    tables = {name: (source.where(f"user_id % 2 = {k}"), target.where(f"user_id % 2 = {k}"), COLUMNS, SLOT) for k, name in enumerate(("even", "odd"))}
    return reconcile.run(tables, {"even": flight})


@query(SEVERAL + ONE + " SELECT * FROM o2")
def reconcile_one_line(spark, sf_dir):
    return reconcile.one_line(several(spark, sf_dir))


@query(SEVERAL + ONE + " SELECT o2.coverage BETWEEN (SELECT min(coverage) FROM rs) AND (SELECT max(coverage) FROM rs) AS \"between\" FROM o2")
def coverage_between(spark, sf_dir):
    return reconcile.coverage_between(several(spark, sf_dir))


@query(lag_sql(0.75, False, ", a AS (SELECT count(*) AS n FROM (SELECT * FROM src EXCEPT SELECT * FROM tg)), b AS (SELECT count(*) AS n FROM (SELECT * FROM tg EXCEPT SELECT * FROM src)) SELECT a.n AS only_in_source, b.n AS only_in_target, a.n + b.n AS reported FROM a, b"))
def set_difference_view(spark, sf_dir):
    source, target, _ = lagged(spark, sf_dir, 0.75)
    return reconcile.set_difference(source, target, COLUMNS)


def corrupted_sql(excluded: bool) -> str:
    sql = lag_sql(1.0, False).replace("tg AS (SELECT user_id, line_no, event_type, cents FROM", "tg AS (SELECT user_id, line_no, CASE WHEN user_id % 50 = 0 THEN 'corrupt' ELSE event_type END AS event_type, cents FROM")
    return sql.replace("false AS held", "coalesce(s.user_id, t.user_id) % 50 = 0 AS held") if excluded else sql


def corrupted(spark, sf_dir, excluded: bool) -> DataFrame:
    """Rows under excluded keys are broken: only the run without exclusion sees it."""
    source, target, _ = lagged(spark, sf_dir, 1.0)
    broken = reconcile.corrupt(target, F.col("user_id") % 50 == 0, "event_type", "corrupt")
    keys = source.where("user_id % 50 = 0").select(*SLOT)
    return reconcile.reconcile(source, broken, COLUMNS, SLOT, keys if excluded else None)


@query(corrupted_sql(True))
def corrupt_excluded(spark, sf_dir):
    return corrupted(spark, sf_dir, True)


@query(corrupted_sql(False))
def corrupt_seen(spark, sf_dir):
    return corrupted(spark, sf_dir, False)


@query(lag_sql(0.75, False, """, i AS (SELECT count(*) AS n FROM (SELECT * FROM src INTERSECT SELECT * FROM tg)), s AS (SELECT count(*) AS n FROM src), t AS (SELECT count(*) AS n FROM tg)
SELECT s.n AS source_rows, t.n AS applied_rows, i.n AS matching, s.n - i.n AS missing, t.n - i.n AS extra, s.n = i.n AND t.n = i.n AS exact FROM i, s, t"""))
def compare_sets(spark, sf_dir):
    source, target, _ = lagged(spark, sf_dir, 0.75)
    return folding.compare_sets(target, source)


# --- decoding and statistics ---


def lines(spark: SparkSession, sf_dir: str, full: bool = True) -> DataFrame:
    """The change stream as log lines: full images before and after, or keys only in deletes."""
    c = change_stream(spark, sf_dir, order="log", tombstones=False)
    key = F.concat(F.lit("user_id[bigint]:"), F.col("user_id"), F.lit(" line_no[bigint]:"), F.col("line_no"))
    row = F.concat(key, F.lit(" event_type[text]:'it''s "), F.col("event_type"), F.lit(": new-tuple:' tags[text[]]:'{a,b}' cents[bigint]:"), F.coalesce(F.col("cents").cast("string"), F.lit("null")))
    old = F.concat(key, F.lit(" cents[bigint]:-1"))
    data = F.when(F.col("op") == "c", F.concat(F.lit("INSERT: "), row)).when(F.col("op") == "d", F.concat(F.lit("DELETE: "), row if full else key))
    data = data.otherwise(F.concat(F.lit("UPDATE: old-key: "), old, F.lit(" new-tuple: "), row) if full else F.concat(F.lit("UPDATE: "), row))
    rows = c.select("seq", "lsn", F.concat(F.lit("table shop.event: "), data).alias("data"))
    marks = c.select("seq", "lsn", F.explode(F.array(F.concat(F.lit("BEGIN "), F.col("lsn")), F.concat(F.lit("COMMIT "), F.col("lsn")))).alias("data"))
    return rows.unionByName(marks)


@query(f"WITH {cs()} SELECT lsn, 'shop.event' AS \"table\", op, CASE op WHEN 'u' THEN CAST(3 AS INT) WHEN 'd' THEN CAST(5 AS INT) END AS before_fields, CASE WHEN op <> 'd' THEN CAST(5 AS INT) END AS after_fields, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN op = 'u' THEN '-1' WHEN op = 'd' THEN CAST(cents AS VARCHAR) END AS old_cents, CASE WHEN op <> 'd' THEN CAST(cents AS VARCHAR) END AS new_cents, 'it''s ' || event_type || ': new-tuple:' AS event_type FROM c")
def decode_lines(spark, sf_dir):
    d = decode.changes(lines(spark, sf_dir))
    img = decode.chosen_image(F.col("op"), F.col("before"), F.col("after"))
    return d.select("lsn", "table", "op", F.when(F.col("before").isNotNull(), F.size("before")).alias("before_fields"), F.when(F.col("after").isNotNull(), F.size("after")).alias("after_fields"), img["user_id"].alias("user_id"), F.col("before")["cents"].alias("old_cents"), F.col("after")["cents"].alias("new_cents"), img["event_type"].alias("event_type"))


SUMMARY = " SELECT count(*) AS changes, count(*) FILTER (op = 'c') AS inserts, count(*) FILTER (op = 'u') AS updates, count(*) FILTER (op = 'd') AS deletes, {b} AS before_present, {a} AS before_absent, {u} AS updates_with_before, {mb} AS mean_before_fields, 5.0::DOUBLE AS mean_after_fields FROM c"


@query(f"WITH {cs()}" + SUMMARY.format(b="count(*) FILTER (op <> 'c')", a="CAST(0 AS BIGINT)", u="count(*) FILTER (op = 'u')", mb="round(avg(CASE op WHEN 'u' THEN 3.0::DOUBLE WHEN 'd' THEN 5.0::DOUBLE END), 4)"))
def summarise_changes(spark, sf_dir):
    return stats.summarise(decode.changes(lines(spark, sf_dir)))


@query(f"WITH {cs()}" + SUMMARY.format(b="count(*) FILTER (op = 'd')", a="count(*) FILTER (op = 'u')", u="CAST(0 AS BIGINT)", mb="2.0::DOUBLE"))
def summarise_keys_only(spark, sf_dir):
    return stats.summarise(decode.changes(lines(spark, sf_dir, full=False)))


@query(f"WITH {cs()} SELECT round(count(*) FILTER (op = 'd')::DOUBLE / nullif(count(*) FILTER (op <> 'c'), 0), 4) AS before_coverage FROM c")
def before_coverage(spark, sf_dir):
    return stats.before_coverage(stats.summarise(decode.changes(lines(spark, sf_dir, full=False))))


@query(f"WITH {cs()} SELECT 'shop.event' AS \"table\", CASE op WHEN 'c' THEN 'INSERT' WHEN 'u' THEN 'UPDATE' ELSE 'DELETE' END AS action, count(*) AS changes FROM c GROUP BY ALL")
def changes_by_table(spark, sf_dir):
    return stats.by_table(decode.changes(lines(spark, sf_dir)))


@query(f"WITH {cs()}, v AS (SELECT op, user_id, count(*) AS n FROM c GROUP BY ALL) SELECT op, count(*) AS n, min(v.n) AS least, max(v.n) AS most, max(v.n) - min(v.n) AS range, round((max(v.n) - min(v.n))::DOUBLE / nullif(min(v.n), 0), 6) AS relative FROM v GROUP BY 1")
def arm_spread(spark, sf_dir):
    per = change_stream(spark, sf_dir, tombstones=False).groupBy("op", "user_id").agg(F.count(F.lit(1)).alias("v"))
    return stats.spread(per, "v", "op")


@query(f"WITH {cs()}, a AS (SELECT CASE op WHEN 'u' THEN 'default' ELSE op END AS arm, count(*) AS n FROM c GROUP BY 1) SELECT arm, n, round(n::DOUBLE / (SELECT n FROM a WHERE arm = 'default'), 4) AS ratio FROM a")
def arm_compare(spark, sf_dir):
    arms = change_stream(spark, sf_dir, tombstones=False).groupBy(F.when(F.col("op") == "u", "default").otherwise(F.col("op")).alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    return stats.compare_arms(arms, "n")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary frame for each begin, change and commit, and one of an unknown kind for each user 7."""
    c = change_stream(spark, sf_dir, tombstones=False)
    first = F.when(F.col("op") == "c", "I").when(F.col("op") == "u", "U").otherwise("D")
    odd = F.when(F.col("user_id") == 7, F.array(F.unhex(F.lit("FE")), F.unhex(F.lit("")))).otherwise(F.array().cast("array<binary>"))
    texts = F.array(F.lit("B"), first, F.lit("C"))
    return c.select(F.explode(F.concat(F.transform(texts, lambda t: F.encode(F.concat(t, F.lit("xyz")), "utf-8")), odd)).alias("frame"))


KINDS = "SELECT 'begin' AS kind, count(*) AS n FROM c UNION ALL SELECT 'commit', count(*) FROM c UNION ALL SELECT CASE op WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' ELSE 'delete' END, count(*) FROM c GROUP BY 1 UNION ALL SELECT k, count(*) FROM c, (VALUES ('unknown:fe'), ('empty')) t(k) WHERE user_id = 7 GROUP BY 1"


@query(f"WITH {cs()} " + KINDS)
def frame_kinds(spark, sf_dir):
    return frame_counts(frames(spark, sf_dir))


@query(f"WITH {cs()}, k AS ({KINDS}), s AS (SELECT CAST(coalesce(sum(n) FILTER (kind IN ('begin', 'commit')), 0) AS BIGINT) AS framing, CAST(coalesce(sum(n) FILTER (kind IN ('insert', 'update', 'delete')), 0) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS f FROM k) SELECT framing, rows, round(rows::DOUBLE / (framing + rows), 4) AS share, round(rows::DOUBLE / f, 4) AS share_of_all FROM s")
def frame_split(spark, sf_dir):
    return stats.frame_split(frame_counts(frames(spark, sf_dir)))


@query(f"WITH {cs()} SELECT CAST(3 * count(*) + 2 * count(*) FILTER (user_id = 7) AS BIGINT) AS frames, CAST(12 * count(*) + count(*) FILTER (user_id = 7) AS BIGINT) AS bytes FROM c")
def frame_bytes(spark, sf_dir):
    return frame_volume(frames(spark, sf_dir))


@query(f"WITH {cs()}, s AS (SELECT 2 * count(*) AS sf, 8 * count(*) AS pf, count(*) AS r FROM c) SELECT sf AS single_framing, pf AS split_framing, r AS single_rows, r AS split_rows, round(pf::DOUBLE / sf, 4) AS framing_multiple, round((pf + r)::DOUBLE / (sf + r), 4) AS message_multiple, true AS rows_agree FROM s")
def split_cost(spark, sf_dir):
    """Four connectors each see every begin and commit, and only their own rows."""
    c = change_stream(spark, sf_dir, tombstones=False).select((F.col("user_id") % 4).cast("string").alias("connector"))
    kinds = F.array(F.lit("begin"), F.lit("commit"))
    single = c.select(F.lit("single").alias("connector"), F.explode(F.concat(kinds, F.array(F.lit("insert")))).alias("kind"))
    marks = c.select(F.explode(F.array(*[F.lit(str(i)) for i in range(4)])).alias("connector"), F.lit(1).alias("one")).select("connector", F.explode(kinds).alias("kind"))
    rows = c.select("connector", F.lit("insert").alias("kind"))
    return stats.split_cost(single.unionByName(marks).unionByName(rows).groupBy("connector", "kind").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT event_id, event_id * 4294967296 + event_id % 4096 AS lsn, event_id * 4294967296 + event_id % 4096 - 4096 AS bytes_since FROM events")
def lsn_parse(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    text = F.concat(F.hex("event_id"), F.lit("/"), F.hex(F.col("event_id") % 4096))
    return e.withColumn("lsn", lsn_number(text)).withColumn("bytes_since", F.col("lsn") - 4096)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CASE WHEN p = o THEN 'EXACT' ELSE 'MOVED' END ELSE CASE WHEN p = o THEN 'EXACT' WHEN o_orderstatus = 'O' AND abs(o - p) * 1000 <= abs(p) THEN 'WITHIN_BAND' ELSE 'BROKEN' END END AS verdict FROM (SELECT o_orderkey, o_orderstatus, o_orderkey AS p, o_orderkey + o_custkey % 3 AS o FROM orders)")
def figure_verdicts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderstatus") == "F", "timing").when(F.col("o_orderstatus") == "O", "volume").otherwise("counted")
    return o.select("o_orderkey", stats.figure_verdict(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey") % 3, kind).alias("verdict"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey, l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate FROM lineitem")
def source_as_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return table_as_text(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate"])


SLOTS = "sl AS (SELECT 'slot_' || CAST(user_id % 6 AS VARCHAR) AS slot, min(event_id) AS restart_lsn, max(event_id) AS confirmed_lsn FROM events WHERE event_type = 'purchase' GROUP BY 1), cu AS (SELECT max(event_id) AS lsn FROM events)"


def slots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Six consumers, each of which has confirmed its purchases up to its last one; and the log's end."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.col("event_id").alias("lsn"))
    own = e.where("event_type = 'purchase'").groupBy(F.concat(F.lit("slot_"), (F.col("user_id") % 6).cast("string")).alias("slot")).agg(F.min("lsn").alias("restart_lsn"), F.max("lsn").alias("confirmed_lsn"))
    return own, F.lit(tables.current_position(e).first()[0])  # one number


@query(f"WITH {SLOTS} SELECT slot, restart_lsn, confirmed_lsn, lsn - restart_lsn AS retained_bytes, lsn - confirmed_lsn AS unconfirmed_bytes FROM sl, cu")
def slot_positions(spark, sf_dir):
    return tables.slot_positions(*slots(spark, sf_dir))


@query(f"WITH {SLOTS} SELECT slot, lsn - restart_lsn AS retained_bytes FROM sl, cu")
def slot_retention(spark, sf_dir):
    return tables.slot_retention(*slots(spark, sf_dir))


@query("SELECT max(event_id) AS lsn FROM events")
def current_position(spark, sf_dir):
    return tables.current_position(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("lsn")))


@query("SELECT CAST(p_brand AS VARCHAR) AS \"table\", string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR) DESC) FILTER (p_size <= 9) AS key FROM part GROUP BY 1 HAVING count(*) FILTER (p_size <= 9) > 0")
def primary_key_order(spark, sf_dir):
    """A catalog made from parts: a brand is a table, its sizes are attributes; the key is those up to 9, the largest first."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    attributes = p.select(F.col("p_brand").alias("table"), F.col("p_size").alias("number"), F.col("p_size").alias("name")).distinct()
    keys = p.where("p_size <= 9").groupBy(F.col("p_brand").alias("table")).agg(F.sort_array(F.collect_set("p_size"), False).alias("columns"))
    both = keys.withColumn("is_primary", F.lit(True)).unionByName(keys.select("table", F.array(F.lit(1)).alias("columns"), F.lit(False).alias("is_primary")))
    return tables.primary_keys(both, attributes).select("table", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"))
