"""Arms of crashes and restarts: batches of the change stream driven into committed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import delivery, merge, recovery, shared
from tidemark.plans.queries import COLUMNS, SLOT, bt, cs, dense, merged_sql, query, union_all
from tidemark.plans.streams import TOPIC, change_stream
from tidemark.sources.store import SnapshotStore, Target

TARGET = Target("event", TOPIC, {"user_id": "long", "line_no": "long", "event_type": "string", "cents": "long"}, SLOT)
BATCHES, CRASH_IN = 6, 4
OTHER = 104729  # the factor of the order after a restart


def sized(spark: SparkSession, sf_dir: str, parts: int, path: str, factor: int | None = None, shrink: int = 4) -> DataFrame:
    """The stream in some order as parts batches of equal size (of shrink quarters of it), written by batch."""
    events = change_stream(spark, sf_dir)
    events = events if factor is None else events.withColumn("arrival", delivery.scattered(F.col("seq"), factor=factor))
    size = max(1, -(-events.count() // parts) * shrink // 4)
    return shared.kept(delivery.batches(dense(events), size), path, "batch")


def graded(arm: str, store: SnapshotStore, run: list[recovery.Outcome], clean: SnapshotStore) -> DataFrame:
    """One row of what an arm left: ledger against data, rows of the batch it fell in, and whether it came to the
    rows of the clean arm."""
    state, fell = store.read(TARGET), run[-1].fell_at
    out = recovery.ledger_agreement(state, store.last_batch()).crossJoin(merge.counts(state))
    out = out.crossJoin(state.agg(F.count_if(F.col("cdc_batch") == CRASH_IN).alias("rows_of_crashed_batch")))
    for name, with_batch in (("same_as_clean", True), ("same_but_for_batches", False)):
        mine, theirs = merge.fingerprint(state, with_batch), merge.fingerprint(clean.read(TARGET), with_batch)
        out = out.crossJoin(mine.crossJoin(theirs.select(F.col("rows").alias("r"), F.col("hash").alias("h"))).select(((F.col("rows") == F.col("r")) & (F.col("hash") == F.col("h"))).alias(name)))
    return out.select(F.lit(arm).alias("arm"), F.lit(fell).cast("string").alias("fell_at"), F.lit(len([o for o in run if not o.fell_at])).cast("long").alias("committed"), *out.columns)


APPLIED = {
    "clean": [("one", 1, 99)],
    **{f"crash_{p}": [("one", 1, CRASH_IN - 1)] for p in ("staged", "merged", "tombstoned")},
    "resume_same": [("one", 1, CRASH_IN - 1), ("one", CRASH_IN, 99)],
    "resume_new": [("one", 1, CRASH_IN - 1), ("two", CRASH_IN, 99)],
    "resume_new_all": [("one", 1, CRASH_IN - 1), ("two", 1, 99)],
    "resume_resized": [("one", 1, CRASH_IN - 1), ("small", CRASH_IN, 99)],
}


def _arms_sql() -> str:
    ctes = [cs(), "z AS (SELECT CAST(ceil(count(*) / 6.0) AS BIGINT) AS n FROM ev)"]
    for name, factor, shrink in (("one", 7919, 4), ("two", OTHER, 4), ("small", OTHER, 3)):
        order = f"(seq % 1000003 * {factor}) % 1000003, seq"
        ctes.append(f"{name} AS (SELECT * EXCLUDE (arrival), row_number() OVER (ORDER BY {order}) AS arrival, (row_number() OVER (ORDER BY {order}) - 1) // ((SELECT n FROM z) * {shrink} // 4) + 1 AS batch FROM ev)")
    rows = []
    for arm, parts in APPLIED.items():
        a = f"a_{arm}"
        ctes.append(f"{a} AS (" + " UNION ALL ".join(f"SELECT *, {100 * i} + batch AS k FROM {order} WHERE batch BETWEEN {low} AND {high}" for i, (order, low, high) in enumerate(parts)) + ")")
        ctes.append(f"r_{arm} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, user_id, line_no ORDER BY lsn DESC, arrival DESC) AS n FROM {a} WHERE NOT tombstone) WHERE n = 1)")
        ctes.append(f"l_{arm} AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY user_id, line_no ORDER BY lsn DESC, k) AS n FROM r_{arm}) WHERE n = 1)")
        ctes.append(f"m_{arm} AS (SELECT k, any_value(batch) AS b, record_key, max(lsn) AS t FROM {a} WHERE tombstone GROUP BY k, record_key)")
        ctes.append(f"s_{arm} AS (SELECT user_id, line_no, event_type, cents, lsn, op = 'd' OR hit IS NOT NULL AS gone, coalesce(hit, batch) AS batch FROM (SELECT l.*, (SELECT arg_min(b, m.k) FROM m_{arm} m WHERE m.record_key = l.record_key AND m.k >= l.k AND m.t >= l.lsn AND l.op <> 'd') AS hit FROM l_{arm} l))")
        fell = f"'{arm.removeprefix('crash_')}'" if arm.startswith("crash_") else "CAST(NULL AS VARCHAR)"
        differ = lambda c, s=f"s_{arm}": f"NOT EXISTS (SELECT {c} FROM {s} EXCEPT SELECT {c} FROM s_clean) AND NOT EXISTS (SELECT {c} FROM s_clean EXCEPT SELECT {c} FROM {s})"
        rows.append(
            f"SELECT '{arm}' AS arm, {fell} AS fell_at, (SELECT count(DISTINCT k) FROM {a}{f' WHERE k >= 100' if len(parts) > 1 else ''}) AS committed, max(batch) AS data_batch, (SELECT max(batch) FROM {a}) AS ledger_batch, max(batch) <= (SELECT max(batch) FROM {a}) AS agrees, count(*) AS total, count(*) FILTER (NOT gone) AS live, count(*) FILTER (gone) AS soft_deleted,"
            f" count(*) FILTER (batch = {CRASH_IN}) AS rows_of_crashed_batch, {differ('*')} AS same_as_clean, {differ('user_id, line_no, event_type, cents, lsn, gone')} AS same_but_for_batches FROM s_{arm}"
        )
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(rows)


@query(_arms_sql())
def chaos_arms(spark, sf_dir):
    """A clean run; three that fall in a batch after its files have been written; four restarts from the last of these:
    with the same batches, in a new order, in a new order from the first batch on, and in batches of another size."""
    root = shared.folder(spark, "chaos")
    one, two, small = sized(spark, sf_dir, BATCHES, f"{root}/one"), sized(spark, sf_dir, BATCHES, f"{root}/two", OTHER), sized(spark, sf_dir, BATCHES, f"{root}/small", OTHER, 3)
    before = SnapshotStore(spark, f"{root}/before", [TARGET])

    def go(store: SnapshotStore, batches: DataFrame, start: int, crash: tuple[str, int] | None = None) -> list[recovery.Outcome]:
        last = batches.agg(F.max("batch")).first()[0] or 0  # one number
        return list(recovery.outcomes(store, lambda n: batches.where(F.col("batch") == n), range(start, last + 1), crash))

    go(before, one.where(F.col("batch") < CRASH_IN), 1)
    prefix = CRASH_IN - 1
    clean = before.fork(f"{root}/clean")
    arms = [("clean", clean, [recovery.Outcome(n, None, n) for n in range(1, prefix + 1)] + go(clean, one, CRASH_IN))]
    for point in ("staged", "merged", "tombstoned"):
        store = before.fork(f"{root}/{point}")
        arms.append((f"crash_{point}", store, [recovery.Outcome(n, None, n) for n in range(1, prefix + 1)] + go(store, one, CRASH_IN, (point, CRASH_IN))))
    crashed = arms[-1][1]
    for name, batches, strategy in (("resume_same", one, "ledger"), ("resume_new", two, "ledger"), ("resume_new_all", two, "replay_all"), ("resume_resized", small, "ledger")):
        store = crashed.fork(f"{root}/{name}")
        arms.append((name, store, go(store, batches, recovery.first_batch_to_apply(store.last_batch(), strategy))))
    return union_all([graded(name, store, run, clean) for name, store, run in arms])


@query(bt().replace("(arrival - 1) // 250 + 1", "(arrival - 1) // (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM rk) + 1") + merged_sql("lsn DESC, batch") + " SELECT coalesce(max(cdc_batch), 0) AS data_batch, (SELECT max(batch) FROM bt) AS ledger_batch, coalesce(max(cdc_batch), 0) <= (SELECT max(batch) FROM bt) AS agrees FROM st")
def ledger_agreement(spark, sf_dir):
    """Three batches committed to a store: its data against its ledger."""
    root = shared.folder(spark, "ledger")
    batches = sized(spark, sf_dir, 3, f"{root}/batches")
    store = SnapshotStore(spark, f"{root}/store", [TARGET])
    list(recovery.outcomes(store, lambda n: batches.where(F.col("batch") == n), [r[0] for r in batches.select("batch").distinct().orderBy("batch").collect()]))  # three numbers
    return recovery.ledger_agreement(store.read(TARGET), store.last_batch())


@query(bt().replace("(arrival - 1) // 250 + 1", "(arrival - 1) // (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM rk) + 1") + merged_sql("lsn DESC, batch") + " SELECT * FROM st")
def store_state(spark, sf_dir):
    """What a committed store holds after three batches, merged on read from its base and its deltas."""
    root = shared.folder(spark, "state")
    batches = sized(spark, sf_dir, 3, f"{root}/batches")
    store = SnapshotStore(spark, f"{root}/store", [TARGET])
    list(recovery.outcomes(store, lambda n: batches.where(F.col("batch") == n), (1, 2, 3)))
    return store.read(TARGET).select(*COLUMNS, "cdc_record_key", "cdc_lsn", "cdc_deleted", "cdc_batch")
