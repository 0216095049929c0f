"""Transactions of a log, publications and retention against plain versions."""

import random

import pytest

from tidemark.functions import stats
from tidemark.operators import layout
from tidemark.sources import identity


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, data string").repartition(3)


def test_transactions_of_a_log(spark):
    log = lines(spark, [
        "table s.a: INSERT: id[integer]:1",  # no BEGIN before it
        "BEGIN 7", "table s.a: INSERT: id[integer]:1 t[text]:'COMMIT 7'", "table s.b: DELETE: (no-tuple-data)", "COMMIT 7",
        "table s.a: UPDATE: id[integer]:9",  # between transactions
        "BEGIN 8", "COMMIT 8", "BEGIN 9", "table s.a: TRUNCATE: (no-flags)", "message: transactional: 1", "COMMIT 9 (at 2020-01-01)",
        "BEGIN 10", "table s.b: INSERT: id[integer]:2",  # not committed yet
    ])
    got = sorted((r.tx, r.table, r.kind) for r in layout.transactions(log).collect() if r.table)
    assert got == [(1, "s.a", "insert"), (1, "s.b", "delete"), (8, "s.a", "truncate")]
    assert layout.transactions(log).where("kind = 'commit'").count() == 3
    published = spark.createDataFrame([("all", "s.a"), ("all", "s.b"), ("all", "s.b"), ("b", "s.b"), ("none", "s.c")], "publication string, table string")
    frames = {(r.publication, r.kind): r.n for r in layout.publication_frames(layout.transactions(log), published).collect()}
    marks = {(p, k): 3 for p in ("all", "b", "none") for k in ("begin", "commit")}
    assert frames == marks | {("all", "insert"): 1, ("all", "delete"): 1, ("all", "truncate"): 1, ("all", "relation"): 2, ("b", "delete"): 1, ("b", "relation"): 1}
    empty = {r.publication: (r.transactions, r.empty) for r in layout.empty_transactions(layout.transactions(log), published).collect()}
    assert empty == {"all": (3, 1), "b": (3, 2), "none": (3, 3)}
    nothing = layout.transactions(log.limit(0))
    assert nothing.count() == 0 and layout.publication_frames(nothing, published).count() == 0


def test_long_transactions_cross_stretches(spark):
    """A transaction of more lines than a stretch has, and many short ones."""
    log = spark.range(200_000).selectExpr("id seq", "case when id = 5 or id > 150000 and id % 10 = 0 then 'BEGIN' when id = 150000 or id > 150000 and id % 10 = 9 then 'COMMIT' else concat('table s.t', id % 3, ': INSERT: k[bigint]:1') end data")
    tx = layout.transactions(log)
    assert tx.where("tx = 5 and kind = 'insert'").count() == 150_000 - 6
    assert tx.where("kind = 'commit'").count() == 1 + 4999
    split = stats.split_cost(layout.publication_frames(tx, spark.createDataFrame([("single", f"s.t{k}") for k in range(3)] + [(f"p{k}", f"s.t{k}") for k in range(3)], "connector string, table string").withColumnRenamed("connector", "publication")).withColumnRenamed("publication", "connector")).first()
    assert split.rows_agree and split.single_framing == 10_000 + 3 and split.split_framing == 30_000 + 3


@pytest.mark.parametrize("seed", range(2))
def test_retention_against_loops(spark, seed):
    rng = random.Random(seed)
    log = [(n, rng.randrange(1, 90)) for n in sorted(rng.sample(range(1, 2**40), 200))]
    end = log[-1][0]
    reads = [(rng.choice("abc"), rng.choice(log)[0]) for _ in range(12)] + [("late", end)]
    marks = [rng.choice(log)[0] for _ in range(6)] + [reads[0][1]]
    moments = [end * i // 4 for i in range(1, 5)]
    stand = layout.positions(spark.createDataFrame(reads, "slot string, lsn long"), spark.createDataFrame([(m,) for m in marks], "lsn long"), moments)
    want, kept = {}, {}
    total = lambda low, high: sum(b for n, b in log if low < n <= high)
    for s in {s for s, _ in reads}:
        for i, m in enumerate(moments):
            confirmed = max((n for t, n in reads if t == s and n <= m), default=0)
            restart = max((n for n in marks if n <= confirmed), default=0)
            want[s, i] = (m, confirmed, restart)
            kept[s, i] = (total(-1, m), total(restart, m), total(confirmed, m))
    assert {(r.slot, r.moment): (r.at_lsn, r.confirmed_lsn, r.restart_lsn) for r in stand.collect()} == want
    got = layout.retention(spark.createDataFrame(log, "lsn long, bytes long").repartition(3), stand)
    assert {(r.slot, r.moment): (r.written, r.retained_bytes, r.unconfirmed_bytes) for r in got.collect()} == kept


def test_unrounded_spread(spark):
    df = spark.createDataFrame([("a", 10), ("a", 13), ("b", 0), ("b", 4), ("c", None)], "arm string, v long")
    got = {r.arm: r for r in stats.spread_unrounded(df, "v", "arm").collect()}
    assert got["a"].least == 10 and got["a"].most == 13 and got["a"].relative == 3 / 10 and got["b"].relative is None


def test_replica_identity(spark):
    rows = [(1, 1, "c", 5, "it's", None, 5, None, None), (2, 2, "u", 5, None, 7, 5, "it's", None), (3, 3, "d", 5, None, 7, 5, None, 7)]
    changes = spark.createDataFrame(rows, "seq long, lsn long, op string, k long, t string, n int, old_k long, old_t string, old_n int")
    text = lambda mode: [r.data for r in identity.log_lines(changes, "s.a", ["k"], ["k", "t", "n"], mode).orderBy("seq").collect()]
    first = "table s.a: INSERT: k[bigint]:5 t[text]:'it''s' n[integer]:null"
    assert text("default") == [first, "table s.a: UPDATE: k[bigint]:5 t[text]:null n[integer]:7", "table s.a: DELETE: k[bigint]:5"]
    assert text("FULL")[1:] == ["table s.a: UPDATE: old-key: k[bigint]:5 t[text]:'it''s' n[integer]:null new-tuple: k[bigint]:5 t[text]:null n[integer]:7", "table s.a: DELETE: k[bigint]:5 t[text]:null n[integer]:7"]
    assert text("nothing")[2] == "table s.a: DELETE: (no-tuple-data)"
    got = {r.arm: r for r in identity.arms(changes, "s.a", ["k"], ["k", "t", "n"]).collect()}
    assert (got["nothing"].outcome, got["nothing"].first_refused, got["nothing"].changes, got["nothing"].ratio) == ("refused", 2, None, None)
    assert got["default"].outcome == "measured" and got["default"].ratio == 1.0 and got["full"].updates_with_before == 1 and got["full"].log_bytes > got["default"].log_bytes
    free = {r.arm: r.outcome for r in identity.arms(changes, "s.a", ["k"], ["k", "t", "n"], published=False).collect()}
    assert set(free.values()) == {"measured"}  # nothing is refused of a table that isn't published
    with pytest.raises(ValueError):
        identity.log_lines(changes, "s.a", ["k"], ["k"], "some")
