import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import delivery, envelope, fold, merge, stretches
from tidemark.plans import queries

SCHEMA = "lsn long, op string, a long, b long, qty long, tombstone boolean, seq long, arrival long, topic string, record_key string"
SLOT = ["a", "b"]


def events(spark, *rows, wide=False):
    """(lsn, a/b, op, qty) in arrival order; op T is a tombstone."""
    out = []
    for i, (lsn, key, op, qty) in enumerate(rows):
        a, b = map(int, key.split("/"))
        t = op == "T"
        out.append((lsn, "d" if t else op, a, b, None if t else qty, t, i, i + 1, "topic", str(a) if wide else key))
    return spark.createDataFrame(out, SCHEMA)


def live(df):
    return sorted((r.a, r.b, r.qty) for r in df.collect())


def count(df):
    return df.first().asDict()


def test_stale_is_dropped(spark):
    e = events(spark, (20, "1/1", "u", 9), (10, "1/1", "c", 1))
    assert live(fold.fold(e, SLOT)) == [(1, 1, 9)]
    assert count(fold.counters(e, SLOT))["stale_dropped"] == 1
    assert live(fold.fold(e, SLOT, guard=False)) == [(1, 1, 1)]


def test_mark_outlives_the_row(spark):
    assert live(fold.fold(events(spark, (20, "1/1", "d", 0), (10, "1/1", "c", 1)), SLOT)) == []


def test_tie_is_applied(spark):
    e = events(spark, (10, "1/1", "c", 1), (10, "1/1", "u", 9))
    assert live(fold.fold(e, SLOT)) == [(1, 1, 9)]
    assert count(fold.counters(e, SLOT))["same_position"] == 1


def test_tombstones_by_key(spark):
    rows = [(10, "1/1", "c", 1), (20, "1/2", "c", 2), (30, "1/1", "d", 0), (30, "1/1", "T", 0)]
    assert live(fold.fold(events(spark, *rows), SLOT)) == [(1, 2, 2)]
    wide = events(spark, *rows, wide=True)
    assert live(fold.fold(wide, SLOT)) == []
    assert count(fold.counters(wide, SLOT))["rows_removed_by_tombstones"] == 1
    assert live(fold.fold(wide, SLOT, on_tombstone="ignore")) == [(1, 2, 2)]
    with pytest.raises(ValueError):
        fold.fold(wide, SLOT, on_tombstone="other")


def test_stale_and_bare_tombstones(spark):
    late = events(spark, (40, "1/1", "u", 9), (10, "1/2", "c", 1), (20, "1/2", "d", 0), (20, "1/2", "T", 0), wide=True)
    assert live(fold.fold(late, SLOT)) == [(1, 1, 9)]
    bare = [(10, "1/1", "c", 1), (40, "1/1", "u", 9), (20, "1/1", "T", 0)]
    assert live(fold.fold(events(spark, *bare), SLOT)) == [(1, 1, 9)]
    assert live(fold.fold(events(spark, *bare), SLOT, guard=False)) == []
    level = [(10, "1/1", "c", 1), (20, "1/1", "u", 9), (20, "1/1", "T", 0)]
    assert live(fold.fold(events(spark, *level), SLOT)) == []


def test_missing_merge_key_is_counted(spark):
    e = events(spark, (10, "1/1", "d", 0)).withColumn("b", F.lit(None).cast("long"))
    assert count(fold.counters(e, SLOT))["changes_with_no_merge_key"] == 1
    assert live(fold.fold(e, SLOT)) == []


def sequential(rows, guard, on_tombstone):
    """The fold as a loop over arrivals."""
    held, mark, under, c = {}, {}, {}, {"stale_dropped": 0, "same_position": 0, "deletes_of_a_row_not_held": 0, "updates_of_a_row_not_held": 0, "rows_removed_by_tombstones": 0}
    for lsn, slot, op, qty, record in rows:
        if op == "T":
            if on_tombstone == "delete":
                for s in list(under.get(record, ())):
                    if s in held and not (guard and mark[s] > lsn):
                        del held[s]
                        c["rows_removed_by_tombstones"] += 1
            continue
        if slot in mark and lsn == mark[slot]:
            c["same_position"] += 1
        if guard and slot in mark and lsn < mark[slot]:
            c["stale_dropped"] += 1
            continue
        mark[slot] = lsn
        under.setdefault(record, set()).add(slot)
        if op == "d":
            c["deletes_of_a_row_not_held"] += held.pop(slot, None) is None
        else:
            c["updates_of_a_row_not_held"] += op == "u" and slot not in held
            held[slot] = qty
    return held, c


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("ties", [False, True])
def test_fold_equals_a_loop(spark, wide, ties):
    for seed in range(3):
        rng = random.Random(seed)
        rows, n = [], 120
        for i in range(n):
            a, b, op = rng.randint(1, 4), rng.randint(1, 3), rng.choice("cuud")
            lsn = (i // 2 if ties else i) + 1
            rows.append((lsn, f"{a}/{b}", op, i))
            if op == "d":
                rows.append((lsn, f"{a}/{b}", "T", 0))
        rng.shuffle(rows)
        e = events(spark, *rows, wide=wide).cache()
        for on_tombstone in ("delete", "ignore"):
            held, c = sequential([(x[0], x[1], x[2], x[3], x[1].split("/")[0] if wide else x[1]) for x in rows], True, on_tombstone)
            assert live(fold.fold(e, SLOT, on_tombstone=on_tombstone)) == sorted((*map(int, k.split("/")), q) for k, q in held.items())
            got = count(fold.counters(e, SLOT, on_tombstone=on_tombstone))
            assert {k: got[k] for k in c} == c
        held, _ = sequential([(x[0], x[1], x[2], x[3], x[1].split("/")[0] if wide else x[1]) for x in rows], False, "delete")
        assert live(fold.fold(e, SLOT, guard=False)) == sorted((*map(int, k.split("/")), q) for k, q in held.items())
        e.unpersist()


TARGET = "a long, b long, qty long, cdc_record_key string, cdc_lsn long, cdc_deleted boolean, cdc_batch long"


def loop_merge(spark, e, n, guard=True):
    target = spark.createDataFrame([], TARGET)
    for b in range(1, n + 1):
        own = e.where(F.col("batch") == b)
        target = merge.merge(target, merge.to_target(merge.reduce_batch(own, SLOT), [*SLOT, "qty"], b), SLOT, guard)
        target = merge.apply_tombstones(target, merge.reduce_tombstones(own), b)
        target = spark.createDataFrame(target.collect(), TARGET)
    return target


def test_reduce(spark):
    e = events(spark, (10, "1/1", "c", 1), (30, "1/1", "u", 3), (20, "1/1", "u", 2)).withColumn("batch", F.lit(1))
    assert [(r.qty, r.lsn) for r in merge.reduce_batch(e, SLOT).collect()] == [(3, 30)]
    row = merge.reduction_counters(e, SLOT).first()
    assert (row.superseded, row.staged_rows) == (2, 1)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("guard", [False, True])
def test_closed_form_equals_batch_loop(spark, wide, guard):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a, b, op = rng.randint(1, 3), rng.randint(1, 3), rng.choice("cuud")
        rows.append((i // 2 + 1, f"{a}/{b}", op, i))
        if op == "d":
            rows.append((i // 2 + 1, f"{a}/{b}", "T", 0))
    rng.shuffle(rows)
    e = delivery.batches(events(spark, *rows, wide=wide), 20).cache()
    n = -(-len(rows) // 20)
    looped = loop_merge(spark, e, n, guard)
    columns = [*SLOT, "qty", "cdc_lsn", "cdc_deleted"]
    closed = merge.merged_state(e, SLOT, [*SLOT, "qty"], guard=guard)
    assert sorted(map(tuple, closed.select(columns).collect())) == sorted(map(tuple, looped.select(columns).collect()))
    if guard:
        assert merge.fingerprint(closed).first() == merge.fingerprint(looped.select(closed.columns)).first()


def test_hard_delete_resurrects_and_versioned_keeps_all(spark):
    first = events(spark, (10, "1/1", "c", 1), (20, "1/1", "d", 0))
    target = merge.to_target(merge.reduce_batch(first, SLOT), [*SLOT, "qty"], 1)
    late = merge.to_target(merge.reduce_batch(events(spark, (15, "1/1", "c", 7)), SLOT), [*SLOT, "qty"], 2)
    assert live(merge.live_rows(merge.merge(target, late, SLOT), [*SLOT, "qty"])) == []
    assert live(merge.live_rows(merge.merge(merge.purge(target), late, SLOT), [*SLOT, "qty"])) == [(1, 1, 7)]
    three = events(spark, (10, "1/1", "c", 1), (20, "1/1", "u", 2), (30, "1/1", "u", 3))
    for size in (1, 3):
        assert merge.versioned_state(delivery.batches(three, size), SLOT, [*SLOT, "qty"]).count() == 3


def test_unreduced_stage_fails(spark):
    e = events(spark, (20, "1/1", "c", 1), (30, "1/1", "u", 2))
    with pytest.raises(Exception, match="staged twice"):
        merge.merge(spark.createDataFrame([], TARGET), merge.to_target(e, [*SLOT, "qty"], 1), SLOT).collect()


def test_envelope(spark):
    rows = [(10, "c", 7, 1), (20, "c", 7, 2), (30, "u", 3, 1), (40, "d", 7, 2)]
    c = spark.createDataFrame(rows, "lsn long, op string, a long, b long")
    e = envelope.envelope(c, F.lit("t"), F.to_json(F.struct("a", "b")), [], True)
    assert [r.lsn for r in e.orderBy("seq").collect()] == [10, 20, 30, 40, 40]
    assert envelope.envelope(c, F.lit("t"), F.lit("k"), [], False).count() == 4
    row = envelope.key_reuse(e.withColumn("record_key", F.col("a").cast("string")), ["a", "b"]).first()
    assert tuple(row) == (2, 1, 2)
    with pytest.raises(Exception, match="unknown op"):
        envelope.envelope(c.withColumn("op", F.lit("x")), F.lit("t"), F.lit("k"), []).collect()


def test_rekeyed(spark):
    c = spark.createDataFrame([(1, "u", 5, 6), (2, "u", 5, 5), (3, "c", None, 7)], "lsn long, op string, was long, now long")
    assert sorted((r.lsn, r.op) for r in envelope.rekeyed(c, F.col("was"), F.col("now")).collect()) == [(1, "c"), (1, "d"), (2, "u"), (3, "c")]


def test_delivery(spark):
    rng = random.Random(1)
    rows = [(i, f"{rng.randint(1, 9)}/1", "u", i) for i in range(200)]
    e = events(spark, *rows)
    order = list(range(200))
    rng.shuffle(order)
    mixed = e.join(spark.createDataFrame(list(enumerate(order)), "seq long, at long"), "seq").withColumn("arrival", F.col("at"))
    want = sum(order[i] > order[j] for i in range(200) for j in range(i + 1, 200))
    row = delivery.disorder(mixed).first()
    assert (row.records, row.inversions, row.cross_key) == (200, want, want - row.same_key)
    routed = delivery.route(e, 4)
    assert delivery.partition_spread(routed, 4).agg(F.sum("records"), F.count("partition")).first() == (200, 4)
    done = sorted(delivery.interleave(routed, 3).select("arrival_key", "partition", "offset").collect())
    for p in range(4):
        mine = [r.offset for r in done if r.partition == p]
        assert mine == sorted(mine)
    applied, back = delivery.prefix_cut(e, 0.25, 200)
    assert (applied.count(), back.count()) == (50, 150)
    with pytest.raises(ValueError):
        delivery.batches(e, 0)
    with pytest.raises(ValueError):
        delivery.route(e, 0)


def test_shuffled_order_has_no_ties(spark):
    """Beyond the prime too: ties of the scattered number go by seq, whatever the tasks."""
    prime = 1_000_003
    seqs = [k + prime * p for k in (0, 1, 2, 5000, 999_999) for p in (0, 1, 2, 7, 10**12)]
    want = sorted(seqs, key=lambda s: (s * 7919 % prime, s))
    for rows in (seqs, seqs[::-1]):
        df = spark.createDataFrame([(s,) for s in rows], "seq long").repartition(3).withColumn("arrival", delivery.scattered(F.col("seq")))
        assert [r.seq for r in df.orderBy("arrival").collect()] == want and df.select("arrival").distinct().count() == len(seqs)
        assert [(r.arrival, r.seq) for r in queries.dense(df).orderBy("arrival").collect()] == list(enumerate(want, 1))


@pytest.mark.parametrize("turned", [False, True])
def test_open_fold_takes_the_later_of_a_period(spark, turned):
    rows = [(10 + i, "u", 1, 1, i, False, 4 + 1_000_003 * i, None, "t", "k") for i in range(3)]
    e = spark.createDataFrame(rows[::-1] if turned else rows, SCHEMA).coalesce(1).withColumn("arrival", delivery.scattered(F.col("seq")))
    assert [r.qty for r in fold.fold(e, ["a", "b"], guard=False).collect()] == [2]


def test_hard_deletes_in_any_order(spark):
    """purged_state() against a loop that deletes flagged rows after each batch."""
    rng = random.Random(4)
    out = []
    for i in range(400):
        key, op = rng.randrange(25), rng.choice("cuud")
        out.append((i, op, key, key % 3, i, False, 2 * i, rng.random(), "t", str(key)))
        if op == "d":
            out.append((i, op, key, key % 3, None, True, 2 * i + 1, rng.random(), "t", str(key)))
    out.sort(key=lambda r: r[7])
    events = [(*r[:7], n, *r[8:]) for n, r in enumerate(out, 1)]
    held = {}
    for at in range(0, len(events), 20):
        part = events[at : at + 20]
        best = {}
        for r in part:
            if not r[5] and r[0] >= best.get(r[9], (-1,))[0]:
                best[r[9]] = r
        for k, r in best.items():
            if k not in held or r[0] > held[k][0]:
                held[k] = (r[0], r[4], r[1], at // 20 + 1)
        marks = {}
        for r in part:
            if r[5]:
                marks[r[9]] = max(marks.get(r[9], -1), r[0])
        held = {k: v for k, v in held.items() if v[2] != "d" and marks.get(k, -1) < v[0]}
    e = delivery.batches(spark.createDataFrame(events, SCHEMA).repartition(3), 20)
    got = {r.cdc_record_key: (r.cdc_lsn, r.qty, r.cdc_batch) for r in merge.purged_state(e, ["a", "b"], ["a", "b", "qty"]).collect()}
    assert got == {k: (v[0], v[1], v[3]) for k, v in held.items()}
    live = {r.cdc_record_key for r in merge.purge(merge.merged_state(e, ["a", "b"], ["a", "b", "qty"])).collect()}
    assert set(got) - live  # some rows came back


def test_merge_of_shuffled_stages_is_the_same(spark):
    """The order in which rows were staged decides nothing, into an empty target too."""
    target = spark.createDataFrame([(1, "k1", 5, False, 1)], "a long, cdc_record_key string, cdc_lsn long, cdc_deleted boolean, cdc_batch long")
    rows = [(i, f"k{i}", 10 + i, False, 2) for i in range(6)]
    for there in (target, target.limit(0)):
        got = [sorted(map(tuple, merge.merge(there, spark.createDataFrame(r, there.schema).repartition(n), ["a"]).collect())) for r, n in ((rows, 1), (rows[::-1], 3))]
        assert got[0] == got[1] == sorted(rows)


@pytest.mark.parametrize("shifts", [(16, 32, 48), (2, 4, 6), (1,)])
def test_running_values(spark, shifts):
    """Places, sums, maxima and last values against a loop, over an order of any spread, with ties."""
    rng = random.Random(2)
    values = [rng.randrange(-(2**62), 2**62) for _ in range(60)] + rng.sample(range(-40, 40), 60) + [2**62] * 3
    rows = [(rng.choice(["p", "q", None]), v, i, rng.choice([None, rng.randrange(9)])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "p string, v long, i long, x long").repartition(4)
    want = {}
    for p in ("p", "q", None):
        past = []
        for _, v, i, x in sorted((r for r in rows if r[0] == p), key=lambda r: (r[1], r[2])):
            there = [y for y in past if y is not None]
            want[i] = (len(past), sum(there), max(there, default=None), there[-1] if there else None)
            past.append(x)
    got = stretches.running(df, ["p"], "v", {"n": ("sum", F.lit(1)), "s": ("sum", F.coalesce("x", F.lit(0))), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}, ["i"], shifts)
    ties = {i for _, v, i, _ in rows if v == 2**62}
    assert {r.i: (r.n, r.s, r.m, r.l if r.i not in ties else want[r.i][3]) for r in got.collect()} == want
    assert {r.i: r.n for r in stretches.numbered(df, ["p"], "v", "n", ["i"], shifts).collect()} == {i: x[0] for i, x in want.items()}
    assert stretches.numbered(df.limit(0), [], "v", "n").count() == 0


def test_stretches_are_bounded_under_skew(spark):
    """One outlying position doesn't put all others into one stretch."""
    df = spark.range(100_000).select(F.col("id").alias("v")).unionByName(spark.range(1).select(F.lit(2**61).cast("long").alias("v")))
    largest = df.groupBy(F.shiftright("v", stretches.SHIFTS[0])).count().agg(F.max("count")).first()[0]
    assert largest <= 1 << 16
    assert stretches.numbered(df, [], "v", "n").where("n <> least(v, 100000)").count() == 0


def test_inversions_against_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(300), a, f"k{rng.randrange(3)}" if rng.random() < 0.5 else "hot", "t") for a in rng.sample(range(10**6), 400)]
    df = spark.createDataFrame(rows, "lsn long, arrival long, record_key string, topic string").repartition(3)
    pairs = lambda rs: sum(x[1] < y[1] and x[0] > y[0] for x in rs for y in rs)
    by_key = {k: [r for r in rows if r[2] == k] for k in {r[2] for r in rows}}
    want = (400, pairs(rows), sum(map(pairs, by_key.values())))
    for low, digit in ((13, 3), (4, 2), (2, 3)):  # within tasks only, and with several passes
        monkeypatch.setattr(delivery, "LOW_BITS", low)
        monkeypatch.setattr(delivery, "DIGIT_BITS", digit)
        got = delivery.disorder(df).first()
        assert (got.records, got.inversions, got.same_key) == want, (low, digit)
    assert delivery.inversions(df.limit(0)).first().inversions == 0


def wide_events(seed, n=300):
    """Changes of 12 slots under 3 record keys and tombstones, shuffled."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, op = rng.randrange(12), rng.choice("cuud")
        out.append((i, op, a, 0, i, False, 2 * i, rng.random(), "t", f"K{a % 3}"))
        if op == "d":
            out.append((i, op, a, 0, None, True, 2 * i + 1, rng.random(), "t", f"K{a % 3}"))
    out.sort(key=lambda r: r[7])
    return [(*r[:7], k, *r[8:]) for k, r in enumerate(out, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_hard_deletes_on_a_wide_key(spark, seed):
    events, held = wide_events(seed), {}
    for at in range(0, len(events), 20):
        part, best, marks = events[at : at + 20], {}, {}
        for r in part:
            if r[5]:
                marks[r[9]] = max(marks.get(r[9], -1), r[0])
            elif r[0] >= best.get(r[2], (-1,))[0]:
                best[r[2]] = r
        for k, r in best.items():
            if k not in held or r[0] > held[k][0]:
                held[k] = (r[0], r[4], r[1], at // 20 + 1, r[9])
        held = {k: v for k, v in held.items() if v[2] != "d" and marks.get(v[4], -1) < v[0]}
    e = delivery.batches(spark.createDataFrame(events, SCHEMA).repartition(3), 20)
    got = {r.a: (r.cdc_lsn, r.qty, r.cdc_batch) for r in merge.purged_state(e, ["a", "b"], ["a", "b", "qty"]).collect()}
    assert got == {k: (v[0], v[1], v[3]) for k, v in held.items()}


@pytest.mark.parametrize("guard", [True, False])
def test_fold_on_a_wide_key(spark, guard):
    events, held = wide_events(7), {}
    for r in events:  # in order of arrival
        if not r[5]:
            if not guard or r[2] not in held or r[0] >= held[r[2]][0]:
                held[r[2]] = (r[0], r[1], r[9], r[4])
        else:
            for k, v in held.items():
                if v[2] == r[9] and (not guard or r[0] >= v[0]):
                    held[k] = (v[0], "d", v[2], v[3])
    got = {r.a: r.lsn for r in fold.fold(spark.createDataFrame(events, SCHEMA).repartition(3), ["a", "b"], guard=guard).collect()}
    assert got == {k: v[0] for k, v in held.items() if v[1] != "d"}


def test_rows_grow_with_slots_and_tombstones(spark):
    """A record key with 2,000 slots and 2,000 tombstones: no operator of the fold or the merge makes their product."""
    rows = spark.range(4000).selectExpr("id lsn", "if(id % 2 = 0, 'c', 'd') op", "id % 2000 a", "0 b", "id qty", "id % 2 = 1 tombstone", "id seq", "id arrival", "'t' topic", "'hot' record_key", "cast(id div 400 + 1 as long) batch")
    for out in (fold.fold(rows, ["a", "b"]), merge.merged_state(rows, ["a", "b"], ["a", "b", "qty"])):
        out.collect()
        most = []

        def walk(node):
            for name in ("numOutputRows",):
                if node.metrics().contains(name):
                    most.append(node.metrics().apply(name).value())
            if node.nodeName() == "AdaptiveSparkPlan":
                walk(node.executedPlan())
            if "QueryStage" in node.nodeName():
                walk(node.plan())
            kids = node.children()
            for i in range(kids.size()):
                walk(kids.apply(i))

        walk(out._jdf.queryExecution().executedPlan())
        assert max(most) < 50_000


def plain_counters(rows, guard):
    """rows (lsn, topic, record key, slot, op or T, arrival), by the definition, an event at a time."""
    rows, keys = sorted(rows, key=lambda r: r[5]), {}
    for _, topic, key, slot, op, _ in rows:
        if op != "T":
            keys.setdefault(slot, set()).add((topic, key))
    top, act = {}, {}
    c = dict.fromkeys(("stale_dropped", "deletes_of_a_row_not_held", "updates_of_a_row_not_held", "rows_removed_by_tombstones"), 0)
    for lsn, topic, key, slot, op, _ in rows:
        if op == "T":
            for s in (s for s, own in keys.items() if (topic, key) in own):
                if not guard or s in top and lsn >= top[s]:
                    c["rows_removed_by_tombstones"] += act.get(s) in ("c", "u")
                    act[s] = "t"
            continue
        if guard and lsn < top.get(slot, lsn):
            c["stale_dropped"] += 1
            continue
        held = act.get(slot, "d") in ("c", "u")
        c["deletes_of_a_row_not_held"] += op == "d" and not held
        c["updates_of_a_row_not_held"] += op == "u" and not held
        top[slot], act[slot] = max(lsn, top.get(slot, lsn)), op
    return c


@pytest.mark.parametrize("guard", [True, False])
@pytest.mark.parametrize("scale", [1, 2**51 + 12345])
def test_counters_where_slots_have_several_keys(spark, guard, scale):
    """Arrivals on either side of 0, dense and scattered; slots under two record keys and on two topics."""
    rng = random.Random(5)
    places = rng.sample(range(-800, 800), 700)
    rows = [(rng.randint(1, 300), rng.choice("xy"), str(rng.randint(1, 4)), (rng.randint(1, 5), rng.randint(1, 4)), rng.choice("cuudTT"), p * scale) for p in places]
    e = spark.createDataFrame([(n, t, k, *s, op if op != "T" else None, op == "T", at) for n, t, k, s, op, at in rows], "lsn long, topic string, record_key string, a long, b long, op string, tombstone boolean, arrival long")
    want = plain_counters(rows, guard)
    got = count(fold.counters(e, SLOT, guard))
    assert {k: got[k] for k in want} == want and want["rows_removed_by_tombstones"] > 20


def test_counters_of_a_hot_key(spark):
    """5,000 slots and 5,000 tombstones of one record key: 25 million pairs, which no step makes."""
    rng = random.Random(6)
    at = rng.sample(range(10**6), 15_000)
    rows = [(rng.randint(1, 10**6), "x", "hot", (1, i % 5000), "cu"[i // 5000], at[i]) for i in range(10_000)]
    rows += [(rng.randint(1, 10**6), "x", "hot", (0, 0), "T", at[i]) for i in range(10_000, 15_000)]
    e = spark.createDataFrame([(n, t, k, *s, op if op != "T" else None, op == "T", p) for n, t, k, s, op, p in rows], "lsn long, topic string, record_key string, a long, b long, op string, tombstone boolean, arrival long")
    marks, by_slot, removed = sorted((r[5], r[0]) for r in rows if r[4] == "T"), {}, 0
    for r in sorted((r for r in rows if r[4] != "T"), key=lambda r: r[5]):
        by_slot.setdefault(r[3], []).append(r)
    for own in by_slot.values():
        kept = [r for i, r in enumerate(own) if r[0] >= max((x[0] for x in own[:i]), default=0)]
        for r, then in zip(kept, [*kept[1:], None], strict=True):
            between = marks[bisect.bisect(marks, (r[5], 10**7)) : bisect.bisect(marks, (then[5], 0)) if then else None]
            removed += any(n >= r[0] for _, n in between)
    got = fold.counters(e, SLOT)
    assert got.collect()[0]["rows_removed_by_tombstones"] == removed > 1000
    most = rows_made(got)
    assert most < 500_000, most


def rows_made(df):
    """The most rows that a node of the plan that ran made."""
    seen, most = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            seen.append(node.plan())
        n = node.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
        seen += [node.children().apply(i) for i in range(node.children().size())]
    return most
