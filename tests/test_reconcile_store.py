import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge, observed, reconcile, recovery
from tidemark.sources import connector, figures, logs, tables
from tidemark.sources.store import DuplicateKeyError, SnapshotStore, Target, build_targets

COLUMNS, KEY = ["o", "l", "qty", "status"], ["o", "l"]


def rows(spark, *values):
    return spark.createDataFrame(list(values), "o long, l long, qty long, status string")


@pytest.mark.parametrize(
    "source, target, flight, want",
    [
        ([(70, 3, 11, "held")], [(70, 3, 11, "open")], [], {"differing": 1, "missing_in_target": 0, "extra_in_target": 0, "verdict": "drift"}),
        ([(8, 2, 6, "x"), (8, 4, 6, "y"), (9, 1, 1, "z")], [(8, 2, 7, "x"), (5, 5, 5, "w"), (6, 6, 6, "w"), (9, 1, 1, "z")], [], {"differing": 1, "missing_in_target": 1, "extra_in_target": 2, "matching": 1}),
        ([(31, 0, 1, "a"), (31, 0, 4, "b")], [(31, 0, 4, "b"), (31, 0, 1, "a")], [], {"duplicate_in_source": 1, "duplicate_in_target": 1, "matching": 1, "verdict": "drift"}),
        ([(12, 9, 3, "new"), (13, 9, 3, "new"), (14, 9, 3, "new")], [(12, 9, 3, "old"), (13, 9, 3, "new"), (14, 9, 3, "new")], [(12, 9)], {"verdict": "clean_partial", "keys_checked": 2}),
        ([(4, 4, 40, "p")], [(4, 4, 41, "q")], [(4, 4)], {"verdict": "no_coverage", "keys_checked": 0}),
        ([], [], [], {"verdict": "no_coverage", "coverage": None}),
        ([(20, 1, 2, "a"), (21, 1, 2, "a"), (22, 1, 2, "a"), (23, 1, 2, "a")], [(20, 1, 2, "b"), (21, 1, 2, "a"), (22, 1, 2, "a"), (23, 1, 9, "a")], [(23, 1)], {"verdict": "drift", "coverage": 0.75}),
        ([(1, 1, None, None)], [(1, 1, None, None)], [], {"verdict": "clean", "matching": 1}),
    ],
)
def test_reconcile(spark, source, target, flight, want):
    got = reconcile.reconcile(rows(spark, *source), rows(spark, *target), COLUMNS, KEY, spark.createDataFrame(flight, "o long, l long")).first().asDict()
    assert {k: got[k] for k in want} == want


def test_one_key_in_flight_is_never_clean(spark):
    many = spark.range(30_000).select(F.col("id").alias("o"), F.lit(1).cast("long").alias("l"), F.lit(1).cast("long").alias("qty"), F.lit("x").alias("status"))
    row = reconcile.reconcile(many, many, COLUMNS, KEY, spark.createDataFrame([(5, 1)], "o long, l long")).first()
    assert (row.coverage, row.verdict) == (1.0, "clean_partial")


def test_markdown_drops_nothing(spark):
    report = spark.range(5).withColumn("n", F.lit(None).cast("int"))
    assert logs.markdown(report, 5).count("\n") == 6
    with pytest.raises(ValueError):
        logs.markdown(report, 4)


def test_columns_rollup_line(spark):
    moved = reconcile.columns_differing(rows(spark, (1, 1, 2, "a")), rows(spark, (1, 1, 2, "b")), COLUMNS, KEY).collect()
    assert [(r.column, r["keys"]) for r in moved] == [("status", 1)]
    reports = spark.createDataFrame([(16, 4, 0, 0, 0, 0, "clean_partial", 0.25), (8, 8, 0, 0, 0, 0, "clean", 1.0), (40, 20, 0, 0, 0, 0, "clean_partial", 0.5)], "keys_either_side long, keys_checked long, missing_in_target long, extra_in_target long, differing long, duplicate_in_target long, verdict string, coverage double")
    assert reconcile.one_line(reports).first().coverage == 0.5
    assert reconcile.rollup(reports).first()[0] == "clean_partial"
    assert reconcile.rollup(reports.limit(0)).first()[0] == "no_coverage"
    assert reconcile.coverage_between(reports).first()[0] is True
    with pytest.raises(Exception, match="unknown verdict"):
        reconcile.rollup(reports.withColumn("verdict", F.lit("odd"))).collect()


@pytest.mark.parametrize(
    "before, after, dropped, twice",
    [
        ([2, 2, 2, 2], [2, 2, 2, 2], 0, 0),
        ([2, 2, 2, 2], [3, 2, 3], 1, 0),
        ([3, 3, 3], [2, 2, 2, 2, 1], 0, 2),
    ],
)
def test_resume_gap(spark, before, after, dropped, twice):
    def batch_of(sizes):
        return [b for b, n in enumerate(sizes, 1) for _ in range(n)]

    ids = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(zip(batch_of(before), batch_of(after), strict=True))], "id long, before int, after int")
    row = recovery.resume_gap(ids, 3).first()
    assert (row.dropped, row.applied_twice) == (dropped, twice)


def test_resume_gap_by_order(spark):
    ids = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 2), (4, 2, 3), (5, 3, 2), (6, 3, 3)], "id long, before int, after int")
    row = recovery.resume_gap(ids, 3).first()
    assert (row.dropped, row.applied_twice, row.prefix_sizes_agree) == (1, 1, True)
    with pytest.raises(Exception, match="different records"):
        recovery.resume_gap(ids.withColumn("after", F.lit(None).cast("int")), 3).collect()
    with pytest.raises(ValueError):
        recovery.resume_gap(ids, 0)


def batch(spark, *rows):
    return spark.createDataFrame([(lsn, op, k, v, op == "t", i, i, topic, str(k)) for i, (lsn, op, k, v, topic) in enumerate(rows)], "lsn long, op string, k long, v string, tombstone boolean, seq long, arrival long, topic string, record_key string")


def make_store(spark, path):
    return SnapshotStore(spark, f"file://{path}", [Target("t", "x.t", {"k": "long", "v": "string"}, ["k"])])


def test_store_crash_and_replay(spark, tmp_path):
    store = make_store(spark, tmp_path / "s")
    frame = lambda i: batch(spark, (100 + i, "c", i, str(i), "x.t"), (100 + i, "t", i - 1, None, "x.t"), (100, "c", 9, "stray", "other"))
    rows = lambda: sorted(store.read(store.targets[0]).collect())
    start = lambda strategy="ledger": range(recovery.first_batch_to_apply(store.last_batch(), strategy), 5)
    for point, written in (("staged", {"batch", "t/rows"}), ("merged", {"batch", "t/rows"}), ("tombstoned", {"batch", "t/rows", "t/marks"})):
        *done, last = recovery.outcomes(store, frame, start(), (point, 3))
        assert last == (3, point, 2) and all(o.fell_at is None for o in done)
        here = tmp_path / "s" / "data" / "v3"
        assert all(list((here / w).glob("*.parquet")) for w in written), point  # it falls with its files on disk
        assert [r.k for r in rows()] == [1, 2] and store.last_batch() == 2
    run = list(recovery.outcomes(store, frame, start()))
    assert recovery.summary(run) == {"committed": 2, "last_tried": 4, "fell_at": None, "ledger": 4, "offset_after": 4, "offset_before": 4}
    before = rows()
    assert [(r.k, r.cdc_deleted, r.cdc_batch) for r in before] == [(1, True, 2), (2, True, 3), (3, True, 4), (4, False, 4)]
    assert recovery.ledger_agreement(store.read(store.targets[0]), store.last_batch()).first().agrees
    list(recovery.outcomes(store, frame, start("replay_all")))
    assert rows() == before and store.last_batch() == 4
    other = list(recovery.outcomes(store, frame, [1], consumer="second"))
    assert other == [(1, None, 1)] and store.last_batch("second") == 1 and store.last_batch() == 4


def test_outcomes_and_offsets(spark, tmp_path):
    class Falling:
        def apply_batch(self, frame, n, fail_at=None, consumer="cdc"):
            if fail_at:
                raise recovery.Crash(fail_at, n)
            if frame is None:
                raise KeyError(n)

        def last_batch(self, consumer):
            return 1

    run = list(recovery.outcomes(Falling(), lambda n: n, (1, 2, 3), ("staged", 2)))
    assert run == [(1, None, 1), (2, "staged", 1)]
    assert recovery.summary(run) == {"committed": 1, "last_tried": 2, "fell_at": "staged", "ledger": 1, "offset_after": 1, "offset_before": 2}
    assert recovery.summary([])["last_tried"] == 0
    for numbers in ([0], [-1, 2]):
        with pytest.raises(ValueError):
            list(recovery.outcomes(Falling(), lambda n: n, numbers))
    with pytest.raises(KeyError):  # other errors pass
        list(recovery.outcomes(Falling(), lambda n: None, [1]))
    for bad in ((1, "other"), (-1, "ledger")):
        with pytest.raises(ValueError):
            recovery.first_batch_to_apply(*bad)
    with pytest.raises(ValueError):
        Target("t", "x", {"a": "long"}, ["b"])


def files(folder):
    return {p: p.stat().st_size for p in folder.rglob("*.parquet")}


def test_store_writes_what_a_batch_brings(spark, tmp_path):
    store, target = make_store(spark, tmp_path / "b"), Target("t", "x.t", {"k": "long", "v": "string"}, ["k"])
    many = spark.range(100_000).selectExpr("id + 1 lsn", "'c' op", "id k", "sha2(cast(id as string), 256) v", "false tombstone", "id seq", "id arrival", "'x.t' topic", "cast(id as string) record_key")
    store.apply_batch(many, 1)
    store.compact(target)
    before = files(tmp_path / "b")
    assert store.manifest()["tables"]["t"]["deltas"] == [] and store.read(target).count() == 100_000
    store.apply_batch(many.where("k < 250").selectExpr("lsn + 1000000 lsn", "'u' op", "k", "'new' v", "tombstone", "seq", "arrival", "topic", "record_key"), 2)
    fresh = {p: n for p, n in files(tmp_path / "b").items() if p not in before}
    assert sum(fresh.values()) < sum(before.values()) / 100  # in proportion to 250 rows of 100,000
    got = store.read(target)
    assert got.count() == 100_000 and got.where("v = 'new' and cdc_batch = 2").count() == 250


def test_store_agrees_with_batches_one_by_one(spark, tmp_path):
    """Deltas merged on read, compacted or not, against merge() and tombstones batch by batch."""
    rng = random.Random(8)
    store, target = make_store(spark, tmp_path / "c"), Target("t", "x.t", {"k": "long", "v": "string"}, ["k"])
    state = spark.createDataFrame([], target.schema)
    for n in range(1, 8):
        rows = []
        for _ in range(25):
            k = rng.randrange(12)
            rows.append((rng.randrange(60), rng.choice("cudt"), k, str(n), "x.t"))
        e = batch(spark, *rows).withColumn("record_key", F.expr("cast(k div 3 as string)"))  # a record key covers three slots
        store.apply_batch(e, n)
        staged = merge.to_target(merge.reduce_batch(e, ["k"]), ["k", "v"], n)
        state = merge.apply_tombstones(merge.merge(state, staged, ["k"], reduced=True), merge.reduce_tombstones(e), n)
        state = spark.createDataFrame(state.collect(), target.schema)
        assert sorted(store.read(target).collect()) == sorted(state.collect()), n
        if n == 3:
            store.compact(target)
    fork = store.fork(f"file://{tmp_path}/d")
    fork.apply_batch(batch(spark, (99, "u", 1, "mine", "x.t")), 8)
    assert sorted(store.read(target).collect()) == sorted(state.collect()) and fork.read(target).where("k = 1").first().v == "mine"
    fork.apply_batch(batch(spark, (100, "d", 1, None, "x.t")), 9, hard_delete=True)
    assert fork.read(target).where("k = 1").count() == 0 and fork.manifest()["tables"]["t"]["deltas"] == []
    fork.apply_batch(batch(spark, (5, "u", 2, "older", "x.t")), 10, guard=False)
    assert fork.read(target).where("k = 2").first().v == "older"
    for n in range(11, 20):  # of what no kept version names nothing is left
        fork.apply_batch(batch(spark, (200 + n, "u", 7, str(n), "x.t"), (1, "c", 1, None, "other")), n)
    used = {p.removeprefix("file://") for v in fork._versions() for p in fork._named(fork.manifest(v))}
    left = {str(p.parent) for p in (tmp_path / "d" / "data").rglob("*.parquet")}
    assert left == used and len(fork._versions()) == 2 and fork.last_batch() == 19


def test_unreduced_batch_changes_nothing(spark, tmp_path):
    store = make_store(spark, tmp_path / "u")
    store.apply_batch(batch(spark, (1, "c", 1, "a", "x.t")), 1)
    with pytest.raises(DuplicateKeyError):
        store.apply_batch(batch(spark, (2, "u", 1, "b", "x.t"), (3, "u", 1, "c", "x.t")), 2, reduce=False)
    assert store.last_batch() == 1 and store.read(store.targets[0]).first().v == "a"


def test_streams(spark, tmp_path):
    from tidemark.streaming.apply import into_store, keyed_state

    src = str(tmp_path / "in")
    one = batch(spark, (10, "c", 1, "a", "x.t"), (30, "u", 1, "z", "x.t"), (20, "u", 1, "b", "x.t"), (12, "c", 2, "q", "x.t"))
    two = batch(spark, (15, "u", 1, "late", "x.t"), (40, "d", 2, None, "x.t")).withColumn("seq", F.col("seq") + 10)
    one.write.parquet(src)
    store = make_store(spark, tmp_path / "st")
    stream = lambda: spark.readStream.schema(one.schema).parquet(src)
    into_store(stream(), store, str(tmp_path / "cp")).awaitTermination()
    two.write.mode("append").parquet(src)
    into_store(stream(), store, str(tmp_path / "cp")).awaitTermination()
    got = {r.k: (r.v, r.cdc_lsn, r.cdc_deleted) for r in store.read(store.targets[0]).collect()}
    assert got[1] == ("z", 30, False) and got[2][1:] == (40, True)
    counted = observed.counted_stream(stream(), ["k"]).writeStream.format("memory").queryName("counted").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert observed.totals(counted) == {"records": 6, "tombstones": 0, "creates": 2, "updates": 3, "deletes": 1, "changes_with_no_merge_key": 0, "first_lsn": 10, "last_lsn": 40}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = {}

    def keep(frame, _):
        for r in frame.collect():
            seen[r.slot] = (r.lsn, r.deleted)

    keyed_state(stream(), ["k"], ["v"]).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {'["1"]': (30, False), '["2"]': (40, True)}


def test_figures(spark):
    text = "# A\n\n| arm | rows | bytes |\n|---|---|---|\n| x | 1,777 | `refused` |\n| y | 12 % | 5 |\n\n## B\n\n| arm | rows |\n|---|---|\n| x | 3 |\n"
    again = text.replace("1,777", "1,778") + "| y | 3 |\n| y | 3 |\n"
    docs = spark.createDataFrame([("one", text), ("two", "no table | here"), ("three", None), ("four", again), ("five", "")], "document string, text string")
    rows = [("a", "A", "x", "rows", "counted", 1777.0), ("b", "B", "x", "rows", "counted", 4.0), ("c", "A", "x", "bytes", "counted", 1.0), ("d", "A", "z", "rows", "counted", 1.0), ("e", "B", "y", "rows", "timing", 3.0)]
    want = spark.createDataFrame([(d, *r) for d in ("one", "four") for r in rows], "document string, name string, heading string, row string, column string, kind string, observed double")
    found = figures.cells(docs)
    assert {(r.document, r.name): r.verdict for r in figures.check(found, want).collect()} == {
        ("one", "a"): "EXACT", ("one", "b"): "BROKEN", ("one", "c"): "MISSING", ("one", "d"): "MISSING", ("one", "e"): "MISSING",
        ("four", "a"): "BROKEN", ("four", "b"): "BROKEN", ("four", "c"): "MISSING", ("four", "d"): "MISSING", ("four", "e"): "MISSING",  # there twice
    }
    assert {r.document: (r.cells, r.graded) for r in figures.coverage(docs, want).collect()} == {"one": (4, 2), "four": (6, 4), "two": (0, 0), "three": (0, 0), "five": (0, 0)}
    graded = {(r.document, r.verdict, r.figures) for r in figures.report(docs, want).collect()}
    assert {x for x in graded if x[0] != "four"} == {("one", "EXACT", 1), ("one", "BROKEN", 1), ("one", "MISSING", 3), ("two", None, 0), ("three", None, 0), ("five", None, 0)}
    assert found.where("document = 'one' and line = 4").orderBy("at").select("row", "column", "value").collect() == [("x", "arm", "x"), ("x", "rows", "1,777"), ("x", "bytes", "`refused`")]


DECLARED = """# what a release of the connector declares; name, type, default, importance
topic.prefix\tSTRING\tNO_DEFAULT\tHIGH
message.prefix.(.+).limit\tINT\tnull\tLOW
decoding.rule.[a-z]+\tSTRING\tnull\tLOW

skipped.operations\tLIST\t[t]\tLOW"""


def test_declared_and_unknown_settings(spark):
    lines = lambda text: spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    known = connector.declared(lines(DECLARED))
    assert {tuple(r) for r in known.collect()} == {("topic.prefix", False), ("message.prefix", True), ("decoding.rule", True), ("skipped.operations", False)}
    with pytest.raises(Exception, match="four cells"):
        connector.declared(lines("a\tb")).collect()
    keys = ["message.prefix.a.limit", "decoding.rule.b", "errors.log.enable", "producer.override.acks", "topic.creation.groups", "config.action.reload", "odd", "skipped.operation", "message.prefixes.a", "topic.prefix.more", "", None]
    settings = spark.createDataFrame([(c, k, "1") for c in ("x", "y") for k in keys[: None if c == "x" else 3]], "connector string, key string, value string").where("key is not null")
    got = connector.unknown(settings, known.unionByName(connector.worker_keys(spark)))
    assert {tuple(r) for r in got.collect()} == {("x", k) for k in ("odd", "skipped.operation", "message.prefixes.a", "topic.prefix.more", "")}
    assert {r.key: r.p for r in spark.createDataFrame([("a",), ("a.b.c",), ("",)], "key string").select("key", connector.prefixes(F.col("key")).alias("p")).collect()} == {"a": [], "a.b.c": ["a", "a.b"], "": []}


def test_setting_problems(spark):
    tables_of = spark.createDataFrame([("depot", "s", "bin"), ("depot", "s", "lot"), ("depot", "s", "bin")], "connector string, schema string, table string")
    good = connector.settings_for(tables_of, {"tasks.max": "2"})
    known = good.select(F.col("key").alias("name"), F.lit(False).alias("head")).distinct()
    found = lambda s: {(r.key, r.problem) for r in connector.problems(s, known).collect()}
    assert found(good) == set()
    got = {r.key: r.value for r in good.collect()}
    assert got["table.include.list"] == "s.bin,s.lot" and got["slot.name"] == "depot_slot" and got["tasks.max"] == "2"
    put = lambda k, v: good.where(F.col("key") != k).unionByName(spark.createDataFrame([("depot", k, v)], "connector string, key string, value string"))
    for key in ("plugin.name", "slot.name", "publication.autocreate.mode"):
        for changed, problem in ((good.where(F.col("key") != key), "missing"), (put(key, ""), "missing"), (put(key, None), "missing"), (put(key, dict((k, a) for k, _, a in connector.RULES)[key]), "default")):
            assert found(changed) == {(key, problem)}
    for key, value in (("connector.class", "x"), ("topic.prefix", "a.b"), ("table.include.list", "a.b.c"), ("table.include.list", "a.b,c"), ("table.include.list", "a.")):
        assert found(put(key, value)) == {(key, "wrong")}
    assert found(put("plugin.nmae", "y")) == {("plugin.nmae", "unknown")} and found(good.unionByName(good)) == {(k, "repeated") for k in got}
    body = json.loads(connector.requests(good).first().body)
    assert body == {"name": "depot", "config": got}


def test_tables_over_jdbc(spark):
    """Through the embedded database that comes with Spark: read whole, in ranges, and as a target's text."""
    options = {"url": "jdbc:derby:memory:tidemark;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id k", "concat('v', id % 7) v", "id * 2 more").write.format("jdbc").options(**options, dbtable="lot").save()
    whole = tables.read_table(spark, options, "lot")
    assert whole.count() == 100 and whole.where("k >= 90").select("v").count() == 10
    parts = tables.read_table(spark, options, "lot", tables.ranges("k", 20, 79, 4))
    assert parts.rdd.getNumPartitions() == 4 and parts.agg(F.sum("k")).first()[0] == 4950
    target = Target("lot", "x.lot", {"k": "long", "v": "string"}, ["k"])
    got = tables.read_target(whole.unionByName(whole), target)
    assert got.columns == ["k", "v"] and got.count() == 100 and got.where("k = '8'").first().v == "v1"
    with pytest.raises(ValueError):
        tables.read_target(whole, Target("lot", "x.lot", {'k"; drop': "long"}, ['k"; drop']))


def test_jdbc_options():
    want = {"url": "jdbc:postgresql://db.example:6543/shop?sslmode=require", "driver": "org.postgresql.Driver", "fetchsize": "10000", "user": "u@x", "password": "p:w"}
    assert tables.jdbc_options("postgresql://u%40x:p%3Aw@db.example:6543/shop?sslmode=require") == want
    assert tables.jdbc_options("host=h dbname=d user=u", 5) == {"url": "jdbc:postgresql://h:5432/d", "driver": "org.postgresql.Driver", "fetchsize": "5", "user": "u"}
    for bad in ("mysql://h/d", "postgresql://h/", "host=h"):
        with pytest.raises(ValueError):
            tables.jdbc_options(bad)
    assert tables.ranges("id", 1, 1000, 8) == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "1001", "numPartitions": "8"}
    with pytest.raises(ValueError):
        tables.ranges("id", 5, 1, 8)


def test_catalog_and_slots(spark):
    indexes = spark.createDataFrame([("a", True, [3, 1]), ("a", False, [2]), ("b", True, [1])], "table string, is_primary boolean, columns array<int>")
    attributes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "k")], "table string, number int, name string")
    assert {r.table: r.key for r in tables.primary_keys(indexes, attributes).collect()} == {"a": ["z", "x"], "b": ["k"]}
    published = spark.createDataFrame([("p", "s", "lot"), ("p", "s", "bin"), ("q", "s", "bin")], "pubname string, schemaname string, tablename string")
    assert [r.tablename for r in tables.publication_tables(published, "p").collect()] == ["bin", "lot"]
    slots = spark.createDataFrame([("one", 100, 900), ("two", 40, 950)], "slot string, restart_lsn long, confirmed_lsn long")
    assert [tuple(r) for r in tables.slot_retention(slots, F.lit(1000)).collect()] == [("two", 960), ("one", 900)]
    assert tables.slot_positions(slots, F.lit(1000), "one").first().unconfirmed_bytes == 100
    with pytest.raises(KeyError):
        tables.slot_positions(slots, F.lit(1000), "three")
    assert tables.current_position(spark.createDataFrame([], "lsn long")).first().lsn is None


def test_frame_files(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    for i, raw in enumerate((b"B1", b"I\x00", b"C", b"")):
        (folder / f"{i:03}").write_bytes(raw)
    frames = logs.read_frames(spark, str(folder))
    assert {r.kind: r.n for r in logs.frame_counts(frames).collect()} == {"begin": 1, "insert": 1, "commit": 1}
    got = []
    run = lambda: logs.stream_frames(spark, str(folder)).writeStream.foreachBatch(lambda f, _: got.extend(bytes(r.frame) for r in f.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    (folder / "004").write_bytes(b"D9")
    run()  # what has been consumed doesn't come again
    assert sorted(got) == [b"B1", b"C", b"D9", b"I\x00"]


def test_targets_and_counted_topics(spark, tmp_path):
    targets = build_targets("x", "s", {"t": ({"k": "long", "v": "string"}, ["k"]), "u": ({"k": "long"}, ["k"])})
    assert [t.topic for t in targets] == ["x.s.t", "x.s.u"]
    store = SnapshotStore(spark, f"file://{tmp_path}/s", targets)
    store.apply_batch(batch(spark, (1, "c", 1, "a", "x.s.t"), (2, "c", 2, "b", "x.s.other"), (3, "c", 3, "c", None)), 1)
    assert [tuple(r) for r in store.ledger().collect()] == [("cdc", 1, 3, 2)]
    assert store.read(targets[0]).count() == 1 and store.read(targets[1]).count() == 0


def test_run_over_tables(spark):
    a, b = rows(spark, (1, 1, 1, "a")), rows(spark, (1, 1, 2, "a"))
    got = {r.table: r.verdict for r in reconcile.run({"same": (a, a, COLUMNS, KEY), "other": (a, b, COLUMNS, KEY)}).collect()}
    assert got == {"same": "clean", "other": "drift"}
    with pytest.raises(ValueError):
        reconcile.run({})


def test_observed_in_one_pass(spark, tmp_path):
    e = batch(spark, (1, "c", 1, "a", "x.t"), (2, "u", 1, "b", "x.t"), (2, "t", 1, None, "x.t"), (3, "d", None, "b", "x.t"))
    out, seen = observed.counted(e, ["k"])
    out.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"records": 4, "tombstones": 1, "creates": 1, "updates": 1, "deletes": 1, "changes_with_no_merge_key": 1, "first_lsn": 1, "last_lsn": 3}
