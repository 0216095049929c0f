import pytest
from pyspark.sql import functions as F

from tidemark.functions import decode, stats
from tidemark.functions.keys import checked_name, identity, image_key, key_columns_for, lsn_number, murmur2, partition_for, record_key, topic_name

# Vectors of the Java client.
VECTORS = [
    ('{"order_id":1,"line_no":1}', 2017569160, 4),
    ('{"order_id":1,"line_no":2}', 573077348, 2),
    ('{"order_id":1,"line_no":3}', 1280944159, 1),
    ('{"customer_id":1}', 151059933, 3),
    ('{"customer_id":40}', 179988587, 5),
    ('{"order_id":2,"line_no":1}', 3325209962, 0),
    ('{"order_id":4,"line_no":1}', 2834121711, 1),
    ('{"order_id":5,"line_no":1}', 3108692482, 2),
]


def plain_murmur2(data: bytes) -> int:
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = 0x9747B28C ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & mask
        h = (h * m & mask) ^ ((k ^ (k >> 24)) * m & mask)
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ (h >> 13)) * m & mask
    return h ^ (h >> 15)


def test_murmur2_vectors_and_tails(spark):
    texts = [v[0] for v in VECTORS] + ["", "a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "é€𝄞", "ÿ" * 9]
    got = spark.createDataFrame([(t,) for t in texts], "k string").select("k", murmur2(F.col("k")).alias("h"), partition_for(F.col("k"), 6).alias("p")).collect()
    for row in got:
        assert row.h == plain_murmur2(row.k.encode())
        assert row.p == (row.h & 0x7FFFFFFF) % 6
    assert [(r.h, r.p) for r in got[:8]] == [v[1:] for v in VECTORS]


def test_names_and_keys(spark):
    assert topic_name("cdc", "shop", "t") == "cdc.shop.t"
    for bad in ("", "a.b"):
        with pytest.raises(ValueError):
            topic_name(bad, "shop", "t")
    with pytest.raises(ValueError):
        partition_for(F.col("k"), 0)
    with pytest.raises(ValueError):
        record_key()
    with pytest.raises(ValueError):
        checked_name('a"b')
    assert key_columns_for("t", {"t": ["a", "b"]}, {"t": ["a"]}) == ["a"]
    with pytest.raises(KeyError):
        key_columns_for("u", {"t": ["a"]})
    row = spark.createDataFrame([(1, None, "é")], "a int, b string, c string").select(record_key("b", "a", "c")).first()[0]
    assert row == '{"b":null,"a":1,"c":"é"}'
    images = spark.createDataFrame([({"a": None, "b": "2"},), ({"a": "1"},), (None,)], "m map<string,string>")
    assert [r[0] for r in images.select(identity(F.col("m"), ["a", "b"])).collect()] == [[None, "2"], None, None]
    one = spark.createDataFrame([({"a": None, "b": "2"},)], "m map<string,string>")
    assert one.select(image_key(F.col("m"), ["b", "a"])).first()[0] == '{"b":"2","a":null}'
    with pytest.raises(Exception, match="lacks a key column"):
        images.select(image_key(F.col("m"), ["b"])).collect()


def test_lsn(spark):
    assert spark.sql("select 'A/FF' as t").select(lsn_number(F.col("t"))).first()[0] == 10 * 2**32 + 255


def parsed(spark, *lines):
    return decode.parse_lines(spark.createDataFrame([(x,) for x in lines], "data string")).collect()


def test_decode(spark):
    rows = parsed(
        spark,
        "table depot.bin: INSERT: bin_id[integer]:77 label[text]:'north wall' aisle[character varying]:null volume[numeric]:12.50",
        "table depot.lot: UPDATE: old-key: lot_id[uuid]:'9b-1' weight[real]:3.25 new-tuple: lot_id[uuid]:'9b-2' weight[real]:4",
        "table depot.lot: UPDATE: lot_id[uuid]:'9b-3' weight[real]:5 open[boolean]:false",
        "table depot.pick: DELETE: shift[date]:'1999-12-31' place[smallint]:40",
        "table depot.pick: DELETE: (no-tuple-data)",
        "  table depot.pick: DELETE: old-key: shift[date]:'2001-01-01' place[smallint]:41  ",
        "BEGIN 90210",
        "COMMIT 90210",
        "table depot.bin: INSERT; nothing that follows counts",
        None,
    )
    assert (rows[0].table, rows[0].op) == ("depot.bin", "c")
    assert (rows[0].before, rows[0].after) == (None, {"bin_id": "77", "label": "north wall", "aisle": None, "volume": "12.50"})
    assert (rows[1].before, rows[1].after) == ({"lot_id": "9b-1", "weight": "3.25"}, {"lot_id": "9b-2", "weight": "4"})
    assert rows[2].before is None and rows[2].after == {"lot_id": "9b-3", "weight": "5", "open": "false"}
    assert rows[3].before == {"shift": "1999-12-31", "place": "40"} and rows[3].after is None
    assert rows[4].before == {} and rows[4].op == "d" and rows[4].after is None
    assert rows[5].before == {"shift": "2001-01-01", "place": "41"} and rows[5].after is None
    assert all(r.action is None and r.table is None and r.before is None and r.after is None for r in rows[6:])


def test_decode_keeps_other_columns(spark):
    df = spark.createDataFrame([(5, "table a.b: INSERT: c[int]:1", "x")], "seq long, data string, op string")
    row = decode.parse_lines(df.withColumn("odd.name", F.lit(1))).first()
    assert (row.seq, row.op, row["odd.name"], row.after) == (5, "c", 1, {"c": "1"})


def test_decode_hard_values(spark):
    rows = parsed(
        spark,
        "table t.t: INSERT: a[text]:'ratio 3:2, see: below' b[text]:'like size[int]:9 but text' c[text]:'it''s ''quoted''' d[integer[]]:'{7,8}' e[character varying(10)[]]:'{}'",
        "table t.t: INSERT: a[text]:'old-key: then new-tuple: or (no-tuple-data)' b[integer]:6",
        "table t.t: UPDATE: old-key: a[text]:'before new-tuple: mark' new-tuple: a[text]:'after'",
        "table t.t: INSERT: a[text]:'" + "long ''x'' " * 40_000 + "'",
        "table t.t: INSERT: a[text]:'null' b[text]:''",
    )
    assert rows[0].after == {"a": "ratio 3:2, see: below", "b": "like size[int]:9 but text", "c": "it's 'quoted'", "d": "{7,8}", "e": "{}"}
    assert rows[1].after == {"a": "old-key: then new-tuple: or (no-tuple-data)", "b": "6"} and rows[1].before is None
    assert rows[2].before == {"a": "before new-tuple: mark"} and rows[2].after == {"a": "after"}
    assert rows[3].after == {"a": "long 'x' " * 40_000}
    assert rows[4].after == {"a": "null", "b": ""}
    with pytest.raises(Exception, match="unterminated"):
        parsed(spark, "table t.t: INSERT: a[text]:'opens and goes on")


def test_unparsed_counts_truncate(spark):
    lines = spark.createDataFrame([("BEGIN 1",), ("table t.t: TRUNCATE: (no-flags)",), ("COMMIT 1",), ("table t.t: INSERT: a[int]:1",)], "data string")
    assert decode.unparsed(lines).first()[0] == 1


def test_summary(spark):
    lines = ["table t.t: INSERT: a[int]:1 b[int]:2", "table t.t: UPDATE: a[int]:1 b[int]:3", "table t.t: UPDATE: old-key: a[int]:1 b[int]:2 new-tuple: a[int]:1 b[int]:3", "table t.t: DELETE: a[int]:1", "table t.t: DELETE: (no-tuple-data)"]
    row = stats.summarise(decode.changes(spark.createDataFrame([(x,) for x in lines], "data string"))).first()
    assert (row.changes, row.before_present, row.before_absent, row.updates_with_before) == (5, 2, 2, 1)


def test_frames(spark):
    frames = spark.createDataFrame([(b"D1",), (b"D2",), (b"T",), (b"R\x00",), (b"M",), (b"\x07z",), (b"\x07",), (b"",)], "frame binary")
    kinds = {r.kind: r.n for r in frames.groupBy(decode.frame_kind(F.col("frame")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {"delete": 2, "truncate": 1, "relation": 1, "message": 1, "unknown:07": 2, "empty": 1}
    single = {"begin": 6, "commit": 5, "relation": 3, "insert": 8, "update": 1, "delete": 4}
    split = [{"begin": 6, "commit": 5, "relation": 2, "insert": 5}, {"begin": 6, "commit": 5, "relation": 1, "insert": 3, "update": 1}, {"begin": 6, "commit": 5, "relation": 1, "delete": 4}]
    rows = [("single", k, n) for k, n in single.items()] + [(str(i), k, n) for i, s in enumerate(split) for k, n in s.items()]
    cost = stats.split_cost(spark.createDataFrame(rows, "connector string, kind string, n long")).first()
    assert (cost.single_framing, cost.split_framing, cost.single_rows, cost.split_rows, cost.rows_agree) == (14, 37, 13, 13, True)
    empty = spark.createDataFrame([], "kind string, n long")
    assert stats.frame_split(empty).first().share is None
    assert stats.frame_split(spark.createDataFrame([("commit", 8)], "kind string, n long")).first().share == 0.0


def test_spread_and_arms(spark):
    row = stats.spread(spark.createDataFrame([(0,), (4,)], "v long"), "v").first()
    assert (row.n, row["range"], row.relative) == (2, 4, None)
    arms = spark.createDataFrame([("default", 10), ("full", 13)], "arm string, v long")
    assert {r.arm: r.ratio for r in stats.compare_arms(arms, "v").collect()} == {"default": 1.0, "full": 1.3}
    with pytest.raises(Exception, match="is not there once"):
        stats.compare_arms(arms, "v", "other").collect()


def test_figure_verdicts(spark):
    rows = [(42, 42, "counted", "EXACT"), (42, 41, "counted", "BROKEN"), (5000, 5004, "volume", "WITHIN_BAND"), (5000, 5011, "volume", "BROKEN"), (8, 3, "timing", "MOVED"), (0, 2, "volume", "BROKEN")]
    df = spark.createDataFrame(rows, "p long, o long, k string, want string")
    for r in df.select("want", stats.figure_verdict(F.col("p"), F.col("o"), F.col("k")).alias("got")).collect():
        assert r.got == r.want
