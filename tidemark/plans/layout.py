"""Queries on the layout of a log, on retention, on connectors' settings and on published figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import fold, layout, observed, shared
from tidemark.plans.queries import SLOT, cs, query
from tidemark.plans.streams import base_changes, change_stream
from tidemark.sources import connector, figures, identity, tables

# --- transactions and publications ---


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes as log lines (seq, data): three to a transaction, on four tables by user. The last one may be open."""
    c = base_changes(spark, sf_dir)
    row = F.concat(F.lit("table shop.t"), (F.col("user_id") % 4).cast("string"), F.when(F.col("op") == "c", ": INSERT: ").when(F.col("op") == "u", ": UPDATE: ").otherwise(": DELETE: "), F.lit("user_id[bigint]:"), F.col("user_id").cast("string"))
    xid = F.expr("cast(lsn div 3 as string)")
    first = F.when(F.col("lsn") % 3 == 0, F.struct((F.col("lsn") * 10).alias("seq"), F.concat(F.lit("BEGIN "), xid).alias("data")))
    last = F.when(F.col("lsn") % 3 == 2, F.struct((F.col("lsn") * 10 + 9).alias("seq"), F.concat(F.lit("COMMIT "), xid).alias("data")))
    lines = F.explode(F.filter(F.array(first, F.struct((F.col("lsn") * 10 + 5).alias("seq"), row.alias("data")), last), lambda x: x.isNotNull()))
    return c.select(lines.alias("l")).select("l.seq", "l.data")


def publications(spark: SparkSession) -> DataFrame:
    every = [f"shop.t{k}" for k in range(4)]
    return spark.createDataFrame([("single", t) for t in every] + [(f"only_{t}", t) for t in every], "publication string, table string")


LAID = """WITH x AS (SELECT event_id, event_id // 3 AS tx, 'shop.t' || CAST(user_id % 4 AS VARCHAR) AS t, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind FROM events),
d AS (SELECT DISTINCT tx FROM x WHERE event_id % 3 = 2), y AS (SELECT x.* FROM x JOIN d USING (tx)),
p AS (SELECT 'single' AS publication, 'shop.t' || CAST(i AS VARCHAR) AS t FROM range(4) r(i) UNION ALL SELECT 'only_shop.t' || CAST(i AS VARCHAR), 'shop.t' || CAST(i AS VARCHAR) FROM range(4) r(i)),
f AS (SELECT publication, kind, CAST(count(*) AS BIGINT) AS n FROM p JOIN y USING (t) GROUP BY ALL
  UNION ALL SELECT publication, 'relation', count(DISTINCT t) FROM p JOIN y USING (t) GROUP BY ALL
  UNION ALL SELECT DISTINCT publication, k, (SELECT count(*) FROM d) FROM p, (VALUES ('begin'), ('commit')) v(k))"""


def laid(spark, sf_dir) -> DataFrame:
    return layout.publication_frames(layout.transactions(log_lines(spark, sf_dir)), publications(spark))


@query(LAID + " SELECT * FROM f")
def layout_frames(spark, sf_dir):
    """Frames of one publication of four tables, and of four of one."""
    return laid(spark, sf_dir)


@query(LAID + """, s AS (SELECT CAST(coalesce(sum(n) FILTER (publication = 'single' AND kind IN ('begin', 'commit', 'relation')), 0) AS BIGINT) AS single_framing, CAST(coalesce(sum(n) FILTER (publication <> 'single' AND kind IN ('begin', 'commit', 'relation')), 0) AS BIGINT) AS split_framing,
  CAST(coalesce(sum(n) FILTER (publication = 'single' AND kind IN ('insert', 'update', 'delete')), 0) AS BIGINT) AS single_rows, CAST(coalesce(sum(n) FILTER (publication <> 'single' AND kind IN ('insert', 'update', 'delete')), 0) AS BIGINT) AS split_rows FROM f)
SELECT *, round(split_framing::DOUBLE / single_framing, 4) AS framing_multiple, round((split_framing + split_rows)::DOUBLE / (single_framing + single_rows), 4) AS message_multiple, single_rows = split_rows AS rows_agree FROM s""")
def layout_cost(spark, sf_dir):
    return stats.split_cost(laid(spark, sf_dir).withColumnRenamed("publication", "connector"))


@query(LAID + " SELECT publication, (SELECT count(*) FROM d) AS transactions, (SELECT count(*) FROM d) - count(DISTINCT y.tx) AS empty FROM p LEFT JOIN y USING (t) GROUP BY 1")
def layout_empty(spark, sf_dir):
    """Transactions of which a publication sends nothing but their marks."""
    return layout.empty_transactions(layout.transactions(log_lines(spark, sf_dir)), publications(spark))


# --- retention ---

MOMENTS = 5
RETAINED = f"""WITH log AS (SELECT event_id AS lsn, CAST(octet_length(encode(props)) + length(event_type) AS BIGINT) AS bytes FROM events),
r AS (SELECT 'slot_' || CAST(user_id % 6 AS VARCHAR) AS slot, event_id AS lsn FROM events WHERE event_type = 'purchase' AND event_id % 11 >= user_id % 6),
k AS (SELECT event_id AS lsn FROM events WHERE event_type = 'signup' AND user_id % 17 = 1),
m AS (SELECT CAST(i AS INTEGER) AS moment, (SELECT max(event_id) FROM events) * (i + 1) // {MOMENTS} AS at_lsn FROM range({MOMENTS}) t(i)),
p AS (SELECT slot, moment, at_lsn, coalesce((SELECT max(lsn) FROM r WHERE r.slot = s.slot AND r.lsn <= m.at_lsn), 0) AS confirmed_lsn FROM (SELECT DISTINCT slot FROM r) s, m),
q AS (SELECT *, coalesce((SELECT max(lsn) FROM k WHERE k.lsn <= p.confirmed_lsn), 0) AS restart_lsn FROM p)"""


def standing(spark, sf_dir) -> DataFrame:
    """Six slots that read at some of their users' purchases, checkpoints at some signups, five moments."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("lsn", F.col("event_id"))
    reads = e.where("event_type = 'purchase' and event_id % 11 >= user_id % 6").select(F.concat(F.lit("slot_"), (F.col("user_id") % 6).cast("string")).alias("slot"), "lsn")
    end = tables.current_position(e).first()[0] or 0  # one number
    return layout.positions(reads, e.where("event_type = 'signup' and user_id % 17 = 1").select("lsn"), [end * (i + 1) // MOMENTS for i in range(MOMENTS)])


@query(RETAINED + " SELECT * FROM q")
def slot_moments(spark, sf_dir):
    return standing(spark, sf_dir)


@query(RETAINED + """ SELECT slot, moment, CAST((SELECT sum(bytes) FROM log WHERE lsn <= at_lsn) AS BIGINT) AS written,
CAST(coalesce((SELECT sum(bytes) FROM log WHERE lsn <= at_lsn AND lsn > restart_lsn), 0) AS BIGINT) AS retained_bytes, CAST(coalesce((SELECT sum(bytes) FROM log WHERE lsn <= at_lsn AND lsn > confirmed_lsn), 0) AS BIGINT) AS unconfirmed_bytes FROM q""")
def retention_moments(spark, sf_dir):
    """Bytes that each slot holds back at each moment."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.col("event_id").alias("lsn"), (F.octet_length("props") + F.length("event_type")).alias("bytes"))
    return layout.retention(log, standing(spark, sf_dir))


# --- settings ---

NAMED = "n AS (SELECT p_brand AS connector, lower(p_type) || '.' || replace(p_name, ' ', '.') || '.' || CAST(p_size AS VARCHAR) AS key, p_size FROM part)"


@query(f"WITH {NAMED}, e AS (SELECT DISTINCT key FROM n WHERE p_size % 3 = 0), h AS (SELECT DISTINCT regexp_extract(key, '^[^.]*[.][^.]*', 0) || '.' AS head FROM n WHERE p_size = 7) SELECT DISTINCT connector, key FROM n WHERE key NOT IN (SELECT key FROM e) AND NOT EXISTS (SELECT 1 FROM h WHERE starts_with(n.key, h.head))")
def unknown_settings(spark, sf_dir):
    """Brands as connectors, their parts as settings; some sizes are declared by name, some types by a pattern."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select(F.col("p_brand").alias("connector"), F.concat_ws(".", F.lower("p_type"), F.translate("p_name", " ", "."), F.col("p_size").cast("string")).alias("key"), F.lit("1").alias("value"), "p_size")
    exact = rows.where("p_size % 3 = 0").select(F.concat("key", F.lit("\tINT\t0\tLOW")).alias("value"))
    heads = rows.where("p_size = 7").select(F.concat(F.substring_index("key", ".", 2), F.lit(".(.+)\tINT\t0\tLOW")).alias("value"))
    return connector.unknown(rows, connector.declared(exact.unionByName(heads)))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k, 'n' || CAST(c_nationkey AS VARCHAR) AS connector FROM customer)
SELECT connector, 'slot.name' AS key, 'default' AS problem FROM c WHERE k % 5 = 0 UNION ALL SELECT connector, 'plugin.name', 'missing' FROM c WHERE k % 5 = 1 UNION ALL SELECT connector, 'topic.prefix', 'wrong' FROM c WHERE k % 5 = 2
UNION ALL SELECT connector, 'plugin.nmae', 'unknown' FROM c WHERE k % 5 = 3 UNION ALL SELECT connector, 'tasks.max', 'repeated' FROM c WHERE k % 7 = 0""")
def setting_problems(spark, sf_dir):
    """A connector a nation, over its customers' segments as tables; nations make five kinds of mistakes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("connector"), F.lit("shop").alias("schema"), F.lower("c_mktsegment").alias("table"))
    good = connector.settings_for(c, {"tasks.max": "1", "transforms.route.type": "router"})
    k = F.regexp_extract("connector", "[0-9]+", 0).cast("int") % 5
    value = F.when((k == 0) & (F.col("key") == "slot.name"), "debezium").when((k == 2) & (F.col("key") == "topic.prefix"), "a.b").otherwise(F.col("value"))
    key = F.when((k == 3) & (F.col("key") == "publication.name"), "plugin.nmae").otherwise(F.col("key"))
    bad = good.where(~((k == 1) & (F.col("key") == "plugin.name"))).select("connector", key.alias("key"), value.alias("value"))
    twice = good.where((F.regexp_extract("connector", "[0-9]+", 0).cast("int") % 7 == 0) & (F.col("key") == "tasks.max"))
    lines = spark.createDataFrame([(f"{name}\tSTRING\t-\tHIGH",) for name, _, _ in connector.RULES] + [("publication.name\tSTRING\t-\tHIGH",), ("# the end",)], "value string")
    return connector.problems(bad.unionByName(twice), connector.declared(lines).unionByName(connector.worker_keys(spark)))


# --- figures ---

SIZES = "z AS (SELECT p_brand AS document, p_size AS s, count(*) AS parts, CAST(sum(CAST(floor(p_retailprice) AS BIGINT)) AS BIGINT) AS price FROM part GROUP BY ALL), y AS (SELECT p_brand AS document, p_type AS t, count(*) AS parts FROM part GROUP BY ALL)"


def documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A Markdown document a brand, with a table by size and one by type; and what was counted by size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("document", F.col("p_brand"))
    sizes = p.groupBy("document", F.col("p_size").alias("s")).agg(F.count(F.lit(1)).alias("parts"), F.sum(F.floor("p_retailprice")).alias("price"))
    types = p.groupBy("document", F.col("p_type").alias("t")).agg(F.count(F.lit(1)).alias("parts"))
    by_size = sizes.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "parts", "price"))), lambda x: F.format_string("| %d | %,d | `%,d` |", x["s"], x["parts"], x["price"])), "\n").alias("a"))
    by_type = types.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "parts"))), lambda x: F.format_string("| %s | **%d** |", x["t"], x["parts"])), "\n").alias("b"))
    text = F.concat(F.lit("# "), F.col("document"), F.lit("\n\n## Sizes\n\n| size | parts | price |\n|---|---:|---|\n"), F.col("a"), F.lit("\n\nMore | text.\n\n## Types\n\n| type | parts |\n|---|---|\n"), F.col("b"), F.lit("\n"))
    return by_size.join(by_type, "document").select("document", text.alias("text")), sizes


@query(f"WITH {SIZES} SELECT document, 'Sizes' AS heading, CAST(s AS VARCHAR) AS row, 'size' AS \"column\", CAST(s AS VARCHAR) AS value FROM z UNION ALL SELECT document, 'Sizes', CAST(s AS VARCHAR), 'parts', format('{{:,}}', parts) FROM z UNION ALL SELECT document, 'Sizes', CAST(s AS VARCHAR), 'price', '`' || format('{{:,}}', price) || '`' FROM z UNION ALL SELECT document, 'Types', t, 'type', t FROM y UNION ALL SELECT document, 'Types', t, 'parts', '**' || CAST(parts AS VARCHAR) || '**' FROM y")
def figure_cells(spark, sf_dir):
    return figures.cells(documents(spark, sf_dir)[0]).select("document", "heading", "row", "column", "value")


def expected(sizes: DataFrame) -> DataFrame:
    """Figures of each size: counts, off by one for some; prices as volumes, off a little for some; one row that isn't there."""
    s = F.col("s").cast("string")
    head = ["document", s.alias("name"), F.lit("Sizes").alias("heading")]
    counts = sizes.select(*head, s.alias("row"), F.lit("parts").alias("column"), F.lit("counted").alias("kind"), (F.col("parts") + (F.col("s") % 5 == 0).cast("int")).cast("double").alias("observed"))
    prices = sizes.select(*head, s.alias("row"), F.lit("price").alias("column"), F.lit("volume").alias("kind"), (F.col("price") + (F.col("s") % 3 == 0).cast("int")).cast("double").alias("observed"))
    gone = sizes.where("s = 1").select(*head, F.lit("1000").alias("row"), F.lit("parts").alias("column"), F.lit("counted").alias("kind"), F.lit(1.0).alias("observed"))
    return counts.unionByName(prices).unionByName(gone)


GRADED = f"WITH {SIZES}, v AS (SELECT document, CASE WHEN s % 5 = 0 THEN 'BROKEN' ELSE 'EXACT' END AS verdict FROM z UNION ALL SELECT document, CASE WHEN s % 3 <> 0 THEN 'EXACT' WHEN 1000 <= price THEN 'WITHIN_BAND' ELSE 'BROKEN' END FROM z UNION ALL SELECT document, 'MISSING' FROM z WHERE s = 1)"


@query(GRADED + " SELECT document, verdict, count(*) AS figures FROM v GROUP BY ALL")
def figure_report(spark, sf_dir):
    docs, sizes = documents(spark, sf_dir)
    return figures.report(docs, expected(sizes))


@query(f"WITH {SIZES} SELECT document, (SELECT 2 * count(*) FROM z WHERE z.document = d.document) + (SELECT count(*) FROM y WHERE y.document = d.document) AS cells, (SELECT 2 * count(*) FROM z WHERE z.document = d.document) AS graded FROM (SELECT DISTINCT document FROM z) d")
def figure_coverage(spark, sf_dir):
    docs, sizes = documents(spark, sf_dir)
    return figures.coverage(docs, expected(sizes))


# --- counters of one pass ---


@query(f"WITH {cs()} SELECT count(*) AS records, count(*) FILTER (tombstone) AS tombstones, count(*) FILTER (NOT tombstone AND op = 'c') AS creates, count(*) FILTER (NOT tombstone AND op = 'u') AS updates, count(*) FILTER (NOT tombstone AND op = 'd') AS deletes, CAST(0 AS BIGINT) AS changes_with_no_merge_key, min(lsn) AS first_lsn, max(lsn) AS last_lsn, (SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, line_no ORDER BY lsn DESC) AS n FROM ev WHERE NOT tombstone) WHERE n = 1 AND op <> 'd') AS live FROM ev")
def observed_counts(spark, sf_dir):
    """Events are read once: what is written for the fold is counted as it goes by."""
    events, seen = observed.counted(change_stream(spark, sf_dir), SLOT)
    stored = shared.kept(events, shared.folder(spark, "observed"))
    live = fold.fold(stored, SLOT).agg(F.count(F.lit(1)).alias("live"))
    row = seen.get
    return live.select(*[F.lit(v).cast("long").alias(k) for k, v in row.items()], "live")


# --- replica identity ---

IMAGES = """i AS (SELECT lsn, op, user_id, line_no, event_type, cents, coalesce(lag(event_type) OVER w, event_type) AS old_type, coalesce(lag(cents) OVER w, cents) AS old_cents FROM c WINDOW w AS (PARTITION BY user_id, line_no ORDER BY lsn)),
t AS (SELECT op, lsn, 'user_id[bigint]:' || user_id || ' line_no[bigint]:' || line_no AS k, ' event_type[text]:''' || event_type || ''' cents[bigint]:' || cents AS n, ' event_type[text]:''' || old_type || ''' cents[bigint]:' || old_cents AS o FROM i),
l AS (SELECT op, lsn, 'table shop.event: ' || CASE op WHEN 'c' THEN 'INSERT: ' || k || n WHEN 'u' THEN 'UPDATE: ' || k || n ELSE 'DELETE: ' || k END AS d, 'table shop.event: ' || CASE op WHEN 'c' THEN 'INSERT: ' || k || n WHEN 'u' THEN 'UPDATE: old-key: ' || k || o || ' new-tuple: ' || k || n ELSE 'DELETE: ' || k || o END AS f FROM t),
a AS (SELECT CAST(sum(length(d)) AS BIGINT) AS db, CAST(sum(length(f)) AS BIGINT) AS fb, count(*) AS n, count(*) FILTER (op <> 'c') AS ud, count(*) FILTER (op = 'u') AS u, count(*) FILTER (op = 'd') AS dl, min(lsn) FILTER (op <> 'c') AS fr FROM l)"""


@query(f"WITH {cs()}, {IMAGES} SELECT 'default' AS arm, 'measured' AS outcome, CAST(NULL AS BIGINT) AS first_refused, db AS log_bytes, n AS changes, dl AS before_present, u AS before_absent, CAST(0 AS BIGINT) AS updates_with_before, 1.0::DOUBLE AS ratio FROM a UNION ALL SELECT 'full', 'measured', NULL, fb, n, ud, 0, u, round(fb::DOUBLE / db, 4) FROM a UNION ALL SELECT 'nothing', CASE WHEN fr IS NULL THEN 'measured' ELSE 'refused' END, fr, NULL, NULL, NULL, NULL, NULL, NULL FROM a")
def identity_arms(spark, sf_dir):
    """The change stream under each replica identity; without one, the source refuses the first update or delete."""
    w = Window.partitionBy(*SLOT).orderBy("lsn")
    c = base_changes(spark, sf_dir).withColumn("seq", F.col("lsn"))
    before = {f"old_{n}": F.coalesce(F.lag(n).over(w), F.col(n)) for n in ("event_type", "cents")} | {f"old_{n}": F.col(n) for n in SLOT}
    return identity.arms(c.withColumns(before), "shop.event", SLOT, [*SLOT, "event_type", "cents"])
