"""Settings of source connectors as rows (connector, key, value), checked for all connectors at once.

What a release of the connector declares is read as a table of names and of heads, the fixed part of a pattern. A
setting is known if its name is declared, or one of its dotted prefixes is a head; both are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public names of Kafka Connect's own settings, and heads of those that users name.
WORKER_KEYS = [
    "connector.class", "tasks.max", "name", "key.converter", "value.converter", "header.converter", "transforms", "predicates",
    "config.action.reload", "topic.creation.default.partitions", "topic.creation.default.replication.factor",
]
WORKER_HEADS = ["transforms", "predicates", "key.converter", "value.converter", "header.converter", "topic.creation", "errors", "producer.override"]
#: What a setting must be (is), must look like (like), or must be set to but not to this default (not).
RULES = [
    ("connector.class", "is", "io.debezium.connector.postgresql.PostgresConnector"),
    ("topic.prefix", "like", r"^[^.]+$"),
    ("table.include.list", "like", r"^[^.,]+\.[^.,]+(,[^.,]+\.[^.,]+)*$"),
    ("plugin.name", "not", "decoderbufs"),
    ("slot.name", "not", "debezium"),
    ("publication.autocreate.mode", "not", "all_tables"),
]
RULE = "key string, rule string, argument string"


def declared(lines: DataFrame) -> DataFrame:
    """(name, head): of lines (value) of a tab-separated list of name, type, default and importance, # for comments. A
    name with a bracket is a pattern, of which the part before it counts, as a head. Other lines are an error."""
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("cells"))
    name = F.when(F.size("cells") == 4, F.col("cells")[0]).otherwise(F.raise_error(F.concat(F.lit("four cells are wanted: "), F.array_join("cells", " | "))))
    pattern = F.col("name").rlike(r"[(\[]")
    return rows.select(name.alias("name")).select(F.when(pattern, F.regexp_extract("name", r"^([^(\[]*?)\.?[(\[]", 1)).otherwise(F.col("name")).alias("name"), pattern.alias("head"))


def worker_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, False) for k in WORKER_KEYS] + [(k, True) for k in WORKER_HEADS], "name string, head boolean")


def prefixes(key: Column) -> Column:
    """a, a.b of a.b.c."""
    parts = F.split(key, r"\.")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def unknown(settings: DataFrame, known: DataFrame) -> DataFrame:
    """(connector, key) of the settings that known (name, head) doesn't have."""
    names, heads = (known.where("head" if h else "not head").select(F.col("name").alias(c)).distinct() for h, c in ((False, "key"), (True, "prefix")))
    keys = settings.select("key").distinct().join(names, "key", "left_anti")
    led = keys.select("key", F.explode(prefixes(F.col("key"))).alias("prefix")).join(heads, "prefix", "left_semi").select("key").distinct()
    return settings.select("connector", "key").distinct().join(keys.join(led, "key", "left_anti"), "key").select("connector", "key")


def problems(settings: DataFrame, known: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(connector, key, problem): settings nobody knows (unknown), and rules that are broken: absent or empty (missing),
    the default that must not be (default), or something else than wanted (wrong). A setting given twice is repeated."""
    rules = rules if rules is not None else settings.sparkSession.createDataFrame(RULES, RULE)
    value = F.coalesce("value", F.lit(""))
    per = settings.groupBy("connector", "key").agg(F.max(value).alias("value"), F.count(F.lit(1)).alias("n"))
    due = settings.select("connector").distinct().join(F.broadcast(rules), F.lit(True))  # a row a rule
    met = due.join(per.drop("n"), ["connector", "key"], "left").withColumn("value", value)
    wrong = F.when(F.col("rule") == "is", F.col("value") != F.col("argument")).when(F.col("rule") == "like", ~F.call_function("rlike", F.col("value"), F.col("argument"))).otherwise(F.lit(False))
    problem = F.when(F.col("value") == "", "missing").when((F.col("rule") == "not") & (F.col("value") == F.col("argument")), "default").when(wrong, "wrong")
    broken = met.select("connector", "key", problem.alias("problem")).where("problem is not null")
    odd = unknown(settings, known).withColumn("problem", F.lit("unknown"))
    return broken.unionByName(odd).unionByName(per.where("n > 1").select("connector", "key", F.lit("repeated").alias("problem")))


def settings_for(tables: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Settings (connector, key, value) that read tables (connector, schema, table): a publication and a slot of the
    connector's own, and more, which take the place of these."""
    wanted = tables.groupBy("connector").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(".", "schema", "table"))), ",").alias("tables"))
    own = {
        "connector.class": F.lit(RULES[0][2]), "plugin.name": F.lit("pgoutput"), "publication.autocreate.mode": F.lit("filtered"),
        "topic.prefix": F.col("connector"), "table.include.list": F.col("tables"),
        "slot.name": F.concat("connector", F.lit("_slot")), "publication.name": F.concat("connector", F.lit("_tables")),
    }
    rows = {k: v for k, v in own.items() if k not in (more or {})} | {k: F.lit(v) for k, v in (more or {}).items()}
    return wanted.select("connector", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rows.items()])).alias("s")).select("connector", "s.key", "s.value")


def requests(settings: DataFrame) -> DataFrame:
    """(connector, body): the JSON text that creates each connector."""
    config = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return settings.groupBy("connector").agg(config.alias("config")).select("connector", F.to_json(F.struct(F.col("connector").alias("name"), "config")).alias("body"))
