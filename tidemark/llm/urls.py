"""URL filter: fixed rules, and a tree of path templates per host.

Segments of a path are generalised first by their form (runs of digits become #). Then the tree is built
level by level over all rows: each child of a node is judged by itself, however many there are. Those
whose labelled purity doesn't differ from the node's are merged under one wildcard child; those that differ stay. The
test is a likelihood ratio, which holds for few labels too, against a bound that grows with the number of children, as
so many are compared; a value of a variable segment, with its label or two, thus goes to the wildcard by itself.
A template is rejected if its share of bad labels,
smoothed towards its host's and that towards the share of all, is high.

Everything is a DataFrame aggregation: counts by (host, template), so no host's rows meet in one task.

Defined results: a null url, or one without "://", has an empty host and path and is judged like any
other template; several labels of one document count by the worst; without labels everything is allowed
unless a rule says otherwise; repeated rows are judged alike; ties between rules of one length go to the
longer host; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, written

# Fixed values of the contract: the rules, in order of writing.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
Z = 2.0  # standard deviations at which one child alone would differ
SMOOTHING = 8.0
BAD_SHARE = 0.5
WILD = "*"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        at = text.index("/")
        of, start = text[:at], text[at:]
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All segments, digits and long hexadecimal runs generalised."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F]{12,}", "#"), "[0-9]+", "#"))


def _alike_tails(tails: DataFrame) -> DataFrame:
    """Finishes the templates of nodes in which no test can tell branches apart: a segment on which all
    paths of the node agree stays, any other is the wildcard. The same as going level by level."""
    rest = F.slice("tokens", F.size("template") + 1, F.size("tokens"))
    each = tails.select("host", "template", F.posexplode(rest).alias("at", "token"))
    each = each.groupBy("host", "template", "at").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    named = F.struct("at", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(WILD).alias("name"))
    names = each.groupBy("host", "template").agg(F.sort_array(F.collect_list(named)).alias("names"))
    more = F.slice(F.col("names.name"), 1, F.size("tokens") - F.size("template"))
    return tails.join(names, ["host", "template"]).select("host", "tokens", "n", "labelled", "bad", F.concat("template", more).alias("template"))


def template_tree(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (host, tokens): its template, and the template's labelled counts and smoothed share of bad.

    pages has host, tokens and doc_id (of what the page shows, or null); labels doc_id and bad (0 or 1).
    The loop goes as deep as a node's labels can still tell its branches apart, without a limit.
    """
    counted = pages.select("host", "tokens", F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("bad"))
    known = pages.where("doc_id is not null").join(labels, "doc_id").select("host", "tokens", F.lit(0).alias("n"), F.lit(1).alias("labelled"), "bad")
    sums = [F.sum(c).cast("long").alias(c) for c in ("n", "labelled", "bad")]
    columns = ["host", "tokens", "n", "labelled", "bad", "template"]
    tree = counted.unionByName(known).groupBy("host", "tokens").agg(*sums)
    tree = written(tree.withColumn("template", F.array().cast("array<string>")).withColumn("alike", F.lit(False)), "urls")
    done, tails, level = [], [], 0
    while True:
        done.append(tree.where((~F.col("alike")) & (F.size("tokens") == level)).select(columns))
        tails.append(tree.where("alike").select(columns))
        at, level = tree.where((~F.col("alike")) & (F.size("tokens") > level)), level + 1
        if at.isEmpty():
            break
        at = at.withColumn("token", F.element_at("tokens", level))
        child = at.groupBy("host", "template", "token").agg(*sums)
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        both = child.join(node, ["host", "template"])
        share = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1.0)
        good, n = F.col("labelled") - F.col("bad"), F.greatest(F.col("labelled"), F.lit(1))
        part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
        ratio = part(F.col("bad"), share) + part(good, 1 - share)
        # a wildcard needs no merging
        named = F.when((F.col("children") > 1) & (ratio < Z * Z / 2 + F.log(F.col("children").cast("double"))), F.lit(WILD)).otherwise(F.col("token"))
        # the ratio of any part of the node, here or deeper, is under the node's good or bad labels and a half, and under a half if it has only one sort
        good = F.col("all_labelled") - F.col("all_bad")
        alike = (F.least(good, F.col("all_bad")) == 0) | (F.greatest(good, F.col("all_bad")) + 0.5 <= Z * Z / 2 + math.log(2))
        step = both.select("host", "template", "token", F.when(~alike, named).alias("next"))
        met = at.join(step, ["host", "template", "token"])
        template = F.when(F.col("next").isNull(), F.col("template")).otherwise(F.concat("template", F.array("next")))
        tree = written(met.select(*columns[:-1], template.alias("template"), F.col("next").isNull().alias("alike")), "urls")
    tree = reduce(DataFrame.unionByName, [*done, _alike_tails(reduce(DataFrame.unionByName, tails))])
    tree = written(tree, "urls")
    total = tree.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()  # one row
    overall = ((total["b"] or 0) + 0.5) / ((total["n"] or 0) + 1.0) if total["n"] else 0.0
    host = tree.groupBy("host").agg(((F.sum("bad") + SMOOTHING * overall) / (F.sum("labelled") + SMOOTHING)).alias("host_share"))
    leaf = tree.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"))
    leaf = leaf.join(host, "host").withColumn("bad_share", (F.col("t_bad") + SMOOTHING * F.col("host_share")) / (F.col("t_labelled") + SMOOTHING))
    return tree.select("host", "tokens", "template").join(leaf.select("host", "template", "t_labelled", "bad_share"), ["host", "template"])


def judge(pages: DataFrame, labels: DataFrame, shows: Column | None = None, rules=RULES, bad_share: float = BAD_SHARE) -> DataFrame:
    """Per row of pages (page_id, url): host, path, rule, verdict, template and its share of bad labels.

    labels: doc_id, quality, toxic. shows gives the doc_id that a page shows; by default the last number
    of the url's path.
    """
    shows = F.regexp_extract(F.col("path"), r"([0-9]{1,18})[^0-9]*$", 1) if shows is None else shows
    own = pages.select("page_id", F.col("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    own = own.select("page_id", "host", "path", segments(F.col("path")).alias("tokens"), shows.try_cast("long").alias("doc_id"))
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    tree = template_tree(own, bad)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("bad_share") >= bad_share, "block").otherwise("allow")
    met = own.join(tree, ["host", "tokens"], "left")
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), F.concat_ws("/", F.lit(""), "template").alias("template"), "bad_share")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 9: every url of pages."""
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
