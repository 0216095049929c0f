"""Tables in Markdown documents as rows of cells, and published figures graded against them: all documents in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import figure_verdict

KEY = ["document", "heading", "row", "column"]


def number(text: Column) -> Column:
    """A cell's number without commas, percent signs, backticks and bold marks; null if it is none."""
    return F.regexp_replace(F.trim(text), r"[,%`*\s]", "").try_cast("double")


def cells(documents: DataFrame) -> DataFrame:
    """(document, line, at, heading, row, column, value) of every table cell of documents (document, text). at is its
    place from 0, row the first cell, heading the last one above the table. A document's lines are gone through in one task."""
    lines = documents.select("document", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    w = Window.partitionBy("document").orderBy("line")
    heading = F.last(F.when(F.col("raw").rlike("^#+ "), F.trim(F.regexp_replace("raw", "^#+ ", ""))), ignorenulls=True).over(w)
    lines = lines.withColumn("heading", heading).withColumn("is_row", F.trim("raw").startswith("|"))
    lines = lines.withColumn("table", F.sum(F.when(F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False)), 1).otherwise(0)).over(w)).where("is_row")
    parts = F.transform(F.split(F.regexp_replace(F.trim("raw"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    island = Window.partitionBy("document", "table").orderBy("line")
    lines = lines.withColumn("parts", parts).withColumn("head", F.first("parts").over(island)).withColumn("first", F.first("line").over(island))
    body = lines.where((F.col("line") > F.col("first")) & ~F.forall("parts", lambda c: c.rlike("^:?-+:?$")))
    body = body.select("document", "line", "heading", F.col("parts")[0].alias("row"), F.posexplode("parts").alias("at", "value"), "head")
    return body.select("document", "line", "at", "heading", "row", F.get("head", F.col("at")).alias("column"), "value")


def check(found: DataFrame, figures: DataFrame) -> DataFrame:
    """figures (document, name, heading, row, column, kind, observed) graded against cells: MISSING where the cell is
    not there once or holds no number."""
    once = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"), F.first("value").alias("value"))
    met = figures.join(once, KEY, "left").withColumn("published", F.when(F.col("times") == 1, number(F.col("value"))))
    return met.select("document", "name", "published", "observed", F.when(F.col("published").isNull(), "MISSING").otherwise(figure_verdict(F.col("published"), F.col("observed"), F.col("kind"))).alias("verdict"))


def report(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """Per document how many figures have each verdict; a document without any figure is one row without a verdict."""
    graded = check(cells(documents), figures).select("document", "verdict")
    return documents.select("document").distinct().join(graded, "document", "left").groupBy("document", "verdict").agg(F.count("verdict").alias("figures"))


def coverage(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """Per document its numeric cells, and those that a figure grades."""
    numeric = cells(documents).where(number(F.col("value")).isNotNull() & (F.col("at") > 0))
    graded = figures.select(*KEY).distinct().withColumn("_g", F.lit(1))
    met = numeric.join(graded, KEY, "left").groupBy("document").agg(F.count(F.lit(1)).alias("cells"), F.count("_g").alias("graded"))
    return documents.select("document").distinct().join(met, "document", "left").select("document", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("graded", F.lit(0)).alias("graded"))
