"""Sources of change-log lines and binary frames, and of tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.decode import changes, frame_kind
from tidemark.functions.keys import lsn_number

LINE_SCHEMA = "seq long, lsn string, data string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines (seq, lsn text, data) of a Parquet folder, with numeric positions: a peek, which can be repeated."""
    return spark.read.schema(LINE_SCHEMA).parquet(path).withColumn("lsn", lsn_number(F.col("lsn")))


def stream_lines(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """The same as a stream: its checkpoint is the slot, and a commit consumes."""
    return spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path).withColumn("lsn", lsn_number(F.col("lsn")))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return changes(read_lines(spark, path))


def table_as_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A source table as the set of its rows in text."""
    return rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).distinct()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Binary frames, a file each, as (path, frame): a peek, which can be repeated. An empty file is none."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("frame"))


def stream_frames(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """The same as a stream: its checkpoint is the slot, and a commit consumes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path).select("path", F.col("content").alias("frame"))


def frame_volume(frames: DataFrame) -> DataFrame:
    """One row over frames (frame binary): how many, and their bytes."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).cast("long").alias("bytes"))


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy(frame_kind(F.col("frame")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; one of more rows than most is an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is no Markdown table; see write_report()")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
