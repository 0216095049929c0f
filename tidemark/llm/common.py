"""What the operators share: reading tables, Arrow batches of bounded size, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


@functools.cache
def arrow_schema(ddl: str) -> pa.Schema:
    """Of "name type, name type"; workers have no session to parse it with."""
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def batch_of(columns: dict, ddl: str) -> pa.RecordBatch:
    """A batch of the schema, whatever types empty columns would get."""
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], names=schema.names)


def trimmed(run: Callable) -> Callable:
    """run, after which the worker gives memory back: workers live on, and their next task may be another kind."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # no such call but in glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return outer


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Applies make()(batch), a dict of columns by name, to each Arrow batch. make runs once a task."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield batch_of(work(batch), schema)

    return df.mapInArrow(trimmed(run), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset, in local
    mode only, one of our own."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing refers to any longer. A job that has just ended is
    still referred to for a moment."""
    gc.collect()
    for pause in (1.0, 0.0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


#: Folders of tables that nothing has deleted yet, and the names of those in the catalog.
_THERE: list[tuple[str, str | None]] = []


def noted(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Has a folder (of a table in the catalog, if it has a name there) deleted when tidied() ends, or with the JVM."""
    _THERE.append((path, table))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, goes when the JVM
    ends or the tidied() call that wrote it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    noted(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s result as a written table; the tables that were written for it are deleted."""
    before = len(_THERE)
    out = written(make(), name)
    done, _THERE[before:] = _THERE[before:-1], _THERE[-1:]
    spark = out.sparkSession
    for path, table in done:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out

