"""Tables with a ledger, committed together: a base, and deltas that are merged when the table is read.

A batch writes what it brings and nothing else: its reduced rows and its tombstones, as one more delta. A reader
takes of each slot the row of the highest position (the earliest delta on a tie) and flags it if a tombstone of
that delta or a later one covers it. When deltas hold a share of the base's rows, or there are MOST_DELTAS, they
are folded into a new base, so that rows are rewritten a bounded number of times on the average. Hard deletes and
the open mode depend on what was there before, and write a new base each time.

Everything of a batch is written, and its key found unique, before the manifest, a small JSON file under a
name that must not exist yet, is renamed into place. A crash before that leaves the version before. Folders are
deleted when no manifest that is kept names them. Files are reached through Hadoop's file systems only, so the
root can be any store Spark writes; the rename is atomic where that store's is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import topic_name
from tidemark.operators import merge
from tidemark.operators.recovery import Crash

KEPT = 2  # versions, the current one and what readers of the one before may still hold
#: Deltas are folded into the base when they have more than the base's rows divided by SHARE (and are LEAST_DELTAS),
#: or are MOST_DELTAS.
MOST_DELTAS, LEAST_DELTAS, SHARE = 32, 4, 2


class Target:
    """Name, topic, business columns and primary key of a target table."""

    def __init__(self, name: str, topic: str, columns: dict[str, str], key: list[str]):
        if not set(key) <= set(columns) or not key:
            raise ValueError("the key is made of the target's columns")
        self.name, self.topic, self.columns, self.key = name, topic, columns, key

    @property
    def schema(self) -> str:
        own = ", ".join(f"`{c}` {t}" for c, t in self.columns.items())
        return own + ", cdc_record_key string, cdc_lsn long, cdc_deleted boolean, cdc_batch long"


MARKS = "cdc_record_key string, t_lsn long, mark_batch long, cdc_seq long"


def build_targets(prefix: str, schema: str, tables: dict[str, tuple[dict[str, str], list[str]]]) -> list[Target]:
    """A target for each table of name: (columns with their types, primary key), fed by its topic."""
    return [Target(name, topic_name(prefix, schema, name), columns, key) for name, (columns, key) in tables.items()]


class DuplicateKeyError(ValueError):
    """A batch holds a merge key twice."""


def read_merged(rows: DataFrame, marks: DataFrame | None, target: Target) -> DataFrame:
    """The table that rows and marks of several deltas (cdc_seq, 0 for the base) come to. A record key has as many
    marks as there are deltas at most."""
    w = Window.partitionBy(*target.key).orderBy(F.desc("cdc_lsn"), F.asc("cdc_seq"))
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    names = [c for c in last.columns if c != "cdc_seq"]
    if marks is None:
        return last.select(*names)
    m = marks.select(F.col("cdc_record_key").alias("_k"), "t_lsn", F.col("mark_batch").alias("_b"), F.col("cdc_seq").alias("_s"))
    hit = (F.col("cdc_record_key") == F.col("_k")) & (F.col("_s") >= F.col("cdc_seq")) & (F.col("t_lsn") >= F.col("cdc_lsn")) & ~F.col("cdc_deleted")
    met = last.join(m, hit, "left").groupBy(*target.key).agg(*[F.any_value(c).alias(c) for c in names if c not in target.key], F.min_by("_b", "_s").alias("_b"))
    return met.withColumns({"cdc_deleted": F.col("cdc_deleted") | F.col("_b").isNotNull(), "cdc_batch": F.coalesce("_b", "cdc_batch")}).select(*names)


class SnapshotStore:
    """The targets' tables under root."""

    def __init__(self, spark: SparkSession, root: str, targets: list[Target]):
        self.spark, self.root, self.targets = spark, root.rstrip("/"), targets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # --- manifests ---

    def _versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifest"))
        names = [x.getPath().getName() for x in found]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, the current one by default."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "ledger": {}, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version or versions[-1]}.json"))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def _swing(self, now: dict, tables: dict, ledger: dict) -> int:
        """Makes tables and ledger the version after now."""
        version = now["version"] + 1
        body = json.dumps({"version": version, "ledger": now["ledger"] | ledger, "tables": tables, "parent": now["version"]}, sort_keys=True)
        temporary, final = self._path(f"{self.root}/manifest/.v{version}.tmp"), self._path(f"{self.root}/manifest/v{version}.json")
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            raise RuntimeError(f"version {version} has been committed by another writer")
        self._forget()
        return version

    @staticmethod
    def _named(manifest: dict) -> set[str]:
        """Folders that a manifest names."""
        tables = manifest["tables"].values()
        return {p for t in tables for p in [t["base"], *(d[k] for d in t["deltas"] for k in ("rows", "marks"))] if p}

    def _forget(self) -> None:
        """Deletes the manifests before the last KEPT, and what only they name under this root."""
        versions = self._versions()
        used = set().union(*[self._named(self.manifest(v)) for v in versions[-KEPT:]])
        for old in versions[:-KEPT]:
            for path in sorted(self._named(self.manifest(old)) - used):
                if path.startswith(f"{self.root}/"):
                    self._fs.delete(self._path(path), True)
            self._fs.delete(self._path(f"{self.root}/manifest/v{old}.json"), False)

    def fork(self, root: str) -> SnapshotStore:
        """Another store that begins with this one's current version, without a copy of its files. It may be
        read as long as this one keeps that version."""
        other = SnapshotStore(self.spark, root, self.targets)
        now = self.manifest()
        if now["version"]:
            other._swing(now | {"version": now["version"] - 1}, now["tables"], {})  # versions go on, as deltas are ordered by them
        return other

    # --- reading ---

    def read(self, target: Target) -> DataFrame:
        """The target's rows as they stand."""
        table = self.manifest()["tables"].get(target.name, {"base": None, "deltas": []})
        base = self.spark.read.schema(target.schema).parquet(table["base"]) if table["base"] else None
        if not table["deltas"]:
            return base if base is not None else self.spark.createDataFrame([], target.schema)
        rows = self.spark.read.schema(target.schema + ", cdc_seq long").parquet(*[d["rows"] for d in table["deltas"]])
        if base is not None:
            rows = base.withColumn("cdc_seq", F.lit(0).cast("long")).unionByName(rows)
        marked = [d["marks"] for d in table["deltas"] if d["marks"]]
        return read_merged(rows, self.spark.read.schema(MARKS).parquet(*marked) if marked else None, target)

    def last_batch(self, consumer: str = "cdc") -> int:
        """The ledger's batch of a consumer, 0 if it has none. It never moves backwards."""
        return self.manifest()["ledger"].get(consumer, {}).get("batch", 0)

    def ledger(self) -> DataFrame:
        """(consumer, batch, records_in_batch, unknown_topic) of the last commit of each consumer."""
        rows = [(c, e["batch"], e.get("records_in_batch"), e.get("unknown_topic")) for c, e in sorted(self.manifest()["ledger"].items())]
        return self.spark.createDataFrame(rows, "consumer string, batch long, records_in_batch long, unknown_topic long")

    # --- writing ---

    def _put(self, frame: DataFrame, path: str, **counts: Column) -> dict:
        """Writes a frame, and counts in the same pass."""
        seen = Observation()
        frame.observe(seen, *[c.alias(n) for n, c in ({"rows": F.count(F.lit(1))} | counts).items()]).write.mode("overwrite").parquet(path)
        return seen.get

    def _assert_unique(self, path: str, schema: str, target: Target) -> None:
        """Before a commit: no slot is there twice in what has been written."""
        twice = self.spark.read.schema(schema).parquet(path).groupBy(*target.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise DuplicateKeyError("a merge key is staged twice")

    def apply_batch(self, events: DataFrame, batch: int, guard: bool = True, on_tombstone: str = "delete", reduce: bool = True, consumer: str = "cdc", fail_at: str | None = None, hard_delete: bool = False) -> None:
        """Reduces a batch for all targets and commits it with the ledger; events are read once.

        Events of topics that no target has are left out and counted: the ledger has the batch's records and
        how many of them were such. fail_at raises Crash when the stage it names has been written: the rows
        (staged), the rows once more without a slot twice (merged), the tombstones too (tombstoned); nothing
        is committed by then, and what has been written is overwritten or never named.
        """
        now = self.manifest()
        version = now["version"] + 1
        here = f"{self.root}/data/v{version}"
        unknown = ~F.coalesce(F.col("topic").isin([t.topic for t in self.targets]), F.lit(False))
        seen = self._put(events, f"{here}/batch", unknown=F.count_if(unknown))
        staged = self.spark.read.schema(events.schema).parquet(f"{here}/batch")
        number, tables, deltas = F.lit(version).cast("long"), dict(now["tables"]), {}
        for t in self.targets:
            own = staged.where(F.col("topic") == t.topic)
            rows = merge.reduce_batch(own, t.key) if reduce else own.where("not tombstone")
            kept = self._put(merge.to_target(rows, list(t.columns), batch).withColumn("cdc_seq", number), f"{here}/{t.name}/rows")
            deltas[t.name] = {"rows": f"{here}/{t.name}/rows", "marks": None, "batch": batch, "n": kept["rows"]}
        self._fall(fail_at, "staged", batch)
        for t in self.targets:
            self._assert_unique(deltas[t.name]["rows"], t.schema, t)
        self._fall(fail_at, "merged", batch)
        for t in self.targets:
            if on_tombstone == "delete":
                marks = merge.reduce_tombstones(staged.where(F.col("topic") == t.topic)).select(F.col("record_key").alias("cdc_record_key"), "t_lsn", F.lit(batch).cast("long").alias("mark_batch"), number.alias("cdc_seq"))
                if self._put(marks, f"{here}/{t.name}/marks")["rows"]:
                    deltas[t.name]["marks"] = f"{here}/{t.name}/marks"
        self._fall(fail_at, "tombstoned", batch)
        for t in self.targets:
            d = deltas[t.name]
            if hard_delete or not guard:
                tables[t.name] = self._rewritten(t, d, f"{here}/{t.name}/base", guard, hard_delete, batch)
            elif d["n"] or d["marks"]:
                old = tables.get(t.name, {"base": None, "n": 0, "deltas": []})
                tables[t.name] = old | {"deltas": [*old["deltas"], d]}
        self._swing(now, tables, {consumer: {"batch": max(batch, self.last_batch(consumer)), "records_in_batch": seen["rows"], "unknown_topic": seen["unknown"]}})
        named = self._named({"tables": tables})
        for path in [f"{here}/batch", *(f"{here}/{t.name}/{kind}" for t in self.targets for kind in ("rows", "marks"))]:
            if path not in named:
                self._fs.delete(self._path(path), True)
        for t in self.targets:
            table = tables.get(t.name, {"n": 0, "deltas": []})
            if len(table["deltas"]) >= MOST_DELTAS or len(table["deltas"]) >= LEAST_DELTAS and sum(d["n"] for d in table["deltas"]) * SHARE > table["n"]:
                self.compact(t)

    @staticmethod
    def _fall(fail_at: str | None, point: str, batch: int) -> None:
        if fail_at == point:
            raise Crash(point, batch)

    def _rewritten(self, t: Target, delta: dict, path: str, guard: bool, hard_delete: bool, batch: int) -> dict:
        """The table after a batch as a new base."""
        frame = merge.merge(self.read(t), self.spark.read.schema(t.schema).parquet(delta["rows"]), t.key, guard, reduced=True)
        if delta["marks"]:
            frame = merge.apply_tombstones(frame, self.spark.read.schema(MARKS).parquet(delta["marks"]).withColumnRenamed("cdc_record_key", "record_key"), batch)
        n = self._put(merge.purge(frame) if hard_delete else frame, path)["rows"]
        return {"base": path, "n": n, "deltas": []}

    def compact(self, target: Target) -> None:
        """Folds the deltas of a target into a new base; no row and no batch number changes."""
        now = self.manifest()
        path = f"{self.root}/data/v{now['version'] + 1}/{target.name}/base"
        n = self._put(self.read(target), path)["rows"]
        self._assert_unique(path, target.schema, target)
        self._swing(now, now["tables"] | {target.name: {"base": path, "n": n, "deltas": []}}, {})
