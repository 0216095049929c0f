"""Exchange of many small numbers as few binary rows: tasks deal packed arrays to buckets, and the
reading side works on one bucket at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import batch_of, trimmed

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def encode(x: np.ndarray) -> bytes:
    """Sorted unsigned numbers: their differences by bytes of one place, which compresses well."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def decode(raw: bytes) -> np.ndarray:
    width = raw[0]
    n = (len(raw) - 1) // width
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, n).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


#: What keyed() makes: for each bucket its keys in order, the owner of each (a place in owners), and the owners.
KEYED = "bucket int, keys binary, at binary, owners binary"
HELD_ROWS = 500_000
MERGED_ROWS = 20_000
KEY_SHIFT = np.uint64(16)  # keys are compared by their upper 48 bits


def keyed(keys: np.ndarray, of: np.ndarray, owners: np.ndarray, buckets: int) -> dict:
    """Rows of KEYED for keys and the places of their owners, at most 65536 owners."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
    _, used, edge = dealt(keys, buckets)
    rows = {"bucket": used.astype(np.int32), "keys": [], "at": [], "owners": []}
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        named, at = np.unique(of[x:y], return_inverse=True)
        rows["keys"].append(encode(keys[x:y] >> KEY_SHIFT))
        rows["at"].append(at.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())
        rows["owners"].append(owners[named].astype("<i8").tobytes())
    return rows


def unkeyed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (upper bits) and owners of a bucket's rows, in order of both."""
    keys, who = [], []
    for r in rows:
        keys.append(decode(r["keys"]))
        at = np.ascontiguousarray(np.frombuffer(r["at"], np.uint8).reshape(2, -1).T).view("<u2").ravel()
        who.append(np.frombuffer(r["owners"], "<i8")[at])
    keys, who = np.concatenate(keys), np.concatenate(who)
    order = np.lexsort((who, keys))
    return keys[order], who[order]


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the keys by bucket (the high bits), the buckets that get any, and where each of them
    begins in the order (and the end)."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of = of[order]
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return order, of[begin], np.append(begin, len(of))


def by_bucket(df: DataFrame, work: Callable[[int, list[dict]], Iterator[dict]], out: str, key: str = "bucket", fold: Callable[[list[dict]], dict] | None = None, merge: Callable[[list[dict]], dict] | None = None, once: tuple[str, ...] = ()) -> DataFrame:
    """Calls work(bucket, rows) for each bucket of df, whose rows come together in one task, and yields
    the columns it returns. df: the bucket's number in the column key, and binary columns. fold makes one
    of several such columns; given it, a task yields once, for all its buckets. merge makes one row of many;
    given it, a task never holds more than MERGED_ROWS of a bucket. Rows alike in key and once count once."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartition(n, key).sortWithinPartitions(key, *once)

    def found(batches) -> Iterator[dict]:
        now, rows, before = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row[key] != now:
                    if rows:
                        yield from work(now, rows)
                    now, rows, before = row[key], [], None
                if once:
                    if before == (this := tuple(row[c] for c in once)):
                        continue
                    before = this
                rows.append(row)
                if merge and len(rows) > MERGED_ROWS:
                    rows = [merge(rows)]
        if rows:
            yield from work(now, rows)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for columns in found(batches):
            if fold is None:
                yield batch_of(columns, out)
                continue
            held.append(columns)
            size += len(next(iter(columns.values())))
            if size > HELD_ROWS:
                held = [fold(held)]
                size = 0
        if held:
            yield batch_of(fold(held), out)

    return sorted_rows.mapInArrow(trimmed(run), out)
