"""Topics, record keys, and the partition a Kafka client would pick, all as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
SEED, M = 0x9747B28C, 0x5BD1E995  # fixed values of the murmur2 variant


def topic_name(prefix: str, schema: str, table: str) -> str:
    """prefix.schema.table; the prefix is one plain name."""
    if not prefix or "." in prefix:
        raise ValueError("a topic prefix is not empty and has no dot")
    return f"{prefix}.{schema}.{table}"


def key_columns_for(table: str, primary_keys: dict[str, list[str]], overrides: dict[str, list[str]] | None = None) -> list[str]:
    """The columns that key a table's records: an override, or the primary key."""
    return list((overrides or {}).get(table, primary_keys[table]))


def record_key(*columns: str) -> Column:
    """Compact JSON of the key columns in the order given; nulls stay, numbers stay numbers."""
    if not columns:
        raise ValueError("a record key needs a column")
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def image_key(image: Column, columns: list[str]) -> Column:
    """Compact JSON of the key columns of a map of text; an absent column is an error."""
    if not columns:
        raise ValueError("a record key needs a column")
    have = F.forall(F.array(*[F.lit(c) for c in columns]), lambda c: F.map_contains_key(image, c))
    key = F.to_json(F.struct(*[image[c].alias(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.when(have, key).otherwise(F.raise_error(F.lit("the image lacks a key column")))


def identity(image: Column, columns: list[str]) -> Column:
    """The values of the columns, or null if the image is null or lacks one; a present null counts."""
    have = F.forall(F.array(*[F.lit(c) for c in columns]), lambda c: F.map_contains_key(image, c))
    return F.when(image.isNotNull() & have, F.array(*[image[c] for c in columns]))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _times(x: Column) -> Column:
    return (x * F.lit(M)).bitwiseAND(F.lit(MASK))


def _little(digits: Column) -> Column:
    """The number of eight hexadecimal digits whose bytes come lowest first."""

    def swapped(v: Column) -> Column:
        low = F.shiftleft(v.bitwiseAND(F.lit(0xFF)), 24).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(0xFF00)), 8))
        return low.bitwiseOR(F.shiftright(v, 8).bitwiseAND(F.lit(0xFF00))).bitwiseOR(F.shiftright(v, 24))

    return let(F.conv(digits, 16, 10).cast("long"), swapped)


def murmur2(key: Column) -> Column:
    """Unsigned 32-bit murmur2 of the UTF-8 bytes, as the Java client computes it; null for null."""

    def of(raw: Column) -> Column:  # hexadecimal digits, two a byte
        n = (F.length(raw) / 2).cast("long")
        words = F.when(n >= 4, F.transform(F.sequence(F.lit(0), F.floor(n / 4).cast("int") - 1), lambda j: _times(_little(F.substring(raw, j * 8 + 1, F.lit(8))))))
        h = F.aggregate(F.coalesce(words, F.array().cast("array<bigint>")), F.lit(SEED).cast("long").bitwiseXOR(n), lambda acc, k: _times(acc).bitwiseXOR(_times(k.bitwiseXOR(F.shiftrightunsigned(k, 24)))))
        rest = _little(F.rpad(F.substring(raw, ((n - n % 4) * 2 + 1).cast("int"), F.lit(8)), 8, "0"))
        h = F.when(n % 4 > 0, _times(h.bitwiseXOR(rest))).otherwise(h)
        h = let(h, lambda x: _times(x.bitwiseXOR(F.shiftrightunsigned(x, 13))))
        return let(h, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 15)))

    return let(F.hex(F.encode(key, "utf-8")), of)


def partition_for(key: Column, partitions: int) -> Column:
    """The murmur2 hash without its sign bit, modulo the number of partitions."""
    if partitions < 1:
        raise ValueError("at least one partition")
    return (murmur2(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")


def lsn_number(text: Column) -> Column:
    """A log position in its text form (two hexadecimal halves) as a number that sorts."""
    halves = F.split(text, "/")
    return F.conv(halves[0], 16, 10).cast("long") * F.lit(2**32) + F.conv(halves[1], 16, 10).cast("long")


def checked_name(name: str) -> str:
    """A column name that is safe to quote."""
    if '"' in name or "`" in name:
        raise ValueError("a name may not hold a quote")
    return f"`{name}`"
