"""Exact removal of repeated byte strings by blockwise sorting of suffixes with a difference cover.

Every suffix matters to a depth of LENGTH bytes only: a byte goes if some string of LENGTH bytes over it
also starts in a document with a smaller doc_id. Texts are packed into chunks. Then

1. the suffixes at positions whose remainder by V lies in the difference cover D are sorted, bucket by
   bucket, to a depth of LENGTH - V + 1 bytes; of each the rank is known as far as needed: whether it is
   tied with a suffix of another document. For any two positions some shift below V brings both into the
   cover, so two equal strings of LENGTH bytes hold a tied pair of cover suffixes at one shift;
2. only suffixes with a tied cover suffix within their first V positions are left (all others are unique);
   they are dealt to buckets and sorted to the full depth, one bucket at a time, and each bucket answers
   which chunks hold a string that starts in a smaller document;
3. each chunk marks the bytes under its answered strings.

Suffixes are compared by hashes of their bytes in place of the bytes themselves: the cover's by 40 bits or
more (a false tie only lets a unique suffix into step 2), the others by 64 bits and a second, independent hash
of as many bytes as keep the chance of any false match in the whole input under one in a million, however
large it is. Buckets get sorted arrays from chunks
and answer with one bit a string, so that text is never shuffled: chunks are a table bucketed by chunk
number, and the answers come to it. A bucket holds a bounded share of all suffixes, and each string once
a chunk, however often it repeats.

Copies of whole texts are settled before: all but the smallest doc_id's are removed whole, if they have
LENGTH bytes.

Defined results: a null text is empty; a row with a null doc_id is neither removed from nor counted as
smaller than any; repeated rows of one doc_id don't remove each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blobs import by_bucket, dealt, decode, encode, mix
from tidemark.llm.common import batch_of, bounded_batches, let_go, noted, read, shared_dir, tidied, trimmed, written
from tidemark.llm.graph import small

LENGTH = 50
#: A perfect difference set: the differences of its members are all remainders by V.
V, D = 21, (0, 1, 4, 14, 16)
CHUNK_BYTES = 4 << 20  # places in a chunk are 32-bit numbers
BLOCK = 1 << 15  # strings hashed at once
BUCKET_SUFFIXES = 1 << 20
NO_ID = 2**63 - 1


def sorting(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of numbers, and the numbers in order. They are sorted with their places in the low bits, which
    is several times faster; where the bits above don't tell all numbers apart, as they are."""
    low = np.uint64((1 << max(len(h) - 1, 0).bit_length()) - 1)
    order = (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    out = h[order]
    if (out[1:] < out[:-1]).any():
        order = np.argsort(h, kind="stable")
        out = h[order]
    return order, out


def numbered(order: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the groups in an order, given where neighbours differ: where each begins, and of each place its group."""
    new = np.flatnonzero(np.concatenate([[True], differs])) if len(order) else np.zeros(0, np.int64)
    number = np.zeros(len(order), np.int32)
    number[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(order))))
    return new, number


def runs(at: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs that at - before up to at + after cover together, for places in order."""
    begin, end = np.maximum(at - before, 0), at + after
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(at) else np.zeros(0, np.int64)
    return begin[new], end[np.append(new[1:], len(at))[: len(new)] - 1]


def at_words(length: int) -> list[int]:
    """Where the words of eight bytes begin that cover a string."""
    return [*range(0, length - 7, 8), length - 8]


def first_hash(words: list[np.ndarray], length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(words[0]), length, np.uint64)
        for w in words:
            h ^= w
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        return mix(h)


def second_hash(words: list[np.ndarray], width: int) -> np.ndarray:
    """Hashes of width bytes: sums of words times odd numbers, scattered."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(words[0]), np.uint64)
        for i, w in enumerate(words, 1):
            h += w * (mix(np.array([i * 0xA24BAED4963EE407 % 2**64], dtype=np.uint64)) | np.uint64(1))
        return mix(h) >> np.uint64(64 - 8 * width)


class Chunk:
    """Texts one after another: data, the end of each, and their ids."""

    def __init__(self, data: bytes, ends: bytes, ids: bytes, length: int, cover_bits: int):
        self.raw, self.length, self.cover_bits = data, length, cover_bits
        self.ends, self.ids = np.frombuffer(ends, "<i8"), np.frombuffer(ids, "<i8")
        self.named, self.rank = np.unique(self.ids, return_inverse=True)  # documents by id
        self.size = len(data)
        padded = np.frombuffer(data + b"\0" * 8, np.uint8)
        self.words = np.ndarray((self.size + 1,), "<u8", padded, strides=(1,))

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The documents at places in order."""
        return np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(np.searchsorted(at, self.ends), prepend=0))

    def checks(self, at: np.ndarray, length: int, width: int) -> np.ndarray:
        """Second hashes of the strings of length bytes at these places."""
        return second_hash([self.words[at + k] for k in at_words(length)], width)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit hashes of the strings of length bytes at these places."""
        return first_hash([self.words[at + k] for k in at_words(length)], length)

    def fits(self, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
        return at + length <= self.ends[doc]

    def cover(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the cover suffixes: place, number of the key, and of the keys, sorted: value, seen in two documents."""
        depth = self.length - V + 1
        at = (np.arange(0, self.size, V, dtype=np.int32)[:, None] + np.array(D, dtype=np.int32)[None, :]).ravel()
        at = at[at + depth <= self.size]
        whole = max(0, (self.size - depth - D[-1]) // V + 1)  # periods with all their places
        h = np.empty(len(at), np.uint64)
        for j, d in enumerate(D):
            h[j : whole * len(D) : len(D)] = first_hash([self.words[d + k :: V][:whole] for k in at_words(depth)], depth)
        h[whole * len(D) :] = self.hashes(at[whole * len(D) :], depth)
        doc = self.doc(at)
        keep = self.fits(at, doc, depth)
        at, doc, h = at[keep], doc[keep], h[keep]
        shift = np.uint64(64 - self.cover_bits)
        order, h = sorting(h >> shift << shift)
        new, number = numbered(order, h[1:] != h[:-1])
        last = np.append(new[1:], len(h))[: len(new)] - 1
        doc = doc[order]
        return at, number, h[new], doc[new] != doc[last]

    def candidates(self, tied: np.ndarray) -> np.ndarray:
        """Places of full-depth strings with a tied cover suffix within their first V places."""
        begin, end = runs(tied, V - 1, 1)
        n = end - begin
        at = np.arange(n.sum(), dtype=np.int32) + np.repeat(begin - (np.cumsum(n) - n), n).astype(np.int32)
        return at[self.fits(at, self.doc(at), self.length)]

    def suffixes(self, tied: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the candidates: place, number of the key, and of the keys, sorted: value, second hash, rank of the smallest id here."""
        at = self.candidates(tied)
        h, more = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for x in range(0, len(at), BLOCK):
            words = [self.words[at[x : x + BLOCK] + k] for k in at_words(self.length)]
            h[x : x + BLOCK], more[x : x + BLOCK] = first_hash(words, self.length), second_hash(words, width)
        order, keys, checks, differs = two_keys(h, more)
        new, number = numbered(order, differs)
        rank = self.rank[self.doc(at)]
        return at, number, keys[new], checks[new], np.minimum.reduceat(rank[order], new) if len(new) else rank


def two_keys(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by two hashes, both in order, and where neighbours differ. It is by the first if that says it all."""
    order, first = sorting(h)
    second = more[order]
    differs = first[1:] != first[:-1]
    if (second[1:] != second[:-1])[~differs].any():
        order = np.lexsort((more, h))
        first, second = h[order], more[order]
        differs = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return order, first, second, differs


def bits_by_bucket(answers: list[dict], keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of all buckets to a chunk's sorted keys, in order."""
    _, used, edge = dealt(keys, buckets)  # sorted keys are in order of bucket already
    out = np.zeros(len(keys), dtype=bool)
    for a, k in zip(answers, np.searchsorted(used, [a["bucket"] for a in answers]).tolist(), strict=True):
        lo, hi = edge[k], edge[k + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo)
    return out


CHUNKS = "chunk long, n long, data binary, ends binary, ids binary"
COVER_KEYS = "bucket int, chunk long, keys binary, more binary"
SUFFIX_KEYS = COVER_KEYS + ", docs binary, checks binary"


def check_width(total: int) -> int:
    """Bytes of the second hash: two of n strings agree by chance in 64 bits and these with n ** 2 / 2 ** (65 + 8 width)."""
    return min(8, max(1, -(-(2 * total.bit_length() - 45) // 8)))


def as_bytes(x: np.ndarray, width: int) -> bytes:
    """Numbers of width bytes, by bytes of one place."""
    x = x.astype(np.uint64)
    return b"".join((x >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(width))


def as_numbers(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros(len(raw) // width, np.uint64)
    for i, x in enumerate(np.frombuffer(raw, np.uint8).reshape(width, -1)):
        out |= x.astype(np.uint64) << np.uint64(8 * i)
    return out


def chunk_table(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs (doc_id, text) as chunks, in a table bucketed by chunk in the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches):
        from pyspark import TaskContext

        base, parts, ids, ends, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            nonlocal base, parts, ids, ends, size
            out = {"chunk": base, "n": size, "data": b"".join(parts), "ends": np.array(ends, "<i8").tobytes(), "ids": np.array(ids, "<i8").tobytes()}
            base, parts, ids, ends, size = base + 1, [], [], [], 0
            return batch_of({k: [v] for k, v in out.items()}, CHUNKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                parts.append(raw)
                size += len(raw)
                ids.append(NO_ID if doc_id is None else doc_id)
                ends.append(size)
                if size >= chunk_bytes:
                    yield row()
        if ids:
            yield row()

    chunks = docs.mapInArrow(trimmed(run), CHUNKS)
    name = f"tidemark_chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, "chunk").saveAsTable(name)
    noted(spark, path, name)
    return spark.table(name)


def with_answers(chunks: DataFrame, answers: DataFrame | None, name: str) -> DataFrame:
    """chunks with the answers to each as a list; chunks are not shuffled."""
    lists = answers.groupBy(F.col("chunk").alias("_of")).agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return chunks.join(lists.hint("shuffle_merge"), F.col("chunk") == F.col("_of"), "left").drop("_of")


def cover_keys(chunks: DataFrame, length: int, bits: int, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, _, keys, twice = Chunk(row["data"], row["ends"], row["ids"], length, bits).cover()
                _, used, edge = dealt(keys, buckets)
                cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                yield batch_of({"bucket": used.astype(np.int32), "chunk": [row["chunk"]] * len(used), "keys": [encode(keys[x:y] >> np.uint64(64 - bits)) for x, y in cuts], "more": [np.packbits(twice[x:y]).tobytes() for x, y in cuts]}, COVER_KEYS)

    return chunks.select("chunk", "data", "ends", "ids").mapInArrow(trimmed(run), COVER_KEYS)


def tied_in_bucket(bucket: int, rows: list[dict]):
    """Answers for cover suffixes: is the key in two documents?"""
    keys = [decode(r["keys"]) for r in rows]
    whole = np.sort(np.concatenate(keys))
    tied = np.unique(whole[1:][whole[1:] == whole[:-1]])
    bits = []
    for k, r in zip(keys, rows, strict=True):
        at = np.searchsorted(tied, k)
        found = tied[np.minimum(at, len(tied) - 1)] == k if len(tied) else np.zeros(len(k), bool)
        bits.append(np.packbits(found | np.unpackbits(np.frombuffer(r["more"], np.uint8), count=len(k)).astype(bool)).tobytes())
    yield {"chunk": [r["chunk"] for r in rows], "bucket": [bucket] * len(rows), "bits": bits}


def tied_places(chunk: Chunk, answers: list[dict] | None, buckets: int) -> np.ndarray:
    at, number, keys, _ = chunk.cover()
    return at[bits_by_bucket(answers or [], keys, buckets)[number]] if len(keys) else at


def suffix_keys(chunks: DataFrame, length: int, bits: int, buckets: int, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["data"], row["ends"], row["ids"], length, bits)
                _, _, keys, checks, least = chunk.suffixes(tied_places(chunk, row["tied"], buckets), width)
                _, used, edge = dealt(keys, buckets)
                out = {"bucket": used.astype(np.int32), "chunk": [row["chunk"]] * len(used), "keys": [], "more": [], "docs": [], "checks": []}
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    here = np.zeros(len(chunk.named), bool)
                    here[least[x:y]] = True
                    out["keys"].append(encode(keys[x:y]))
                    out["more"].append(as_bytes((np.cumsum(here) - 1)[least[x:y]], 4))
                    out["docs"].append(chunk.named[here].astype("<i8").tobytes())
                    out["checks"].append(as_bytes(checks[x:y], width))
                yield batch_of(out, SUFFIX_KEYS)

    return chunks.select("chunk", "data", "ends", "ids", "tied").mapInArrow(trimmed(run), SUFFIX_KEYS)


def smaller_in_bucket(bucket: int, rows: list[dict]):
    """Answers for full-depth strings: does the string start in a smaller document than here?"""
    keys = [decode(r["keys"]) for r in rows]
    docs = [np.frombuffer(r["docs"], "<i8")[as_numbers(r["more"], 4).astype(np.int64)] for r in rows]
    whole, own = np.concatenate(keys), np.concatenate(docs)
    check = np.concatenate([as_numbers(r["checks"], len(r["checks"]) // len(k)) for k, r in zip(keys, rows, strict=True)])
    whole -= whole.min()  # a bucket's keys are alike in their high bits, which are put to use
    whole <<= np.uint64(min(63, 64 - int(whole.max()).bit_length()))
    order, _, _, differs = two_keys(whole, check)
    new, number = numbered(order, differs)
    least = np.minimum.reduceat(own[order], new)[number]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    bits = [np.packbits(a < b).tobytes() for a, b in zip(np.split(least, cut), docs, strict=True)]
    yield {"chunk": [r["chunk"] for r in rows], "bucket": [bucket] * len(rows), "bits": bits}


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def marked(chunks: DataFrame, length: int, bits: int, buckets: int, width: int, with_text: bool) -> DataFrame:
    schema = RESULT + ", kept binary" * with_text

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["data"], row["ends"], row["ids"], length, bits)
                at, number, keys, _, least = chunk.suffixes(tied_places(chunk, row["tied"], buckets), width)
                doc = chunk.doc(at)
                own = chunk.rank[doc]
                gone = at[(bits_by_bucket(row["smaller"] or [], keys, buckets)[number] | (least[number] < own)) & (chunk.ids[doc] != NO_ID)]
                start, out = 0, {k.split()[0]: [] for k in RESULT.split(", ")}
                kept_text = []
                ends = np.searchsorted(gone, chunk.ends).tolist()
                for doc_id, end, x, y in zip(chunk.ids.tolist(), chunk.ends.tolist(), [0, *ends], ends, strict=False):
                    begin, stop = runs(gone[x:y], 0, length) if x < y else (gone[:0], gone[:0])
                    kept = b"".join(chunk.raw[i:j] for i, j in zip([start, *stop.tolist()], [*begin.tolist(), end], strict=True))
                    out["doc_id"].append(None if doc_id == NO_ID else doc_id)
                    out["n_bytes"].append(end - start)
                    out["n_removed"].append(end - start - len(kept))
                    out["n_spans"].append(len(begin))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    kept_text.append(kept)
                    start = end
                if with_text:
                    out["kept"] = kept_text
                yield batch_of(out, schema)

    return chunks.select("chunk", "data", "ends", "ids", "tied", "smaller").mapInArrow(trimmed(run), schema)


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): what is removed, and the hash of the rest; with_text adds the rest."""
    if length < V + 7:
        raise ValueError(f"length must be {V + 7} at least")
    return tidied(lambda: _dedup(docs, length, with_text, chunk_bytes), "removed")


def _dedup(docs: DataFrame, length: int, with_text: bool, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text")
    long_enough = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    sums = long_enough.select("doc_id", F.sha2("text", 256).alias("sum"), F.octet_length("text").cast("long").alias("n"))
    first = sums.groupBy("sum").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = written(sums.join(small(written(first, "copies")), "sum").where("doc_id > least").select("doc_id", "sum", "n"), "copies")
    bare = F.lit(hashlib.sha256(b"").hexdigest())
    whole = copies.select("doc_id", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), bare.alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_text else []))
    gone = copies.select(F.col("doc_id").alias("_id"), F.col("sum").alias("_sum")).distinct()
    # an id may be on several rows of different text: the text decides too
    rest = docs.join(small(gone), (F.col("doc_id") == F.col("_id")) & (F.sha2("text", 256) == F.col("_sum")), "left_anti")
    chunks = chunk_table(rest, chunk_bytes)
    total = chunks.agg(F.sum("n")).first()[0] or 0  # one number
    buckets = max(128, total * len(D) // V // BUCKET_SUFFIXES)
    bits, width = min(64, max(40, total.bit_length() + 10)), check_width(total)
    tied = written(by_bucket(cover_keys(chunks, length, bits, buckets), tied_in_bucket, "chunk long, bucket int, bits binary"), "tied")
    let_go(spark)
    chunks = with_answers(chunks, tied, "tied")
    smaller = written(by_bucket(suffix_keys(chunks, length, bits, buckets, width), smaller_in_bucket, "chunk long, bucket int, bits binary"), "smaller")
    let_go(spark)
    return marked(with_answers(chunks, smaller, "smaller"), length, bits, buckets, width, with_text).unionByName(whole)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 3: every whole text of documents, strings of 50 bytes."""
    return dedup(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rn, CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT rn, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS t FROM d, unnest(range(0, len(h) // 2 - {LENGTH - 1})) u(i)
), f AS (SELECT t, min(doc_id) AS least FROM s GROUP BY 1),
g AS (SELECT rn, i FROM s JOIN f USING (t) WHERE least < doc_id),
b AS (SELECT rn, i, CASE WHEN i <= coalesce(lag(i) OVER (PARTITION BY rn ORDER BY i), -1000) + {LENGTH} THEN 0 ELSE 1 END AS first FROM g),
k AS (SELECT rn, i, sum(first) OVER (PARTITION BY rn ORDER BY i) AS span FROM b),
r AS (SELECT rn, span, min(i) AS a, max(i) + {LENGTH} AS z FROM k GROUP BY ALL),
m AS (SELECT rn, count(*) AS spans, sum(z - a) AS removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM r GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE
    array_to_string(list_transform(range(1, spans + 2), lambda j: substr(h, 2 * CAST(CASE WHEN j = 1 THEN 0 ELSE z[j - 1] END AS BIGINT) + 1, 2 * CAST(CASE WHEN j > spans THEN len(h) // 2 ELSE a[j] END - CASE WHEN j = 1 THEN 0 ELSE z[j - 1] END AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN m USING (rn)
"""
