"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct n-word shingles. Sets are put in size bands so that two sets similar
enough lie in one band or in neighbouring ones. For a band the similarity bounds the size k of the
symmetric difference. The feature domain is dealt to n1 groups of N2 parts each; by counting, some group
holds few of the differing elements, at most K2, and then some N2 - K2 of its parts hold none. So a set's
signatures are, for each group and each choice of N2 - K2 parts, a hash of its elements there: two similar
sets share one. Sets that have no element in chosen parts would all share that signature; each band gets
some groups more than needed, so that a set with up to so many such groups can leave these signatures out.
Elements of very many documents are left out of the signatures, which makes no difference larger. A set
that has too few elements then adds the signatures of all its elements, and if those are too few as well
its prefix: of the elements in a fixed order, the first of which two similar sets must share one.

Signatures are owned by sketches rather than sets: a set's sketch is a hash of its least elements in a few
fixed orders, which near copies mostly share. Sets of one sketch are candidates of each other, so that what
meets by signature is the sketches, and candidate links are between these. Each batch of documents keeps
one owner of a signature and links the others to it before anything is shuffled, and what a task has linked
goes by one name in it; tasks that gather signatures keep one owner of each too, as they come. A signature of very many documents is thus neither a long list nor many links.

Sketches that share a signature form clusters (connected components of the candidate links). Clusters too
large for one block are formed anew, by elements of the sets' prefixes, rarest first. Within a cluster the
links are verified exactly, all pairs of a block by one matrix product; large clusters are cut into blocks
by hash, first each block and the cluster's leader, then, where that has left more than one component, what
is outside the largest one against all of the cluster. Copies (equal sets) are one entity throughout, so groups of copies never make pairs.

Defined results: a null or empty text has an empty set, which links with nothing; fewer than n words make
one shingle; repeated rows and equal sets are linked; a row with a null doc_id takes part like any other
(links lead through it), but a component is named by its smallest id that isn't null (null if there is
none); an empty table gives an empty result; other columns are ignored by components_of() and kept by
one_of_each(), which keeps a row of null doc_id only if its component has no id, one for the component, or
if its set is empty.
"""

from __future__ import annotations

import bisect
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.blobs import KEY_SHIFT, KEYED, by_bucket, dealt, decode, encode, keyed, mix, unkeyed
from tidemark.llm.common import batch_of, bounded_batches, let_go, map_rows, read, tidied, trimmed, written
from tidemark.llm.graph import Forest, components, forest, small

N2, K2 = 3, 1
BUCKET_NUMBERS = 1 << 20
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
COMMON, LEAST_IN_TASK, MOST_COMMON = 24, 3, 300_000
SKETCH = 3
CHOICES = list(itertools.combinations(range(N2), N2 - K2))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    # a word is the sum of its bytes' numbers times powers of an odd number, counted from its start
    power, inverse = powers(len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTES[raw] * power, out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])


BASE = 0x9E3779B97F4A7C15
KEPT_POWERS = 1 << 20
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE, from 1 up, and those of its inverse, from 0 up; kept if they aren't many."""
    if _POWERS and len(_POWERS[-1][0]) >= n:
        return tuple(x[:n] for x in _POWERS[-1])
    size = max(n, min(KEPT_POWERS, 1 << 14 if n <= 1 << 14 else 2 * n))
    with np.errstate(over="ignore"):
        found = tuple(np.cumprod(np.full(size, f % 2**64, dtype=np.uint64)) for f in (BASE, pow(BASE, -1, 2**64)))
    found = found[0], np.concatenate([[np.uint64(1)], found[1][:-1]])
    if size <= KEPT_POWERS:
        _POWERS[:] = [found]
    return found[0][:n], found[1][:n]


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
STEPS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The set of n-word shingles, as sorted 64-bit hashes."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < n:
            steps = STEPS[: len(words)]
            return mix(np.array([(words * steps).sum(dtype=np.uint64) + np.uint64(len(words)) * np.uint64(0xE7037ED1A0B428DB)], dtype=np.uint64))
        at = words[: len(words) - n + 1] * STEPS[0]
        for k in range(1, n):
            at = at + words[k : len(words) - n + 1 + k] * STEPS[k]
        return np.unique(mix(at))


def fingerprint(elements: np.ndarray) -> int:
    """Of a set: equal sets have equal ones."""
    with np.errstate(over="ignore"):
        x = mix(elements ^ np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64) + np.uint64(len(elements)) * np.uint64(0x589965CC75374CC3)
        return int(mix(np.array([x], dtype=np.uint64)).view(np.int64)[0])


def rare_of(elements: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements that aren't in common (sorted), and those that are."""
    if not len(common):
        return elements, elements[:0]
    known = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] == elements
    return elements[~known], elements[known]


def sketch(elements: np.ndarray, rare: np.ndarray) -> int:
    """A hash of the least rare elements (of any, if none is rare) in SKETCH orders."""
    with np.errstate(over="ignore"):
        of = rare if len(rare) else elements
        least = [(of ^ STEPS[40 + k]).min() for k in range(SKETCH)]  # elements are scattered already
        return int(mix((np.array(least, dtype=np.uint64) * STEPS[48 : 48 + SKETCH]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


class Bands:
    """Size bands for a similarity of percent / 100: least and largest size of each, and its k."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be 1 to 100")
        self.percent, self.low, self.high = percent, [1], []
        while self.low[-1] < 1 << 40:
            self.high.append(self.low[-1] * 100 // percent)
            self.low.append(self.high[-1] + 1)
        self.low.pop()
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}

    def of(self, size: int) -> int:
        return bisect.bisect_right(self.low, size) - 1

    def layout(self, band: int, salt: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where the parts of all groups begin, a number for each choice of each group, and the spare groups."""
        if found := self.kept.get((band, salt)):
            return found
        groups, spare = self.groups(band)
        parts = groups * N2
        with np.errstate(over="ignore"):
            begin = ((np.arange(parts, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts) << np.uint64(32)
            own = mix(np.array([2 * band + salt + 1], dtype=np.uint64))
            place = mix(np.arange(1, groups + 1, dtype=np.uint64) ^ own)[:, None] + STEPS[8 : 8 + len(CHOICES)]
        if groups <= 1 << 14:
            self.kept[band, salt] = begin, place, spare
        return begin, place, spare

    def differing(self, band: int) -> int:
        """The largest symmetric difference of similar sets that meet in this band."""
        return (100 - self.percent) * 2 * self.high[band] // (100 + self.percent)

    def groups(self, band: int) -> tuple[int, int]:
        """Number of groups, and how many of them are spare."""
        needed = -(-(self.differing(band) + 1) // (K2 + 1))
        spare = max(1, needed // 16)
        return needed + spare, spare


#: For each choice of parts, which they are, and what their sums are multiplied with.
CHOSEN = np.array([[p in c for p in range(N2)] for c in CHOICES])
FACTORS = np.where(CHOSEN, STEPS[16 : 16 + N2], np.uint64(0))


def _projections(elements: np.ndarray, bands: Bands, band: int, salt: int) -> tuple[np.ndarray, bool]:
    """The signatures of a band that hold an element, and whether more groups lack one than are spare.
    elements are sorted and scattered: parts are ranges of them, and a part's hash is the sum of its elements."""
    begin, place, spare = bands.layout(band, salt)
    edge = np.append(np.searchsorted(elements, begin), len(elements))
    total = np.zeros(len(elements) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(elements, out=total[1:])
        sums = (total[edge[1:]] - total[edge[:-1]]).reshape(-1, 1, N2)
        there = ((np.diff(edge) > 0).reshape(-1, 1, N2) & CHOSEN).any(2)
        x = mix((sums * FACTORS).sum(2, dtype=np.uint64) + place)
    return x[there], int((~there).any(1).sum()) > spare


def signatures(elements: np.ndarray, bands: Bands, common: np.ndarray) -> np.ndarray:
    """Of one set. Elements in common (sorted) are left out at first: that makes no difference larger,
    so the counting argument holds, and sets don't meet for a passage that many documents have."""
    size, found = len(elements), []
    rare, known = rare_of(elements, common)
    own = bands.of(size)
    for band in (own, own + 1):
        if bands.differing(band) == 0:  # equal sets only, and those are one entity
            continue
        sig, bare = _projections(rare, bands, band, 0)
        found.append(sig)
        if bare:  # what these sets share may be common elements only
            sig, bare = _projections(elements, bands, band, 1)
            found.append(sig)
        if bare:
            least = -(-size * bands.percent // 100)  # what a similar set shares with this one
            with np.errstate(over="ignore"):
                found.append(mix(np.concatenate([rare, known])[: size - least + 1] * STEPS[32] + np.uint64(band)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def common_elements(docs: DataFrame, n: int, least: int = COMMON, most: int = MOST_COMMON) -> np.ndarray:
    """Shingles of at least so many documents, sorted: the most frequent ones, most at most. All documents
    are counted, task by task, and counts below LEAST_IN_TASK of a task are left out. Any choice gives the
    same links; this one keeps signature groups small."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held, size = [], 0

        def counted():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            pick = times >= LEAST_IN_TASK
            return batch_of({"e": values[pick].view(np.int64), "n": times[pick].astype(np.int64)}, "e long, n long")

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, n))
                size += len(held[-1])
            if size > 2_000_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    sums = docs.select("text").mapInArrow(trimmed(run), "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = sums.orderBy(F.desc("n"), "e").limit(most).select("e").toArrow()["e"]  # 8 bytes each
    return np.sort(top.to_numpy().astype(np.int64).view(np.uint64))


def described(docs: DataFrame, n: int, common: np.ndarray) -> DataFrame:
    """Per row of docs: doc_id, the set's size, its fingerprint and its sketch (both null if it's empty)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            entities = [fingerprint(s) if len(s) else None for s in sets]
            return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "entity": entities, "sketch": [sketch(s, rare_of(s, common)[0]) if len(s) else None for s in sets]}

        return work

    return map_rows(docs, make, "doc_id long, n_shingles long, entity long, sketch long")


def _starred(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys and their owners: the keys in order, an owner of each, and links of the others to it."""
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    first = who[np.flatnonzero(new)][np.cumsum(new) - 1]
    pick = first != who
    a, b = first[pick], who[pick]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return keys[new], who[new], np.stack([a[once], b[once]], 1)


def _fewest(links: list[np.ndarray]) -> np.ndarray:
    links = np.concatenate([np.zeros((0, 2), np.int64), *links])
    return links[forest(links)[0]]


def links_of(blobs: DataFrame) -> DataFrame:
    """Links (a, b) between owners that share a key of blobs (KEYED): a forest of them for each task. A
    row without places (at) holds links instead: their ends are its keys and its owners."""

    def gathered(rows):
        parts = [r for r in rows if "starred" in r]
        plain = [r for r in rows if "starred" not in r and r["at"]]
        links = [np.stack([np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["owners"], "<i8")], 1) for r in rows if "starred" not in r and not r["at"]]
        keys, who = [p["starred"][0] for p in parts], [p["starred"][1] for p in parts]
        if plain:
            more = unkeyed(plain)
            keys, who = [*keys, more[0]], [*who, more[1]]
        if keys:
            starred = _starred(np.concatenate(keys), np.concatenate(who))
            links.append(starred[2])
        else:
            starred = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return {"starred": (starred[0], starred[1], _fewest([*(p["starred"][2] for p in parts), *links]))}

    def meet(_, rows):
        links = gathered(rows)["starred"][2]
        if len(links):
            yield {"a": links[:, 0].copy(), "b": links[:, 1].copy()}

    def fewer(found):  # of a task's buckets together
        links = _fewest([np.stack([x["a"], x["b"]], 1) for x in found])
        return {"a": links[:, 0].copy(), "b": links[:, 1].copy()}

    return by_bucket(blobs, meet, "a long, b long", fold=fewer, merge=gathered)


def own_links(found: np.ndarray, buckets: int) -> dict:
    """Rows of KEYED with a task's own links, dealt to buckets by their first ends."""
    order, used, edge = dealt(mix(found[:, 0].copy().view(np.uint64)), buckets)
    parts = [found[order[x:y]] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return {"bucket": used.astype(np.int32), "keys": [p[:, 0].astype("<i8").tobytes() for p in parts], "at": [b""] * len(parts), "owners": [p[:, 1].astype("<i8").tobytes() for p in parts]}


def buckets_for(numbers: int) -> int:
    return max(64, numbers // BUCKET_NUMBERS)


def candidate_links(docs: DataFrame, n: int, percent: int, total: int, common: np.ndarray) -> DataFrame:
    """Links (a, b) between sketches whose sets share a signature; total is the number of all shingles."""
    bands, buckets = Bands(percent), buckets_for(total)
    bounded_batches(docs.sparkSession)

    def deal(batches):
        seen: set[int] = set()
        kept, trees = [], Forest()
        for batch in batches:
            owners, found = [], []
            for text in batch.column(0).to_pylist():
                s = shingles(text, n)
                if len(s) and (e := fingerprint(s)) not in seen:
                    seen.add(e)
                    sig = signatures(s, bands, common)
                    if len(sig):
                        found.append(sig)
                        owners.append(sketch(s, rare_of(s, common)[0]))
            if found:
                names, of = np.unique(np.array(owners, dtype=np.int64), return_inverse=True)
                keys, at, own = _starred(np.concatenate(found), np.repeat(of, [len(x) for x in found]))
                if len(own):  # what this task has linked goes by one name from here on
                    links = names[own]
                    kept.append(links[trees.add(links)])
                names = np.array([trees.root(x) for x in names.tolist()], dtype=np.int64)
                yield batch_of(keyed(keys, at, names, buckets), KEYED)
        if any(map(len, kept)):
            yield batch_of(own_links(np.concatenate(kept), buckets), KEYED)

    return links_of(docs.select("text").mapInArrow(trimmed(deal), KEYED))


def texts_of(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """text and the columns of members (doc_id, entity, ...): rows of docs that may have a member's set.
    Members without a doc_id are found by their sets, in each task by the first row that has it."""
    found = docs.where("doc_id is not null").join(small(members.where("doc_id is not null")), "doc_id").select("text", *members.columns)
    bare = members.where("doc_id is null")
    if not bare.limit(1).count():
        return found

    def make():
        seen = {None}  # one row of a set is enough of a task

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, n) for t in batch.column(0).to_pylist()]
            entities = [fingerprint(s) if len(s) else None for s in sets]
            return {"text": batch.column(0), "entity": [None if e in seen else seen.add(e) or e for e in entities]}

        return work

    nulls = map_rows(docs.where("doc_id is null").select("text"), make, "text string, entity long").where("entity is not null")
    return found.unionByName(nulls.join(small(bare), "entity").select("text", *members.columns))


PIECES = "chunk long, sizes binary, owners binary, keys binary"


def prefix_links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between members that share an element of their prefixes, the elements of fewest
    members first. Similar sets share one; sets that only have a passage in common mostly don't, because
    their own elements come first.

    Sets lie in chunks. A chunk asks once for each of its elements in how many members it is, and gets one
    number back; so an element of very many members is one entry a chunk, and its owners never meet for it.
    """
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = buckets_for(total)
    chosen = texts_of(docs, members.select("doc_id", "entity"), n).select("text", "entity")

    def collect(batches):
        chunk, seen = TaskContext.get().partitionId() << 32, set()
        for batch in batches:
            sets, owners = [], []
            for text, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, n) if e not in seen else shingles(None, n)
                if len(s) and fingerprint(s) == e:
                    sets.append(s)
                    owners.append(e)
                    seen.add(e)
            if sets:
                yield batch_of({"chunk": [chunk], "sizes": [np.array([len(s) for s in sets], "<i8").tobytes()], "owners": [np.array(owners, "<i8").tobytes()], "keys": [np.concatenate(sets).astype("<u8").tobytes()]}, PIECES)
                chunk += 1

    def asked(raw: bytes):
        """The elements of a chunk, the distinct keys among them, where each is, and the buckets of the keys."""
        elements = np.frombuffer(raw, "<u8")
        keys, at, times = np.unique(elements >> KEY_SHIFT << KEY_SHIFT, return_inverse=True, return_counts=True)
        _, used, edge = dealt(keys, buckets)
        return elements, keys, at, times, used, edge

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, keys, _, times, used, edge = asked(row["keys"])
                cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                yield batch_of({"bucket": used.astype(np.int32), "chunk": [row["chunk"]] * len(used), "keys": [encode(keys[x:y] >> KEY_SHIFT) for x, y in cuts], "times": [times[x:y].astype("<u4").tobytes() for x, y in cuts]}, "bucket int, chunk long, keys binary, times binary")

    def answer(bucket, rows):
        keys = [decode(r["keys"]) for r in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([np.frombuffer(r["times"], "<u4") for r in rows]))[at]
        parts = np.split(np.minimum(sums, 2**32 - 1).astype("<u4"), np.cumsum([len(k) for k in keys])[:-1])
        yield {"chunk": [r["chunk"] for r in rows], "bucket": [bucket] * len(rows), "times": [x.tobytes() for x in parts]}

    pieces = written(chosen.mapInArrow(trimmed(collect), PIECES), "pieces")
    replies = by_bucket(pieces.mapInArrow(trimmed(ask), "bucket int, chunk long, keys binary, times binary"), answer, "chunk long, bucket int, times binary")
    lists = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "times")).alias("replies"))

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                elements, keys, at, _, used, edge = asked(row["keys"])
                times = np.zeros(len(keys), np.int64)
                for r, k in zip(row["replies"], np.searchsorted(used, [r["bucket"] for r in row["replies"]]).tolist(), strict=True):
                    times[edge[k] : edge[k + 1]] = np.frombuffer(r["times"], "<u4")
                times, sizes, owners = times[at], np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["owners"], "<i8")
                of = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((elements, times, of))
                place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                prefix = sizes - -(-sizes * percent // 100) + 2  # one more than needed, in case two elements have one key
                order = order[(place < prefix[of]) & (times[order] > 1)]  # what is in one set only meets nothing
                if len(order):
                    yield batch_of(keyed(mix(elements[order]), of[order], owners, buckets), KEYED)

    return links_of(pieces.join(lists, "chunk").select("keys", "sizes", "owners", "replies").mapInArrow(trimmed(deal), KEYED))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Places of the similar pairs: within left, or between left and right. By matrix products of the
    0/1 matrices over the elements that more than one set has."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    common = np.bincount(number) > 1
    keep = common[number]
    columns, of = (np.cumsum(common) - 1)[number[keep]], of[keep]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    n_left, width = len(left), int(common.sum())
    shared = np.zeros((n_left, len(sets) - n_left if right is not None else n_left), dtype=np.int64)
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(columns, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, width - at)), dtype=np.float32)
        m[of[lo:hi], columns[lo:hi] - at] = 1
        shared += np.rint(m[:n_left] @ (m[n_left:] if right is not None else m).T).astype(np.int64)
    other = size[n_left:] if right is not None else size
    union = size[:n_left, None] + other[None, :] - shared
    good = 100 * shared >= percent * union
    if right is None:
        good &= np.triu(np.ones_like(good), 1)
    return list(zip(*(x.tolist() for x in np.nonzero(good)), strict=True))


def sets_of(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members (entity, ...) with their elements, but for doc_id."""
    names = [c for c in members.columns if c != "doc_id"]
    kinds = {"bigint": "long", "int": "int", "boolean": "boolean"}
    schema = ", ".join([*(f"{c} {kinds[t]}" for c, t in members.dtypes if c != "doc_id"), "elements binary"])

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> dict:
            found = []
            for text, e in zip(batch.column("text").to_pylist(), batch.column("entity").to_pylist(), strict=True):
                s = shingles(text, n) if e not in seen else shingles(None, n)
                own = len(s) > 0 and fingerprint(s) == e
                found.append(s.tobytes() if own else None)
                if own:
                    seen.add(e)
            return {c: batch.column(c) for c in names} | {"elements": found}

        return work

    return map_rows(texts_of(docs, members, n).select("text", *names), make, schema).where("elements is not null")


def links_in_blocks(met: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold, of rows (key, side, entity, elements): between the sides of a key, or within
    the only side there is."""

    def check(_, rows):
        sides: tuple[dict, dict] = {}, {}
        for r in rows:
            sides[r["side"]][r["entity"]] = np.frombuffer(r["elements"], np.uint64)
        one, other = (list(s) for s in sides)
        if json.loads(rows[0]["key"])["both"]:
            if not (one and other):
                return
            found = linked(list(sides[0].values()), list(sides[1].values()), percent)
        elif len(one) < 2:
            return
        else:
            found, other = linked(list(sides[0].values()), None, percent), one
        links = np.array([(one[i], other[j]) for i, j in found], dtype=np.int64).reshape(-1, 2)
        links = links[forest(links)[0]]
        if len(links):
            yield {"a": links[:, 0].copy(), "b": links[:, 1].copy()}

    dealt_out = met.select(F.to_json("key").alias("key"), "side", "entity", "elements")
    return by_bucket(dealt_out, check, "a long, b long", key="key", once=("side", "entity"))


def verified(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that hold, of members (doc_id, entity, cluster, leader, blocks), within each block and
    between it and the cluster's leader."""
    sets = sets_of(docs, members.select("doc_id", "entity", "cluster", "leader", "blocks"), n)
    block = F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int")
    everywhere = F.when(F.col("entity") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    met = sets.withColumn("block", F.explode(everywhere))
    return links_in_blocks(met.select(F.struct("cluster", "block", F.lit(False).alias("both")).alias("key"), F.lit(0).alias("side"), "entity", "elements"), percent)


def verified_outside(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """The links (a, b) that are left to find in clusters whose members (doc_id, entity, n_shingles, cluster,
    own: the component so far) are of several components: between members outside the cluster's largest
    component and all others. Within that component links decide nothing, so its members meet only those outside."""
    load = [F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("size")]
    each = written(members.groupBy("cluster", "own").agg(*load), "jaccard")
    main = each.groupBy("cluster").agg(F.max(F.struct("sets", "own")).alias("m")).select("cluster", F.col("m.own").alias("main"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.sum("sets") / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES))).cast("int")
    sides = each.join(small(written(main, "jaccard")), "cluster").groupBy("cluster", "main", (F.col("own") != F.col("main")).alias("outside")).agg(blocks.alias("b"))
    plan = sides.groupBy("cluster", "main").agg(F.max(F.when(~F.col("outside"), F.col("b"))).alias("inner"), F.max(F.when(F.col("outside"), F.col("b"))).alias("outer"))
    own = written(members.join(small(written(plan, "jaccard")), "cluster").select("doc_id", "entity", "cluster", "inner", "outer", (F.col("own") != F.col("main")).alias("outside")), "jaccard")
    sets = sets_of(docs, own, n).withColumn("block", F.pmod(F.xxhash64("entity"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    to = lambda x, y, within: F.struct(x.alias("x"), y.alias("y"), F.lit(within).alias("outer_only"))
    outer, inner = F.sequence(F.lit(0), F.col("outer") - 1), F.sequence(F.lit(0), F.col("inner") - 1)
    block = F.col("block")
    among = F.transform(outer, lambda j: to(F.least(block, j), F.greatest(block, j), True))
    across = F.when(F.col("outside"), F.transform(inner, lambda j: to(block, j, False))).otherwise(F.transform(outer, lambda i: to(i, block, False)))
    met = sets.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(among, across)).otherwise(across)))
    both = ~F.col("at.outer_only") | (F.col("at.x") != F.col("at.y"))
    side = F.when(F.col("at.outer_only"), (block != F.col("at.x")).cast("int")).otherwise((~F.col("outside")).cast("int"))
    return links_in_blocks(met.select(F.struct("cluster", "at.x", "at.y", "at.outer_only", both.alias("both")).alias("key"), side.alias("side"), "entity", "elements"), percent)


def described_clusters(members: DataFrame, clusters: DataFrame, by: str) -> DataFrame:
    """members (doc_id, entity, n_shingles, sketch) with cluster, leader and blocks, those whose cluster has
    more than one; clusters (node, root) are of the column by. A sketch can be a cluster by itself."""
    own = members.join(small(clusters.select(F.col("node").alias(by), F.col("root").alias("cluster"))), by, "left" if by == "sketch" else "inner")
    own = written(own.withColumn("cluster", F.coalesce("cluster", by)), "jaccard")
    load = own.groupBy("cluster").agg(F.min("entity").alias("leader"), F.count(F.lit(1)).alias("sets"), F.greatest(F.lit(1), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES))).cast("int").alias("blocks"))
    load = written(load.where("sets > 1"), "jaccard")
    return written(own.join(small(load), "cluster").select("doc_id", "entity", "n_shingles", "sketch", "cluster", "leader", "blocks"), "jaccard")


def classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The description of all rows of docs (doc_id, text), and (entity, class) of entities that link."""
    common = common_elements(docs, n)
    own = written(described(docs, n, common), "shingles")
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    clusters = components(candidate_links(docs, n, percent, total, common))
    let_go(own.sparkSession)
    first = own.where("entity is not null").groupBy("entity").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    members = described_clusters(first, clusters, "sketch")
    large = members.where("blocks > 1")
    if large.limit(1).count():  # sets meet there by passages rather than as copies
        tight = components(prefix_links(docs, large, n, percent))
        again = described_clusters(large.select("doc_id", "entity", "n_shingles", "sketch"), tight, "entity")
        members = written(members.where("blocks = 1").unionByName(again), "jaccard")
    links = written(verified(docs, members, n, percent), "jaccard")
    found = components(links)
    large = members.where("blocks > 1")
    if large.limit(1).count():
        rooted = large.join(small(found), F.col("entity") == F.col("node"), "left").withColumn("own", F.coalesce("root", "entity"))
        open_clusters = rooted.groupBy("cluster").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("cluster")
        rest = rooted.join(small(written(open_clusters, "jaccard")), "cluster").select("doc_id", "entity", "n_shingles", "cluster", "own")
        rest = written(rest, "jaccard")
        if rest.limit(1).count():
            found = components(links.union(verified_outside(docs, rest, n, percent)))
    return own, found.select(F.col("node").alias("entity"), F.col("root").alias("class"))


def _named(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, entity, class (null if the set is empty) and the component's smallest id."""
    return tidied(lambda: _name(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), n, percent), "named")


def _name(docs: DataFrame, n: int, percent: int) -> DataFrame:
    own, found = classes(docs, n, percent)
    named = own.join(small(found), "entity", "left").select("doc_id", "n_shingles", "entity", F.coalesce("class", "entity").alias("class"))
    named = written(named, "jaccard")
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class", "least")
    return named.join(small(written(least, "jaccard")), "class", "left").select("doc_id", "n_shingles", "entity", "class", F.coalesce("least", "doc_id").alias("component_id"))


def components_of(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): the size of its set, and the smallest doc_id that links lead to."""
    return _named(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, without those linked to a smaller doc_id and without
    repeats of a doc_id with the same text, which become one row. Of a component without any doc_id one
    row stays, of the others no row of null doc_id."""
    ids = _named(docs, n, percent)
    gone = small(written(ids.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "jaccard"))
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    again = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
    bare = ids.where("doc_id is null and entity is not null")
    if not bare.limit(1).count():
        return kept
    # rows have no name here but their sets: one set of each class without an id stays, by one of its rows
    names, extra = docs.columns, max(docs.columns, key=len) + "_"  # no column's name
    one = written(bare.where("component_id is null").groupBy("class").agg(F.min("entity").alias(extra)).select(extra), "jaccard")

    def entity_of(batches):
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(names.index("text")).to_pylist()]
            found = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*names, extra])

    bounded_batches(docs.sparkSession)
    nulls = docs.where("doc_id is null").mapInArrow(trimmed(entity_of), StructType([*docs.schema.fields, StructField(extra, LongType())]))
    stay = nulls.join(small(one), extra).dropDuplicates([extra]).unionByName(nulls.where(F.col(extra).isNull()))
    return kept.where("doc_id is not null").unionByName(stay.select(*[F.col(f"`{c}`") for c in names]))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 7: three-word shingles, similarity of 0.9 or more."""
    return components_of(read(spark, sf_dir, "documents"), 3, 90)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d
), e AS (
  SELECT md5(array_to_string(list_sort(s), chr(10))) AS e, min(doc_id) AS least, any_value(s) AS s, any_value(len(s)) AS n FROM l WHERE len(s) > 0 GROUP BY 1
), x AS (SELECT least, n, unnest(s) AS s FROM e),
p AS (
  SELECT a.least AS a, b.least AS b FROM x a JOIN x b ON a.s = b.s AND a.least <> b.least
  GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT least AS node, least AS to_node FROM e UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.to_node
), c AS (SELECT node, min(to_node) AS component FROM r GROUP BY 1)
SELECT l.doc_id, CAST(len(l.s) AS BIGINT) AS n_shingles, CAST(coalesce(c.component, l.doc_id) AS BIGINT) AS component_id
FROM l LEFT JOIN e ON len(l.s) > 0 AND e.e = md5(array_to_string(list_sort(l.s), chr(10))) LEFT JOIN c ON c.node = e.least
"""
