"""Hierarchical multi-length packing of token sequences.

A document's ids fill whole windows of the largest size first; what is left is routed to the smallest
tier (a power of two) that holds it. Each tier is packed on its own: its pieces open windows of the
tier's size, the gap behind a piece is filled from shorter tiers, largest fitting piece first, and
closed by cutting a shorter piece. At the end of a partition the few pieces that fill no window are cut
into runs whose lengths are powers of two, so nothing is padded. Sequences are dealt to step groups, the
longest first and each to the group with the fewest tokens, so that groups made together hold the same
number of tokens (to a window) and the same mix of sizes.

Packing runs where the rows are: no shuffle, and memory is bounded by one flush (FLUSH tokens) and one
document. A task that is run again makes its sequences anew, under ids of its own partition.

Defined results: a null or empty text has only the closing id; repeated rows are packed each on its
own; a null doc_id stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import bounded_batches, read, trimmed

TOKENIZER = "word_bpe_49k.json"
CLOSING_ID = 1
WINDOW = 2048
LEAST_TIER = 256
FLUSH = 1 << 19
STEP_TOKENS = 1 << 17
STEPS_AT_ONCE = 8
CACHED_WORDS = 600_000

#: Text without these characters, as it is and in lower case: NFC changes nothing there, lower() is the library's, and
#: SPLIT knows all letters.
UNUSUAL = re.compile("[^\x00-\x7e\xa1-įı-ɏ–—‘’“”…]")
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: Fixed value: how the vocabulary file splits a lower-case text, its classes spelt out for those characters.
SPLIT = re.compile("[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|'(?:[stmd]|re|ve|ll)|[^ \t\n\ra-zªµºß-öø-ɏ0-9²³¹¼-¾]+")


class WordTokenizer:
    """The ids that the vocabulary file gives, by words: words never share a token, so the ids of a
    text are those of its words, which are kept in a bounded dictionary."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.library = Tokenizer.from_file(path)
        #: strings that are one token wherever they stand in a text; the library finds them
        self.added = sorted({t.content.lower() for t in self.library.get_added_tokens_decoder().values()})
        # Words come in lower case and split, so that the same merges do without the regular expressions.
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)
        for token, i in self.library.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends, self.words = ends, {}

    def _learn(self, new: list[str]) -> None:
        """Every word ends with a token that is marked as a word's end."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, at = ids.tobytes(), 0
        for w, end in zip(new, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
            self.words[w] = raw[at:end]
            at = end

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its ids and the closing one, unsigned 32-bit."""
        known = self.words
        found: list = []  # bytes, or the text's words
        for text in texts:
            low = text.lower()
            odd = not text.isascii() and (UNUSUAL.search(text) or UNUSUAL.search(low)) or CONTROL.search(text) or any(t in low for t in self.added)
            found.append(self._whole(text) if odd else SPLIT.findall(low))
        new: set[str] = set()
        for words in found:
            if isinstance(words, list):
                new.update(set(words).difference(known))
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = {w for words in found if isinstance(words, list) for w in words}
        listed = list(new)
        for k in range(0, len(listed), 20_000):
            self._learn(listed[k : k + 20_000])
        closing = CLOSING_ID.to_bytes(4, "little")
        get = known.__getitem__
        return [np.frombuffer((x if isinstance(x, bytes) else b"".join(map(get, x))) + closing, dtype="<u4") for x in found]


_TOKENIZERS: dict[str | None, WordTokenizer] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """One a worker process, with its words."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Packs the documents of one partition. emit(pieces of one sequence) is called as windows fill;
    a piece is (document, start, length) and the document whatever the caller passes."""

    def __init__(self, emit: Callable[[list], None], window: int = WINDOW, least: int = LEAST_TIER, flush: int = FLUSH):
        if window < least or window & (window - 1) or least & (least - 1) or least < 1:
            raise ValueError("window and least tier must be powers of two, the window not the smaller")
        self.emit, self.window, self.flush = emit, window, flush
        self.tiers = []
        while window >= least:
            self.tiers.append(window)
            window //= 2
        #: by tier, pieces as (length, number, document, start), in order of length
        self.open: list[list] = [[] for _ in self.tiers]
        self.held = self.number = 0

    def add(self, doc, n: int) -> None:
        at = 0
        while n - at >= self.window:
            self.emit([(doc, at, self.window)])
            at += self.window
        if n > at:
            self._route(doc, at, n - at)
            self.held += n - at
        if self.held >= self.flush:
            self._pack(False)

    def _route(self, doc, start: int, n: int) -> None:
        tier = next(i for i in reversed(range(len(self.tiers))) if n <= self.tiers[i])
        self.number += 1
        bisect.insort(self.open[tier], (n, self.number, doc, start))

    def _take(self, tier: int, gap: int):
        """Out of this tier and shorter ones the longest piece that fits the gap."""
        for t in range(tier, len(self.tiers)):
            k = bisect.bisect_right(self.open[t], (gap + 1,)) - 1
            if k >= 0:
                return self.open[t].pop(k)
        return None

    def _pack(self, last: bool) -> None:
        for t, size in enumerate(self.tiers):
            while sum_at_least(self.open[t:], size):
                if not self.open[t]:
                    break
                n, _, doc, start = self.open[t].pop()
                pieces, gap = [(doc, start, n)], size - n
                while gap:
                    got = self._take(t, gap)
                    if got is None:  # all that is left is longer than the gap: the shortest such piece is cut
                        n, _, doc, start = next(x for x in reversed(self.open[t:]) if x).pop(0)
                        pieces.append((doc, start, gap))
                        self._route(doc, start + gap, n - gap)
                        gap = 0
                    else:
                        n, _, doc, start = got
                        pieces.append((doc, start, n))
                        gap -= n
                self.emit(pieces)
        if last:
            self._close()
        self.held = sum(x[0] for tier in self.open for x in tier)

    def _close(self) -> None:
        """What fills no window of its tier: runs whose lengths are powers of two, longest first."""
        rest = [(doc, start, n) for tier in self.open for n, _, doc, start in reversed(tier)]
        self.open = [[] for _ in self.tiers]
        total = sum(x[2] for x in rest)
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            total -= size
            pieces = []
            while size:
                doc, start, n = rest.pop(0)
                take = min(n, size)
                pieces.append((doc, start, take))
                size -= take
                if take < n:
                    rest.insert(0, (doc, start + take, n - take))
            self.emit(pieces)

    def finish(self) -> None:
        self._pack(True)


def balanced(sizes: list[int], step: int) -> list[int]:
    """The group of each sequence, from 0: as few groups as hold step tokens each, the longest sequences
    first, each to the group with the fewest tokens. No group gets more than step: lengths are powers of two
    that divide it, so a group that isn't full has room for a sequence no longer than those before."""
    groups = [(0, g) for g in range(-(-sum(sizes) // step))]
    found = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        filled, g = heapq.heappop(groups)
        found[i] = g
        heapq.heappush(groups, (filled + sizes[i], g))
    return found


def sum_at_least(tiers: list[list], size: int) -> bool:
    total = 0
    for tier in tiers:
        for x in reversed(tier):
            total += x[0]
            if total >= size:
                return True
    return False


PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


def pack(docs: DataFrame, window: int = WINDOW, least_tier: int = LEAST_TIER, step_tokens: int = STEP_TOKENS, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece of docs (doc_id, text): where it lies. with_ids adds the ids themselves.

    step_group numbers groups of sequences of at most step_tokens tokens, a multiple of the window. Groups
    are made STEPS_AT_ONCE at a time, and those made together hold the same tokens to a window; tokens of
    one group can be one training step.
    """
    if step_tokens < window or step_tokens % window:
        raise ValueError("step_tokens must be a multiple of the window")
    bounded_batches(docs.sparkSession)
    schema = PIECES_SCHEMA + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = tokenizer(path), {k: [] for k in names}
        base = TaskContext.get().partitionId() << 40
        state = {"sequence": base, "group": base, "tokens": 0}
        pending: list[list] = []

        def emit(pieces: list) -> None:
            pending.append(pieces)
            state["tokens"] += sum(p[2] for p in pieces)

        def grouped(last: bool) -> None:
            """Rows of the pending sequences, whole groups of them at a time."""
            most = STEPS_AT_ONCE * step_tokens
            while pending and (last or state["tokens"] >= most):
                sizes, total = [], 0
                for pieces in pending:
                    size = sum(p[2] for p in pieces)
                    if total + size > most:
                        break
                    sizes.append(size)
                    total += size
                of = balanced(sizes, step_tokens)
                for pieces, size, g in zip(pending, sizes, of, strict=False):
                    at = 0
                    for (doc_id, ids), start, n in pieces:
                        part = ids[start : start + n]
                        row = (doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), state["sequence"], at, size, state["group"] + g)
                        for k, v in zip(names, row, strict=False):
                            out[k].append(v)
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                        at += n
                    state["sequence"] += 1
                state["group"] += max(of) + 1
                state["tokens"] -= total
                del pending[: len(sizes)]

        def drained() -> Iterator[pa.RecordBatch]:
            if out["doc_id"]:
                kinds = [pa.int64()] * 9 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds, strict=True)], names=names)
                for v in out.values():
                    v.clear()

        packer = Packer(emit, window, least_tier)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
                packer.add((doc_id, ids), len(ids))
            grouped(False)
            yield from drained()
        packer.finish()
        grouped(True)
        yield from drained()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(trimmed(run), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 6: every whole text of documents, sequences of at most 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
