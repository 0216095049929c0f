"""Suffix dedup, Jaccard join and top-k search against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import blobs, graph, jaccard, suffixes, topk

SCHEMA = "doc_id long, text string"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    passage = " ".join(rng.choices(words, k=25))
    docs, out = [], []
    for i in range(n):
        k = rng.random()
        if k < 0.2 and docs:
            text = rng.choice(docs)
        elif k < 0.5 and docs:
            w = rng.choice(docs).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif k < 0.65:
            text = " ".join(rng.choices(words, k=rng.randint(0, 15))) + " " + passage
        elif k < 0.75:
            text = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        else:
            text = " ".join(rng.choices(words, k=rng.randint(10, 250)))
        docs.append(text)
        out.append((i * 3 + 1, text))
    rng.shuffle(out)
    return out + [(0, None), (2, ""), (5, " \n"), (8, docs[0].upper()), (None, docs[1]), (out[0][0], out[0][1]), (11, "é" * 60 + docs[3])]


# --- suffixes ---


def plain_dedup(rows, length=50):
    first, result = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            least = first.setdefault(raw[i : i + length], doc_id) if doc_id is not None else None
            if doc_id is not None and least < doc_id:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        result.append((doc_id, len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("chunk", [2_000, 1 << 20])
def test_suffixes(spark, chunk):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("chunk"), F.lit(2).alias("_id"), F.lit(3).alias("tied")).repartition(4)
    assert sorted(map(tuple, suffixes.dedup(df, chunk_bytes=chunk).collect()), key=str) == plain_dedup(rows)


def test_suffixes_edges(spark):
    assert suffixes.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x" * 49), (2, "x" * 49), (3, "x" * 50), (4, "x" * 200), (5, "a" + "x" * 49)]
    assert sorted(map(tuple, suffixes.dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain_dedup(rows)
    short = [(1, "short"), (2, ""), (3, "short"), (4, None)]
    assert sorted(map(tuple, suffixes.dedup(spark.createDataFrame(short, SCHEMA)).collect()), key=str) == plain_dedup(short)
    kept = suffixes.dedup(spark.createDataFrame(rows, SCHEMA), with_text=True).where("doc_id = 4").first()
    assert kept.kept == b""
    with pytest.raises(ValueError):
        suffixes.dedup(spark.createDataFrame(rows, SCHEMA), length=10)
    differences = {(a - b) % suffixes.V for a in suffixes.D for b in suffixes.D}
    assert differences == set(range(suffixes.V))


def test_very_long_texts(spark, monkeypatch):
    """Texts far longer than a chunk, a batch of words or the kept powers."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=60_000))
    other = " ".join(rng.choices(words, k=50_000))
    rows = [(1, long), (2, long[:150_000] + " changed " + long[150_000:]), (3, other), (4, other[1000:3000]), (5, "short one"), (6, long[-120:] + " and more")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = plain_components(rows, 5, 80)
    assert sorted(map(tuple, jaccard.components_of(df).collect()), key=str) == want and (2, 1) in {(d, c) for d, _, c in want}
    a, b = jaccard.word_hashes(long[:50_000]), jaccard.word_hashes(long)
    monkeypatch.setattr(jaccard, "KEPT_POWERS", 1000)
    monkeypatch.setattr(jaccard, "_POWERS", [])
    assert (jaccard.word_hashes(long) == b).all() and (a[:-1] == b[: len(a) - 1]).all() and not jaccard._POWERS
    assert sorted(map(tuple, suffixes.dedup(df, chunk_bytes=40_000).collect()), key=str) == plain_dedup(rows)


def test_second_hashes():
    raw = b"some bytes that are here twice: some bytes that are here twice: " * 3
    chunk = suffixes.Chunk(raw, np.array([len(raw)]).tobytes(), np.array([1]).tobytes(), 50, 64)
    at = np.arange(len(raw) - 49)
    for width in (1, 2, 7, 8):
        checks = chunk.checks(at, 50, width)
        assert (suffixes.as_numbers(suffixes.as_bytes(checks, width), width) == checks).all()
        assert checks[0] == checks[32] and len(set(checks.tolist())) > 20
    assert [suffixes.check_width(n) for n in (1, 1 << 20, 1 << 29, 1 << 47)] == [1, 1, 2, 7]


def test_suffixes_sort_keys_themselves(monkeypatch):
    """Sorting places by their keys took most of the CPU seconds: keys are sorted, with the places in their low bits."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(20)]
    texts += [t[:300] + " changed " + t[300:] for t in texts]
    raw, ids = [t.encode() for t in texts], np.array(rng.sample(range(1000), len(texts)), "<i8")
    ends = np.cumsum([len(r) for r in raw]).astype("<i8")
    chunk = suffixes.Chunk(b"".join(raw), ends.tobytes(), ids.tobytes(), 50, 40)

    def refused(*_, **__):
        raise AssertionError("an indirect sort")

    with monkeypatch.context() as patched:
        patched.setattr(np, "argsort", refused)
        patched.setattr(np, "lexsort", refused)
        at, number, keys, twice = chunk.cover()
        assert (at[1:] > at[:-1]).all() and (keys[1:] > keys[:-1]).all()
        assert (keys[number] == chunk.hashes(at, 30) >> np.uint64(24) << np.uint64(24)).all()
        at, number, keys, checks, least = chunk.suffixes(at[twice[number]], 2)
        sent = {"chunk": 1, "keys": blobs.encode(keys), "more": suffixes.as_bytes(least, 4), "docs": chunk.named.tobytes(), "checks": suffixes.as_bytes(checks, 2)}
        other = sent | {"chunk": 2, "docs": (chunk.named - 500).tobytes()}
        answers = next(suffixes.smaller_in_bucket(0, [sent, other]))["bits"]
    assert [np.unpackbits(np.frombuffer(b, np.uint8), count=len(keys)).all() for b in answers] == [True, False]
    owners = {}
    for i, r in zip(ids.tolist(), raw, strict=True):
        for p in range(len(r) - 49):
            owners.setdefault(r[p : p + 50], set()).add(i)
    assert at.tolist() == sorted(set(at.tolist())) and (checks[number] == chunk.checks(at, 50, 2)).all()
    assert all(chunk.named[least[k]] == min(owners[chunk.raw[p : p + 50]]) for p, k in zip(at.tolist(), number.tolist(), strict=True))
    found = {chunk.raw[p : p + 50] for p in at.tolist()}
    assert {t for t, who in owners.items() if len(who) > 1} <= found


def test_suffixes_orders():
    rng = np.random.default_rng(1)
    for h in (rng.integers(0, 2**64, 1000, dtype=np.uint64), rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(2**63, 2**63 + 9, 77, dtype=np.uint64), np.full(5, 2**64 - 1, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)):
        order, out = suffixes.sorting(h)
        assert (order == np.argsort(h, kind="stable")).all() and (out == np.sort(h)).all()
        more = rng.integers(0, 3, len(h)).astype(np.uint64)
        order, first, second, differs = suffixes.two_keys(h, more)
        pairs = list(zip(h.tolist(), more.tolist(), strict=True))
        assert list(zip(first.tolist(), second.tolist(), strict=True)) == sorted(pairs) == [pairs[i] for i in order]
        new, number = suffixes.numbered(order, differs)
        assert len(new) == len(set(pairs)) and [(first[new][k], second[new][k]) for k in number] == pairs
    at = np.flatnonzero(rng.random(3000) < 0.02)
    for before, after in ((20, 1), (0, 50)):
        begin, end = suffixes.runs(at, before, after)
        assert {p for a, b in zip(begin.tolist(), end.tolist(), strict=True) for p in range(a, b)} == {p for a in at.tolist() for p in range(max(a - before, 0), a + after)}
        assert (begin[1:] > end[:-1]).all() and not len(suffixes.runs(at[:0], before, after)[0])


def test_suffixes_at_borders(spark):
    """What goes from the end of a text and from the beginning of the next is two spans; texts without an id stand between."""
    rng = random.Random(3)
    p, q, own = ("".join(rng.choices("abcdefghij é", k=n)) for n in (60, 70, 400))
    rows = [(1, p + "|" + q), (2, own[:200] + p), (3, q + own[200:]), (None, p + q), (4, ""), (6, p[:49] + "!" + q), (5, q + p + p), (3, p + own[200:])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert sorted(map(tuple, suffixes.dedup(df).collect()), key=str) == plain_dedup(rows)


def test_broadcast_by_bytes(spark):
    df = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sum"))
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in x._jdf.queryExecution().logical().toString()
    assert hinted(graph.small(df)) and not hinted(graph.small(df, 1000 * 100))
    with pytest.raises(KeyError):
        graph.small(df.select(F.array("id")))


def test_sorted_numbers_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    for v in (x, x >> np.uint64(40), x[:1], np.array([0, 0, 2**64 - 1], dtype=np.uint64)):
        assert (blobs.decode(blobs.encode(v)) == v).all()


# --- Jaccard ---


def plain_components(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, monkeypatch, n, percent):
    rows = corpus(2, 160)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("entity"), F.lit(2).alias("cluster")).repartition(4)
    want = plain_components(rows, n, percent)
    assert sorted(map(tuple, jaccard.components_of(df, n, percent).collect()), key=str) == want
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)  # clusters of many blocks
    assert sorted(map(tuple, jaccard.components_of(df, n, percent).collect()), key=str) == want


def test_jaccard_null_ids(spark):
    """Rows without an id link like others: as near copies, as bridges, and among themselves."""
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join([*w[2:], "x1", "x2"]), " ".join([*w[4:], "x1", "x2", "x3", "x4"])
    other = [f"v{i}" for i in range(40)]
    alone = [f"u{i}" for i in range(40)]
    rows = [(1, a), (None, b), (3, c), (None, " ".join(other)), (None, " ".join(other)), (None, " ".join([*other[1:], "y"])), (9, " ".join(alone)), (None, " ".join([*alone[1:], "z"])), (None, None), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_entity", F.lit("x")).repartition(3)
    assert sorted(map(tuple, jaccard.components_of(df).collect()), key=str) == plain_components(rows, 5, 80)
    found = {(r.doc_id, r.component_id) for r in jaccard.components_of(df).collect()}
    assert (3, 1) in found and (None, 1) in found  # linked through a row without an id only
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    stay = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(x for x, _ in stay if x) == [1, 9]
    assert sorted((t or "") for x, t in stay if x is None)[:2] == ["", ""] and len([1 for x, t in stay if x is None and t]) == 1


def test_jaccard_bridges_without_ids(spark):
    rng = random.Random(8)
    rows = [(None if rng.random() < 0.4 else d, t) for d, t in corpus(9, 120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, jaccard.components_of(df, 3, 80).collect()), key=str) == plain_components(rows, 3, 80)


@pytest.mark.parametrize("joined", [0, 25])
def test_links_outside_the_largest_component(spark, monkeypatch, joined):
    """One cluster of all sets, whose links are all to be found but those among the first ones."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 6)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(14, 90)) if t and t.split()]
    sets = {i: jaccard.shingles(t, 3) for i, t in rows}
    entity = {i: jaccard.fingerprint(s) for i, s in sets.items()}
    one = {e: i for i, e in sorted(entity.items(), reverse=True)}
    ids = sorted(one.values())
    own = {i: -1 if k < joined else entity[i] for k, i in enumerate(ids)}
    members = spark.createDataFrame([(i, entity[i], len(sets[i]), 7, own[i]) for i in ids], "doc_id long, entity long, n_shingles long, cluster long, own long")
    got = {tuple(sorted((r.a, r.b))) for r in jaccard.verified_outside(spark.createDataFrame(rows, SCHEMA).repartition(3), members, 3, 70).collect()}
    links = {tuple(sorted((entity[i], entity[j]))) for i in ids for j in ids if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))}
    first = {entity[i] for i in ids[:joined]}
    assert got <= links and (got or not links)
    within = [(x, next(iter(first))) for x in first]
    roots = lambda found: {x: r for x, r in graph.forest(np.array([*found, *within, (1, 1)]))[1].items() if x != r}
    assert roots(got) == roots(links)


def test_links_of_in_pieces(spark, monkeypatch):
    """Rows of a bucket are merged as they come, with the same components."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        keys = rng.integers(0, 60, 30).astype(np.uint64) << np.uint64(40)
        rows += [dict(zip(("bucket", "keys", "at", "owners"), x, strict=True)) for x in zip(*blobs.keyed(keys, rng.integers(0, 5, 30), rng.integers(0, 500, 5), 4).values(), strict=True)]
    df = spark.createDataFrame([{k: int(v) if k == "bucket" else bytes(v) for k, v in r.items()} for r in rows], blobs.KEYED)
    want = {r.node: r.root for r in graph.components(jaccard.links_of(df)).collect()}
    monkeypatch.setattr(blobs, "MERGED_ROWS", 3)
    assert {r.node: r.root for r in graph.components(jaccard.links_of(df)).collect()} == want and want


def test_signatures_meet():
    """Sets at exactly the threshold share a signature, whatever elements are common."""
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90):
        bands = jaccard.Bands(percent)
        for _ in range(150):
            size = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            differ = int(len(a) * 2 * (100 - percent) / (100 + percent) / 2)
            cut = int(rng.integers(0, differ + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[cut:]], rng.integers(0, 2**63, differ - cut).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            common = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
            for c in (common, np.zeros(0, np.uint64)):
                assert len(np.intersect1d(jaccard.signatures(a, bands, c), jaccard.signatures(b, bands, c)))


def test_jaccard_keeps_one(spark):
    rows = [(3, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, ""), (2, ""), (7, None), (9, "other words are here now")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_gone", F.lit("x"))
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 9]
    assert jaccard.components_of(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_by_rounds(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, 500 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r.node: r.root for r in graph.components(df).collect()}
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert {r.node: r.root for r in graph.components(df).collect()} == one
    assert one[40] == 0 and one[529] == 500


# --- top-k ---


def plain_topk(rows, k):
    vectors = {}
    usable = [(i, [int(np.floor(np.float64(np.float32(c)) * 64)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for i, v in usable:
        if i % 20 == 0:
            vectors[i] = min(vectors.get(i, v), v)
    out = []
    for q, v in vectors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(30)] + [(500, None), (520, [1.0, None]), (540, [float("nan")]), (560, [float("inf")]), (580, [0.5]), (600, []), (None, [1.0]), (3, rows[3][1]), (20, rows[20][1]), (40, rows[41][1]), (40, rows[42][1]), (43, rows[44][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(2).alias("v")).repartition(3)
    want = plain_topk(rows, 20)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0).collect())) == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "CANDIDATES_A_SALT", 100)
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0).collect())) == want
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]


def test_topk_huge_numbers(spark):
    x = np.array([[2.0**40, -(2.0**40)], [2.0**40, 2.0**40]])
    assert topk.scores(np.array([[2.0**21, 1.0]]), x).tolist() == [[2**61 - 2**40, 2**61 + 2**40]]
    assert topk.scores(np.array([[2.0**40, 2.0**40]]), x).tolist() == [[0, 2**63 - 1]]
    rows = [(0, [2.0**30, 1.0]), (1, [-(2.0**30), 1.0]), (2, [2.0**29, 0.5]), (20, [0.0, 0.0]), (20, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    end = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = [(q, r, i, end(s)) for q, r, i, s in plain_topk(rows, 3)]
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, 3).collect())) == sorted(want)


@pytest.mark.parametrize("spread, most", [(0.05, 0.4), (3.0, 1.0)])
def test_topk_leaves_out(spread, most):
    """Bounds leave most candidates out where vectors lie in groups, and never one that counts."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16))
    x = np.floor(64 * (centres[rng.integers(0, 20, 3000)] + spread * rng.normal(size=(3000, 16))))
    ids, q_ids = np.arange(3000), np.arange(0, 3000, 20)
    pivots = x[rng.permutation(3000)[:24]]
    far = topk.angles(x, pivots)
    order = np.argsort(far.argmin(1), kind="stable")
    q = x[q_ids]
    reach = topk.first_reach(q_ids, q, ids[:300], x[:300], 20)
    who, found_ids, found, scored = topk.best_of_block(q_ids, q, far[q_ids], topk.Cells(ids[order], x[order], far[order]), 20, reach)
    s = topk.scores(q, x)
    s[np.arange(len(q)), q_ids] = -(2**60)
    want = [sorted(zip((-s[i]).tolist(), ids.tolist(), strict=True))[:20] for i in range(len(q))]
    assert [[(-int(c), int(b)) for a, b, c in zip(who, found_ids, found, strict=True) if a == i] for i in range(len(q))] == want
    assert scored <= most * s.size


def test_a_forest_that_grows():
    rng = random.Random(12)
    links = np.array([(rng.randrange(80), rng.randrange(80)) for _ in range(70)])
    trees, kept = graph.Forest(), []
    for at in range(0, 70, 9):
        part = links[at : at + 9]
        kept.append(part[trees.add(part)])
    whole, roots = graph.forest(links)
    again = graph.forest(np.concatenate(kept))[1]
    assert len(np.concatenate(kept)) == len(whole) and {x: trees.root(x) for x in roots} == roots == again | {x: r for x, r in roots.items() if x not in again}
    assert trees.root(10**6) == 10**6 and 10**6 not in trees.parent
