"""PPM scoring, lexical search and the conversation trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import convtrie, lexical, ppm

# --- PPM ---


class PlainTrie:
    def __init__(self, order, texts):
        self.order, self.after = order, defaultdict(Counter)
        for t in texts:
            marks = [0] * order + [b + 1 for b in t] + [0]
            for i in range(order, len(marks)):
                for k in range(order + 1):
                    self.after[tuple(marks[i - k : i])][marks[i]] += 1

    def p(self, context, symbol):
        gone, p = set(), 1.0
        for k in range(self.order, -1, -1):
            seen = self.after.get(tuple(context[len(context) - k :]), Counter())
            left = {s: n for s, n in seen.items() if s not in gone}
            if left:
                room = sum(left.values()) + len(left)
                if symbol in left:
                    return p * left[symbol] / room
                p *= len(left) / room
            gone |= set(seen)
        return p / (257 - len(gone)) if symbol not in gone else 0.0

    def log(self, text):
        marks = [0] * self.order + [b + 1 for b in text] + [0]
        return sum(math.log10(self.p(marks[i - self.order : i], marks[i])) for i in range(self.order, len(marks)))


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain_scores(rows, order):
    low = [(d, (t or "").encode().lower()) for d, t in rows]
    train = [t for d, t in low if not held(d)]
    trie, counts = PlainTrie(order, train), Counter()
    for t in train:
        counts.update([*re.findall(rb"[^\x20\x09-\x0d]+", t), b""])
    total = sum(counts.values())
    out = []
    for d, t in low:
        tokens = [*re.findall(rb"[^\x20\x09-\x0d]+", t), b""]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in tokens)
        out.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(trie.log(t), 6)))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))).replace("ab ", "AB\n")) for i in range(n)]
    return [*rows, rows[3], (None, "abc abc"), (500, None), (501, ""), (502, " \n"), (503, "\0\x01zzz 世界"), (504, "a" * 3000)]


@pytest.mark.parametrize("order, chunk", [(2, 1 << 20), (4, 2000)])
def test_scores(spark, order, chunk, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE_BYTES", 700)  # texts in pieces, in this process
    rows = texts(1, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'x' as word", "2 as n")
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ppm.score(docs, order, chunk).collect()], key=str)
    assert got == plain_scores(rows, order)


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    learnt = [bytes(rng.choices(b"abc", k=30)) for _ in range(20)]
    trie = PlainTrie(4, learnt)
    for context in ([0, 0, 0, 0], [98, 99, 100, 98], [99, 99, 255, 98], [255, 255, 255, 255]):
        assert abs(sum(trie.p(context, s) for s in range(257)) - 1) < 1e-9


def test_grams_in_pieces(monkeypatch):
    monkeypatch.setattr(ppm, "PIECE_BYTES", 7)
    long = bytes(random.Random(3).choices(range(256), k=100))
    seen = Counter()
    for parts in ppm.pieces([long, b"", b"ab"], 4):
        keys, place, _ = ppm.grams(parts, 4)
        seen.update(keys[place].tolist())
    want = Counter()
    for t in (long, b"", b"ab"):
        marks = [0] * 4 + [b + 1 for b in t] + [0]
        for i in range(4, len(marks)):
            want[sum(m << 9 * (4 - j) for j, m in enumerate(marks[i - 4 : i + 1]))] += 1
    assert seen == want


def test_dense_and_sorted_codes_agree(monkeypatch):
    codes = np.array(random.Random(4).choices(range(1000), k=300))
    one = ppm.dense(codes, 1000)
    monkeypatch.setattr(ppm, "DENSE", 10)
    assert all((a == b).all() for a, b in zip(one, ppm.dense(codes, 1000), strict=True))


def test_nothing_to_learn_from(spark):
    rows = [(i, "ab") for i in range(200) if held(i)]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.train_tokens == 0 and r.base_score == 0 and abs(r.score - 3 * math.log10(1 / 257)) < 1e-9 for r in got)
    assert ppm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- lexical search ---


def plain_search(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held_terms = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n, total = len(held_terms), sum(x[2] for x in held_terms)
    df = Counter(w for _, c, _ in held_terms for w in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(words(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, k in held_terms:
            m = 25 + 75 * k * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, q in terms.items() if c[w])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


def test_mined_sets_give_the_same_sums():
    rng = random.Random(5)
    items = [Counter(rng.choices(range(40), [1 / (k + 1) for k in range(40)], k=25)) for _ in range(50)] + [Counter({3: 2}), Counter()]
    items = [x for x in items if x]
    leaves, sums, made = lexical.mine(items)
    plan = lexical.Plan(list(range(len(items))), [b"%d" % i for i in range(40)], leaves, sums, made)
    weighed = np.array([[rng.randint(0, 1000) for _ in range(7)] for _ in range(40)])
    assert (plan.scores(weighed) == np.array([sum(q * weighed[t] for t, q in x.items()) for x in items])).all()
    assert len(made) + sum(map(len, sums)) < 0.8 * sum(sum(x.values()) for x in items)  # fewer additions than without sharing
    assert max(np.bincount([s for x in sums for s in x] + [s for p in made for s in p])) >= 2


@pytest.mark.parametrize("entries", [1 << 15, 40])
def test_search(spark, entries, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ENTRIES", entries)  # several blocks of items
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(80)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k)).replace("a ", "A, ")
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += [docs[4], docs[5], (None, docs[6][1]), (200, docs[6][1]), (201, None), (202, ""), (203, "..."), (204, "abc" * 2000 + " a1_b2"), (205, "zz " * 5000)]
    items = [(i, text(rng.randint(1, 20))) for i in range(20)] + [(3, "zz zz b2"), (50, None), (51, "!!"), (52, "notthere"), (None, "zz a1")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as n", "8 as item_id"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term"))
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=str) == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0 and lexical.search(docs, some).count() == 0
    assert lexical.search(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0


# --- conversations ---


def plain_trie(rows):
    told, out = defaultdict(list), []
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()), (role, text)))
    told = {c: [t for _, t in sorted(x)] for c, x in told.items()}
    new = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = told.get(c - c % 5, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, x in new.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(new[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    first = [("system", "You are."), ("user", "Hé"), ("user", "")]
    rows = []
    for c in range(0, 150):
        n = rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 30])
        for t in range(n):
            role, text = rng.choice(first) if rng.random() < 0.9 else ("user", f"{rng.randint(0, 5)}")
            rows.append((c, t, role, text))
    rows += [(301, 0, "user", "x"), (302, 0, "user", "x"), (400, None, None, None), (400, 1, "user", None), (401, 5, "a", "b"), (401, 5, "a", "b"), (401, 5, "a", "a"), (None, 0, "user", "x"), (3, 4, "user", "long " * 4000)]
    rows += [(601, t, "user", f"{t % 3}") for t in range(9000, 0, -1)] + [(602, t, "user", f"{t % 3}") for t in range(9001)]
    rng.shuffle(rows)
    return rows


def test_trie(spark):
    rows = conversations(7)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as block", "2 as depth", "3 as pos")
    short = [r for r in rows if r[0] not in (601, 602)]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted([tuple(r[c] for c in names) for r in convtrie.trie(table.where("conv_id is null or conv_id < 600")).collect()], key=str)
    assert got == plain_trie(short)
    deep = convtrie.trie(table.where("conv_id >= 600")).where("depth > 8990").orderBy("depth", "conv_id").collect()
    assert deep[0].depth == 8991 and {r.n_convs for r in deep} <= {1, 2} and deep[-1].n_leaves == 1  # 1,126 blocks, without a loop


def test_hot_parents_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "SHARE", 2)
    rows = [(c, t, "user", "same" if t == 0 else f"{c}-{t}") for c in range(0, 200, 5) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted([tuple(r[c] for c in names) for r in convtrie.trie(table).collect()], key=str) == plain_trie(rows)
    assert convtrie.trie(table.where("false")).count() == 0
