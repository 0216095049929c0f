"""Operators that SQL cannot express, against plain versions on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_pairs_ops import plain_components
from tidemark.llm import html, jaccard, language, mixing, packing, secrets, urls

FULL = 2**64 - 1


# --- language identification ---


def plain_grams(text):
    x = [ord(c) for c in re.sub(r"[\W\d_]+", " ", text.lower())]
    out = []
    one = [c * 0x9E3779B97F4A7C15 & FULL for c in x]
    two = [((a ^ a >> 29) * 0xBF58476D1CE4E5B9 + c * 0x94D049BB133111EB) & FULL for a, c in zip(one, x[1:], strict=False)]
    three = [((a ^ a >> 31) * 0x9E3779B97F4A7C15 + c * 0xD6E8FEB86659FD93) & FULL for a, c in zip(two, x[2:], strict=False)]
    for part in (one, two, three):
        out += [v >> 49 for v in part]
    return Counter(out)


def plain_softmax(z):
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_language_against_plain_ftrl(spark):
    """Frequencies, weights, temperature and predictions against loops over dictionaries."""
    rng = random.Random(3)
    words = {"en": "the and of that was with house".split(), "de": "der und nicht eine mit haus für".split(), "fr": "le les une dans avec maison être".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 8))), lang) for i, lang in enumerate(list(words) * 15)]
    rows += [(100, "mixed the der le", None), (None, "and of the", "en"), (101, "12 34", "de"), (102, None, "fr"), (103, "", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit(df)
    learnt = [r for r in rows if r[0] is not None and r[2] is not None and any(c.isalpha() for c in r[1] or "")]
    df_of = Counter(f for _, t, _ in learnt for f in plain_grams(t))
    idf = {f: math.log((1 + len(learnt)) / (1 + n)) + 1 for f, n in df_of.items()}
    order = {r.doc_id: (r.k, r.lang, np.array(sorted(plain_grams(r.text or "")), "<i4").tobytes()) for r in df.where("doc_id is not null and lang is not null").withColumn("k", F.xxhash64(F.col("doc_id"), F.lit(17))).collect()}
    labels, vectors = sorted(words), []
    for _, text, lang in sorted(learnt, key=lambda r: order[r[0]]):
        x = {f: n * idf[f] for f, n in plain_grams(text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        vectors.append((labels.index(lang), {f: v / size for f, v in x.items()} | {-1: 1.0}))
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-3, 1e-3
    z, s = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3)

    def weight(f, k):
        v = z[f][k]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(s[f][k])) / alpha + l2)

    for _ in range(3):
        for y, x in [v for i, v in enumerate(vectors) if i % 5]:
            w = {f: [weight(f, k) for k in range(3)] for f in x}
            p = plain_softmax([sum(x[f] * w[f][k] for f in x) for k in range(3)])
            for f, v in x.items():
                for k in range(3):
                    g = (p[k] - (k == y)) * v
                    z[f][k] += g - (math.sqrt(s[f][k] + g * g) - math.sqrt(s[f][k])) / alpha * w[f][k]
                    s[f][k] += g * g
    assert model.labels == tuple(labels)
    for f in df_of:
        assert model.idf[f] == pytest.approx(idf[f]) and model.weights[f] == pytest.approx([weight(f, k) for k in range(3)], abs=1e-9)
    assert np.count_nonzero(model.weights.any(1)) <= len(df_of)
    held = [(y, [sum(v * weight(f, k) for f, v in x.items()) for k in range(3)]) for i, (y, x) in enumerate(vectors) if not i % 5]
    loss = lambda t: -sum(math.log(plain_softmax([v / t for v in logits])[y] + 1e-12) for y, logits in held)
    grid = [0.05 * 1.05**i for i in range(123)]
    assert loss(model.temperature) <= min(map(loss, grid)) + 1e-6 * len(held)
    for r in language.predict(df, model).join(df.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        x = {f: n * idf.get(f, math.log(1 + len(learnt)) + 1) for f, n in plain_grams(r.t or "").items()}
        if not any(c.isalpha() for c in r.t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        size = math.sqrt(sum(v * v for v in x.values()))
        p = plain_softmax([(sum(v / size * weight(f, k) for f, v in x.items() if f in df_of) + weight(-1, k)) / model.temperature for k in range(3)])
        assert r.lang_pred == labels[p.index(max(p))] and r.score == pytest.approx(max(p), abs=1e-9)


# --- URL templates ---


def plain_templates(rows):
    """{tokens: template} of one host's rows (tokens, n, labelled, bad), recursively."""
    found = {}

    def go(own, prefix):
        level = len(prefix)
        at = []
        for r in own:
            if len(r[0]) == level:
                found[r[0]] = prefix
            else:
                at.append(r)
        if not at:
            return
        labelled, bad = sum(r[2] for r in at), sum(r[3] for r in at)
        children = defaultdict(list)
        for r in at:
            children[r[0][level]].append(r)
        if min(labelled - bad, bad) == 0 or max(labelled - bad, bad) + 0.5 <= 2 + math.log(2):
            for r in at:
                tail = tuple(t if {q[0][i] for q in at if len(q[0]) > i} == {t} else "*" for i, t in enumerate(r[0]) if i >= level)
                found[r[0]] = prefix + tail
            return
        share, groups = (bad + 0.5) / (labelled + 1), defaultdict(list)
        for token, part in children.items():
            lab, b = (sum(r[k] for r in part) for k in (2, 3))
            ratio = sum(k * math.log(k / (lab * p)) for k, p in ((b, share), (lab - b, 1 - share)) if k)
            merged = len(children) > 1 and ratio < 2 + math.log(len(children))
            groups["*" if merged else token] += part
        for name, part in groups.items():
            go(part, (*prefix, name))

    go(rows, ())
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_url_tree_against_plain(spark, seed):
    rng = random.Random(seed)
    pages, labels = [], {}
    for i in range(900):
        host = rng.choice(["a.net", "b.net", "c.net"])
        parts = [rng.choice(["news", "shop", "tag", "u"]), rng.choice(["x", "y", "z", "long", f"v{rng.choice('abcdefghij')}"])]
        parts += [rng.choice("pqrs")] * rng.randint(0, 3)
        pages.append((i, f"http://{host}/{'/'.join(parts)}/{i}"))
        if rng.random() < 0.7:
            labels[i] = int(rng.random() < (0.9 if parts[0] == "shop" and parts[1] in "xy" or parts[-1] == "q" else 0.1))
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string").repartition(3), spark.createDataFrame([(i, 1 - b, 0) for i, b in labels.items()], "doc_id long, quality int, toxic int"), rules=()).collect()}
    by_host, tokens_of = defaultdict(Counter), {}
    for i, url in pages:
        host, *parts = re.sub("[0-9]+", "#", url[7:]).split("/")
        tokens_of[i] = host, tuple(parts)
        by_host[host][tuple(parts), "n"] += 1
        if i in labels:
            by_host[host][tuple(parts), "labelled"] += 1
            by_host[host][tuple(parts), "bad"] += labels[i]
    everything = (sum(labels.values()) + 0.5) / (len(labels) + 1)
    seen = set()
    for host, counts in by_host.items():
        rows = [(t, counts[t, "n"], counts[t, "labelled"], counts[t, "bad"]) for t in {t for t, _ in counts}]
        templates = plain_templates(rows)
        own = (sum(r[3] for r in rows) + 8 * everything) / (sum(r[2] for r in rows) + 8)
        sums = defaultdict(lambda: [0, 0])
        for t, _, lab, bad in rows:
            sums[templates[t]][0] += lab
            sums[templates[t]][1] += bad
        for i, (h, t) in tokens_of.items():
            if h == host:
                lab, bad = sums[templates[t]]
                share = (bad + 8 * own) / (lab + 8)
                assert got[i].template == "/" + "/".join(templates[t])
                assert got[i].bad_share == pytest.approx(share) and got[i].verdict == ("block" if share >= 0.5 else "allow")
                seen.add(got[i].verdict)
    assert seen == {"block", "allow"}


def test_url_verdicts_on_held_out_labels(spark):
    """Templates learnt from two thirds of the labels tell the rest apart; where labels don't hang on the
    path, nothing is blocked."""
    rng = random.Random(9)
    pages = [(i, f"http://{rng.choice(['m.net', 'n.net'])}/{rng.choice(['casino', 'blog', 'wiki', 'win'])}/{i}") for i in range(3000)]
    bad = {i: int(rng.random() < (0.85 if "casino" in u or "win" in u else 0.05)) for i, u in pages}
    frame = spark.createDataFrame(pages, "page_id long, url string")
    label = lambda pick: spark.createDataFrame([(i, 1 - b, 0) for i, b in pick.items()], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(frame, label({i: b for i, b in bad.items() if i % 3}), rules=()).collect()}
    held = [i for i in bad if i % 3 == 0]
    assert sum((got[i] == "block") == bad[i] for i in held) / len(held) > 0.85
    assert sum(got[i] == "block" for i in held if not bad[i]) / sum(1 for i in held if not bad[i]) < 0.2
    even = {i: int(rng.random() < 0.2) for i in bad}
    assert {r.verdict for r in urls.judge(frame, label(even), rules=()).collect()} == {"allow"}


# --- leaf blocks of pages ---


class Leaves(HTMLParser):
    """Runs of text between block-level tags, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.now, self.hidden = [], "", 0

    def end(self):
        if self.now.split():
            self.found.append(" ".join(self.now.split()))
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in html.INLINE:
            self.end()
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.end()
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.now += data


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        k = rng.random()
        text = rng.choice(["plain words", "a &amp; b", "&eacute;t&#233; ", "x &lt; y", "tabs\t and\n lines ", "", "5 > 3"])
        if k < 0.3 or depth > 4:
            out.append(text)
        elif k < 0.5:
            tag = rng.choice(["b", "em", "span", "a", "code", "sup"])
            out.append(f"{text}<{tag} class='q' title=\"a > b\">{rng.choice(['in', 'side '])}</{tag}>")
        elif k < 0.55:
            out.append("<script>if (a < b) { x = '</p>' }</script><style>p > b {}</style><!-- <p>no</p> -->")
        else:
            tag = rng.choice(["div", "section", "ul", "article", "nav", "blockquote", "h2", "table", "footer"])
            out.append(f"<{tag} id=i{depth}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_blocks_against_another_parser():
    rng = random.Random(12)
    for _ in range(300):
        page = f"<html><body>{random_page(rng)}</body></html>"
        plain = Leaves()
        plain.feed(page)
        plain.close()
        plain.end()
        assert [b.text for b in html.blocks(page)] == plain.found, page


# --- secrets ---


def plain_ratio(model, s):
    total, a, b = 0.0, 0, 0
    for c in s:
        k = secrets.ALPHABET.index(c) + 1
        total, a, b = total + float(model.ratio[a, b, k]), b, k
    return total / len(s)


def plain_secrets(model, s):
    """The spans of a string without base spans, each as a set of places."""
    if m := re.search("(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])", s):
        return plain_secrets(model, s[: m.start()]) | {(x + m.end(), y + m.end()) for x, y in plain_secrets(model, s[m.end() :])}
    if len(s) < 8:
        return set()

    def good(t):
        total = plain_ratio(model, t) * len(t)
        word = t.isalpha() and (t[1:].islower() or t[1:].isupper())
        return total / len(t) > model.threshold and total > (30 if word else 16)

    if good(s):
        return {(0, len(s))}
    found = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", s) if 8 <= m.end() - m.start() < len(s) and good(m[0])]
    ratios, a, b = [], 0, 0
    for c in s:
        k = secrets.ALPHABET.index(c) + 1
        ratios.append(float(model.ratio[a, b, k]))
        a, b = b, k
    for i in range(len(s) - 19):
        if sum(ratios[i : i + 20]) / 20 > model.inner:
            start, end = i + (s[i] in "+/_=-"), i + 20
            while start > 0 and s[start - 1] not in "+/_=-":
                start -= 1
            while end < len(s) and s[end] not in "+/_=-":
                end += 1
            found.append((start, end))
    places = {p for x, y in found for p in range(x, y)}
    return {(x, y) for x, y in ((p, next(q for q in range(p, len(s) + 1) if q not in places)) for p in places if p - 1 not in places)}


def test_markov_spans_against_plain():
    model = secrets.train()
    rng = random.Random(21)
    samples = [s for s, _ in secrets.labelled_samples(60, seed=5)]
    seen = Counter()
    for _ in range(400):
        s = rng.choice(["/", "-", "_", "="]).join(rng.choice(samples) for _ in range(rng.randint(1, 3)))
        want = plain_secrets(model, s)
        assert {p for x, y in model.secrets_in(s) for p in range(x, y)} == {p for x, y in want for p in range(x, y)}, s
        if not secrets.base_spans(s):  # around other text the spans are the same ones, moved
            text = f"see {s} and more."
            assert {p for x, k, y in secrets.all_spans(text, model)[1] for p in range(x - 4, y - 4)} == {p for x, y in want for p in range(x, y)}
        seen[bool(want)] += 1
    assert min(seen.values()) > 20


def test_short_secrets_and_ordinary_names():
    """Random strings from 16 characters on are found in each alphabet that mixes letters with others or cases; of
    identifiers that the models haven't seen hardly any, and no prose."""
    model, rng = secrets.train(), random.Random(99)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    found = lambda texts: sum(any(k == 3 for _, k, _ in secrets.all_spans(f"x: {t} .", model)[1]) for t in texts) / len(texts)
    for alphabet in (upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", lower + digits, upper + digits, digits + "abcdef", digits + "ABCDEF", upper + lower):
        for n, least in ((16, 0.9), (24, 0.98)):
            texts = ["".join(rng.choices(alphabet, k=n)) for _ in range(400)]
            assert found([t for t in texts if not secrets.base_spans(t)] or texts[:1]) >= (least if n < 24 or alphabet != digits + "abcdef" else 0), (alphabet, n)
    assert found([s for s, y in secrets.labelled_samples(3000, seed=123) if not y]) < 0.005
    names = ["6feeeedf-f7bb-36b0-4466-9d5406204f68", "x86_64-pc-linux-gnu-unknown-toolchain", lower, upper, upper + lower + digits, "2024-01-31/12-30-59", "0049-171-5550123", "internationalization", "Donaudampfschifffahrtsgesellschaft", "dhthe erontihethan rheeyd"]
    assert found(names) == 0
    assert [k for _, k, _ in secrets.all_spans("6feeeedf-f7bb-36b0-4466-9d5406204f68-Zk3Qp9vX2mB7tL4w", model)[1]] == [3]


# --- the pipeline ---


def plain_copies(docs):
    n = Counter(d["source"] for d in docs)
    whole = sum(math.sqrt(v) for v in n.values())
    out = []
    for d in docs:
        rate = len(docs) * (math.sqrt(n[d["source"]]) / whole) / n[d["source"]]
        draws, copies = max(1, math.ceil(rate / 16)), 0
        for j in range(1, draws + 1):
            u = (int(md5(f"{mixing.SEED}|{d['doc_id']}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = cdf = math.exp(-rate / draws)
            for k in range(81):
                if cdf > u:
                    break
                copies += 1
                p *= rate / draws / (k + 1)
                cdf += p
        out += [d] * copies
    return out


def test_pipeline_against_plain(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    import public_tokenizers

    rng = random.Random(31)
    words = {"en": "the and of that was with from they which house over under never again".split(), "de": "der die und nicht eine mit für auf haus werden über unter wieder".split()}
    docs = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        docs.append({"doc_id": i, "text": " ".join(rng.choices(words[lang], k=rng.randint(30, 80))), "lang": lang if i % 4 else None, "source": rng.choice(["web", "web", "web", "book"]), "n_chars": 1, "extra": f"e{i}"})
    for i in range(150, 200):
        near = docs[rng.randrange(150)]["text"].split()
        if i % 2:
            near[rng.randrange(len(near))] = "changed"
        docs.append({"doc_id": i, "text": " ".join(near) + (" token = 'abcDEF123456'" if i % 5 == 0 else ""), "lang": "en", "source": "web", "n_chars": 1, "extra": "x"})
    docs += [{"doc_id": 300 + i, "text": t, "lang": None, "source": None, "n_chars": None, "extra": None} for i, t in enumerate([None, "", "123 456", "?!"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([tuple(d.values()) for d in docs], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = language.fit(spark.createDataFrame([tuple(d.values()) for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1], schema))
    kept = [d for d in docs if (p := model.predict(d["text"])) and p[0] != "und" and p[1] >= 0.3]
    one = {c for _, _, c in plain_components([(d["doc_id"], d["text"]) for d in kept], 5, 80)}
    kept = [d for d in kept if d["doc_id"] in one]
    markov = secrets.train()
    for d in kept:
        spans, text, end = secrets.all_spans(d["text"], markov)[1], "", 0
        for a, _, b in spans:
            if a >= end:
                text += d["text"][end:a] + "[SECRET]"
            end = max(end, b)
        d["text"] = text + d["text"][end:]
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    ids = {}
    for d in plain_copies(kept):
        ids[d["doc_id"]] = [*library.encode(d["text"], add_special_tokens=False).ids, 1]
        want[d["doc_id"]] += len(ids[d["doc_id"]])
    filled = Counter()
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        filled[r.doc_id] += r.length
    assert filled == want and len(want) < len(docs) and any("[SECRET]" in d["text"] for d in kept)
    assert jaccard.components_of(spark.createDataFrame([(d["doc_id"], d["text"]) for d in kept], "doc_id long, text string")).where("component_id <> doc_id").count() <= len(kept)


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own ones pass through all stages."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["_gone", "_row", "_of", "_copy", "_order", "_source", "entity", "cluster", "sketch", "class", "node", "root", "chunk", "k", "copies", "score"]
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the and of that was with from they"), F.col("id"), F.lit("house")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), *[F.concat(F.lit(c), F.col("id")).alias(c) for c in names])
    docs = rows.unionByName(rows.withColumn("lang", F.lit("de")).withColumn("doc_id", F.col("doc_id") + 100).withColumn("text", F.concat(F.lit("der die und nicht eine "), F.col("doc_id"))))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == rows.columns
        assert docs.where(" or ".join(f"`{c}` is null or `{c}` not like '{c}%'" for c in names)).count() == 0
    assert docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
