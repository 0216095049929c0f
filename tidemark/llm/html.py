"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (runs of inline content between block-level tags). Features of a block
are its ancestors' tags and the kinds their class, id and role names speak of, its own tag, and its text
(length, share in links, closing punctuation). The field has two labels, main text or not; it is trained
by stochastic gradients of the conditional log-likelihood on labelled pages and decoded by Viterbi.

Defined results: null or empty html gives an empty text; rows are extracted one by one, so repeated rows
give repeated results; a tie between two labellings goes to "not main text"; null ids and urls are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import map_rows, read

OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
SPECIAL = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: their content is blocks of its own, but a paragraph around them goes on
WITHIN = frozenset("noscript template iframe object select".split())
FOREIGN = frozenset(("svg", "math"))
#: elements that end an open svg or math, as it can't hold them
PLAIN = frozenset("""address article aside b big blockquote body br button caption center cite code col colgroup dd del details dialog div
dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link
main menu meta nav noscript object ol optgroup option p pre q ruby s samp section select small span strike strong sub summary sup table
tbody td template textarea tfoot th thead tr tt u ul var""".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q s samp small span strike strong sub sup svg time tt u var wbr br".split())
#: a new element of the key closes an open one of the value
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: kinds of element, by words in class, id and role names
KINDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager skip",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer foot bottom copyright colophon legal contentinfo",
    "side": "sidebar aside rail widget complementary related recommended popular trending",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense adbox",
    "notice": "cookie cookies consent notice gdpr alert banner popup modal newsletter subscribe paywall dialog",
    "form": "form search login signup searchform contact",
    "talk": "comment comments reply replies respond disqus discussion feedback",
    "share": "share sharing social follow tags tagcloud byline meta",
    "main": "main content article post entry story body text articlebody",
}
KIND_OF: dict[str, list[str]] = {}
for _kind, _words in KINDS.items():
    for _word in _words.split():
        KIND_OF.setdefault(_word, []).append(_kind)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAMED: dict[str, tuple[str, ...]] = {}


def kinds_of(attributes: str) -> tuple[str, ...]:
    """Kinds that an element's class, id and role speak of."""
    got = _NAMED.get(attributes)
    if got is None:
        found = set()
        for m in NAMES.finditer(attributes):
            for w in WORD.findall(m[1] or m[2] or m[3] or ""):
                found.update("k:" + k for k in KIND_OF.get(w.lower(), ()))
        if HIDDEN.search(attributes):
            found.add("k:hidden")
        got = tuple(sorted(found))
        if len(_NAMED) > 10_000:
            _NAMED.clear()
        _NAMED[attributes] = got
    return got


class Tags:
    """The tags of a page in order, each part of the page looked at a bounded number of times.

    A search that finds nothing finds nothing further on either, so what doesn't follow any more is remembered: a
    comment's end, a >, either quote, and the end tag of each raw element. So are the quotes from which no end of a
    tag was found (open)."""

    def __init__(self, page: str) -> None:
        self.page, self.gone, self.open = page, {}, set()

    def find(self, what: str, at: int) -> int:
        """The next place of what from at on, -1 if there is none."""
        if self.gone.get(what, len(self.page) + 1) <= at:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def close(self, tag: str, at: int) -> re.Match | None:
        """The next end tag of a raw element."""
        if self.gone.get("/" + tag, len(self.page) + 1) <= at:
            return None
        found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if not found:
            self.gone["/" + tag] = at
        return found

    def _end(self, at: int) -> tuple[int, int]:
        """Of a tag whose name ends at at: the place of its > and the place behind it. A > in a quoted value is not
        its end, unless a quote stays open or no > follows the quotes: then the first > is."""
        seen, now = [], at
        while m := SPECIAL.search(self.page, now):
            now = m.start()
            if m[0] == ">":
                return now, now + 1
            if now in self.open:
                break
            seen.append(now)
            if (close := self.find(m[0], now + 1)) < 0:
                break
            now = close + 1
        self.open.update(seen)
        first = self.find(">", at)
        return first, first + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, / of an end tag, name, attributes) of the next tag from at on; name is empty for comments,
        declarations and instructions."""
        while at >= 0 and (m := OPEN.search(self.page, at)):
            start, at = m.span()
            if m[2]:
                close, end = self._end(at)
                if close >= 0:
                    return start, end, m[1], m[2], self.page[at:close]
            elif m[0] == "<!--":
                end = self.find("-->", at)
                return start, end + 3 if end >= 0 else len(self.page), "", "", ""
            elif (end := self.find(">", at)) >= 0:
                return start, end + 1, "", "", ""
            at = self.find("<!--", start + 1)  # no > follows, so only a comment can
        return None


@dataclass
class Block:
    text: str
    above: frozenset  # features of all elements around it
    tag: str  # the innermost block-level element
    in_links: int  # characters of text inside links


@dataclass
class _Open:
    tag: str
    above: frozenset
    block: str
    root: int = 0  # the place of the svg or math it is in
    base: int = 0  # the place of the last element up to it that isn't inline, 0 for none


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space made plain and references decoded."""
    found: list[Block] = []
    stack = [_Open("", frozenset(), "")]
    parts: list[str] = []
    state = {"links": 0, "a": 0}

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                found.append(Block(text, top.above, top.block, state["links"]))
            parts.clear()
        state["links"] = 0

    places: dict[str, list[int]] = {}  # of the open elements, by tag

    def drop(n: int) -> None:
        for x in stack[n:]:
            state["a"] -= x.tag == "a"
            places[x.tag].pop()
        del stack[n:]

    def push(x: _Open) -> None:
        k = len(stack)
        x.base = stack[-1].base if x.tag in INLINE else k
        places.setdefault(x.tag, []).append(k)
        stack.append(x)
        state["a"] += x.tag == "a"

    at, size, tags = 0, len(page), Tags(page)
    while at < size:
        m = tags.next(at)
        if m is None:
            text, at = page[at:], size
        else:
            text, at = page[at : m[0]], m[1]
        if text:
            parts.append(text)
            if state["a"]:
                state["links"] += len(text)
        if m is None:
            break
        if not m[3]:
            continue
        closing, tag, attributes = m[2], m[3].lower(), m[4]
        closed = attributes.rstrip().endswith("/")
        root = stack[-1].root
        if root and closing:  # within svg and math no tag ends a block
            k = places[tag][-1] if places.get(tag) else 0
            if k >= root:
                drop(k)
            elif k:
                drop(root)
            if not 0 < k < root:
                continue
        elif root and tag in PLAIN:
            drop(root)
        elif root:
            top, close = stack[-1], None
            if tag in RAW and not closed:
                close = tags.close(tag, at)
            if close:
                at = close.end()
            elif not closed:
                push(_Open(tag, top.above, top.block, root))
            if tag in ("text", "desc", "annotation"):
                parts.append(" ")
            continue
        if tag not in INLINE:
            end()
        if closing:
            if places.get(tag) and (tag not in INLINE or places[tag][-1] > stack[-1].base):
                drop(places[tag][-1])
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID or closed and tag in FOREIGN:
            continue
        if tag in RAW:
            close = tags.close(tag, at)
            at = close.end() if close else size
            continue
        if tag not in INLINE and tag not in WITHIN:  # a paragraph ends where another block begins; so do items and cells
            while (k := stack[-1].base) and (stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ())):
                drop(k)
        top, inline = stack[-1], tag in INLINE
        more = kinds_of(attributes) if attributes else ()
        above = top.above if inline and not more else top.above.union(more) if inline else top.above.union(more, ("t:" + tag,))
        push(_Open(tag, above, top.block if inline else tag, len(stack) if tag in FOREIGN else 0))
    end()
    return found


def text_features(b: Block, seen_h1: bool) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.in_links / max(len(b.text), 1)
    out = ["b:" + b.tag, f"n:{min(words.bit_length(), 8)}", "l:0" if share < 0.1 else "l:1" if share < 0.6 else "l:2", "h:1" if seen_h1 else "h:0"]
    if b.text[-1] in ".!?…:;\"'”»":
        out.append("end")
    if "©" in b.text or "(c)" in b.text.lower():
        out.append("copy")
    return out


@dataclass
class ChainField:
    """weights: of each feature for the label "main text"; moves[a][b]: from label a to b."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    kept: dict = field(default_factory=dict)

    def states(self, page: list[Block]) -> np.ndarray:
        """For each block the score of "main text" against the other label."""
        out, seen, get = np.zeros(len(page)), False, self.weights.get
        for i, b in enumerate(page):
            seen = seen or b.tag == "h1"
            base = self.kept.get(b.above)
            if base is None:
                if len(self.kept) > 10_000:
                    self.kept.clear()
                base = self.kept[b.above] = sum(get(f, 0.0) for f in sorted(b.above))
            out[i] = base + sum(get(f, 0.0) for f in text_features(b, seen))
        return out

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        scores = self.states(page).tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_a, from_b = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 >= b + m11 else (1, b + m11)
            back.append((from_a[0], from_b[0]))
            a, b = from_a[1], from_b[1] + s
        labels = [1 if b > a else 0]
        for x in reversed(back):
            labels.append(x[labels[-1]])
        return [k == 1 for k in reversed(labels)]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        found = blocks(page)
        return "\n".join(b.text for b, good in zip(found, self.decode(found), strict=True) if good)


def _marginals(state: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each block, and the expected count of each move, by forward and backward sums."""
    n = len(state)
    local = np.stack([np.zeros(n), state], 1)
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = local[0]
    for i in range(1, n):
        f[i] = np.logaddexp(f[i - 1, 0] + moves[0], f[i - 1, 1] + moves[1]) + local[i]
    for i in range(n - 2, -1, -1):
        x = local[i + 1] + b[i + 1]
        b[i] = np.logaddexp(moves[:, 0] + x[0], moves[:, 1] + x[1])
    total = np.logaddexp(f[-1, 0], f[-1, 1])
    count = np.zeros((2, 2))
    for i in range(1, n):
        count += np.exp(f[i - 1][:, None] + moves + (local[i] + b[i])[None, :] - total)
    return np.exp(f[:, 1] + b[:, 1] - total), count


def train(pages: list[list[tuple[Block, bool]]] | None = None, epochs: int = 8, rate: float = 0.3, ridge: float = 1e-4, seed: int = 3) -> ChainField:
    """Maximises the conditional log-likelihood of labelled pages, step sizes by AdaGrad."""
    pages = labelled_pages() if pages is None else pages
    model, grown, rng = ChainField(), {}, random.Random(seed)
    moves_grown = np.full((2, 2), 1e-6)
    prepared = []
    for page in pages:
        seen, rows = False, []
        for b, _ in page:
            seen = seen or b.tag == "h1"
            rows.append([*sorted(b.above), *text_features(b, seen)])
        if rows:
            prepared.append((rows, np.array([float(y) for _, y in page])))
    for _ in range(epochs):
        rng.shuffle(prepared)
        for rows, y in prepared:
            w = model.weights
            state = np.array([sum(w.get(f, 0.0) for f in row) for row in rows])
            p, count = _marginals(state, model.moves)
            grad: dict[str, float] = {}
            for row, d in zip(rows, y - p, strict=True):
                for f in row:
                    grad[f] = grad.get(f, 0.0) + d
            for f, g in grad.items():
                g -= ridge * w.get(f, 0.0)
                grown[f] = grown.get(f, 1e-6) + g * g
                w[f] = w.get(f, 0.0) + rate * g / grown[f] ** 0.5
            true = np.zeros((2, 2))
            k = y.astype(int)
            np.add.at(true, (k[:-1], k[1:]), 1)
            moves_grown += (true - count) ** 2
            model.moves = model.moves + rate * (true - count) / np.sqrt(moves_grown)
    return model


def labelled_pages(n: int = 400, seed: int = 11) -> list[list[tuple[Block, bool]]]:
    """Default labelled pages, made from a seed: articles of invented words inside varied page furniture.

    Main text carries a mark that no other text has; the mark labels the blocks and is then taken off.
    """
    rng = random.Random(seed)
    mark = "\ue000"
    syllables = "an the in on er re st al ou en ti ba co di fu ga le mi no pa ro sa tu ve za".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 1, b: int = 60) -> str:
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ":"])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(k))

    def one_of(*kinds: str) -> str:
        return rng.choice(kinds)

    def named(kind: str) -> str:
        word = rng.choice(KINDS[kind].split())
        return one_of(f'class="{word}"', f'id="{word}"', f'class="x-{word} wide"', f'class="{word}-{words(1, 1)}"')

    def furniture() -> str:
        kind = rng.choice(["nav", "head", "foot", "side", "ad", "notice", "form", "talk", "share"])
        inner = {
            "nav": lambda: f"<ul>{links(rng.randint(2, 9))}</ul>",
            "head": lambda: one_of(f"<h1>{words(1, 4)}</h1>", f"<p>{sentence(2, 9)}</p>", f"<a href='/'>{words(1, 3)}</a>"),
            "foot": lambda: one_of("&copy; ", "") + one_of(sentence(3, 25), f"<p>{sentence(3, 30)}</p>", f"<ul>{links(3)}</ul>"),
            "side": lambda: f"<h3>{words(1, 4)}</h3>" + one_of(f"<ul>{links(4)}</ul>", f"<p>{sentence(4, 50)}</p>"),
            "ad": lambda: one_of(sentence(2, 40), f"<p>{sentence(2, 40)}</p>", f"<a href='//x'>{sentence(2, 9)}</a>"),
            "notice": lambda: f"<p>{sentence(4, 40)}</p><button>{words(1, 2)}</button>",
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>",
            "talk": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(f"<div class='{one_of('comment', 'reply', 'c')}'><b>{words(1, 2)}</b><p>{sentence(3, 50)}</p></div>" for _ in range(rng.randint(1, 5))),
            "share": lambda: f"<span>{words(1, 4)}</span> <a href='#'>{words(1, 2)}</a>",
        }[kind]()
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind)
        if tag and rng.random() < 0.6:
            return f"<{tag}>{inner}</{tag}>" if rng.random() < 0.6 else f"<{tag} {named(kind)}>{inner}</{tag}>"
        where = one_of("div", "div", "section", "ul" if kind == "nav" else "div")
        return f"<{where} {named(kind)}>{inner}</{where}>"

    def article() -> str:
        out = [f"<h1>{mark}{sentence(2, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            k = rng.random()
            text = mark + sentence(1, one_of(4, 30, 120))
            if rng.random() < 0.15:
                text = text.replace(" ", f" <a href='/x'>{words(1, 2)}</a> ", 1)
            if k < 0.7:
                out.append(one_of(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p><b>{text}<br>"))
            elif k < 0.76:
                out.append(f"<h2>{text}</h2>")
            elif k < 0.82:
                out.append("<ul>" + "".join(f"<li>{mark}{sentence(2, 20)}</li>" for _ in range(3)) + "</ul>")
            elif k < 0.86:
                out.append(f"<blockquote>{text}</blockquote>")
            elif k < 0.9:
                out.append(f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>")
            elif k < 0.93:
                out.append(f"<pre>{text}</pre>")
            else:
                out.append(furniture())
        return "".join(out)

    pages = []
    for _ in range(n):
        body = [furniture() for _ in range(rng.randint(0, 4))]
        opening, closing = rng.choice([("<article>", "</article>")] * 6 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div {named('main')}>", "</div>"), (f"<section {named('main')}>", "</section>"), ("<div>", "</div>"), ("", "")])
        body += [opening + article() + closing]
        body += [furniture() for _ in range(rng.randint(0, 4))]
        found = blocks(f"<html><head><title>{words(2, 9)}</title></head><body>{''.join(body)}</body></html>")
        page = []
        for b in found:
            good = mark in b.text
            b.text = b.text.replace(mark, "").strip()
            if b.text:
                page.append((b, good))
        pages.append(page)
    return pages


def extract(pages: DataFrame, model: ChainField | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): the main text and its length in code points."""
    model = model or train()
    weights, moves = model.weights, model.moves

    def make():
        own = ChainField(weights, moves)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [own.extract(h) for h in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_rows(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query 5: the main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
