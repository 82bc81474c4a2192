"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks: runs of text between block-level tags.  Features of a
block are its ancestors' tags and class words, properties of its text, and where it stands
towards the element that holds most of the page's prose: plainly inside it, inside a named part
of it, before or after it.  Labels are ``text`` and ``rest``.  The field is trained on labelled
pages (stochastic gradient of the log-likelihood, forward-backward) and decoded by Viterbi.

Labelled pages come from a bounded sample: pages that mark their article element label their
own blocks, and from the same blocks further labelled pages are composed with other containers
and with furniture that the sample may lack.  Names in composed pages are half usual ones and half
made up, and names are hidden from most training pages, so they
are a hint and never decide alone.  Classes of ``html``, ``body`` and of the article element
itself are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import unit_hash

#: The field is trained on about this many pages, none longer than ``FIT_CHARS``.
FIT_PAGES, FIT_CHARS = 300, 1 << 17
EPOCHS, RATE, DECAY = 10, 0.3, 1e-4
#: Names are hidden but from one in so many training pages.
NAMED = 3
#: Pages composed from each of them.
COMPOSED = 6
SEED = 2001

#: Fixed values of HTML: block-level elements, elements without content, elements whose
#: content is no markup and no page text, elements skipped with all elements in them, and
#: which open element an opening tag closes.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = frozenset("template noscript svg head".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
SCOPES = frozenset("ul ol table dl select body div article main section td th".split())
#: Elements that are the form of a text, not a part of a page.
FLOWING = frozenset(
    "p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tbody thead tfoot tr td th caption figure figcaption hr "
    "hgroup legend option optgroup summary details center address".split())
HOLDERS = BLOCKS - FLOWING
#: Elements that say nothing about what is in them.
PLAIN = ("html", "body", "div", "section")

#: What a page calls its article and what it calls everything else.
ARTICLE_TAGS = ("article", "main")
ARTICLE_WORDS = ("article", "body", "content", "entry", "main", "post", "story", "text")
REST_TAGS = ("aside", "footer", "form", "header", "menu", "nav", "button", "dialog", "select", "fieldset")
REST_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie",
              "cookies", "disqus", "footer", "form", "header", "login", "menu", "nav", "navbar", "navigation", "newsletter",
              "notice", "pagination", "popup", "privacy", "promo", "related", "reply", "replies", "share", "sharing",
              "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget")

STOPS = ".!?…\"'”»"

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_loose = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_names = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_word = re.compile(r"[A-Za-z]+")


class Node:
    """An open element: what it adds to the features of its ancestors, and its nearest holder."""

    __slots__ = ("tag", "words", "up", "fresh", "own", "over", "holder", "score")

    def __init__(self, tag: str, words: frozenset, up: "Node | None", open_: Callable[[str], bool]):
        self.tag, self.up, self.score = tag, up, None
        self.words = words = frozenset() if tag in ("html", "body", *ARTICLE_TAGS) else words
        block = tag in BLOCKS and tag not in ("html", "body")
        self.own = tag if block else up.own if up else "none"
        self.over = (up.own if up else "none") if block else up.over if up else "none"
        self.fresh = tuple(f for f in features_of(tag, words) if not open_(f))
        self.holder = self if tag in HOLDERS or up is None else up.holder

    def chain(self) -> Iterator["Node"]:
        node = self
        while node is not None:
            yield node
            node = node.up


def features_of(tag: str, words: frozenset) -> list[str]:
    """What an element adds to the features of the blocks in it."""
    out = [f"in:{tag}"] if tag in BLOCKS and tag not in PLAIN else []
    out += [f"word:{w}" for w in sorted(words)]
    out += ["rest-word"] if not words.isdisjoint(REST_WORDS) else []
    return out + (["article-word"] if not words.isdisjoint(ARTICLE_WORDS) else [])


@dataclass
class Block:
    node: Node  # the innermost open element
    text: str
    linked: int  # characters inside links

    def prose(self) -> int:
        """Characters outside links, if the block reads like a paragraph."""
        free = len(self.text) - self.linked
        return free if self.text.count(" ") > 4 and (free >= 80 or free >= 25 and self.text[-1] in STOPS) else 0


def parsed_tag(page: str, at: int) -> re.Match | None:
    return _tag.match(page, at) or _loose.match(page, at)


def self_closing(m: re.Match) -> bool:
    return m.group(3).rstrip().endswith("/")


def raw_end(page: str, tag: str, at: int) -> int | None:
    """Where the content of a ``RAW`` element that starts at ``at`` and its closing tag end."""
    end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)|</{re.escape(tag)}\s[^>]*>", re.I).search(page, at)
    return end.end() if end else None


def skipped_ends(page: str, at: int) -> dict[int, int]:
    """For every closed ``SKIPPED`` element from ``at`` on, where its opening tag and where its
    closing tag ends.  Elements of the same name nest; one that is not closed is left out."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    endless: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        m = parsed_tag(page, at)
        if m is None:
            at += 1
            continue
        at, tag = m.end(), (m.group(2) or "").lower() if m.lastindex else ""
        if tag in SKIPPED and m.group(1):
            if opened[tag]:
                ends[opened[tag].pop()] = at
        elif tag in SKIPPED and not (tag == "svg" and self_closing(m)):
            opened[tag].append(at)
        elif tag in RAW and not m.group(1) and not (opened["svg"] and self_closing(m)):
            end = None if tag in endless else raw_end(page, tag, at)
            if end is None and not opened["svg"]:
                break
            if end is None:
                endless.add(tag)  # nor has a later one an end
            at = end or at
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order.  The work follows the length of the page, however
    deep its elements are nested."""
    out: list[Block] = []
    root = Node("html", frozenset(), None, lambda f: False)
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # where elements of a name are open
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(stack[-1] if stack else root, text, linked))
        parts.clear()
        linked = 0

    def put(piece):
        nonlocal linked
        if piece:
            parts.append(piece)
            if places.get("a"):
                linked += len(piece)

    def push(tag, words):
        node = Node(tag, words, stack[-1] if stack else root, lambda f: open_.get(f, 0) > 0)
        for f in features_of(tag, node.words):
            open_[f] = open_.get(f, 0) + 1
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)

    def pop_to(tag):
        depth = places[tag][-1]
        while len(stack) > depth:
            node = stack.pop()
            places[node.tag].pop()
            for f in features_of(node.tag, node.words):
                open_[f] -= 1

    def deepest(tags):
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    at, n, ends = 0, len(page), None
    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            put(page[at:])
            break
        put(page[at:open_at])
        m = parsed_tag(page, open_at)
        if m is None:
            if re.match(r"</?[A-Za-z!?]", page[open_at:open_at + 3]):
                break  # the page ends inside a tag
            put("<")
            at = open_at + 1
            continue
        at = m.end()
        tag = (m.group(2) or "").lower() if m.lastindex else ""
        if not tag:
            continue
        if m.group(1):
            if places.get(tag):
                if tag in BLOCKS:
                    flush()
                pop_to(tag)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            at = raw_end(page, tag, at) or n
            continue
        if tag in SKIPPED:
            if not (tag == "svg" and self_closing(m)):
                ends = skipped_ends(page, open_at) if ends is None else ends
                at = ends.get(at, at)  # what is not closed holds nothing
            continue
        if tag in BLOCKS:
            flush()
            if tag not in ("button", "option", "optgroup") and places.get("p"):
                pop_to("p")
            for open_tag in CLOSES.get(tag, ()):
                if places.get(open_tag) and places[open_tag][-1] > deepest(SCOPES - {open_tag}):
                    pop_to(open_tag)
        if tag not in VOID and not self_closing(m):
            words = frozenset(w.lower() for v in _names.findall(m.group(3)) for w in _word.findall(v))
            push(tag, words)
    flush()
    return out


def _status(holder: Node, centre: Node, known: dict) -> tuple[str, tuple]:
    """How a holder stands towards the centre: ``plain`` or ``named`` inside it, or ``out``; and
    what the outermost named part is called."""
    path = []
    while holder is not None and holder not in known:
        path.append(holder)
        if holder is centre:
            break
        holder = holder.up.holder if holder.up else None
    state = known.get(holder, ("out", ())) if holder is not None else ("out", ())
    for node in reversed(path):
        if node is centre:
            state = ("plain", ())
        elif state[0] == "plain" and (node.words or node.tag in REST_TAGS):
            state = ("named", (node.tag, node.words))
        known[node] = state
    return state


def places_of(blocks: Sequence[Block]) -> list[str]:
    """Where each block stands towards the element that holds most of the prose, the centre.

    A holder is credited with its own prose and half of what the holders in it have; a named
    part that has most of the centre's prose is no part but its text.  Names of the centre and
    of what it is in are taken from the features.
    """
    prose = [b.prose() for b in blocks]
    credit: dict[Node, float] = {}
    for b, n in zip(blocks, prose):
        if n:
            own = b.node.holder
            credit[own] = credit.get(own, 0.0) + n
            if own.up is not None:
                credit[own.up.holder] = credit.get(own.up.holder, 0.0) + n / 2
    if not credit:
        return ["none"] * len(blocks)
    # what HTML sets apart, or is named like furniture, is the centre only if nothing else comes near
    def rank(holder):
        apart = any(n.tag in REST_TAGS or not n.words.isdisjoint(REST_WORDS) for n in holder.chain())
        return credit[holder] / (4 if apart else 1)

    centre = max(credit, key=rank)
    for node in centre.chain():  # names of what holds the prose say nothing about it
        node.fresh = tuple(f for f in node.fresh if f.startswith("in:"))
    known: dict[Node, tuple] = {}
    states = [_status(b.node.holder, centre, known) for b in blocks]
    inside = [i for i, (state, _) in enumerate(states) if state != "out"]
    share: dict[tuple, int] = {}
    for (state, name), n in zip(states, prose):
        if state != "out":
            share[name] = share.get(name, 0) + n
    total, out = sum(share.values()), []
    # so do names of a part that is nearly all there is
    whole = [name for name, n in share.items() if name and 10 * n > 9 * total]
    for node, (state, name) in known.items():
        if name in whole and (node.tag, node.words) == name:
            node.fresh = tuple(f for f in node.fresh if f.startswith("in:"))
    for i, (b, (state, name)) in enumerate(zip(blocks, states)):
        if state == "out":
            h = b.node.holder
            same = h.tag == centre.tag and h.words == centre.words and (h.words or h.tag in ARTICLE_TAGS)
            state = "same" if same else "before" if i < inside[0] else "after" if i > inside[-1] else "between"
        elif state == "named" and 2 * share[name] > total:
            state = "major"
        out.append(state)
    return out


def changes_of(places: Sequence[str]) -> list[int]:
    """For every block but the first: 0 if it and that before it stand alike towards the centre and
    belong to it, 2 if they stand alike elsewhere, 1 if they do not."""
    return [1 if a != b else 0 if a in ("plain", "major", "same") else 2 for a, b in zip(places, places[1:])]


def own_features(node: Node) -> list[str]:
    return [f"own:{node.own}", f"up:{node.over if node.over not in PLAIN else 'none'}"]


def path_features(node: Node) -> list[str]:
    """Features of the elements that a block is in."""
    return ["bias", *own_features(node), *sorted({f for n in node.chain() for f in n.fresh})]


def text_features(b: Block, place: str) -> list[str]:
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    out = [f"words:{min(words.bit_length(), 7)}", "links:" + ("most" if 2 * b.linked >= n else "some" if b.linked else "none")]
    out.append("end:" + ("stop" if text[-1] in STOPS else "other"))
    out += [f"place:{place}", f"place:{place}:{'prose' if b.prose() else 'short'}", f"place:{place}:{b.node.own}"]
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    return out


@dataclass
class Field:
    """Weights by feature (for ``text`` against ``rest``) and between neighbours, apart for
    how they stand towards the page's prose (``changes_of``)."""

    weights: dict[str, float]
    moves: list[list[list[float]]]  # change of place, from label, to label

    def path_score(self, node: Node | None) -> float:
        """Weights of what a node and its ancestors add, each node once."""
        path = []
        while node is not None and node.score is None:
            path.append(node)
            node = node.up
        total = node.score if node is not None else self.weights.get("bias", 0.0)
        for n in reversed(path):
            total += sum(self.weights.get(f, 0.0) for f in n.fresh)
            n.score = total
        return total

    def scores(self, blocks: Sequence[Block], places: Sequence[str]) -> list[float]:
        get = self.weights.get
        return [self.path_score(b.node) + sum(get(f, 0.0) for f in (*own_features(b.node), *text_features(b, place)))
                for b, place in zip(blocks, places)]

    def decode(self, scores: Sequence[float], changes: Sequence[int]) -> list[int]:
        """Viterbi: the most probable labels; of equal ones ``rest`` is taken."""
        if not scores:
            return []
        rest, text, back = 0.0, scores[0], []
        for s, change in zip(scores[1:], changes):
            (a, b), (c, d) = self.moves[change]
            from_rest, from_text = (rest + a, rest + b), (text + c, text + d)
            back.append((int(from_text[0] > from_rest[0]), int(from_text[1] > from_rest[1])))
            rest, text = max(from_rest[0], from_text[0]), max(from_rest[1], from_text[1]) + s
        labels = [int(text > rest)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page or "")
        places = places_of(blocks)
        labels = self.decode(self.scores(blocks, places), changes_of(places))
        return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def own_labels(blocks: Sequence[Block]) -> list[int] | None:
    """Labels of a page that marks its article element; None for other pages.

    Inside the article, an element that HTML itself sets apart, or one that is named like
    furniture and holds less than half of the article's prose, is rest.
    """
    article: dict[Node | None, tuple] = {None: (False, None)}  # inside, and the outermost part set apart

    def state(node):
        path = []
        while node not in article:
            path.append(node)
            node = node.up
        inside, part = article[node]
        for n in reversed(path):
            inside = inside or n.tag in ARTICLE_TAGS
            if inside and part is None and (n.tag in REST_TAGS or not n.words.isdisjoint(REST_WORDS)):
                part = n
            article[n] = inside, part
        return inside, part

    states = [state(b.node) for b in blocks]
    if not any(inside for inside, _ in states):
        return None
    prose: dict[Node | None, int] = {}
    for b, (inside, part) in zip(blocks, states):
        if inside:
            prose[part] = prose.get(part, 0) + b.prose()
    half = sum(prose.values()) / 2
    return [int(inside and (part is None or part.tag not in REST_TAGS and prose[part] > half)) for inside, part in states]


def composed_pages(blocks: Sequence[Block], labels: Sequence[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A labelled page from a page's blocks: another container for its article, and furniture
    before, inside and after it."""
    none = frozenset()

    def name(usual, share=0.5):
        word = rng.choice(usual) if rng.random() < share else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9)))
        return frozenset([word])

    def under(node, *path):
        for tag, words in path:
            node = Node(tag, words, node, lambda f, above=node: above is not None and any(f in n.fresh for n in above.chain()))
        return node

    body = under(None, ("html", none), ("body", none))
    containers = [(("article", none),), (("main", none),), (("div", name(ARTICLE_WORDS)),), (("section", name(ARTICLE_WORDS)),),
                  (("main", none), ("article", none)), (("div", name(ARTICLE_WORDS)), ("div", name(ARTICLE_WORDS))), ()]
    container = under(body, *rng.choice(containers))
    inner = [("p",)] * 6 + [("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("div", "p"), ("section", "p"), ("h2",),
                            ("h3",), ("pre",), ("div",), ("figure", "figcaption"), ("table", "tbody", "tr", "td")]
    # an article may name every paragraph's element
    each = [("div", name(ARTICLE_WORDS))] if rng.random() < 0.15 else []

    def cut(text):  # paragraphs of any length, of articles and of furniture
        words = text.split(" ")[:rng.randint(1, 30)]
        return text if rng.random() < 0.5 else " ".join(words) + rng.choice((".", ".", "?", ""))

    article = [Block(under(container, *each, *((t, none) for t in rng.choice(inner))), cut(b.text), 0)
               for b, y in zip(blocks, labels) if y]
    other = [b for b, y in zip(blocks, labels) if not y] or list(blocks)

    def furniture(inside):
        for _ in range(rng.randint(1, 4)):
            holder = under(inside, (rng.choice(REST_TAGS), none) if rng.random() < 0.25 else
                           (rng.choice(("div", "div", "section", "section", "ul")), name(REST_WORDS, 0.25)))
            for _ in range(rng.randint(1, 4)):
                # furniture may read like an article: its words come from either
                text = cut(rng.choice(other if rng.random() < 0.4 else blocks).text)
                linked = len(text) if rng.random() < 0.3 else 0
                row = (rng.choice(("div", "li", "article")), none if rng.random() < 0.5 else name(REST_WORDS))
                deep = (row,) if rng.random() < 0.3 and holder.tag != "ul" and row[0] != "article" else ()
                yield Block(under(holder, *deep, (rng.choice(("p", "p", "li", "div", "h3")), none)), text, linked)

    before, after = list(furniture(body)), list(furniture(body))
    within = list(furniture(container)) if rng.random() < 0.7 else []
    # comments and the like close an article more often than they cut it
    at = len(article) if rng.random() < 0.5 else rng.randint(0, len(article))
    page = before + article[:at] + within + article[at:] + after
    y = [0] * len(before) + [1] * at + [0] * len(within) + [1] * (len(article) - at) + [0] * len(after)
    return page, y


def train(pages: Sequence[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Stochastic gradient ascent of the conditional log-likelihood, each weight with its own rate."""
    names: dict[str, int] = {}
    named = ("rest-word", "article-word", "word:")
    coded = [([[names.setdefault(f, len(names)) for f in path_features(b.node) + text_features(b, place)
                if not (k % NAMED and f.startswith(named))] for b, place in zip(blocks, places_of(blocks))],
              np.array(y)) for k, (blocks, y) in enumerate(pages) if blocks]
    flat = [(np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), y,
             np.array(changes_of(places_of(blocks)), np.int64)) for (rows, y), blocks in zip(coded, (b for b, _ in pages if b))]
    w, moves, rng = np.zeros(len(names)), np.zeros((3, 2, 2)), random.Random(seed)
    seen, seen_moves = np.full(len(names), 1e-3), np.full((3, 2, 2), 1e-3)  # squares of the steps so far
    for _ in range(epochs):
        rng.shuffle(flat)
        for feature, row, y, change in flat:
            n = len(y)
            s = np.zeros((n, 2))
            s[:, 1] = np.bincount(row, weights=w[feature], minlength=n)
            fore, back = np.zeros((n, 2)), np.zeros((n, 2))
            fore[0], step_to = s[0], moves[change]
            for i in range(1, n):
                fore[i] = s[i] + np.logaddexp(fore[i - 1, 0] + step_to[i - 1, 0], fore[i - 1, 1] + step_to[i - 1, 1])
            for i in range(n - 2, -1, -1):
                ahead = s[i + 1] + back[i + 1]
                back[i] = np.logaddexp(step_to[i, :, 0] + ahead[0], step_to[i, :, 1] + ahead[1])
            whole = np.logaddexp(fore[-1, 0], fore[-1, 1])
            error = y - np.exp(fore[:, 1] + back[:, 1] - whole)
            own, at = np.unique(feature, return_inverse=True)
            step = np.bincount(at, weights=error[row]) - DECAY * w[own]
            seen[own] += step * step
            w[own] += RATE * step / np.sqrt(seen[own])
            step = np.zeros((3, 2, 2))
            np.add.at(step, (change, y[:-1], y[1:]), 1.0)
            np.subtract.at(step, change, np.exp(fore[:-1, :, None] + step_to + (s[1:] + back[1:])[:, None, :] - whole))
            seen_moves += step * step
            moves += RATE * step / np.sqrt(seen_moves)
    return Field({f: float(w[i]) for f, i in names.items()}, moves.tolist())


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", fit_pages: int = FIT_PAGES,
        seed: int = SEED) -> Field:
    """A field trained on a sample of about ``fit_pages`` different pages, drawn by a seeded hash
    of their ids; the sample's pages have at most ``FIT_CHARS`` characters each, which bounds what comes
    to the driver.  Where no sampled page marks its article, composed pages of a plain text teach
    what the containers look like.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).where(
        F.col("html").isNotNull() & (F.length("html") <= FIT_CHARS))
    drawn = unit_hash(F.lit(seed), F.col("id"))
    share = min(1.0, 2 * fit_pages / max(1, pages.count()))
    first = rows.withColumn("_h", drawn).where(F.col("_h") / F.lit(2.0 ** 63) <= share).groupBy("html").agg(F.min("_h").alias("_h"))
    sample = first.orderBy("_h", "html").limit(fit_pages).collect()
    rng, labelled = random.Random(seed), []
    for text in sorted(r["html"] for r in sample):
        blocks = leaf_blocks(text)
        labels = own_labels(blocks)
        if labels and any(labels):
            labelled.append((blocks, labels))
    plain = Node("p", frozenset(), Node("html", frozenset(), None, lambda f: False), lambda f: False)
    base = labelled or [([Block(plain, " ".join(["word"] * k) + ".", 0) for k in (6, 40, 80)], [1, 1, 1])] * 50
    composed = [composed_pages(b, y, rng) for b, y in base for _ in range(COMPOSED)]
    return train(labelled + [page for page in composed if centred(*page)], seed=seed)


def centred(blocks: Sequence[Block], labels: Sequence[int]) -> bool:
    """Whether the prose of a page's article, and not of its furniture, is its centre."""
    at = [place in ("plain", "major", "same") for place, y in zip(places_of(blocks), labels) if y]
    return 2 * sum(at) >= len(at)


def extract(pages: DataFrame, field: Field, html_col: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text as ``name``, empty if there is none."""
    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([field.main_text(t) for t in s], dtype=object)

    return pages.withColumn(name, main_text(F.col(html_col).cast("string")))


def text_report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.  A null html is empty; ids and urls
    are passed on as they are; an empty table gives an empty result."""
    out = extract(pages.select("page_id", "url", "html"), fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
