"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its leaf blocks, the runs of text between block-level tags in page order.
Each block has binary features of its ancestors (tags, and words in class, id and role) and of its text
(length, links, punctuation, place). Two labels, content and other, are scored by feature weights and by
weights for neighbouring labels; the weights are trained by maximum likelihood on labelled pages and the
best labelling of a page is decoded by Viterbi. Without other pages, :func:`labelled_pages` makes a fixed
number of varied ones, so the model's size and training do not depend on the corpus.

Text: character references are decoded, white space in a block becomes one space, content blocks are
joined by one space; nothing is cut. Scripts, styles, comments and markup are never text; a ``<`` that opens
no tag is text; an unclosed comment or script runs to the end of the page, as in browsers.

Edge cases: a null or empty page, or one without content, has the empty text; rows are extracted one by one,
so repeated rows and null ids do no harm; other columns are kept.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, EPOCHS, RATE, DECAY = 360, 40, 0.08, 1e-3

BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = BLOCK - frozenset("button canvas caption dd dt head html body iframe li object optgroup option tbody td template textarea tfoot th thead title tr video audio noscript legend select".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
FENCE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

TAGS = "nav header footer aside form article main section ul ol li table td button select figure figcaption blockquote pre dialog menu noscript head title label p div h1 h2 h3 h4 dl details template address".split()
GROUPS = {
    "ad": "ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo promotion banner teaser adsbygoogle",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip topnav sitemap",
    "head": "masthead header topbar branding logo tagline hero",
    "foot": "footer foot copyright legal colophon imprint",
    "side": "sidebar side aside widget related recommended trending popular rail tags tagcloud archive blogroll",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall disclaimer warning message toast",
    "sign": "newsletter subscribe subscription signup login search searchbox form register",
    "comment": "comment comments commentlist reply replies respond discussion disqus review reviews guestbook feedback",
    "share": "share sharing social follow likes",
    "main": "content article post entry story text main maintext articlebody postbody body prose page",
    "by": "byline author meta date timestamp",
}
_READ = frozenset(TAGS)  # the ancestors that features look at
_GROUP_OF = {word: group for group, words in GROUPS.items() for word in words.split()}
_SPLIT = re.compile(r"[A-Z]?[a-z]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OPENS = re.compile(r"</?[a-zA-Z][^\s/>]*[^>]*>?")
_NOT_DIGITS = re.compile(r"\D+")
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

FEATURES: dict[str, int] = {}


def _feature(name: str) -> int:
    return FEATURES.setdefault(name, len(FEATURES))


for _t in TAGS:
    _feature(f"in:{_t}")
    _feature(f"tag:{_t}")
for _g in GROUPS:
    _feature(f"named:{_g}")
    _feature(f"named:{_g}&body")
for _n in ("bias", "hidden", "in:article&p", "in:article&header", "nowhere", "copyright", "ends", "commas", "digits", "upper", "first", "last", "heading before", "tag:body", "tag:other"):
    _feature(_n)
for _n in range(6):
    _feature(f"words:{_n}")
    _feature(f"links:{_n}")


@dataclass
class Block:
    text: str
    features: list[int]


def _groups(attributes: str) -> frozenset[str]:
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return frozenset()
    found = set()
    for value in _NAMED.findall(attributes):
        for word in _SPLIT.findall(value):
            if group := _GROUP_OF.get(word.lower()):
                found.add(group)
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return frozenset(found)


class Stack:
    """The open tags, with what a block needs to know of them; every step takes about constant time, however deep the page.

    An entry is ``(tag, block tag or None, tags, groups, article before header)`` of itself and those around it; of the tags
    only those that features look at, so that a page of many distinct tag names takes no more memory.
    """

    def __init__(self) -> None:
        self.entries: list[tuple[str, str | None, frozenset[str], frozenset[str], bool]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> tuple[str, str | None, frozenset[str], frozenset[str], bool]:
        return self.entries[-1] if self.entries else ("", None, frozenset(), frozenset(), False)

    def push(self, name: str, groups: frozenset[str] = frozenset()) -> None:
        _, own, tags, named, ordered = self.top()
        if name in BLOCK:
            own = name
            self.blocks.append(len(self.entries))
        ordered = ordered or (name == "header" and "article" in tags and "header" not in tags)
        self.places.setdefault(name, []).append(len(self.entries))
        self.entries.append((name, own, tags if name in tags or name not in _READ else tags | {name}, named if groups <= named else named | groups, ordered))

    def cut(self, place: int) -> None:
        """Closes all tags from that place on."""
        while len(self.entries) > place:
            name = self.entries.pop()[0]
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def last(self, *names: str) -> int:
        """The place of the innermost of these tags; -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, name: str) -> None:
        place = self.last(name)
        if place >= 0 and (name in BLOCK or not self.blocks or place > self.blocks[-1]):
            self.cut(place)

    def open(self, name: str, groups: frozenset[str]) -> None:
        if name in CLOSES_P:
            place = self.last("p")
            if place >= 0 and self.last("button", "table", "td") < place:
                self.cut(place)
        elif name in SIBLING:
            place = self.last(*SIBLING[name])
            if place >= 0 and self.last(*FENCE.get(name, ())) < place:
                self.cut(place)
        self.push(name, groups)


class Tags:
    """Finds the tag that starts at a place. A ``>`` inside quotes does not end it; from the first tag on whose quotes are not closed, it does."""

    def __init__(self, page: str) -> None:
        self.page, self.quoted, self.last = page, True, page.rfind(">")

    def at(self, place: int) -> re.Match | None:
        if place > self.last:
            return None
        if self.quoted and not (tag := _TAG.match(self.page, place)):
            self.quoted = not _OPENS.match(self.page, place)
        elif self.quoted:
            return tag
        return _LOOSE.match(self.page, place)


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order, with their features."""
    page = page or ""
    stack, tags = Stack(), Tags(page)
    parts: list[str] = []
    raw: list[tuple[str, str, frozenset[str], frozenset[str], bool, float]] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            _, own, within, named, ordered = stack.top()
            raw.append((text, own or "body", within, named, ordered, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack.places.get("a"):
            linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = size if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = size if stop < 0 else stop + 1
            continue
        tag = tags.at(lt)
        if not tag:
            add("<")
            at = lt + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            end_block()
        if closing:
            stack.close(name)
            continue
        if name in RAW:
            stop = re.compile(f"</{name}", re.I).search(page, at)
            inner = page[at : stop.start() if stop else size]
            if name == "title":
                stack.push(name)
                add(inner)
                end_block()
                stack.cut(len(stack.entries) - 1)
            gt = page.find(">", stop.start()) if stop else -1
            at = size if gt < 0 else gt + 1
            continue
        if name not in VOID:
            stack.open(name, _groups(attributes))
    end_block()
    return _described(raw)


def _described(raw: list[tuple[str, str, frozenset[str], frozenset[str], bool, float]]) -> list[Block]:
    blocks, heading = [], False
    for k, (text, own, within, named, ordered, links) in enumerate(raw):
        f = FEATURES
        words = text.count(" ") + 1
        on = [f["bias"], f[f"words:{min(5, int(np.searchsorted((3, 6, 11, 21, 51), words, 'right')))}"], f[f"links:{min(5, int(links * 5))}"]]
        on += [f[f"in:{t}"] for t in within if f"in:{t}" in f]
        on.append(f.get(f"tag:{own}", f["tag:other"]))
        on += [f["hidden"] if g == "hidden" else f[f"named:{g}"] for g in named]
        if own in ("p", "div", "section", "pre", "blockquote"):
            on += [f[f"named:{g}&body"] for g in named if g != "hidden"]
        if "article" in within and own == "p":
            on.append(f["in:article&p"])
        if ordered:
            on.append(f["in:article&header"])
        if not within & {"nav", "header", "footer", "aside", "form", "article", "main"} and not named:
            on.append(f["nowhere"])
        n = len(text)
        checks = {
            "copyright": "©" in text or "(c) " in text.lower(),
            "ends": text[-1] in ".!?:;。！？\"”»)",
            "commas": text.count(",") >= 2,
            "digits": len(_NOT_DIGITS.sub("", text)) * 5 > n,
            "upper": text.isupper(),
            "first": k * 10 < len(raw),
            "last": (len(raw) - k) * 10 <= len(raw),
            "heading before": heading,
        }
        on += [f[name] for name, true in checks.items() if true]
        heading |= own in ("h1", "h2")
        blocks.append(Block(text, on))
    return blocks


@dataclass
class Crf:
    """``emission[f]`` favours content over other; ``change[a][b]`` scores label b after label a."""

    emission: np.ndarray
    change: np.ndarray

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels; content only where strictly better."""
        if not blocks:
            return []
        scores = [float(self.emission[b.features].sum()) for b in blocks]
        (oo, oc), (co, cc) = self.change.tolist()
        other, content, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_other = (other >= content + co, oc + other >= content + cc)
            back.append(from_other)
            other, content = max(other + oo if from_other[0] else other, content + co, other + oo), s + max(other + oc, content + cc)
        label = content > other
        labels = [label]
        for from_other in reversed(back):
            label = not from_other[int(label)]
            labels.append(label)
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return " ".join(b.text for b, keep in zip(blocks, self.decode(blocks), strict=True) if keep)


def fit(pages: list[tuple[list[Block], list[bool]]], epochs: int = EPOCHS, seed: int = 3) -> Crf:
    """Maximum likelihood with a quadratic penalty: forward-backward over batches of padded pages, Adam steps."""
    rng = np.random.default_rng(seed)
    pages = [p for p in pages if p[0]]
    weights = np.zeros(len(FEATURES) + 4)
    mean, spread, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // 60)):
            batch = [pages[r] for r in rows]
            n, long = len(batch), max(len(b) for b, _ in batch)
            x = np.zeros((n, long, len(FEATURES)), np.float32)
            y, real = np.zeros((n, long), int), np.zeros((n, long), bool)
            for i, (blocks, labels) in enumerate(batch):
                for t, block in enumerate(blocks):
                    x[i, t, block.features] = 1
                y[i, : len(labels)], real[i, : len(labels)] = labels, True
            emit = np.stack([np.zeros((n, long)), x @ weights[:-4]], axis=2)
            change = weights[-4:].reshape(2, 2)
            ahead, behind = np.zeros((n, long, 2)), np.zeros((n, long, 2))
            ahead[:, 0] = emit[:, 0]
            for t in range(1, long):
                step_to = np.logaddexp.reduce(ahead[:, t - 1, :, None] + change, axis=1) + emit[:, t]
                ahead[:, t] = np.where(real[:, t, None], step_to, ahead[:, t - 1])
            for t in range(long - 2, -1, -1):
                step_back = np.logaddexp.reduce(change + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(real[:, t + 1, None], step_back, 0)
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            share = np.exp(ahead + behind - total[:, None, None])
            slope = np.zeros_like(weights)
            slope[:-4] = np.einsum("nt,ntf->f", np.where(real, share[:, :, 1] - y, 0), x)
            for t in range(1, long):
                pair = np.exp(ahead[:, t - 1, :, None] + change + (emit[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
                pair[np.arange(n), y[:, t - 1], y[:, t]] -= 1
                slope[-4:] += pair[real[:, t]].sum(axis=0).ravel()
            slope = slope / n + DECAY * weights
            step += 1
            mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
            weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Crf(weights[:-4], weights[-4:].reshape(2, 2))


# --- labelled pages ---------------------------------------------------------------------------------
# Content is marked by a private-use character before each of its words, which labels the leaf blocks.
MARK = "\ue000"


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[str]:
    """Varied pages whose content words start with ``MARK``."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _words(rng: random.Random, n: int, mark: bool) -> str:
    made = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    made[0] = made[0].capitalize()
    made = [w + rng.choice(["", "", "", "", "", ",", ".", "%", "***", "!!", " 42", " &amp; x"]) if rng.random() < 0.4 else w for w in made]
    return " ".join(MARK + w if mark else w for w in made) + (rng.choice([".", ".", ".", "", "?", "&hellip;"]))


def _sentences(rng: random.Random, mark: bool = False) -> str:
    return " ".join(_words(rng, rng.randint(1, 24), mark) for _ in range(rng.choice([1, 1, 1, 2, 3, 6])))


def _name(rng: random.Random, group: str) -> str:
    word = rng.choice(GROUPS[group].split())
    word = rng.choice([word, f"{rng.choice(['site', 'page', 'js', 'c', 'block', 'top'])}-{word}", f"{word}-{rng.choice(['wrap', 'box', 'list', 'inner', 'item'])}"])
    return f' {rng.choice(["class", "class", "class", "id"])}="{word}"'


def _links(rng: random.Random, n: int) -> str:
    inner = "".join(f'<li><a href="/{k}">{_words(rng, rng.randint(1, 3), False)}</a></li>' for k in range(n))
    return rng.choice([f"<ul>{inner}</ul>", inner.replace("<li>", "<span>").replace("</li>", "</span> | "), f"<ol>{inner}</ol>"])


def _other(rng: random.Random) -> str:
    kind = rng.choice("nav nav header footer aside ad ad notice form comments comments share side hidden by".split())
    text = lambda: _sentences(rng)
    div = lambda group, inner: f"<div{_name(rng, group)}>{inner}</div>"
    if kind == "nav":
        return rng.choice([f"<nav>{_links(rng, rng.randint(2, 8))}</nav>", div("nav", _links(rng, rng.randint(2, 8)))])
    if kind == "header":
        inner = f"<h1>{_words(rng, 3, False)}</h1><p>{text()}</p>" if rng.random() < 0.5 else f"<h2>{_words(rng, 2, False)}</h2>{_links(rng, 3)}"
        return rng.choice([f"<header>{inner}</header>", div("head", inner)])
    if kind == "footer":
        inner = rng.choice([f"&copy; {text()}", f"<p>{text()}</p>", _links(rng, 4) + text(), f"<p>&copy; 2020 {text()}</p>{_links(rng, 3)}"])
        return rng.choice([f"<footer>{inner}</footer>", div("foot", inner)])
    if kind in ("aside", "side"):
        inner = f"<h3>{_words(rng, 2, False)}</h3>" + rng.choice([_links(rng, 5), f"<p>{text()}</p>", f"<p>{text()}</p><p>{text()}</p>"])
        return f"<aside>{inner}</aside>" if kind == "aside" else div("side", inner)
    if kind in ("ad", "notice"):
        inner = rng.choice([text(), f"<p>{text()}</p>", f"{text()} <a href='/x'>{_words(rng, 2, False)}</a>", f"<p>{text()}</p><button>{_words(rng, 1, False)}</button>"])
        return div(kind, inner) if rng.random() < 0.8 else f"<section{_name(rng, kind)}>{inner}</section>"
    if kind == "form":
        inner = f"<label>{_words(rng, 2, False)}</label><input name=q><select><option>{_words(rng, 1, False)}</option></select><p>{text()}</p><button>{_words(rng, 1, False)}</button>"
        return rng.choice([f"<form>{inner}</form>", div("sign", f"<form action='/s'>{inner}</form>"), div("sign", f"<p>{text()}</p>")])
    if kind == "comments":
        each = "".join(rng.choice([f"<div{_name(rng, 'comment')}><p>{text()}</p></div>", f"<li{_name(rng, 'comment')}><b>{_words(rng, 1, False)}</b><p>{text()}</p><p>{text()}</p></li>"]) for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<section id='comments'><h2>{_words(rng, 2, False)}</h2>{each}</section>", div("comment", f"<h3>{_words(rng, 2, False)}</h3>{each}")])
    if kind == "share":
        return div("share", _links(rng, 3))
    if kind == "by":
        return div("by", _words(rng, 4, False))
    return f"<div style='display:none'><p>{text()}</p></div>"


def _content(rng: random.Random) -> str:
    out = [f"<h1>{_words(rng, rng.randint(2, 12), True)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 14)):
        text = _sentences(rng, True)
        out.append(
            rng.choice(
                [f"<p>{text}</p>"] * 8
                + [f"<p><b>{text}<br>", f"<h2>{_words(rng, 4, True)}</h2>", f"<ul><li>{text}</li><li>{_words(rng, 3, True)}</li></ul>", f"<blockquote>{text}</blockquote>"]
                + [f"<pre>{text}</pre>", f"<p>{text} <a href='/y'>{_words(rng, 2, True)}</a> {_words(rng, 5, True)}</p>", f"<div>{text}</div>", f"<table><tr><td>{_words(rng, 2, True)}</td><td>{text}</td></tr></table>"]
            )
        )
        if rng.random() < 0.12:
            out.append(_other(rng))
    return "".join(out)


def _page(rng: random.Random) -> str:
    inner = _content(rng)
    body = rng.choice(
        [f"<article>{inner}</article>"] * 4
        + [f"<main>{inner}</main>", f"<main><article{_name(rng, 'main')}>{inner}</article></main>", f"<div{_name(rng, 'main')}>{inner}</div>", f"<section{_name(rng, 'main')}>{inner}</section>", f"<div><div>{inner}</div></div>", inner]
    )
    if "<article" in body[:15] and rng.random() < 0.35:
        body = body.replace("<h1>", "<header><h1>", 1).replace("</h1>", "</h1></header>", 1)
    before = "".join(_other(rng) for _ in range(rng.randint(0, 4)))
    after = "".join(_other(rng) for _ in range(rng.randint(0, 4)))
    title = f"<title>{_words(rng, 4, False)}</title>"
    return f"<!DOCTYPE html><html><head>{title}<style>p{{}}</style></head><body>{before}{body}{after}</body></html>"


def labelled_blocks(page: str) -> tuple[list[Block], list[bool]]:
    """Features from the page without marks, labels from the marks."""
    labels = [MARK in b.text for b in leaf_blocks(page)]
    return leaf_blocks(page.replace(MARK, "")), labels


def trained(pages: list[str] | None = None) -> Crf:
    return fit([labelled_blocks(p) for p in (pages or labelled_pages())])


def extract(df: DataFrame, page: str = "html", out: str = "text", model: Crf | None = None) -> DataFrame:
    """Adds the main text of every row's page."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        crf = shared.value
        for pages in batches:
            yield pd.Series([crf.extract(p) for p in pages], dtype=object)

    return df.withColumn(out, run(F.col(page)))
