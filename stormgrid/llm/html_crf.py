"""Operator 2: main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks, the runs of text between block-level tags, each with the tags, classes and ids around
it. A block's features are its ancestors, words in their classes, its length, links, punctuation and place; a chain of
two labels (article or not) runs over a page's blocks and Viterbi finds the best one. Weights are trained by penalised
likelihood on TRAINING_PAGES labelled pages of many layouts, which this module lays out itself from a seed (labels are
known there); that number is the bound of what the driver holds.

Edge cases: null or empty html, or no article: empty text, 0 characters. Unclosed tags, comments and quotes end where
the page ends. Whole pages are read, however long. Repeated rows each have a result, an empty table an
empty one. Other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stormgrid.llm.shared import project

TRAINING_PAGES, ROUNDS, PENALTY = 600, 250, 0.3
#: What browsers lay out as blocks, what has no end tag, and what holds no text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre section select summary
table tbody td tfoot th thead title tr ul video audio canvas""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math xmp iframe object title".split())
CLOSES_P = BLOCK - {"button", "html", "head", "body", "option", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "legend", "title", "iframe", "video", "audio", "canvas"}
SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d")

#: Words of class, id and role attributes that tell what a part of a page is for.
HINTS = {
    "comment": "comment comments reply replies discussion disqus respond commentlist reader",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp banner adsbygoogle",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pager pagination tabs topbar skip",
    "foot": "footer foot colophon copyright legal",
    "head": "header masthead logo branding top",
    "notice": "cookie cookies consent notice notices alert gdpr modal popup overlay subscribe newsletter signup paywall login",
    "share": "share sharing social follow tools buttons tags meta byline author",
    "content": "content article post entry main story body text page prose markdown hentry articlebody",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
TAGS = "article main section nav header footer aside form ul ol li table td th dl h1 h2 h3 p blockquote pre figure figcaption button label div details address".split()
WORDS = {
    "w:copyright": re.compile("©|copyright|all rights reserved", re.I),
    "w:cookie": re.compile(r"cookie|privacy|gdpr|consent", re.I),
    "w:sub": re.compile("subscribe|newsletter|sign up|log in|e-?mail", re.I),
    "w:share": re.compile("share|tweet|facebook|follow us|read more|related|comments?$|repl(y|ies)", re.I),
    "w:ad": re.compile("advert|sponsored|promot|buy now|% off", re.I),
}


class Block:
    """Text of a leaf block, the TAGS and hints of its ancestors, its innermost tag, and how many of its raw characters
    stand in links."""

    __slots__ = ("text", "tags", "hints", "inner", "linked", "raw")

    def __init__(self, text: str, tags: frozenset, hints: frozenset, inner: str, linked: int, raw: int):
        self.text, self.tags, self.hints, self.inner, self.linked, self.raw = text, tags, hints, inner, linked, raw


@cache
def _hints_of(names: str) -> frozenset:
    return frozenset(_HINT[w] for w in _PART.findall(names) if w in _HINT)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    # open elements: name, and the tags, hints and innermost tag of it and all above; where each name and any block stands
    stack: list[tuple[str, frozenset, frozenset, str]] = [("", frozenset(), frozenset(), "other")]
    where: dict[str, list[int]] = defaultdict(list)
    block_at = [0]
    text: list[str] = []
    linked, at, end = 0, 0, len(page)

    def close() -> None:
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, *stack[-1][1:], linked, sum(map(len, text))))
            text.clear()
        linked = 0

    def pop_to(i: int) -> None:
        while len(stack) > i:
            where[stack.pop()[0]].pop()
        while block_at[-1] >= i:
            block_at.pop()

    def last(*names: str) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max(where[x][-1] if where[x] else 0 for x in names)

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            run = page[at:stop]
            text.append(run)
            if where["a"]:
                linked += len(run)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK:
                close()
            i = last(name)
            if i and (name in BLOCK or i > block_at[-1]):
                pop_to(i)
            continue
        if name in RAW:
            if name in BLOCK:
                close()
            gone = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = gone.end() if gone else end
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            close()
            if name in CLOSES_P and (i := last("p")) and i == block_at[-1]:
                pop_to(i)
            if name in SAME and (i := last(*(("dt", "dd") if name in ("dt", "dd") else (name,)))) > last(*SAME[name]):
                pop_to(i)
        if name in VOID or (m[3] or m[6] or "").endswith("/"):
            continue
        attrs = m[3] or m[6] or ""
        _, tags, hints, inner = stack[-1]
        if "=" in attrs:
            hints = hints | _hints_of(" ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower())
        where[name].append(len(stack))
        if name in BLOCK:
            block_at.append(len(stack))
        stack.append((name, tags | {name} if name in _TAGS and name not in tags else tags, hints, name if name in _INNER else inner))
    close()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        size = len(b.text)
        density = b.linked / max(b.raw, 1)
        f = [f"t:{t}" for t in b.tags]
        f += [f"h:{h}" for h in b.hints]
        inner = b.inner
        f += [f"in:{inner}", f"size:{min(size.bit_length(), 10)}", f"link:{int(density * 4)}", f"at:{(4 * i) // n}", "bias"]
        if "t:article" in f or "t:main" in f or "content" in b.hints:
            f.append(f"core:{'link' if density > 0.6 else inner}")
        if b.text[-1] in ".!?:;…\"'»”":
            f.append("stop")
        if size < 400:
            f += [k for k, r in WORDS.items() if r.search(b.text)]
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


_TAGS = frozenset(TAGS)
_INNER = frozenset("p h1 h2 h3 h4 li td th div a button label nav header footer aside figcaption blockquote pre article section dd dt form".split())


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages of many layouts. A word that begins with † marks text of the article; marks go before features are taken."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        return "".join(pick("an", "er", "in", "on", "the", "st", "ti", "wh", "éa", "ou", "sch", "ción") for _ in range(rng.integers(1, 5))) + (pick("***", "%%%", "$$$", "###") if chance(0.02) else "")

    def words(lo: int, hi: int) -> str:
        s = " ".join(word() for _ in range(rng.integers(lo, hi)))
        return s.capitalize() + ("." if chance(0.8) else "")

    def para() -> str:
        s = "†" + words(1, 4 if chance(0.2) else 120)
        s = s.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1) if chance(0.2) else s
        s = pick(f"<b>{s}", f"<b>{s}</b>", f"<em>{s}</em>", s) if chance(0.3) else s
        return f"<p>{s}</p>" if chance(0.8) else f"<p>{s}<br>"

    def links(tag: str, cls: str, k: int) -> str:
        return f"<{tag}{cls}><ul>" + "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(k)) + f"</ul></{tag}>"

    def cls(*xs: str) -> str:
        return f' {pick("class", "id")}="{pick(*xs)}"'

    def junk() -> str:
        kind = rng.integers(9)
        return [
            lambda: f"<div{cls('ad', 'ads', 'advert', 'sponsored', 'promo banner', 'ad-slot')}>{words(2, 40)}</div>",
            lambda: f"<aside{cls('sidebar', 'related', 'widget') if chance(0.7) else ''}><h3>{words(1, 4)}</h3><p>{words(3, 40)}</p></aside>",
            lambda: f"<div{cls('cookie-notice', 'consent', 'notice', 'alert', 'gdpr-banner', 'popup')}><p>{pick('We use cookies. ', 'Notice: ', '')}{words(3, 30)}</p><button>{words(1, 3)}</button></div>",
            lambda: f"<form{cls('search', 'newsletter', 'signup')}><label>{words(1, 6)}</label><input name=q><p>{words(1, 15)}</p><button>{words(1, 3)}</button></form>",
            lambda: links("div", cls("share", "social", "related", "tags", "breadcrumbs"), rng.integers(2, 7)),
            lambda: f"<section{cls('comments', 'comment-list', 'discussion')}><h2>Comments</h2>" + "".join(f"<div class=\"comment\"><p>{words(2, 60)}</p></div>" for _ in range(rng.integers(1, 6))) + "</section>",
            lambda: links("nav", "", rng.integers(3, 12)),
            lambda: f"<div{cls('sidebar', 'widget', 'related-posts', 'trending')}><p>{words(3, 60)}</p>{links('div', '', 3)}</div>",
            lambda: f"<noscript>{words(2, 9)}</noscript><script>var t=\"</p>\";</script>",
        ][kind]()

    pages = []
    for _ in range(n):
        inner = (f"<h1>†{words(2, 10)}</h1>" if chance(0.9) else "")
        if chance(0.15):
            inner = f"<header>{inner}</header>" if chance(0.5) else inner + f"<div class=\"byline\">{words(2, 6)}</div>"
        for _ in range(rng.integers(1, 16)):
            r = rng.random()
            if r < 0.8:
                inner += para()
            elif r < 0.84:
                inner += f"<{pick('h2', 'h3')}>†{words(1, 8)}</{pick('h2', 'h3')}>"
            elif r < 0.88:
                inner += f"<{(t := pick('ul', 'ol'))}>" + "".join(f"<li>†{words(2, 25)}</li>" for _ in range(rng.integers(2, 6))) + f"</{t}>"
            elif r < 0.91:
                inner += f"<blockquote>{para()}</blockquote>" if chance(0.5) else f"<table><tr><td>†{words(1, 8)}</td><td>†{words(1, 8)}</td></tr></table>"
            else:
                inner += junk()
        if chance(0.25):
            inner += f"<section{cls('comments', 'discussion')}>" + "".join(f"<{(t := pick('div', 'article', 'li'))} class=\"comment\"><p>{words(2, 60)}</p></{t}>" for _ in range(rng.integers(1, 5))) + "</section>"
        if chance(0.15):
            inner += f"<footer>{words(2, 12)}</footer>"
        layout = rng.random()
        if layout < 0.55:
            core = f"<article{cls('post', 'entry') if chance(0.3) else ''}>{inner}</article>"
        elif layout < 0.7:
            core = f"<main>{inner}</main>"
        elif layout < 0.92:
            core = f"<div{cls('content', 'article', 'post-body', 'entry-content', 'main', 'story')}>{inner}</div>"
        else:
            core = f"<div>{inner}</div>"
        if chance(0.2):
            core = f"<main>{core}</main>"
        page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"
        page += pick(links("nav", "", rng.integers(2, 12)), f"<header><p>{words(1, 8)}</p>{links('nav', '', 5)}</header>", f"<div{cls('header', 'masthead', 'topbar')}>{words(1, 6)}{links('div', cls('menu', 'nav'), 5)}</div>", "")
        page += "".join(junk() for _ in range(rng.integers(0, 3))) + core + "".join(junk() for _ in range(rng.integers(0, 4)))
        page += pick(f"<footer>&copy; {words(2, 14)}</footer>", f"<footer><p>{words(2, 20)}</p>{links('div', '', 4)}</footer>", f"<div{cls('footer', 'colophon', 'legal')}>Copyright {words(2, 9)}</div>", "")
        bs = blocks_of(page + "</body></html>")
        y = [int("†" in b.text) for b in bs]
        for b in bs:
            b.text = b.text.replace("†", "")
        keep = [i for i, b in enumerate(bs) if b.text]
        if keep:
            pages.append(([bs[i] for i in keep], [y[i] for i in keep]))
    return pages


class Crf:
    """Two labels. A block's potential is the sum of its features' weights, for label 1; step[a, b] for neighbours."""

    def __init__(self, weight: dict[str, float], step: np.ndarray):
        self.weight, self.step = weight, step

    def decode(self, blocks: list[Block]) -> list[bool]:
        if not blocks:
            return []
        w = self.weight.get
        (aa, ab), (ba, bb) = self.step.tolist()
        zero = one = 0.0
        back = []
        for i, f in enumerate(features(blocks)):
            e = sum(w(k, 0.0) for k in f)
            if i == 0:
                one = e
                continue
            from0, from1 = one + ba > zero + aa, one + bb > zero + ab
            back.append((from0, from1))
            zero, one = (one + ba if from0 else zero + aa), (one + bb if from1 else zero + ab) + e
        label = one > zero
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]]) -> Crf:
    """Penalised maximum likelihood: forward and backward sums over all pages at once, Adam steps."""
    feats = [features(b) for b, _ in pages]
    names = sorted({k for p in feats for f in p for k in f})
    number = {k: i for i, k in enumerate(names)}
    n, longest = len(pages), max(len(p) for p in feats)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest), bool)
    for i, (p, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
        for j, f in enumerate(p):
            x[i, j, [number[k] for k in f]] = 1
        y[i, : len(p)], live[i, : len(p)] = labels, True
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair_live = live[:, 1:]
    seen_pair = np.array([[(pair_live & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen = (x[live].T * y[live]).sum(1)
    for t in range(1, ROUNDS + 1):
        step = theta[-4:].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[..., 1] = x @ theta[:-4].astype(np.float32)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for j in range(1, longest):
            on = np.logaddexp.reduce(forward[:, j - 1, :, None] + step[None], axis=1) + e[:, j]
            forward[:, j] = np.where(live[:, j, None], on, forward[:, j - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        for j in range(longest - 2, -1, -1):
            back = np.logaddexp.reduce(step[None] + (e[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
            backward[:, j] = np.where(live[:, j + 1, None], back, 0)
        p = np.exp(forward[..., 1] + backward[..., 1] - total[:, None]) * live
        both = np.exp(forward[:, :-1, :, None] + step[None, None] + (e + backward)[:, 1:, None, :] - total[:, None, None, None]) * pair_live[..., None, None]
        gradient = np.concatenate((seen - np.einsum("ijk,ij->k", x, p.astype(np.float32)), (seen_pair - both.sum((0, 1))).ravel())) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(dict(zip(names, theta[:-4].tolist(), strict=True)), theta[-4:].reshape(2, 2))


@cache
def trained() -> Crf:
    return train(labelled_pages())


def main_text(crf: Crf, page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, yes in zip(blocks, crf.decode(blocks), strict=True) if yes)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. No shuffle; the weights (a few hundred numbers) are broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(shared.value, h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = project(pages, "page_id", "url", "html")
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.mapInArrow(run, f"{', '.join(kinds)}, text string, n_chars long")
