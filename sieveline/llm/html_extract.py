"""Main text of web pages: a linear-chain CRF over DOM leaf blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# -- from HTML to leaf blocks ------------------------------------------------

#: Fixed values of HTML: elements that never have contents; whose contents are
#: not markup; that are not shown as text; that flow within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("script style title head template noscript iframe noembed noframes svg math canvas object select datalist textarea option xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element that the start of another ends: paragraphs by any block, and
#: items of a kind by the next.
_P_STAYS = INLINE | HIDDEN | VOID - {"hr"}
_SCOPE = frozenset("html table td th caption button object template".split())
_LISTS = frozenset("ul ol menu".split())
#: Kinds of elements that a start ends: those that it ends, and those behind
#: which it doesn't look for one.
_ENDS = (({"p"}, _SCOPE), ({"li"}, _LISTS | _SCOPE), ({"dt", "dd"}, {"dl"} | _SCOPE), ({"tr", "td", "th"}, _SCOPE - {"td", "th"}), ({"td", "th"}, {"tr"} | _SCOPE), ({"option"}, {"select"} | _SCOPE))
_ENDED_BY = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_MOVES = {t: tuple(1 if t in own else -1 if t in limit else 0 for own, limit in _ENDS) for t in {x for own, limit in _ENDS for x in own | limit}}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TO_VALUE, _BLANK = re.compile(r"[^>=]*"), re.compile(r"\s*")
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_SPACES = re.compile(r"[\s\x00]+")
_HUGE_REF = re.compile(r"&#0*[0-9]{8,};?")  # beyond all code points, and too long for int()

#: Words in classes, ids and roles that features tell apart; those of boxes that
#: are no part of an article, those of its readers' comments, those of its body;
#: and elements that are such boxes.
NOISE = ("ad ads advert advertisement sponsor sponsored promo promotion banner cookie consent gdpr notice alert sidebar side rail menu nav navigation breadcrumb breadcrumbs footer masthead topbar share social follow related recommended newsletter subscribe signup login modal popup overlay widget tags form search copyright legal pagination pager toc complementary contentinfo").split()
TALK = "comment comments reply replies disqus respond discussion".split()
BOXES = frozenset("nav footer aside form menu dialog button".split())
#: Boxes that nothing inside of them turns into an article: elements and words.
HARD = BOXES | frozenset("newsletter subscribe signup cookie consent gdpr modal popup login footer".split())
#: Words that stand beside a cue in a name, joined to it or not, and don't change
#: what it means.
BESIDE = "s list lists area section box boxes wrap wrapper thread block container item items inner outer holder panel bar group row col column left right top bottom site page blog user users reader readers my the all new no unit slot link links title header head heading count".split()
#: Elements whose text decides more than a name of several words does.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote pre figure figcaption dd dt".split())
BODY = "article content post entry main story body text".split()
CUES = [*NOISE, *TALK, *BODY, "header", "meta", "byline", "author"]
_CUE, _NOISE, _TALK, _BODY = (frozenset(x) for x in (CUES, NOISE, TALK, BODY))
_KNOWN = _CUE | frozenset(BESIDE)
_LETTERS = re.compile(r"[a-z]+")
#: A cue joined to another known word: commentlist, postcomments, sitefooter.
_JOINED = {x + y: c for c in (*NOISE, *TALK) if len(c) > 5 for other in (*BESIDE, *BODY, "form") if other != "s" for x, y in ((c, other), (other, c))}


def _cues(tag: str, names: str) -> frozenset[str]:
    """The cues in an element's classes, ids and roles. On an element of text a
    name that has other words too, such as social-history, says nothing."""
    found = set()
    for name in names.split():
        words = [_JOINED.get(w, w) for w in _LETTERS.findall(name)]
        if tag not in TEXTUAL or _KNOWN.issuperset(words):
            found.update(words)
    return _CUE.intersection(found)


class Node(NamedTuple):
    """An open element, with what its ancestors and itself add up to."""

    tag: str
    tags: frozenset[str]  # those that features know
    own: str  # the innermost that is not inline
    cues: frozenset[str]
    noise: bool  # inside a box of noise, and no article or its body inside of that
    hard: bool  # inside a box that no article can be in
    talk: bool
    headed: bool  # in a header of an article
    near: tuple[int, ...]  # where the nearest of each kind of _ENDS is open, or -1


_ROOT = Node("", frozenset(), "", frozenset(), False, False, False, False, (-1,) * len(_ENDS))


class Block(NamedTuple):
    text: str
    node: Node
    linked: int  # characters inside links


def _tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag's attributes, or -1. Quotes count after =
    only; one that isn't closed, or behind a > but not before white space, / or
    another >, is none."""
    gt = html.find(">", at)
    part = html[at:gt]
    if gt < 0 or "'" not in part and part.count('"') % 2 == 0:
        return gt
    while True:
        at = _TO_VALUE.match(html, at).end()
        if at == len(html) or html[at] == ">":
            return at if at < len(html) else -1
        at = _BLANK.match(html, at + 1).end()
        quote = html[at : at + 1]
        if quote in ('"', "'") and quote:
            end = html.find(quote, at + 1)
            if end < 0 or html[end + 1 : end + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">") and ">" in html[at:end]:
                return html.find(">", at)
            at = end + 1


def _opened(tag: str, attrs: str, up: Node, depth: int) -> Node:
    cues = frozenset()
    if "=" in attrs and tag not in ("html", "body"):
        words = " ".join(x or y or z for _, x, y, z in _ATTR.findall(attrs)).lower()
        if words:
            cues = _cues(tag, words)
    near, moves = up.near, _MOVES.get(tag)
    if moves:
        near = tuple(depth if m > 0 else -1 if m < 0 else x for x, m in zip(near, moves))
    tags = up.tags | {tag} if tag in _SEEN and tag not in up.tags else up.tags
    hard = up.hard or tag in BOXES or bool(cues & HARD)
    noise = hard or bool(cues & _NOISE) or up.noise and not (tag in ("article", "main") or cues & _BODY)
    above = frozenset() if up.noise and not noise and tag in ("article", "main") else up.cues  # what an article leaves behind
    return Node(tag, tags, up.own if tag in INLINE else tag, above | cues if cues else above, noise, hard, up.talk or bool(cues & _TALK), up.headed or tag == "header" and not up.tags.isdisjoint(("article", "main")), near)


def leaf_blocks(html: str) -> list[Block]:
    """Runs of text that no block element interrupts, with what they lie in.

    Time is linear in the page, whatever its markup: ancestors are summed up as
    elements open, and nothing is searched for again once it was not found."""
    out: list[Block] = []
    stack: list[Node] = []
    count: dict[str, int] = {}
    buf: list[str] = []
    linked = hidden = 0

    def flush():
        nonlocal linked
        if buf:
            text = _SPACES.sub(" ", unescape(_HUGE_REF.sub("\ufffd", "".join(buf)))).strip()
            if text:
                out.append(Block(text, stack[-1] if stack else _ROOT, linked))
            buf.clear()
            linked = 0

    def close(to: int):
        nonlocal hidden
        while len(stack) > to:
            tag = stack.pop().tag
            count[tag] -= 1
            hidden -= tag in HIDDEN

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        end = n if lt < 0 else lt
        if end > at and not hidden:
            buf.append(html[at:end])
            if count.get("a"):
                linked += end - at
        if lt < 0:
            break
        m = _NAME.match(html, lt + 1)
        if not m:
            if html.startswith("<!--", lt):
                at = html.find("-->", lt + 2) + 3
                at = at if at > 2 else n
            elif html[lt + 1 : lt + 2] in ("!", "?"):
                at = html.find(">", lt) + 1 or n
            else:
                at = lt + 1
                if not hidden:
                    buf.append("<")
            continue
        gt = _tag_end(html, m.end())
        if gt < 0:  # no tag ends any more: the rest is text
            if not hidden:
                buf.append(html[lt:])
            break
        attrs, at = html[m.end() : gt], gt + 1
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                if tag not in INLINE:
                    flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            elif tag == "br" and not hidden:
                buf.append(" ")
            continue
        if tag not in INLINE:
            flush()
        for kind in ([] if tag in _P_STAYS else [0]) + ([_ENDED_BY[tag]] if tag in _ENDED_BY else []):
            if stack and stack[-1].near[kind] >= 0:
                flush()
                close(stack[-1].near[kind])
        if tag in VOID:
            if tag in ("br", "img", "input") and not hidden:
                buf.append(" ")
            continue
        if tag in RAW:
            raw = _RAW_END[tag].search(html, at)
            at = raw.start() if raw else n
        stack.append(_opened(tag, attrs, stack[-1] if stack else _ROOT, len(stack)))
        count[tag] = count.get(tag, 0) + 1
        hidden += tag in HIDDEN
    flush()
    return out


# -- features ----------------------------------------------------------------

_TAGS = "nav header footer aside form article main section div ul ol li table tr td th p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption dl dt dd a button label address details summary b strong em span menu dialog body".split()
_NAMES = ["bias", *(f"in:{t}" for t in _TAGS), *(f"own:{t}" for t in _TAGS), *(f"cue:{c}" for c in CUES), *(f"words:{k}" for k in range(9)), *(f"links:{k}" for k in range(5)), *(f"commas:{k}" for k in range(4)), "stop", "copyright", "first", "digits", "short_link", "no_article", "article_h1", "article_header", "noise", "noise_inside", "talk"]
_SEEN = frozenset(_TAGS)
FEATURE = {n: k for k, n in enumerate(_NAMES)}


def features(blocks: list[Block]) -> list[list[int]]:
    body = ("article", "main")
    any_article = any(not b.node.tags.isdisjoint(body) for b in blocks)
    out = []
    for k, b in enumerate(blocks):
        at = b.node
        n = b.text.count(" ") + 1
        inside = not at.tags.isdisjoint(body)
        f = {"bias", f"words:{min(8, n.bit_length())}", f"links:{min(4, 4 * b.linked // max(1, len(b.text)))}", f"commas:{min(3, b.text.count(',') + b.text.count('. '))}", f"own:{at.own}"}
        f.update(f"in:{t}" for t in at.tags)
        f.update(f"cue:{c}" for c in at.cues)
        for name, holds in (
            ("stop", b.text[-1] in ".!?…\"”"),
            ("copyright", "©" in b.text or "copyright" in b.text.lower()),
            ("first", k == 0),
            ("digits", sum(c.isdigit() for c in b.text) * 3 > len(b.text)),
            ("short_link", b.linked and n <= 4),
            ("no_article", any_article and not inside),
            ("article_h1", "h1" in at.tags and "article" in at.tags),
            ("article_header", at.headed),
            ("noise", at.noise),
            ("noise_inside", at.noise and inside),
            ("talk", at.talk),
        ):
            if holds:
                f.add(name)
        out.append([FEATURE[x] for x in f if x in FEATURE])
    return out


# -- the chain ---------------------------------------------------------------


class Crf(NamedTuple):
    """emit: a weight per feature for label 1 against 0; move: 2 x 2 transitions."""

    emit: list[float]
    move: list[list[float]]

    def decode(self, feats: list[list[int]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        w = self.emit
        (m00, m01), (m10, m11) = self.move
        back, a, b = [], 0.0, 0.0  # best scores that end in 0 and 1
        for k, f in enumerate(feats):
            e = 0.0
            for x in f:
                e += w[x]
            if k:
                fa, fb = b + m10 > a + m00, b + m11 >= a + m01
                back.append((fa, fb))
                a, b = (b + m10 if fa else a + m00), (b + m11 if fb else a + m01) + e
            else:
                b = e
        if not feats:
            return []
        cur = int(b > a)
        out = [cur]
        for fa, fb in reversed(back):
            cur = int(fb if cur else fa)
            out.append(cur)
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], l2: float = 0.002, rounds: int = 250) -> Crf:
    """Maximum likelihood with an L2 penalty: forward-backward over all pages at
    once, Adam steps."""
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(f) for f, _ in pages)
    width = max(len(x) for f, _ in pages for x in f)
    idx = np.full((n, longest, width), len(_NAMES))
    y = np.zeros((n, longest), np.int64)
    on = np.zeros((n, longest), bool)
    for p, (f, lab) in enumerate(pages):
        for t, x in enumerate(f):
            idx[p, t, : len(x)] = x
        y[p, : len(f)], on[p, : len(f)] = lab, True
    w, move = np.zeros(len(_NAMES) + 1), np.zeros((2, 2))
    mw, vw, mm, vm = np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)
    total = on.sum()
    pair_on = on[:, 1:]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:, :-1][pair_on], y[:, 1:][pair_on]), 1)
    for k in range(1, rounds + 1):
        e = w[idx].sum(axis=2)
        emit = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(on[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + move[None], axis=1) + emit[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(move[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(on[:, t + 1, None], nxt, beta[:, t + 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * on
        pair = np.exp(alpha[:, :-1, :, None] + move[None, None] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_on[:, :, None, None]
        gw = np.bincount(idx.ravel(), np.repeat(((p1 - y) * on).ravel(), width), minlength=len(w)) / total + l2 * w / 100
        gw[-1] = 0
        gm = (pair.sum(axis=(0, 1)) - seen_pairs) / total + l2 * move / 100
        for g, x, m, v in ((gw, w, mw, vw), (gm, move, mm, vm)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Crf(w[:-1].tolist(), move.tolist())


# -- labelled pages ----------------------------------------------------------


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A page made up for training: its HTML, and its blocks with labels."""
    parts: list[str] = []
    blocks: list[tuple[str, int]] = []
    vowels, cons = "aeiouàéüö", "bcdfghlmnprstvz"

    def word():
        return "".join(rng.choice(cons) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def sentence(lo, hi):
        ws = [word() + ("," if rng.random() < 0.12 else "") for _ in range(rng.randint(lo, hi))]
        return " ".join(ws).strip(",").capitalize() + "."

    def block(open_, text, close, label):
        parts.append(f"{open_}{text.replace('&', '&amp;')}{close}")
        blocks.append((text, label))

    def menu(tag, cls=""):
        parts.append(f"<{tag}{cls}><ul>")
        for _ in range(rng.randint(2, 8)):
            block(f'<li><a href="/{word()}">', " ".join(word() for _ in range(rng.randint(1, 3))), "</a></li>", 0)
        parts.append(f"</ul></{tag}>")

    def box(classes, tags="div div div section p aside"):
        tag = rng.choice(tags.split())
        key = rng.choice(["class", "class", "class", "id"])
        return f'<{tag} {key}="{rng.choice(classes)}">', f"</{tag}>"

    def talk():
        """Readers' comments, in any of the usual shapes."""
        open_, close = rng.choice([("<section {}>", "</section>"), ("<div {}>", "</div>"), ("<div {}>", "</div>"), ("<ol {}>", "</ol>"), ("<ul {}>", "</ul>")])
        name = rng.choice(["comments", "comment-list", "commentlist", "comments-area", "post-comments", "postcomments", "replies", "disqus thread", "discussion"])
        each = ("<li>", "</li>") if "l" in close[2:4] and rng.random() < 0.5 else rng.choice([('<div class="comment">', "</div>"), ('<article class="comment">', "</article>"), ('<li class="comment">', "</li>"), ('<div class="reply"><div class="body">', "</div></div>"), ("<p>", "</p>"), ('<div class="comment"><blockquote>', "</blockquote></div>")])
        alone = rng.random() < 0.25 and "comment" in each[0]
        if not alone:
            parts.append(open_.format(f'{rng.choice(["class", "id"])}="{name}"'))
            if rng.random() < 0.4:
                block("<h3>", sentence(1, 4), "</h3>", 0)
        for _ in range(rng.randint(1, 4)):
            inner = ("<p>", "</p>") if each[0] != "<p>" and rng.random() < 0.7 else ("", "")
            block(each[0] + inner[0], " ".join(sentence(2, 18) for _ in range(rng.randint(1, 3))), inner[1] + each[1], 0)
        if not alone:
            parts.append(close)

    def noise(inside=False):
        k = rng.choice(["ad", "cookie", "form", "aside", "share", "related", "newsletter", "notice", "notice", "button"] + (["talk", "talk", "footer", "nav"] if inside else ["menu"]))
        long_ = lambda: " ".join(sentence(3, 18) for _ in range(rng.randint(1, 3)))
        if k == "talk":
            talk()
        elif k in ("ad", "cookie", "notice", "newsletter"):
            names = {"ad": "ad ads advert ad-banner sponsored promo advertisement", "cookie": "cookie cookie-consent gdpr-banner", "notice": "notice alert site-notice notice-box", "newsletter": "newsletter newsletter-signup subscribe"}[k]
            open_, close = box(names.split())
            inner = ("<p>", "</p>") if not open_.startswith("<p") and rng.random() < 0.5 else ("", "")
            deep = rng.randint(0, 2) if not open_.startswith("<p") else 0
            parts.append(open_ + rng.choice(["<div>", "<div>", '<div class="content">'] if k == "newsletter" else ["<div>"]) * deep)
            for _ in range(rng.randint(1, 3) if inner[0] else 1):
                block(inner[0], long_(), inner[1], 0)
            parts.append("</div>" * deep + close)
        elif k == "button":
            block("<button>", sentence(1, 4), "</button>", 0)
        elif k == "form":
            parts.append("<form>")
            block("<label>", word(), "</label><input name=q>", 0) if rng.random() < 0.5 else block("<p>", sentence(3, 28), "</p>", 0)
            parts.append("</form>")
        elif k == "aside":
            parts.append(rng.choice(["<aside>", '<div class="sidebar">', '<div id="sidebar">']))
            end = "</aside>" if parts[-1] == "<aside>" else "</div>"
            own = rng.choice(["", "", "", "article"]) if end == "</aside>" else ""
            parts.append(f"<{own}>" if own else "")
            block("<h3>", sentence(1, 4), "</h3>", 0)
            for _ in range(rng.randint(1, 3)):
                block("<p>", sentence(4, 30), "</p>", 0)
            parts.append((f"</{own}>" if own else "") + end)
        elif k == "footer":
            open_, close = rng.choice([("<footer>", "</footer>"), ("<footer><p>", "</p></footer>"), ('<div class="footer"><p>', "</p></div>")])
            block(open_, long_(), close, 0)
        elif k == "nav":
            menu("nav") if rng.random() < 0.6 else block("<nav>", sentence(2, 12), "</nav>", 0)
        elif k == "share":
            block('<div class="share social">', " ".join(word() for _ in range(rng.randint(1, 4))), "</div>", 0)
        elif k == "menu":
            menu("div", ' class="menu"')
        else:
            parts.append('<div class="related"><ul>')
            for _ in range(rng.randint(1, 4)):
                block(f'<li><a href="/{word()}">', sentence(2, 9), "</a></li>", 0)
            parts.append("</ul></div>")

    parts.append(f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var x='<p>';</script></head><body>")
    if rng.random() < 0.5:
        parts.append(rng.choice(["<header>", '<div id="header">']))
        end = "</header>" if parts[-1] == "<header>" else "</div>"
        block("<p>", sentence(1, 6), "</p>", 0)
        if rng.random() < 0.4:
            block("<h1>", sentence(1, 4), "</h1>", 0)
        parts.append(end)
    if rng.random() < 0.85:
        menu("nav") if rng.random() < 0.7 else menu("div", ' class="nav"')
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        noise()
    shell = rng.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main" class="post">', "</div>"), ("<div>", "</div>")])
    parts.append(shell[0])
    if rng.random() < 0.9:
        own = "article" in shell[0] and rng.random() < 0.3
        parts.append("<header>" if own else "")
        block(rng.choice(["<h1>", "<h2>"]), sentence(2, 10).rstrip("."), "", 1)
        parts.append("</h1>" if "<h1>" in parts[-1] else "</h2>")
        parts.append("</header>" if own else "")
    for k in range(rng.choice([1, 2, 4, 8, 16])):
        r = rng.random()
        if r < 0.66:
            block("<p>", " ".join(sentence(1, 22) for _ in range(rng.randint(1, 5))), rng.choice(["</p>", "</p>", "</p>", "\n"]), 1)
        elif r < 0.73:
            block("<p><b>", sentence(1, 12), "<br>", 1)
        elif r < 0.79:
            block(rng.choice(["<h2>", "<h3>"]), sentence(1, 7), "", 1)
            parts.append("</h2>" if "<h2>" in parts[-1] else "</h3>")
        elif r < 0.83:
            block("<blockquote><p>", sentence(4, 25), "</p></blockquote>", 1)
        elif r < 0.87:
            parts.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                block("<li>", sentence(1, 12), "</li>", 1)
            parts.append("</ul>")
        elif r < 0.9:
            parts.append("<table><tr>")
            block("<td>", sentence(1, 6), "</td>", 1)
            block("<td>", sentence(1, 6), "</td>", 1)
            parts.append("</tr></table>")
        elif r < 0.915:
            parts.append("<div><div>")
            block(rng.choice(["<p>", "<pre>"]), sentence(2, 20), "", 1)
            parts.append("</pre></div></div>" if "<pre>" in parts[-1] else "</p></div></div>")
        elif r < 0.93:
            block("<figure><img src=x><figcaption>", sentence(2, 14), "</figcaption></figure>", 1)
        elif k:
            noise(True)
    if rng.random() < 0.25:
        talk() if rng.random() < 0.6 else noise(True)
    parts.append(shell[1])
    if rng.random() < 0.3:
        talk()
    for _ in range(rng.choice([0, 0, 1, 2])):
        noise()
    if rng.random() < 0.9:
        parts.append(rng.choice(["<footer>", '<div id="footer">']))
        end = "</footer>" if parts[-1] == "<footer>" else "</div>"
        block("", rng.choice(["© ", "", "Copyright "]) + sentence(2, 12), "", 0)
        parts.append(end)
    parts.append("</body></html>")
    return "".join(parts), blocks


def labelled(html: str, truth: list[tuple[str, int]]) -> tuple[list[list[int]], list[int]]:
    """Features and labels of a page whose blocks' labels are known in order."""
    blocks = leaf_blocks(html)
    if [b.text for b in blocks] != [t for t, _ in truth]:
        raise ValueError("the labels don't fit the page's blocks")
    return features(blocks), [y for _, y in truth]


def train(pages: int = 400, seed: int = 1) -> Crf:
    rng = random.Random(seed)
    return fit([labelled(*labelled_page(rng)) for _ in range(pages)])


# -- the operator ------------------------------------------------------------


def main_text(html: str, crf: Crf) -> str:
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, y in zip(blocks, crf.decode(features(blocks))) if y)


def extract(pages: DataFrame, crf: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page; one row per input row: page_id, url, text, n_chars.

    A page is cut into leaf blocks (text that no block element interrupts, with
    character references decoded and white space as one space), a linear-chain
    CRF labels them all at once, and the blocks of the article are joined by one
    line break in page order. The CRF is fitted on labelled pages that train()
    makes up, or given. Null, empty or markup-only pages give the empty text.
    Broken markup ends where the page ends; a quote that is not closed is none.
    Very long and deeply nested pages take time in proportion to their length.
    Repeated rows and ids get a row each; no rows give no rows; extra columns,
    whatever their names, are ignored. A map-only pass.
    """
    spark = pages.sparkSession
    ship(spark)
    of = spark.sparkContext.broadcast(crf or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = of.value
        for batch in batches:
            for c in range(0, batch.num_rows, 256):
                part = batch.slice(c, 256)
                texts = [main_text(x.as_py() or "", model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
