"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with a leaf for every run of inline text between block boundaries. Each
node is content or not; a node has a potential from its own features (tag, words of class, id and role, link density,
length, punctuation) and every parent-child edge has a potential over the two states, one table for element children
and one for text. Sum-product messages go up and down all trees of a batch, level by level in numpy, and leaves whose
marginal reaches one half are kept in page order. The potentials are trained by maximum likelihood on labelled pages:
pages composed at random from common layouts, in which every text run's label is known. An element's label is whether
it holds any content.

Defined results: null or blank html, or a page without content, gives the empty string; repeated rows and null ids get
a row each; an empty table an empty result; broken markup is read as browsers read it (implied ends, stray ends
ignored, an unfinished tag at the end dropped; of a button, svg, select and the like without an end of its own only
the text right after its tag is dropped); the whole html is read whatever its length.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from versoscan.llm import words as W
from versoscan.llm.shared import table

# fixed names of the markup language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose mfenced merror mmultiscripts semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input object math".split()) | MATH
DROPPED = frozenset("head script style template noscript iframe svg canvas select button textarea audio video map title noembed noframes xmp datalist annotation annotation-xml".split())
FOREIGN = frozenset("svg annotation annotation-xml".split())  # of the dropped ones, those that a slash at the tag's end closes
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+\Z", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'>]+/\Z")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What words in class, id and role say, by kind.
HINTS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs tabbar toolbar sitemap skip",
    "header": "header masthead banner topbar logo branding tagline",
    "footer": "footer copyright legal contentinfo colophon imprint",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular complementary more readmore teaser teasers tags",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe subscription paywall announcement toast disclaimer warning privacy",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense commercial",
    "comment": "comment comments commentlist reply replies disqus discussion respond responses feedback reader",
    "form": "form search login signin signup register contact",
    "share": "share sharing social follow likes",
    "body": "article content contents post entry story main body text prose articlebody maincontent hentry",
}
HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}


BARE = 0.3  # share of training pages without any names


class Page(NamedTuple):
    """parent and features of every node (parents come first), and the text of leaves (None for elements)."""

    parent: list[int]
    features: list[list[str]]
    text: list[str | None]


@functools.lru_cache(100_000)
def hints(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and m.start() and not attributes[m.start() - 1].isspace():
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.add("hidden")
        elif name != "style":
            found.update(HINT[p] for w in PART.findall(value) if (p := w.lower()) in HINT)
    return tuple(sorted(found))


def closes_itself(start_tag: str) -> bool:
    """Whether a foreign element's tag ends with a slash that isn't part of an unquoted value."""
    return start_tag.endswith("/") and not UNQUOTED_SLASH.search(start_tag)


def element_ends(source: str, tag: str) -> dict[int, int]:
    """Where each well-matched element of this name ends, by the end of its start tag."""
    ends, open_ = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", source, re.I):
        if not m[1]:
            if not (tag in FOREIGN and closes_itself(m[0][:-1])):
                open_.append(m.end())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


def closers(source: str) -> dict[int, int]:
    """Where the end tag that fits each start tag stands, by the start tag's place; at -1 the place of the first </body>."""
    found: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for m in TAG.finditer(source):
        tag = m[2].lower()
        if not m[1]:
            open_.setdefault(tag, []).append(m.start())
        elif open_.get(tag):
            found[open_[tag].pop()] = m.start()
        elif tag == "body":
            found.setdefault(-1, m.start())
    for at in open_.get("body", ()):
        found.pop(at, None)
    return found


def parse(source: str) -> Page:
    parent, tags, marks, text = [-1], ["body"], [()], [None]
    words, linked = [0], [0]
    open_: list[tuple[str, int]] = [("body", 0)]  # tag and node; -1 for inline
    begun = [-1]  # where the start tag of each open element stands
    outer: list[float] = []  # the first end tag of the open block elements up to each, once it is asked for
    fits: dict[int, int] = {}
    counts: dict[str, int] = {}
    ends: dict[str, dict[int, int]] = {}  # of dropped elements, by tag
    here = 0  # the innermost block element
    pieces: list[str] = []
    run_words = run_linked = links = 0

    def flush() -> None:
        nonlocal run_words, run_linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                parent.append(here)
                tags.append(tags[here])
                marks.append(marks[here])
                text.append(joined)
                words.append(len(joined.split(" ")))
                linked.append(min(run_linked, words[-1]))
            pieces.clear()
        run_words = run_linked = 0

    def say(part: str) -> None:
        nonlocal run_linked
        if part:
            part = html.unescape(part) if "&" in part else part
            pieces.append(part)
            if links:
                run_linked += len(part.split())

    def pop() -> None:
        nonlocal here, links
        tag, node = open_.pop()
        begun.pop()
        del outer[len(open_) :]
        counts[tag] -= 1
        if node >= 0:
            flush()
            here = next(n for _, n in reversed(open_) if n >= 0)
        elif tag == "a":
            links -= 1

    def close_until(targets: set[str] | frozenset[str], limits: set[str]) -> None:
        """Closes the innermost of targets, if one is open above the limits."""
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] in targets:
                while len(open_) > i:
                    pop()
                return
            if open_[i][0] in limits:
                return

    def first_end() -> float:
        """Where the first end tag stands that closes one of the open block elements."""
        if not fits:
            fits.update(closers(source) or {-2: 0})
        for k in range(len(outer), len(open_)):
            own = fits.get(begun[k], stop + 1) if open_[k][1] >= 0 else stop + 1
            outer.append(min(own, outer[-1]) if outer else own)
        return outer[-1]

    at = 0
    stop = len(source)
    while at < stop:
        m = TOKEN.search(source, at)
        say(source[at : m.start() if m else stop])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in DROPPED:
            if closing or (tag in FOREIGN and closes_itself(m[3])):
                continue
            if tag not in RAW and tag != "head":
                if tag not in ends:
                    ends[tag] = element_ends(source, tag)
                end = ends[tag].get(at)
                if end is None or first_end() < end:
                    end = source.find("<", at)  # without an end of its own: only the text right after it goes
                at = end if end >= 0 else stop
                if tag not in ("template", "noscript"):
                    pieces.append(" ")
            else:
                # on to its end, counting elements of the same name inside it
                inner = re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I)
                depth = 1
                if tag == "head":
                    inner = re.compile(r"<(?:(/)head(?=[\s/>])|(?=body[\s/>]))[^>]*+>?", re.I)
                while depth and (e := inner.search(source, at)):
                    if tag == "head" and not e[1]:
                        at = e.start()
                        break
                    depth += -1 if e[1] else (0 if tag in RAW else 1)
                    at = e.end()
                else:
                    at = at if not depth or tag == "head" else stop
                if tag != "head" and tag not in ("script", "style", "template", "noscript", "title"):
                    pieces.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        if closing:
            if tag == "br":
                pieces.append(" ")
            elif counts.get(tag):
                if tag in INLINE:
                    for i in range(len(open_) - 1, 0, -1):
                        if open_[i][1] >= 0:
                            break
                        if open_[i][0] == tag:
                            while len(open_) > i:
                                pop()
                            break
                else:
                    close_until({tag}, {"table"} if tag not in ("table", "body") and tag in ("p", "li") else set())
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                if counts.get("p"):
                    close_until({"p"}, {"table"})
                flush()
            continue
        if tag in INLINE:
            if tag == "a" and counts.get("a"):
                close_until({"a"}, set())
            open_.append((tag, -1))
            begun.append(m.start())
            counts[tag] = counts.get(tag, 0) + 1
            links += tag == "a"
            continue
        if counts.get("p") and tag in CLOSES_P:
            close_until({"p"}, {"table", "td", "th", "button"})
        if tag in IMPLIED:
            close_until(*IMPLIED[tag])
        flush()
        parent.append(here)
        tags.append(tag)
        marks.append(hints(m[3]) if m[3] else ())
        text.append(None)
        words.append(0)
        linked.append(0)
        here = len(parent) - 1
        open_.append((tag, here))
        begun.append(m.start())
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    return Page(parent, describe(parent, tags, marks, text, words, linked), text)


def describe(parent: list[int], tags: list[str], marks: list[tuple[str, ...]], text: list[str | None], words: list[int], linked: list[int]) -> list[list[str]]:
    n = len(parent)
    all_words, all_linked, paragraphs, depth = words[:], linked[:], [0] * n, [0] * n
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        all_words[p] += all_words[i]
        all_linked[p] += all_linked[i]
        paragraphs[p] += tags[i] == "p" and text[i] is None
    out = []
    for i in range(n):
        share = 0 if not all_words[i] else min(3, int(4 * all_linked[i] / all_words[i]))
        size = min(9, all_words[i].bit_length())
        if text[i] is None:
            f = [f"E {tags[i]}", f"E links {share}", f"E words {size}", f"E {min(3, paragraphs[i])} p", *(f"E is {k}" for k in marks[i])]
            if i:
                f.append(f"E {tags[parent[i]]}>{tags[i]}")
        else:
            t = text[i]
            f = [f"T {tags[i]}", f"T links {share} words {min(size, 6)}", f"T ends {t[-1] in '.!?:;…。'}", *(f"T in {k}" for k in marks[i])]
            if "©" in t:
                f.append("T ©")
            if depth[i] < 2:
                f.append("T loose")
        out.append(f)
    return out


class Forest(NamedTuple):
    """Trees of many pages in one array each; levels[d] lists the nodes d edges below a root."""

    parent: np.ndarray
    leaf: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray  # nodes x most features, padded by the index that weighs nothing


class Model(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray  # how much a feature speaks for content; one more for padding
    edges: np.ndarray  # kind of child (element, text) x parent's state x child's state


def gather(pages: list[Page], index: dict[str, int]) -> Forest:
    none = len(index)
    sizes = [len(p.parent) for p in pages]
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = np.array([x for p in pages for x in p.parent])
    root = parent < 0
    parent = parent + base
    rows = [[index.get(f, none) for f in fs] for p in pages for fs in p.features]
    features = np.full((len(rows), max(map(len, rows))), none)
    for i, r in enumerate(rows):
        features[i, : len(r)] = r
    levels, depth, d = [np.flatnonzero(root)], np.where(root, 0, -1), 0
    waiting = np.flatnonzero(~root)
    while len(waiting):
        now = depth[parent[waiting]] == d
        d += 1
        levels.append(waiting[now])
        depth[waiting[now]] = d
        waiting = waiting[~now]
    return Forest(parent, np.array([t is not None for p in pages for t in p.text]), levels, features)


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(*np.moveaxis(a, axis, 0))


def propagate(forest: Forest, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log beliefs of all nodes after messages upward and then downward, those messages up, and each node's edge table."""
    belief = np.zeros((len(forest.parent), 2))
    belief[:, 1] = model.weights[forest.features].sum(axis=1)
    up = np.zeros_like(belief)
    table_ = model.edges[forest.leaf.astype(int)]
    for nodes in reversed(forest.levels[1:]):
        up[nodes] = log_sum(table_[nodes] + belief[nodes][:, None, :], 2)
        np.add.at(belief, forest.parent[nodes], up[nodes])
    for nodes in forest.levels[1:]:
        above = belief[forest.parent[nodes]] - up[nodes]
        belief[nodes] += log_sum(table_[nodes] + above[:, :, None], 1)
    return belief, up, table_


def marginals(forest: Forest, model: Model) -> np.ndarray:
    belief = propagate(forest, model)[0]
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def fit(pages: list[Page], labels: list[list[bool]], rounds: int = 90, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """Maximum likelihood; labels are those of each page's leaves, in order."""
    index = {f: i for i, f in enumerate(sorted({f for p in pages for fs in p.features for f in fs}))}
    forest = gather(pages, index)
    y = np.zeros(len(forest.parent), bool)
    y[forest.leaf] = np.concatenate([np.array(x, bool) for x in labels])
    for nodes in reversed(forest.levels[1:]):
        np.logical_or.at(y, forest.parent[nodes], y[nodes])
    y[forest.levels[0]] = True
    child = np.concatenate(forest.levels[1:])
    gold = np.zeros((2, 2, 2))
    np.add.at(gold, (forest.leaf[child].astype(int), y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    parts = [np.zeros(len(index) + 1), np.zeros((2, 2, 2))]
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in parts]
    order = np.argsort(forest.features.reshape(-1), kind="stable")
    node = order // forest.features.shape[1]
    present, first = np.unique(forest.features.reshape(-1)[order], return_index=True)
    for step in range(1, rounds + 1):
        model = Model(index, *parts)
        belief, up, tables = propagate(forest, model)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        z = log_sum(belief, 1)
        # an edge's joint belief: the parent without this child, the table, the child without its parent
        down = log_sum(tables[child] + (belief[forest.parent[child]] - up[child])[:, :, None], 1)
        joint = (belief[forest.parent[child]] - up[child])[:, :, None] + tables[child] + (belief[child] - down)[:, None, :]
        joint = np.exp(joint - z[forest.parent[child]][:, None, None])
        got = np.stack([joint[forest.leaf[child] == k].sum(axis=0) for k in (False, True)])
        slope = [np.zeros_like(parts[0]), gold - got]
        slope[0][present] = np.add.reduceat((y - p)[node], first)
        for part, g, (m, v) in zip(parts, slope, memory, strict=True):
            g = g / len(pages) - decay * part
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            part += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        parts[0][-1] = 0
    return Model(index, *parts)


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page composed at random from common layouts, and its content blocks in page order."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(1, 9)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: some(4, 18).capitalize() + r.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 6)))
    bare = r.random() < BARE  # plain divs without names: links and short lines around, sentences inside
    content: list[str] = []
    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
    titles = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{some(3, 10).capitalize()}</a></li>' for _ in range(r.randint(2, 6))) + "</ul>"
    links = lambda: titles() if r.random() < 0.15 else "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"

    def named(kind: str, *tags: str) -> tuple[str, str]:
        """An opening and a closing tag: an element of that meaning, or a plain one with a telling name."""
        if bare:
            return "<div>", "</div>"
        names = [n for n in HINTS[kind].split() if n not in ("body", "main") or r.random() < 0.5]
        if tags and r.random() < 0.5:
            tag = r.choice(tags)
            return (f"<{tag}>" if r.random() < 0.6 else f'<{tag} {r.choice(("class", "id"))}="{r.choice(names)}">'), f"</{tag}>"
        tag = r.choice(("div", "div", "div", "section", "ul" if kind == "nav" else "div"))
        name = r.choice(names) + r.choice(("", "", f"-{word()}", "-wrapper", f" {word()}"))
        return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">', f"</{tag}>"

    def keep(text: str, wrap: str = "{}") -> str:
        content.append(text)
        return wrap.format(text)

    def block(kind: str, inside: str, *tags: str) -> str:
        a, b = named(kind, *tags)
        return a + inside + b

    def heading(least: int, most: int) -> str:
        tag = r.choice(("h2", "h3", "h3", "h3", "h4"))
        return f"<{tag}>{some(least, most)}</{tag}>"

    def ad() -> str:
        return block("side", links()) if bare else block("ad", r.choice([sentence(), some(2, 8), prose(), f"<p>{sentence()}</p>", link()]))

    def notice() -> str:
        return block("side", links()) if bare else block("notice", r.choice([f"<p>{prose()}</p>", sentence(), f"<p>{sentence()}</p><button>{word()}</button>", f"{heading(1, 4)}<p>{sentence()}</p>" + r.choice(("", "<form><input></form>"))]), "dialog")

    def form() -> str:
        return r.choice([f"<form><label>{some(1, 3)}</label><input type=text><p>{sentence()}</p></form>", f'<form class="search"><input><button>{word()}</button>{some(1, 4)}</form>', f"<form><fieldset><legend>{some(1, 3)}</legend><label>{some(1, 2)}</label><div>{sentence()}</div></fieldset></form>"])

    def side() -> str:
        return block("side", links()) if bare else block("side", heading(1, 4) + r.choice([links(), f"<p>{sentence()}</p>", f"<p>{prose()}</p>", links() + f"<p>{prose()}</p>"]), "aside", "aside")

    def comments() -> str:
        one = r.choice(["<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment">{}</article>', "<div>{}</div>", "{}", "<article>{}</article>"])
        made = "".join(one.format(r.choice([f"<p>{prose()}</p>", f"<b>{word()}</b><p>{sentence()}</p>", prose()])) for _ in range(r.randint(1, 6)))
        a, b = f'<{(t := r.choice(("div", "section", "ol", "div")))} {r.choice(("class", "id"))}="{r.choice(HINTS["comment"].split()) + r.choice(("", "-list", " " + word()))}">', f"</{t}>"
        return a + (f"<h3>{some(1, 3)}</h3>" if r.random() < 0.6 else "") + made + b

    out = ["<!DOCTYPE html><html><head><title>x</title><script>var a='<p>';</script></head><body>"]
    cells = not bare and r.random() < 0.06  # laid out by a table: menu, article and footer are its cells
    if r.random() < 0.15:
        out.append(f'<a{r.choice(("", " class=skip", " class=skip-link"))} href="#{word()}">{some(1, 4)}</a>')
    if r.random() < 0.25:
        out.append(notice())
    if r.random() < 0.1:
        out.append(r.choice(("<center>{}</center>", "<p>{}</p>", "<div>{}</div>")).format(r.choice((" - ", " | ", " ", "<br>")).join(link() for _ in range(r.randint(2, 6)))) + "<hr>" * (r.random() < 0.4))
    if cells:
        out.append(f'<table><tr><td class="{r.choice(HINTS["nav"].split())}">' + r.choice(("<br>", " ")).join(link() for _ in range(r.randint(2, 6))) + "</td>")
    elif r.random() < 0.6:
        out.append(block("header", r.choice([f"<h1>{some(1, 3)}</h1>", heading(1, 3), f"<p>{some(2, 6)}</p>", f"<div>{some(1, 3)}</div>" + links(), link(), f"<h1>{some(1, 3)}</h1><p>{sentence()}</p>"]), "header", "header"))
    if r.random() < 0.85:
        out.append(block("nav", r.choice([links(), "".join(link() for _ in range(5)), " | ".join(link() for _ in range(4))]), "nav", "nav", "nav", "menu"))
    if r.random() < 0.5:
        out.append(ad())
    before = r.random() < 0.3
    if before:
        out.append(side())
    a, b = ("<td>", "</td></tr>") if cells else r.choice([("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", "")]) if bare else r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), named("body", "article", "main"), named("body", "article"), ("<div>", "</div>"), ('<div id="page"><article class="post">', "</article></div>"), ("<table><tr><td>", "</td></tr></table>")])
    out.append(a)
    if r.random() < 0.85:
        title = keep(some(2, 9).capitalize())
        out.append(r.choice([f"<h1>{title}</h1>"] * 3 + [f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>"]))
        if not bare and r.random() < 0.12:  # a line below the title, in the article's own header
            out[-1] = f"<header><h1>{title}</h1>" + keep(r.choice((sentence(), some(3, 12))), r.choice(("<p>{}</p>", f"<p class={word()}>{{}}</p>"))) + "</header>"
    for _ in range(r.randint(1, 9)):
        x = r.random()
        if x < 0.62:
            text = prose() if r.random() < 0.85 else some(1, 8)
            if not a and r.random() < 0.3:  # text of the body itself
                out.append(keep(text, "<hr>{}<hr>"))
                continue
            plain = r.choice(("<div>", "<div>", f'<div class="{word()}">', f'<div class="{word()} {word()}-{word()}">', "<section>", "<div><div>", "<figure>"))
            wrapped = f"{plain}<p>{{}}</p>" + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", plain)))  # as many editors write each block
            out.append(keep(text, r.choice(["<p>{}</p>"] * 5 + ["<p><b>{}<br>", "<div>{}</div>", "<p>{}"] + [wrapped] * 3 * (not bare) + ["<div>{}</div>"] * 6 * bare)))
        elif x < 0.68:
            out.append(keep(some(1, 6).capitalize(), "<h2>{}</h2>"))
        elif x < 0.74:
            out.append("<ul>" + "".join(keep(r.choice([sentence(), some(1, 6)]), "<li>{}</li>") for _ in range(r.randint(1, 4))) + "</ul>")
        elif x < 0.78:
            out.append(keep(prose(), "<blockquote>{}</blockquote>") if r.random() < 0.6 else "<blockquote>" + keep(prose(), "<p>{}</p>") + keep(some(1, 5), r.choice(("<footer>{}</footer>", "<p>{}</p>"))) + "</blockquote>")
        elif x < 0.81:
            out.append("<table><tr>" + "".join(keep(some(1, 3), "<td>{}</td>") for _ in range(3)) + "</tr></table>")
        elif x < 0.84:
            out.append(keep(some(3, 9), "<figure><img src=x><figcaption>{}</figcaption></figure>"))
        elif x < 0.85 and not bare:  # a section on what its name says elsewhere
            names = [n for kind in ("footer", "notice", "form") for n in HINTS[kind].split() if n not in ("modal", "overlay", "dialog", "popup", "toast", "footer")]
            out.append(f'<section {r.choice(("class", "id"))}="{r.choice(names)}">' + keep(some(2, 6).capitalize(), "<h2>{}</h2>") + "".join(keep(prose(), "<p>{}</p>") for _ in range(r.randint(1, 3))) + "</section>")
        elif x < 0.865 and not bare:  # a paragraph that is one link, or nearly
            linked = f"<a href=/x>{(t := sentence()[:-1])}</a>"
            text = r.choice(["{}.", "{}", f"{some(1, 3).capitalize()} {{}} {some(1, 3)}."])
            content.append(text.format(t))
            out.append(f"<p>{text.format(linked)}</p>")
        elif x < 0.89:
            text = f"{some(2, 9)} {(t := word() if r.random() < 0.6 else some(3, 12))} {some(1, 7)}."
            content.append(text)
            out.append(f"<p>{text.replace(t, f'<a href=/x>{t}</a>', 1) if t not in text.replace(' ' + t + ' ', ' ', 1) else text}</p>")
        elif x < 0.92:
            out.append(ad())
        elif x < 0.94:
            out.append(block("share", "".join(link() for _ in range(3))))
        elif x < 0.96:
            out.append(form())
        elif x < 0.98:
            out.append(notice())
        else:
            out.append(side())
    inside = r.random() < 0.3
    tail = comments() if r.random() < 0.4 and not bare and not cells else ""
    out += [tail, b] if inside else [b, tail]
    if cells:
        out.append(f'<tr><td colspan=2 class="{r.choice(HINTS["footer"].split())}">{r.choice((some(2, 7), sentence()))}</td></tr></table>')
    if not before and r.random() < 0.4:
        out.append(side())
    if r.random() < 0.2:
        out.append(form())
    if r.random() < 0.2:
        out.append(ad())
    if r.random() < 0.15:
        out.append(notice())
    if r.random() < 0.1:
        out.append("<hr>" * (r.random() < 0.5) + f"<address>{r.choice((some(2, 8), sentence()))}</address>")
    if r.random() < 0.85 and not cells:
        out.append(block("footer", r.choice([f"<ul><li>{sentence()}</li><li>{link()}</li></ul>", f"<p>{some(2, 6)}</p>", f"&copy; {word()} &middot; {some(1, 3)}", links(), f"{some(2, 5)} &copy; 2024", f"<p>{sentence()}</p>" + links(), some(1, 8)]), "footer", "footer", "footer"))
    return "".join(out) + "</body></html>", content


def labelled_pages(n: int, seed: int) -> tuple[list[Page], list[list[bool]]]:
    pages, labels = [], []
    for i in range(n):
        source, content = labelled_page(seed * 100_000 + i)
        page = parse(source)
        wanted = [" ".join(c.split()) for c in content]
        marks, k = [], 0
        for t in page.text:
            if t is not None:
                marks.append(k < len(wanted) and t == wanted[k])
                k += marks[-1]
        if k == len(wanted):  # else its markup split a block in two
            pages.append(page)
            labels.append(marks)
    return pages, labels


@functools.cache
def trained(n: int = 500) -> Model:
    return fit(*labelled_pages(n, 1))


def main_texts(sources: list[str], model: Model) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    probability = marginals(gather(pages, model.index), model)
    out, at = [], 0
    for page in pages:
        out.append("\n\n".join(t for t, p in zip(page.text, probability[at : at + len(page.text)], strict=True) if t is not None and p >= 0.5))
        at += len(page.text)
    return out


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html), in one narrow pass."""
    model = model or trained()
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, "html", 1 << 20):
            texts = main_texts(part.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url string, text string, n_chars long")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
