"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element of a page is a binary variable, content or boilerplate. Its own potential comes from its tag,
the words in its class and id, and the length and links of its text; parent-child potentials make neighbours agree
as far as training says. Sum-product messages go up the tree and down again, exactly, and give each node the marginal
probability of being content. Both kinds of potentials are fitted by maximum likelihood on labelled pages.

A batch of pages is one forest: messages are passed one depth at a time for all pages together.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Elements whose inside is not text of the page, and elements without an inside. Fixed values.
_RAW = ("script", "style", "title", "textarea")
_DROPPED = ("noscript", "template", "iframe", "object", "svg", "canvas", "math", "select", "datalist", "audio", "video",
            "map")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt
ruby s samp small span strike strong sub sup time tt u var wbr""".split())
# An element of the first kind ends an open one of the second, up to the elements of the third. Fixed values.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_KINDS = ("body main article section div p heading list li table row cell quote pre figure caption nav header footer "
          "aside form control dialog details address other").split()
_KIND_OF = {
    "html": "body", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "dt": "li", "dd": "li", "tr": "row",
    "thead": "row", "tbody": "row", "tfoot": "row", "td": "cell", "th": "cell", "blockquote": "quote",
    "figcaption": "caption", "button": "control", "input": "control", "fieldset": "form", "legend": "control",
    "label": "control", "option": "control", "output": "control", "summary": "details",
    **{f"h{n}": "heading" for n in range(1, 7)},
}
# Words in class, id, role and aria-label that hint at a purpose. Fixed values.
_HINTS = {
    "advert": "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
              "outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay interstitial paywall toast "
              "announcement dialog",
    "comment": "comment comments commentlist reply replies discussion disqus respond responses reviews forum",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip",
    "side": "sidebar side aside widget related recommended recommendations popular trending more teaser rail "
            "complementary",
    "share": "share sharing social follow tweet facebook twitter tags tag meta byline author",
    "head": "header masthead topbar logo branding site-header",
    "foot": "footer foot copyright legal colophon contentinfo site-footer bottom",
    "form": "form search login signin signup subscribe subscription newsletter register contact",
    "hidden": "hidden sr-only visually-hidden screen-reader-text",
    "content": "content article post entry story main body text prose page entry-content post-content "
               "article-body post-body story-body articlebody",
}
_HINT_OF = {word: name for name, words in _HINTS.items() for word in words.split()}
_ELEMENT = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join([*_RAW, *_DROPPED]) + r")(?=[\s/>])[^>]*+>"
    rf"|{_ELEMENT}"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE)
_ELEMENT_TAG = re.compile(_ELEMENT)
_END_OF = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in [*_RAW, *_DROPPED]}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LABEL = "data-label"
_STATES = {"content": 1, "boilerplate": 0}


@dataclass
class Page:
    """Block elements in page order, parents before children, and the text blocks between their edges."""

    parent: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    hints: list[frozenset] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def _hints(attributes: str) -> tuple[frozenset, str | None]:
    found, label = set(), None
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if name == LABEL:
            label = value
        elif name == "hidden" or name == "style" and "none" in value and "display" in value:
            found.add("hidden")
        elif name in ("class", "id", "role", "aria-label", "itemprop"):
            for word in value.split():
                parts = [word.lower(), *re.split(r"[-_]", word.lower()), *(p.lower() for p in _PART.findall(word))]
                found.update(_HINT_OF[p] for p in parts if p in _HINT_OF)
    return frozenset(found), label


def parse(source: str) -> Page:
    """The page's blocks. Every block element starts and ends a text block; inline elements do not.

    The places of open elements are kept by name, and an end tag that was not found is not looked for again, so that
    the time is in proportion to the page, whatever is left open in it.
    """
    page = Page([-1], ["body"], [frozenset()], [-1])
    stack: list[tuple[str, int]] = [("html", 0)]
    places: dict[str, list[int]] = {}
    endless: set[str] = set()
    run: list[str] = []
    in_link = linked = 0

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            page.text.append(text)
            page.owner.append(stack[-1][1])
            page.linked.append(min(linked, len(text)))
        run, linked = [], 0

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    def last(names: Sequence[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def characters(piece: str) -> None:
        nonlocal linked
        if piece:
            run.append(piece)
            linked += in_link and len(piece.strip())

    at, least, stop = 0, 0, source.rfind(">") + 1
    # Nothing behind the last bracket is a whole tag.
    while m := _TAG.search(source, least, stop):
        characters(source[at:m.start()])
        at = least = m.end()
        if m[1]:
            name = m[1].lower()
            end = None if name in endless else _END_OF[name].search(source, at)
            if end or name in _RAW:
                at = least = end.end() if end else len(source)
                continue
            # Without an end it is an element like others.
            endless.add(name)
            m, tag_at = _ELEMENT_TAG.match(source, m.start()), m.start()
            if not m:
                at, least = tag_at, tag_at + 1
                continue
            at = least = m.end()
            closing, tag, attributes = m[1], m[2].lower(), m[3]
        elif m[3] is None:
            if m.end() == stop and source.startswith("<!--", m.start()) and not m[0].endswith("-->"):
                at = least = len(source)
            continue
        else:
            closing, tag, attributes = m[2], m[3].lower(), m[4]
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                run.append(" ")
            continue
        if closing:
            depth = last((tag,))
            if depth and tag not in ("html", "body"):
                close(depth)
            else:
                flush()
            continue
        if tag in ("html", "body"):
            flush()
            found, label = _hints(attributes)
            page.hints[0] |= found
            page.label[0] = _STATES.get(label, page.label[0])
            continue
        ended, within = _CLOSES.get(tag, ((), ()))
        if tag not in _VOID or tag == "hr":
            # A paragraph has no block inside; list items, rows and cells end the one before them.
            apart = last(within)
            # The outermost of those that the tag ends, and a paragraph right above.
            open_ = [found[bisect_right(found, apart)] for name in ended if (found := places.get(name, ())) and found[-1] > apart]
            if stack[-1][0] == "p" and len(stack) - 1 > apart:
                open_.append(len(stack) - 1)
            target = min(open_, default=0)
            if target:
                close(target)
        flush()
        in_link = 0
        found, label = _hints(attributes)
        parent = stack[-1][1]
        number = len(page.parent)
        page.parent.append(parent)
        page.kind.append(_KIND_OF.get(tag, tag if tag in _KINDS else "other"))
        page.hints.append(found)
        page.label.append(_STATES.get(label, page.label[parent]))
        if tag not in _VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, number))
    # A tag that is cut off at the end of the page is markup, not text.
    rest = source[at:]
    cut = re.search(r"<[a-zA-Z/!?][^<]*\Z", rest)
    characters(rest[:cut.start()] if cut else rest)
    flush()
    return page


_FEATURES = ([f"kind {k}" for k in _KINDS] + [f"hint {h}" for h in _HINTS]
             + [f"length {n}" for n in range(5)] + [f"links {n}" for n in range(3)]
             + [f"below {n}" for n in range(5)] + [f"links below {n}" for n in range(3)]
             + ["sentence", "copyright", "bare list", "bias"])
_PLACE = {name: at for at, name in enumerate(_FEATURES)}
#: Children are tied to their parent by one table of potentials per kind of child.
_TIES = ("holder", "text", "off", "main")


@dataclass
class Forest:
    """Block elements of several pages: active features (node, feature), parents, depths, ties and labels."""

    size: int
    row: np.ndarray
    column: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]
    tie: np.ndarray
    label: np.ndarray
    first: np.ndarray


def forest(pages: Sequence[Page]) -> Forest:
    first = np.concatenate(([0], np.cumsum([len(p.parent) for p in pages]))).astype(int)
    size = int(first[-1])
    parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, f, 0)
                             for p, f in zip(pages, first)]) if pages else np.zeros(0, int)
    own, own_links = np.zeros(size), np.zeros(size)
    pairs: list[tuple[int, int]] = []
    tie = np.zeros(size, int)
    for page, base in zip(pages, first):
        for at, (kind, found) in enumerate(zip(page.kind, page.hints)):
            pairs.append((base + at, _PLACE[f"kind {kind}"]))
            pairs += [(base + at, _PLACE[f"hint {h}"]) for h in found]
            if found - {"content"} or kind in ("nav", "header", "footer", "aside", "form", "dialog"):
                tie[base + at] = 2
            elif kind in ("article", "main") or "content" in found:
                tie[base + at] = 3
        for text, owner, linked in zip(page.text, page.owner, page.linked):
            own[base + owner] += len(text)
            own_links[base + owner] += linked
            if text[-1] in ".!?…。":
                pairs.append((base + owner, _PLACE["sentence"]))
            if "©" in text or "copyright" in text[:80].lower():
                pairs.append((base + owner, _PLACE["copyright"]))
    tie[(tie == 0) & (own > 0)] = 1
    depth = np.zeros(size, int)
    for at in range(size):
        if parent[at] >= 0:
            depth[at] = depth[parent[at]] + 1
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1]) if size else []
    below, below_links = own.copy(), own_links.copy()
    for level in reversed(levels[1:]):
        np.add.at(below, parent[level], below[level])
        np.add.at(below_links, parent[level], below_links[level])
    node = np.arange(size)
    bins = np.array([1, 25, 80, 300])
    shares = np.array([0.2, 0.6])
    columns = [_PLACE["length 0"] + np.searchsorted(bins, own, side="right"),
               _PLACE["links 0"] + np.searchsorted(shares, own_links / np.maximum(own, 1)),
               _PLACE["below 0"] + np.searchsorted(bins, below, side="right"),
               _PLACE["links below 0"] + np.searchsorted(shares, below_links / np.maximum(below, 1)),
               np.full(size, _PLACE["bias"])]
    unique = np.array(sorted(set(pairs)), int).reshape(-1, 2)
    return Forest(size, np.concatenate([unique[:, 0], *[node] * len(columns)]),
                  np.concatenate([unique[:, 1], *columns]), parent, levels, tie,
                  np.concatenate([p.label for p in pages]) if pages else np.zeros(0, int), first)


@dataclass(frozen=True)
class Model:
    """Log potentials: per feature for being content, and per tie a table [parent state, child state]."""

    node: np.ndarray
    tie: np.ndarray


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(trees: Forest, model: Model, evidence: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product: P(node state), P(parent state, child state) per child, and the log partition sum.

    ``evidence`` adds to the log potentials, for labelled states.
    """
    local = np.zeros((trees.size, 2))
    local[:, 1] = np.bincount(trees.row, weights=model.node[trees.column], minlength=trees.size)
    if evidence is not None:
        local = local + evidence
    up = local.copy()
    message = np.zeros((trees.size, 2))
    for level in reversed(trees.levels[1:]):
        # What a child tells its parent about each state of the parent.
        message[level] = _log_add(model.tie[trees.tie[level]] + up[level][:, None, :], 2)
        np.add.at(up, trees.parent[level], message[level])
    belief = up.copy()
    both = np.zeros((trees.size, 2, 2))
    roots = trees.levels[0] if trees.levels else np.zeros(0, int)
    total = float(_log_add(up[roots], 1).sum()) if len(roots) else 0.0
    for level in trees.levels[1:]:
        # What the parent knows without this child, passed down.
        rest = belief[trees.parent[level]] - message[level]
        joint = rest[:, :, None] + model.tie[trees.tie[level]] + up[level][:, None, :]
        belief[level] = _log_add(joint, 1)
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        both[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
    state = np.exp(belief - _log_add(belief, 1)[:, None]) if trees.size else belief
    return state, both, total


def fit(pages: Sequence[str], rounds: int = 200, rate: float = 0.15, decay: float = 2e-5) -> Model:
    """Maximum likelihood on pages whose elements carry ``data-label`` (content or boilerplate; inherited).

    The gradient is the difference of two passes of messages, with and without the labels as evidence.
    """
    trees = forest([parse(p) for p in pages])
    evidence = np.zeros((trees.size, 2))
    evidence[trees.label == 1, 0] = -1e6
    evidence[trees.label == 0, 1] = -1e6
    # One vector of all potentials, moved along running means of the gradient (Adam).
    size, ties = len(_FEATURES), (len(_TIES), 2, 2)
    point = np.zeros(size + int(np.prod(ties)))
    drift, spread = np.zeros_like(point), np.zeros_like(point)
    for number in range(1, rounds + 1):
        model = Model(point[:size], point[size:].reshape(ties))
        free, free_both, _ = marginals(trees, model)
        held, held_both, _ = marginals(trees, model, evidence)
        push = np.bincount(trees.column, weights=(held - free)[trees.row, 1], minlength=size)
        pull = np.stack([(held_both - free_both)[trees.tie == t].sum(axis=0) for t in range(len(_TIES))])
        slope = np.concatenate([push, pull.ravel()]) / max(1, trees.size) - decay * point
        drift = 0.9 * drift + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        point = point + rate * (drift / (1 - 0.9**number)) / (np.sqrt(spread / (1 - 0.99**number)) + 1e-9)
    return Model(point[:size], point[size:].reshape(ties))


def labelled_pages(count: int = 400, seed: int = 17) -> list[str]:
    """Pages of many layouts, made by rule, whose elements say whether they are content."""
    draw = Random(seed)
    syllables = "ba de fi go ku la me ni po ru sa ti vo wa ze on er an".split()
    known = ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(600)]

    def pick(*options):
        return draw.choice(options)

    def some(chance: float) -> bool:
        return draw.random() < chance

    def word() -> str:
        return draw.choice(known)

    def words(low: int, high: int) -> str:
        return " ".join(draw.choices(known, k=draw.randrange(low, high)))

    def prose(low: int = 1, high: int = 5) -> str:
        return " ".join(words(2, 18).capitalize() + pick(".", ".", ".", "?", "!")
                        for _ in range(draw.randrange(low, high)))

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>'
                       for _ in range(draw.randrange(low, high)))

    def box(tag: str, label: str, inside: str, hint: str | None = None) -> str:
        attribute = f' {pick("class", "id")}="{hint}"' if hint else ""
        return f'<{tag}{attribute} {LABEL}="{label}">{inside}</{tag}>'

    def off(tag: str, inside: str, hint: str | None = None) -> str:
        return box(tag, "boilerplate", inside, hint)

    def boilerplate(place: str) -> str:
        menu = pick(off("nav", f"<ul>{links(3, 9)}</ul>", pick(None, "menu", "main-nav")),
                    off("div", f"<ul>{links(3, 9)}</ul>", pick("nav", "navbar", "menu")))
        advert = off(pick("div", "div", "aside", "section", "p"), pick(prose(), f"<p>{prose()}</p>", words(2, 8)),
                     pick("ad", "ads", "ad-banner", "advert", "sponsored", "promo"))
        notice = off(pick("div", "section", "p"), pick(prose(1, 3), f"<p>{prose(1, 3)}</p><button>{words(1, 3)}"
                                                                    f"</button>"),
                     pick("cookie-notice", "notice", "cookie-banner", "consent", "popup", "alert"))
        head = off("header", pick(f"<h1>{words(1, 4)}</h1>", f"<div>{words(1, 4)}</div><p>{prose(1, 2)}</p>",
                                  f"<ul>{links(2, 5)}</ul>"), pick(None, "site-header", "masthead"))
        foot = pick(off("footer", pick(f"&copy; {words(1, 4)} &middot; {prose(1, 3)}", f"<p>{prose(1, 3)}</p>",
                                       f"<ul>{links(2, 6)}</ul><p>{words(2, 7)}</p>"), pick(None, "footer")),
                    off("div", f"<p>&copy; {words(2, 8)}</p>", pick("footer", "copyright", "site-footer")))
        side = pick(off("aside", pick(f"<h3>{words(1, 3)}</h3><ul>{links(2, 7)}</ul>", f"<p>{prose()}</p>"),
                        pick(None, "sidebar", "related", "widget")),
                    off("div", pick(f"<h3>{words(1, 3)}</h3><p>{prose()}</p>", f"<ul>{links(2, 6)}</ul>"),
                        pick("sidebar", "related", "widget-area", "trending")))
        form = off("form", pick(f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>",
                                f"<p>{prose(1, 2)}</p><input type=text><button>{words(1, 2)}</button>"),
                   pick(None, "search", "newsletter", "login"))
        talk = "".join(pick(f"<div class=comment><b>{word()}</b><p>{prose()}</p></div>", f"<p>{prose()}</p>",
                            f"<li><p>{prose()}</p></li>") for _ in range(draw.randrange(1, 5)))
        comments = off(pick("section", "div", "ul", "ol"), pick("", f"<h3>{words(1, 3)}</h3>") + talk,
                       pick("comments", "comment-list", "comments-area", "discussion", "replies"))
        share = off(pick("div", "ul"), f"<ul>{links(2, 5)}</ul>", pick("share", "social-links", "tags"))
        places = {
            "top": (head, menu, notice, advert, form), "bottom": (comments, foot, side, advert, notice, form),
            "middle": (advert, side, share, form, notice), "end": (comments, share, advert, side),
        }
        return pick(*places[place])

    def paragraph() -> str:
        inline = pick("", "", f' <a href="/{word()}">{words(1, 4)}</a> {words(1, 5)}.', f" <b>{words(1, 4)}</b>",
                      f" <em>{words(1, 3)}</em> {words(1, 3)}.")
        return f"<p>{prose()}{inline}</p>"

    blocks = [
        *[paragraph] * 6, lambda: f"<p>{words(1, 4)}</p>", lambda: f"<p>{words(4, 60)}</p>",
        lambda: f"<p>{' '.join([word()] * draw.randrange(5, 90))}</p>", lambda: f"<p>{prose(8, 30)}</p>",
        lambda: f"<p>{prose(30, 60)}</p>", lambda: f"<p>{words(60, 200)}</p>",
        lambda: f"<p>{word().capitalize()}.</p>", lambda: f"<h2>{words(1, 6)}</h2>", lambda: f"<h3>{words(1, 5)}</h3>",
        lambda: f"<p><b>{prose()}<br>", lambda: f"<blockquote>{pick('<p>', '')}{prose()}</blockquote>",
        lambda: "<ul>" + "".join(f"<li>{prose(1, 2)}</li>" for _ in range(3)) + "</ul>",
        lambda: f"<ol><li>{words(1, 5)}</li><li>{words(1, 5)}</li></ol>",
        lambda: f"<table><tr><th>{word()}</th><td>{words(1, 3)}</td></tr><tr><th>{word()}</th><td>{words(1, 4)}</td>"
                "</tr></table>",
        lambda: f"<pre>{words(2, 9)}</pre>",
        lambda: f"<figure><img src=x><figcaption>{prose(1, 2)}</figcaption></figure>",
        lambda: f"<div>{prose()}</div>", lambda: f"<div><p>{prose()}</p></div>",
        lambda: f"<section><p>{prose()}</p></section>",
    ]

    pages = []
    for _ in range(count):
        body = [pick(*blocks)() for _ in range(pick(1, 1, 2, 3, 4, 6, 12, 40))]
        if some(0.15):
            # An article of nothing but very short or unfinished paragraphs.
            body = [f"<p>{pick('', '<b>')}{words(1, 5)}{pick('.', '.', '')}</p>" for _ in range(draw.randrange(2, 25))]
        if some(0.2):
            body.insert(draw.randrange(len(body) + 1), boilerplate("middle"))
        if some(0.25):
            body.append(boilerplate("end"))
        title = pick(f"<h1>{words(2, 9)}</h1>", f"<h1>{words(2, 9)}</h1>", "",
                     f'<header {LABEL}="content"><h1>{words(2, 9)}</h1></header>')
        inside = title + "".join(body)
        bare = some(0.15)
        main = inside if bare else pick(box("article", "content", inside, pick(None, None, "post")), box("article", "content", inside),
                    box("main", "content", inside), f"<main><article {LABEL}=content>{inside}</article></main>",
                    box("div", "content", inside, pick("content", "post-body", "entry-content", "article", "main")),
                    box("section", "content", inside, pick("content", "story")))
        top = "".join(boilerplate("top") for _ in range(draw.randrange(0, 4)))
        bottom = "".join(boilerplate("bottom") for _ in range(draw.randrange(0, 4)))
        whole = top + main + bottom
        if some(0.3) and not bare:
            whole = f'<div class="{pick("wrapper", "page", "container", "site")}">{whole}</div>'
        label = f' {LABEL}="content"' if bare else ""
        pages.append(f'<!DOCTYPE html><html><head><title>{words(1, 6)}</title><script>x("<p>")</script></head>'
                     f"<body{label}>{whole}</body></html>")
    return pages


@cache
def default_model() -> Model:
    """The model fitted on ``labelled_pages``; a few seconds, once per driver."""
    return fit(labelled_pages())


def main_text(sources: Sequence[str | None], model: Model) -> list[str]:
    """Text blocks whose element is content, joined by line feeds; the empty text where there is none."""
    pages = [parse(s or "") for s in sources]
    trees = forest(pages)
    state, _, _ = marginals(trees, model)
    return ["\n".join(text for text, owner in zip(page.text, page.owner) if state[base + owner, 1] > 0.5)
            for page, base in zip(pages, trees.first)]


_BATCH_CHARS = 2_000_000


def extract(pages: DataFrame, model: Model | None = None, column: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole ``html`` in ``column``; a null page has the empty text.

    Rows are handled one by one, repeated ones alike; all columns are kept, one named ``column`` is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, start = batch.column("html"), 0
            while start < len(sources):
                # A few pages at a time: as many as make up some characters.
                end, held, size = start, [], 0
                while end < len(sources) and (not held or size < _BATCH_CHARS):
                    held.append(sources[end].as_py())
                    size += len(held[-1] or "")
                    end += 1
                rows = batch.slice(start, end - start)
                kept = [c for c in rows.schema.names if c != column]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), pa.array(main_text(held, shared.value), pa.string())],
                    [*kept, column])
                start = end

    plain = pages.select(*[f"`{f}`" for f in pages.columns if f != column])
    return plain.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField(column, T.StringType())]))
