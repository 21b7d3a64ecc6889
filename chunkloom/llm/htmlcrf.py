"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between tags of block elements. Each
block has features of its ancestors (tags, and what their class and id names hint at)
and of its text; neighbours are linked by a two-state chain, article or not. The
weights are learned by gradient ascent on the likelihood of labelled pages, which a
generator builds from random templates with known labels, and Viterbi finds a page's
likeliest labelling.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements that break a line of text, that have no end tag, whose text is never shown, that hold raw text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN_TAGS = frozenset("head template noscript iframe svg canvas audio video select datalist button option script style title textarea noframes".split())
RAW_TAGS = frozenset("script style textarea title noframes iframe xmp noembed".split())
#: An open element that a start tag ends: itself and, for p, any block.
ENDS_ITSELF = frozenset("li dt dd tr td th option p".split())

#: Parts of class and id names, by what they hint at.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "top": "header masthead topbar top branding logo",
    "bottom": "footer foot bottom copyright colophon legal",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular",
    "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer warning",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promoted promotion teaser",
    "remark": "comment comments reply replies respond disqus discussion reader feedback",
    "share": "share sharing social follow tags tag",
    "form": "form search searchform login contact",
    "article": "article content post entry story body main text prose page",
}
_HINT_OF = {word: name for name, words in HINTS.items() for word in words.split()}
_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\s\xa0]+")


#: Elements that features look at, and those within which an element ends its like.
_LAYOUT = ("nav", "aside", "footer", "header", "form", "article", "main", "li", "td", "blockquote", "figure", "figcaption", "pre", "h1", "h2", "h3", "p", "address", "label", "a", "dd", "dt", "section")
_SCOPE = frozenset("ul ol dl table div article section body".split())


@dataclass
class Block:
    """text, the tag of the element that it begins in, and of all elements around it the tags of _LAYOUT and the hints. linked: characters in links."""

    text: str
    leaf: str
    tags: frozenset[str]
    hints: frozenset[str]
    linked: int


@dataclass(slots=True)
class Element:
    """An open element. tags, hints: its own and its ancestors'. block, scope: places of the innermost of these, itself included."""

    tag: str
    unshown: bool
    tags: frozenset[str]
    hints: frozenset[str]
    block: int
    scope: int


NOWHERE = Element("", False, frozenset(), frozenset(), -1, -1)


class OpenElements:
    """The elements that are open. No step takes longer the deeper they are, but for those that it closes."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    @property
    def top(self) -> Element:
        return self.stack[-1] if self.stack else NOWHERE

    def push(self, tag: str, hints: frozenset[str], unshown: bool) -> None:
        up, n = self.top, len(self.stack)
        tags = up.tags | {tag} if tag in _LAYOUT and tag not in up.tags else up.tags
        self.places[tag].append(n)
        self.stack.append(Element(tag, unshown or up.unshown, tags, up.hints if hints <= up.hints else up.hints | hints, n if tag in BLOCK_TAGS else up.block, n if tag in _SCOPE else up.scope))

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def innermost(self, tag: str) -> int:
        return self.places[tag][-1] if self.places[tag] else -1


def attributes_of(raw: str) -> tuple[frozenset[str], bool]:
    """(hints, hidden): what class, id and role names hint at, and whether the element is not shown."""
    found, hidden = set(), False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            found.update(_HINT_OF[w] for w in re.split(r"[^a-z]+", value.lower()) if w in _HINT_OF)
        hidden |= name == "hidden" or name == "style" and _NO_DISPLAY.search(value) is not None
    return frozenset(found), hidden


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: "text" with the raw text as rest, "start" and "end" tags with raw attributes as rest.

    A tag ends with the first > outside the quotes of its values. After a tag whose quotes
    never close, quotes are no longer looked at, so that a page is read once. What
    begins like a tag after the last > is text. Raw text elements are skipped.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True

    def tag_end(begin: int) -> int:
        nonlocal quotes
        at = begin
        while quotes:
            m = _STOP.search(page, at)
            if m is None:
                quotes = False
            elif m[0] == ">":
                return m.start()
            elif page[max(begin, m.start() - 64) : m.start()].rstrip()[-1:] != "=":
                at = m.end()
            elif (close := page.find(m[0], m.end())) < 0:
                quotes = False
            else:
                at = close + 1
        return page.find(">", begin)

    while m := _START.search(page, at):
        if m.start() > last and not m[1] and not m[2]:
            break
        yield "text", "", page[at : m.start()]
        if m[1] or m[2]:
            mark = "-->" if m[1] else "]]>"
            end = page.find(mark, m.end())
            at = end + 3 if end >= 0 else n
            continue
        end = page.find(">", m.end()) if m[3] else tag_end(m.end())
        at = end + 1
        if m[3]:
            continue
        tag = m[5].lower()
        yield ("end" if m[4] else "start"), tag, page[m.end() : end]
        if tag in RAW_TAGS and not m[4]:
            stop = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = stop.end() if stop else n
    yield "text", "", page[at:]


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; character references are decoded, white space is one space, blank blocks are left out."""
    open_, out, pieces = OpenElements(), [], []
    linked, where = 0, NOWHERE

    def close_block() -> None:
        nonlocal linked, where
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append(Block(text, where.tag, where.tags, where.hints, min(linked, len(text))))
        pieces.clear()
        linked, where = 0, NOWHERE

    blank = True
    for kind, tag, rest in markup(page):
        if kind == "text":
            if rest and not open_.top.unshown:
                text = entities.unescape(rest)
                pieces.append(text)
                if not text.isspace():
                    if blank:
                        where, blank = open_.top, False
                    if "a" in open_.top.tags:
                        linked += len(text.strip())
            continue
        if tag in BLOCK_TAGS:
            close_block()
            blank = True
        if kind == "end":
            if (place := open_.innermost(tag)) >= 0:
                open_.close(place)
            continue
        if tag in BLOCK_TAGS and (place := open_.top.block) >= 0 and open_.stack[place].tag == "p":
            open_.close(place)
        if tag in ENDS_ITSELF and (place := open_.innermost(tag)) > open_.top.scope:
            open_.close(place)
        if tag == "br":
            pieces.append(" ")
        if tag in VOID_TAGS or tag in RAW_TAGS or rest.endswith("/") and tag not in BLOCK_TAGS:
            continue
        hints, hidden = attributes_of(rest) if rest and tag not in ("html", "body") else (frozenset(), False)
        open_.push(tag, hints, hidden or tag in UNSHOWN_TAGS)
    close_block()
    return out


_NOTICE = re.compile(r"cookie|consent|privacy|newsletter|subscribe|sign up|log ?in|all rights reserved|copyright|©|terms of|javascript", re.I)


def features(block: Block) -> list[str]:
    tags, n = block.tags, len(block.text)
    out = ["bias"] + [f"in:{t}" for t in _LAYOUT if t in tags] + [f"hint:{h}" for h in block.hints]
    inner = "article" in tags or "main" in tags
    if inner or "article" in block.hints:
        out.append("within")
        out += [f"within+{t}" for t in ("nav", "aside", "footer", "header", "form", "li") if t in tags] + [f"within+hint:{h}" for h in block.hints if h != "article"]
    else:
        out += ["without", f"without+leaf:{block.leaf}"]
    out.append(f"size:{min(9, n.bit_length())}")
    density = block.linked / n
    out.append("links:all" if density > 0.8 else "links:some" if density > 0.3 else "links:few")
    if block.text[-1] in ".!?…:;\"'”»)":
        out.append("ends")
    if n < 300 and _NOTICE.search(block.text):
        out.append("notice words")
    return out


@dataclass
class Chain:
    """weights: of each feature for the article state. step: [before, now] scores of state pairs. first: of the first state."""

    weights: dict[str, float] = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def labels(self, blocks: list[Block]) -> list[bool]:
        """Viterbi."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        no, yes = self.first.tolist()
        back = []
        for i, b in enumerate(blocks):
            own = sum(self.weights.get(f, 0.0) for f in features(b))
            if i:
                to_no, to_yes = (0, no + s00) if no + s00 >= yes + s10 else (1, yes + s10), (0, no + s01) if no + s01 > yes + s11 else (1, yes + s11)
                back.append((to_no[0], to_yes[0]))
                no, yes = to_no[1], to_yes[1]
            yes += own
        state, out = int(yes > no), []
        for i in range(len(blocks) - 1, -1, -1):
            out.append(bool(state))
            if i:
                state = back[i - 1][state]
        return out[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 40, rate: float = 0.5, ridge: float = 0.02) -> Chain:
    """Maximum likelihood by forward-backward and adaptive gradient steps on all pages."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in features(b)] for b in blocks] for blocks, _ in pages]
    w, step, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    seen_w, seen_s, seen_f = np.full(len(names), 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(rounds):
        gw, gs, gf = -ridge * w, -ridge * step, -ridge * first
        for own, (_, labels) in zip(rows, pages, strict=True):
            n = len(own)
            if n == 0:
                continue
            unary = np.zeros((n, 2))
            unary[:, 1] = [w[f].sum() for f in own]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = first + unary[0]
            for i in range(1, n):
                ahead[i] = log_sum(ahead[i - 1][:, None] + step, 0) + unary[i]
            for i in range(n - 2, -1, -1):
                behind[i] = log_sum(step + (unary[i + 1] + behind[i + 1])[None], 1)
            total = log_sum(ahead[-1], 0)
            p = np.exp(ahead + behind - total)
            y = np.array(labels, int)
            for f, error in zip(own, y - p[:, 1], strict=True):
                gw[f] += error
            gf += np.eye(2)[y[0]] - p[0]
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + step[None] + (unary[1:] + behind[1:])[:, None, :] - total)
                np.add.at(gs, (y[:-1], y[1:]), 1)
                gs -= pair.sum(axis=0)
        for value, grad, seen in ((w, gw, seen_w), (step, gs, seen_s), (first, gf, seen_f)):
            seen += grad**2
            value += rate * grad / np.sqrt(seen)
    return Chain({f: float(w[i]) for f, i in names.items()}, step, first)


# -- labelled pages --------------------------------------------------------------

#: Syllables that the generator makes words of.
SYLLABLES = "ba co di en fu ga hi is jo ka li mo nu or pe qua re su ti un ver wo xe zu é ñ ö ü ß ain eau sch tion ing".split()


class PageMaker:
    """Builds pages from random templates, with each block's label known by where it was put."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        w = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.1:
            w.insert(self.r.randrange(len(w) + 1), self.r.choice(["x.y7@mail.example.com", "+1 (678) 555-5272", "84.26.86.227", "4541241989961675", "&amp;", "2024"]))
        return " ".join(w)

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.r.choice(["."] * 6 + ["!", "?", ":", ""])

    def paragraph(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8])))
        if self.r.random() < 0.15:
            text += f' <a href="/{self.r.randrange(99)}">{self.words(1, 4)}</a> {self.sentence()}'
        return text

    def open(self, tag: str, *names: str) -> str:
        name = self.r.choice(names) if names and self.r.random() < 0.85 else ""
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">' if name else f"<{tag}>"

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(low, high))) + "</ul>"

    def article_part(self) -> str:
        kind = self.r.random()
        if kind < 0.68:
            return f"<p>{self.paragraph()}</p>"
        if kind < 0.74:
            return f"<p><b>{self.sentence()}<br><p>{self.paragraph()}"
        if kind < 0.82:
            return f"<h{(h := self.r.randint(2, 4))}>{self.words(1, 7).capitalize()}</h{h}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.sentence(2, 14)}</li>" for _ in range(self.r.randint(1, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote><p>{self.paragraph()}</p></blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(self.r.randint(1, 3))) + "</table>"
        return f"<div>{self.paragraph()}</div>"

    def clutter(self, inside: bool) -> str:
        r = self.r
        makers = [
            lambda: self.open("div", "ad", "ads", "advert", "sponsored", "promo", "ad-slot top") + f"{self.sentence(3, 14)}</div>",
            lambda: self.open("aside", "sidebar", "related", "widget") + f"<h3>{self.words(1, 3)}</h3>{self.links(1, 5)}<p>{self.sentence(2, 12)}</p></aside>",
            lambda: self.open("div", "share", "social-links", "tags") + f"{self.links(1, 4)}</div>",
            lambda: f'<form class="{r.choice(["newsletter", "search", "login", "contact"])}"><label>{self.words(1, 4)}</label><input name="q"><p>{self.sentence(3, 9)}</p><button>{self.words(1, 2)}</button></form>',
            lambda: f'<{(t := r.choice(["section", "div", "ol"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "reader-comments", "replies", "disqus_thread"])}"><h3>{self.words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{self.paragraph()}</p></div>' for _ in range(r.randint(1, 4))) + f"</{t}>",
        ]
        if not inside:
            makers += [
                lambda: f'<div class="{r.choice(["cookie-banner", "cookie-notice", "notice", "consent", "alert", "popup"])}"><p>{self.sentence(4, 20)}</p></div>',
                lambda: f'<div class="{r.choice(["sidebar", "side", "widget", "related-posts", "trending"])}"><h4>{self.words(1, 3)}</h4><p>{self.paragraph()}</p>{self.links(0, 4)}</div>',
                lambda: f"<aside><p>{self.paragraph()}</p></aside>",
            ]
        return r.choice(makers)()

    def page(self) -> list[tuple[str, bool]]:
        """(piece of html, is article) in order."""
        r, out = self.r, []
        title = self.sentence(2, 10)
        out.append((f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>', False))
        for make in r.sample(
            [
                lambda: self.open("nav", "menu", "navbar") + self.links(2, 8) + "</nav>",
                lambda: f'<div class="{r.choice(["menu", "nav", "navigation", "breadcrumbs"])}">{self.links(2, 8)}</div>',
                lambda: self.open("header", "site-header", "masthead") + f"<h1>{self.words(1, 4)}</h1><p>{self.sentence(2, 8)}</p></header>",
                lambda: self.clutter(False),
                lambda: self.clutter(False),
            ],
            r.randint(1, 4),
        ):
            out.append((make(), False))
        start, end = r.choice([("<article>", "</article>")] * 4 + [("<main><article>", "</article></main>"), ("<main>", "</main>")] + [(f'<div {r.choice(["class", "id"])}="{n}">', "</div>") for n in ("content", "post", "entry-content", "article-body", "story", "main")])
        out.append((start, False))
        if r.random() < 0.85:
            head = f"<h1>{title}</h1>"
            out.append((f"<header>{head}</header>" if r.random() < 0.15 else head, True))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            out.append((self.article_part(), True))
            if r.random() < 0.06:
                out.append((self.clutter(True), False))
        out.append((end, False))
        for _ in range(r.randint(0, 3)):
            out.append((self.clutter(False), False))
        if r.random() < 0.9:
            foot = f"{r.choice(['&copy; ', '', 'Copyright '])}{self.words(1, 3)} &middot; {self.sentence(2, 14)}"
            out.append((self.open("footer", "site-footer", "bottom") + (f"<p>{foot}</p>{self.links(0, 4)}" if r.random() < 0.5 else foot) + "</footer>" if r.random() < 0.8 else f'<div class="{r.choice(["footer", "copyright", "bottom"])}">{foot}</div>', False))
        out.append(("</body></html>", False))
        return out

    def labelled(self) -> tuple[list[Block], list[bool]]:
        """A page's blocks and labels. A mark that no page has shows which blocks came from article pieces."""
        pieces = self.page()
        marked = "".join(re.sub(r">(?=[^<\s])", ">\ue000", h) if y else h for h, y in pieces)
        blocks = leaf_blocks(marked)
        labels = ["\ue000" in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace("\ue000", "") or "."
        return blocks, labels


def trained(n_pages: int = 100, seed: int = 1) -> Chain:
    """A chain learned from so many generated pages; the same for the same numbers."""
    maker = PageMaker(seed)
    return train([maker.labelled() for _ in range(n_pages)])


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, chain.labels(blocks), strict=True) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of the whole html of each row.

    Null or empty html, and a page without an article, give an empty text. Broken and
    unclosed tags are read as browsers do, roughly. Rows that repeat an id get a row
    each. Extra columns are not read; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(tell, "page_id long, url string, text string, n_chars long")
