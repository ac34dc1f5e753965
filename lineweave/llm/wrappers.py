"""Main text of web pages by wrapper induction.

1. Each page becomes a tree of its block elements, menus and all.
2. A host's most common layouts (which label paths a page has) give a reference page each. Every page of the host is aligned
   with the references by simple tree matching: the largest order-preserving matching of nodes with equal labels (element
   and classes), in which leaves of equal text weigh double. It votes for the nodes of the references that fit it: aligned,
   same text, characters, characters in links. Votes are added up before they are shuffled.
3. The host's wrapper follows from the votes on each node. Nodes with the same text on MIN_SHARE of the pages that have them
   are constant. From the root, the slot that holds the article is the innermost container with over SLOT_SHARE of the
   text that varies and isn't linked; headings right before it belong to it. Constant nodes, and blocks whose text is
   mostly linked, are template inside the slot too; if no container stands out, so are short blocks of a single line that
   stand on most pages.
4. Of a page that fits a reference and has text in its slot, what is aligned with the slot or stands inside it is content, without template nodes (unless
   those hold most of it: copies of one article repeat, too), and without elements that are never article text by their
   names or classes. Other pages, and hosts with fewer than MIN_PAGES pages, go by names and classes alone: of a page that
   marks its article, the article, else all but menus, headers, footers, sidebars, notices, adverts, forms, comments.

Edge cases: a null or empty page has an empty text; a page without url or host has no wrapper; unclosed and stray tags
are tolerated, in time linear in the page; blocks nested over MAX_DEPTH deep are laid flat, their text kept; a very long page
is a tree like any other; of equal layouts, hashes decide; repeated rows each have their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import common

MIN_PAGES = 8
MIN_SHARE = 0.6
#: Share of a host's varying, unlinked text that a container must hold to be gone into.
SLOT_SHARE = 0.5
#: Share of linked characters from which a block is a menu; share of the slot from which repeated text is an article of its own.
LINK_SHARE, REPEATED_SHARE = 0.5, 0.6
#: Share of the slot up to which a block of one line is no article text, where no container stands out.
LINE_SHARE = 0.1
#: Layouts of a host that get a reference page. A page fits those with at least
#: this share of the kinds of its nodes that the best one has, and half of all its kinds.
REFERENCES = 3
ALIKE = 0.8
MAX_DEPTH = 150
#: Cells of a matching from which arrays are faster than lists; the result is the same.
FEW_CELLS = 1_000

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""["'>]""")
#: Nearly every tag; it never looks beyond the next angle bracket.
_TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content isn't text, read up to their end tag.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "xmp"}
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
BLOCK = {"html", "body", "head", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "section", "article", "header", "footer", "nav", "aside", "main", "figure", "figcaption", "form", "fieldset", "address", "details", "summary", "hr", "menu", "dialog", "hgroup", "center"}
VOID = {"hr", "br", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that are never article text.
OUTSIDE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "label", "input"}
#: Words in a class, id or role that mark what isn't article text.
OUTSIDE_WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "masthead", "sidebar", "aside", "widget", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "banner", "popup", "modal", "alert", "comment", "comments", "replies", "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "pagination", "pager", "search", "contentinfo", "complementary", "toolbar"}
ARTICLE_WORDS = {"article", "main"}
#: A start tag closes the innermost open element of these, up to a container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "html", "nav", "header", "footer", "aside", "form", "blockquote"}


#: Blocks that hold other blocks; only these can be slots.
SLOTS = {"html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "center"}
HEADINGS = {"h1", "h2", "h3"}


@dataclass
class Node:
    label: str
    outside: bool = False
    article: bool = False
    children: list[Node] = field(default_factory=list)
    text: str = ""  # of a text leaf
    chars: int = 0  # of a text leaf: characters, and those of them in links
    links: int = 0
    path: str | None = None  # of a node without branches, once chained() has been there: labels down to its end, their number and the text there
    depth: int = 0
    said: str = ""


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page's pieces, kind being text, open, close or empty. Every character is looked at a bounded number of times."""
    at, end = 0, len(page)
    last = {c: page.rfind(c) for c in ('"', "'", ">", "-->")}
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            yield "text", "", page[at : lt if lt > 0 else end]
            at = lt if lt > 0 else end
        elif m := _TAG.match(page, at):
            name, rest, at = m[1].lower(), m[2], m.end()
            kind = "close" if page[m.start() + 1] == "/" else "empty" if rest and rest[-1] == "/" else "open"
            if name not in RAW:
                yield kind, name, rest
            elif kind == "open":
                close = _RAW_ENDS[name].search(page, at)
                at = close.end() if close else end
        elif page.startswith("<!--", at):
            at = page.find("-->", at + 4) + 3 if last["-->"] >= at + 4 else end
        elif page[at + 1 : at + 2] in ("!", "?") and last[">"] > at:
            at = page.find(">", at) + 1
        elif last[">"] < at or not (m := _NAME.match(page, at + 1)):
            yield "text", "", "<"
            at += 1
        else:
            stop = m.end()
            while (s := _STOP.search(page, stop)) and s[0] != ">":
                if last[s[0]] <= s.start():  # a quote that nothing closes
                    s = re.compile(">").search(page, s.start()) if last[">"] > s.start() else None
                    break
                stop = page.find(s[0], s.end()) + 1
            if not s:
                yield "text", "", page[at:]
                return
            rest = page[m.end() : s.start()]
            name, at = m[1].lower(), s.end()
            kind = "close" if m[0][0] == "/" else "empty" if rest.endswith("/") else "open"
            if name in RAW and kind == "open":
                close = _RAW_ENDS[name].search(page, at)
                at = close.end() if close else end
            elif name not in RAW:
                yield kind, name, rest


def _plain(said: str) -> str:
    return " ".join((entities.unescape(said) if "&" in said else said).split())


def parse(page: str | None) -> Node:
    """The tree of a page's blocks; runs of inline text are leaves labelled #text."""
    root = Node("#root")
    open_: list[tuple[str, Node]] = [("#root", root)]
    many: Counter[str] = Counter()  # open blocks by name
    hidden: list[str] = []  # inline elements that aren't article text
    within: Counter[str] = Counter()  # those by name, and links
    run: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if run:
            said = _plain("".join(run))
            link = len(_plain("".join(linked))) if linked else 0
            run.clear()
            linked.clear()
            if said:
                open_[-1][1].children.append(Node("#text", text=said, chars=len(said), links=min(link, len(said))))
        if hidden:
            hidden.clear()
        if within:
            within.clear()

    def close(k: int) -> None:
        for name, _ in open_[k:]:
            many[name] -= 1
        del open_[k:]

    for kind, tag, rest in tags(page or ""):
        if kind == "text":
            if not hidden:
                run.append(rest)
                if within["a"]:
                    linked.append(rest)
        elif tag == "br":
            run.append(" ")
        elif tag == "a":
            within["a"] = kind == "open"
        elif kind == "close":
            if tag in BLOCK:
                if many[tag] > 0:
                    flush()
                    k = len(open_) - 1
                    while open_[k][0] != tag:
                        k -= 1
                    close(k)
                elif tag == "p":
                    flush()
            elif within[tag] > 0:
                while (gone := hidden.pop()) != tag:
                    within[gone] -= 1
                within[tag] -= 1
        elif tag not in BLOCK:
            if tag not in VOID and kind == "open" and (hidden or tag in OUTSIDE):
                hidden.append(tag)
                within[tag] += 1
        else:
            flush()
            closes = CLOSES.get(tag, {"p"})
            if many["p"] > 0 or (len(closes) > 1 and any(many[c] > 0 for c in closes)):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] in closes:
                        close(k)
                        break
                    if open_[k][0] in CONTAINERS:
                        break
            if rest.strip():
                said: dict[str, str] = {}
                for a in _ATTRIBUTE.finditer(rest):
                    said.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
                classes = said.get("class", "").lower()
                words = set(re.split(r"[^a-z0-9]+", f"{classes} {said.get('id', '').lower()} {said.get('role', '').lower()}"))
                own = Node(f"{tag}.{classes}" if classes else tag, tag in OUTSIDE or bool(words & OUTSIDE_WORDS) or "hidden" in said, tag in ARTICLE_WORDS or said.get("role", "").lower() in ARTICLE_WORDS)
            else:
                own = Node(tag, tag in OUTSIDE, tag in ARTICLE_WORDS)
            open_[-1][1].children.append(own)
            if tag not in VOID:
                open_.append((tag, own if len(open_) < MAX_DEPTH else open_[-1][1]))
                many[tag] += 1
    flush()
    return root


def content(root: Node) -> Node:
    """The tree without what is never article text by names; if a part is marked as article, only such parts."""

    def inside(node: Node) -> Node:
        return Node(node.label, article=node.article, children=[inside(c) for c in node.children if not c.outside], text=node.text)

    def marked(node: Node, label: str) -> list[Node]:
        if node.article and (label == "" or node.label.split(".")[0] == label):
            return [node]
        return [x for c in node.children for x in marked(c, label)]

    kept = inside(root)
    for label in ("article", ""):
        if found := [x for x in marked(kept, label) if leaves(x)]:
            return Node("#root", children=found)
    return kept


def leaves(node: Node) -> list[Node]:
    return [node] if node.text else [x for c in node.children for x in leaves(c)]


def preorder(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        out.append(todo.pop())
        todo += reversed(out[-1].children)
    return out


def chained(root: Node) -> Node:
    """Notes on each node without branches what is below it: two with the same labels weigh their number, and one more if texts are equal."""
    for x in reversed(preorder(root)):
        if not x.children:
            x.path, x.depth, x.said = x.label, 1, x.text
        elif len(x.children) == 1 and (c := x.children[0]).path is not None:
            x.path, x.depth, x.said = f"{x.label} {c.path}", c.depth + 1, c.said
        else:
            x.path, x.depth = None, -1
    return root


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """All pairs of the simple tree matching of two nodes with one label, blocks before what they hold."""

    known: dict[tuple[int, int], int] = {}

    def weigh(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        if x.path is not None and x.path == y.path:
            return x.depth + (x.said == y.said)
        key = id(x), id(y)
        if key not in known:
            w = 1 + align(x.children, y.children, False)[0]
            if len(known) >= 1_000_000:
                known.clear()
            known[key] = w
        return known[key]

    def plain_after(row: list[int], w: list[int]) -> list[int]:
        new, last = [0], 0
        for diagonal, above, v in zip(row, row[1:], w, strict=False):
            if above > last:
                last = above
            if v and diagonal + v > last:
                last = diagonal + v
            new.append(last)
        return new

    def traced(first: int, j: int, ws, best, xs: list[Node], ys: list[Node], out: list) -> int:
        """Appends the pairs of the rows from `first` on, last ones first, and returns the column that is reached."""
        i = len(ws)
        while i and j:
            w = ws[i - 1][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                out.append((xs[first + i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return j

    def align(xs: list[Node], ys: list[Node], listed: bool) -> tuple[int, list[tuple[Node, Node]]]:
        """The largest weight and, if asked for, node pairs. Of n rows of the table about 2 sqrt(n) are held at once."""
        n, m = len(xs), len(ys)
        if n * m <= FEW_CELLS:
            told = [(y.path, y.said) for y in ys]
            if all(p is not None for p, _ in told):
                ws = [[(x.depth + (x.said == t) if x.path == p else weigh(x, y) if x.label == y.label else 0) for y, (p, t) in zip(ys, told, strict=True)] for x in xs]
            else:
                ws = [[weigh(x, y) for y in ys] for x in xs]
            if not listed:
                row = [0] * (m + 1)
                for w in ws:
                    row = plain_after(row, w)
                return row[m], []
            best = [[0] * (m + 1)]
            for w in ws:
                best.append(plain_after(best[-1], w))
            out: list[tuple[Node, Node]] = []
            traced(0, m, ws, best, xs, ys, out)
            return best[n][m], out[::-1]
        names: dict = {}
        number = lambda keys: np.array([names.setdefault(k, len(names)) for k in keys], np.int64)
        fx, fy = ([(v.path, v.said, v.depth) if v.path is not None else None for v in nodes] for nodes in (xs, ys))
        (lx, px, tx), (ly, py, ty) = ([number(("l", v.label) for v in nodes), number(("p", f[0]) if f else (side, k) for k, f in enumerate(forms)), number(("t", f[1] if f else None) for f in forms)] for side, forms, nodes in (("x", fx, xs), ("y", fy, ys)))

        def weights(i: int) -> np.ndarray:
            w = np.where(py == px[i], (fx[i][2] if fx[i] else 0) + (ty == tx[i]), 0)
            for j in np.flatnonzero((ly == lx[i]) & (py != px[i])).tolist():
                w[j] = weigh(xs[i], ys[j])
            return w

        def after(row: np.ndarray, w: np.ndarray) -> np.ndarray:
            new = row.copy()
            np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0), out=new[1:])
            return np.maximum.accumulate(new)

        step, row = math.isqrt(n) + 1, np.zeros(m + 1, np.int64)
        held = [row]
        for i in range(n):
            row = after(row, weights(i))
            if listed and (i + 1) % step == 0:
                held.append(row)
        out, j = [], m
        for block in range(len(held) - 1, -1, -1) if listed else ():
            first, best, ws = block * step, [held[block]], []
            for i in range(first, min(first + step, n)):
                ws.append(weights(i))
                best.append(after(best[-1], ws[-1]))
            j = traced(first, j, ws, best, xs, ys, out)
        return int(row[m]), out[::-1]

    out: list[tuple[Node, Node]] = []

    def pairs(x: Node, y: Node) -> None:
        while x.path is not None and x.path == y.path and x.children:
            out.append((x, y))
            x, y = x.children[0], y.children[0]
        out.append((x, y))
        if x.children and y.children:
            for c, d in align(x.children, y.children, True)[1]:
                pairs(c, d)

    if a.label == b.label:
        pairs(a if a.depth else chained(a), b if b.depth else chained(b))
    return out


def key_of(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def skeleton(node: Node) -> str:
    """A tree without texts: labels with flags, and hash, characters and linked characters in place of a text."""
    if node.text:
        return f"{key_of(node.text)}:{node.chars}:{node.links}"
    flags = "!" * node.outside + "*" * node.article
    return f"({flags}{node.label.translate(_PLAIN)} {' '.join(map(skeleton, node.children))})"


_PLAIN = str.maketrans(dict.fromkeys("() \t\n\r\f\v!*", "_"))


def from_skeleton(text: str) -> Node:
    top = Node("#top")
    stack = [top]
    for token in re.findall(r"\([^ ]*|\)|[^ ()]+", text):
        if token == ")":
            stack.pop()
        elif token[0] == "(":
            name = token[1:].lstrip("!*")
            stack[-1].children.append(Node(name, "!" in token, "*" in token))
            stack.append(stack[-1].children[-1])
        else:
            key, chars, links = token.split(":")
            stack[-1].children.append(Node("#text", text=key, chars=int(chars), links=int(links)))
    return top.children[0]


def layout(node: Node) -> str:
    """Which label paths a tree has, down to its text."""
    paths: set[str] = set()

    def walk(x: Node, path: str) -> None:
        for c in x.children:
            if not c.text:
                paths.add(f"{path}/{c.label}")
                walk(c, f"{path}/{c.label}")

    walk(node, "")
    return key_of(" ".join(sorted(paths)))


def aligned(references: list[Node], page: Node) -> list[tuple[int, list[tuple[Node, Node]]]]:
    """The references that fit a page, by their numbers, with the pairs of nodes; the one that shares most first."""
    found = [(k, match(r, page)) for k, r in enumerate(references)]
    kinds = [len({y.label for _, y in pairs}) for _, pairs in found]
    least = max(ALIKE * max(kinds), len({x.label for x in preorder(page)}) / 2)
    fits = [x for x, own in zip(found, kinds, strict=True) if own >= least]
    return sorted(fits, key=lambda x: (-sum(1 + (a.text == b.text != "") for a, b in x[1]), x[0]))


@dataclass
class Vote:
    """What the pages say of a node of a reference: pages aligned, pages with its text, characters, linked ones, and text leaves."""

    pages: int = 0
    same: int = 0
    chars: int = 0
    links: int = 0
    lines: int = 0


def weighed(root: Node) -> dict[int, tuple[int, int, int]]:
    """Of each node, by id: characters, linked characters and leaves, with all that it holds."""
    out: dict[int, tuple[int, int, int]] = {}
    for x in reversed(preorder(root)):
        if x.text:
            out[id(x)] = x.chars, x.links, 1
        elif len(x.children) == 1:
            out[id(x)] = out[id(x.children[0])]
        else:
            chars = links = lines = 0
            for c in x.children:
                p, q, r = out[id(c)]
                chars, links, lines = chars + p, links + q, lines + r
            out[id(x)] = chars, links, lines
    return out


def induced(reference: Node, votes: dict[int, Vote]) -> tuple[list[int], list[int]]:
    """Of a reference, by numbers of nodes in preorder: the slot with the headings before it, and template nodes in the slot. No slot: no wrapper."""
    nodes = preorder(reference)
    number = {id(x): k for k, x in enumerate(nodes)}
    vote = [votes.get(k, Vote()) for k in range(len(nodes))]
    pages = vote[0].pages
    name = lambda x: x.label.split(".")[0]
    if pages < MIN_PAGES:
        return [], []
    constant = [v.pages >= MIN_PAGES and v.same >= MIN_SHARE * v.pages and bool(x.text) for x, v in zip(nodes, vote, strict=True)]
    linked = [v.pages > 0 and v.links >= LINK_SHARE * v.chars > 0 for v in vote]
    fixed = {id(x): 0 for x in nodes}  # characters of constant leaves below a node
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        fixed[id(x)] = vote[k].chars if constant[k] else sum(fixed[id(c)] for c in x.children)

    def mass(x: Node, vary: bool) -> int:
        v = vote[number[id(x)]]
        return max(0, v.chars - v.links - (fixed[id(x)] if vary else 0))

    for vary in (True, False):  # where all is constant, pages are copies, and all text counts
        if mass(nodes[0], vary):
            break
    at, before = nodes[0], []
    while True:
        inside = [c for c in at.children if name(c) in SLOTS and c.children]
        best = max(inside, key=lambda c: mass(c, vary), default=None)
        if best is None or mass(best, vary) < SLOT_SHARE * mass(at, vary) or not mass(best, vary):
            break
        k = [id(c) for c in at.children].index(id(best))
        before = []
        while k and name(at.children[k - 1]) in HEADINGS:
            k -= 1
            before.append(at.children[k])
        at = best
    whole = vote[number[id(at)]]
    template = []
    for x in preorder(at)[1:]:
        k, v = number[id(x)], vote[number[id(x)]]
        menu = linked[k] and v.lines > v.pages
        line = name(at) in ("#root", "html", "body") and name(x) not in HEADINGS | {"p", "#text"} and 2 * v.pages >= pages and v.lines <= v.pages and v.chars / max(1, v.pages) <= LINE_SHARE * whole.chars / max(1, whole.pages)
        if constant[k] or menu or line:
            template.append(k)
    return [number[id(x)] for x in (at, *before)], template


def split(page: Node, pairs: list[tuple[Node, Node]], numbers: dict[int, int], slot: set[int], template: set[int], by_name: bool) -> list[int] | None:
    """Numbers of the leaves of a page that are content by its host's wrapper; None if the page has no slot."""
    to = {id(y): numbers[id(x)] for x, y in pairs}
    out: list[tuple[int, bool]] = []
    chars = {False: 0, True: 0}
    count, found = 0, False
    todo = [(page, False, False)]
    while todo:
        x, inside, gone = todo.pop()
        k = to.get(id(x), -1)
        found |= k in slot
        inside |= k in slot
        if inside:
            gone |= k in template
        if by_name and x.outside:
            inside, todo_in = False, False
        else:
            todo_in = inside
        if x.text:
            if inside:
                out.append((count, gone))
                chars[gone] += x.chars
            count += 1
        todo += [(c, todo_in, gone) if not (by_name and x.outside) else (c, False, gone) for c in reversed(x.children)]
    if not found:
        return None
    all_ = chars[True] > REPEATED_SHARE * (chars[True] + chars[False])
    return [k for k, gone in out if all_ or not gone]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.slice(k, 256)
            shapes, layouts, packed = [], [], []
            for page in part.column("html").to_pylist():
                tree = parse(page)
                texts = leaves(tree)
                shapes.append(skeleton(tree))
                layouts.append(layout(tree) if texts else None)
                packed.append(zlib.compress("\n".join(x.text for x in texts).encode("utf-8", "surrogatepass"), 1))
            cols = [*(part.column(c) for c in ("page_id", "url", "host")), pa.array(shapes, pa.string()), pa.array(layouts, pa.string()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "shape", "layout", "packed"])


class _Trees:
    """The references of hosts as trees, and their nodes' numbers."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def of(self, shapes: list[str]) -> tuple[list[Node], dict[int, int]]:
        key = tuple(shapes)
        if key not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            trees = [from_skeleton(x) for x in shapes]
            self.known[key] = trees, {id(x): k for t in trees for k, x in enumerate(preorder(t))}
        return self.known[key]


VOTES = "host string, ref int, node int, pages long, same long, chars long, links long, lines long"


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Trees()
    for batch in batches:
        votes: dict[tuple[str, int, int], Vote] = defaultdict(Vote)
        for host, shape, refs in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "refs")), strict=True):
            trees, numbers = known.of(refs)
            page = from_skeleton(shape)
            size = weighed(page)
            for ref, pairs in aligned(trees, page):
                for x, y in pairs:
                    v = votes[host, ref, numbers[id(x)]]
                    chars, links, lines = size[id(y)]
                    v.pages, v.same, v.chars, v.links, v.lines = v.pages + 1, v.same + (x.text == y.text), v.chars + chars, v.links + links, v.lines + lines
        if votes:
            keys = list(zip(*votes, strict=True))
            cols = [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), *(pa.array([getattr(v, c) for v in votes.values()], pa.int64()) for c in ("pages", "same", "chars", "links", "lines"))]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "ref", "node", "pages", "same", "chars", "links", "lines"])


WRAPPERS = "host string, slots array<array<int>>, templates array<array<int>>"


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, slots, templates = [], [], []
        for host, refs, votes in zip(*(batch.column(c).to_pylist() for c in ("host", "refs", "votes")), strict=True):
            of: dict[int, dict[int, Vote]] = defaultdict(dict)
            for v in votes:
                of[v["ref"]][v["node"]] = Vote(*(v[c] for c in ("pages", "same", "chars", "links", "lines")))
            made = [induced(from_skeleton(shape), of[k]) for k, shape in enumerate(refs)]
            hosts.append(host)
            slots.append([m[0] for m in made])
            templates.append([m[1] for m in made])
        kind = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(slots, kind), pa.array(templates, kind)], names=["host", "slots", "templates"])


def _written(by_name: bool):
    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Trees()
        for batch in batches:
            texts, ways = [], []
            for shape, packed, refs, slots, templates in zip(*(batch.column(c).to_pylist() for c in ("shape", "packed", "refs", "slots", "templates")), strict=True):
                page = from_skeleton(shape)
                blocks = [x for x in zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if x]
                kept = None
                if slots and any(slots):
                    trees, numbers = known.of(refs)
                    k, pairs = next((x for x in aligned(trees, page) if slots[x[0]]), (0, []))
                    kept = split(page, pairs, numbers, set(slots[k]), set(templates[k]), by_name)
                ways.append("wrapper" if kept else "names")
                if not kept:
                    for k, x in enumerate(leaves(page)):
                        x.text = str(k)
                    kept = [int(x.text) for x in leaves(content(page) if by_name else page)]
                texts.append("\n\n".join(blocks[k] for k in kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(ways, pa.string())], names=["page_id", "url", "text", "decided_by"])

    return ran


#: Bytes of a table by host up to which it is sent to all tasks.
BROADCAST_BYTES = 16 << 20
#: Parts of each host's pages where such a table is larger.
SALTS = 64


def _with_host(pages: DataFrame, by_host: DataFrame, size: Column, how: str) -> DataFrame:
    """Pages with what is known of their hosts: sent along if that is small, else joined by host and part, as a host may have a third of all pages."""
    if (by_host.agg(F.sum(size + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(by_host), "host", how)
    parts = by_host.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_part", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int")).join(parts, ["host", "_part"], how).drop("_part")


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def extracted(pages: DataFrame, *, by_name: bool = True, by_wrapper: bool = True) -> DataFrame:
    """page_id, url, text, n_chars and decided_by (wrapper or names) of every page. by_name, by_wrapper: without one of the two."""
    common.small_batches(pages.sparkSession)
    host = F.nullif(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    parsed = common.cut(rows.mapInArrow(_parsed, "page_id long, url string, host string, shape string, layout string, packed binary"), "pages")
    known = parsed.where("host is not null and layout is not null").select("host", "layout", "shape")
    layouts = known.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), F.min_by("shape", F.struct(F.xxhash64("shape"), "shape")).alias("shape"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "layout"))
    best = layouts.withColumn("rank", rank).where(F.col("rank") <= REFERENCES) if by_wrapper else layouts.where("false").withColumn("rank", F.lit(1))
    refs = best.groupBy("host").agg(F.sum("pages").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "shape"))), lambda x: x["shape"]).alias("refs"))
    refs = common.cut(refs.where(F.col("n") >= MIN_PAGES).drop("n"), "references")  # REFERENCES pages of a host
    size = F.length(F.array_join("refs", ""))
    votes = _with_host(known.select("host", "shape"), refs, size, "inner").mapInArrow(_voted, VOTES)
    votes = votes.groupBy("host", "ref", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "chars", "links", "lines")])
    told = votes.groupBy("host").agg(F.collect_list(F.struct("ref", "node", "pages", "same", "chars", "links", "lines")).alias("votes"))  # a vote per node of REFERENCES pages
    wrappers = common.cut(refs.join(told.join(refs, "host").select("host", "refs", "votes").mapInArrow(_inferred, WRAPPERS), "host"), "wrappers")
    ready = _with_host(parsed.select("page_id", "url", "host", "shape", "packed"), wrappers, size, "left").select("page_id", "url", "shape", "packed", "refs", "slots", "templates")
    done = ready.mapInArrow(_written(by_name), "page_id long, url string, text string, decided_by string")
    return done.withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "decided_by")
