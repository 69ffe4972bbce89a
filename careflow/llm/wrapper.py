"""Main text of HTML pages by wrapper induction (operator 6).

Pages of one host share a template. Each page's whole DOM tree is aligned with a reference tree of its
host (a page of middle size) by simple tree matching: the largest order-preserving
match of equal labels, by dynamic programming over lists of children. Summed over the host's
pages the aligned nodes vote:

- a text that is the same nearly everywhere is template, wherever it stands and whatever it is called;
- an element whose varying text is mostly links is a menu, even if its entries change from page to page;
- the deepest element that holds nearly all other varying text, once a page, is the host's content.

Then every page is read again: the text of its content element (of the article or main element
around it, if there is one), less template, and varying text outside that isn't a menu, in page
order, block by block. Only what votes can't tell is left to names: text that varies like the article but is
something else (reader comments, adverts, notices, forms) goes by fixed lists of elements, roles and whole class names. Hosts with too few
different pages to vote take the content element that most hosts have, or a page's own
article or main element, or its body, and the lists decide alone.

Only trees of labels and text hashes are moved for the induction, never texts.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import tidy
from .words import slices

#: Different pages that a host needs for a wrapper of its own, and for calling a node inside its content template.
LEAST_PAGES, SURE_PAGES = 3, 10
#: Share of pages in which a template node has the same text; share of varying text that the content element holds.
SAME, HOLDS = 0.9, 0.8
#: Share of an element's varying text that is links in a menu.
LINKED = 0.7
#: Elements deeper than this have no node of their own: their text is blocks of the last one above, until they all have ended.
DEEPEST = 512
#: Pairs of different subtrees up to which two lists of children are compared in full; cells of a table that is kept whole.
PAIRS, SMALL = 1 << 16, 4_096
#: Up to so many bytes of wrappers are broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: A host with a thousandth of all pages, but no fewer than this, is dealt over ``SALTS`` tasks.
LARGE_HOST, SALTS = 1_000, 128

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPES = frozenset("html body table ul ol dl select article section div td th".split())
JUNK_TAGS = frozenset("nav footer aside form script style noscript template button select textarea input iframe svg canvas object embed dialog menu head title link meta datalist audio video map".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay overlays newsletter newsletters subscribe subscription sidebar sidebars menu menus navbar navbars nav navs navigation breadcrumb breadcrumbs footer footers masthead topbar comment comments disqus reply replies respond discussion share sharing social related recommend recommended recommendation recommendations widget widgets login signup register search toolbar toolbars pagination pager pagers skip".split()
)
#: What may stand beside these in a name; a name with any other word isn't one of them.
BESIDE = frozenset("area bar block bottom box button buttons col column container footer form global group header icons inner item items label left links list main outer page panel post right row section site slot thread top unit user wrap wrapper".split())
JUNK_HEADERS = frozenset("header headers site-header page-header main-header global-header top-header header-bar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element, or with the label "#" a block's text."""

    __slots__ = ("tag", "label", "children", "junk", "main", "text", "linked")

    def __init__(self, tag: str, label: str, junk: bool = False, main: bool = False, text: str = "", linked: int = 0):
        self.tag, self.label, self.children, self.junk, self.main, self.text, self.linked = tag, label, [], junk, main, text, linked


def junk_name(name: str) -> bool:
    """Whether a whole class name or id is that of boilerplate: ``comment-list`` is, ``social-science`` or ``notice-of-award`` is not."""
    words = [w for w in re.split(r"[-_]+", name) if w and not w.isdigit()]
    return name in JUNK_HEADERS or (any(w in JUNK_WORDS for w in words) and all(w in JUNK_WORDS or w in BESIDE for w in words))


@functools.lru_cache(maxsize=20_000)
def _kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, junk, main) of an element."""
    found = {a.lower(): (b or c or d or "").lower() for a, b, c, d in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role = found.get("role", "")
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articlebody"
    names = f"{found.get('class', '')} {found.get('id', '')}"
    junk = tag in JUNK_TAGS or role in JUNK_ROLES or (not main and tag not in HEADINGS and tag not in ("html", "body") and any(map(junk_name, names.split())))
    label = re.sub(r"\d+", "0", f"{tag}.{found['class']}" if found.get("class") else tag)
    return label, junk, main


def parse(page: str | None) -> Node:
    """A page's tree: elements that are blocks, and each block's text with white space put in order."""
    root = Node("", "")
    stack, held = [root], []
    in_link, linked = False, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                stack[-1].children.append(Node("#", "#", text=text, linked=min(linked, len(text))))
        linked = 0

    page, at = page or "", 0
    inline: list[str] = []  # open inline elements that are junk: their text is left out
    deep, how_deep = [], Counter()  # open elements below DEEPEST: they have no node, but their ends are theirs
    while at < len(page):
        m = _TAG.search(page, at)
        if not inline:
            part = page[at : m.start() if m else len(page)]
            if part:
                held.append(entities.unescape(part) if "&" in part else part)
                if in_link:
                    linked += len(" ".join(held[-1].split()))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m[1]
        if m[1] and how_deep[tag]:
            flush()
            while (last := deep.pop()) != tag:
                how_deep[last] -= 1
            how_deep[tag] -= 1
            continue
        if m[1]:
            if tag in BLOCKS or any(x.tag == tag for x in stack):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        flush()
                        del stack[i:]
                        break
                else:
                    flush()
            elif inline and tag == inline[-1]:
                inline.pop()
            continue
        label, junk, main = _kind(tag, m[3].rstrip(">"))
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in BLOCKS and not main:
            if junk and not m[3].endswith("/>"):
                inline.append(tag)
            continue
        flush()
        inline.clear()
        shut = CLOSES.get(tag, set())
        if deep:
            if deep[-1] == "p" or deep[-1] in shut or (tag in HEADINGS and deep[-1] in HEADINGS):
                how_deep[deep.pop()] -= 1
            deep.append(tag)
            how_deep[tag] += 1
            continue
        for i in range(len(stack) - 1, 0, -1):
            open_tag = stack[i].tag
            if open_tag == "p" or open_tag in shut or (tag in HEADINGS and open_tag in HEADINGS):
                del stack[i:]
            elif open_tag in SCOPES:
                break
        if len(stack) > DEEPEST:
            deep.append(tag)
            how_deep[tag] += 1
            continue
        node = Node(tag, label, junk or (tag == "header" and not any(x.main for x in stack)), main)
        stack[-1].children.append(node)
        stack.append(node)
    flush()
    return root


@functools.lru_cache(maxsize=50_000)
def step(path: int, label: str) -> int:
    """A 56-bit number for the path of labels that goes on from another path's."""
    return int.from_bytes(hashlib.blake2b(f"{path} {label}".encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def below(node: Node, path: int, nth: int) -> list[tuple[Node, int, int]]:
    """A node's children with their paths, by labels alone and with each one's number among equal labels."""
    seen: dict[str, int] = {}
    out = []
    for c in node.children:
        k = seen[c.label] = seen.get(c.label, 0) + 1
        out.append((c, step(path, c.label), step(nth, f"{c.label} {k}")))
    return out


def flat(root: Node) -> tuple[list, ...]:
    """Depth, label, path, numbered path, text hash, code points of text and of links in it (both 0 within elements that are boilerplate by name) of each node, in page order."""
    out: tuple[list, ...] = ([], [], [], [], [], [], [])
    todo = [(c, 0, path, nth, c.junk) for c, path, nth in reversed(below(root, 0, 0))]
    while todo:
        node, depth, path, nth, junk = todo.pop()
        for x, v in zip(out, (depth, node.label, path, nth, text_hash(node.text) if node.text else 0, 0 if junk else len(node.text), 0 if junk else node.linked)):
            x.append(v)
        todo += [(c, depth + 1, p, k, junk or c.junk) for c, p, k in reversed(below(node, path, nth))]
    return out


def _nest(depth: list[int]) -> list[list[int]]:
    """Children of each node (the last list: of the root) from the depths."""
    kids: list[list[int]] = [[] for _ in range(len(depth) + 1)]
    path = [len(depth)]
    for i, d in enumerate(depth):
        del path[d + 1 :]
        kids[path[-1]].append(i)
        path.append(i)
    return kids


class _Shapes:
    """A tree's lists of children, and for each node a number that equal subtrees of labels share."""

    def __init__(self, depth: list[int], label: list[str], numbers: dict):
        self.kids, self.label, n = _nest(depth), [*label, ""], len(depth)
        self.shape, self.size = [0] * (n + 1), [1] * (n + 1)
        for i in [*range(n - 1, -1, -1), n]:  # children come behind their parent, the root's list is last
            kids = self.kids[i]
            self.shape[i] = numbers.setdefault((self.label[i], *(self.shape[k] for k in kids)), len(numbers))
            self.size[i] += sum(self.size[k] for k in kids)


def match(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of nodes of two trees, each given by depths and labels.

    Children with equal subtrees at both ends of two lists are matched at once, which is never worse than any
    other match of these; the lists between take dynamic programming, a row at a time. Sizes are kept by shape, and no call is nested.
    Two lists with more than ``PAIRS`` pairs of different subtrees of one label are matched by
    the most that such a pair could have in common, its smaller size, and only the pairs that are matched are gone into:
    order and labels stay exact there, and the work goes with the number of siblings and no longer with all that is below them.
    """
    numbers: dict = {}
    x, y = _Shapes(*a, numbers), _Shapes(*b, numbers)
    sizes: dict[tuple[int, int], int] = {}

    def ends(i: int, j: int) -> tuple[list[int], list[int], int, int]:
        p, q = x.kids[i], y.kids[j]
        low, most = 0, min(len(p), len(q))
        while low < most and x.shape[p[low]] == y.shape[q[low]]:
            low += 1
        high = 0
        while high < most - low and x.shape[p[-1 - high]] == y.shape[q[-1 - high]]:
            high += 1
        return p, q, low, high

    def open_pairs(p: list[int], q: list[int]) -> list[tuple[int, int]] | None:
        """Different subtrees of one label with children on both sides, one pair for each two shapes; None if there are more than ``PAIRS``."""
        if not p or not q:
            return []
        mine, theirs = ({t.shape[k]: k for k in reversed(side) if t.kids[k]} for t, side in ((x, p), (y, q)))
        by_label: dict[str, list[int]] = {}
        for k in theirs.values():
            by_label.setdefault(y.label[k], []).append(k)
        if sum(len(by_label.get(x.label[m], ())) for m in mine.values()) > PAIRS:
            return None
        return [(m, k) for m in mine.values() for k in by_label.get(x.label[m], ()) if x.shape[m] != y.shape[k]]

    def gain(p: int, q: int, rough: bool) -> int:
        if x.label[p] != y.label[q]:
            return 0
        if x.shape[p] == y.shape[q]:
            return x.size[p]
        if not x.kids[p] or not y.kids[q]:
            return 1
        return min(x.size[p], y.size[q]) if rough else 1 + sizes[x.shape[p], y.shape[q]]

    def small(p: list[int], q: list[int], trace: bool) -> tuple[int, list[tuple[int, int]]]:
        """The same for short lists, with the whole table: 1 a match, 2 from above, 0 from the left."""
        above, how = [0] * (len(q) + 1), []
        for i in p:
            row, came, last = [0], bytearray(len(q) + 1), 0
            for n, j in enumerate(q):
                best, c = last, 0
                if above[n + 1] > best:
                    best, c = above[n + 1], 2
                g = gain(i, j, False)
                if g and above[n] + g >= best:
                    best, c = above[n] + g, 1
                row.append(best)
                came[n + 1], last = c, best
            how.append(came)
            above = row
        pairs, m, n = [], len(p), len(q)
        while trace and m and n:
            if how[m - 1][n] == 1:
                m, n = m - 1, n - 1
                pairs.append((p[m], q[n]))
            elif how[m - 1][n] == 2:
                m -= 1
            else:
                n -= 1
        return above[-1], pairs

    def lists(p: list[int], q: list[int], rough: bool, trace: bool) -> tuple[int, list[tuple[int, int]]]:
        """Size of the largest match of two lists and, if asked for, its pairs."""
        if not p or not q:
            return 0, []
        if len(p) * len(q) <= SMALL and not rough:
            return small(p, q, trace)
        labels: dict[str, int] = {}
        which: dict[int, int] = {}
        column = np.array([which.setdefault(y.shape[k], len(which)) for k in q])
        first = list({y.shape[k]: k for k in reversed(q)}.items())
        first = [k for _, k in sorted(first, key=lambda s: which[s[0]])]  # a node for each different subtree
        kept: dict[int, np.ndarray] = {}
        label_of, size_of, has_kids = np.array([labels.setdefault(y.label[k], len(labels)) for k in first]), np.array([y.size[k] for k in first]), np.array([bool(y.kids[k]) for k in first])

        def gains(i: int) -> np.ndarray:
            """What matching a child is worth with each of the others."""
            if rough:
                most = np.minimum(size_of, x.size[i]) if x.kids[i] else np.ones(len(first), np.int64)
                row = np.where(label_of == labels.get(x.label[i], -1), np.where(has_kids, most, 1), 0)
                if x.shape[i] in which:
                    row[which[x.shape[i]]] = x.size[i]
                return row[column]
            if x.shape[i] not in kept:
                if len(kept) * len(first) > 16 * PAIRS:
                    kept.clear()
                kept[x.shape[i]] = np.array([gain(i, k, False) for k in first])
            return kept[x.shape[i]][column]

        def below_(row: np.ndarray, i: int) -> np.ndarray:
            out = row.copy()
            np.maximum(row[1:], row[:-1] + gains(i), out=out[1:])
            return np.maximum.accumulate(out)

        # Every so many rows one is kept; those between are made again on the way back.
        every, row, marks = int(len(p) ** 0.5) + 1, np.zeros(len(q) + 1, np.int64), []
        for r, i in enumerate(p):
            if r % every == 0:
                marks.append(row)
            row = below_(row, i)
        pairs, n = [], len(q)
        for b in reversed(range(len(marks))) if trace else ():
            rows, part = [marks[b]], p[b * every : (b + 1) * every]
            for i in part:
                rows.append(below_(rows[-1], i))
            r = len(part)
            while r and n:
                g = gain(part[r - 1], q[n - 1], rough)
                if g and rows[r - 1][n - 1] + g == rows[r][n]:
                    r, n = r - 1, n - 1
                    pairs.append((part[r], q[n]))
                elif rows[r - 1][n] > rows[r][n - 1]:
                    r -= 1
                else:
                    n -= 1
        return int(row[-1]), pairs

    rough: set[tuple[int, int]] = set()

    def measure(i: int, j: int) -> None:
        """Sizes of two subtrees' match and of all that it needs."""
        todo = [(i, j)]
        while todo:
            i, j = todo[-1]
            key = x.shape[i], y.shape[j]
            if key in sizes:
                todo.pop()
                continue
            p, q, low, high = ends(i, j)
            rest_p, rest_q = p[low : len(p) - high], q[low : len(q) - high]
            met = open_pairs(rest_p, rest_q)
            if met is None:
                rough.add(key)
            new = [(m, k) for m, k in met or () if (x.shape[m], y.shape[k]) not in sizes]
            if new:
                todo += new
                continue
            todo.pop()
            same = sum(x.size[k] for k in p[:low]) + sum(x.size[k] for k in p[len(p) - high :])
            sizes[key] = same + lists(rest_p, rest_q, key in rough, False)[0]

    pairs, todo = [], [(len(a[0]), len(b[0]))]
    while todo:
        i, j = todo.pop()
        key = x.shape[i], y.shape[j]
        p, q, low, high = ends(i, j)
        found = [*zip(p[:low], q[:low]), *zip(p[len(p) - high :], q[len(q) - high :])]
        p, q = p[low : len(p) - high], q[low : len(q) - high]
        if key not in sizes:  # the roots, or below a pair that was matched by sizes alone
            measure(i, j)
        found += lists(p, q, key in rough, True)[1]
        pairs += found
        todo += [(m, n) for m, n in found if x.kids[m] and y.kids[n]]
    return pairs


_TREE = "host string, page long, depth array<int>, label array<string>, path array<long>, nth array<long>, hash array<long>, size array<int>, linked array<int>, n int, digest long"
_VOTES = "host string, kind int, key long, other long, depth int, a long, b long, most long"


@tidy
def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    for b in (part for whole in batches for part in slices(whole, 2)):
        found = [flat(parse(x.as_py())) for x in b.column(2)]
        digest = [text_hash(repr(t)) for t in found]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([t[i] for t in found], pa.list_(k)) for i, k in enumerate(kinds)), pa.array([len(t[0]) for t in found], pa.int32()), pa.array(digest, pa.int64())], [c.split()[0] for c in _TREE.split(", ")])


@tidy
def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page: votes on nodes of the reference, and varying text by element.

    A row is (host, kind, key, other, depth, a, b, most): kind 0, a reference node's path and text hash: a = same,
    b = 1 for each page that has the node; kind 1, an element's path: a = varying code points within that aren't links, b =
    times in this page; kind 4, the same by numbered path; kind 2: a = all of these, b = 1 page; kind 3, the path of an element with text: a = varying code points in links, b = of all.
    """
    names = [c.split()[0] for c in _VOTES.split(", ")]
    for batch in batches:
        votes: dict[tuple[str, int, int, int, int], list[int]] = {}

        def vote(key: tuple[str, int, int, int, int], a: int, b: int) -> None:
            x = votes.setdefault(key, [0, 0, 0])  # noqa: B023
            x[0] += a
            x[1] += b
            x[2] = max(x[2], b)

        for i in range(batch.num_rows):
            host, depth, label, path, nth, hashed, size, linked, ref = (batch.column(c)[i].as_py() for c in ("host", "depth", "label", "path", "nth", "hash", "size", "linked", "ref"))
            pairs = dict(match((depth, label), (ref["depth"], ref["label"])))
            times: dict[int, int] = {}
            within, above, total = [0] * len(path), [], 0
            for n, d in enumerate(depth):
                del above[d:]
                above.append(n)
                if not hashed[n]:
                    times[path[n]] = times.get(path[n], 0) + 1
                    continue
                j = pairs.get(n)
                same = j is not None and ref["hash"][j] == hashed[n]
                if j is not None:
                    vote((host, 0, ref["path"][j], ref["hash"][j], 0), int(same), 1)
                if not same:
                    vote((host, 3, path[above[-2]] if d else 0, 0, 0), linked[n], size[n])
                    total += size[n] - linked[n]
                    for k in above[:-1]:
                        within[k] += size[n] - linked[n]
            varying: dict[int, tuple[int, int]] = {}
            for n, p in enumerate(path):
                if not hashed[n]:
                    varying[p] = (varying.get(p, (0, 0))[0] + within[n], depth[n])
                    if within[n]:
                        vote((host, 4, nth[n], 0, depth[n]), within[n], 1)
            for p, n in times.items():
                vote((host, 1, p, 0, varying[p][1]), varying[p][0], n)
            vote((host, 2, 0, 0, 0), total, 1)
        keys = list(votes)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)), *(pa.array([votes[k][i] for k in keys], pa.int64()) for i in range(3))], names)


def _main_nodes(root: Node) -> list[Node]:
    """Outermost article or main elements; the body, or all, if there are none."""
    out, todo, bodies = [], [root], []
    while todo:
        n = todo.pop()
        if n.junk:
            continue
        if n.main:
            out.append(n)
            continue
        if n.tag == "body":
            bodies.append(n)
        todo += reversed(n.children)
    return out or bodies or [root]


def _on_the_way(root: Node, target: int, numbered: bool) -> tuple[set[int], set[int]]:
    """Elements at a path (by labels or numbered), and those above them, by identity."""
    at, over = set(), set()
    todo: list[tuple[Node, int, int, tuple]] = [(*c, ()) for c in below(root, 0, 0)]
    while todo:
        n, path, nth, chain = todo.pop()
        if n.text or n.junk:
            continue
        if (nth if numbered else path) == target:
            at.add(id(n))
            while chain:
                over.add(chain[0])
                chain = chain[1]
            continue
        chain = (id(n), chain)
        todo += [(*c, chain) for c in below(n, path, nth)]
    return at, over


def extract(page: str | None, wrapper: str | None) -> str:
    """A page's main text under a wrapper (JSON: content or other, numbered, template, menus)."""
    root, w = parse(page), _loaded(wrapper)
    template, menus = w["template"], w["menus"]
    at, over = _on_the_way(root, w["content"], w.get("numbered", False)) if w.get("content") else (set(), set())
    out: list[str] = []
    voted = bool(at)
    if not voted:  # only the usual element's text, or that of the article, main or body
        at = (_on_the_way(root, w["other"], w.get("numbered", False))[0] if w.get("other") else set()) or {id(n) for n in _main_nodes(root)}
    # With a content element the whole page is read: within it less the template, outside less all constant text and menus.
    todo = [(root, 0, id(root) in at)]
    while todo:
        n, path, inside = todo.pop()
        if n.junk:
            continue
        if n.text:
            if inside:
                keep = not voted or not template.get((step(path, "#"), text_hash(n.text)))
            else:
                keep = voted and path not in menus and (step(path, "#"), text_hash(n.text)) not in template
            if keep:
                out.append(n.text)
            continue
        for c in reversed(n.children):
            todo.append((c, path if c.text else step(path, c.label), inside or id(c) in at or (c.main and id(c) in over)))
    return "\n\n".join(out)


@functools.lru_cache(maxsize=2_000)
def _loaded(wrapper: str | None) -> dict:
    w = json.loads(wrapper) if wrapper else {}
    w["template"] = {(path, text): sure for path, text, sure in w.get("template") or ()}  # sure: within the content element as well
    w["menus"] = frozenset(w.get("menus") or ())
    return w


@tidy
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, 2)):
        texts = [extract(x.as_py(), w) for x, w in zip(b.column("html"), b.column("wrapper").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def induce(rows: DataFrame) -> DataFrame:
    """(host, wrapper, content, numbered) of the hosts with enough different pages, from rows (host, page_id, html)."""
    trees = rows.select("host", "page_id", "html").filter("html is not null").mapInArrow(_trees, _TREE)
    trees = common.stash(trees.dropDuplicates(["host", "digest"]), "wrapper-trees")  # copies of a page vote once
    # Large hosts (a thousand of them at most) are told by broadcast, and dealt over several tasks.
    hosts = trees.groupBy("host").agg(F.count("*").alias("different"), F.percentile_approx("n", 0.5).alias("middle")).filter(F.col("different") >= LEAST_PAGES)
    hosts = common.stash(hosts, "wrapper-hosts")
    is_large = F.col("different") >= max(LARGE_HOST, trees.count() // 1_000)
    large = F.broadcast(hosts.filter(is_large).select("host", "middle", F.lit(SALTS).alias("salts")))
    # The reference: the page that has as many nodes as half of the host's pages have at most, or nearest to it.
    sizes = trees.select("host", "n", "digest").join(large, "host", "left")
    sizes = sizes.filter("salts is not null").drop("salts").unionByName(sizes.filter("salts is null").drop("salts", "middle").join(hosts.filter(~is_large).select("host", "middle"), "host"))
    nearest = sizes.groupBy("host").agg(F.min(F.struct(F.abs(F.col("n") - F.col("middle")), "n", "digest")).alias("x")).select("host", "x.digest")
    reference = trees.join(nearest, ["host", "digest"]).select("host", F.struct("depth", "label", "path", "hash").alias("ref"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = trees.join(large, "host", "left").withColumn("salt", F.pmod("digest", salts))
    copied = reference.join(large, "host", "left").select("host", "ref", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))).alias("salt"))
    votes = dealt.join(copied, ["host", "salt"]).select("host", "depth", "label", "path", "nth", "hash", "size", "linked", "ref").mapInArrow(_align, _VOTES)
    votes = common.stash(votes.groupBy("host", "kind", "key", "other").agg(F.max("depth").alias("depth"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("most").alias("most")), "wrapper-votes")
    pages = votes.filter("kind = 2").select("host", F.col("a").alias("varying"), F.col("b").alias("pages"))
    # The deepest element that holds nearly all varying text: one that is there once a page by its labels, or one by its number among equals.
    content = votes.filter("(kind = 1 and most = 1) or kind = 4").join(pages, "host").filter((F.col("a") >= HOLDS * F.col("varying")) & (F.col("varying") > 0))
    content = content.groupBy("host").agg(F.max_by(F.struct(F.col("key").alias("content"), (F.col("kind") == 4).alias("numbered")), F.struct("depth", F.col("kind") == 1, "a", "key")).alias("x")).select("host", "x.*")
    # A text is template if it is the same in nearly all pages that have its node; within the content only if these are nearly all of many pages.
    sure = ((F.col("pages") >= SURE_PAGES) & (F.col("b") >= SAME * F.col("pages"))).cast("long")
    template = votes.filter("kind = 0").join(pages, "host").filter((F.col("a") >= SAME * F.col("b")) & (F.col("b") >= LEAST_PAGES))
    template = template.groupBy("host").agg(F.sort_array(F.collect_list(F.array("key", "other", sure))).alias("template"))
    menus = votes.filter((F.col("kind") == 3) & (F.col("b") > 0) & (F.col("a") >= LINKED * F.col("b"))).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("menus"))
    wrappers = pages.join(content, "host", "left").join(template, "host", "left").join(menus, "host", "left")
    return common.stash(wrappers.select("host", F.to_json(F.struct("content", "numbered", "template", "menus")).alias("wrapper"), "content", "numbered"), "wrappers")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if none), n_chars (code points).

    A null or empty page has an empty text and takes no part in the induction. Pages without a
    host (null or odd urls) form a host of their own. Repeated rows each give their row; copies of a
    page count and vote once. Other columns aren't read; an
    empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    wrappers = induce(rows)
    usual = wrappers.filter("content is not null").groupBy("content", "numbered").count().orderBy(F.col("count").desc(), "content").limit(1).collect()
    default = json.dumps({"other": usual[0][0], "numbered": usual[0][1]}) if usual else None
    few = (wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES
    known = wrappers.select("host", "wrapper").filter("content is not null")
    joined = rows.join(F.broadcast(known) if few else known, "host", "left").select("page_id", "url", "html", F.coalesce("wrapper", F.lit(default)).alias("wrapper"))
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
