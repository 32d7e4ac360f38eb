"""Main text of web pages by wrappers, one per host (operator 3).

Wrapper inference. A page becomes a tree of elements and texts. Siblings that
repeat fold into repeated groups, ``(...)+``, whatever their period. The trees of
a host are then aligned one after the other: each mismatch is resolved into a
text slot (texts that differ), an optional group, ``(...)?`` (what only one side
has), or a repeated group (one against many). The result is a union-free regular
expression over tags, slots and template texts; texts below it are counted.

The wrapper decides. Its region is where the host's slot text lies: from the root
down, the one element that holds most of the text outside links and outside
elements that say themselves that they are menus, adverts, forms and the like.
Names such as ``article`` count only where no element holds most. Within the
region, repeated groups of links are menus, and texts that nearly all pages of
the host share are template; slots are the content. A page whose host has no
wrapper that fits is its own host: the wrapper of that page alone decides.

Inference covers all pages. Each task aligns its own pages into partial wrappers,
and passes them on whole where it holds too much; partial wrappers of a host meet
in two steps, salted first, so that no host, however large, brings its pages into
one task. Nothing of a wrapper is forgotten, whatever its size: one task
holds a host's whole wrapper at last. On how many pages a text is, is counted by a
shuffle; of these counts, a host's last task gets those of texts that are template
in some part of its pages, and no other text can be template in all. Plans are
broadcast up to BROADCAST_BYTES, beyond which pages and plans meet by a salted
shuffle.

Defined results: null or empty html: empty text. Rows without a url, or without
a host, are each their own host. Rows that repeat are extracted as rows of their
own. Very long pages are read whole; elements nested deeper than DEEPEST count as
children of the element at that depth. Other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship, spread, staged, unstage

BROADCAST_BYTES = 32 << 20
SALTS = 64
DEEPEST = 100
#: Share of a host's pages that template texts are on, and of the region's text that they may be at most.
SHARED, AT_MOST = 0.8, 0.3
#: Hosts, items and texts that a task holds before it passes them on.
_HOSTS, _ITEMS, _TEXTS = 2000, 100_000, 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|(</?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>|</?[A-Za-z][^>]*\Z|[^<]+|<""", re.S | re.I)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Element names and marks.
_BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_NEVER = frozenset("nav header footer aside form menu dialog button select option head audio video canvas object map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|comments?|reply|replies|disqus|respond|share|sharing|social|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|login|search|toolbar|pagination|pager|complementary|contentinfo|skip(?:-link)?)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story)(?:$|[\s_-])", re.I)
#: Elements that stand for one another wherever they repeat, and those that may be a region.
_ALIKE = frozenset("p li tr td th dt dd option a b i em strong span br code h1 h2 h3 h4 h5 h6".split())
_REGIONS = frozenset("html body div section article main center table tbody tr td".split())
#: What the start of an element closes: names, and where the search for them ends.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_ENDS = frozenset("td th table caption button object li".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind '<' opens, '/' closes, '#' is text; comments, scripts and the like are left out."""
    for m in _TOKEN.finditer(page):
        name = m.group(3)
        if name:
            yield "/" if m.group(2) == "</" else "<", name.lower(), m.group(4) or ""
        else:
            raw = m.group(0)
            if raw[0] != "<" or raw == "<":
                yield "#", "", raw


def _marks(rest: str) -> str:
    return " ".join(a or b or c for a, b, c in _MARK.findall(rest)) if "=" in rest else ""


class Node:
    """An element of a page: its name, what it calls itself, and its children, nodes or raw texts."""

    __slots__ = ("name", "key", "bad", "children")

    def __init__(self, name: str, marks: str = "") -> None:
        self.name, self.children = name, []
        self.key = f"{name}.{re.sub('[0-9]+', '0', marks)}" if marks and name not in ("html", "body") and name not in _MAIN else name
        self.bad = name in _NEVER or bool(marks and name not in ("html", "body") and _BAD.search(marks))


def tree(page: str) -> Node:
    """The page as a tree; ends of elements that are left out are implied."""
    root = Node("")
    stack = [root]
    for kind, name, rest in tokens(page):
        if kind == "#":
            stack[-1].children.append(rest)
        elif kind == "<":
            if name in _BLOCKS and name != "br":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in _P_ENDS:
                        break
            if name in _CLOSES:
                same, ends = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in same:
                        del stack[k:]
                        break
                    if stack[k].name in ends:
                        break
            if name in _MAIN and not any(x.name in _MAIN or x.name == "section" for x in stack):
                # what was left open before the article ends here
                for k in range(1, len(stack)):
                    if stack[k].name in _NEVER:
                        del stack[k:]
                        break
            node = Node(name, _marks(rest))
            stack[min(len(stack), DEEPEST) - 1].children.append(node)
            if name not in _VOID and not rest.endswith("/"):
                stack.append(node)
        else:
            inline = name not in _BLOCKS and name not in _NEVER
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if inline and stack[k].name in _BLOCKS:
                    break
    return root


# ---- wrapper inference -------------------------------------------------------
# Items are lists, so that JSON holds them:
#   ['#', text or None, times seen, characters]      a template text or a slot
#   ['<', key, items, times seen, bad]               an element
#   ['+', items], ['?', items]                       a repeated, an optional group


def _text_id(text: str) -> str:
    """A text, or what stands for a long one."""
    return text if len(text) <= 40 else f"~{zlib.crc32(text.encode()):08x}{zlib.adler32(text[::-1].encode()):08x}{len(text):x}"


def items_of(node: Node) -> list:
    out: list = []
    for c in node.children:
        if isinstance(c, Node):
            out.append(["<", c.key, items_of(c), 1, c.bad])
        elif text := " ".join(html.unescape(c).split()):
            out.append(["#", _text_id(text), 1, len(text)])
    return fold(out)


def _key(x: list):
    """What two items must share to stand for each other; groups have the key of what they hold."""
    while x[0] in "+?" and len(x[1]) == 1:
        x = x[1][0]
    return "#" if x[0] == "#" else x[1] if x[0] == "<" else tuple(map(_key, x[1]))


def _within(x: list) -> set:
    while x[0] in "+?":
        x = x[1][0]
    return set(_flat(x[2])) if x[0] == "<" else set()


def _flat(items: list) -> Iterator[str]:
    for x in items:
        if x[0] in "+?":
            yield from _flat(x[1])
        else:
            yield "#" if x[0] == "#" else x[1]


def _by_name(key: str) -> bool:
    """Is an element found by its key, whatever it holds?"""
    return "." in key or key in _MAIN or key in ("html", "body")


def _kind(x: list, k: str | tuple) -> tuple:
    """What decides which items of key ``k`` an item stands for: the key and, of containers, what they hold and how much of it always."""
    while x[0] in "+?":
        x = x[1][0]
    return (k, None, 0) if not isinstance(k, str) or k == "#" or k in _ALIKE or _by_name(k) else (k, frozenset(_within(x)), len(set(_flat([y for y in x[2] if y[0] != "?"]))))


def _alike(x: tuple, y: tuple) -> bool:
    """Do items of these kinds stand for each other? Containers only if they hold like things; rare parts tell none apart."""
    a, b = x[1], y[1]
    return x[0] == y[0] and (not a or not b or 2 * len(a & b) >= max(1, min(x[2], y[2])))


def _merge(x: list, y: list) -> list:
    """The item that stands for both of two items of one key."""
    if "?" in (x[0], y[0]):
        inner = [z[1] if z[0] == "?" else [z] for z in (x, y)]
        return ["?", [_merge(a, b) for a, b in zip(*inner, strict=True)] if len(inner[0]) == len(inner[1]) else align(*inner)]
    if "+" in (x[0], y[0]):
        inner = [z[1] if z[0] == "+" else [z] for z in (x, y)]
        return ["+", [_merge(a, b) for a, b in zip(*inner, strict=True)] if len(inner[0]) == len(inner[1]) else align(*inner)]
    if x[0] == "#":
        return ["#", x[1] if x[1] == y[1] else None, x[2] + y[2], x[3] + y[3]]
    return ["<", x[1], align(x[2], y[2]), x[3] + y[3], x[4]]


def _group(items: list, times: list[list]) -> list:
    """A repeated group of ``items`` and further rounds of it."""
    for more in times:
        items = [_merge(a, b) for a, b in zip(items, more, strict=True)]
    optional = all(i[0] == "?" for i in items)
    bare = [i[1][0] if i[0] == "?" and len(i[1]) == 1 and (optional or len(items) == 1) else i for i in items]
    if len(bare) == 1 and bare[0][0] == "+":
        bare = bare[0][1]
    return ["?", [["+", bare]]] if optional else ["+", bare]


def fold(items: list) -> list:
    """Tandem repeats become repeated groups, shortest periods first, of any period."""
    period, keys = 1, []
    while 2 * period <= len(items):
        if not keys:
            keys, number = [_key(i) for i in items], {}
            times, run, longest = Counter(keys), 0, 0
            for k in keys:  # repeats lie within runs of items whose keys occur again
                run = run + 1 if times[k] > 1 else 0
                longest = max(longest, run)
            if longest > 1:
                ks, kinds = np.array([number.setdefault(k, len(number)) for k in keys]), list(map(_kind, items, keys))
        if 2 * period > longest:
            break
        same = ks[period:] == ks[:-period]
        if same.sum() < period:
            period += 1
            continue
        out, i, changed = [], 0, False
        run = np.convolve(same, np.ones(period, int), "valid") == period if period > 1 else same
        while i < len(items):
            j = i
            while j < len(run) and run[j] and all(map(_alike, kinds[i : i + period], kinds[j + period : j + 2 * period])) and not (period == 1 and keys[i] == "#"):
                j += period
            if j > i:
                out.append(_group(items[i : i + period], [items[at : at + period] for at in range(i + period, j + period, period)]))
                i, changed = j + period, True
            else:
                out.append(items[i])
                i += 1
        if changed:
            items, keys = out, []
        else:
            period += 1
    return items


def _rounds(items: list, others: list) -> list:
    """``items`` with runs that a repeated group of ``others`` describes made into such groups."""
    has = set(map(_key, items))
    for o in others:
        body = o[1] if o[0] == "+" else o[1][0][1] if o[0] == "?" and o[1][0][0] == "+" else []
        if len(body) < 2 or _key(body[0]) not in has:
            continue
        want, k, out, i = tuple(map(_key, body)), len(body), [], 0
        while i < len(items):
            if tuple(map(_key, items[i : i + k])) == want:
                out.append(["+", items[i : i + k]])
                i += k
            else:
                out.append(items[i])
                i += 1
        if len(out) < len(items):
            items = fold(out)
            has = set(map(_key, items))
    return items


def align(a: list, b: list) -> list:
    """The items that stand for both of two lists: common ones in order, the rest as optional groups."""
    if any(x[0] in "+?" for x in a):
        b = _rounds(b, a)
    if any(x[0] in "+?" for x in b):
        a = _rounds(a, b)
    ka, kb = ([_kind(x, _key(x)) for x in y] for y in (a, b))
    fits = lambda i, j: _alike(ka[i], kb[j])
    i, n, m = 0, len(a), len(b)
    while i < min(n, m) and fits(i, i):
        i += 1
    while n > i and m > i and fits(n - 1, m - 1):
        n, m = n - 1, m - 1
    pairs = [(k, k) for k in range(i)] + [(p + i, q + i) for p, q in _common(ka[i:n], kb[i:m])] + [(k, m + k - n) for k in range(n, len(a))]
    out, at, to, loose = [], 0, 0, False
    for p, q in [*pairs, (len(a), len(b))]:
        for rest in (a[at:p], b[to:q]):
            for x in rest:
                out.append(x if x[0] == "?" else ["?", [x]])
                loose = True
        if p < len(a):
            out.append(_merge(a[p], b[q]))
        at, to = p + 1, q + 1
    return fold(out) if loose else out


def _common(ka: list[tuple], kb: list[tuple]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of kinds, as pairs of places."""
    of: dict = {}
    for k in set(kb):
        of.setdefault(k[0], []).append(k)
    stands = {k: [x for x in of.get(k[0], ()) if _alike(k, x)] for k in set(ka)}
    met = {x for xs in stands.values() for x in xs}
    ps, qs = [p for p, k in enumerate(ka) if stands[k]], [q for q, k in enumerate(kb) if k in met]
    if not ps:
        return []
    # bit r stands for qs[-1 - r]
    width, bits = len(qs), dict.fromkeys(met, 0)
    places: dict = {}
    for r, q in enumerate(reversed(qs)):
        places.setdefault(kb[q], []).append(r)
    for k, rs in places.items():
        raw = bytearray(width // 8 + 1)
        for r in rs:
            raw[r >> 3] |= 1 << (r & 7)
        bits[k] = int.from_bytes(raw, "little")
    mask = {}
    for k in {ka[p] for p in ps}:
        mask[k] = 0
        for x in stands[k]:
            mask[k] |= bits[x]
    # of each suffix of ps: bit r is 0 where the longest grows with qs[-1 - r]; every step-th is kept, those between are found again
    full, step = (1 << width) - 1, isqrt(len(ps)) + 1

    def up(v: int, p: int) -> int:
        u = v & mask[ka[ps[p]]]
        return ((v + u) | (v - u)) & full

    kept, v = {}, full
    for p in range(len(ps), -1, -1):
        v = up(v, p) if p < len(ps) else v
        if p % step == 0 or p == len(ps):
            kept[p] = v
    left = width - v.bit_count()
    out, p, r, rows = [], 0, width - 1, {}
    while left:
        if p + 1 not in rows:
            end = min(len(ps), (p // step + 1) * step)
            rows = {end: kept[end]}
            for k in range(end - 1, p - 1, -1):
                rows[k] = up(rows[k + 1], k)
        if mask[ka[ps[p]]] >> r & 1:
            out.append((ps[p], qs[width - 1 - r]))
            p, r, left = p + 1, r - 1, left - 1
        elif (~rows[p + 1] & ((1 << (r + 1)) - 1)).bit_count() == left:
            p += 1
        else:
            r -= 1
    return out


def _size(items: list) -> int:
    return sum(1 + (0 if x[0] == "#" else _size(x[2] if x[0] == "<" else x[1])) for x in items)


class Wrapper:
    """The wrapper of a host's pages: items, number of pages, and on how many each text is."""

    def __init__(self, items: list | None = None, pages: int = 0, texts: dict[str, int] | None = None) -> None:
        self.items, self.pages, self.texts = items or [], pages, texts or {}

    def add(self, items: list, pages: int, texts: dict[str, int]) -> None:
        self.items = align(self.items, items) if self.pages else items
        self.pages += pages
        for t, n in texts.items():
            self.texts[t] = self.texts.get(t, 0) + n

    def page(self, root: Node) -> None:
        self.add(items_of(root), 1, dict.fromkeys(_texts(root), 1))


def put(held: list[Wrapper], w: Wrapper | None) -> None:
    """Adds a wrapper to a list of wrappers, in which those of no more pages meet it, so that each meets others a logarithm of times; none: all meet."""
    if w is None:
        w = held.pop()
        while held:
            held[-1].add(w.items, w.pages, w.texts)
            w = held.pop()
    while held and held[-1].pages <= w.pages:
        held[-1].add(w.items, w.pages, w.texts)
        w = held.pop()
    held.append(w)


def _texts(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, Node):
            if not c.bad:
                yield from _texts(c)
        elif text := " ".join(html.unescape(c).split()):
            yield _text_id(text)


def infer(pages: list[str]) -> list:
    """The wrapper's items of pages of one host."""
    w = Wrapper()
    for p in pages:
        w.page(tree(p))
    return w.items


def pattern(items: list) -> str:
    """The wrapper as a regular expression over tags, #text slots and template texts."""
    return "".join(f"<{x[1]}>" if x[0] == "<" and x[1].split(".")[0] in _VOID else f"<{x[1]}>{pattern(x[2])}</{x[1].split('.')[0]}>" if x[0] == "<" else ("#text" if x[1] is None else re.escape(x[1])) if x[0] == "#" else f"({pattern(x[1])}){x[0]}" for x in items)


# ---- what the wrapper decides -------------------------------------------------


def _mass(items: list, link: bool = False) -> tuple[int, int]:
    """Characters of text, and of those in links; elements that call themselves menus and the like do not count."""
    own = linked = 0
    for x in items:
        if x[0] == "#":
            own += x[3]
            linked += x[3] * link
        elif x[0] in "+?" or not x[4] or _main_in(x[2]):
            a, b = _mass(x[1] if x[0] in "+?" else x[2], link or x[0] == "<" and x[1].split(".")[0] == "a")
            own, linked = own + a, linked + b
    return own, linked


def _main_in(items: list) -> bool:
    return any(_main_in(x[1]) if x[0] in "+?" else x[0] == "<" and (x[1] in _MAIN or _main_in(x[2])) for x in items)


def _elements(items: list) -> Iterator[list]:
    """Elements right below, those in groups included."""
    for x in items:
        if x[0] == "<":
            yield x
        elif x[0] in "+?":
            yield from _elements(x[1])


def _menus(items: list, path: str, out: set[str]) -> None:
    for x in _elements(items):
        here = f"{path}/{x[1]}"
        own, linked = _mass(x[2])
        if own and linked >= 0.9 * own and x[1].split(".")[0] not in _ALIKE:
            out.add(here)
        else:
            _menus(x[2], here, out)


def decide(w: Wrapper) -> dict:
    """Region (steps from the root), menus within it, template texts."""
    region, items = [], w.items
    while True:
        able = [x for x in _elements(items) if not x[4] or _main_in(x[2])]
        weigh = {id(x): (lambda a, b: a - b)(*_mass(x[2])) for x in able}
        own, linked = _mass(items)
        if any(x[1].split(".")[0] == "h1" for x in able):
            break
        able = [x for x in able if x[1].split(".")[0] in _REGIONS]
        named = [x for x in able if x[1] in _MAIN or x[1].partition(".")[2] and _GOOD.search(x[1].partition(".")[2])]
        best = max(able, key=lambda x: weigh[id(x)], default=None)
        if best is None or weigh[id(best)] < 0.6 * (own - linked) or not weigh[id(best)]:
            best = max(named, key=lambda x: weigh[id(x)], default=None)
            if best is None:
                break
        region.append([best[1], [] if _by_name(best[1]) else sorted(_within(best))])
        items = best[2]
        if best[1] in _MAIN:
            break
    menus: set[str] = set()
    _menus(items, "", menus)
    consts: list[str] = []
    if w.pages >= 3:
        least = w.pages if w.pages < 5 else SHARED * w.pages
        consts = [t for t, n in w.texts.items() if n >= least]
        length = lambda t: len(t) if t[0] != "~" else int(t[17:], 16)
        if sum(map(length, consts)) > AT_MOST * _mass(items)[0] / w.pages:
            consts = []  # the pages are copies of each other
    return {"region": region, "menus": sorted(menus), "consts": sorted(consts)}


# ---- extraction --------------------------------------------------------------


def _find(node: Node, region: list) -> list[Node]:
    if not region:
        return [node]
    key, within = region[0]
    out: list[Node] = []
    for c in node.children:
        if isinstance(c, Node) and c.key == key:
            has = {x.key if isinstance(x, Node) else "#" for x in c.children if isinstance(x, Node) or x.strip()}
            if _by_name(key) or not has or 2 * len(has.intersection(within)) >= min(len(has), len(within)):
                out += _find(c, region[1:])
    return out


def _links(node: Node, link: bool = False) -> tuple[int, int, int]:
    """Characters, those in links, links."""
    own = linked = n = 0
    for c in node.children:
        if isinstance(c, Node):
            a, b, k = _links(c, link or c.name == "a")
            own, linked, n = own + a, linked + b, n + k + (c.name == "a")
        else:
            size = len(c.strip())
            own, linked = own + size, linked + size * link
    return own, linked, n


def blocks(node: Node, menus: frozenset[str] = frozenset()) -> list[str]:
    """The texts of a region, block by block, in page order."""
    out: list[str] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                out.append(text)

    def walk(at: Node, path: str) -> None:
        for c in at.children:
            if not isinstance(c, Node):
                buf.append(html.unescape(c))
                continue
            block = c.name in _BLOCKS or c.name in _NEVER
            if block:
                flush()
            elif c.name == "img":
                buf.append(" ")
            here = f"{path}/{c.key}"
            if not (c.bad and not any(isinstance(x, Node) and x.name in _MAIN for x in c.children)):
                own, linked, n = _links(c) if here in menus else (0, 0, 0)
                if n < 3 or linked < 0.9 * own:
                    walk(c, here)
            if block:
                flush()

    walk(node, "")
    flush()
    return out


def extract(page: str | None, how: dict | None = None) -> str:
    """A page's main text, by ``decide`` of its host's wrapper, or of its own: blocks joined by line feeds."""
    if not page:
        return ""
    root = tree(page)
    found = _find(root, how["region"]) if how else []
    if not found:
        w = Wrapper()
        w.page(root)
        how = decide(w)
        found = _find(root, how["region"])
    got = [t for n in found for t in blocks(n, frozenset(how["menus"]))]
    if how["consts"]:
        consts = frozenset(how["consts"])
        own = [t for t in got if _text_id(t) not in consts]
        got = own or got  # a page that holds nothing else is a copy of what most pages hold
    return "\n".join(got)


# ---- distribution ------------------------------------------------------------

_PARTIAL = "host string, salt int, pages long, wrapper string, texts array<struct<text: string, n: long>>"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's pages: wrappers of hosts and, with the number of pages they are from, counts of their texts."""
    from pyspark import TaskContext

    salt, names = TaskContext.get().partitionId() % SALTS, ["host", "salt", "pages", "wrapper", "texts"]
    held: dict[str, Wrapper] = {}
    texts: dict[str, tuple[list[int], dict[str, int]]] = {}
    n_items, n_texts, full = 0, 0, False

    def rows(hosts: list[str], pages: list[int], wrappers: list | None, counts: list[dict[str, int]] | None) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(hosts), 64):
            h = hosts[s : s + 64]
            w = [json.dumps(x.items, ensure_ascii=False) for x in wrappers[s : s + 64]] if wrappers else [None] * len(h)
            c = [[{"text": t, "n": n} for t, n in x.items()] for x in counts[s : s + 64]] if counts else [None] * len(h)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array([salt] * len(h), pa.int32()), pa.array(pages[s : s + 64], pa.int64()), pa.array(w, pa.string()),
                                              pa.array(c, pa.list_(pa.struct([("text", pa.string()), ("n", pa.int64())])))], names)

    def wrappers() -> Iterator[pa.RecordBatch]:
        yield from rows(list(held), [w.pages for w in held.values()], list(held.values()), None)

    def counts() -> Iterator[pa.RecordBatch]:
        yield from rows(list(texts), [n[0] for n, _ in texts.values()], None, [c for _, c in texts.values()])

    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            root = tree(page)
            items = items_of(root)
            n_items += _size(items)
            held.setdefault(host, Wrapper()).add(items, 1, {})
            n, of = texts.setdefault(host, ([0], {}))
            n[0] += 1
            n_texts -= len(of)
            for t in dict.fromkeys(_texts(root)):
                of[t] = of.get(t, 0) + 1
            n_texts += len(of)
            if n_items > _ITEMS:  # as if pages shared none
                n_items = sum(_size(w.items) for w in held.values())
                full = 2 * n_items > _ITEMS
            if full or len(held) > _HOSTS:
                yield from wrappers()
                held, n_items, full = {}, 0, False
            if n_texts > _TEXTS or len(texts) > _HOSTS:
                yield from counts()
                texts, n_texts = {}, 0
    yield from wrappers()
    yield from counts()


def _join(last: bool):
    """Partial wrappers sorted by host: one per host, and where it is the last step, what it decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held, texts, salt = None, [], {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            if host is None:
                return
            put(held, None)
            w = held[0]
            if not last:
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([salt], pa.int32()), pa.array([w.pages]), pa.array([json.dumps(w.items, ensure_ascii=False)])], ["host", "salt", "pages", "wrapper"])
            elif w.pages > 1:
                w.texts = texts
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(decide(w), ensure_ascii=False)])], ["host", "plan"])

        for b in batches:
            for h, s, n, body, text in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "pages", "wrapper", "text")), strict=True):
                if (h, s) != (host, salt) if not last else h != host:
                    yield from out()
                    host, held, texts, salt = h, [], {}, s
                if text is None:
                    put(held, Wrapper(json.loads(body), n))
                else:
                    texts[text] = n
        yield from out()

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plans: dict[str, dict] = {}
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = []
            for page, p in zip(part.column("html").to_pylist(), part.column("plan").to_pylist(), strict=True):
                if p is not None and p not in plans:
                    if len(plans) > 10_000:
                        plans.clear()
                    plans[p] = json.loads(p)
                texts.append(extract(page, plans.get(p)))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host and plan of every host with two pages or more. ``pages``: host, html."""
    part = staged(pages.where("host <> '' and length(html) > 0").select("host", "html").mapInArrow(_partial, _PARTIAL), "partial")
    none = F.lit(None)
    whole = part.where("wrapper IS NOT NULL").select("host", "salt", "pages", "wrapper", none.cast("string").alias("text"))
    order = ["host", "salt", "pages", "wrapper"]
    whole = whole.repartition("host", "salt").sortWithinPartitions(*order).mapInArrow(_join(False), "host string, salt int, pages long, wrapper string")
    # what is on that share of all pages is on it in some part of them
    texts = (part.select("host", "pages", F.inline("texts")).groupBy("host", "text")
             .agg(F.sum("n").alias("pages"), F.max(F.col("n") >= SHARED * F.col("pages") - 0.001).alias("often")).where("often"))
    both = whole.select(*order, none.cast("string").alias("text")).unionByName(texts.select("host", F.lit(SALTS).alias("salt"), "pages", none.cast("string").alias("wrapper"), "text"))
    plans = staged(both.repartition("host").sortWithinPartitions(*order).mapInArrow(_join(True), "host string, plan string"), "wrappers")
    unstage(part)
    return plans


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    ship(pages.sparkSession)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    pages = spread(pages).withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit(""))))
    plans = wrappers(pages)
    size = plans.agg(F.coalesce(F.sum(F.length("plan") + F.length("host") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        both = pages.join(F.broadcast(plans), "host", "left")
    else:
        both = (pages.withColumn("salt", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS)).cast("int"))
                .join(plans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left"))
    return both.select("page_id", "url", "html", "plan").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
