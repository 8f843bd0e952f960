"""Main text of web pages by ratios of text and punctuation per tag path."""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from hushframe.llm.common import fields, map_rows

#: Fixed values of the markup language.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new element of the same group closes, up to their container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: What never is main text.
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video "
    "nav footer aside button select textarea menu dialog search".split()
)
NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar alert "
    "alertdialog dialog toolbar".split()
)
#: Words in class and id that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored "
    "promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "side aside rail footer masthead cookie cookies consent gdpr notice notices alert "
    "newsletter subscribe subscription signup login popup modal overlay share sharing "
    "social related recommended recommendations comment comments commentlist disqus "
    "respond reply replies toolbar widget widgets pagination pager skip".split()
)
#: Names that hold a word of the above but mean the text itself.
CONTENT = frozenset("article content main post entry story body text".split())
KEEPS = frozenset({"article", "main"})
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_END = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCT = re.compile(r"[.,;:!?。，；！？…]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


#: Deeper elements become neighbours, as in browsers; it bounds all ways up.
DEPTH = 500


@dataclass(eq=False)
class Node:
    tag: str
    path: int  # number of the tag path from the root
    parent: Node | None
    out: bool = False  # furniture, or inside it
    link: bool = False
    kept: bool = False  # inside an article
    named: bool = False  # class or id names furniture
    depth: int = 0


@dataclass
class Leaf:
    """The text between two tags."""

    text: str
    node: Node
    block: int
    score: float = 0.0
    kept: bool = field(default=False)


def _named(value: str) -> bool:
    """Whether a class or id names furniture.

    Its last word decides, as in ``story-share``; before that, a word for the text itself
    outweighs one for furniture, but for adverts and comments.
    """
    words = [n.lower() for n in _NAMES.findall(value)]
    if not words:
        return False
    if words[-1] in FURNITURE:
        return True
    names = set(words)
    return bool(names & FURNITURE and not (names & CONTENT and not names & {"ad", "ads", "comments"}))


def _furniture(tag: str, attrs: dict[str, str], parent: Node) -> tuple[bool, bool]:
    """Whether an element is out, and whether it may be, if it is not around the text."""
    if tag in NEVER or attrs.get("role", "").lower() in NEVER_ROLES:
        return True, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True, False
    if _HIDDEN.search(attrs.get("style", "")):
        return True, False
    if tag == "header" and not parent.kept:
        return True, False
    if tag == "form":
        return False, True
    if tag in ("html", "body", *KEEPS) or (tag == "p" and parent.kept):
        return False, False
    return False, any(_named(x) for k in ("class", "id") for x in attrs.get(k, "").split())


def _attributes(tag: str) -> dict[str, str]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(tag)}
    found = {k: html.unescape(v) if "&" in v else v for k, v in found.items()}
    if re.search(r"\shidden(?=[\s/>])", tag):
        found.setdefault("hidden", "")
    return found


def leaves(page: str) -> list[Leaf]:
    """Text leaves in page order, with their tag paths and block numbers."""
    node = root = Node("", 0, None)
    paths: dict[tuple[int, str], int] = {}
    out: list[Leaf] = []
    block, at, size = 0, 0, len(page)
    while at < size:
        lt = page.find("<", at)
        end = size if lt < 0 else lt
        if end > at:
            out.append(Leaf(page[at:end], node, block))
        if lt < 0:
            break
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = size if stop < 0 else stop + 3
            elif page.startswith(("<!", "<?", "</"), lt):
                stop = page.find(">", lt)
                at = size if stop < 0 else stop + 1
            else:
                out.append(Leaf("<", node, block))
                at = lt + 1
            continue
        tag, closing = m[1].lower(), page[lt + 1] == "/"
        stop = _END.match(page, m.end())
        at = stop.end() if stop else (page.find(">", m.end()) + 1 or size)
        if closing:
            block += tag in BLOCK
            up = node
            while up is not root and up.tag != tag:
                if up.tag in BLOCK and tag not in BLOCK:
                    up = root  # a stray inline end tag closes no block
                    break
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        if tag in BLOCK:
            block += 1
            up = node
            while up.tag not in BLOCK and up is not root:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in CLOSES:
            same, within = CLOSES[tag]
            up = node
            while up is not root and up.tag not in within:
                if up.tag in same:
                    node = up.parent
                up = up.parent
        if tag in VOID:
            if tag == "br":
                out.append(Leaf(" ", node, block))
            continue
        attrs = _attributes(page[m.end() : at]) if at - m.end() > 1 else {}
        is_out, named = _furniture(tag, attrs, node)
        if node.depth >= DEPTH:
            node = node.parent
        path = paths.setdefault((node.path, tag), len(paths) + 1)
        new = Node(tag, path, node, is_out or node.out, tag == "a" or node.link)
        new.kept, new.depth, new.named = node.kept or tag in KEEPS, node.depth + 1, named
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else size
            if close:
                at = page.find(">", at) + 1 or size
            continue
        node = new
    return out


def score_paths(found: list[Leaf], sigma: float = 1.0) -> float:
    """Give each leaf the score of its tag path; return the threshold.

    Per path: characters of text per leaf, and punctuation per leaf.  Both run over the
    leaves in page order through a Gaussian of width ``sigma``, are averaged per path
    again, and are fused as their product.  The threshold is the standard deviation
    of the scores, at most half of the largest one.
    """
    if not found:
        return 0.0
    paths: dict[int, list[float]] = {}
    for leaf in found:
        size = 0 if leaf.node.link else len(leaf.text.strip())
        sums = paths.setdefault(leaf.node.path, [0.0, 0.0, 0.0])
        sums[0] += size
        sums[1] += len(_PUNCT.findall(leaf.text)) if size else 0
        sums[2] += 1
    text = [paths[x.node.path][0] / paths[x.node.path][2] for x in found]
    marks = [paths[x.node.path][1] / paths[x.node.path][2] for x in found]
    reach = math.ceil(2 * sigma)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            low, high = max(0, i - reach), min(len(values), i + reach + 1)
            w = weights[low - i + reach : high - i + reach]
            out.append(sum(a * b for a, b in zip(w, values[low:high])) / sum(w))
        return out

    fused: dict[int, list[float]] = {}
    for leaf, t, p in zip(found, smooth(text), smooth(marks)):
        sums = fused.setdefault(leaf.node.path, [0.0, 0.0])
        sums[0] += t * (1 + p)
        sums[1] += 1
    for leaf in found:
        leaf.score = fused[leaf.node.path][0] / fused[leaf.node.path][1]
    scores = [x.score for x in found]
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return min(spread, max(scores) / 2)


def _without_named(found: list[Leaf]) -> list[Leaf]:
    """Leaves outside forms and elements whose names are those of furniture.

    Such an element stays if it is around the page's text: if more than half of the
    text outside links is in it, of that in articles where there are any.
    """
    worded = [x for x in found if not x.node.link and x.text.strip()]
    worded = [x for x in worded if x.node.kept] or worded
    held: dict[int, int] = {}
    total = 0
    for leaf in worded:
        size, node = len(leaf.text.strip()), leaf.node
        total += size
        while node is not None:
            if node.named:
                held[id(node)] = held.get(id(node), 0) + size
            node = node.parent
    cut: dict[int, bool] = {}

    def is_cut(node: Node | None) -> bool:
        seen = []
        while node is not None and id(node) not in cut:
            seen.append(node)
            node = node.parent
        yes = node is not None and cut[id(node)]
        for n in reversed(seen):
            yes = yes or n.named and 2 * held.get(id(n), 0) <= total
            cut[id(n)] = yes
        return yes

    return [x for x in found if not is_cut(x.node)]


def _ancestors(node: Node | None) -> list[Node]:
    """From the root down."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out[::-1]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, in page order, joined by a blank line.

    Leaves inside furniture are left out.  Of the others, those on content paths (by
    ``score_paths``) mark where the article is: the element around all of those inside
    ``article`` and ``main`` or all outside, whichever have the larger sum of scores,
    widened to the nearest ``article`` or ``main``.  All blocks in there belong to the text, but
    for leaves off the content paths that are lists of links only.
    """
    found = _without_named([x for x in leaves(page or "") if not x.node.out])
    worded = [x for x in found if x.text.strip()]
    if not worded:
        return ""
    least = score_paths(worded)
    marked = [x for x in worded if x.score >= least] or worded
    sums = {kept: sum(x.score for x in marked if x.node.kept is kept) for kept in (True, False)}
    kept = sums[True] >= sums[False] and any(x.node.kept for x in marked)
    chains: dict[int, list[Node]] = {
        id(x.node): _ancestors(x.node) for x in marked if x.node.kept is kept
    }
    first, *others = chains.values()
    depth = len(first)
    for chain in others:
        depth = min(depth, len(chain))
        while first[depth - 1] is not chain[depth - 1]:
            depth -= 1
    around = first[:depth]
    tops = [n for n in around if n.tag in KEEPS]
    if tops:
        top = tops[0]
    else:
        blocks = [n for n in around if n.tag in BLOCK and n.tag not in ("p", "li", "td")]
        top = blocks[-1] if blocks else around[0]
    under: dict[int, bool] = {id(top): True}

    def within(node: Node | None) -> bool:
        seen = []
        while node is not None and id(node) not in under:
            seen.append(node)
            node = node.parent
        yes = node is not None and under[id(node)]
        under.update((id(n), yes) for n in seen)
        return yes

    texts: dict[int, list[Leaf]] = {}
    for leaf in found:
        if within(leaf.node):
            texts.setdefault(leaf.block, []).append(leaf)
    blocks = []
    for parts in texts.values():
        worded = [x for x in parts if x.text.strip()]
        if worded and all(x.node.link and x.score < least for x in worded):
            continue
        raw = "".join(html.unescape(x.text) if "&" in x.text else x.text for x in parts)
        if line := " ".join(raw.split()):
            blocks.append(line)
    return "\n\n".join(blocks)


def extract_text(df: DataFrame, key: str, markup: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Main text of every page: ``key, *carry, text, n_chars``.

    Null or empty markup, and pages without text of their own, give an empty text.
    Every row gives one row, equal keys too.
    """

    def make():
        def extract(keys, pages, *kept):
            texts = [main_text(p) for p in pages]
            return keys, *kept, texts, [len(t) for t in texts]

        return extract

    schema = f"{fields(df, key, *carry)}, text string, n_chars bigint"
    return map_rows(df, [key, markup, *carry], schema, make)
