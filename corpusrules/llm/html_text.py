"""Main text of web pages by composite text density.

Every node of a page has a density: characters per tag, lowered by the share of its
characters that stand in links. The sums of the densities of a node's children
tell where the text is; the node with the largest sum is the seed. The least density on
the path from the body to the seed is the threshold. On the way down to the seed a part beside
the path stays if it is as dense as that and has a fair share of the seed's text; in the seed
a dense part stays, a short one if it stands next to one that stays. Lists of links go, and so do
parts whose role says that they are no article text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .rows import add_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
_SPACE = re.compile(r"\s+")
_ATTRIBUTE = re.compile(
    r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.DOTALL
)
_NAMES = re.compile(r"[a-z0-9]+")

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
#: An opening tag ends open elements of these names, up to the nearest of the second set.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table "
    "ul".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Tags of running text: such a part is short for itself and belongs to what it stands next to.
_TEXT = frozenset(
    "#run address blockquote dd dl dt figure h1 h2 h3 h4 h5 h6 li ol p pre table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A part beside the path to the seed has at least this share of the seed's sum; a dense part of
#: the seed at least ``_PEAK`` of its densest part.
_BESIDE, _PEAK = 0.1, 0.1
_FORMATTING = frozenset("a b big code em font i s small strike strong tt u span".split())

#: Roles without article text: by element and by ARIA role.
DROP = frozenset(
    "script style noscript template head title nav aside footer button input select "
    "option textarea label fieldset iframe object embed canvas svg audio video map dialog "
    "menu link meta annotation annotation-xml".split()
)
DROP_ROLES = frozenset(
    "navigation banner complementary contentinfo search form dialog alertdialog alert menu "
    "menubar toolbar".split()
)
#: Words of class and id, which only count together with the share of the page's text and the
#: links: what others say or sell, parts of the layout, and words that articles use as well.
_OTHERS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo "
    "promotion promoted nav navbar breadcrumb breadcrumbs cookie cookies consent gdpr popup modal "
    "comment comments disqus respond replies reply newsletter subscribe subscription signup login "
    "pagination pager".split()
)
_LAYOUT = frozenset(
    "navigation menu sidebar aside footer masthead topbar copyright toolbar skip".split()
)
_LOOSE = frozenset(
    "banner notice notices notification alert overlay share sharing social related recommended "
    "recommendations widget legal disclaimer".split()
)
DROP_NAMES = _OTHERS | _LAYOUT | _LOOSE
#: A part with such a word goes if it has less than this share of the page's text.
_OTHERS_SHARE, _LAYOUT_SHARE, _LOOSE_SHARE = 0.8, 0.4, 0.25


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link", "links", "sum", "density", "block", "words", "holds")

    def __init__(self, tag: str, attrs: str, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.words = None


def parse(page: str) -> Node:
    """A tree of ``Node`` and text; unclosed and misplaced tags are mended, nothing is lost."""
    root = node = Node("#root", "", None)
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            tail = page[at:]
            cut = tail.rfind("<")
            if cut >= 0 and re.match(r"</?[a-zA-Z]", tail[cut:]):
                tail = tail[:cut]  # a tag that the end of the page cuts off
            if tail:
                node.children.append(tail)
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            node = _close(node, name)
            continue
        node = _make_room(node, name)
        child = Node(name, m[3], node)
        node.children.append(child)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            child.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif name not in VOID and not m[3].rstrip().endswith("/") or name in ("p", "div", "a"):
            if name not in VOID:
                node = child
    return root


def _make_room(node: Node, name: str) -> Node:
    if name in _PARAGRAPH_ENDS:
        up = node
        while up.parent is not None and (up.tag in _FORMATTING or up.tag == "p"):
            if up.tag == "p":
                return up.parent
            up = up.parent
        return node
    rule = _CLOSES.get(name)
    if rule:
        up, found = node, None
        while up.parent is not None and up.tag not in rule[1]:
            if up.tag in rule[0]:
                found = up
            up = up.parent
        return found.parent if found is not None else node
    return node


def _close(node: Node, name: str) -> Node:
    up = node
    while up.parent is not None:
        if up.tag == name:
            return up.parent
        up = up.parent
    return node


def dropped(node: Node) -> bool:
    """Has an element, role or state that is never article text; sets ``node.words`` too."""
    node.words = {"form"} if node.tag == "form" else None
    if node.tag in DROP:
        return True
    if not node.attrs.strip():
        return node.tag == "header" and not _in_article(node)
    if node.tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(node.attrs):
        key = m[1].lower()
        value = html.unescape((m[2] or "").strip("\"'")).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in DROP_ROLES:
            if value not in ("form", "search"):
                return True
            node.words = (node.words or set()) | {"form"}
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id"):
            words = DROP_NAMES.intersection(_NAMES.findall(value))
            if words:
                exact = {w for w in words if w in value.split()}
                node.words = (node.words or set()) | words | ({"exact"} if exact else set())
    return node.tag == "header" and not _in_article(node)


def _no_text(node: Node, total: int, density: float) -> bool:
    """Do the words of a node, its links, density and share of the page's text speak against it?"""
    words, part = node.words, node.chars / max(1, total)
    if node.holds or not node.chars:
        return False
    linked = 3 * node.link >= node.chars
    inside = _in_article(node)
    if inside and node.tag in _HEADINGS:
        return False
    if words & _OTHERS and part < _OTHERS_SHARE or "form" in words and part < _LOOSE_SHARE:
        return True
    if inside:
        return linked and part < _LAYOUT_SHARE
    if words & _LAYOUT and part < _LAYOUT_SHARE:
        return True
    thin = "exact" in words and node.density < density
    return bool(words & _LOOSE) and part < _LOOSE_SHARE and (linked or thin)


def _in_article(node: Node) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in ("article", "main"):
            return True
        up = up.parent
    return False


def _weight(root: Node) -> float:
    """Prune roles without text, then characters, tags and density sums, bottom up.

    Returns the share of the page's characters that stand in links.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not dropped(c)]
        stack += [c for c in node.children if not isinstance(c, str)]
    share = _measure(order, root)
    if not any(node.words for node in order):
        return share
    total, gone = root.chars, set()
    for node in order:
        if node.parent in gone or node.words and _no_text(node, total, root.density):
            gone.add(node)
    for node in order:
        node.children = [c for c in node.children if c not in gone]
    return _measure([node for node in order if node not in gone], root)


def _measure(order: list[Node], root: Node) -> float:
    for node in reversed(order):
        _count(node)
        node.holds = node.tag in ("article", "main") and node.chars > 0 or any(
            c.holds for c in node.children if not isinstance(c, str)
        )
    share = root.link / root.chars if root.chars else 0.0
    for node in order:
        node.density = _density(node, share)
    for node in order:
        node.sum = sum(c.density for c in node.children if not isinstance(c, str))
    return share


def _count(node: Node) -> None:
    node.chars = node.tags = node.link = node.links = 0
    node.block = node.tag not in INLINE
    for c in node.children:
        if isinstance(c, str):
            node.chars += len(c.strip())
        else:
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link += c.link
            node.links += c.links
            node.block = node.block or c.block
    if node.tag == "a":
        node.link, node.links = node.chars, node.links + 1


def _density(node: Node, share: float) -> float:
    if not node.chars:
        return 0.0
    plain = node.chars - node.link
    ratio = node.chars / max(1, node.tags)
    base = node.chars * node.link / max(1, plain) + share * node.chars + math.e
    if not node.link:
        return ratio * math.log(max(math.e, node.chars * max(1, node.tags))) / max(1.0, math.log(base))
    inner = (node.chars / max(1, node.link)) * (max(1, node.tags) / max(1, node.links))
    return max(0.0, ratio * math.log(max(1.0, inner)) / max(1.0, math.log(base)))


def _parts(node: Node, share: float) -> list[Node]:
    """Blocks of a node and the runs of text between them, those without text left out."""
    out, run = [], None
    for c in node.children:
        if not isinstance(c, str) and c.block:
            out.append(c)
            run = None
            continue
        if run is None:
            run = Node("#run", "", node)
            out.append(run)
        run.children.append(c)
    for part in out:
        if part.tag == "#run":
            _count(part)
            part.sum = part.density = _density(part, share)
    return [part for part in out if part.chars]


def _link_list(part: Node) -> bool:
    return part.links >= 3 and 2 * part.link >= part.chars


def _spread(parts: list[Node], kept: list[bool], joins: Callable[[Node], bool]) -> None:
    """Parts that ``joins`` accepts stay if an unbroken row of them leads to one that stays."""
    for order in (range(len(parts)), range(len(parts) - 1, -1, -1)):
        near = False
        for i in order:
            near = kept[i] = kept[i] or near and joins(parts[i])


def _choice(parts: list[Node], dense: list[bool], marked: bool) -> list[bool]:
    kept = list(dense)
    alike = {(x.tag, x.attrs) for x, stays in zip(parts, dense, strict=True) if stays}
    _spread(
        parts,
        kept,
        lambda x: (x.tag in _TEXT or (x.tag, x.attrs) in alike) and 2 * x.link < x.chars,
    )
    if True in kept:
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for i, part in enumerate(parts):
            inside = first < i < last
            kept[i] = kept[i] or not _link_list(part) and (marked or inside)
    for i in range(len(parts) - 1, -1, -1):
        if parts[i].tag in _HEADINGS:  # a heading goes the way of what stands under it
            under = i + 1
            while under < len(parts) and parts[under].tag not in _HEADINGS:
                under += 1
            below = kept[i + 1 : under]
            if below:
                kept[i] = any(below)
    return kept if any(kept) else [True] * len(parts)


def _prune(top: Node, seed: Node, threshold: float, share: float) -> None:
    """Keep the parts of ``top`` that belong to the text, see the head of the module."""
    path, up = {seed}, seed
    while up is not top:
        up = up.parent
        path.add(up)
    marked = top.tag in ("article", "main")
    stack = [top]
    while stack:
        node = stack.pop()
        if node.tag in _TEXT or not any(not isinstance(c, str) and c.block for c in node.children):
            continue
        parts = _parts(node, share)
        if node not in path:
            kept = [not _link_list(x) for x in parts]
            kept = kept if any(kept) else [True] * len(parts)
        elif node is seed:
            bar = max(threshold, _PEAK * max((x.density for x in parts), default=0.0))
            dense = [x.density >= bar and not _link_list(x) for x in parts]
            kept = _choice(parts, dense, marked)
        else:
            bar = _BESIDE * seed.sum
            dense = [
                x in path
                or x.density >= threshold and max(x.sum, x.density) >= bar and 2 * x.link < x.chars
                for x in parts
            ]
            kept = _choice(parts, dense, marked)
        node.children = []
        for part, stays in zip(parts, kept, strict=True):
            if not stays:
                continue
            node.children += part.children if part.tag == "#run" else [part]
            if part.tag != "#run":
                stack.append(part)


def _seed(top: Node) -> tuple[Node, float]:
    """The node of ``top`` with the largest sum, and the least density on the way to it."""
    seed, stack = None, [top]
    while stack:
        node = stack.pop()
        if seed is None or node.sum > seed.sum:
            seed = node
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    while not seed.block and seed is not top:
        seed = seed.parent
    threshold, up = seed.density, seed
    while up is not top:
        up = up.parent
        threshold = min(threshold, up.density)
    return seed, threshold


def select(root: Node) -> list[Node]:
    """The subtrees with the main text, other parts taken out; none if the page has no text.

    Several articles: the one with the largest sum, and others that are half as dense as its
    threshold and no links in the main.
    """
    share = _weight(root)
    body, articles = None, []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "body" and body is None:
            body = node
        if node.tag in ("article", "main") and node.chars:
            articles.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    top = body if body is not None and body.chars else root
    if not top.chars:
        return []
    tops = [(x, *_seed(x)) for x in articles or [top]]
    best, _, threshold = max(tops, key=lambda x: x[1].sum)
    tops = [
        x for x in tops
        if x[0] is best or 2 * x[0].density >= threshold and 3 * x[0].link < x[0].chars
    ]
    for x in tops:
        _prune(*x, share)
    return [x[0] for x in tops]


def blocks(node: Node) -> list[str]:
    """Text of each block in page order, references decoded, white space evened out."""
    out, run = [], []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag in INLINE:
            if item.tag == "br":
                run.append(" ")
            stack += reversed(item.children)
        else:
            flush()
            stack.append(None)
            stack += reversed(item.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(text for node in select(parse(page)) for text in blocks(node))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with ``text`` (empty if there is none) and ``n_chars``, its code points.

    A null or empty page gives an empty text; a page that is cut off gives what
    there is. Rows are independent of each other, nothing is shuffled.
    """

    def make():
        def one(page):
            text = main_text(page)
            return text, len(text)

        return one

    return add_columns(df, html_col, "text string, n_chars long", make)
