"""Main text of web pages by composite text density.

The page becomes a tree.  Elements whose tag or role says that they are no text of an
article are cut off; the rest gets a density for every node: characters for each tag,
corrected by how much of the node is links.  Text of elements that their class names as
adverts, notices and the like counts as links do, so that a name alone decides nothing.

The node with the largest sum of its children's densities is the main subtree, and the
smallest density on its way up to the body is the threshold.  Nodes beside that way that
reach the threshold are searched for their own largest sums.  What is chosen stays whole,
but for elements named as no article text that are below the threshold.

Each page is one row in one pass over the scan, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, column

# Each part of a tag can be read in one way only, and none is given back.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"'=]+|=\s*+(?>\"[^\"]*\"|'[^']*')?|[\"'])*+)>",
    re.S,
)
#: The same without quotes, for what follows a tag that never ends.
_BARE_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_BEGIN = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_HINT = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements that are opened deeper than this are not nested in each other, so that no way up is long.
_DEEPEST = 256

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body button caption head html option optgroup select tbody td tfoot th thead tr".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

# Tags and roles of what is not article text.
_NOISE_TAGS = frozenset("script style noscript template nav header footer aside form button input select textarea iframe object embed svg canvas audio video dialog menu title head".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of classes and ids.  An element is named as no article text if one of its names is
# made of such words and of words that say only where or what shape it is.
_COMMENT_WORDS = frozenset("comment comments commentlist respond disqus replies".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login sidebar nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "masthead header footer related recommended recommendations share sharing social pagination pager toolbar widget widgets search skip".split()
)
_SHAPE_WORDS = frozenset(
    "area bar block body bottom box buttons card cards col column container content entry group holder inner item items left link links list main mobile module outer page "
    "article articles panel post posts right row section site slot stories story text thread top unit wrap wrapper".split()
)
_ARTICLE_WORDS = frozenset("article entry post story".split())
_HOLDS_TEXT = frozenset({"html", "body", "main"})


class _Node:
    __slots__ = ("tag", "up", "depth", "items", "named", "comments", "role", "hidden", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: "_Node | None", attributes: str = "") -> None:
        self.tag, self.up, self.items, self.depth = tag, up, [], 0 if up is None else up.depth + 1
        self.named, self.comments, self.role, self.hidden = False, False, "", False
        for name, value in _HINT.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                self.role = value.lower()
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.hidden = True
            elif name != "aria-hidden":
                for one in value.split():
                    words = {w.lower() for w in _NAME.findall(one)} - {""}
                    words = {w for w in words if not w.isdigit()}
                    self.comments = self.comments or bool(words & _COMMENT_WORDS) and words <= _COMMENT_WORDS | _SHAPE_WORDS
                    if "header" in words and words & _ARTICLE_WORDS:
                        words.discard("header")  # of an article, and not of the page
                    self.named = self.named or bool(words & _NOISE_WORDS) and words <= _NOISE_WORDS | _SHAPE_WORDS
        if up is not None:
            up.items.append(self)


def parse(page: str) -> _Node:
    """The tree of a page; elements that the standard ends implicitly end here too.

    A tag that the page ends in is no text.  If quotes are the reason why a tag never ends,
    they are not heeded in the rest of the page.
    """
    root = _Node("html", None)
    here, at, token, opened = root, 0, _TOKEN, Counter()

    def leave(node: _Node) -> None:
        nonlocal here
        while here is not node:
            opened[here.tag] -= 1
            here = here.up

    while True:
        begin = _BEGIN.search(page, at)
        text = page[at : begin.start() if begin else len(page)]
        if text:
            here.items.append(html.unescape(text))
        if begin is None:
            return root
        met = token.match(page, begin.start())
        if met is None:
            token = _BARE_TOKEN
            met = token.match(page, begin.start())
        at, name = met.end(), (met[2] or "").lower()
        if not name:
            continue
        if met[1]:
            if opened[name]:
                node = here
                while node is not None and node.tag != name:
                    # The end of an inline element does not end the blocks around it.
                    node = None if name not in _BLOCK and node.tag in _BLOCK else node.up
                if node is not None and node.up is not None:
                    leave(node.up)
            continue
        if name == "html":
            continue
        if name in _ENDS_P and opened["p"]:
            node = here
            while node is not None and node.tag != "p" and (node.tag not in _BLOCK):
                node = node.up
            if node is not None and node.tag == "p" and node.up is not None:
                leave(node.up)
        if name in _SIBLINGS:
            node, stop, to = here, _SCOPE.get(name, {"table"}), here
            while node is not None and node.tag not in stop:
                if node.tag in _SIBLINGS[name] and node.up is not None:
                    to = node.up
                    if name in _SCOPE:
                        break
                node = node.up
            leave(to)
        elif name == "a" and opened["a"]:
            node, to = here, here
            while node is not None and node.tag not in _BLOCK:
                if node.tag == "a":
                    to = node.up
                node = node.up
            leave(to)
        elif name == "body":
            leave(root)
        node = _Node(name, here, met[3])
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            if name in ("textarea", "title"):
                node.items.append(html.unescape(raw))
            at = end.end() if end else len(page)
        elif name not in _VOID and here.depth < _DEEPEST:
            here = node
            opened[name] += 1


def _below(node: _Node) -> Iterator[_Node]:
    """The node and all below it, parents first."""
    stack = [node]
    while stack:
        top = stack.pop()
        yield top
        stack += [x for x in reversed(top.items) if isinstance(x, _Node)]


def _prune(root: _Node) -> None:
    """Cut off what its tag, its role or an attribute says is no article text, and reader comments."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.items = [x for x in node.items if not (isinstance(x, _Node) and _is_cut(x))]
        stack += [x for x in node.items if isinstance(x, _Node)]


def _is_cut(x: _Node) -> bool:
    return x.tag in _NOISE_TAGS or x.hidden or x.role in _NOISE_ROLES or x.comments and x.tag not in _HOLDS_TEXT


def _visible(text: str) -> int:
    return sum(map(len, text.split()))


def _measure(body: _Node) -> list[_Node]:
    """Densities of the body and all below it, and for each node the sum over its children."""
    nodes = list(_below(body))
    blocks: dict[int, int] = {}
    for node in reversed(nodes):
        below = [x for x in node.items if isinstance(x, _Node)]
        node.chars = sum(_visible(x) for x in node.items if isinstance(x, str)) + sum(x.chars for x in below)
        node.tags = len(below) + sum(x.tags for x in below)
        blocks[id(node)] = sum(blocks[id(x)] + (x.tag in _BLOCK) for x in below)
    # What holds the page's largest article, or most of its text in several blocks, is a wrapper, whatever it is called.
    wraps: set[int] = set()
    up = max((x for x in nodes if x.tag in ("article", "main")), key=lambda x: x.chars, default=None)
    while up is not None:
        wraps.add(id(up))
        up = up.up
    for node in nodes:
        if node.tag in _HOLDS_TEXT or id(node) in wraps or (2 * node.chars > body.chars and blocks[id(node)] > 1):
            node.named = False
    for node in reversed(nodes):
        below = [x for x in node.items if isinstance(x, _Node)]
        node.link_chars = node.chars if node.tag == "a" or node.named else sum(x.link_chars for x in below)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in below)
    rate = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c / max(1, c - lc) * lc + rate * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9, max(base, 1 + 1e-9))
        node.total = sum(x.density for x in node.items if isinstance(x, _Node))
    return nodes


def _chosen(body: _Node, nodes: list[_Node]) -> tuple[set[int], float]:
    """The nodes (by identity) whose whole subtrees are the text, and the threshold.

    The node with the largest sum is the first.  On its way up to the body, headings and
    nodes that reach the threshold and are not mostly links are taken as well: of them the
    subtrees with their own largest sums.  What stands beside it in its own article or main
    element is taken whole, if it is not mostly links.
    """
    best = max(nodes, key=lambda x: x.total)
    if not best.total:
        return {id(body)}, 0.0
    way, node = [best], best
    while node is not body:
        node = node.up
        way.append(node)
    threshold = min(x.density for x in way)
    inner = max((k for k, x in enumerate(way) if x.tag in ("article", "main")), default=0)
    chosen = {id(best)}
    for k, up in enumerate(way[1:], 1):
        for at, x in enumerate(up.items):
            if not isinstance(x, _Node):
                if k <= inner or _visible(x) >= threshold:
                    alone = up.items[at] = _Node("span", None)
                    alone.items.append(x)
                    chosen.add(id(alone))
            elif x is not way[k - 1] and x.chars and 2 * x.link_chars <= x.chars:
                if k <= inner or x.tag in _HEADINGS:
                    chosen.add(id(x))
                elif x.density >= threshold:
                    chosen.add(id(max(_below(x), key=lambda y: y.total) if x.total >= threshold else x))
    return chosen, threshold


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _blocks(body: _Node, chosen: set[int], threshold: float) -> list[str]:
    """The texts of the chosen subtrees' blocks in page order, white space as single spaces."""
    done, run = [], []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            done.append(text)

    stack: list = [(body, False)]
    while stack:
        x, inside = stack.pop()
        if x is close:
            close()
            continue
        inside = inside or id(x) in chosen
        if isinstance(x, str):
            if inside:
                run.append(x)
        elif inside and x.named and x.density < threshold and id(x) not in chosen:
            close()
        elif x.tag in _BLOCK:
            close()
            stack += [(close, inside), *((y, inside) for y in reversed(x.items))]
        elif x.tag == "br":
            run.append(" ")
        else:
            stack += [(y, inside) for y in reversed(x.items)]
    close()
    return done


def main_text(page: str | None) -> str:
    """The article's text of one page; empty if there is none."""
    root = parse(page or "")
    _prune(root)
    body = next((x for x in _below(root) if x.tag == "body"), root)
    nodes = _measure(body)
    if not body.chars:
        body = root
        nodes = _measure(body)
    return "\n".join(_blocks(body, *_chosen(body, nodes)))


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row.

    Null and empty pages have an empty text.  Of broken markup as much is read as can be;
    a tag that the page ends in is no text.  Null ids and urls and repeated rows pass
    through, an empty table gives no rows, and other columns are not read.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            texts = [main_text(x) for x in column(batch, html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, id_col), column(batch, url_col), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(rows, ", ".join([*kinds, "text string, n_chars long"]))
