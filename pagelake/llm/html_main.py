"""Operator 9: main text of raw pages by composite text density.

A page becomes a tree. For every node: C characters and T tags below it, LC and LT of them in links. The composite text
density is C/T * log_base(C/LC * T/LT) with base ln(C/(C-LC) * LC + LC_body/C_body * C + e) (zero denominators count as
1): link-adjusted characters per tag. A node's density sum adds its children's densities; the node with the largest one
holds the main text, and the least density on its path to the body is the threshold: from the body down, the node of the
largest density sum is kept in every subtree that reaches it, and these are joined in page order. The article or main element
around such a node is taken whole; if the first node is in one, only such elements are kept. Elsewhere, link-heavy containers
below the threshold count as menus. Menus, headers,
footers, sidebars, notices, adverts, forms, comments, hidden nodes, scripts and styles are taken out by element, role or
class before densities are computed. Classes and ids count on containers only, as whole names or by their first word
("cookie-notice"), words that may as well name a part of the text ("related-work", "share-price") only beside other words of layout
("related-posts"), in an article or main element as whole classes; what holds most of the page's unlinked text is never
taken out, hidden nodes, scripts and the like apart. Readers' comments are taken out wherever they are, by class or id, unless they
are nearly all of the page.

Blocks are cut at block-level tags; references are decoded and white space in a block is one space; blocks are joined by
an empty line. Nothing else is dropped or capped. A page is one row from start to end: no shuffle.

Defined results: null or empty html, and pages without text, give an empty text; broken or cut-off markup is read as far as
it goes; equal density sums go to the earlier node; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text.
NOISE = frozenset(
    "head title meta link script style noscript template button select option textarea input iframe object embed svg canvas audio video map".split())
#: Elements that hold it only if they hold most of the page.
ASIDE = frozenset("nav footer aside form dialog menu".split())
#: Elements whose class and id count.
CONTAINER = frozenset("div section header nav aside footer form ul ol dl table tbody tr td fieldset details center figure article".split())
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOISE_CLASS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead ad ads advert adverts advertisement banner promo"
    " promoted sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup"
    " share sharing social comment comments respond reply replies related recommended widget toolbar pagination pager login".split())
#: Of these, words that also name parts of a text; they count only where all words of the name are noise or one of LAYOUT.
AMBIGUOUS = frozenset("share sharing social related recommended notice notices alert comment comments respond reply replies header menu widget promo banner login ads sponsor"
                      " consent subscribe subscription popup overlay aside".split())
LAYOUT = frozenset("area bar block body bottom box btn button buttons card cards container content count field form global group heading holder icon icons inner item items left link links list"
                   " main meta more outer page panel post posts primary right row secondary section site slot stories thread title top unit user users wrap wrapper articles".split())
#: Readers' comments, which count in the text as well, by class and by id.
COMMENT = frozenset("comment comments respond replies disqus".split())
#: Elements inside a line of text, never taken alone.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
#: A start tag closes these open elements first.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: ... but not beyond these.
SCOPE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'>/]+)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "noise", "maybe", "up", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "top")

    def __init__(self, tag: str, up: Node | None, noise: bool = False, maybe: int = 0):
        self.tag, self.up, self.noise, self.maybe = tag, up, noise, maybe
        self.kids: list[Node | str] = []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    return out


#: Noise unless it is nearly all of the page's unlinked text (a discussion may be longer than what it is about).
COMMENTS = 2


def is_noise(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """Whether the element is noise, and whether it is unless it holds most of the page's unlinked text (1), or nearly all (COMMENTS)."""
    if tag in NOISE:
        return True, False
    maybe = tag in ASIDE or tag == "header" and not in_article
    if not attrs or not attrs.strip("/ ") or tag in ("html", "body", "main"):
        return False, maybe
    a = attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN.search(a.get("style", "")):
        return True, False
    if maybe or a.get("role", "").lower() in NOISE_ROLE:
        return False, True
    if tag not in CONTAINER:
        return False, False
    classes, ids = a.get("class", "").lower().split(), a.get("id", "").lower().split()
    if tag == "article":
        return False, not {"comment", "comments", "ad", "advert", "promo", "sponsored"}.isdisjoint(classes + ids)
    named = [re.findall(r"[a-z0-9]+", c) for c in classes + ids]
    if any(all(x in COMMENT or x in LAYOUT or x.isdigit() for x in w) and not COMMENT.isdisjoint(w) for w in named):
        return False, COMMENTS
    if in_article:
        # (an id is the anchor of a part there)
        return False, any(w and all(x in NOISE_CLASS and x != "header" for x in w) for w in named[: len(classes)])
    return False, any(w and w[0] in NOISE_CLASS and (w[0] not in AMBIGUOUS or all(x in NOISE_CLASS or x in LAYOUT or x.isdigit() for x in w)) for w in named)


def settle(root: Node) -> None:
    """Decide which of the elements that may be noise are."""
    every = nodes(root)
    for x in every:
        x.chars = x.link_chars = 0
    for x in reversed(every):
        x.chars += sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        if x.tag == "a":
            x.link_chars = x.chars
        if x.up is not None:
            x.up.chars += x.chars
            x.up.link_chars += x.link_chars
    for x in every:
        own, page = x.chars - x.link_chars, root.chars - root.link_chars
        x.noise = bool(x.maybe) and (20 * own <= 19 * page if x.maybe == COMMENTS else 2 * own <= page)


def parse(html: str) -> Node:
    """The tree of a page; text pieces are decoded."""
    root = node = Node("#page", None)
    open_tags: dict[str, list[int]] = {}  # depths of the open elements of each name
    depth = 0

    def pop_to(tags: frozenset | set, stop: frozenset | set = frozenset()) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stop`` is open inside it."""
        nonlocal node, depth
        to = max((open_tags[t][-1] for t in tags if open_tags.get(t)), default=0)
        if not to or any(open_tags[t][-1] > to for t in stop if open_tags.get(t)):
            return
        while depth >= to:
            open_tags[node.tag].pop()
            node, depth = node.up, depth - 1

    pos, n = 0, len(html)
    while pos < n:
        m = MARKUP.search(html, pos)
        start = m.start() if m else n
        if start > pos:
            node.kids.append(unescape(html[pos:start]))
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                node.kids.append("\n")
            elif tag == "p" and not open_tags.get("p"):
                node.kids.append(Node("p", node))
            else:
                pop_to({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "div", "section") else frozenset())
            continue
        if tag == "br":
            node.kids.append("\n")
            continue
        if tag in BLOCK and open_tags.get("p"):
            pop_to({"p"}, {"td", "th", "button", "object"})
        if tag in CLOSES:
            pop_to(set(CLOSES[tag].split()), set(SCOPE[tag].split()))
        if tag in ("body", "html") and open_tags.get(tag):
            continue
        new = Node(tag, node, *is_noise(tag, m[3], bool(open_tags.get("article") or open_tags.get("main"))))
        node.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, pos)
            stop = end.start() if end else n
            if not new.noise:
                new.kids.append(unescape(html[pos:stop]))
            close = html.find(">", stop) if end else -1
            pos = close + 1 if close >= 0 else n
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            depth += 1
            open_tags.setdefault(tag, []).append(depth)
            node = new
    settle(root)
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes that are not noise, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.noise]
    return out


def measure(root: Node) -> list[Node]:
    """Set the counts, density and density sum of every node; returns the nodes."""
    every = nodes(root)
    for x in every:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
    for x in reversed(every):
        x.chars += sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.tags + 1
        if x.up is not None:
            x.up.chars += x.chars
            x.up.tags += x.tags + 1
            x.up.link_chars += x.link_chars
            x.up.link_tags += x.link_tags
    body_ratio = root.link_chars / max(root.chars, 1)
    for x in every:
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, body_ratio)
        x.total = 0.0
    for x in every:
        if x.up is not None:
            x.up.total += x.density
    return every


def density(c: int, t: int, lc: int, lt: int, body_ratio: float) -> float:
    if c == 0:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + body_ratio * c + math.e)
    inner = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    if base <= 1.0 + 1e-12:
        base = 1.0 + 1e-12 if base < 1.0 else base + 1e-12
    # without links the base is e, whose logarithm is 1: the logarithm to that base is the natural one
    return c / max(t, 1) * math.log(max(inner, 1.0)) / max(math.log(base), 1.0)


def main_nodes(root: Node) -> tuple[list[Node], float]:
    """The nodes that hold the main text, in page order, and the density threshold."""
    every = measure(root)
    body = next((x for x in every if x.tag == "body"), root)
    # the node of the largest density sum in each subtree; of equal ones the earliest
    for x in reversed(every):
        x.top = x
        for k in x.kids:
            if isinstance(k, Node) and not k.noise and k.top.tag not in INLINE and (k.top.total > x.top.total):
                x.top = k.top
    best = body.top
    least, at = best.density, best
    while at is not None and at is not body:
        least, at = min(least, at.density), at.up
    threshold = min(least, body.density)
    chosen, stack = set(), [body]
    while stack:
        x = stack.pop()
        if x in chosen or x.chars == 0 or x.tag in INLINE or x.density < threshold - 1e-9:
            continue
        chosen.add(x.top)
        if x.top is not x:
            stack += [k for k in x.kids if isinstance(k, Node) and not k.noise]
    whole = {x: _whole(x) for x in chosen}
    if whole.get(best):
        chosen = {w for w in whole.values() if w}
    else:
        chosen = {w or x for x, w in whole.items()}
    out, covered = [], set()
    for x in every:
        if x.up in covered:
            covered.add(x)
        elif x in chosen:
            out.append(x)
            covered.add(x)
    return out or [body], threshold


def _whole(x: Node) -> Node | None:
    """The outermost article or main element that ``x`` is in."""
    whole = None
    while x is not None:
        if x.tag in ("article", "main"):
            whole = x
        x = x.up
    return whole


def blocks(node: Node, threshold: float) -> list[str]:
    out: list[str] = []
    piece: list[str] = []

    def cut() -> None:
        text = " ".join("".join(piece).split())
        if text:
            out.append(text)
        piece.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            piece.append(x)
        elif not x.noise and not (x is not node and x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.link_chars > 0.8 * x.chars > 0 and x.density < threshold and not _whole(x)):
            if x.tag in BLOCK:
                cut()
                stack.append(None)
            stack += reversed(x.kids)
    cut()
    return out


def main_text(html: str | None) -> str:
    root = parse(html or "")
    chosen, threshold = main_nodes(root)
    return "\n\n".join(b for node in chosen for b in blocks(node, threshold))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(part):
        texts = [main_text(h) for h in part["_html"]]
        return {"id": part["_id"], "url": part["_url"], "text": texts, "n_chars": [len(t) for t in texts]}

    cols = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return per_batch(cols, run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
