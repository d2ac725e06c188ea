"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches

#: Elements of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset("aside button dialog footer head input menu nav select".split())
CONTROLS = frozenset("button input select textarea".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
HEADS = frozenset("h2 h3 h4 h5 h6".split())
#: Words of class and id names that say what stands beside an article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements adbox adslot banner sponsor sponsored sponsors promo promos promotion promotions nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs header masthead topbar footer sidebar side aside rail related recommend recommended recommendation recommendations cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe signup share sharing social login search pagination pager skip adsbygoogle teaser teasers trending".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: May be a part of the article or its comments.
TALK = frozenset("conversation discussion discussions responses".split())
#: Words that say nothing about it, and those that name what a header or a comment belongs to.
PLAIN = frozenset(
    "area bar block body bottom box button buttons container content form forms group holder inner item items left link links list main module outer panel primary region right row section "
    "secondary site slot text thread top unit widget wrap wrapper zone".split()
)
OF_ARTICLE = frozenset("article articles entry page post posts reader story user".split())
HEADERS = frozenset("banner header masthead".split())
#: A name with one of these says how a page is laid out.
LAID_OUT = frozenset("by close closed has have hide no non not off on open show with without".split())
#: What the heading over reader comments may say besides.
AROUND_COMMENTS = frozenset("a add all an from join latest leave on our reader readers recent s the this to top user users visitor visitors write your".split())
#: What a notice says that no name tells of.
NOTICES = frozenset("advertisement consent cookie cookies newsletter subscribe unsubscribe".split())
#: Elements that are weighed by density inside an article.
PARTS = frozenset("article center dd details div dl fieldset form ins ol section span table ul".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar alertdialog".split())
#: An element with one of these open is closed by the same, or by a block for p.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_BARRIER = frozenset("ul ol dl table body html article div section td main aside nav form select".split())
_P_ENDS = BLOCK - frozenset("br head html body option optgroup".split())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE = re.compile(r"\S+\s+\S+\s+\S.*[.!?\u2026\u3002\uff01\uff1f:][\"')\]\u00bb\u201d\u2019]*\Z", re.S)
_RIGHTS = re.compile(r"\s*(?:\u00a9|\(c\)|copyright)", re.I)
#: What a named element is, going by its names alone.
HIDDEN, NAMED, OF_COMMENTS, HEADER, FORM, LABEL = "hidden", "named", "comments", "header", "form", "label"
#: Names of which only a part says so: density decides.
MAYBE, MAYBE_COMMENTS = "maybe", "maybe comments"


class Node:
    """An element: its text in page order as strings and child nodes, and counts for its density."""

    __slots__ = ("beside", "chars", "density", "kids", "kind", "link_chars", "link_tags", "tag", "tags", "total")

    def __init__(self, tag: str, kind: str = "") -> None:
        self.tag, self.kind, self.kids, self.beside = tag, kind, [], False


def named(name: str) -> str:
    """NAMED or OF_COMMENTS if all words of a class or id name say that its element stands beside an article
    or nothing; MAYBE and MAYBE_COMMENTS if some do; else ''.

    has-sidebar, comments-open and side-by-side don't count. Of entry-header, which is a part of the
    article, header doesn't.
    """
    words = {w.lower() for w in _PARTS.findall(name)} - PLAIN
    left = words - OF_ARTICLE
    if not left or left & LAID_OUT or (left <= HEADERS and left != words):
        return ""
    if left <= BESIDE | COMMENTS:
        return OF_COMMENTS if left & COMMENTS else NAMED
    return MAYBE if left & (BESIDE | COMMENTS) - HEADERS else MAYBE_COMMENTS if left & TALK else ""


def _kind(tag: str, attrs: str, in_article: bool) -> str:
    if tag in NOT_CONTENT:
        return HIDDEN
    kind = HEADER if tag == "header" and not in_article else FORM if tag in ("form", "fieldset") else LABEL if tag == "label" else ""
    if not attrs or tag in ("html", "body"):
        return kind
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return HIDDEN
        if name in ("class", "id") and not (name == "id" and tag not in BLOCK):
            for x in map(named, value.split()):
                if x in (MAYBE, MAYBE_COMMENTS):
                    kind = kind or (x if tag in PARTS and tag != "article" else "")
                elif x == OF_COMMENTS or (x and tag not in ("article", "main")):
                    kind = x if kind != OF_COMMENTS else kind
        elif name == "role" and value.lower() in BESIDE_ROLES and tag not in ("article", "main"):
            kind = NAMED if kind in ("", MAYBE, MAYBE_COMMENTS) else kind
    return kind


def parse(html: str) -> Node:
    """The element tree. Unclosed elements end as HTML lets them; stray end tags are ignored; never fails."""
    root = Node("#root")
    stack = [root]
    names = ["#root"]
    at, end = 0, len(html)
    articles = 0

    def pop_to(k: int) -> None:
        nonlocal articles
        articles -= sum(n in ("article", "main") for n in names[k:])
        del stack[k:], names[k:]

    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if tag in BLOCK or not any(n in _BARRIER for n in names[k + 1 :]):
                    pop_to(k)
            elif tag == "p":
                stack[-1].kids.append(Node("p"))
            continue
        if tag in _P_ENDS and "p" in names:
            k = len(names) - 1 - names[::-1].index("p")
            if not any(n in _BARRIER for n in names[k + 1 :]):
                pop_to(k)
        if tag in CLOSES:
            for k in range(len(names) - 1, 0, -1):
                if names[k] in CLOSES[tag]:
                    pop_to(k)
                    break
                if names[k] in _BARRIER:
                    break
        if tag in RAW and not (tag == "svg" and m[3].rstrip().endswith("/")):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            continue
        node = Node(tag, _kind(tag, m[3], articles > 0))
        stack[-1].kids.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            names.append(tag)
            articles += tag in ("article", "main")
    return root


def _ordered(root: Node) -> list[Node]:
    """Parents before their children, without the parts beside the article."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.beside:
            out.append(n)
            todo.extend(k for k in n.kids if type(k) is Node)
    return out


def _headed_comments(n: Node) -> bool:
    """Whether the heading that n begins with says that reader comments follow, or n has a name of that sort and article elements in it."""
    kids = [k for k in n.kids if type(k) is Node and not k.beside]
    words = set()
    if kids and kids[0].tag in HEADS:
        words = set(re.findall(r"[a-z]+", text_of(kids[0]).lower()))
    if words & COMMENTS:
        return words <= COMMENTS | TALK | OF_ARTICLE | AROUND_COMMENTS
    return n.kind == MAYBE_COMMENTS and any(k.tag == "article" for k in _ordered(n))


def _decide(root: Node) -> None:
    """Sets beside. Names only propose: what holds the article element stays, and on a page without one what holds paragraphs with half of the text outside links; comments never."""
    order, todo, parent = [], [root], {}
    while todo:
        n = todo.pop()
        n.beside = n.kind in (HIDDEN, OF_COMMENTS)
        if not n.beside:
            order.append(n)
            kids = [k for k in n.kids if type(k) is Node]
            parent.update((id(k), n) for k in kids)
            todo.extend(kids)
    plain, holds, text = {}, {}, {}
    for n in reversed(order):
        kids = [k for k in n.kids if type(k) is Node and not k.beside]
        plain[id(n)] = 0 if n.tag == "a" else sum(len(k.strip()) for k in n.kids if type(k) is str) + sum(plain[id(k)] for k in kids)
        holds[id(n)] = (n.tag in ("article", "main")) + sum(holds[id(k)] for k in kids)
        text[id(n)] = n.tag == "p" or n.tag in HEADINGS or any(text[id(k)] for k in kids)
    for n in order:
        if n.kind in (NAMED, HEADER, FORM):
            n.beside = not holds[id(n)] and (holds[id(root)] > 0 or not text[id(n)] or plain[id(n)] * 2 <= plain[id(root)])
            if n.kind == HEADER and n.beside:  # not a site's header but an article's, between paragraphs
                beside_p = any(k.tag == "p" if type(k) is Node else not k.isspace() for k in parent[id(n)].kids)
                n.beside = not (beside_p and any(type(k) is Node and k.tag in HEADINGS for k in n.kids))
        elif n.tag in ("div", "section") and _headed_comments(n):
            n.beside = holds[id(root)] > holds[id(n)] or (not holds[id(n)] and plain[id(n)] * 2 <= plain[id(root)])
        elif n.kind == LABEL:
            up = parent[id(n)]
            n.beside = any(type(k) is Node and k.tag in CONTROLS for x in (n, up) for k in x.kids)


def measure(root: Node) -> list[Node]:
    """Sets every node's counts, its composite text density and total, the sum of its children's densities.

    density = chars / tags * log(chars / link chars * tags / link tags) to the base
    ln(chars / other chars * link chars + the page's share of link chars * chars + e), where counts of
    0 stand as 1: few characters per tag and many of them in links lower it.
    """
    nodes = _ordered(root)
    for n in reversed(nodes):
        n.chars = n.link_chars = n.tags = n.link_tags = 0
        for k in n.kids:
            if type(k) is str:
                n.chars += 0 if k.isspace() else len(k) - k.count(" ")
            elif not k.beside:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / max(1, root.chars)
    for n in reversed(nodes):
        chars, tags, links = n.chars, max(1, n.tags), max(1, n.link_chars)
        base = log(chars / max(1, chars - n.link_chars) * links + share * chars + e)
        n.density = chars / tags * max(0.0, log(chars / links * tags / max(1, n.link_tags)) / log(base)) if chars else 0.0
        n.total = sum(k.density for k in n.kids if type(k) is Node and not k.beside)
    return nodes


def _path(nodes: list[Node]) -> list[Node]:
    """From the node with the largest total up to the root; empty if there is no text."""
    best = max((n for n in nodes if n.chars), key=lambda n: (n.total or n.density, n.chars), default=None)
    if best is None:
        return []
    parent = {id(k): n for n in nodes for k in n.kids if type(k) is Node}
    path = [best]
    while id(path[-1]) in parent:
        path.append(parent[id(path[-1])])
    return path


def _weigh(nodes: list[Node], path: list[Node]) -> bool:
    """Sets beside by density for what isn't on the path; whether anything has changed.

    The yardstick is the outermost article element on the path, else the chosen subtree; the threshold is the
    least density on the path. Beside go: what a part of its name proposes, if it has at most half as much
    text outside links as the yardstick and, inside it, a lower density; inside an article element also
    what is below the threshold and mostly links, three or more, and an article element with no more
    text than the outer one has of its own (a teaser or a comment); and what then has only headings left.
    """
    articles = [n for n in path if n.tag == "article"]
    whole = articles[-1] if articles else path[0]
    on, threshold = {id(n) for n in path}, min(n.density for n in path)
    inside = {id(n) for n in _ordered(whole)}
    nested = [n for n in nodes if n.tag == "article" and id(n) in inside and id(n) not in on] if articles else []
    own = whole.chars - whole.link_chars - sum(n.chars - n.link_chars for n in nested)
    emptied = []
    for n in nodes:
        if id(n) in on or n.tag not in PARTS:
            continue
        plain, within = n.chars - n.link_chars, id(n) in inside
        if n.kind == MAYBE:
            n.beside = plain * 2 <= whole.chars - whole.link_chars and (not within or n.density < whole.density)
        if within and articles and not n.beside:
            menu = n.link_tags >= 3 and n.link_chars * 2 > n.chars and n.density < threshold
            n.beside = menu or (n.tag == "article" and plain <= own)
        if n.beside:
            emptied.append(n)
    if not emptied:
        return False
    parent = {id(k): n for n in nodes for k in n.kids if type(k) is Node}
    while emptied:
        up = parent.get(id(emptied.pop()))
        if up is None or id(up) in on or up.beside or up.tag not in PARTS:
            continue
        if all(k.isspace() if type(k) is str else k.beside or k.tag in HEADS or not k.chars for k in up.kids):
            up.beside = True
            emptied.append(up)
    return True


def _belongs(k: Node | str, threshold: float) -> bool:
    """Whether what stands next to the chosen subtree is text of the article too: as dense as the path to the body, a heading or a sentence, and mostly outside links."""
    if type(k) is str:
        return bool(_SENTENCE.match(k.strip())) and not _beside_article(k)
    if not k.chars or k.link_chars * 2 > k.chars:
        return False
    text = text_of(k)
    return (k.tag in HEADINGS or k.density >= threshold or bool(_SENTENCE.match(text))) and not _beside_article(text)


def _beside_article(text: str) -> bool:
    """Whether a text that stands by itself beside the article is a mark of rights or a notice of a sentence or two."""
    words = re.findall(r"[a-z]+", text.lower()) if len(text) <= 300 else []
    speaks = len(words) <= 3 or not {"our", "us", "we", "your"}.isdisjoint(words)
    return bool(_RIGHTS.match(text)) or (speaks and not NOTICES.isdisjoint(words))


def main_node(root: Node) -> Node | None:
    """The subtree with the largest sum of its children's densities, with what belongs to it.

    The threshold is the least density on the path from that subtree up to the body. On the way up,
    what stands beside the path and belongs to the article is kept and the rest is dropped: inside main what
    is mostly links, above an article element all but further article elements as dense as the threshold and
    headings. Inside an article element density decides too (_weigh). Elsewhere menus (three links or more, and
    mostly links) are dropped from the subtree itself.
    """
    _decide(root)
    nodes = measure(root)
    path = _path(nodes)
    if path and _weigh(nodes, path):
        nodes = measure(root)
        path = _path(nodes)
    if not path:
        return None
    best, threshold = path[0], min(n.density for n in path)
    tags = [n.tag for n in path]
    article = len(path) - 1 - tags[::-1].index("article") if "article" in tags else 0
    main = tags.index("main") if "main" in tags else 0
    top = path[article]
    if not article and best.tag != "article":  # menus without a name
        best.kids = [k for k in best.kids if type(k) is str or k.beside or k.tag == "p" or k.link_tags < 3 or k.link_chars * 2 <= k.chars]
    for i in range(article + 1, len(path)):
        up = path[i]
        kept = []
        for k in up.kids:
            if k is path[i - 1] or type(k) is Node and k.beside or type(k) is str and k.isspace():
                kept.append(k)
                continue
            if article:
                good = type(k) is Node and k.link_chars * 2 <= k.chars and (k.tag in HEADINGS or (k.tag == "article" and k.density >= threshold))
            elif i <= main:
                good = type(k) is str or k.link_chars * 2 <= k.chars
            else:
                good = not main and _belongs(k, threshold)
            if good:
                kept.append(k)
                top = up
        up.kids = kept
    return top


def text_of(node: Node) -> str:
    """Its text by blocks: references decoded, white space in a block one space, blocks joined by one."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        k = todo.pop()
        if type(k) is str:
            out.append(unescape(k) if "&" in k else k)
            continue
        if k.beside:
            continue
        if k.tag in BLOCK:
            out.append(" ")
            todo.append(" ")
        todo.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def extract(html: str) -> str:
    """The main text of a page; empty if it has none."""
    node = main_node(parse(html))
    return text_of(node) if node else ""


def main_texts(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (its code points) per row of pages.

    Null and empty html, and pages without an article, give an empty text. Every text is parsed whole
    and malformed markup never fails; repeated rows are extracted each by itself; kept columns may be
    null; further columns are left out; an empty table gives no rows. Stateless, one pass, no shuffle.
    """

    def stage(batches):
        for batch in batches:
            found = [extract(h) if h else "" for h in batch.column("_html").to_pylist()]
            kept = [batch.column(c) for c in keep]
            yield pa.record_batch([*kept, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return map_batches(rows, stage, f"{schema}, text string, n_chars long")
