"""One page's HTML to nested rows; a small helper of the extraction job."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pagelens.functions.text import EDGE

#: Elements of HTML without an end tag, and those a start tag of the given element ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article div section td th main aside nav form select".split())
SILENT = frozenset(("script", "style"))


class _Element:
    __slots__ = ("attrs", "in_head", "node", "parent", "parts", "tag")

    def __init__(self, node: int, parent: _Element | None, tag: str, attrs: dict[str, str], in_head: bool) -> None:
        self.node, self.parent, self.tag, self.attrs, self.in_head, self.parts = node, parent, tag, attrs, in_head, []


class _Tree(HTMLParser):
    """Elements in page order; text goes to its element and all around it when asked for."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[_Element] = []
        self.open: list[_Element] = []

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted, as nothing asks for them."""
        return j

    def _close(self, k: int) -> None:
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for ends in ([{"p"}] if tag in ENDS_P else []) + ([SIBLINGS[tag]] if tag in SIBLINGS else []):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag in ends:
                    self._close(k)
                    break
                if self.open[k].tag in SCOPE:
                    break
        if tag == "body":
            self.open = [e for e in self.open if e.tag == "html"]
        up = self.open[-1] if self.open else None
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        e = _Element(len(self.all), up, tag, seen, bool(up and (up.in_head or up.tag == "head")))
        self.all.append(e)
        if up:
            up.parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if self.open[k].tag in SCOPE and tag not in SCOPE:
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1].parts.append(data)


def _texts(e: _Element, silent: bool = False) -> list[str]:
    """Text pieces below an element in page order, without scripts and styles unless silent."""
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif silent or x.tag not in SILENT or x is e:
            todo.extend(reversed(x.parts))
    return out


def _tight(e: _Element) -> str:
    return "".join(t.strip() for t in _texts(e))


def _spaced(e: _Element) -> str:
    return " ".join(s for t in _texts(e) if (s := t.strip()))


def _join(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


def _netloc(url: str) -> str:
    try:
        return urlsplit(url).netloc
    except ValueError:
        return ""


def _scheme(ref: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", ref)
    return m[1].lower() if m else ""


def _rels(e: _Element) -> list[str]:
    return e.attrs.get("rel", "").lower().split()


def _types(block: object) -> list[str]:
    found: list[str] = []
    todo = [block]
    while todo:
        b = todo.pop()
        if isinstance(b, list):
            todo.extend(reversed(b))
        elif isinstance(b, dict):
            t = b.get("@type")
            found += [str(x) for x in (t if isinstance(t, list) else [t]) if x]
            if isinstance(b.get("@graph"), list):
                todo.append(b["@graph"])
    return found


def _tree(html: str) -> list[_Element]:
    tree = _Tree()
    try:
        tree.feed(html)
        tree.close()
    except (AssertionError, ValueError):
        pass
    return tree.all


def _matches(e: _Element, selector: str) -> bool:
    """Whether an element fits a simple selector: tag, .class, #id and their combinations."""
    tag = re.match(r"[A-Za-z][\w-]*", selector)
    classes = e.attrs.get("class", "").split()
    return (
        (not tag or e.tag == tag[0].lower())
        and all(c in classes for c in re.findall(r"\.([\w-]+)", selector))
        and all(i == e.attrs.get("id") for i in re.findall(r"#([\w-]+)", selector))
    )


def area_text(html: str, include: list[str], exclude: list[str]) -> str | None:
    """Text of the elements that fit one of the include selectors (the body without any), without what fits an exclude one; null if nothing fits."""
    if not include and not exclude:
        return None
    out: list[str] = []
    found = False
    for root in _tree(html):
        if root.parent is not None:
            continue
        todo: list[tuple[object, bool]] = [(root, not include)]
        while todo:
            x, inside = todo.pop()
            if isinstance(x, str):
                if inside and x.strip():
                    out.append(x.strip())
                continue
            if x.tag in SILENT or x.tag == "head" or any(_matches(x, s) for s in exclude):
                continue
            inside = inside or any(_matches(x, s) for s in include)
            found = found or inside
            todo.extend((k, inside) for k in reversed(x.parts))
    return " ".join(out) if found else None


def dom_xml(html: str) -> str:
    """The element tree as well-formed XML, for XPath: names and attributes that XML doesn't allow are left out."""
    name = re.compile(r"[A-Za-z_][\w.-]*$")
    clean = lambda t: re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", t).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    out = ["<dom>"]
    todo: list[object] = [e for e in reversed(_tree(html)) if e.parent is None]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(clean(x))
        elif name.match(x.tag):
            out.append(f"<{x.tag}" + "".join(f' {k}="{clean(v)}"' for k, v in x.attrs.items() if name.match(k)) + ">")
            todo.append((f"</{x.tag}>",))
            todo.extend(reversed(x.parts))
        else:
            todo.extend(reversed(x.parts))
    return "".join(out) + "</dom>"


_VOWELS = re.compile("[ae]+")
_SILENT_E = re.compile(r"[^ae]*+[ae]++[^ae].*e\.*")
_SENTENCE = re.compile("[.!?]+")
#: Shapes of words whose syllables a task remembers at most, and characters of such a shape.
_KNOWN_WORDS = 1 << 15
_KNOWN_CHARS = 32


class _Shape(dict):
    """For str.translate: white space as a blank, e as it is, other vowels as a, marks at the ends of words as a dot and all else as b, which is what syllables depend on."""

    def __missing__(self, code: int) -> str:
        return "b"


_SHAPE = _Shape({ord(c): to for chars, to in ((" \t\n\r\f\v", " "), ("aiouy", "a"), ("e", "e"), (EDGE, ".")) for c in chars})


def _syllables(shape: str) -> int:
    """Of a word's shape: runs of vowels, without a silent e; one for a word without vowels, none for one of marks alone."""
    n = len(_VOWELS.findall(shape))
    return n - (_SILENT_E.fullmatch(shape) is not None) if n else int("b" in shape)


def text_counts(texts: list[str], known: dict[str, int]) -> tuple[list[int], list[int], list[int]]:
    """Words, ends of sentences and syllables of each text, as text.flesch counts them; known keeps the syllables of shapes of words from one call to the next.

    A text has few shapes, also where nearly all of its words are different.
    """
    words, sentences, syllables = [], [], []
    for text in texts:
        shapes = text.lower().translate(_SHAPE).split()
        total = 0
        for w in shapes:
            k = known.get(w)
            if k is None:
                k = _syllables(w)
                if len(w) <= _KNOWN_CHARS and len(known) < _KNOWN_WORDS:
                    known[w] = k
            total += k
        words.append(len(shapes))
        sentences.append(len(_SENTENCE.findall(text)))
        syllables.append(total)
    return words, sentences, syllables


def parse_page(url: str, html: str) -> dict:
    """The nested row of a page; see plans.extract for its schema. Never fails: what can't be read is left out."""
    nodes = _tree(html)
    by: dict[str, list[_Element]] = {}
    for e in nodes:
        by.setdefault(e.tag, []).append(e)
    metas, links = by.get("meta", []), by.get("link", [])
    meta = lambda name, key="name": next((m.attrs["content"] for m in metas if m.attrs.get(key, "").lower() == name and m.attrs.get("content")), None)
    descriptions = [m for m in metas if m.attrs.get("name", "").lower() == "description"]
    canonicals = [x for x in links if "canonical" in _rels(x)]
    raw = canonicals[0].attrs.get("href") if canonicals else None
    base = _netloc(url)

    refs = []
    for a in by.get("a", []):
        href = a.attrs.get("href", "").strip()
        if href and _scheme(href) in ("", "http", "https"):
            full = _join(url, href)
            alt = "".join(i.attrs.get("alt", "") for i in by.get("img", []) if i.parent is a)
            refs.append(
                {"href": full, "anchor": _tight(a) or alt, "rel": a.attrs.get("rel", "").split(), "is_internal": _netloc(full) == base, "target": a.attrs.get("target")}
            )

    def rel_href(rel: str, also: str = "") -> str | None:
        return next((_join(url, x.attrs["href"]) for x in links if rel in _rels(x) and x.attrs.get("href") and (not also or also in x.attrs)), None)

    resources, seen = [], set()
    for e in nodes:
        kind, ref = None, None
        if e.tag == "link" and "stylesheet" in _rels(e):
            kind, ref = "css", e.attrs.get("href")
        elif e.tag == "script":
            kind, ref = "js", e.attrs.get("src")
        elif e.tag in ("video", "audio", "source", "iframe"):
            kind, ref = "media", e.attrs.get("src")
        if kind and ref and (kind, full := _join(url, ref)) not in seen:
            seen.add((kind, full))
            resources.append({"url": full, "kind": kind})

    whole = lambda v: int(v) if v and v.isdigit() else None
    images = [
        {
            "node_id": i.node,
            "src": _join(url, i.attrs["src"]),
            "alt": i.attrs.get("alt"),
            "width": whole(i.attrs.get("width")),
            "height": whole(i.attrs.get("height")),
            "loading": i.attrs.get("loading"),
            "fetchpriority": i.attrs.get("fetchpriority"),
            "decorative": i.attrs.get("role") in ("presentation", "none") or i.attrs.get("aria-hidden") == "true",
            "srcset": [_join(url, c.split()[0]) for c in i.attrs.get("srcset", "").split(",") if c.split() and not c.strip().startswith("data:")],
        }
        for i in by.get("img", [])
        if i.attrs.get("src")
    ]
    jsonld = []
    for s in by.get("script", []):
        if s.attrs.get("type", "").strip().lower() == "application/ld+json":
            text = "".join(_texts(s, silent=True)).strip()
            try:
                block = json.loads(text)
                jsonld.append({"block": json.dumps(block, ensure_ascii=False), "types": _types(block), "error": None})
            except ValueError as error:
                jsonld.append({"block": text, "types": [], "error": str(error)[:200]})
    bodies = by.get("body") or by.get("html") or []
    main = _spaced(bodies[0]) if bodies else " ".join(s for e in nodes if e.parent is None for s in [_spaced(e)] if s)
    roots = [e for e in nodes if e.parent is None]
    full = " ".join(s for e in roots if e.tag not in SILENT and (s := _spaced(e)))
    parents = {e.node: e for e in nodes}
    # of each element: the last one below it, its place among the children of its parent, and how many these are
    last_id, nth, children = {e.node: e.node for e in nodes}, {}, {}
    for e in nodes:
        up = e.parent.node if e.parent else None
        nth[e.node] = children[up] = children.get(up, 0) + 1
    for e in reversed(nodes):
        if e.parent:
            last_id[e.parent.node] = max(last_id[e.parent.node], last_id[e.node])

    def ancestors(e: _Element) -> list[dict]:
        out, up = [], e.parent
        while up is not None and len(out) < 64:
            out.append({"tag": up.tag, "role": up.attrs.get("role"), "aria_hidden": up.attrs.get("aria-hidden") == "true"})
            up = up.parent
        return out

    return {
        "title": _tight(by["title"][0]) if "title" in by else None,
        "title_count": len(by.get("title", [])),
        "meta_desc": descriptions[0].attrs.get("content") if descriptions else None,
        "meta_desc_count": len(descriptions),
        "meta_robots": meta("robots"),
        "meta_keywords": meta("keywords"),
        "viewport": meta("viewport"),
        "generator": meta("generator"),
        "canonical": _join(url, raw) if raw else None,
        "canonical_raw": raw,
        "canonical_count": len(canonicals),
        "canonical_in_head": bool(canonicals and canonicals[0].in_head),
        **{f"h{k}": [t for e in by.get(f"h{k}", []) if (t := _tight(e))] for k in range(1, 7)},
        "links": refs,
        "resources": resources,
        "images": images,
        "jsonld": jsonld,
        "microdata_types": list(dict.fromkeys(e.attrs["itemtype"].rstrip("/").split("/")[-1] for e in nodes if e.attrs.get("itemtype"))),
        "rdfa_types": list(dict.fromkeys(t for e in nodes for t in e.attrs.get("typeof", "").split())),
        "og": {m.attrs["property"]: m.attrs["content"] for m in metas if m.attrs.get("property", "").startswith("og:") and m.attrs.get("content")},
        "twitter": {m.attrs["name"]: m.attrs["content"] for m in metas if m.attrs.get("name", "").startswith("twitter:") and m.attrs.get("content")},
        "hreflang": [{"lang": x.attrs["hreflang"], "href": x.attrs["href"]} for x in links if "alternate" in _rels(x) and x.attrs.get("hreflang") and x.attrs.get("href")],
        "prev_url": rel_href("prev"),
        "next_url": rel_href("next"),
        "amp_url": rel_href("amphtml"),
        "mobile_alternate": rel_href("alternate", "media"),
        "lang": by["html"][0].attrs.get("lang") if "html" in by else None,
        "main_text": main,
        "full_text": full,
        "forms_count": len(by.get("form", [])),
        "dom_node_count": len(nodes),
        "elements": [
            {
                "node_id": e.node,
                "parent_id": e.parent.node if e.parent else None,
                "last_id": last_id[e.node],
                "nth": nth[e.node],
                "siblings": children[e.parent.node if e.parent else None],
                "tag": e.tag,
                "attrs": e.attrs,
                "text": _spaced(e) if e.tag not in ("html", "body", "head", "main", "article", "div", "section", "ul", "ol", "table", "tbody", "form", "nav") else "",
                "in_head": e.in_head,
                "ancestors": ancestors(e),
            }
            for e in parents.values()
        ],
    }
