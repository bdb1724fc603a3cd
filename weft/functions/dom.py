"""HTML trees where regular expressions cannot serve: a small tree builder, selectors, Markdown, structured data.

Pure Python on the standard parser, applied to Arrow batches by ``weft.operators.extract``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"}
HIDDEN = {"script", "style", "noscript", "iframe", "svg", "template", "head"}
#: What an opening tag closes when it meets it open.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
CLOSES |= {b: {"p"} for b in ("div", "ul", "ol", "table", "section", "article", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "form")}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in HIDDEN - {"head"} else c.text() for c in self.children)

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^\]\s]+)))?\s*\]|:(?P<pseudo>first-child|last-child)""")


def _compound(text: str) -> list[tuple]:
    out, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"selector: {text!r}")
        out.append(tuple(m.group(k) for k in ("tag", "id", "cls", "attr", "op", "pseudo")) + (next((x for x in (m["q"], m["s"], m["v"]) if x is not None), None),))
        at = m.end()
    return out


def selector(text: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives of steps (combinator, tests); combinators are ' ', '>', '+' and '~'."""
    out = []
    for part in re.split(r",(?![^\[]*\])", text):
        tokens = re.findall(r"\s*[>+~]\s*(?![^\[]*\])|(?:\[[^\]]*\]|[^\s>+~\[])+|\s+", part.strip())
        steps, combinator = [], " "
        for t in tokens:
            if t.strip() in (">", "+", "~"):
                combinator = t.strip()
            elif t.strip():
                steps.append((combinator, _compound(t.strip())))
                combinator = " "
        if not steps:
            raise ValueError(f"selector: {text!r}")
        out.append(steps)
    return out


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, id_, cls, attr, op, pseudo, value in tests:
        own = node.attrs.get(attr) if attr else None
        if tag and tag != "*" and node.tag != tag.lower() or id_ and node.attrs.get("id") != id_ or cls and cls not in node.classes():
            return False
        if attr and (own is None or op and not {"=": own == value, "~=": value in own.split(), "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value), "*=": bool(value) and value in own, "|=": own == value or own.startswith(f"{value}-")}[op]):
            return False
        if pseudo:
            mates = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else [node]
            if node is not mates[0 if pseudo == "first-child" else -1]:
                return False
    return True


def _matches(node: Node, steps: list[tuple[str, list[tuple]]]) -> bool:
    combinator, tests = steps[-1]
    if not _fits(node, tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if combinator in "+~":
        mates = [c for c in node.parent.children if isinstance(c, Node)] if node.parent else []
        before = mates[: next(i for i, c in enumerate(mates) if c is node)]
        return any(_matches(c, rest) for c in (before[-1:] if combinator == "+" else before))
    up = node.parent
    while up is not None and up.tag != "#root":
        if _matches(up, rest):
            return True
        if combinator == ">":
            return False
        up = up.parent
    return False


def select(root: Node, text: str) -> list[Node]:
    parts = selector(text)
    return [n for n in root.walk() if any(_matches(n, s) for s in parts)]


def split_attribute(spec: str) -> tuple[str, str | None]:
    """``css@attr`` into both; an @ inside brackets or quotes belongs to the selector."""
    m = re.match(r"""^((?:\[[^\]]*\]|"[^"]*"|'[^']*'|[^@\[\]"'])*)@([\w:-]+)$""", spec.strip())
    return (m[1].strip(), m[2]) if m and m[1].strip() else (spec.strip(), None)


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def scrape(root: Node, fields: dict[str, str], most: int | None = None) -> dict[str, object]:
    """Each field's values: none is null, one a string, more a list; a bad selector gives an error and the rest goes on."""
    out: dict[str, object] = {}
    for name, spec in fields.items():
        css, attr = split_attribute(spec)
        try:
            found = [n.attrs.get(attr) if attr else squeeze(n.text()) for n in select(root, css)]
        except ValueError as e:
            out[name] = {"error": str(e)}
            continue
        found = found[:most]
        out[name] = None if not found else found[0] if len(found) == 1 else found
    return out


def block_text(root: Node) -> str:
    """Visible text: white space runs are one space, blocks stand apart by an empty line."""
    parts: list[str] = []

    def go(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag not in HIDDEN:
                block = c.tag in BLOCK
                parts.append("\n\n" if block else " " if c.tag in ("td", "th") else "")
                go(c)
                parts.append("\n\n" if block else "")

    go(root)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r" {2,}", " ", "".join(parts)))).strip()


def formatted_text(root: Node) -> str:
    """Plain text with headings in capitals, bullets, and alternative texts of images."""
    lines: list[str] = []

    def go(n: Node, buffer: list[str]) -> None:
        for c in n.children:
            if isinstance(c, str):
                buffer.append(c)
            elif c.tag in HIDDEN:
                continue
            elif c.tag == "img":
                if c.attrs.get("alt"):
                    buffer.append(f"[Image: {c.attrs['alt']}]")
            elif c.tag in BLOCK:
                flush(buffer)
                own: list[str] = []
                go(c, own)
                s = squeeze("".join(own))
                if s:
                    lines.append(s.upper() if re.fullmatch("h[1-6]", c.tag) else f"• {s}" if c.tag == "li" else s)
            else:
                go(c, buffer)

    def flush(buffer: list[str]) -> None:
        s = squeeze("".join(buffer))
        buffer.clear()
        if s:
            lines.append(s)

    top: list[str] = []
    go(root, top)
    flush(top)
    return "\n".join(lines)


CHROME = {"nav", "header", "footer", "aside", "form"}


def main_content(root: Node) -> tuple[Node, str, float]:
    """The node that holds the article, how it was found, and with what confidence: article or main, densest block, body."""
    for css in ("article", "main", "[role=main]", ".content", "#content", ".post", ".entry-content"):
        found = [n for n in select(root, css) if len(squeeze(n.text())) >= 50]
        if found:
            return max(found, key=lambda n: len(n.text())), "landmark", 0.9
    best, score = None, 0.0
    for n in root.walk():
        if n.tag in ("div", "section", "td"):
            text = sum(len(squeeze(c.text())) for c in n.children if isinstance(c, Node) and c.tag == "p")
            links = sum(len(a.text()) for a in n.walk() if a.tag == "a")
            if text - links > score:
                best, score = n, text - links
    if best is not None and score >= 100:
        return best, "density", 0.5
    body = next((n for n in root.walk() if n.tag == "body"), root)
    return body, "body", 0.2


def markdown(root: Node) -> str:
    """Headings, paragraphs, lists, links, emphasis, code, quotes and tables as Markdown."""

    def inline(n: Node) -> str:
        out = []
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif c.tag in HIDDEN:
                continue
            elif c.tag == "br":
                out.append("\n")
            elif c.tag in ("b", "strong"):
                out.append(f"**{inline(c).strip()}**")
            elif c.tag in ("i", "em"):
                out.append(f"*{inline(c).strip()}*")
            elif c.tag == "code":
                out.append(f"`{c.text()}`")
            elif c.tag == "a":
                out.append(f"[{inline(c).strip()}]({c.attrs['href']})" if c.attrs.get("href") else inline(c))
            elif c.tag == "img":
                out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            else:
                out.append(inline(c))
        return "".join(out)

    blocks: list[str] = []

    def items(n: Node, depth: int) -> list[str]:
        out, i = [], 0
        for c in n.children:
            if isinstance(c, Node) and c.tag == "li":
                i += 1
                flat = Node("span", children=[x for x in c.children if isinstance(x, str) or x.tag not in ("ul", "ol")])
                out.append("  " * depth + (f"{i}. " if n.tag == "ol" else "- ") + inline(flat).strip())
                for x in c.children:
                    if isinstance(x, Node) and x.tag in ("ul", "ol"):
                        out += items(x, depth + 1)
        return out

    def go(n: Node) -> None:
        loose: list[Node | str] = []

        def flush() -> None:
            s = inline(Node("span", children=list(loose))).strip()
            loose.clear()
            if s:
                blocks.append(s)

        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCK:
                if not (isinstance(c, Node) and c.tag in HIDDEN):
                    loose.append(c)
                continue
            flush()
            if re.fullmatch("h[1-6]", c.tag):
                blocks.append("#" * int(c.tag[1]) + " " + inline(c).strip())
            elif c.tag in ("ul", "ol"):
                blocks.append("\n".join(items(c, 0)))
            elif c.tag == "pre":
                blocks.append("```\n" + c.text().strip("\n") + "\n```")
            elif c.tag == "blockquote":
                blocks.append("\n".join(f"> {x}" for x in markdown(c).split("\n")))
            elif c.tag == "hr":
                blocks.append("---")
            elif c.tag == "table":
                rows = [[inline(x).strip() for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in c.walk() if r.tag == "tr"]
                rows = [r for r in rows if r]
                if rows:
                    blocks.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
            else:
                go(c)
        flush()

    go(root)
    return "\n\n".join(b for b in blocks if b.strip())


def microdata(root: Node) -> list[dict]:
    """Top items as {type, properties}; the value of a property is by tag: content, address, datetime, item, text."""

    def value(n: Node):
        if "itemscope" in n.attrs:
            return item(n)
        for tags, attr in ((("meta",), "content"), (("a", "link", "area"), "href"), (("img", "audio", "video", "source", "iframe", "embed"), "src"), (("time",), "datetime"), (("data", "meter"), "value"), (("object",), "data")):
            if n.tag in tags and attr in n.attrs:
                return n.attrs[attr]
        return squeeze(n.text())

    def item(n: Node) -> dict:
        props: dict[str, list] = {}

        def go(x: Node) -> None:
            for c in x.children:
                if isinstance(c, Node):
                    for name in c.attrs.get("itemprop", "").split():
                        props.setdefault(name, []).append(value(c))
                    if "itemscope" not in c.attrs:
                        go(c)

        go(n)
        return {"type": n.attrs.get("itemtype", ""), "properties": props}

    return [item(n) for n in root.walk() if "itemscope" in n.attrs and "itemprop" not in n.attrs]


def rdfa(root: Node) -> list[dict]:
    return [{"type": n.attrs.get("typeof", ""), "vocab": n.attrs.get("vocab", ""), "properties": {p.attrs["property"]: p.attrs.get("content") or squeeze(p.text()) for p in n.walk() if "property" in p.attrs}} for n in root.walk() if "typeof" in n.attrs]


def json_ld(root: Node) -> list:
    out = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                out.append(json.loads("".join(c for c in n.children if isinstance(c, str))))
            except ValueError:
                continue
    return out


# fixed values: kinds of schema.org items in the order in which a type is tried, and their fields
SCHEMA_KINDS = ["article", "organization", "person", "product", "event", "place", "website"]
SCHEMA_FIELDS = {
    "article": ["headline", "author", "datePublished", "dateModified", "description", "image", "publisher", "wordCount", "articleSection"],
    "organization": ["name", "url", "logo", "description", "address", "telephone", "email", "foundingDate"],
    "person": ["name", "givenName", "familyName", "jobTitle", "worksFor", "url", "image", "description"],
    "product": ["name", "description", "image", "brand", "price", "currency", "availability", "sku", "gtin"],
    "event": ["name", "description", "startDate", "endDate", "location", "organizer", "price", "url"],
    "place": ["name", "address", "telephone", "url", "description", "geo", "openingHours"],
    "website": ["name", "url", "description", "publisher", "inLanguage", "potentialAction"],
}
NAMED_FIELDS = {"author", "publisher", "worksFor", "brand", "location", "organizer"}
OFFER_FIELDS = {"price": "price", "currency": "priceCurrency", "availability": "availability"}
OTHER_NAMES = {"headline": ["name"], "gtin": ["gtin13", "gtin12", "gtin8"]}


def schema_kind(item: dict) -> str | None:
    """Kind of a schema.org item by what its type holds; a blog posting is an article."""
    kind = item.get("@type") or ""
    kind = " ".join(map(str, kind)).lower() if isinstance(kind, list) else str(kind).lower()
    return "article" if "blogposting" in kind else next((k for k in SCHEMA_KINDS if k in kind), None)


def schema_field(item: dict, kind: str, name: str):
    """A field's value: the name of what it refers to, that of the offer, or that under another name; null if there is none."""
    if name in OFFER_FIELDS and kind in ("product", "event"):
        offers = item.get("offers") or {}
        offers = offers[0] if isinstance(offers, list) and offers else offers
        return offers.get(OFFER_FIELDS[name]) if isinstance(offers, dict) else None
    value = next((v for n in (name, *OTHER_NAMES.get(name, [])) if (v := item.get(n))), None)
    return value.get("name") if name in NAMED_FIELDS and isinstance(value, dict) else value


def schema_items(root: Node) -> dict[str, dict | None]:
    """The last item of each kind among a page's JSON-LD, by its fields; null where there is none."""
    out: dict[str, dict | None] = dict.fromkeys(SCHEMA_KINDS)
    for block in json_ld(root):
        for item in block if isinstance(block, list) else block.get("@graph", [block]) if isinstance(block, dict) else []:
            if isinstance(item, dict) and (kind := schema_kind(item)):
                out[kind] = {f: schema_field(item, kind, f) for f in SCHEMA_FIELDS[kind]}
    return out


# fixed values: what a cleaned page loses, the attributes that it keeps, the elements that are no text but stay
DROPPED = "script, noscript, style, link[rel=stylesheet], nav, header, footer, aside, .advertisement, .ads, .social-share, .popup, .modal"
KEPT_ATTRIBUTES = ["href", "src", "alt", "title", "class", "id"]
EMBEDDED = {"img", "video", "audio", "iframe"}


def clean(root: Node) -> str:
    """HTML without scripts, styles, comments, page furniture, other attributes and elements that hold nothing."""
    gone = {id(n) for n in select(root, DROPPED)}

    def holds(n: Node) -> bool:
        return n.tag in EMBEDDED or any(c.strip() if isinstance(c, str) else id(c) not in gone and holds(c) for c in n.children)

    def write(n: Node) -> str:
        inner = "".join(escape(c, quote=False) if isinstance(c, str) else write(c) if id(c) not in gone and holds(c) else "" for c in n.children)
        if n.tag == "#root":
            return inner
        attributes = "".join(f' {k}="{escape(n.attrs[k] or "")}"' for k in n.attrs if k in KEPT_ATTRIBUTES)
        return f"<{n.tag}{attributes}>" if n.tag in VOID else f"<{n.tag}{attributes}>{inner}</{n.tag}>"

    return write(root)


#: Where a field is looked for when no hint is given.
SEMANTIC = {
    "title": "h1, title, [itemprop=name]", "description": "meta[name=description]@content", "price": "[itemprop=price], .price, [data-price]", "author": "[rel=author], .author, [itemprop=author]", "date": "time, .date, [itemprop=datePublished]",
    "image": "meta[property='og:image']@content", "rating": "[itemprop=ratingValue], .rating", "email": "a[href^='mailto:']", "phone": "a[href^='tel:']", "address": "address, .address, [itemprop=address]",
}


def coerce(value, kind: str):
    """A string as number, boolean or list; null where it does not fit."""
    if value is None or kind == "string":
        return value
    if kind in ("number", "integer"):
        m = re.sub(r"[^0-9.-]", "", str(value))
        try:
            return int(float(m)) if kind == "integer" else float(m)
        except ValueError:
            return None
    if kind == "boolean":
        return bool(re.search(r"^(true|yes|1|on|available|in stock)$", str(value).strip(), re.I))
    if kind == "array":
        return value if isinstance(value, list) else [x.strip() for x in re.split(r"[,;|]", str(value)) if x.strip()]
    return value


def structured(root: Node, schema: dict, hints: dict[str, str] | None = None) -> dict:
    """Fields of a JSON-Schema subset by hint, itemprop, data attribute, class or id, or the table; with errors and confidence."""
    data, errors = {}, []
    for name, spec in schema.get("properties", {}).items():
        tries = [hints[name]] if hints and name in hints else []
        tries += [f"meta[name='{name}']@content", f"meta[property='og:{name}']@content", f"[itemprop='{name}']", f"[data-{name.replace('_', '-')}]@data-{name.replace('_', '-')}", f".{name.replace('_', '-')}", f"#{name.replace('_', '-')}"]
        tries += [SEMANTIC[name]] if name in SEMANTIC else []
        found = None
        for t in tries:
            got = scrape(root, {"x": t})["x"]
            if got not in (None, "") and not isinstance(got, dict):
                found = got
                break
        kind = spec.get("type", "string")
        data[name] = coerce(found if kind == "array" or not isinstance(found, list) else found[0], kind)
        if name in schema.get("required", []) and data[name] in (None, ""):
            errors.append(f"missing required field: {name}")
    found = sum(v not in (None, "") for v in data.values())
    base = 0.6 if data and found == len(data) else 0.4
    return {"data": data, "errors": errors, "confidence": max(0.0, base - min(0.3, 0.1 * len(errors)))}


def balanced_json(text: str):
    """The first balanced JSON object or array of a text, fences ignored; None if there is none."""
    text = re.sub(r"```(?:json)?", "", text or "")
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
    return None
