"""Pages to ordered sections and structured data, with the standard library's tokenizer and an own tree."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgrid.operators.pages import MAX_CONTENT, MAX_HTML, MAX_SECTION, MIN_PAGE_TEXT
from factgrid.plans.ship import ship_package

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no readable text.
JUNK = frozenset("style nav footer header aside form iframe noscript svg button input select textarea script".split())
#: Elements that are one record or block each, and those that open a section.
RECORDS = frozenset("li dd tr p dt blockquote figcaption address h4 h5 h6".split())
HEADERS = frozenset("h1 h2 h3".split())
#: Schema.org keys and the words that pages use for them, in order.
JSONLD_KEYS = {
    "name": "name", "servesCuisine": "cuisine", "priceRange": "price_range", "telephone": "phone", "url": "url", "description": "description",
    "foundingDate": "founded", "applicationCategory": "category", "operatingSystem": "platform", "programmingLanguage": "language",
    "license": "license", "datePublished": "published", "author": "author", "brand": "brand",
}
#: Keys that hold further records, and the parts of an address.
JSONLD_NESTED, ADDRESS_PARTS = ("@graph", "itemListElement", "item", "mainEntity"), ("streetAddress", "addressLocality", "addressRegion")
MAX_RECORDS, MAX_VALUE = 60, 200
SECTION_TYPE = "array<struct<sec_ord int, sec_id string, heading string, text string>>"


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """Elements below this one in document order, junk left out."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, Node) and child.tag not in JUNK:
                yield child
                stack.append(iter(child.children))

    def strings(self) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in JUNK:
                stack.append(iter(child.children))

    def text(self) -> str:
        return " ".join(s for s in (x.strip() for x in self.strings()) if s)


class Tree(HTMLParser):
    """An end tag closes the nearest open element of its name, or nothing; all else nests."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _all(root: Node) -> Iterator[Node]:
    """Every element in document order, junk too."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _shown(value: object) -> object:
    """What stands for a value: an object's name, a list's items joined, anything else itself."""
    if isinstance(value, dict):
        value = value.get("name") or value.get("@value")
    if isinstance(value, list):
        return ", ".join(str(v.get("name")) if isinstance(v, dict) else str(v) for v in value)
    return value


def _address(value: object) -> str | None:
    if isinstance(value, dict):
        return " ".join(str(value.get(k, "")) for k in ADDRESS_PARTS).strip() or None
    return value if isinstance(value, str) else None


def _own_record(thing: dict) -> str | None:
    """`label: value | ...` of an object with a name and anything besides."""
    if not thing.get("name"):
        return None
    pairs = [(label, str(shown)[:MAX_VALUE]) for key, label in JSONLD_KEYS.items() if (shown := _shown(thing.get(key)))]
    pairs += [("address", a)] if (a := _address(thing.get("address"))) is not None else []
    rating = thing.get("aggregateRating")
    pairs += [("rating", str(rating["ratingValue"]))] if isinstance(rating, dict) and rating.get("ratingValue") else []
    return " | ".join(f"{label}: {text}" for label, text in pairs) if len(pairs) > 1 else None


def jsonld_records(node: object) -> Iterator[str]:
    """Records of everything that has a name, nested ones before what holds them."""
    if isinstance(node, list):
        for item in node:
            yield from jsonld_records(item)
    elif isinstance(node, dict):
        for key in JSONLD_NESTED:
            yield from jsonld_records(node.get(key))
        if own := _own_record(node):
            yield own


def jsonld_text(root: Node) -> str:
    records: list[str] = []
    for node in _all(root):
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                records += jsonld_records(json.loads("".join(c for c in node.children if isinstance(c, str))))
            except (ValueError, TypeError, RecursionError):
                continue
    return "\n".join(records[:MAX_RECORDS])


def _element_text(node: Node) -> str:
    if node.tag == "tr":
        cells = [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")] or [c for c in node.walk() if c.tag in ("td", "th")]
        text = " | ".join(c.text() for c in cells)
    else:
        text = node.text()
    return re.sub(r"\s{2,}", " ", text).strip()


def parse_sections(html: str) -> list[tuple[str, str, str]]:
    """(sec_id, heading, text) of a page in order; structured data comes second."""
    root = Tree(html[:MAX_HTML]).root
    structured = jsonld_text(root)
    tops = list(root.walk())
    body = next((n for n in tops if n.tag == "main"), None) or next((n for n in tops if n.tag == "article"), None) or next((n for n in tops if n.attrs.get("id") == "content"), None) or root
    sections: list[tuple[str, str, list[str]]] = [("sec_0", "General Introduction", [])]
    current = sections[0]
    if structured:
        sections.append(("sec_jsonld", "STRUCTURED DATA (schema.org)", structured.split("\n")))
    opened = 0
    stack = [iter(body.children)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        if isinstance(node, str) or node.tag in JUNK:
            continue
        if node.tag in RECORDS:  # all that is inside belongs to it
            text = _element_text(node)
            if len(text) > 2:
                current[2].append(text)
            continue
        if node.tag in HEADERS:
            text = node.text()
            if len(text) > 3:
                opened += 1
                current = (f"sec_{opened}", f"{node.tag.upper()}: {text}", [])
                sections.append(current)
        stack.append(iter(node.children))
    out = [(i, h, "\n".join(lines)[:MAX_SECTION]) for i, h, lines in sections]
    return [s for s in out if len(s[2]) > 10]


def with_sections(pages: DataFrame, html_col: str = "html", snippet_col: str = "snippet") -> DataFrame:
    """pages with sections (in order) and content instead of the HTML, which is cut before it is parsed.

    Content of less than 200 characters gives way to the snippet, and its sections lose
    their headings but stay. Null HTML has no sections. Arrow-batched; other columns pass through.
    """
    ship_package(pages.sparkSession)
    schema = pages.drop(html_col).withColumn("sections", F.lit(None).cast(SECTION_TYPE)).withColumn("content", F.lit("")).schema
    cut = pages.withColumn(html_col, F.left(html_col, F.lit(MAX_HTML)))
    columns = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            sections, contents = [], []
            for html, snippet in zip(batch.column(html_col).to_pylist(), batch.column(snippet_col).to_pylist(), strict=True):
                found = parse_sections(html) if html else []
                content = "\n".join(s[2] for s in found)[:MAX_CONTENT]
                thin = len(content) < MIN_PAGE_TEXT
                sections.append([{"sec_ord": i, "sec_id": s[0], "heading": "" if thin else s[1], "text": s[2]} for i, s in enumerate(found)])
                contents.append((snippet or content) if thin else content)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in columns), pa.array(sections, arrow.field("sections").type), pa.array(contents, pa.string())], schema=arrow)

    return cut.mapInArrow(run, schema)

