"""HTML topics and navigation as Python table functions over the standard library's parser.

The tree walk is the one step that expressions cannot make; everything after it is columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

#: Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PREFIXES = (({"warning", "note_warning"}, "[警告] "), ({"caution", "note_caution"}, "[注意] "))
ROOT_LABEL = "用户手册"
#: An opening tag of the first kind closes an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES |= {name: {"p"} for name in ("div", "ul", "ol", "table", "section", "article", "figure", "nav", "main", "aside", "header", "footer", *HEADINGS)}
SCOPES = {"ul", "ol", "table", "div", "section", "article", "td", "th", "li", "figure"}

SECTIONS = "array<struct<title: string, level: int, path: array<string>, blocks: array<string>, images: array<struct<url: string, alt: string, section_path: array<string>>>>>"
TOPIC = "topic_id string, title string, breadcrumbs array<string>, source_url string, source_file string"


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def tags(self, *names: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and (not names or c.name in names)]

    def walk(self) -> Iterator[Node]:
        """All tags below, in document order."""
        stack = self.tags()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.tags()[::-1])

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.name not in ("script", "style"):
                stack.extend(x.children[::-1])
        return squeezed(" ".join(out))


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closing = CLOSES.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in closing:
                del self.open[i:]
                break
            if self.open[i].name in SCOPES:
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _table(node: Node) -> list[str]:
    rows = [" | ".join(c.text() for c in row.walk() if c.name in ("th", "td")) for row in node.walk() if row.name == "tr" and any(c.name in ("th", "td") for c in row.walk())]
    return ["\n".join(rows)] if rows else [t] if (t := node.text()) else []


def blocks_of(node: Node, url: str, path: list[str], images: list[dict]) -> list[str]:
    """A tag as text blocks; figures add to images instead."""
    if node.name in ("ul", "ol"):
        told = [(i, li.text()) for i, li in enumerate(node.tags("li"), 1)]
        return [f"{i}. {t}" if node.name == "ol" else f"- {t}" for i, t in told if t]
    if node.name == "table":
        return _table(node)
    if node.name == "figure":
        image = next((n for n in node.walk() if n.name == "img"), None)
        if image is not None and image.attrs.get("src"):
            images.append({"url": urljoin(url, image.attrs["src"]), "alt": squeezed(image.attrs.get("alt")), "section_path": path})
        return []
    if node.name in ("div", "section"):
        out = [b for child in node.tags() for b in blocks_of(child, url, path, images)]
        prefix = next((p for names, p in PREFIXES if any(node.has_class(n) for n in names)), "")
        return [prefix + out[0], *out[1:]] if prefix and out else out
    return [t] if (t := node.text()) else []


def sections_of(html: str, title: str, url: str, strict: bool = True) -> list[dict] | None:
    """Sections of a topic page, or None. Not strict: any article, and its own tags as the body."""
    root = tree(html)
    wanted = lambda n: n.name == "article" and (not strict or n.attrs.get("role") == "article")
    inside = [a for m in root.walk() if m.name == "main" for a in m.walk() if wanted(a)]
    article = next(iter(inside), None) or next((n for n in root.walk() if wanted(n)), None)
    if article is None:
        return None
    out: list[dict] = []
    stack: list[tuple[Node, list[str], int]] = [(article, [], 1)]
    while stack:
        node, parents, level = stack.pop()
        heading = next(iter(node.tags(*HEADINGS)), None)
        name = heading.text() if heading is not None else ""
        level = int(heading.name[1]) if heading is not None else level
        path = [*parents, name] if name else parents
        body = next((d for d in node.tags("div") if d.has_class("body")), None)
        parts = body.tags() if body is not None else [] if strict else [c for c in node.tags() if c.name not in HEADINGS and not (c.name == "article" and c.has_class("topic"))]
        images: list[dict] = []
        blocks = [b for child in parts for b in blocks_of(child, url, path, images)]
        if blocks or images:
            out.append({"title": name or title, "level": level, "path": path or [title], "blocks": blocks, "images": images})
        stack.extend((n, path, level + 1) for n in node.tags("article")[::-1] if n.has_class("topic"))
    return out or None


def parse_topics(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Documents of topic pages; pages without sections give no row.

    pages: html (string or binary), topic_id, title, breadcrumbs, source_url, source_file,
    manual_id, snapshot_id, vehicle_model.
    """
    kept = ["topic_id", "title", "source_url", "manual_id", "snapshot_id", "vehicle_model"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            html = [h if isinstance(h, str) else (h or b"").decode("utf-8", "replace") for h in frame["html"]]
            found = [sections_of(h, t, u, strict) if h else None for h, t, u in zip(html, frame["title"], frame["source_url"], strict=True)]
            raw = [h.encode() if isinstance(h, str) else h or b"" for h in frame["html"]]
            yield frame.drop(columns="html").assign(sections=found, content_hash=[hashlib.sha256(r).hexdigest() for r in raw])[[f is not None for f in found]]

    rows = pages.select(*kept, "breadcrumbs", "source_file", "html")
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in [*kept, "breadcrumbs", "source_file"]) + f", sections {SECTIONS}, content_hash string"
    out = rows.mapInPandas(run, schema)
    return out.withColumn("document_id", ids.document_id(F.col("manual_id"), F.col("snapshot_id"), F.col("topic_id"))).withColumn("breadcrumb", F.col("breadcrumbs")).withColumn("metadata", F.create_map(F.lit("source_file"), F.col("source_file"))).withColumn("manual_version", F.lit(None).cast("string")).drop("breadcrumbs", "source_file")


def navigation(html: str, url: str) -> tuple[str, str, list[dict], int]:
    """Manual id, vehicle model, unique topics in order (first of a url), and the number of references."""
    root = tree(html)
    nodes = list(root.walk())
    menu = next((n for n in nodes if n.attrs.get("id") == "menu"), None)
    page_title = next((n.text() for n in nodes if n.name == "title"), "")
    model = squeezed(menu.attrs.get("data-title") if menu else "") or page_title
    manual = squeezed(menu.attrs.get("data-number") if menu else "") or (urlparse(url).path.split("/")[-2:-1] or [""])[0]
    lists = [n for n in nodes if n.name == "ul"]
    top = next((n for n in lists if n.attrs.get("id") == "manual-nav"), None) or next((n for n in lists if n.has_class("map") and n.has_class("bookmap")), None)
    if top is None:
        raise ValueError("no navigation list")

    def label_of(item: Node) -> tuple[Node | None, str]:
        direct = next(iter(item.tags("a", "div")), None)
        if direct is None:
            return None, ""
        named = next((n for n in direct.walk() if n.has_class("nav-text")), direct)
        return direct, named.text()

    items = top.tags("li")
    if len(items) == 1 and label_of(items[0])[0] is not None and label_of(items[0])[0].text() == ROOT_LABEL and items[0].tags("ul"):
        items = items[0].tags("ul")[0].tags("li")
    found: dict[str, dict] = {}
    refs = 0
    stack = [(i, []) for i in items[::-1]]
    while stack:
        item, above = stack.pop()
        direct, label = label_of(item)
        if direct is None:
            continue
        crumbs = [*above, label] if label else above
        href = squeezed(direct.attrs.get("data-content")) or squeezed(direct.attrs.get("href")) if direct.name == "a" else ""
        if href and href != "#":
            refs += 1
            target = urljoin(url, href)
            file = urlparse(target).path.split("/")[-1]
            topic = re.sub(r"\.[^.]*$", "", file)
            found.setdefault(target, {"topic_id": topic, "title": label or topic, "breadcrumbs": crumbs, "source_url": target, "source_file": file})
        below = next((u for u in item.tags("ul") if u.has_class("sub-menu")), None) or next(iter(item.tags("ul")), None)
        if below is not None:
            stack.extend((i, crumbs) for i in below.tags("li")[::-1])
    return manual, model, list(found.values()), refs


def parse_navigation(indexes: DataFrame) -> DataFrame:
    """(index_url, error, manual_id, vehicle_model, refs, topic fields): indexes has html and url.

    An index that cannot be read is one row with its error and nothing else.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["index_url", "error", "manual_id", "vehicle_model", "refs", "place", "topic_id", "title", "breadcrumbs", "source_url", "source_file"]
        none = dict.fromkeys(columns)
        for frame in frames:
            rows = []
            for html, url in zip(frame["html"], frame["url"], strict=True):
                try:
                    if html is None:
                        raise ValueError("no index page")
                    manual, model, topics, refs = navigation(html, url)
                except ValueError as error:
                    rows.append(none | {"index_url": url, "error": str(error)})
                    continue
                rows += [none | {"index_url": url, "manual_id": manual, "vehicle_model": model, "refs": refs, "place": i, **t} for i, t in enumerate(topics)]
            told = pd.DataFrame(rows, columns=columns, dtype=object)
            yield told.astype({"refs": "Int32", "place": "Int32"})

    return indexes.select("html", "url").mapInPandas(run, f"index_url string, error string, manual_id string, vehicle_model string, refs int, place int, {TOPIC}")
