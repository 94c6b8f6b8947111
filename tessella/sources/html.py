"""Pages parsed in Arrow batches where patterns do not do."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ..batches import slices


class Page(HTMLParser):
    """Title, description, links with their texts, meta tags, structured data and text; text of scripts and styles counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.links, self.parts, self.inside, self.data = "", "", [], [], "", False
        self.meta: dict[str, str] = {}
        self.anchors: list[tuple[str, str]] = []
        self.structured: list[str] = []
        self.href, self.said = "", []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.inside = tag
        self.data = tag == "script" and (a.get("type") or "").lower() == "application/ld+json"
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag == "a":
            self.href, self.said = a.get("href") or "", []
        if tag == "meta" and (name := (a.get("name") or a.get("property") or "").lower()) and a.get("content"):
            self.meta[name] = a["content"]
        if self.data:
            self.structured.append("")
        if tag == "meta" and (a.get("name") or "").lower() == "description":
            self.description = a.get("content") or ""

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.anchors.append((self.href, " ".join(" ".join(self.said).split())))
            self.href, self.said = "", []
        self.inside, self.data = "", False

    def handle_data(self, data):
        if self.href:
            self.said.append(data)
        if self.data:
            self.structured[-1] += data
        if self.inside == "title":
            self.title += data
        elif not self.data:
            self.parts.append(data)


def parsed(pages: DataFrame, key: str, html: str) -> DataFrame:
    """title, description, links (all hrefs), visible text, anchors (href and text of every closed link), meta (by name or
    property, the last of equals) and json_ld (texts of structured data) of each page; a null page is an empty one."""
    kind = pages.schema[key].dataType.simpleString()
    anchor = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            rows = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = Page()
                p.feed(h or "")
                rows.append((k, " ".join(p.title.split()), p.description, p.links, " ".join(" ".join(p.parts).split()), [{"href": u, "text": t} for u, t in p.anchors], list(p.meta.items()), p.structured))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.string()), pa.array(cols[5], anchor), pa.array(cols[6], pa.map_(pa.string(), pa.string())), pa.array(cols[7], pa.list_(pa.string()))], names=[key, "title", "description", "links", "visible", "anchors", "meta", "json_ld"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, title string, description string, links array<string>, visible string, anchors array<struct<href: string, text: string>>, meta map<string, string>, json_ld array<string>")
