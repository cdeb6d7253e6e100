"""HTML pages to columns with the standard library's parser, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIPPED = {"script", "style", "noscript", "template"}
_BLOCKS = {"p", "li", "div", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "tr", "table", "ul", "ol", "body", "br"}


#: A title without references and markup.
_PLAIN = "(?i)<title>([^<&]*)</title>"


class _Page(HTMLParser):
    """Collects the title, link targets and blocks of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.blocks = [], [], [[]]
        self.in_title, self.skipped = False, 0

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in _SKIPPED:
            self.skipped += 1
        elif tag in _BLOCKS:
            self.blocks.append([])
        self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag in _BLOCKS:
            self.blocks.append([])

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self.blocks[-1].append(data)

    def row(self) -> tuple[str, list[str], list[str]]:
        one = lambda parts: " ".join("".join(parts).split())
        return one(self.title), self.links, [t for b in self.blocks if (t := one(b))]


def _parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for html in batch.column(1).to_pylist():
            page = _Page()
            page.feed(html or "")
            page.close()
            rows.append(page.row())
        title, links, blocks = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(title, pa.string()), pa.array(links, pa.list_(pa.string())), pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "title", "links", "paragraphs"])


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, links, paragraphs of each page. Null pages are empty; broken markup never fails."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_parsing, "page_id long, title string, links array<string>, paragraphs array<string>")


def titles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and title of each page, as `parse` gives it. A page whose only title holds neither a reference nor markup is read by a
    built-in expression; the parser gets the others."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), html.alias("html"))
    found, before = F.regexp_extract("html", _PLAIN, 1), F.substring_index(F.lower("html"), "<title>", 1)
    # The only one, and not within anything in which it would be no title.
    once = (F.regexp_count("html", F.lit("(?i)<title")) == 1) & F.col("html").rlike(_PLAIN) & ~before.rlike("<(?:script|style|noscript|template|textarea|!--)")
    plain = rows.where(once).select("page_id", F.array_join(F.filter(F.split(found, r"(?U)\s+"), lambda x: x != ""), " ").alias("title"))
    return plain.unionByName(parse(rows.where(~once)).select("page_id", "title"))
