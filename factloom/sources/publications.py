"""Publication pages marked up with itemprop attributes to columns, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_FAMILY = {"pubs", "docdbFamily", "countryStatus"}
_SIDES = {"left": "x0", "top": "y0", "right": "x1", "bottom": "y1"}
_CALLOUT = pa.struct([("id", pa.string()), ("label", pa.string()), *((c, pa.int32()) for c in _SIDES.values())])
_IMAGE = pa.struct([("full", pa.string()), ("callouts", pa.list_(_CALLOUT))])
_TEXTS = pa.list_(pa.string())
_SCHEMA = pa.schema([("id", pa.string()), ("title", pa.string()), ("claims", _TEXTS), ("paragraphs", _TEXTS), ("signs", pa.string()), ("description", pa.string()), ("figrefs", _TEXTS), ("images", pa.list_(_IMAGE)), ("family", _TEXTS), ("pdf", pa.string())])
_SQL = "id string, title string, claims array<string>, paragraphs array<string>, signs string, description string, figrefs array<string>, images array<struct<full:string,callouts:array<struct<id:string,label:string,x0:int,y0:int,x1:int,y1:int>>>>, family array<string>, pdf string"


def whole(value: str | None) -> int | None:
    """A bound cut to a whole number, or null if it is none that a 32-bit column holds."""
    try:
        n = int(float(value))
    except (TypeError, ValueError, OverflowError):
        return None
    return n if abs(n) < 1 << 31 else None


class _Image:
    """What one entry of the image list holds; the first value of a property counts."""

    def __init__(self):
        self.full, self.thumbnail, self.callouts = None, None, []

    def row(self) -> dict | None:
        full = self.full or self.thumbnail
        kept = []
        for c in self.callouts:
            code = normalize("NFKC", c.get("id", "")).strip().translate({0x27: None, 0x2019: None})
            box = {to: whole(c.get(side)) for side, to in _SIDES.items()}
            if code and None not in box.values():
                kept.append({"id": code, "label": c.get("label", ""), **box})
        return {"full": full, "callouts": kept} if full else None


class _Publication(HTMLParser):
    """Keeps the open elements as a stack; text goes to whatever capture is open on it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, list | None]] = []
        self.title, self.page_title = "", []
        self.claims, self.paragraphs, self.signs, self.images, self.family, self.pdf = [], [], [], [], [], ""
        self.description, self.figrefs = [], []

    def inside(self, test) -> bool:
        return any(test(tag, attrs) for tag, attrs, _ in self.stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes, prop = a.get("class", "").split(), a.get("itemprop", "")
        into = None
        if tag == "meta" and a.get("name") == "DC.title":
            self.title = " ".join(a.get("content", "").split())
        elif tag == "meta" and self.images and self.inside(lambda t, x: t == "li" and x.get("itemprop") == "images"):
            self.noted(prop, a.get("content", ""))
        elif tag == "img" and prop == "thumbnail" and self.images and self.inside(lambda t, x: t == "li" and x.get("itemprop") == "images"):
            self.images[-1].thumbnail = self.images[-1].thumbnail or a.get("src")
        elif tag == "li" and prop == "images":
            self.images.append(_Image())
        elif tag == "li" and prop == "callouts" and self.images and self.inside(lambda t, x: x.get("itemprop") == "images"):
            self.images[-1].callouts.append({})
        elif tag == "section" and prop == "description":
            into = self.description
        elif tag == "figref" and self.inside(lambda t, x: x.get("itemprop") == "description"):
            self.figrefs.append(into := [])
        elif tag == "title":
            into = self.page_title
        elif tag == "div" and "claim" in classes:
            if self.inside(lambda t, x: x.get("itemprop") == "claims") and not self.inside(lambda t, x: "claim" in x.get("class", "").split()):
                self.claims.append(into := [])
        elif tag == "div" and "description-paragraph" in classes:
            self.paragraphs.append(into := [])
        elif tag == "reference-signs-list":
            into = self.signs
        elif tag == "span" and prop == "publicationNumber" and self.inside(lambda t, x: x.get("itemprop") in _FAMILY):
            self.family.append(into := [])
        elif tag == "a" and prop == "pdfLink":
            self.pdf = self.pdf or a.get("href", "")
        if tag == "br":
            self.handle_data("\n")
        if tag not in _VOID:
            self.stack.append((tag, a, into))

    def noted(self, prop: str, value: str) -> None:
        """A property of the image or the callout that is open; sides count within bounds only."""
        image = self.images[-1]
        if self.inside(lambda t, x: t == "li" and x.get("itemprop") == "callouts"):
            bounds = self.inside(lambda t, x: x.get("itemprop") == "bounds")
            if prop in ("id", "label") or (prop in _SIDES and bounds):
                image.callouts[-1].setdefault(prop, value)
        elif prop == "full":
            image.full = image.full or value

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:  # an end tag closes what was left open inside
            del self.stack[at:]

    def handle_data(self, data):
        for _, _, into in self.stack:
            if into is not None:
                into.append(data)

    def figure_texts(self) -> list[str]:
        """References that name a figure, without white space."""
        texts = ["".join("".join(f).split()) for f in self.figrefs]
        return [t for t in texts if (n := normalize("NFKC", t)).startswith("図", n[:1] in ("【", "["))]

    def row(self, own: str) -> dict:
        joined = lambda parts: "".join(parts)
        parts = joined(self.page_title).split(" - ")
        family = dict.fromkeys(x for f in self.family if (x := joined(f).strip()) and x != own)
        return {"title": self.title or (" ".join(parts[1].split()) if len(parts) > 1 else ""), "claims": [t for c in self.claims if (t := "".join(joined(c).split()))], "paragraphs": [joined(p) for p in self.paragraphs], "signs": joined(self.signs), "description": "\n".join(self.description), "figrefs": self.figure_texts(), "images": [r for i in self.images if (r := i.row())], "family": list(family), "pdf": self.pdf}


def _parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for own, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = _Publication()
            page.feed(html or "")
            page.close()
            rows.append({"id": own, **page.row(own or "")})
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def parse(pages: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """id, title, claims, paragraphs, signs (the reference list's text), description (all its text), figrefs, images with their
    callouts, family and pdf of each page. A callout without a code or with a bound that is no number is left out, an image
    without an address too; its thumbnail's address stands in for a missing one."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_parsing, _SQL)
