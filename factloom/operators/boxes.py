"""Box algebra: overlaps, containment, nearness, rotation and reconciliation of labelled boxes.

Range joins are equi-joins on the page and the cells of a coarse grid, then the
exact condition; a pair counts once, in the first cell that both boxes touch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factloom.functions.text import CONFUSED, MEANT

BOX = ["x0", "y0", "x1", "y1"]


def celled(boxes: DataFrame, size: int, slack: int = 0) -> DataFrame:
    """A row for each grid cell that the box, widened by the slack, touches."""
    cells = lambda lo, hi: F.sequence(F.floor((F.col(lo) - slack) / size), F.floor((F.col(hi) + slack) / size))
    return boxes.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))


def _renamed(df: DataFrame, end: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in df.columns if c not in keys))


def overlapping(a: DataFrame, b: DataFrame, slack: int = 5, size: int = 64) -> DataFrame:
    """Pairs of boxes on one page that overlap, or lie at most the slack apart."""
    keys = ["page", "cx", "cy"]
    left, right = _renamed(celled(a, size, slack).withColumns({"gx": F.col("cx"), "gy": F.col("cy")}), "a", keys), _renamed(celled(b, size), "b", keys)
    near = (F.col("x1_a") >= F.col("x0_b") - slack) & (F.col("x1_b") >= F.col("x0_a") - slack) & (F.col("y1_a") >= F.col("y0_b") - slack) & (F.col("y1_b") >= F.col("y0_a") - slack)
    once = (F.col("cx") == F.greatest(F.floor((F.col("x0_a") - slack) / size), F.floor(F.col("x0_b") / size))) & (F.col("cy") == F.greatest(F.floor((F.col("y0_a") - slack) / size), F.floor(F.col("y0_b") / size)))
    return left.join(right, keys).where(near & once).drop("cx", "cy", "gx_a", "gy_a")


def contained(boxes: DataFrame, slack: int = 3, size: int = 64) -> DataFrame:
    """Boxes (page, box_id, label, box) inside a box of a longer label on their page."""
    pairs = overlapping(boxes, boxes, slack, size)
    inside = (F.col("x0_a") >= F.col("x0_b") - slack) & (F.col("x1_a") <= F.col("x1_b") + slack) & (F.col("y0_a") >= F.col("y0_b") - slack) & (F.col("y1_a") <= F.col("y1_b") + slack)
    return pairs.where((F.length("label_b") > F.length("label_a")) & inside).select("page", F.col("box_id_a").alias("box_id")).distinct()


def corner_pairs(boxes: DataFrame, reach: int = 30) -> DataFrame:
    """Pairs of equal labels on a page whose upper left corners lie less than `reach` apart both ways, lower id first. Boxes alone with
    their label on a page, as most are, do not go on to the grid."""
    several = F.count("*").over(Window.partitionBy("page", "label")) > 1
    at = boxes.withColumn("several", several).where("several").select("page", "label", "box_id", "x0", "y0", F.floor(F.col("x0") / reach).alias("cx"), F.floor(F.col("y0") / reach).alias("cy"))
    # Half of the neighbouring cells: each pair meets once, from one side or the other.
    steps = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)))))
    around = at.withColumn("step", steps).withColumns({"cx": F.col("cx") + F.col("step.x"), "cy": F.col("cy") + F.col("step.y")})
    keys = ["page", "label", "cx", "cy"]
    pairs = _renamed(around, "a", keys).join(_renamed(at, "b", keys), keys)
    once = ((F.col("step_a.x") != 0) | (F.col("step_a.y") != 0) | (F.col("box_id_a") < F.col("box_id_b"))) & (F.col("box_id_a") != F.col("box_id_b"))
    close = (F.abs(F.col("x0_a") - F.col("x0_b")) < reach) & (F.abs(F.col("y0_a") - F.col("y0_b")) < reach)
    return pairs.where(once & close).select("page", "label", F.least("box_id_a", "box_id_b").alias("a"), F.greatest("box_id_a", "box_id_b").alias("b"))


def rotated(boxes: DataFrame, angle: int, width: Column, height: Column) -> DataFrame:
    """Boxes read on a page turned by 90 or 270 degrees counter-clockwise, in the page's own coordinates."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    back = {90: (width - y1, x0, width - y0, x1), 270: (y0, height - x1, y1, height - x0)}[angle]
    return boxes.select(*(c for c in boxes.columns if c not in BOX), *(v.alias(c) for c, v in zip(BOX, back, strict=True)))


def area(end: str) -> Column:
    return (F.col(f"x1_{end}") - F.col(f"x0_{end}")) * (F.col(f"y1_{end}") - F.col(f"y0_{end}"))


def reconciled(callouts: DataFrame, tokens: DataFrame, slack: int = 5) -> DataFrame:
    """Callouts after tokens read at the same place correct them: the longest token that holds a callout's code replaces it, else
    the smallest box of the same code replaces its box; tokens that meet no callout are added."""
    pairs = overlapping(callouts, tokens, slack)
    longer = (F.length("label_b") > F.length("label_a")) & F.contains(F.col("label_b"), F.col("label_a"))
    same = (F.col("label_a") == F.col("label_b")) & (area("b") < area("a"))
    w = Window.partitionBy("page", "box_id_a").orderBy(F.desc(F.when(longer, F.length("label_b")).otherwise(0)), area("b"), "box_id_b")
    best = pairs.where(longer | same).withColumn("r", F.row_number().over(w)).where("r = 1")
    fixed = best.select("page", F.col("box_id_a").alias("box_id"), F.col("label_b").alias("new_label"), *(F.col(f"{c}_b").alias(f"new_{c}") for c in BOX))
    kept = callouts.join(fixed, ["page", "box_id"], "left").select("page", "box_id", *(F.coalesce(f"new_{c}", c).alias(c) for c in ["label", *BOX]), F.when(F.col("new_label").isNull(), "callout").otherwise("token").alias("origin"))
    met = pairs.select("page", F.col("box_id_b").alias("box_id")).distinct()
    added = tokens.join(met, ["page", "box_id"], "left_anti").select("page", "box_id", "label", *BOX, F.lit("token").alias("origin"))
    return kept.unionByName(added)


def nearest_segment(points: DataFrame, segments: DataFrame, reach: int = 45, band: int = 12, slack: int = 5, size: int = 64) -> DataFrame:
    """For each box the longest segment of those with an end nearly as close as the closest: within `band` of it, none over `reach`
    away, the other end outside the box. Either end may be the near one; ends meet boxes through the cells of a grid."""
    ends = [segments.select("page", "segment_id", *(F.col(c).alias(n) for c, n in zip(order, ("nx", "ny", "fx", "fy"), strict=True))) for order in (("sx0", "sy0", "sx1", "sy1"), ("sx1", "sy1", "sx0", "sy0"))]
    near = ends[0].unionByName(ends[1]).withColumns({"cx": F.floor(F.col("nx") / size), "cy": F.floor(F.col("ny") / size)})
    beyond = lambda lo, hi, at: F.greatest(F.col(lo) - F.col(at), F.lit(0), F.col(at) - F.col(hi))
    within = F.col("fx").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("fy").between(F.col("y0") - slack, F.col("y1") + slack)
    dx, dy = beyond("x0", "x1", "nx").cast("double"), beyond("y0", "y1", "ny").cast("double")
    pairs = celled(points, size, reach).join(near, ["page", "cx", "cy"]).where(~within).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= reach)
    close = Window.partitionBy("page", "box_id")
    pairs = pairs.withColumn("least", F.min("distance").over(close)).where(F.col("distance") <= F.col("least") + band)
    w = close.orderBy(((F.col("fx") - F.col("nx")) ** 2 + (F.col("fy") - F.col("ny")) ** 2).desc(), "segment_id")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("page", "box_id", "segment_id")


def split_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with bracketed parts, as one row for each part; widths are shared by characters."""
    n = F.greatest(F.lit(1), F.length("label"))
    at = lambda i: F.substring(F.col("label"), i, F.lit(1))
    bracket = lambda i: at(i).isin("(", ")")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: ~bracket(i) & ((i == 1) | bracket(i - 1)))
    parts = F.filter(F.split("label", r"[()]+"), lambda p: p != "")
    whole = F.array(F.struct(F.lit(1).alias("start"), F.col("label").alias("part")))
    rows = tokens.select("*", n.alias("n"), F.size(parts).alias("parts"), F.explode(F.when(F.size(parts) > 0, F.arrays_zip(starts.alias("start"), parts.alias("part"))).otherwise(whole)).alias("p"))
    wide, one, start = (F.col("x1") - F.col("x0")) / F.col("n"), F.col("parts") <= 1, F.col("p.start") - 1
    x0 = F.when(one, F.col("x0")).otherwise((F.col("x0") + wide * start).cast("int"))
    x1 = F.when(one, F.col("x1")).otherwise((F.col("x0") + wide * (start + F.length("p.part"))).cast("int"))
    return rows.select(*(c for c in tokens.columns if c not in ("label", "x0", "x1")), F.col("p.part").alias("label"), x0.alias("x0"), x1.alias("x1"))


def away_from(new: DataFrame, old: DataFrame, reach: int = 25) -> DataFrame:
    """Boxes whose centre lies less than `reach` from that of no old box on their page, by either axis."""
    middle = lambda df, lo, hi: (df[lo] + df[hi]) / 2
    at = lambda df, *more: df.select(*more, "page", middle(df, "x0", "x1").alias("mx"), middle(df, "y0", "y1").alias("my"))
    cell = lambda c: F.floor(F.col(c) / reach)
    around = at(old).withColumn("cx", F.explode(F.sequence(cell("mx") - 1, cell("mx") + 1))).withColumn("cy", F.explode(F.sequence(cell("my") - 1, cell("my") + 1)))
    here = at(new, "box_id").withColumns({"cx": cell("mx"), "cy": cell("my")})
    keys = ["page", "cx", "cy"]
    pairs = _renamed(here, "a", keys).join(_renamed(around, "b", keys), keys)
    close = pairs.where((F.abs(F.col("mx_a") - F.col("mx_b")) < reach) & (F.abs(F.col("my_a") - F.col("my_b")) < reach)).select("page", F.col("box_id_a").alias("box_id")).distinct()
    return new.join(close, ["page", "box_id"], "left_anti")


class _Page:
    """The tokens of one page by rows and from the left, and for each its partner: the first token that joins on to it."""

    def __init__(self, tokens: list[dict], code: re.Pattern):
        self.tokens = sorted(tokens, key=lambda t: (t["y0"], t["x0"], t["box_id"]))
        self.code = code
        known = tokens[0].get("known")
        self.known = None if known is None else _Known(known)
        self.partner = [self.first(a) for a in range(len(tokens))]

    def fits(self, a: dict | None, b: dict | None) -> bool:
        """Whether b follows a closely enough in its row, or as its subscript, and both together stand for a code."""
        if a is None or b is None or a is b or a["rotated"] or b["rotated"]:
            return False
        high, gap = a["y1"] - a["y0"], b["x0"] - a["x1"]
        if not -2 <= gap < 0.45 * high:
            return False
        dy = abs(a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2
        below = b["y1"] - b["y0"] < 0.85 * high and b["y1"] >= a["y1"] - 0.2 * high and dy < 0.6 * high
        text = a["label"] + b["label"]
        return (dy < 0.35 * high or below) and self.code.fullmatch(text) is not None and (self.known is None or text in self.known)

    def first(self, a: int) -> int:
        return next((b for b, t in enumerate(self.tokens) if self.fits(self.tokens[a], t)), -1)

    def joined(self) -> list[dict]:
        """Joins the first token that has a partner with it, until none has one. Only pairs with one of the two can change."""
        while (a := next((k for k, b in enumerate(self.partner) if b >= 0), -1)) >= 0:
            b = self.partner[a]
            t, u = self.tokens[a], self.tokens[b]
            t |= {"label": t["label"] + u["label"], "y0": min(t["y0"], u["y0"]), "x1": u["x1"], "y1": max(t["y1"], u["y1"]), "conf": min((c for c in (t["conf"], u["conf"]) if c is not None), default=None)}
            self.tokens[b], self.partner[b] = None, -1
            for c, p in enumerate(self.partner):
                if c == a or p in (a, b):
                    self.partner[c] = self.first(c)
                elif (p < 0 or a < p) and self.fits(self.tokens[c], t):
                    self.partner[c] = a
        return [t for t in self.tokens if t is not None]


class _Known:
    """Codes that a text stands for: the same, the same but for case, or the only one that is the same once misread characters are folded."""

    def __init__(self, codes: list[str]):
        self.codes, self.lower = set(codes), {c.lower() for c in codes}
        self.folded = Counter(map(self.fold, self.codes))

    @staticmethod
    def fold(text: str) -> str:
        return text.translate(str.maketrans(CONFUSED, MEANT)).lower()

    def __contains__(self, text: str) -> bool:
        return text in self.codes or text.lower() in self.lower or (len(text) >= 2 and self.folded[self.fold(text)] == 1)


def _touching(table: pa.Table, most: int = 64) -> np.ndarray:
    """For each row whether some token of its page may follow another: their gap fits. Pages of over `most` tokens may always."""
    key, x0, x1, y0, y1 = (table[c].to_numpy() for c in ("page_key", "x0", "x1", "y0", "y1"))
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    page = np.repeat(np.arange(len(start)), size)
    high, hit = y1 - y0, size > most
    for k in range(1, min(most, size.max())):
        near = np.flatnonzero(page[k:] == page[:-k])
        for a, b in ((near, near + k), (near + k, near)):
            gap = x0[b] - x1[a]
            hit[page[a[(gap >= -2) & (gap < 0.45 * high[a])]]] = True
    return hit[page]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that end where a page ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("page_key").to_numpy()
        last = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
        if last or (held and held[-1].column("page_key")[-1].as_py() != key[0]):
            if held or last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _joining(code: re.Pattern, schema: pa.Schema):
    """Pages stand together in the rows. Those on which no token may follow another stay as they are; of the others one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            hit = _touching(table)
            yield from table.filter(pa.array(~hit)).select(schema.names).cast(schema).to_batches()
            out: list[dict] = []
            for _, page in groupby(table.filter(pa.array(hit)).to_pylist(), key=lambda row: row["page"]):
                out += _Page(list(page), code).joined()
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def joined_tokens(tokens: DataFrame, code: str, known: DataFrame | None = None) -> DataFrame:
    """Tokens (page, box_id, label, box) after neighbours that were read apart are joined: one that follows at once in the same row, or
    as a smaller subscript, and makes a code together with it that stands for a known one, where codes are given: (page, code), or
    (code) for all pages, one drawing's list. Pairs are joined one at a time, by rows and then from the left, until none is left; a
    page's tokens are one group. Tokens with `rotated` stay as they are; `conf` becomes the lower one of the two."""
    extra = {"rotated": F.lit(False), "conf": F.lit(None).cast("double")}
    now = tokens.select("page", "box_id", "label", *BOX, *((F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c == "rotated" else F.col(c).cast("double")).alias(c) if c in tokens.columns else v.alias(c) for c, v in extra.items()))
    if known is not None:
        by = [c for c in ("page",) if c in known.columns]
        lists = known.groupBy(*by).agg(F.collect_set("code").alias("known"))
        now = now.join(lists, by, "left") if by else now.crossJoin(F.broadcast(lists))
        now = now.withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    made = StructType([f for f in now.schema.fields if f.name not in ("rotated", "known")])
    # Equal keys of neighbouring pages would only have these looked at more closely.
    sorted_ = now.repartition("page").sortWithinPartitions("page").withColumn("page_key", F.xxhash64("page"))
    out = sorted_.mapInArrow(_joining(re.compile(code), to_arrow_schema(made)), made)
    kinds = dict(tokens.dtypes)
    return out.select("page", "box_id", "label", *(F.col(c).cast(kinds[c]).alias(c) for c in BOX), *(["conf"] if "conf" in tokens.columns else []))
