"""Labelled drawings: which publication serves a request, and what its figures show of a claim's components.

`resolved` finds for each request its publication, and where that lacks signs or
images the family member that lends them. `report` joins components, signs and
what was read in the figures into four tables: legend, figures, unknown, others.
All of it is joins and aggregations by request; nothing loops over requests, and no table is sent whole to each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from factloom.functions import text
from factloom.operators import boxes, claims, resolve
from factloom.operators.boxes import BOX
from factloom.session import by_key, stored

#: Family members looked at, figures taken, and the share of an image's codes that the signs have to know.
FAMILY, FIGURES, KNOWN = 6, 40, 0.3
#: A number read with this confidence counts though no table has it.
SURE, NUMBER = 85, "^[0-9]{1,4}[a-z]?$"


def by_number(requests: DataFrame, publications: DataFrame) -> DataFrame:
    """id, doc, n_tried of requests (id, number) one of whose possible publication numbers exists: the first one, and how many were tried."""
    tried = requests.select("id", F.posexplode(text.doc_candidates(F.col("number"))).alias("at", "doc"))
    found = tried.join(by_key(publications.select(F.col("id").alias("doc")).distinct()), "doc", "left_semi")
    return found.groupBy("id").agg(F.min_by("doc", "at").alias("doc"), (F.min("at") + 1).alias("n_tried"))


@F.pandas_udf(DoubleType())
def _likeness(claim: pd.Series, others: pd.Series) -> pd.Series:
    """The largest share of common pairs of characters, of all pairs, with one of the other claims."""
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    best = []
    for own, theirs in zip(claim, others, strict=True):
        held = pairs(own or "")
        sets = [pairs(t or "") for t in ([] if theirs is None else theirs)]
        best.append(max((len(held & x) / max(1, len(held | x)) for x in sets), default=0.0))
    return pd.Series(best, dtype="float64")


def claim_likeness(pairs: DataFrame) -> DataFrame:
    """sim of rows (claim, claims): how alike the most alike of the claims is by pairs of characters; 0.5 where no claim is given."""
    bare = pairs.withColumns({"own": text.bare_claim(F.col("claim")), "theirs": F.transform("claims", text.bare_claim)})
    return bare.withColumn("sim", F.when(F.coalesce("claim", F.lit("")) == "", 0.5).otherwise(_likeness("own", "theirs"))).drop("own", "theirs", "claims")


def resolved(requests: DataFrame, publications: DataFrame, signs: DataFrame, hits: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """id, doc, found_by, sim, sign_doc, image_doc of requests (id, number, claim) for which a publication is found.

    publications: as parsed; signs: (id, code) of publications; hits: (id, rank, hit) what a search for a request gave. doc is the
    first candidate number that exists, else the best hit. Family members in their order of preference, FAMILY at most, lend signs
    (own or international publications only) and images; images only where the codes in them are known to the signs. publications
    hold a number once; where several documents share one, own (id, pictured, family) tells what is a request's own."""
    signs = stored(signs.select("id", "code").distinct(), "signs")  # they are met three times, and their plan is long
    direct = stored(by_number(requests, publications).select("id", "doc", F.lit("number").alias("found_by")), "direct")
    docs = by_key(publications.select(F.col("id").alias("doc"), "claims"))
    chosen = direct
    if hits is not None:
        open_ = requests.join(by_key(direct), "id", "left_anti").select("id", "claim")
        likely = claim_likeness(open_.join(by_key(hits), "id").join(docs, F.col("hit") == F.col("doc")).select("id", "claim", "rank", "hit", "claims"))
        chosen = direct.unionByName(resolve.best_hit(likely).select("id", F.col("hit").alias("doc"), F.lit("search").alias("found_by")))
    told = requests.select("id", "claim").where("claim <> ''")
    near = chosen.join(by_key(claim_likeness(chosen.join(by_key(told), "id").join(docs, "doc")).select("id", "sim")), "id", "left")

    signed = signs.select(F.col("id").alias("doc")).distinct().withColumn("signed", F.lit(True))
    if own is None:
        own = chosen.join(by_key(publications.select(F.col("id").alias("doc"), (F.size("images") > 0).alias("pictured"), "family")), "doc").select("id", "pictured", "family")
    owned = near.join(by_key(signed), "doc", "left").join(by_key(own), "id", "left").select("id", "doc", "found_by", "sim", "family", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("signed", "pictured")))
    lacking = owned.where("NOT signed OR NOT pictured")
    members = _family(lacking)
    members = members.withColumnRenamed("signed", "doc_signed").join(by_key(signed.withColumnRenamed("doc", "member")), "member", "left")
    lender = members.where("NOT doc_signed AND signed AND (member LIKE 'JP%' OR member LIKE 'WO%')").groupBy("id").agg(F.min(F.struct("place", F.col("member").alias("sign_doc"))).alias("lender"))
    with_images = members.where("NOT pictured").join(by_key(lender), "id", "left")
    # What an image's codes are held against at each member: the signs found up to there, or else its own.
    against = F.when(F.col("doc_signed"), F.col("doc")).when(F.col("lender.place") <= F.col("place"), F.col("lender.sign_doc")).otherwise(F.col("member"))
    fitting = _fitting(with_images.select("id", "place", "member", against.alias("against")), publications, signs)
    image = fitting.groupBy("id").agg(F.min_by("member", "place").alias("member_image"))
    out = owned.join(by_key(lender), "id", "left").join(by_key(image), "id", "left")
    lent_ = lambda own, other, name: F.when(F.col(own), F.col("doc")).otherwise(F.col(other)).alias(name)
    return stored(out.select("id", "doc", "found_by", "sim", lent_("signed", "lender.sign_doc", "sign_doc"), lent_("pictured", "member_image", "image_doc")), "resolved")


def _family(rows: DataFrame) -> DataFrame:
    """One row for each of the first members of rows (id, ..., family), best first: member, place."""
    each = rows.select(*(c for c in rows.columns if c != "family"), F.posexplode("family").alias("at", "member"))
    w = Window.partitionBy("id").orderBy(*claims.family_order(F.col("member")), "at")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= FAMILY).drop("at")


def _fitting(rows: DataFrame, publications: DataFrame, signs: DataFrame) -> DataFrame:
    """Rows (id, place, member, against) whose member has images and codes in them that `against` knows, or where either has none."""
    codes = F.array_distinct(F.flatten(F.transform("images", lambda i: F.transform(i["callouts"], lambda c: c["id"]))))
    read = publications.where(F.size("images") > 0).select(F.col("id").alias("member"), codes.alias("read"))
    table = signs.groupBy(F.col("id").alias("against")).agg(F.collect_set("code").alias("known"))  # the signs of one publication
    both = rows.join(by_key(read), "member").join(by_key(table), "against", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return both.where((F.size("read") == 0) | (F.size("known") == 0) | (F.size(F.array_intersect("read", "known")) >= KNOWN * F.size("read")))


def lent(found: DataFrame, table: DataFrame, source: str) -> DataFrame:
    """Rows of a table by publication (id, ...) as rows of the requests that use it: source names the column of found."""
    return found.select("id", F.col(source).alias("of")).where("of IS NOT NULL").join(by_key(table.withColumnRenamed("id", "of")), "of").drop("of")


def merged_body(found: DataFrame, body: DataFrame) -> DataFrame:
    """id, code, name: the body name of each code from the request's own publication, else from the one of its signs, else of its images."""
    rows = [lent(found, body, c).withColumn("priority", F.lit(k)) for k, c in enumerate(("doc", "sign_doc", "image_doc"))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("id", "code").agg(F.min_by("name", F.struct("priority", "name")).alias("name"))


def figure_pages(found: DataFrame, publications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The figures (id, page, label) of each request's image publication, and the callouts in them (id, page, box_id, label, note, box).
    Figures are named by the text's references where there are as many of these as images, else by number."""
    images = lent(found, publications.select("id", "images", "figrefs"), "image_doc").withColumn("images", F.slice("images", 1, FIGURES))
    each = images.select("id", F.posexplode("images").alias("at", "image"), F.when(F.size("figrefs") == F.size("images"), F.col("figrefs")).alias("refs"))
    named = F.coalesce(text.fig_label(F.try_element_at("refs", F.col("at") + 1)), F.concat(F.lit("図面 "), (F.col("at") + 1).cast("string")))
    pages = each.select("id", F.col("at").alias("page"), F.when(F.col("refs").isNull(), F.concat(F.lit("図面 "), (F.col("at") + 1).cast("string"))).otherwise(named).alias("label"))
    read = each.select("id", F.col("at").alias("page"), F.posexplode("image.callouts").alias("n", "c"))
    return pages, read.select("id", "page", F.concat(F.lit("c"), F.col("n").cast("string")).alias("box_id"), F.col("c.id").alias("label"), F.col("c.label").alias("note"), *(F.col(f"c.{b}").alias(b) for b in BOX))


def local_signs(texts: DataFrame, pasted: DataFrame) -> DataFrame:
    """id, at, code, name of own material: the list under the heading of a text (id, text), overruled code by code by pasted lists."""
    listed = lambda df, rank: df.where("text IS NOT NULL").select("id", F.lit(rank).alias("rank"), F.posexplode(text.sign_list(text.sign_section(F.col("text")), 1)).alias("at", "p"))
    headed = texts.where(F.contains(text.nfkc(F.col("text")), F.lit("符号の説明")))
    both = listed(headed, 1).unionByName(listed(pasted, 0)).select("id", "p.code", "p.name", "rank", "at")
    first = both.groupBy("id", "code").agg(F.min_by(F.struct("name", "rank", "at"), F.struct("rank", "at")).alias("m"))
    order = Window.partitionBy("id").orderBy("m.rank", "m.at")
    return first.select("id", (F.row_number().over(order) - 1).alias("at"), "code", "m.name")


def extra_components(claim: DataFrame, signs: DataFrame, components: DataFrame) -> DataFrame:
    """id, comp, at: sign names that a claim (id, claim) holds word for word, not behind another letter of a word, and that are no
    components yet; of names that are one after normalising the first."""
    names = signs.select("id", "at", "name", text.norm(F.col("name")).alias("key")).where(F.length("key") >= 2)
    first = names.groupBy("id", "key").agg(F.min_by(F.struct("at", "name"), F.struct("at", "name")).alias("s"))
    new = first.join(by_key(components.select("id", text.norm(F.col("comp")).alias("key")).distinct()), ["id", "key"], "left_anti")
    flat = claim.select("id", text.norm(text.nfkc(F.col("claim"))).alias("flat"))
    quoted = F.concat(F.lit(f"(?<!{claims.NAME})\\Q"), F.replace("key", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return new.join(by_key(flat), "id").where(F.contains("flat", F.col("key")) & F.regexp("flat", quoted)).select("id", F.col("s.name").alias("comp"), F.col("s.at").alias("at"))


@dataclass
class Report:
    """legend: id, place, comp, codes, names, source, extra, figs. figures: id, page, label, codes, claim_codes, n_callouts, n_tokens.
    unknown: id, code, note, body_name, figs. others: id, code, name."""

    legend: DataFrame
    figures: DataFrame
    unknown: DataFrame
    others: DataFrame


def in_code_order(codes: Column) -> Column:
    """Codes of an array, each once, the shorter first."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(codes), lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))), lambda x: x["c"])


def legend_of(components: DataFrame, claim: DataFrame, signs: DataFrame, body: DataFrame) -> DataFrame:
    """id, place, comp, codes, names, source, extra of components (id, place, comp) and of those that only the claim adds."""
    own = components.groupBy("id", "comp").agg(F.min("place").alias("place")).withColumn("extra", F.lit(False))
    more = extra_components(claim, signs, own).select("id", "comp", F.col("at").alias("place"), F.lit(True).alias("extra"))
    order = Window.partitionBy("id").orderBy("extra", "place", "comp")
    every = stored(own.unionByName(more).withColumn("place", F.row_number().over(order)), "components")
    links = resolve.link_with_fallback(every, signs, body, ("id",))
    linked = links.groupBy("id", "comp").agg(in_code_order(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("name")).alias("names"), F.min("origin").alias("source"))
    none = F.array().cast("array<string>")
    return every.join(by_key(linked), ["id", "comp"], "left").select("id", "place", "comp", F.coalesce("codes", none).alias("codes"), F.coalesce("names", none).alias("names"), F.coalesce("source", F.lit("")).alias("source"), "extra")


def _hits(callouts: DataFrame, tokens: DataFrame | None, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each page shows: (id, page, code, origin), and what was found before boxes were reconciled: (id, page, code, note)."""
    by = ("id",)
    matched = lambda df: df.join(by_key(resolve.match_codes(df.select("id", F.col("label").alias("text")), known, by).select("id", F.col("text").alias("label"), "code")), ["id", "label"], "left")
    # A page of the report is a page of one request: boxes meet on both.
    placed = lambda df: df.withColumn("page", F.struct("id", "page"))
    back = lambda df: df.select(F.col("page.id").alias("id"), F.col("page.page").alias("page"), F.col("label").alias("code"), "origin")
    called = stored(matched(callouts).withColumn("label", F.coalesce("code", "label")).drop("code"), "called")
    seen = called.select("id", "page", F.col("label").alias("code"), "note")
    if tokens is None:
        return called.select("id", "page", F.col("label").alias("code"), F.lit("callout").alias("origin")), seen
    read = matched(tokens).withColumns({"sure": F.col("code").isNotNull() | (F.col("label").rlike(NUMBER) & (F.col("conf") >= SURE))})
    read = read.where(F.col("sure") | F.col("label").rlike(f"^{text.CODE}$")).withColumns({"label": F.coalesce("code", "label"), "box_id": F.concat(F.lit("t"), F.col("box_id").cast("string"))})
    both = boxes.reconciled(placed(called.select("id", "page", "box_id", "label", *BOX)), placed(read.select("id", "page", "box_id", "label", *BOX)))
    doubtful = placed(read.where(~F.col("sure"))).select("page", "box_id")
    hits = both.join(by_key(doubtful), ["page", "box_id"], "left_anti")
    hits = stored(hits, "hits")
    added = back(hits.where(F.startswith("box_id", F.lit("t"))))
    return back(hits), seen.unionByName(added.select("id", "page", "code", F.lit("").alias("note")))


def report(components: DataFrame, claim: DataFrame, signs: DataFrame, body: DataFrame, pages: DataFrame, callouts: DataFrame, tokens: DataFrame | None = None) -> Report:
    """The report of requests: components (id, place, comp), claim (id, claim), signs (id, at, code, name), body (id, code, name),
    pages (id, page, label), callouts (id, page, box_id, label, note, box) and tokens read (id, page, box_id, label, conf, box).

    Tables that several parts use are written once in between: parsing and linking stay out of the plans of those parts."""
    signs, body, pages, callouts = (stored(df, name) for df, name in ((signs, "signs"), (body, "body"), (pages, "pages"), (callouts, "callouts")))
    legend = stored(legend_of(components, claim, signs, body), "legend")
    claimed = legend.select("id", "comp", F.explode("codes").alias("code"))
    known = signs.select("id", "code").union(body.select("id", "code"))
    hits, seen = _hits(callouts, tokens, known)
    labels = lambda rows: F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("page", rows))), lambda x: x[rows]))

    shown = hits.select("id", "page", "code").distinct().join(by_key(claimed), ["id", "code"]).join(by_key(pages), ["id", "page"])
    figs = shown.groupBy("id", "comp").agg(labels("label").alias("figs"))
    legend = legend.join(by_key(figs), ["id", "comp"], "left").select("id", "place", "comp", "codes", "names", "source", "extra", F.coalesce("figs", F.array().cast("array<string>")).alias("figs"))

    marks = claimed.select("id", "code").distinct().withColumn("claimed", F.lit(True))
    of_page = hits.join(by_key(marks), ["id", "code"], "left").groupBy("id", "page").agg(
        in_code_order(F.collect_set("code")).alias("codes"), in_code_order(F.collect_set(F.when(F.col("claimed"), F.col("code")))).alias("claim_codes"),
        F.count_if(F.col("origin") == "callout").alias("n_callouts"), F.count_if(F.col("origin") == "token").alias("n_tokens"),
    )
    none = F.array().cast("array<string>")
    figures = pages.join(by_key(of_page), ["id", "page"], "left").select("id", "page", "label", *(F.coalesce(c, none).alias(c) for c in ("codes", "claim_codes")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_callouts", "n_tokens")))

    strange = seen.join(by_key(signs.select("id", "code").distinct()), ["id", "code"], "left_anti").join(by_key(pages), ["id", "page"])
    unknown = strange.groupBy("id", "code").agg(F.min_by("note", F.struct("page", "note")).alias("note"), labels("label").alias("figs"))
    unknown = unknown.join(by_key(body.select("id", "code", F.col("name").alias("body_name"))), ["id", "code"], "left").select("id", "code", "note", F.coalesce("body_name", F.lit("")).alias("body_name"), "figs")
    others = signs.select("id", "code", "name").join(by_key(marks), ["id", "code"], "left_anti")
    return Report(legend, figures, unknown, others)


def notes(found: DataFrame, signs: DataFrame) -> DataFrame:
    """id and notes of resolved requests: found only by searching, claims that differ, signs or images lent by the family, no signs."""
    has = signs.select("id").distinct().withColumn("has", F.lit(True))
    told = [
        ("found by search", F.col("found_by") == "search"), ("claims differ", F.col("sim") < 0.5), ("signs of a family member", F.col("sign_doc") != F.col("doc")),
        ("images of a family member", F.col("image_doc") != F.col("doc")), ("no list of signs", F.col("has").isNull()), ("no images", F.col("image_doc").isNull()),
    ]
    said = F.array_compact(F.array(*(F.when(test, F.lit(note)) for note, test in told)))
    return found.join(has, "id", "left").select("id", said.alias("notes"))


def _html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def html(found: Report, titles: DataFrame) -> DataFrame:
    """id and html of each request (id, title): a page with the legend as a table, other signs and unknown codes. Images are not part of it."""
    joined = lambda c, empty: F.when(F.size(c) > 0, F.array_join(c, "、")).otherwise(F.lit(empty))
    where = F.when(F.size("figs") > 0, F.array_join("figs", "、")).when(F.size("codes") > 0, F.lit("not found in the figures")).otherwise("")
    basis = F.concat("source", F.when(F.col("extra"), F.lit(" (same name in the claim)")).otherwise(""))
    cells = F.concat(*(F.concat(F.lit("<td>"), _html(c), F.lit("</td>")) for c in (F.col("comp"), joined("codes", "―"), joined("names", ""), basis, where)))
    lines = lambda df, order, line: df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]).alias("lines"))
    table = lines(found.legend, ["place"], F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).select("id", F.array_join("lines", "").alias("legend"))
    size = F.length("code").alias("n")
    others = lines(found.others, [size, "code"], _html(F.concat_ws(" ", "code", "name"))).select("id", F.array_join("lines", "、").alias("others"))
    named = F.when(F.col("body_name") != "", F.concat(F.lit("・"), "body_name")).otherwise("")
    unknown = lines(found.unknown, [size, "code"], _html(F.concat("code", F.lit("（"), F.array_join(F.slice("figs", 1, 3), "・"), named, F.lit("）")))).select("id", F.array_join("lines", "、").alias("unknown"))
    whole = titles.join(table, "id", "left").join(others, "id", "left").join(unknown, "id", "left")
    part = lambda c: F.coalesce(c, F.lit("―"))
    page = [F.lit("<!doctype html><meta charset=\"utf-8\"><h1>"), _html(F.coalesce("title", F.lit(""))), F.lit("</h1><table>"), F.coalesce("legend", F.lit("")), F.lit("</table><p>"), part("others"), F.lit("</p><p>"), part("unknown"), F.lit("</p>")]
    return whole.select("id", F.concat(*page).alias("html"))
