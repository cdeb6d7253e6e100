import pytest

from factloom.operators import claims, drawings
from factloom.sources import publications


def callout(code, label="", box=(0, 0, 10, 10), close=True):
    sides = "".join(f'<meta itemprop="{k}" content="{v}">' for k, v in zip(("left", "top", "right", "bottom"), box, strict=True))
    return f'<li itemprop="callouts"><meta itemprop="id" content="{code}"><meta itemprop="label" content="{label}"><span itemprop="bounds">{sides}</span>{"</li>" * close}'


def page(claim="", signs="", paragraphs=(), images=(), figrefs=(), family=()):
    """A publication page as the parser expects it."""
    return (
        f'<section itemprop="claims"><div class="claim">{claim}</div></section><section itemprop="description">'
        + (f"<reference-signs-list>{signs}</reference-signs-list>" if signs else "") + "".join(f'<div class="description-paragraph">{p}</div>' for p in paragraphs) + "".join(f"<figref>{f}</figref>" for f in figrefs)
        + "</section>" + "".join(f'<li itemprop="images"><meta itemprop="full" content="{i}">{"".join(cs)}</li>' for i, cs in images)
        + "".join(f'<tr itemprop="docdbFamily"><span itemprop="publicationNumber">{f}</span></tr>' for f in family)
    )


@pytest.fixture(scope="module")
def library(spark):
    """Publications that lend each other signs and images, and one whose codes do not fit."""
    body = ["送風機は羽根１１と第２の軸１２を有し、弁９９がある。"]
    rows = {
        "JP2020000001A": page("羽根と軸を備える送風機。", "１１ 羽根<br>１２ 第２軸<br>１３ 軸受", body, [("u1", [callout("11", "blade"), callout("x1"), callout("13", box=("a", 0, 1, 1))]), ("u2", [callout("１２'", box=(0.5, 1.5, 9.9, 8))])], ["図１は、全体を示す図である。", "図２は断面図。"]),
        "JP2020000002A": page("別の送風機。", "", body, [], (), ["US9", "WO2A5", "JPX", "JPY", "WO3"]),
        "JPX": page(images=[("x", [callout("77"), callout("78")])]), "JPY": page(signs="11 羽根<br>12 軸", images=[("y", [callout("11")])]), "WO3": page(signs="1 管", images=[("w", [])]),
        "JP2020000003A": page("蓋を有する容器。", "", [], [("z", [])], (), ["US9"]),
    }
    return publications.parse(spark.createDataFrame(list(rows.items()), "id string, html string"))


def test_images_and_callouts(spark):
    html = page(images=[("a", [callout("1", "one", (1.9, 2, -3.5, 4)), callout("", "none"), callout("2", "bad", ("x", 0, 1, 1)), callout("3", "inf", ("inf", 0, 1, 1)), callout("4", "big", ("1e12", 0, 1, 1)), '<li itemprop="callouts"><meta itemprop="id" content="5"></li>', callout("６'", "", close=False)])], figrefs=["【図 １】は 図", "表1", "[図2"])
    html += '<li itemprop="images"><img itemprop="thumbnail" src="t"></li><li itemprop="images"><meta itemprop="id" content="9"></li>'
    row = publications.parse(spark.createDataFrame([("p", html)], "id string, html string")).first()
    assert [(i.full, [tuple(c) for c in i.callouts]) for i in row.images] == [("a", [("1", "one", 1, 2, -3, 4), ("6", "", 0, 0, 10, 10)]), ("t", [])]
    assert row.figrefs == ["【図１】は図", "[図2"]


def test_resolution(spark, library):
    signs = claims.publication_signs(library)
    asked = [("a", "特開2020-1", "羽根と軸を備える送風機。"), ("b", "特開2020-2", ""), ("c", "特開2020-3", "x"), ("d", "?", "蓋を有する容器。"), ("e", "?", "蓋を有する容器。"), ("f", "?", "")]
    requests = spark.createDataFrame(asked, "id string, number string, claim string")
    hits = spark.createDataFrame([("d", 0, "gone"), ("d", 1, "JP2020000001A"), ("d", 2, "JP2020000003A"), ("e", 0, "JP2020000001A"), ("f", 1, "JP2020000001A"), ("a", 0, "JP2020000003A")], "id string, rank int, hit string")
    got = {r.id: (r.doc, r.found_by, r.sign_doc, r.image_doc) for r in drawings.resolved(requests, library, signs, hits).collect()}
    one = "JP2020000001A"
    assert got == {
        "a": (one, "number", one, one),
        # JPX has images, but no signs are known yet, not even its own, so nothing speaks against it; JPY is the first with signs.
        "b": ("JP2020000002A", "number", "JPY", "JPX"),
        "c": ("JP2020000003A", "number", None, "JP2020000003A"), "d": ("JP2020000003A", "search", None, "JP2020000003A"), "f": (one, "search", one, one),
    }
    assert {r.id: r.n_tried for r in drawings.by_number(requests, library).collect()} == {"a": 1, "b": 1, "c": 1}
    told = {r.id: r.notes for r in drawings.notes(drawings.resolved(requests, library, signs, hits), drawings.lent(drawings.resolved(requests, library, signs, hits), signs, "sign_doc")).collect()}
    assert told["a"] == [] and told["b"] == ["signs of a family member", "images of a family member"] and told["d"] == ["found by search", "no list of signs"] and told["c"] == ["claims differ", "no list of signs"]


def test_codes_of_images_have_to_fit(spark):
    """Signs found before hold for later images: three tenths of the codes have to be known."""
    some = {"D": page(family=["JPA", "JPB", "JPC"]), "JPA": page(signs="1 管<br>2 軸<br>3 弁"), "JPB": page(images=[("u", [callout(str(k)) for k in (1, 5, 6, 7)])]), "JPC": page(images=[("v", [callout(str(k)) for k in (1, 2, 6, 7)])])}
    some["JP1111111B2"] = some.pop("D")
    docs = publications.parse(spark.createDataFrame(list(some.items()), "id string, html string"))
    got = drawings.resolved(spark.createDataFrame([("q", "特許1111111", "")], "id string, number string, claim string"), docs, claims.publication_signs(docs)).first()
    assert (got.doc, got.sign_doc, got.image_doc) == ("JP1111111B2", "JPA", "JPC")


def made(spark, library, tokens=None):
    signs = claims.publication_signs(library)
    body = claims.body_signs(library.selectExpr("id", "array_join(paragraphs, '\n') AS text"))
    requests = spark.createDataFrame([("a", "特開2020-1", "羽根と軸受と軸を備える送風機")], "id string, number string, claim string")
    found = drawings.resolved(requests, library, signs)
    components = spark.createDataFrame([("a", 0, "羽根"), ("a", 1, "軸"), ("a", 2, "弁"), ("a", 3, "蓋"), ("a", 4, "羽根")], "id string, place int, comp string")
    pages, callouts = drawings.figure_pages(found, library)
    return drawings.report(components, requests.select("id", "claim"), drawings.lent(found, signs, "sign_doc"), drawings.merged_body(found, body), pages, callouts, tokens)


def test_report(spark, library):
    r = made(spark, library)
    first, second = "図1：全体", "図2：断面図"
    assert [tuple(x)[1:] for x in r.legend.orderBy("place").collect()] == [
        (1, "羽根", ["11"], ["羽根"], "signs", False, [first]), (2, "軸", ["12"], ["第2軸"], "signs", False, [second]), (3, "弁", ["99"], ["弁"], "body", False, []), (4, "蓋", [], [], "", False, []), (5, "軸受", ["13"], ["軸受"], "signs", True, [])
    ]
    assert sorted(tuple(x)[1:] for x in r.figures.collect()) == [(0, first, ["11", "x1"], ["11"], 2, 0), (1, second, ["12"], ["12"], 1, 0)]
    assert [tuple(x) for x in r.unknown.collect()] == [("a", "x1", "", "", [first])]
    assert r.others.count() == 0


def test_tokens_mend_callouts(spark, library):
    """Read again: a longer code in place of a part of it, a new one, a sure number, an unsure one, and letters that no table has."""
    tokens = spark.createDataFrame([("a", 0, 1, "l3", 90.0, 100, 0, 110, 8), ("a", 0, 2, "55", 90.0, 200, 0, 210, 8), ("a", 0, 3, "56", 50.0, 300, 0, 310, 8), ("a", 0, 4, "x1b", 20.0, 1, 1, 9, 9), ("a", 1, 5, "99", 10.0, 50, 0, 60, 9)], "id string, page int, box_id int, label string, conf double, x0 int, y0 int, x1 int, y1 int")
    r = made(spark, library, tokens)
    figures = {x.page: (x.codes, x.claim_codes, x.n_callouts, x.n_tokens) for x in r.figures.collect()}
    assert figures == {0: (["11", "13", "55", "x1b"], ["11", "13"], 1, 3), 1: (["12", "99"], ["12", "99"], 1, 1)}
    assert {x.code: (x.body_name, len(x.figs)) for x in r.unknown.collect()} == {"x1": ("", 1), "55": ("", 1), "99": ("弁", 1)}


def test_own_material_and_page(spark):
    texts = spark.createDataFrame([("a", "文。【符号の説明】１ 管、２ 軸【書類名】図面"), ("b", None)], "id string, text string")
    pasted = spark.createDataFrame([("a", "２ 回転軸、３ <弁>蓋")], "id string, text string")
    signs = drawings.local_signs(texts, pasted)
    assert [(r.code, r.name) for r in signs.where("id = 'a'").orderBy("at").collect()] == [("2", "回転軸"), ("3", "<弁>蓋"), ("1", "管")]
    pages = spark.createDataFrame([("a", 0, "図面 1")], "id string, page int, label string")
    tokens = spark.createDataFrame([("a", 0, 1, "2", 90.0, 0, 0, 5, 5)], "id string, page int, box_id int, label string, conf double, x0 int, y0 int, x1 int, y1 int")
    none = spark.createDataFrame([], "id string, page int, box_id string, label string, note string, x0 int, y0 int, x1 int, y1 int")
    comps = spark.createDataFrame([("a", 0, "回転軸")], "id string, place int, comp string")
    r = drawings.report(comps, spark.createDataFrame([("a", "軸と管")], "id string, claim string"), signs, spark.createDataFrame([], "id string, code string, name string"), pages, none, tokens)
    assert {x.comp: (x.codes, x.extra, x.figs) for x in r.legend.collect()} == {"回転軸": (["2"], False, ["図面 1"])}
    text = drawings.html(r, spark.createDataFrame([("a", "A & B")], "id string, title string")).first()["html"]
    assert "<h1>A &amp; B</h1>" in text and "<td>回転軸</td><td>2</td><td>回転軸</td><td>signs</td><td>図面 1</td>" in text and "3 &lt;弁&gt;蓋" in text
