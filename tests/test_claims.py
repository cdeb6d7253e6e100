from factloom.operators import claims
from factloom.sources import publications


def test_expansion(spark):
    docs = spark.createDataFrame([("p", "【請求項１】甲。【請求項２】請求項１に記載の乙。【請求項３】請求項２に記載の丙。【請求項４】請求項９の丁。"), ("q", None)], "id string, text string")
    got = {r.no: (r.n_parts, r.text) for r in claims.expanded(claims.numbered(docs)).collect()}
    assert got[1] == (1, "甲。")
    assert got[3] == (3, "甲。\n請求項1に記載の乙。\n請求項2に記載の丙。")
    assert got[4] == (1, "請求項9の丁。")


def test_no_chain_is_too_long(spark):
    """1,000 claims, each on the one before, and some odd references, against a plain walk."""
    rows = [("p", n, f"c{n}", n - 1 if n > 1 else None) for n in range(1, 1001)] + [("q", 5, "x", 9), ("q", 9, "y", 9), ("q", 11, "z", 9), ("q", 12, None, 4)]
    got = {(r.id, r.no): (r.n_parts, r.text) for r in claims.expanded(spark.createDataFrame(rows, "id string, no int, text string, ref int")).collect()}
    known = {(i, n): (t, ref) for i, n, t, ref in rows}
    for (i, no), (t, ref) in known.items():
        parts, last, at = [t], no, ref
        while (i, at) in known and at < last:
            parts.insert(0, known[i, at][0])
            last, at = at, known[i, at][1]
        assert got[i, no] == (len(parts), "\n".join(x for x in parts if x is not None))
    assert len(got) == len(known)


def test_heading_holds_dotted_items(spark):
    """Signs under a heading in the description are read by their form, and a list that is none is turned down."""
    rows = [("a", None, [], "文。【符号の説明】１０…管 ２０…軸 ３０…羽根【書類名】"), ("b", None, [], "符号の説明、これは文、あれも文、それも文、１ 管、２ 軸")]
    got = claims.publication_signs(spark.createDataFrame(rows, "id string, signs string, paragraphs array<string>, description string"))
    assert {(r.id, r.code, r.name, r.origin) for r in got.collect()} == {("a", "10", "管", "heading"), ("a", "20", "軸", "heading"), ("a", "30", "羽根", "heading")}


def test_body_signs(spark):
    docs = spark.createDataFrame([(1, "前記軸流ファン１２は、管３０ｂと管３０ｂ、および図５、配管３０ｂに示す。")], "id int, text string")
    assert {(r.code, r.name) for r in claims.body_signs(docs).collect()} == {("12", "軸流ファン"), ("30b", "管")}


def test_sign_table_needs_enough_codes(spark):
    docs = spark.createDataFrame([(1, "１ 管、２ 軸、３ 羽根"), (2, "１ 管")], "id int, signs string")
    assert {(r.id, r.code, r.name) for r in claims.sign_table(docs).collect()} == {(1, "1", "管"), (1, "2", "軸"), (1, "3", "羽根")}


def test_publication_page(spark):
    html = """<html><head><title>JP1A - Fan unit - Site</title><meta name="DC.title" content="Fan
      unit"></head><section itemprop="claims"><div class="claim">A <div class="claim">x</div>fan</div><div class="claim"> B</div></section>
      <section itemprop="description"><reference-signs-list>1 管<br>2 軸</reference-signs-list><div class="description-paragraph">text 1</div></section>
      <li itemprop="images"><meta itemprop="full" content="u1"></li><tr itemprop="pubs"><td><span itemprop="publicationNumber">JP2B</span></tr>
      <tr itemprop="pubs"><span itemprop="publicationNumber">JP1A</span></tr><tr itemprop="docdbFamily"><span itemprop="publicationNumber">JP2B</span></tr>
      <span itemprop="publicationNumber">US9</span><a itemprop="pdfLink" href="p.pdf">"""
    row = publications.parse(spark.createDataFrame([("JP1A", html), ("x", None)], "id string, html string")).where("id = 'JP1A'").first()
    assert (row.title, row.claims, row.paragraphs, row.signs, [(i.full, i.callouts) for i in row.images], row.family, row.pdf) == ("Fan unit", ["Axfan", "B"], ["text 1"], "1 管\n2 軸", [("u1", [])], ["JP2B"], "p.pdf")


def test_lists_of_signs_are_chosen_by_their_form(spark):
    docs = spark.createDataFrame([(1, "１０…管 ２０…軸 ３０・・・羽根"), (2, "１ 管、２ 軸、３ 羽根、これは文、あれも文"), (3, "これは文、１ 管、２ 軸、あれは文"), (4, None)], "id int, signs string")
    assert {(r.id, r.code, r.name) for r in claims.sign_table(docs).collect()} == {(1, "10", "管"), (1, "20", "軸"), (1, "30", "羽根")}


def test_signs_fall_back_to_paragraphs_and_headings(spark):
    rows = [("a", "1 管\n2 軸", ["x"]), ("b", "", ["文一、文二", "１ 管、２ 軸、３ 羽根", "末の文"]), ("c", "", ["【符号の説明】１ 管、２ 軸【書類名】図面"]), ("d", "", ["文"]), ("e", None, None)]
    got = claims.publication_signs(spark.createDataFrame(rows, "id string, signs string, paragraphs array<string>"))
    found = {}
    for r in got.collect():
        found.setdefault((r.id, r.origin), set()).add(r.code)
    assert found == {("a", "list"): {"1", "2"}, ("b", "paragraph"): {"1", "2", "3"}, ("c", "heading"): {"1", "2"}}
