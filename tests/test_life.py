import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import canonical, network, review
from factloom.sources import collections, extraction, tables, workbooks

ROW = lambda name, keep=True: (name, "r", "t", keep)


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), f"id string, rows {collections.ROWS}")


def held(df):
    return {r.id: [x.source for x in r.rows] for r in collections.reviews_of(df).collect()}


@pytest.fixture
def collection(spark, tmp_path):
    things = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    said = spark.createDataFrame([("a", "s", 0.5)], "id string, source string, prob double")
    return collections.create(spark, str(tmp_path / "c"), "first", things, said)


def test_log_is_applied_once_and_undone(spark, collection, tmp_path):
    collection.record(changes(spark, ("a", [ROW("one")]), ("b", [ROW("two")])))
    collections.follow(collection, str(tmp_path / "at")).awaitTermination()
    assert held(collection.read("reviews")) == {"a": ["one"], "b": ["two"]}
    version = collection.state()[0]
    collections.follow(collection, str(tmp_path / "at")).awaitTermination()  # nothing new
    collections.applied(collection)(collection.log(), 7)  # the same changes in another batch
    assert collection.state()[0] == version
    assert held(collection.read("reviews")) == {"a": ["one"], "b": ["two"]}
    collection.record(changes(spark, ("a", None), ("b", [ROW("new"), ROW("more")]), ("c", [])))
    collections.follow(collection, str(tmp_path / "other")).awaitTermination()  # a new checkpoint: the whole log again
    assert held(collection.read("reviews")) == {"b": ["new", "more"], "c": []}
    collection.record(collections.undone(collection.log(), 3))
    collections.applied(collection)(collection.log(), 9)
    assert held(collection.read("reviews")) == {"a": ["one"], "b": ["two"]}
    assert held(collection.log()) == held(collection.read("reviews"))


def test_versions(spark, collection, tmp_path):
    assert collection.state()[0] == 1 and collection.read("meta").first()["name"] == "first"
    with pytest.raises(ValueError):
        collections.create(spark, collection.root, "again", spark.range(1), spark.range(1))
    collection.commit(entities=collection.read("entities").where("id = 'b'"))
    spark.range(3).write.parquet(f"{collection.root}/tables/entities/3")  # a writer that was lost before its manifest
    assert [r.id for r in collection.read("entities").collect()] == ["b"] and collection.read("statements").count() == 1
    assert collection.read("entities", 1).count() == 2
    assert collection.restore(1) == 3 and collection.read("entities").count() == 2
    assert collection.commit(entities=collection.read("entities").limit(1)) == 4
    with pytest.raises(ValueError):
        collection.read("entities", 9)
    with pytest.raises(ValueError):
        collection.restore(9)


def test_analysis_replaces_statements(spark):
    entities = spark.createDataFrame([("a", None), ("b", True), ("c", None)], "id string, analyzed boolean")
    old = spark.createDataFrame([("a", "old"), ("c", "stays")], "id string, source string")
    found = spark.createDataFrame([("a", [("new", "r", "t", 0.5, True, "o")], None), ("c", None, "failed")], "id string, candidates array<struct<source:string,relation:string,target:string,prob:double,selected:boolean,origin:string>>, error string")
    marked, said = collections.analysed(entities, old, found)
    assert {r.id: r.analyzed for r in marked.collect()} == {"a": True, "b": True, "c": None}
    assert sorted((r.id, r.source) for r in said.collect()) == [("a", "new"), ("c", "stays")]


def test_extraction_stops_after_the_first_failures(spark, tmp_path):
    """A counting extractor leaves a file for each call."""
    calls = tmp_path / "calls"
    calls.mkdir()
    docs = spark.createDataFrame([(f"{k:02}", "bad" if k < 2 else "good" if k == 2 else "x") for k in range(20)], "id string, text string").repartition(4)

    def counting(works):
        def extract(t):
            import uuid

            (calls / uuid.uuid4().hex).touch()
            if t not in works:
                raise ValueError(t)
            return []

        return extract

    with pytest.raises(extraction.ExtractionFailed, match="good"):
        extraction.probed(docs, counting(["x"]))
    assert len(list(calls.iterdir())) == 3
    found = extraction.probed(docs, counting(["x", "good"])).collect()
    assert sorted(r.id for r in found if r.error) == ["00", "01"] and len(found) == 20
    assert len(extraction.probed(docs.limit(2), counting([])).collect()) == 2  # fewer than three: kept as they are


def workbook(path, rows, more=""):
    """A file with shared, inline, number and boolean cells, and a second sheet."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="List" sheetId="1" r:id="a"/><sheet name="Other" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>文献番号</t></si><si><r><t>請求</t></r><r><t>項</t></r><rPh><t>せいきゅう</t></rPh></si><si><t>a&amp;b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{more}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    head = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>FI</t></is></c><c r="E2" t="inlineStr"><is><t>FI</t></is></c></row>'
    rows = head + '<row r="1"/><row r="3"><c r="A3"><v>12</v></c><c r="B3" t="s"><v>2</v></c><c r="E3" t="b"><v>1</v></c></row><row r="9"><c r="D9" t="str"><v> x </v></c></row><row r="10"><c r="A10"/></row>'
    workbook(tmp_path / "list.xlsx", rows, '<row><c t="inlineStr"><is><t>n</t></is></c></row><row><c><v>7</v></c></row>')
    df = tables.read_list(spark, str(tmp_path / "list.xlsx"))
    assert df.columns == ["文献番号", "請求項", "FI", "FI 2"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("12", "a&b", None, "true"), (None, None, " x ", None)], key=str)
    assert [tuple(r) for r in workbooks.read_workbook(spark, str(tmp_path), "Other").collect()] == [("7",)]
    docs = tables.documents(df, tables.detect_columns(df.columns)).where("id IS NOT NULL").first()
    assert (docs.id, docs.text, docs.text_source) == ("12", "a&b", "claim")
    assert [workbooks.column_number(x) for x in ("A1", "Z9", "AA10", "AB7")] == [0, 25, 26, 27]
    with pytest.raises(ValueError):
        workbooks.read_workbook(spark, str(tmp_path), "absent")


def test_texts_fall_back_to_the_third_column(spark):
    df = spark.createDataFrame([("1", "c", "a", "x"), ("2", " ", "a", "x"), ("3", None, "", "x"), ("4", None, None, None)], "a string, b string, c string, d string").toDF("番号", "請求項", "要約", "代替")
    rows = tables.documents(df, tables.detect_columns(df.columns)).collect()
    assert {r.id: (r.text, r.text_source) for r in rows} == {"1": ("c", "claim"), "2": ("a", "abstract"), "3": ("x", "alt"), "4": (None, "none")}
    assert tables.documents(df, tables.detect_columns(df.columns), limit=2).count() == 2


def test_depths_of_a_long_chain(spark):
    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(150)] + [("150", "0"), ("149", "3")], "source string, target string")
    depth = network.depths(links, spark.createDataFrame([("0",)], "node string"))
    assert {r.node: r.depth for r in depth.collect()} == {str(k): k for k in range(151)}
    assert sorted(map(tuple, network.crossing(links, depth).collect())) == [("149", "3"), ("150", "0")]


def test_names_and_tidy_relations(spark):
    spelled = spark.createDataFrame([(n,) for n in ("Ｆａｎ", "fan", "Fan", "前記fan", "blade", "rotor-blade", "Rotor Blade", "hub", None)], "name string")
    merges = spark.createDataFrame([("blade", "Rotor Blade"), ("hub", "gone"), ("fan", "hub")], "name string, into string")
    got = {r.name: r.canonical for r in canonical.names(spelled, merges).collect()}
    assert got == {n: "Fan" for n in ("Ｆａｎ", "fan", "Fan", "前記fan", "hub")} | {n: "Rotor Blade" for n in ("blade", "rotor-blade", "Rotor Blade")}
    rows = spark.createDataFrame([("p", "fan", " has ", "blade"), ("p", "Ｆａｎ", "has", "Rotor Blade"), ("p", "fan", "is", "hub"), ("p", "", "x", "hub"), ("p", "new", "on", "hub")], "id string, source string, relation string, target string")
    assert sorted(tuple(r) for r in canonical.tidy(rows, canonical.names(spelled, merges)).collect()) == [("p", "Fan", "has", "Rotor Blade", 2), ("p", "new", "on", "Fan", 1)]
    chain = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(200)] + [("x", "y")], "a string, b string")
    assert {r.label for r in canonical.components(chain).collect()} == {"000", "x"}
    candidates = spark.createDataFrame([("p", "fan", "has", "blade", True), ("p", "Rotor Blade", "has", "Ｆａｎ", False), ("p", "a", "has", "b", False)], "id string, source string, relation string, target string, selected boolean")
    none = spark.createDataFrame([], "x string, y string")
    assert [r.target for r in review.near_duplicates(candidates, none, canonical.names(spelled, merges)).collect()] == ["Ｆａｎ"] and review.near_duplicates(candidates, none).count() == 0


def test_structure_by_hand(spark):
    gold = spark.createDataFrame([("p", "第1電極", "基板"), ("p", "第2電極", "基板"), ("q", "a", "b")], "id string, source string, target string")
    found = spark.createDataFrame([("p", "電極1", "基板"), ("p", "電極9", "基板"), ("p", "電極1", "基板"), ("p", "基板", "電極1"), ("q", "b", "a"), ("r", "a", "b")], "id string, source string, target string")
    assert tuple(review.structure_evaluation(found, gold).first()) == (2, 3, 1)
    assert tuple(review.structure_evaluation(found.limit(0), gold).first()) == (0, 0, 3)


def test_rules_that_share_a_statement(spark):
    """A statement made twice is gone only without a rule that both rows need."""
    rows = [("p", "a", ["R1"]), ("p", "a", ["R2", "R1"]), ("p", "b", ["R1"]), ("p", "b", ["R2"]), ("p", "c", None), ("p", "d", ["R2", "R2"])]
    found, gold = spark.createDataFrame(rows, "id string, source string, rules array<string>"), spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "d"), ("p", "e")], "id string, source string")
    got = {r.rule: (r.n, r.tp, r.fp, round(r.f1_without, 9), round(r.f1_delta, 9)) for r in review.rule_effects(found, gold, ["id", "source"]).collect()}
    whole = 2 * 3 / (3 + 1 + 4)
    assert got == {"R1": (3, 2, 1, round(4 / 7, 9), round(whole - 4 / 7, 9)), "R2": (3, 2, 1, round(4 / 7, 9), round(whole - 4 / 7, 9))}
    assert sorted((r.source, r.rules) for r in review.dropped_by(found, ["R1", "R2"], ["id", "source"]).collect()) == [("a", ["R1", "R2"]), ("b", ["R1", "R2"]), ("d", ["R2"])]
