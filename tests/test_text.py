import pytest
from pyspark.sql import functions as F

from factloom.functions import text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("comp", "sign", "score"), [("多穴管", "多穴管", 3), ("多穴管", "第1多穴管", 2), ("ファン", "軸流ファン", 2), ("第1ヘッダ", "ヘッダ", 1), ("第1ヘッダ", "第2ヘッダ", 0), ("横回転軸", "回転軸", 0), ("前記 筐体", "筐体", 3), ("", "筐体", 0), ("管", "横管", 0)])
def test_name_match(spark, comp, sign, score):
    assert one(spark, text.name_match(F.col("a"), F.col("b")), a=comp, b=sign) == score


@pytest.mark.parametrize(
    ("number", "expected"),
    [
        ("特開２０２２－１４４９５７号公報", ["JP2022144957A"]),
        ("2022-144957", ["JP2022144957A"]),
        ("7800720", ["JP7800720B2", "JP7800720B1"]),
        ("特許第7800720号", ["JP7800720B2", "JP7800720B1"]),
        ("特開平8-123", ["JPH08000123A"]),
        ("実登3012345", ["JP3012345U"]),
        ("再表2010/123456", ["JPWO2010123456A1", "WO2010123456A1"]),
        ("WO2020/123456", ["WO2020123456A1"]),
        ("US 10,1", []),
        ("JP2022144957A", ["JP2022144957A"]),
        ("", []),
    ],
)
def test_doc_candidates(spark, number, expected):
    assert one(spark, text.doc_candidates(F.col("n")), n=number) == expected


def test_document_address(spark):
    at = lambda n: one(spark, text.document_address(F.col("n"), "https://host"), n=n)
    assert at("特開2022-1449") == "https://host/c1801/PU/JP-2022-001449/11/ja"
    assert at("特願2022-1449") == "https://host/c1801/PU/JP-2022-001449/10/ja"
    assert at("特許第7800720号") == at("JP7800720B2") == "https://host/c1801/PU/JP-7800720/15/ja"
    assert at("実登3012345") == "https://host/c1801/PU/JP-3012345/25/ja"
    assert at("something") is None


def test_sign_pairs_hold_codes_until_a_name_comes(spark):
    found = one(spark, text.sign_pairs(F.col("t")), t="１、１０１  半導体装置\n５  電力変換装置\n???\n7 foo\n１ 別名")
    assert {p["code"]: p["name"] for p in found} == {"1": "半導体装置", "101": "半導体装置", "5": "電力変換装置"}


def test_bigrams_and_overlap(spark):
    assert one(spark, text.bigrams(F.col("t")), t="abab") == ["ab", "ba"]
    assert one(spark, text.bigrams(F.col("t")), t="a") == []
    same = text.overlap(text.bigrams(F.col("a")), text.bigrams(F.col("b")))
    assert one(spark, same, a="abc", b="abc") == 1.0
    assert one(spark, same, a="a", b="a") == 0.0
    assert one(spark, same, a="abc", b="bcd") == one(spark, same, a="bcd", b="abc") == pytest.approx(1 / 3)


def test_labels_and_claims(spark):
    assert one(spark, text.fig_label(F.col("t")), t="図１は、本実施形態に係る電力変換装置の斜視図である。") == "図1：本実施形態に係る電力変換装置の斜視図"
    assert one(spark, text.first_claim(F.col("t")), t="【請求項１】甲。【請求項２】乙。") == "甲。"
    assert [tuple(x) for x in one(spark, text.claims_block(F.col("t")), t="【請求項1】甲。\n【請求項2】乙。")] == [(1, "甲。"), (2, "乙。")]
    assert one(spark, text.nfkc(F.col("t").cast("string")), t=None) == ""
    assert one(spark, text.folded(F.col("t")), t="3Ob") == "306"
    assert one(spark, text.clean_relation(F.col("t")), t="には有する") == "有する"
    assert one(spark, text.company_name(F.col("t")), t="Acme Co., Ltd.") == "Acme"
