import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import layout
from factloom.sources import extraction, tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_dotted_signs(spark):
    got = one(spark, text.dotted_signs(F.col("t")), t="１１０…放熱装置 １１０ａ、３１０ａ…装着面 １２４ 1、１２４ 2…開口部")
    assert [(x["code"], x["name"]) for x in got] == [("110", "放熱装置"), ("110a", "装着面"), ("310a", "装着面"), ("1241", "開口部"), ("1242", "開口部"), ("124", "開口部")]


def test_sections_and_labels(spark):
    assert one(spark, text.sign_section(F.col("t")), t="前【符号の説明】【0001】１ 管【書類名】次").strip() == "1 管"
    assert one(spark, text.solution_part(F.col("t")), t="【課題】x【解決手段】管(12)と軸３を備える。").startswith("管と軸")
    assert one(spark, text.item_label(F.col("a"), F.col("b"), F.col("c")), a="k", b=" ", c="Acme") == "k｜no title｜Acme"
    assert one(spark, text.text_label(F.col("t")), t="請求項（全文）") == "請求項"
    assert one(spark, text.clean_answer(F.col("t")), t="<think>a\nb</think> yes ") == "yes"
    df = spark.sql("SELECT 1 AS a, map('x', 1, 'y', 2) AS m, named_struct('p', 1, 'q', map(1, 2)) AS s UNION ALL SELECT 1, map('y', 2, 'x', 1), named_struct('p', 1, 'q', map(1, 2)) UNION ALL SELECT 1, map('x', 2, 'y', 1), named_struct('p', 1, 'q', map(1, 2))")
    one_way, other = ([r.k for r in df.select(text.fingerprint(df, *names).alias("k")).collect()] for names in (("a", "m", "s"), ("s", "a", "m")))
    assert one_way == other and one_way[0] == one_way[1] != one_way[2]


def test_extraction_keeps_failures_and_resumes(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "bad"), ("c", ""), ("d", None)], "id string, text string")

    def extract(t):
        if t == "bad":
            raise ValueError("x" * 500)
        return [{"source": w, "relation": "r", "target": "t", "prob": float(k), "selected": True, "origin": "o"} for k, w in enumerate(t.split())]

    found = extraction.extracted(extraction.pending(docs, None), extract)
    assert sorted((r.id, r.error and len(r.error)) for r in found.collect()) == [("a", None), ("b", 200)]
    assert [(r.ord, r.source) for r in extraction.candidates(found).collect()] == [(0, "two"), (1, "one")]
    assert [r.id for r in extraction.pending(docs, found).collect()] == ["b"]


def test_history_newest_first(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"time": "2020-01-01", "n": 1}, {"time": "2021-01-01", "n": 2, "disabled": ["R1"]}]')
    assert [r.n for r in tables.read_history(spark, str(tmp_path / "h.json")).collect()] == [2, 1]


def test_claim_texts(spark):
    df = spark.createDataFrame([("特許第1号", "ab"), ("特許1", "abc"), ("", "x"), ("2", None)], "no string, t string")
    assert [tuple(r) for r in tables.claim_texts(df, "no", "t").collect()] == [("特許1", "abc")]


def test_layout_is_stable(spark):
    terms = spark.createDataFrame([(i, t) for i in range(12) for t in (("a", "b") if i % 2 else ("c", "d"))], "id long, term string")
    read = lambda: {r.id: tuple(round(x, 6) for x in r["at"]) for r in layout.coordinates(terms.repartition(3)).collect()}
    got = read()
    assert got == read() and got[0] == got[2] != got[1] and got[1] == pytest.approx(got[3])
