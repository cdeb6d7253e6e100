import corpus_pipeline
from factloom.llm import queries
from tests.llm import brute


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_stages_on_odd_rows(spark, tmp_path):
    base = "the house stands on a green hill and the river runs below it to the wide sea where ships wait for wind"
    item = "Question: how many ships wait for wind below the green hill near the wide river sea today"
    docs = [
        (1, base * 2, "en"), (2, (base * 2).replace("green", "green"), "en"), (3, None, "en"), (4, "", None), (5, "123", "en"),
        (6, f"note {item} end", "en"), (7, "login token = abcdef123456 and the river runs on to the sea", "en"), (None, "a plain text of the river", None), (8, "x" * brute.LONG, "en"),
    ]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "1 AS id", "2 AS label", "3 AS spans")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in df.collect()}
    assert set(kept["language"]) == {1, 2, 6, 7, None, 8}
    assert set(kept["near_duplicates"]) == {1, 6, 7, None, 8}
    assert set(kept["benchmark"]) == {1, 7, None, 8}
    assert kept["secrets"][7].text == "login [SECRET] and the river runs on to the sea" and kept["secrets"][7].n_chars == len(kept["secrets"][7].text)
    assert kept["secrets"][1].text == base * 2
    assert all(r.round_trip for r in kept["tokens"].values())
    assert list(kept["secrets"][1].asDict()) == corpus_pipeline.COLUMNS


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_go_by_row(spark):
    """Where ids repeat, only the copy's own rows go, and one of equal rows stays."""
    a, b, c = ("the house stands on a green hill " * 3, "ships wait for wind below the wide river " * 3, "nothing here is like the other two texts at all")
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (None, "one more text of its own without any id"), (5, a + "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(str(i) for i, _ in got) == ["3", "7", "9", "None"] and (7, b) in got
