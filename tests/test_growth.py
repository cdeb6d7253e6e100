"""What a task holds follows neither the table nor a frequent value."""

import numpy as np
import pyarrow as pa
import pytest

from factloom import model
from factloom.functions import text
from factloom.operators import boxes, review, stats
from factloom.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast(spark, run) -> list[str]:
    """The plans with broadcasts among those that run by its end, of the session's own record of them."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    plans = [runs.apply(k).physicalPlanDescription() for k in range(before, runs.size())]
    assert plans and all("Scan parquet" in p for p in plans)
    return [p for p in plans if "BroadcastExchange" in p]


def test_parts_follow_the_rows(spark, sf_dir):
    assert model.parts(spark, sf_dir, "lineitem", 100) == model.table(spark, sf_dir, "lineitem").count() // 100 + 1
    assert model.parts(spark, sf_dir, "region") == spark.sparkContext.defaultParallelism


def test_statements_meet_by_item_in_parts_of_bounded_size(spark, sf_dir):
    """Explicit parts are not put together again by adaptive execution, and relations, a few words, deal no rows."""
    for name, key in (("near_duplicate_statements", "id"), ("drawing_components", "id"), ("company_code_matrix", "id"), ("company_code_share", "id"), ("prf_eval", "id"), ("rule_effects", "id"), ("box_near", "page"), ("token_join", "page")):
        assert "REPARTITION_BY_NUM" in plan(registry.QUERIES[name](spark, sf_dir)), name
    assert "hashpartitioning(relation" not in plan(registry.QUERIES["near_duplicate_statements"](spark, sf_dir))


def test_near_duplicates_with_nulls_and_synonyms(spark):
    rows = [(1, "x", "A", "y", True), (1, "y", "N", "x", False), (1, "y", "B", "x", False), (1, "x", None, "y", False), (1, "x", None, "y", True), (2, "x", "A", "y", False), (None, "x", "A", "y", True), (None, "x", "A", "y", False), (1, "x", "A", "y", None)]
    df = spark.createDataFrame(rows, "id int, source string, relation string, target string, selected boolean")
    got = review.near_duplicates(df, spark.createDataFrame([("N", "A"), ("N", "C")], "x string, y string"))
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "y", "N", "x", False)]


def test_a_null_key_equals_none(spark):
    found = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b"), (2, "b")], "id int, t string")
    gold = spark.createDataFrame([(1, "a"), (None, "a"), (3, "c")], "id int, t string")
    for parts in (None, 3):
        assert tuple(review.evaluate(found, gold, ["id", "t"], parts).first()) == (1, 2, 2)


def test_matrix_counts_an_id_once(spark):
    rows = spark.createDataFrame([(1, "r", "a"), (1, "r", "a"), (1, "s", "a"), (1, "r", "b"), (2, "s", "b"), (None, "t", "c")], "id int, row string, col string")
    got = sorted(map(tuple, stats.matrix(rows, "row", "col", 2, 2).collect()))
    assert got == [("r", "a", 1), ("r", "b", 1), ("s", "a", 1), ("s", "b", 1)]


def test_pages_without_neighbours_stay_as_they_are(spark):
    table = pa.table({"page_key": [1, 1, 2, 2, 3], "x0": [0, 9, 0, 30, 9], "x1": [8, 17, 8, 38, 17], "y0": [0] * 5, "y1": [10] * 5})
    assert boxes._touching(table).tolist() == [True, True, False, False, False]
    assert boxes._touching(table, most=1).tolist() == [True, True, True, True, False]
    batches = [b for k in (1, 2, 3) for b in table.to_batches(max_chunksize=k)]
    keys = [t["page_key"].to_pylist() for t in boxes._whole(iter(table.to_batches(max_chunksize=1)))]
    assert keys == [[1, 1], [2, 2], [3]] and len(batches) == 10 and np.concatenate(keys).size == 5
    rows = [(p, n, "7", x, 0, x + 8, 10) for p in range(300) for n, x in enumerate((0, 9) if p % 3 == 0 else (0, 30))]
    got = boxes.joined_tokens(spark.createDataFrame(rows, "page int, box_id int, label string, x0 int, y0 int, x1 int, y1 int").repartition(1), text.CODE).collect()
    assert sorted((r.page, r.label) for r in got) == sorted((p, x) for p in range(300) for x in (["77"] if p % 3 == 0 else ["7", "7"]))


@pytest.mark.parametrize("name", ["drawing_legend", "drawing_figures", "drawing_unknown_and_others", "document_resolution"])
def test_drawings_send_no_table_through_the_driver(spark, sf_dir, name):
    """Small files are no reason to broadcast: every join of a drawing deals its rows by key, in the tables written between too."""
    assert not broadcast(spark, lambda: registry.QUERIES[name](spark, sf_dir).collect())
