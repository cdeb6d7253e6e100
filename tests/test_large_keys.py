"""Queries on tables whose keys have more digits than those of the small ones: numbers made of them are shared."""

import os

import duckdb
import pytest

from factloom.functions import text
from factloom.operators import resolve
from factloom.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def long_keys(sf_dir, tmp_path_factory):
    """The smallest tables, orders and their lines three times: keys up to 149, from 100,000 and from 1,000,000."""
    there = str(tmp_path_factory.mktemp("long_keys"))
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        duckdb.sql(f"COPY (SELECT * REPLACE ({key} + shift AS {key}) FROM '{sf_dir}/{t}.parquet', (VALUES (0), (100000), (1000000)) v(shift) WHERE {key} < 150 OR shift = 1000000) TO '{there}/{t}.parquet'")
    for t in oracle.TABLES:
        if not os.path.exists(f"{there}/{t}.parquet"):
            os.symlink(f"{sf_dir}/{t}.parquet", f"{there}/{t}.parquet")
    return there


@pytest.mark.parametrize("name", ["document_resolution", "drawing_legend", "drawing_figures", "drawing_unknown_and_others"])
def test_orders_that_share_a_number(spark, long_keys, name):
    oracle.same(registry.QUERIES[name](spark, long_keys), oracle.connect(long_keys), registry.ORACLE_SQL[name])


def test_only_suffixes_that_can_match_are_made(spark):
    """Long names are no reason for many rows: a sign meets its drawing's components by their lengths."""
    signs = spark.createDataFrame([(1, "1", "x" * 300 + "管"), (1, "2", "弁"), (2, "3", "y" * 300 + "管")], "id int, code string, name string")
    comps = spark.createDataFrame([(1, "x管"), (1, "弁")], "id int, comp string")
    links = resolve.link_names(comps, signs, ("id",))
    assert sorted((r.id, r.comp, r.code, r.score) for r in links.collect()) == [(1, "x管", "1", 2), (1, "弁", "2", 3)]
    assert "_suffixes" not in dir(resolve)


def test_the_key_of_a_number_is_worked_out_once(spark):
    plan = spark.range(1).select(text.doc_candidates(text.F.concat(text.F.lit("特開2000-"), text.F.col("id").cast("string"))).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("公報") == 1
