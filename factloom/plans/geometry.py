"""Queries over labelled boxes, which lineitem's whole numbers stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import text
from factloom.operators import boxes
from factloom.plans.base import query

_BOXES = """WITH b AS (SELECT DISTINCT l_orderkey AS page, l_partkey * 8 + l_linenumber AS box_id, 'a' || (l_partkey % 7) || CASE WHEN l_partkey % 3 = 0 THEN 'b' ELSE '' END AS label,
CAST(l_partkey * 37 % 120 AS INTEGER) AS x0, CAST((l_partkey * 91 + l_linenumber * 13) % 90 AS INTEGER) AS y0, CAST(l_partkey * 37 % 120 + 5 + l_partkey % 60 AS INTEGER) AS x1, CAST((l_partkey * 91 + l_linenumber * 13) % 90 + 5 + l_linenumber * 7 % 40 AS INTEGER) AS y1 FROM lineitem)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    x0, y0 = k * 37 % 120, (k * 91 + n * 13) % 90
    label = F.concat(F.lit("a"), (k % 7).cast("string"), F.when(k % 3 == 0, "b").otherwise(""))
    box = [v.cast("int").alias(c) for c, v in zip(boxes.BOX, (x0, y0, x0 + 5 + k % 60, y0 + 5 + n * 7 % 40), strict=True)]
    rows = model.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (k * 8 + n).alias("box_id"), label.alias("label"), *box)
    return rows.repartition(model.parts(spark, sf_dir, "lineitem"), "page").distinct()


_NEAR = "a.x1 >= b.x0 - 5 AND b.x1 >= a.x0 - 5 AND a.y1 >= b.y0 - 5 AND b.y1 >= a.y0 - 5"


_PAIRS = ", p AS MATERIALIZED (SELECT l.page, l.label, r.label AS other, l.box_id AS a, r.box_id AS b, l.x0 AS lx0, l.y0 AS ly0, l.x1 AS lx1, l.y1 AS ly1, r.x0, r.y0, r.x1, r.y1 FROM b AS l JOIN b AS r ON l.page = r.page)"


@query(_BOXES + _PAIRS + " SELECT page, a, b FROM p WHERE a < b AND lx1 >= x0 - 5 AND x1 >= lx0 - 5 AND ly1 >= y0 - 5 AND y1 >= ly0 - 5")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return boxes.overlapping(rows, rows).where("box_id_a < box_id_b").select("page", F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"))


@query(_BOXES + " SELECT DISTINCT a.page, a.box_id FROM b a JOIN b ON a.page = b.page AND length(b.label) > length(a.label) AND a.x0 >= b.x0 - 3 AND a.x1 <= b.x1 + 3 AND a.y0 >= b.y0 - 3 AND a.y1 <= b.y1 + 3")
def box_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.contained(labelled(spark, sf_dir))


@query(_BOXES + _PAIRS + " SELECT page, label, a, b FROM p WHERE label = other AND a < b AND abs(lx0 - x0) < 30 AND abs(ly0 - y0) < 30")
def box_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.corner_pairs(labelled(spark, sf_dir))


@query(_BOXES + f""", c AS (SELECT page, box_id, CASE WHEN length(label) > 2 THEN substr(label, 1, 2) ELSE label END AS label, x0, y0, x1, y1 FROM b WHERE box_id % 2 = 0), t AS (SELECT * FROM b WHERE box_id % 2 = 1),
p AS (SELECT a.page, a.box_id, b.box_id AS token, b.label AS new_label, b.x0 AS nx0, b.y0 AS ny0, b.x1 AS nx1, b.y1 AS ny1, length(b.label) > length(a.label) AND contains(b.label, a.label) AS longer, a.label = b.label AND (b.x1 - b.x0) * (b.y1 - b.y0) < (a.x1 - a.x0) * (a.y1 - a.y0) AS same, (b.x1 - b.x0) * (b.y1 - b.y0) AS area
FROM c a JOIN t b ON a.page = b.page AND {_NEAR}), best AS (SELECT * FROM p WHERE longer OR same QUALIFY row_number() OVER (PARTITION BY page, box_id ORDER BY CASE WHEN longer THEN length(new_label) ELSE 0 END DESC, area, token) = 1)
SELECT c.page, c.box_id, coalesce(new_label, label) AS label, coalesce(nx0, x0) AS x0, coalesce(ny0, y0) AS y0, coalesce(nx1, x1) AS x1, coalesce(ny1, y1) AS y1, CASE WHEN new_label IS NULL THEN 'callout' ELSE 'token' END AS origin FROM c LEFT JOIN best USING (page, box_id)
UNION ALL SELECT page, box_id, label, x0, y0, x1, y1, 'token' FROM t WHERE (page, box_id) NOT IN (SELECT page, token FROM p)""")
def reconcile_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callouts (even ids, codes cut short) against tokens (odd ids)."""
    rows = labelled(spark, sf_dir)
    callouts = rows.where("box_id % 2 = 0").withColumn("label", F.when(F.length("label") > 2, F.substring("label", 1, 2)).otherwise(F.col("label")))
    return boxes.reconciled(callouts, rows.where("box_id % 2 = 1"))


@query(_BOXES + " SELECT page, box_id, label, 200 - y1 AS x0, x0 AS y0, 200 - y0 AS x1, x1 AS y1, 90 AS angle FROM b UNION ALL SELECT page, box_id, label, y0, 200 - x1, y1, 200 - x0, 270 FROM b")
def rotate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, side = labelled(spark, sf_dir), F.lit(200)
    return boxes.rotated(rows, 90, side, side).withColumn("angle", F.lit(90)).unionByName(boxes.rotated(rows, 270, side, side).withColumn("angle", F.lit(270)))


@query(_BOXES + """, e AS (SELECT page, box_id AS segment_id, x0 AS nx, y0 AS ny, x1 AS fx, y1 AS fy FROM b WHERE box_id % 2 = 1 UNION ALL SELECT page, box_id, x1, y1, x0, y0 FROM b WHERE box_id % 2 = 1),
p AS MATERIALIZED (SELECT l.page, l.box_id, e.segment_id, e.nx, e.ny, e.fx, e.fy, sqrt(CAST(greatest(l.x0 - nx, 0, nx - l.x1) ** 2 + greatest(l.y0 - ny, 0, ny - l.y1) ** 2 AS DOUBLE)) AS distance, fx BETWEEN l.x0 - 5 AND l.x1 + 5 AND fy BETWEEN l.y0 - 5 AND l.y1 + 5 AS inside FROM b AS l JOIN e ON l.page = e.page WHERE l.box_id % 2 = 0),
n AS (SELECT *, min(distance) OVER (PARTITION BY page, box_id) AS least FROM p WHERE distance <= 45 AND NOT inside)
SELECT page, box_id, segment_id FROM n WHERE distance <= least + 12 QUALIFY row_number() OVER (PARTITION BY page, box_id ORDER BY (fx - nx) ** 2 + (fy - ny) ** 2 DESC, segment_id) = 1""")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    segments = rows.where("box_id % 2 = 1").select("page", F.col("box_id").alias("segment_id"), *(F.col(c).alias(f"s{c}") for c in boxes.BOX))
    return boxes.nearest_segment(rows.where("box_id % 2 = 0"), segments)


@query(_BOXES + """, t AS (SELECT page, box_id, label || '(' || substr(label, 2) || ')' AS label, label AS p1, substr(label, 2) AS p2, x0, y0, x1, y1 FROM b), n AS (SELECT *, length(label) AS n FROM t)
SELECT page, box_id, y0, y1, p1 AS label, x0, CAST(trunc(x0 + (x1 - x0) / n * length(p1)) AS INTEGER) AS x1 FROM n
UNION ALL SELECT page, box_id, y0, y1, p2, CAST(trunc(x0 + (x1 - x0) / n * (length(p1) + 1)) AS INTEGER), CAST(trunc(x0 + (x1 - x0) / n * (length(p1) + 1 + length(p2))) AS INTEGER) FROM n""")
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two codes, one in brackets, as two boxes."""
    rows = labelled(spark, sf_dir)
    return boxes.split_tokens(rows.withColumn("label", F.concat("label", F.lit("("), F.substring("label", 2, 10), F.lit(")"))))


@query(_BOXES + " SELECT n.page, n.box_id FROM b n WHERE n.box_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.box_id % 2 = 0 AND o.page = n.page AND abs((o.x0 + o.x1) / 2.0 - (n.x0 + n.x1) / 2.0) < 25 AND abs((o.y0 + o.y1) / 2.0 - (n.y0 + n.y1) / 2.0) < 25)")
def box_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes read a second time whose centres are not near one read before."""
    rows = labelled(spark, sf_dir)
    return boxes.away_from(rows.where("box_id % 2 = 1"), rows.where("box_id % 2 = 0")).select("page", "box_id")


@query(_BOXES + """, t AS (SELECT page, box_id, x0 * 9 AS x0, x0 * 9 + 8 AS x1, row_number() OVER (PARTITION BY page ORDER BY x0) AS k FROM (SELECT page, min(box_id) AS box_id, x0 FROM b GROUP BY page, x0)), g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w BETWEEN -2 AND 4 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY page ORDER BY k)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY k) AS run FROM g), p AS (SELECT *, (row_number() OVER (PARTITION BY page, run ORDER BY k) - 1) // 4 AS part FROM r)
SELECT page, min(x0) AS x0, max(x1) AS x1, repeat('7', count(*)) AS label FROM p GROUP BY page, run, part""")
def token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits in one row, joined while they touch and make a code, which has four digits at most."""
    rows = labelled(spark, sf_dir).groupBy("page", "x0").agg(F.min("box_id").alias("box_id"))
    tokens = rows.select("page", "box_id", F.lit("7").alias("label"), (F.col("x0") * 9).alias("x0"), F.lit(0).alias("y0"), (F.col("x0") * 9 + 8).alias("x1"), F.lit(10).alias("y1"))
    return boxes.joined_tokens(tokens, text.CODE).select("page", "x0", "x1", "label")
