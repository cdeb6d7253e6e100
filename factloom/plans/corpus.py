"""Queries over entities and their codes: trends, rankings, matrices, shares, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.model import ENTITY, code_sql
from factloom.operators import network, stats
from factloom.plans.base import query


@query(f"""
WITH {ENTITY}, {code_sql(1)}, sizes AS (SELECT id, count(*) AS size FROM entity_code GROUP BY id),
flat AS (SELECT e.id, year, code, grp, coalesce(size, 0) AS size FROM entity e JOIN (SELECT DISTINCT * FROM entity_code) USING (id) LEFT JOIN sizes USING (id) WHERE year IS NOT NULL),
best AS (SELECT code FROM flat GROUP BY code ORDER BY count(*) DESC, code LIMIT 8)
SELECT year, code, grp, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM flat WHERE code IN (SELECT code FROM best) GROUP BY year, code, grp""")
def bubble_year_code_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = model.entity_code(spark, sf_dir, 1)
    sizes = codes.groupBy("id").agg(F.count("*").alias("size"))
    flat = model.entity(spark, sf_dir).where(F.col("year").isNotNull()).join(codes.distinct(), "id").join(sizes, "id", "left")
    best = stats.top(flat.groupBy("code").agg(F.count("*").alias("n")), "n", 8, ties="code")
    return flat.join(F.broadcast(best), "code", "left_semi").groupBy("year", "code", "grp").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("total_size"))


@query(f"""
WITH {ENTITY}, {code_sql(0)}, sizes AS (SELECT id, count(*) AS size FROM entity_code GROUP BY id),
flat AS (SELECT e.id, year, code, grp, coalesce(size, 0) AS size FROM entity e JOIN (SELECT DISTINCT * FROM entity_code) USING (id) LEFT JOIN sizes USING (id) WHERE year IS NOT NULL),
best AS (SELECT code FROM flat GROUP BY code ORDER BY count(*) DESC, code LIMIT 3)
SELECT year, code, grp, count(*) AS n, CAST(round_even(avg(size), 1) AS DOUBLE) AS mean_size FROM flat WHERE code IN (SELECT code FROM best) GROUP BY year, code, grp""")
def bubble_mean_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = model.entity_code(spark, sf_dir, 0)
    return stats.bubble(model.entity(spark, sf_dir), codes, codes.groupBy("id").agg(F.count("*").alias("size")), 3)


@query(f"WITH {ENTITY} SELECT year, company, count(*) AS n FROM entity GROUP BY year, company")
def year_group_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.entity(spark, sf_dir).groupBy("year", "company").agg(F.count("*").alias("n"))


@query(f"WITH {code_sql(1)}, heads AS (SELECT id, min(code) AS code FROM entity_code GROUP BY id) SELECT code, count(*) AS n FROM heads GROUP BY code ORDER BY n DESC, code LIMIT 15")
def first_code_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = model.entity_code(spark, sf_dir, 1).groupBy("id").agg(F.min("code").alias("code"))
    return stats.rank_values(heads, "code", 15)


@query(f"WITH {ENTITY} SELECT grp AS company, count(*) AS n FROM entity GROUP BY grp ORDER BY n DESC, grp LIMIT 10")
def company_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_values(model.entity(spark, sf_dir).select(F.col("grp").alias("company")), "company", 10)


@query(f"WITH {code_sql(2)} SELECT code, count(*) AS n FROM entity_code GROUP BY code")
def code_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes over the raw list: one that an entity repeats counts each time."""
    return stats.rank_values(model.entity_code(spark, sf_dir, 2), "code")


_MATRIX = f"""
WITH {ENTITY}, {code_sql(1)}, cells AS (SELECT DISTINCT id, grp, code FROM entity JOIN entity_code USING (id)),
r AS (SELECT grp FROM cells GROUP BY grp ORDER BY count(DISTINCT id) DESC, grp LIMIT 10), c AS (SELECT code FROM cells GROUP BY code ORDER BY count(DISTINCT id) DESC, code LIMIT 12),
counted AS (SELECT grp, code, count(*) AS n FROM cells GROUP BY grp, code), grid AS (SELECT grp, code, coalesce(n, 0) AS n FROM r CROSS JOIN c LEFT JOIN counted USING (grp, code))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = model.entity_code(spark, sf_dir, 1).repartition(model.parts(spark, sf_dir, "lineitem"), "id")
    return model.entity(spark, sf_dir).join(codes, "id")


@query(_MATRIX + " SELECT grp, code, n FROM grid")
def company_code_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.matrix(_cells(spark, sf_dir), "grp", "code", 10, 12)


@query(_MATRIX + " SELECT grp, code, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY grp) AS share FROM grid")
def company_code_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    grid = stats.matrix(_cells(spark, sf_dir), "grp", "code", 10, 12)
    return grid.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy("grp"))))


_FLAT = f"WITH {ENTITY}, {code_sql(0)}, flat AS (SELECT DISTINCT id, company, code FROM entity JOIN entity_code USING (id))"


@query(_FLAT + ", s AS (SELECT company, count(DISTINCT id) AS size FROM flat GROUP BY company) SELECT company, code, count(*) AS n, any_value(size) AS size, CAST(count(*) AS DOUBLE) / any_value(size) AS share FROM flat JOIN s USING (company) GROUP BY company, code")
def radar_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.entity(spark, sf_dir).join(model.entity_code(spark, sf_dir, 0), "id")
    return stats.shares(rows, "company", "code")


@query(_FLAT + """, s AS (SELECT company, count(DISTINCT id) AS size FROM flat GROUP BY company), o AS (SELECT code, count(DISTINCT id) AS all_n FROM flat GROUP BY code), t AS (SELECT count(DISTINCT id) AS all_ids FROM flat)
SELECT company, code, count(*) AS n, any_value(size) AS size, any_value(all_n) AS all_n, any_value(all_ids) AS all_ids, (CAST(count(*) AS DOUBLE) / any_value(size)) / (CAST(any_value(all_n) AS DOUBLE) / any_value(all_ids)) AS coefficient
FROM flat JOIN s USING (company) JOIN o USING (code) CROSS JOIN t GROUP BY company, code""")
def radar_specialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.entity(spark, sf_dir).join(model.entity_code(spark, sf_dir, 0), "id")
    return stats.specialisation(rows, "company", "code")


_WORDS = "words AS (SELECT DISTINCT doc_id AS id, lang, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS term FROM documents)"


@query(f"""WITH {_WORDS}, titles AS (SELECT doc_id AS id, lower(regexp_extract(text, '\\p{{L}}{{4,}}')) AS term FROM documents), kept AS (SELECT w.* FROM words w ANTI JOIN titles t ON w.id = t.id AND w.term = t.term),
here AS (SELECT term, count(DISTINCT id) AS n_selected FROM kept WHERE lang = 'fr' GROUP BY term HAVING count(DISTINCT id) >= 2), there AS (SELECT term, count(DISTINCT id) AS n_all FROM kept GROUP BY term)
SELECT term, n_selected, n_all FROM here JOIN there USING (term) ORDER BY n_selected DESC, term LIMIT 50""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of one group's texts against all; a term that opens its text is left out for that text."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))
    opening = F.array(F.lower(F.regexp_extract("text", r"\p{L}{4,}", 0)))
    kept = model.doc(spark, sf_dir).select("id", "grp", F.explode(F.array_except(words, opening)).alias("term"))  # distinct in a text
    return stats.terms(kept, F.col("grp") == "fr", 2, 50).select("term", "n_selected", "n_all")


@query(f"WITH {ENTITY}, {code_sql(0)} SELECT DISTINCT id, company, year FROM entity SEMI JOIN (SELECT * FROM entity_code WHERE code = 'PROMO') c USING (id) WHERE company IN ('BUILDING', 'MACHINERY') AND year BETWEEN 1996 AND 1998")
def filter_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = model.entity_code(spark, sf_dir, 0).where("code = 'PROMO'")
    chosen = model.entity(spark, sf_dir).where(F.col("company").isin("BUILDING", "MACHINERY") & F.col("year").between(1996, 1998))
    return chosen.join(code, "id", "left_semi").select("id", "company", "year").distinct()


@query(f"WITH {ENTITY} SELECT company, count(*) AS n FROM entity GROUP BY company UNION ALL SELECT company || '*' AS company, count(*) AS n FROM entity WHERE company IN ('BUILDING') GROUP BY company")
def company_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty selection is no filter."""

    def chosen(names: list[str]) -> DataFrame:
        rows = model.entity(spark, sf_dir)
        return rows.where(F.col("company").isin(names)) if names else rows

    every = chosen([]).groupBy("company").agg(F.count("*").alias("n"))
    some = chosen(["BUILDING"]).groupBy(F.concat("company", F.lit("*")).alias("company")).agg(F.count("*").alias("n"))
    return every.unionByName(some)


@query(f"WITH {ENTITY}, best AS (SELECT grp FROM entity GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 5) SELECT CASE WHEN grp IN (SELECT grp FROM best) THEN grp ELSE 'other' END AS bucket, count(*) AS n FROM entity GROUP BY 1")
def top_groups_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_groups(model.entity(spark, sf_dir), "grp", 5).groupBy("bucket").agg(F.count("*").alias("n"))


@query("SELECT lang AS grp, count(*) AS n FROM (SELECT lang FROM documents ORDER BY doc_id LIMIT 200) GROUP BY lang UNION ALL SELECT g, 0 FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(g) WHERE g NOT IN (SELECT lang FROM (SELECT lang FROM documents ORDER BY doc_id LIMIT 200))")
def source_breakdown_fixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows (a report of the loading page) by a fixed list of kinds."""
    counts = model.doc(spark, sf_dir).orderBy("id").limit(200).groupBy("grp").agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(g,) for g in ("de", "en", "es", "fr", "it")], "grp string")
    return fixed.join(counts, "grp", "left").select("grp", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {code_sql(1)}, linked AS (SELECT id, count(DISTINCT code) AS codes FROM entity_code GROUP BY id) SELECT count(*) AS entities, count(*) FILTER (codes > 0) AS linked, count(*) FILTER (codes >= 3) AS many FROM orders LEFT JOIN linked ON o_orderkey = id")
def linked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = model.entity_code(spark, sf_dir, 1).groupBy("id").agg(F.countDistinct("code").alias("codes"))
    rows = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(codes, "id", "left")
    return rows.agg(F.count("*").alias("entities"), F.count_if(F.col("codes") > 0).alias("linked"), F.count_if(F.col("codes") >= 3).alias("many"))


@query("SELECT p_brand AS brand, CAST(median(p_size) AS DOUBLE) AS median_size FROM part WHERE p_size BETWEEN 5 AND 45 GROUP BY p_brand")
def median_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "part").where(F.col("p_size").between(5, 45)).groupBy(F.col("p_brand").alias("brand")).agg(F.median("p_size").alias("median_size"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS types FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def first_seen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of first appearance; counted down to one row a value before any list is built."""
    firsts = model.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    ordered = F.array_sort(F.collect_list(F.struct("first_id", "event_type")))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("types"))


@query(f"""WITH {code_sql(0)}, sets AS (SELECT id, list(DISTINCT code) AS codes FROM entity_code GROUP BY id), r AS (SELECT ['PROMO', 'STANDARD'] AS ref)
SELECT id, CAST(len(codes) AS BIGINT) AS size, CAST(len(list_intersect(codes, ref)) AS BIGINT) AS hits, 10 * len(list_intersect(codes, ref)) >= 3 * len(codes) AS compatible FROM sets CROSS JOIN r""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = model.entity_code(spark, sf_dir, 0).groupBy("id").agg(F.collect_set("code").alias("codes"))
    hits = F.size(F.array_intersect("codes", F.array(F.lit("PROMO"), F.lit("STANDARD"))))
    return sets.select("id", F.size("codes").cast("long").alias("size"), hits.cast("long").alias("hits"), (hits * 10 >= F.size("codes") * 3).alias("compatible"))


@query(f"""WITH {code_sql(0)}, hits AS (SELECT o_orderkey AS id, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT id, count(*) AS n FROM entity_code WHERE code = 'NO SUCH' GROUP BY id) h ON o_orderkey = h.id)
SELECT count(*) AS kept FROM hits WHERE n > 0 OR (SELECT max(n) FROM hits) = 0""")
def nonempty_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with hits, or all where none has any."""
    codes = model.entity_code(spark, sf_dir, 0).where("code = 'NO SUCH'").groupBy("id").agg(F.count("*").alias("n"))
    rows = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(codes, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    most = rows.agg(F.max("n").alias("most"))
    return rows.crossJoin(F.broadcast(most)).where("n > 0 OR most = 0").agg(F.count("*").alias("kept"))


@query(f"WITH {code_sql(1)} SELECT id, a, b FROM (SELECT x.id, x.code AS a, y.code AS b FROM (SELECT DISTINCT * FROM entity_code) x JOIN (SELECT DISTINCT * FROM entity_code) y ON x.id = y.id AND x.code < y.code)")
def code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = model.entity_code(spark, sf_dir, 1).groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return sets.select("id", F.posexplode("codes").alias("i", "a"), "codes").select("id", "a", F.explode(F.expr("slice(codes, i + 2, size(codes))")).alias("b"))


@query(f"""WITH RECURSIVE {ENTITY}, links AS (SELECT DISTINCT c_mktsegment AS source, 'N' || (c_nationkey % 5) AS target FROM customer UNION SELECT DISTINCT 'N' || (n_nationkey % 5), 'R' || (n_nationkey % 3) FROM nation UNION SELECT 'R0', 'N1'),
walk AS (SELECT 'BUILDING' AS node, 0 AS depth UNION SELECT target, depth + 1 FROM walk JOIN links ON node = source WHERE depth < 8),
d AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT source, target FROM links JOIN d a ON source = a.node JOIN d b ON target = b.node WHERE b.depth <> a.depth + 1""")
def tree_depth_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that leave the levels of the tree below one root."""
    customer, nation = model.table(spark, sf_dir, "customer"), model.table(spark, sf_dir, "nation")
    at = lambda letter, c, k: F.concat(F.lit(letter), (F.col(c) % k).cast("string"))
    links = customer.select(F.col("c_mktsegment").alias("source"), at("N", "c_nationkey", 5).alias("target"))
    links = links.union(nation.select(at("N", "n_nationkey", 5), at("R", "n_nationkey", 3))).union(spark.createDataFrame([("R0", "N1")], "source string, target string")).distinct()
    depth = network.depths(links, spark.createDataFrame([("BUILDING",)], "node string"))
    return network.crossing(links, depth)


@query(f"WITH {ENTITY}, k AS (SELECT count(DISTINCT company) AS k FROM entity), g AS (SELECT company, row_number() OVER (ORDER BY company) - 1 AS i FROM (SELECT DISTINCT company FROM entity)) SELECT year, company, count(*) AS n, year + (any_value(i) - (any_value(k) - 1) / 2.0::DOUBLE) * 0.8::DOUBLE / any_value(k) AS place FROM entity JOIN g USING (company) CROSS JOIN k GROUP BY year, company")
def dodged_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year and group with the group's place beside the year, so that marks do not hide each other."""
    rows = model.entity(spark, sf_dir)
    places = rows.agg(F.array_sort(F.collect_set("company")).alias("groups"))  # the few groups chosen for a chart
    counts = rows.groupBy("year", "company").agg(F.count("*").alias("n")).crossJoin(F.broadcast(places))
    k, i = F.size("groups"), F.array_position("groups", F.col("company")) - 1
    return counts.select("year", "company", "n", (F.col("year") + (i - (k - 1) / F.lit(2.0)) * F.lit(0.8) / k).alias("place"))


@query(_FLAT + """, s AS (SELECT company, count(DISTINCT id) AS size FROM flat GROUP BY company), o AS (SELECT code, count(DISTINCT id) AS all_n FROM flat GROUP BY code), t AS (SELECT count(DISTINCT id) AS all_ids FROM flat)
SELECT company, code, least(((CAST(count(*) AS DOUBLE) / any_value(size)) / (CAST(any_value(all_n) AS DOUBLE) / any_value(all_ids))) / 3, 1) AS heat FROM flat JOIN s USING (company) JOIN o USING (code) CROSS JOIN t GROUP BY company, code""")
def specialisation_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour scale of the coefficient: a third at the mean, full from three times the mean."""
    rows = model.entity(spark, sf_dir).join(model.entity_code(spark, sf_dir, 0), "id")
    return stats.specialisation(rows, "company", "code").select("company", "code", F.least(F.col("coefficient") / 3, F.lit(1.0)).alias("heat"))


@query(f"WITH {ENTITY} SELECT id, CAST(id AS VARCHAR) || '｜' || coalesce(nullif(trim(title), ''), 'no title') || '｜' || coalesce(nullif(trim(company), ''), 'unknown') AS label FROM entity")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.functions import text

    rows = model.entity(spark, sf_dir)
    return rows.select("id", text.item_label(F.col("id").cast("string"), F.col("title"), F.col("company")).alias("label"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windows that streaming.progress keeps."""
    windows = model.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n")


@query("""SELECT event_type, CAST(sum(CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of JSON text; text that is no JSON counts as none."""
    value = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    return model.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("total"), F.count("*").alias("n"))
