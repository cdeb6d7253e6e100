"""Queries over reviews: overlays, queues, edits, evaluation, exports, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.model import TRIPLE
from factloom.operators import review
from factloom.plans.base import query
from factloom.sources import tables


@query(f"""WITH {TRIPLE}, t AS (SELECT DISTINCT * FROM triple), reviewed AS (SELECT DISTINCT doc_id AS id FROM labels), h AS (SELECT id, source, relation, target, 'human' AS origin FROM t WHERE score % 2 = 0 AND id IN (SELECT id FROM reviewed)),
m AS (SELECT id, source, relation, target, 'machine' AS origin FROM t WHERE score >= 5 AND id NOT IN (SELECT id FROM reviewed)) SELECT * FROM h UNION ALL SELECT * FROM m""")
def effective_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows of reviewed ids, selected candidates of the others."""
    t = model.triple(spark, sf_dir).distinct()
    reviewed = model.review(spark, sf_dir)
    return review.effective(t.withColumn("selected", F.col("score") >= 5), reviewed, t.withColumn("keep", F.col("score") % 2 == 0))


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL) AS known, count(*) FILTER (d.doc_id IS NULL) AS dropped FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'en') d USING (doc_id)")
def review_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of items of the collection, and how many belong to none."""
    known, dropped = tables.known_reviews(model.review(spark, sf_dir), model.doc(spark, sf_dir).where("grp <> 'en'"))
    return known.agg(F.count("*").alias("known")).crossJoin(dropped)


@query("""WITH new AS (SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || '.' END AS new_text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id AS key, length(coalesce(new_text, text)) AS chars, NOT (new_text IS NOT NULL AND new_text IS DISTINCT FROM text) AS analyzed FROM documents LEFT JOIN new ON doc_id = key""")
def text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New texts for known keys; analysis is reset only where the text differs."""
    docs = model.doc(spark, sf_dir).select(F.col("id").alias("key"), "text", F.lit(None).cast("boolean").alias("analyzed"))
    new = docs.where("key % 2 = 0").select("key", F.when(F.col("key") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("."))).alias("text"))
    merged, _ = review.merge_texts(docs, new)
    return merged.select("key", F.length("text").cast("long").alias("chars"), "analyzed")


@query("""SELECT count(*) AS n, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (text <> '' AND l.doc_id IS NULL) AS todo, count(l.doc_id) AS reviewed, count(*) FILTER (quality = 1) AS kept
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = model.review(spark, sf_dir).groupBy("id").agg(F.max("keep").alias("keep"))
    rows = model.doc(spark, sf_dir).join(marks.withColumn("reviewed", F.lit(True)), "id", "left")
    has = F.col("text") != ""
    return rows.agg(F.count("*").alias("n"), F.count_if(has).alias("with_text"), F.count_if(has & F.col("reviewed").isNull()).alias("todo"), F.count("reviewed").alias("reviewed"), F.count_if("keep").alias("kept"))


@query("SELECT doc_id AS id, source AS company, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> '' AND source IN ('src1', 'src2', 'src3') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def unreviewed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = model.doc(spark, sf_dir).where((F.col("text") != "") & F.col("company").isin("src1", "src2", "src3"))
    return queue.join(model.review(spark, sf_dir), "id", "left_anti").select("id", "company", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {TRIPLE}, q AS (SELECT id, count(*) FILTER (score BETWEEN 5 AND 7) AS review, count(*) FILTER (score >= 8) AS accept FROM triple GROUP BY id)
SELECT id, review, accept, row_number() OVER (PARTITION BY id % 50 ORDER BY review DESC, accept, id) AS place FROM q""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty reviewers' queues, each with the most open statements first."""
    q = model.triple(spark, sf_dir).groupBy("id").agg(F.count_if(F.col("score").between(5, 7)).alias("review"), F.count_if(F.col("score") >= 8).alias("accept"))
    queues = q.withColumn("reviewer", F.col("id") % 50)
    return review.places(queues, "reviewer", {"review": True, "accept": False}, "id").drop("reviewer")


@query("""WITH q AS (SELECT d.doc_id AS id, source, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
o AS (SELECT source, min(id) AS first_open FROM q WHERE NOT done GROUP BY source)
SELECT id, source, nullif(coalesce((SELECT min(p.id) FROM q p WHERE p.source = q.source AND NOT p.done AND p.id > q.id), first_open), id) AS next_open FROM q LEFT JOIN o USING (source)""")
def next_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next open item after each within its source, going round at the end."""
    done = model.review(spark, sf_dir).select("id").distinct().withColumn("done", F.lit(True))
    q = model.doc(spark, sf_dir).select("id", F.col("company").alias("source")).join(done, "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return review.next_open(q, "id", "done", "source").select("id", "source", "next_open")


@query(f"""WITH {TRIPLE}, d AS (SELECT DISTINCT id * 1000 + CAST(substr(source, 7) AS INTEGER) * 10 + ascii(relation) % 10 AS row_id, source, relation, min(target) AS target, max(score) AS score FROM triple GROUP BY id, source, relation),
r AS (SELECT row_id, source, relation, target, score, score >= 5 AS keep FROM d), e AS (SELECT row_id AS edge_no, CASE WHEN row_id % 7 = 0 THEN NULL ELSE row_id END AS row_id, source, CASE WHEN row_id % 5 = 0 THEN 'X' ELSE relation END AS relation, target FROM r WHERE keep AND row_id % 3 <> 0)
SELECT r.row_id, e.edge_no, coalesce(e.source, r.source) AS source, coalesce(e.relation, r.relation) AS relation, coalesce(e.target, r.target) AS target, e.edge_no IS NOT NULL AS keep,
CASE WHEN r.row_id IS NULL THEN 'added' WHEN e.edge_no IS NOT NULL AND (r.source, r.relation, r.target) <> (e.source, e.relation, e.target) THEN 'corrected' ELSE 'machine' END AS verdict, CASE WHEN r.row_id IS NULL THEN 10 ELSE score END AS score
FROM r FULL JOIN e ON r.row_id = e.row_id""")
def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edited graph put back onto its table: edges dropped, changed and added."""
    row_id = F.col("id") * 1000 + F.substring("source", 7, 10).cast("int") * 10 + F.ascii("relation") % 10
    d = model.triple(spark, sf_dir).groupBy("id", "source", "relation").agg(F.min("target").alias("target"), F.max("score").alias("score"))
    rows = d.select(row_id.alias("row_id"), "source", "relation", "target", "score", (F.col("score") >= 5).alias("keep"), F.lit("machine").alias("verdict"))
    kept = rows.where("keep AND row_id % 3 <> 0")
    edits = kept.select(F.col("row_id").alias("edge_no"), F.when(F.col("row_id") % 7 != 0, F.col("row_id")).alias("row_id"), "source", F.when(F.col("row_id") % 5 == 0, "X").otherwise(F.col("relation")).alias("relation"), "target")
    return review.apply_edits(rows, edits)


@query(f"""WITH {TRIPLE}, f AS (SELECT DISTINCT id, source, relation, target FROM triple WHERE score >= 5), g AS (SELECT DISTINCT id, source, relation, target FROM triple WHERE score >= 3 AND relation <> 'N'),
c AS (SELECT count(*) FILTER (f.id IS NOT NULL AND g.id IS NOT NULL) AS tp, count(*) FILTER (g.id IS NULL) AS fp, count(*) FILTER (f.id IS NULL) AS fn FROM f FULL JOIN g USING (id, source, relation, target)) SELECT tp, fp, fn, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM c""")
def prf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = model.triple(spark, sf_dir)
    found, gold = t.where("score >= 5"), t.where("score >= 3 AND relation <> 'N'")
    return review.f_score(review.evaluate(found, gold, ["id", "source", "relation", "target"], model.parts(spark, sf_dir, "lineitem")))


@query("SELECT d.doc_id AS id, source AS company, lang AS field, CAST(length(text) AS BIGINT) AS chars, CAST(k AS BIGINT) AS kept FROM documents d JOIN (SELECT doc_id, sum(quality) AS k FROM labels GROUP BY doc_id) l USING (doc_id) WHERE text <> ''")
def gold_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed items that have a text, with the number of kept rows."""
    marks = model.review(spark, sf_dir).groupBy("id").agg(F.count_if("keep").alias("kept"))
    return model.doc(spark, sf_dir).where("text <> ''").join(marks, "id").select("id", "company", F.col("grp").alias("field"), F.length("text").cast("long").alias("chars"), "kept")


@query("SELECT count(*) AS reviews, CAST(sum(quality) AS BIGINT) AS kept, count(DISTINCT doc_id) AS items FROM labels")
def kept_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.review(spark, sf_dir).agg(F.count("*").alias("reviews"), F.count_if("keep").alias("kept"), F.countDistinct("id").alias("items"))


_RULES = f"""WITH {TRIPLE}, f AS (SELECT id, source, relation, target, CASE WHEN score >= 8 THEN ['R' || score % 4, relation] ELSE ['R' || score % 4] END AS rules FROM triple WHERE score >= 4), g AS (SELECT DISTINCT id, source, relation, target FROM triple WHERE score >= 6 AND relation <> 'N'),
names AS (SELECT DISTINCT unnest(rules) AS rule FROM f), runs AS (SELECT rule, id, source, relation, target FROM names CROSS JOIN (SELECT id, source, relation, target, rules FROM f) WHERE NOT list_contains(rules, rule) GROUP BY ALL),
base AS (SELECT count(*) FILTER (g.id IS NOT NULL) AS tp, count(*) FILTER (g.id IS NULL) AS fp FROM (SELECT DISTINCT id, source, relation, target FROM f) x LEFT JOIN g USING (id, source, relation, target)), n AS (SELECT rule, count(*) AS n FROM f, unnest(rules) u(rule) GROUP BY rule)"""


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statements with the rules that made them, and the gold ones."""
    t = model.triple(spark, sf_dir)
    own = F.concat(F.lit("R"), (F.col("score") % 4).cast("string"))
    found = t.where("score >= 4").select("id", "source", "relation", "target", F.when(F.col("score") >= 8, F.array(own, "relation")).otherwise(F.array(own)).alias("rules"))
    return found, t.where("score >= 6 AND relation <> 'N'")


@query(_RULES + """, w AS (SELECT rule, count(*) FILTER (g.id IS NOT NULL) AS tp, count(*) FILTER (g.id IS NULL) AS fp FROM runs r LEFT JOIN g USING (id, source, relation, target) GROUP BY rule), k AS (SELECT count(*) AS gold FROM g)
SELECT rule, n, tp, fp, 2.0::DOUBLE * tp / (tp + fp + gold) AS f1_without, (SELECT 2.0::DOUBLE * tp / (tp + fp + gold) FROM base, k) - 2.0::DOUBLE * tp / (tp + fp + gold) AS f1_delta FROM w JOIN n USING (rule) CROSS JOIN k""")
def rule_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far F1 falls without each rule; the SQL runs the evaluation once for every rule."""
    return review.rule_effects(*_ruled(spark, sf_dir), ["id", "source", "relation", "target"], model.parts(spark, sf_dir, "lineitem"))


@query(_RULES + " SELECT id, source, relation, target, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM f, unnest(rules) u(rule) WHERE (id, source, relation, target) NOT IN (SELECT id, source, relation, target FROM f WHERE NOT list_contains(rules, 'R0') AND NOT list_contains(rules, 'A')) GROUP BY id, source, relation, target")
def rule_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that two rules switched off take away."""
    gone = review.dropped_by(_ruled(spark, sf_dir)[0], ["R0", "A"], ["id", "source", "relation", "target"])
    return gone.withColumn("rules", F.array_join("rules", ","))


@query(f"""WITH {TRIPLE}, f AS (SELECT DISTINCT id, source || CASE WHEN score % 2 = 0 THEN '1' ELSE '22' END AS source, target FROM triple WHERE score >= 5), g AS (SELECT DISTINCT id, source || '3' AS source, target FROM triple WHERE score >= 4 AND relation <> 'N'),
fn AS (SELECT id, node, base, row_number() OVER (PARTITION BY id, base ORDER BY node) AS k FROM (SELECT DISTINCT id, node, regexp_replace(node, '[0-9]+$', '') AS base FROM (SELECT id, source AS node FROM f UNION SELECT id, target FROM f))),
gn AS (SELECT id, node, base, row_number() OVER (PARTITION BY id, base ORDER BY node) AS k FROM (SELECT DISTINCT id, node, regexp_replace(node, '[0-9]+$', '') AS base FROM (SELECT id, source AS node FROM g UNION SELECT id, target FROM g))),
m AS (SELECT fn.id, fn.node, gn.node AS of FROM fn JOIN gn USING (id, base, k)), t AS (SELECT count(*) AS tp FROM f JOIN m a ON f.id = a.id AND f.source = a.node JOIN m b ON f.id = b.id AND f.target = b.node JOIN g ON g.id = f.id AND g.source = a.of AND g.target = b.of)
SELECT tp, (SELECT count(*) FROM f) - tp AS fp, (SELECT count(*) FROM g) - tp AS fn, 2.0::DOUBLE * tp / ((SELECT count(*) FROM f) + (SELECT count(*) FROM g)) AS f1 FROM t""")
def structure_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of edges without their relations, nodes matched one to one by their base."""
    t = model.triple(spark, sf_dir)
    found = t.where("score >= 5").select("id", F.concat("source", F.when(F.col("score") % 2 == 0, "1").otherwise("22")).alias("source"), "target")
    gold = t.where("score >= 4 AND relation <> 'N'").select("id", F.concat("source", F.lit("3")).alias("source"), "target")
    return review.f_score(review.structure_evaluation(found, gold))


@query("""WITH new AS (SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || '.' END AS new_text FROM documents WHERE doc_id % 2 = 0), m AS (SELECT doc_id, new_text IS NOT NULL AND new_text IS DISTINCT FROM text AS changed FROM documents LEFT JOIN new ON doc_id = key)
SELECT doc_id AS id, CASE WHEN changed THEN 0 ELSE doc_id % 7 END AS n_rejected, NOT changed AND doc_id IN (SELECT doc_id FROM labels) AS reviewed, CASE WHEN changed THEN 'claim' ELSE 'abstract' END AS text_source FROM m""")
def text_merge_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new texts reset: rejected counts, reviews and the text's source, where the text differs."""
    docs = model.doc(spark, sf_dir).select(F.col("id").alias("key"), "text", F.lit(None).cast("boolean").alias("analyzed"), (F.col("id") % 7).alias("n_rejected"), F.lit("abstract").alias("text_source"))
    new = docs.where("key % 2 = 0").select("key", F.when(F.col("key") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("."))).alias("text"), F.lit("claim").alias("text_source"))
    merged, changed = review.merge_texts(docs, new)
    left = review.without(model.review(spark, sf_dir), changed).select(F.col("id").alias("key"), F.lit(True).alias("reviewed")).distinct()
    return merged.join(left, "key", "left").select(F.col("key").alias("id"), "n_rejected", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), "text_source")


@query("SELECT doc_id AS id, source, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS following FROM documents WHERE doc_id % 3 <> 0 AND text <> '' AND source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND (doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id = 1) WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def queue_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items before and after each open one in its company's queue; items that are not analysed yet are left out."""
    docs = model.doc(spark, sf_dir).withColumn("analyzed", F.when(F.col("id") % 3 == 0, False))
    q = review.queue_of(docs, model.review(spark, sf_dir), companies=["src1", "src2", "src3", "src4", "src5"], current=1)
    return review.beside(q.select("id", F.col("company").alias("source")), "id", "source").select("id", "source", "previous", "following")
