"""Queries over statements: networks, co-occurrence, degrees, bands, duplicates, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.model import ENTITY, TRIPLE, code_sql
from factloom.operators import canonical, network, review, similarity, stats
from factloom.plans.base import query
from factloom.session import stored

_EDGES = f"WITH {TRIPLE}, edges AS (SELECT source, relation, target, count(DISTINCT id) AS count FROM triple GROUP BY source, relation, target)"


@query(_EDGES + " SELECT * FROM edges WHERE count >= 5")
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.edges(model.triple(spark, sf_dir), 5)


@query(f"WITH {TRIPLE}, ends AS (SELECT id, source AS node FROM triple UNION ALL SELECT id, target FROM triple), n AS (SELECT node, count(DISTINCT id) AS count FROM ends GROUP BY node), e AS (SELECT source, target FROM triple WHERE relation = 'R' GROUP BY source, relation, target HAVING count(DISTINCT id) >= 25) SELECT node, count FROM n WHERE node IN (SELECT source FROM e UNION SELECT target FROM e) OR NOT EXISTS (SELECT 1 FROM e)")
def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = model.triple(spark, sf_dir)
    return network.touched(network.nodes(triples), network.edges(triples.where("relation = 'R'"), 25))


@query(f"WITH {code_sql(1)}, c AS (SELECT DISTINCT * FROM entity_code) SELECT x.code AS a, y.code AS b, count(*) AS count FROM c x JOIN c y ON x.id = y.id AND x.code < y.code GROUP BY 1, 2")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.cooccurrence(model.entity_code(spark, sf_dir, 1))


@query(_EDGES + ", ends AS (SELECT source AS node FROM edges WHERE source <> target UNION ALL SELECT target FROM edges WHERE source <> target) SELECT node, count(*) AS degree FROM ends GROUP BY node")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(network.edges(model.triple(spark, sf_dir)))


@query(_EDGES + " SELECT CASE WHEN source = 'Brand#11' THEN target ELSE source END AS neighbour, CAST(sum(count) AS BIGINT) AS weight FROM edges WHERE source = 'Brand#11' OR target = 'Brand#11' GROUP BY 1")
def neighbour_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.neighbours(network.edges(model.triple(spark, sf_dir)), "Brand#11")


_NODES = f"WITH {TRIPLE}, ends AS (SELECT id, source AS node FROM triple UNION ALL SELECT id, target FROM triple), nodes AS (SELECT node, count(DISTINCT id) AS count FROM ends GROUP BY node)"


@query(_NODES + " SELECT node, count, CAST(count AS DOUBLE) / (SELECT max(count) FROM nodes) AS scale FROM nodes WHERE count >= (SELECT min(count) FROM (SELECT count FROM nodes ORDER BY count DESC LIMIT 35))")
def label_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.labelled(network.scaled(network.nodes(model.triple(spark, sf_dir))))


@query(f"WITH {TRIPLE} SELECT substr(source, 1, 5) AS base, array_to_string(list_sort(list(DISTINCT source))[1:4], ',') AS surfaces FROM triple GROUP BY 1")
def node_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.triple(spark, sf_dir).select(F.substring("source", 1, 5).alias("base"), F.col("source").alias("surface"))
    return network.surfaces(rows).select("base", F.array_join("surfaces", ",").alias("surfaces"))


@query(f"WITH {TRIPLE} SELECT CASE WHEN score >= 8 THEN 'accept' WHEN relation = 'A' OR score >= 5 THEN 'review' ELSE 'reject' END AS status, count(*) AS n FROM triple GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their band; those of one relation count as selected."""
    t = model.triple(spark, sf_dir).withColumn("selected", F.col("relation") == "A")
    return t.withColumn("status", review.classify(F.col("score"), F.col("selected"), accept=8, least=5))


@query(f"""WITH {TRIPLE}, c AS (SELECT *, relation = 'A' AS selected, CASE WHEN score >= 8 THEN 'accept' WHEN relation = 'A' OR score >= 5 THEN 'review' ELSE 'reject' END AS status FROM triple)
SELECT status, selected, status = 'accept' OR (status = 'review' AND selected) AS tick, CASE WHEN status = 'accept' AND score > 8 THEN 1.0 WHEN status = 'accept' THEN 0.8 WHEN score > 8 THEN 0.5 ELSE 0.1 END::DOUBLE AS confidence, count(*) AS n FROM c GROUP BY ALL""")
def classify_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    sources = F.when(F.col("score") > 8, 2).otherwise(1)
    shown = c.select("status", "selected", review.default_tick(F.col("status"), F.col("selected")).alias("tick"), review.confidence(F.col("status") == "accept", sources).alias("confidence"))
    return shown.groupBy("status", "selected", "tick", "confidence").agg(F.count("*").alias("n"))


@query(f"WITH {TRIPLE} SELECT id, source, relation, target, score FROM triple WHERE score >= 5 QUALIFY row_number() OVER (PARTITION BY source, relation, target ORDER BY score DESC, id) = 1")
def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = model.triple(spark, sf_dir).where("score >= 5")
    return review.dedupe(t, ["source", "relation", "target"], "score", ["id"])


@query(f"WITH {TRIPLE}, d AS (SELECT DISTINCT * FROM triple WHERE score >= 6), r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, id, relation) AS r FROM d) SELECT id, source, relation, target, score, CAST(r AS INTEGER) AS r FROM r WHERE r <= 2")
def cap_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.capped(model.triple(spark, sf_dir).distinct(), ["source", "target"], "score", ["id", "relation"], least=6, most=2)


@query("""WITH g AS (SELECT * FROM (VALUES ('c', 'one'), ('cl', 'two'), ('v', 'three'), ('purchase', 'four'), ('none', 'five')) v(prefix, name))
SELECT name, count(event_id) AS n FROM g LEFT JOIN events ON starts_with(event_type, prefix) GROUP BY name""")
def candidate_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by prefix groups; a row may fall in several. Types are counted before they meet the few prefixes."""
    groups = spark.createDataFrame([("c", "one"), ("cl", "two"), ("v", "three"), ("purchase", "four"), ("none", "five")], "prefix string, name string")
    types = model.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return groups.join(types, F.startswith(F.col("event_type"), F.col("prefix")), "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(f"WITH {TRIPLE} SELECT CASE relation WHEN 'A' THEN 'has' WHEN 'N' THEN 'acts' ELSE 'other' END AS kind, count(*) AS n FROM triple WHERE CASE relation WHEN 'A' THEN 'has' WHEN 'N' THEN 'acts' ELSE 'other' END IN ('has', 'other') GROUP BY 1")
def relation_kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("A", "has"), ("N", "acts")], "relation string, kind string")
    rows = model.triple(spark, sf_dir).join(F.broadcast(kinds), "relation", "left").withColumn("kind", F.coalesce("kind", F.lit("other")))
    return rows.where(F.col("kind").isin("has", "other")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {TRIPLE} SELECT target AS grp, count(*) FILTER (score >= 5) AS chosen, count(*) AS total FROM triple WHERE score > 0 GROUP BY target")
def selected_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.triple(spark, sf_dir).where("score > 0").groupBy(F.col("target").alias("grp")).agg(F.count_if(F.col("score") >= 5).alias("chosen"), F.count("*").alias("total"))


@query(f"WITH {TRIPLE}, {ENTITY}, hit AS (SELECT id, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, count(*) AS statements FROM triple WHERE source = 'Brand#22' GROUP BY id) SELECT id, company, year, relations, statements FROM hit JOIN entity USING (id)")
def entities_with_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = model.triple(spark, sf_dir).where("source = 'Brand#22'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), F.count("*").alias("statements"))
    return hit.join(model.entity(spark, sf_dir).select("id", "company", "year"), "id")


@query(f"""WITH {TRIPLE}, c AS (SELECT DISTINCT id, source, relation, target, score >= 8 AS selected, least(source, target) AS a, greatest(source, target) AS b FROM triple)
SELECT DISTINCT x.id, x.source, x.relation, x.target FROM c x JOIN c y ON x.id = y.id AND x.a = y.a AND x.b = y.b AND NOT x.selected AND y.selected AND (x.relation = y.relation OR (x.relation, y.relation) IN (('A', 'N'), ('N', 'A')))""")
def near_duplicate_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.triple(spark, sf_dir).repartition(model.parts(spark, sf_dir, "lineitem"), "id")
    rows = rows.select("id", "source", "relation", "target", (F.col("score") >= 8).alias("selected")).distinct()
    synonyms = spark.createDataFrame([("A", "N")], "x string, y string")
    return review.near_duplicates(rows, synonyms).select("id", "source", "relation", "target").distinct()


@query(f"WITH {code_sql(1)}, c AS (SELECT DISTINCT * FROM entity_code) SELECT x.id AS a, x.id + 1 AS b, count(*) AS common, string_agg(x.code, ',' ORDER BY x.code) AS codes FROM c x JOIN c y ON y.id = x.id + 1 AND x.code = y.code GROUP BY x.id")
def shared_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neighbours in the list have in common."""
    codes = model.entity_code(spark, sf_dir, 1).select("id", F.col("code").alias("term"))
    pairs = codes.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).distinct()
    common = similarity.shared(codes, pairs)
    return common.groupBy("a", "b").agg(F.count("*").alias("common"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("codes"))


@query("""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.id, c.id AS other, list_cosine_similarity(q.e, c.e) AS sim FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 100 = 0)
SELECT id, other, CASE WHEN (SELECT e FROM v WHERE v.id = p.id) = (SELECT e FROM v WHERE v.id = p.other) THEN 'exact' WHEN sim >= 0.6 THEN 'near' ELSE 'weak' END AS label FROM p WHERE sim >= 0.3""")
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others."""
    v = model.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = similarity.vector_matches(v.where("id % 100 = 0"), v, 0.3)
    return found.select("id", "other", review.match_label(F.col("same"), F.col("sim")).alias("label"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS name, p_brand AS code FROM part), terms AS (SELECT id, 'c' || code AS term FROM t UNION ALL SELECT id, 'g' || substr(name, CAST(i AS INTEGER), 2) FROM t, unnest(range(1, length(name))) u(i)),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT id) AS n FROM terms),
w AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN n), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS sim FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id, b.id)
SELECT id, other, CAST(row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def char_code_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest five by names' characters and codes; queries are the ids divisible by 100, against all."""
    part = model.table(spark, sf_dir, "part")
    grams = F.transform(F.sequence(F.lit(1), F.length("p_name") - 1), lambda i: F.concat(F.lit("g"), F.substring(F.col("p_name"), i, F.lit(2))))
    terms = part.select(F.col("p_partkey").alias("id"), F.concat(F.array(F.concat(F.lit("c"), "p_brand")), grams).alias("terms"))
    v = stored(similarity.vectors(terms), "vectors")
    return similarity.top_cosine(v.where("id % 100 = 0"), v, 5).select("id", "other", "rank")


@query("""WITH terms AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT id) AS n FROM terms),
w AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN n), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS sim FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id, b.id)
SELECT id, other, CAST(row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest five texts by their words; queries are the ids divisible by 100, against all."""
    terms = model.doc(spark, sf_dir).select("id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("terms"))
    v = stored(similarity.vectors(terms), "vectors")
    return similarity.top_cosine(v.where("id % 100 = 0"), v, 5).select("id", "other", "rank")


_GRAINS = f"""WITH {TRIPLE}, d AS (SELECT DISTINCT id, source, relation, target FROM triple WHERE score >= 5), g AS (SELECT DISTINCT id, 'triple' AS grain, source || '|' || relation || '|' || target AS term FROM d UNION SELECT id, 'pair', source || '|' || target FROM d UNION SELECT id, 'component', source FROM d UNION SELECT id, 'component', target FROM d)"""


def grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grain, term of chosen statements: whole, as pairs, and as components."""
    return similarity.grains(model.triple(spark, sf_dir).where("score >= 5"))


@query(_GRAINS + """, terms AS MATERIALIZED (SELECT id, grain || ':' || term AS term FROM g), df AS (SELECT term, count(*) AS df FROM terms GROUP BY term), n AS (SELECT count(DISTINCT id) AS n FROM terms),
w AS (SELECT id, term, ln((1 + n) / (1 + df)) + 1 AS w FROM terms JOIN df USING (term) CROSS JOIN n), u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS sim FROM u a JOIN u b ON a.term = b.term AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id, b.id)
SELECT id, other, CAST(row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def grain_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest five items by their statements at three grains; queries are the ids divisible by 100, against all."""
    v = stored(similarity.vectors(similarity.grain_lists(model.triple(spark, sf_dir).where("score >= 5"))), "vectors")
    return similarity.top_cosine(v.where("id % 100 = 0"), v, 5).select("id", "other", "rank")


@query(_GRAINS + """ SELECT x.id AS a, x.id + 1 AS b, x.grain, count(*) AS common, string_agg(x.term, ',' ORDER BY x.term) AS terms FROM g x JOIN g y ON y.id = x.id + 1 AND x.grain = y.grain AND x.term = y.term GROUP BY x.id, x.grain""")
def grain_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neighbours in the list share: statements, pairs and components."""
    g = grains(spark, sf_dir)
    pairs = g.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).distinct()
    common = similarity.shared(g.select("id", F.struct("grain", "term").alias("term")), pairs)
    return common.groupBy("a", "b", "term.grain").agg(F.count("*").alias("common"), F.array_join(F.array_sort(F.collect_list("term.term")), ",").alias("terms"))


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part), m AS (SELECT a.name, min_by(b.name, length(b.name)) AS into_name FROM n a JOIN n b ON starts_with(a.name, b.name) GROUP BY a.name), c AS (SELECT split_part(p_name, ' ', 1) AS into_name, count(*) AS parts FROM part GROUP BY 1) SELECT name, into_name, coalesce(parts, 0) AS parts FROM m LEFT JOIN c USING (into_name)")
def prefix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that open with another name merge into it, with how many rows that one has."""
    part = model.table(spark, sf_dir, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    merges = similarity.prefix_merges(part.select(F.col("p_name").alias("name")).union(part.select(first)))
    counts = stats.rank_values(part.select(first.alias("into")), "into", name="parts")
    return merges.join(counts, "into", "left").select("name", F.col("into").alias("into_name"), F.coalesce("parts", F.lit(0)).alias("parts"))


@query(f"""WITH {TRIPLE}, {ENTITY}, c AS (SELECT DISTINCT id, source, target, CASE WHEN score >= 8 THEN 'accept' WHEN relation = 'A' OR score >= 5 THEN 'review' ELSE 'reject' END AS status FROM triple),
seen AS (SELECT doc_id AS id, max(quality) AS keep FROM labels GROUP BY doc_id), rels AS (SELECT c.id, source, target, s.id IS NOT NULL AS reviewed FROM c LEFT JOIN seen s ON c.id = s.id WHERE CASE WHEN s.id IS NULL THEN status IN ('accept', 'review') ELSE keep = 1 END)
SELECT DISTINCT id, unnest([source, target]) AS component, reviewed FROM rels""")
def drawing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each item for its drawing: of the rows kept in review where it was reviewed, else of what is accepted or to review."""
    seen = model.review(spark, sf_dir).groupBy("id").agg(F.max("keep").alias("keep"))
    rows = classified(spark, sf_dir).select("id", "source", "target", "status").repartition(model.parts(spark, sf_dir, "lineitem"), "id")
    rows = rows.distinct().join(seen, "id", "left")
    kept = rows.where(F.coalesce("keep", F.col("status").isin("accept", "review")))
    return kept.select("id", F.explode(F.array("source", "target")).alias("component"), F.col("keep").isNotNull().alias("reviewed")).distinct()


@query(f"""WITH {TRIPLE}, {code_sql(1)}, {ENTITY}, u AS (SELECT id, 'code' AS kind, code AS term FROM entity_code UNION SELECT id, 'component', source FROM triple WHERE score >= 5 UNION SELECT id, 'component', target FROM triple WHERE score >= 5 UNION SELECT id, 'relation', relation FROM triple WHERE score >= 5
UNION SELECT id, 'title', unnest(regexp_extract_all(lower(title), '\\p{{L}}{{2,}}')) FROM entity)
SELECT kind, term, count(*) AS items FROM u GROUP BY kind, term""")
def term_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by the terms of every kind that they hold: codes, components and relations of chosen statements, words of titles."""
    rows = stats.held_terms(model.entity(spark, sf_dir), model.triple(spark, sf_dir).where("score >= 5"), model.entity_code(spark, sf_dir, 1))
    return rows.groupBy("kind", "term").agg(F.count("*").alias("items"))


@query(f"""WITH {TRIPLE}, d AS (SELECT DISTINCT id, source, relation, target FROM triple WHERE score >= 5), g AS (SELECT id, count(*) AS kept, string_agg(source || '|' || relation || '|' || target, ';' ORDER BY source, relation, target) AS triples FROM d GROUP BY id)
SELECT id, kept, triples FROM g WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def gold_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of each reviewed item, in order, as one list; an item's statements are few."""
    done = model.review(spark, sf_dir).where("keep").select("id").distinct()
    d = model.triple(spark, sf_dir).where("score >= 5").select("id", "source", "relation", "target").distinct().join(done, "id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("source", "relation", "target")))
    return d.groupBy("id").agg(F.count("*").alias("kept"), F.array_join(F.transform(listed, lambda x: F.concat_ws("|", x["source"], x["relation"], x["target"])), ";").alias("triples"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) || ' group' FROM part), s AS (SELECT name AS parent, left(name, length(name) - 6) AS stem FROM n WHERE ends_with(name, ' group'))
SELECT name, coalesce(min_by(parent, (length(stem), parent)), name) AS into_name FROM n LEFT JOIN s ON starts_with(name, stem) GROUP BY name""")
def parent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that open with a parent company's stem merge into it."""
    part = model.table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" group"))))
    return similarity.parent_merges(names, (" group",)).withColumnRenamed("into", "into_name")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT unnest([p_name, upper(p_name), replace(p_name, ' ', '-'), p_brand]) AS name FROM part), f AS (SELECT name, replace(replace(lower(name), ' ', ''), '-', '') AS form FROM s),
e AS (SELECT x.name AS a, y.name AS b FROM f x JOIN f y USING (form) UNION SELECT p_name, p_brand FROM part WHERE p_partkey % 40 = 1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT name AS a, name AS b FROM s UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS name, min(b) AS canonical FROM r GROUP BY a""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of part names and brands, some of which are merged, by the smallest one that they lead to."""
    part = model.table(spark, sf_dir, "part")
    spelled = part.select(F.explode(F.array("p_name", F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("-")), "p_brand")).alias("name"))
    return canonical.names(spelled, part.where("p_partkey % 40 = 1").select(F.col("p_name").alias("name"), F.col("p_brand").alias("into")))


@query(f"""WITH {TRIPLE}, v AS (SELECT id, CASE id % 3 WHEN 0 THEN upper(source) WHEN 1 THEN replace(source, '#', '-#') ELSE source END AS source, ' ' || relation AS relation, CASE WHEN id % 5 = 0 THEN source ELSE target END AS target FROM triple),
c AS (SELECT name, min(name) OVER (PARTITION BY replace(lower(name), '-', '')) AS canonical FROM (SELECT source AS name FROM v UNION SELECT target FROM v))
SELECT v.id, a.canonical AS source, trim(relation) AS relation, b.canonical AS target, count(*) AS n FROM v JOIN c a ON source = a.name JOIN c b ON target = b.name WHERE a.canonical <> b.canonical GROUP BY ALL""")
def tidy_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in several spellings, some from a name to itself, by canonical names."""
    t = model.triple(spark, sf_dir)
    source = F.when(F.col("id") % 3 == 0, F.upper("source")).when(F.col("id") % 3 == 1, F.replace("source", F.lit("#"), F.lit("-#"))).otherwise(F.col("source"))
    v = t.select("id", source.alias("source"), F.concat(F.lit(" "), "relation").alias("relation"), F.when(F.col("id") % 5 == 0, F.col("source")).otherwise(F.col("target")).alias("target"))
    return canonical.tidy(v, canonical.names(v.select(F.explode(F.array("source", "target")).alias("name"))))


_AXES = {"code": "Brand#22", "component": "NATION_3", "relation": "R", "title": "high"}


@query(f"WITH {TRIPLE}, {code_sql(1)}, {ENTITY} " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, id, title, year FROM entity WHERE company = 'BUILDING' AND {test}" for kind, test in (
    ("code", "id IN (SELECT id FROM entity_code WHERE code = 'Brand#22')"), ("component", "id IN (SELECT id FROM triple WHERE score >= 5 AND 'NATION_3' IN (source, target))"),
    ("relation", "id IN (SELECT id FROM triple WHERE score >= 5 AND relation = 'R')"), ("title", "list_contains(regexp_extract_all(lower(title), '\\p{L}{2,}'), 'high')"))))
def members_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's items behind one cell of each kind of matrix: by code, component, relation and word of the title."""
    entities = model.entity(spark, sf_dir)
    held = stats.held_terms(entities, model.triple(spark, sf_dir).where("score >= 5"), model.entity_code(spark, sf_dir, 1))
    parts = [stats.members(entities, held, "BUILDING", kind, term).select(F.lit(kind).alias("kind"), "id", "title", "year") for kind, term in _AXES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
