import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import boxes, network, resolve, review, similarity, stats
from factloom.sources import pages, tables
from factloom.streaming import progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_specialisation_of_everything_is_one(spark):
    df = spark.createDataFrame([(1, "g", "x"), (2, "g", "y"), (2, "g", "x")], "id int, grp string, code string")
    assert [r.coefficient for r in stats.specialisation(df, "grp", "code").collect()] == [1.0, 1.0]


def test_majority_takes_first_seen(spark):
    votes = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4)], "key string, name string, at int")
    assert stats.majority(votes, "key", "name", "at").first()["name"] == "b"


def test_touched_falls_back_to_all_nodes(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "node string, count long")
    none = spark.createDataFrame([], "source string, relation string, target string, count long")
    assert network.touched(nodes, none).count() == 2
    some = spark.createDataFrame([("a", "r", "c", 1)], "source string, relation string, target string, count long")
    assert rows(network.touched(nodes, some)) == [("a", 1)]


def test_link_with_fallback(spark):
    comps = spark.createDataFrame([("ファン",), ("軸",)], "comp string")
    signs = spark.createDataFrame([("1", "軸流ファン"), ("2", "羽根")], "code string, name string")
    body = spark.createDataFrame([("9", "軸"), ("8", "ファン")], "code string, name string")
    got = {(r.comp, r.code, r.origin) for r in resolve.link_with_fallback(comps, signs, body).collect()}
    assert got == {("ファン", "1", "signs"), ("軸", "9", "body")}


def test_match_codes_tiers(spark):
    known = spark.createDataFrame([("30a",), ("10",), ("A1",)], "code string")
    read = spark.createDataFrame([("30A",), ("lO",), ("10",), ("zz",), ("l",)], "text string")
    assert rows(resolve.match_codes(read, known)) == [("10", "10", 1), ("30A", "30a", 2), ("lO", "10", 3)]


def test_best_hit_stops_early(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.85), (1, 2, "b", 0.95), (2, 1, "c", 0.4), (2, 2, "d", 0.5), (3, 1, "e", 0.2)], "id int, rank int, hit string, sim double")
    assert rows(resolve.best_hit(hits)) == [(1, "a", 0.85), (2, "d", 0.5)]


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 5), (3, "b", 1)], "id int, k string, score int")
    once = review.dedupe(df, ["k"], "score", ["id"])
    assert rows(once) == rows(review.dedupe(once, ["k"], "score", ["id"])) == [(2, "a", 5), (3, "b", 1)]


def test_next_open_goes_round(spark):
    q = spark.createDataFrame([(1, False, "g"), (2, True, "g"), (9, True, "g"), (13, False, "g"), (5, False, "h"), (6, True, "h")], "at int, done boolean, grp string")
    for width in (1, 3, 1000):
        got = {r.at: r.next_open for r in review.next_open(q, "at", "done", "grp", width=width).collect()}
        assert got == {1: 13, 2: 13, 9: 13, 13: 1, 5: None, 6: 5}


def test_places_are_those_of_one_window(spark):
    data = [(k % 3 if k % 7 else None, (k * 5) % 4 if k % 11 else None, k % 2, k * 13 % 101) for k in range(60)]
    q = spark.createDataFrame(data, "grp int, review int, accept int, id int")
    nulls_last = lambda r: (r[1] is None, -(r[1] or 0), r[2], r[3])
    expected = []
    for g in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == g), key=nulls_last)
        expected += [(*r, k + 1) for k, r in enumerate(mine)]
    for width in (1, 7, 1000):
        got = [tuple(r) for r in review.places(q, "grp", {"review": True, "accept": False}, "id", width=width).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert review.places(q.limit(0), "grp", {"review": True}, "id").count() == 0


def test_contained_words_by_distinct_words(spark):
    texts = spark.createDataFrame([(1, "motors motor x"), (2, "motorcase, unmotor"), (3, None), (4, ""), (2, "motorcase")], "id int, text string")
    names = spark.createDataFrame([("motor",), ("motor",), ("motorcase",), ("x",), (None,)], "name string")
    assert rows(resolve.contained_words(texts, names)) == [(1, "motor"), (1, "x"), (2, "motor"), (2, "motorcase")]
    present = spark.createDataFrame([(1, "motor", "more")], "id int, name string, note string")
    assert rows(resolve.contained_words(texts, names, least=2, present=present)) == [(2, "motor"), (2, "motorcase")]
    assert rows(resolve.contained_words(texts, names.limit(0))) == rows(resolve.contained_words(texts.limit(0), names)) == []


def test_terms_count_ids_once(spark):
    held = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (2, "b", "y"), (3, "b", None), (None, "a", "x"), (1, "c", "x")], "id int, term string, grp string")
    assert rows(stats.terms(held, F.col("grp") == "x", 1, 5)) == [("a", 1, 2, 1.5), ("c", 1, 1, 3.0)]
    assert rows(stats.terms(held, F.col("grp") == "z", 1, 5)) == []


def test_evaluate_empty(spark):
    none = spark.createDataFrame([], "a string")
    r = review.f_score(review.evaluate(none, none, ["a"])).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (0, 0, 0, 0.0)


def test_prefix_merges(spark):
    names = spark.createDataFrame([("ab",), ("abc",), ("x",)], "name string")
    assert rows(similarity.prefix_merges(names)) == [("ab", "ab"), ("abc", "ab"), ("x", "x")]


def test_pages(spark):
    html = "<html><title>A &amp;\n B</title><script>no</script><p>one <b>two</b><p>three<a href='u'>x</a></div></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p")], "page_id long, html string")
    got = {r.page_id: (r.title, r.links, r.paragraphs) for r in pages.parse(df).collect()}
    assert got[1] == ("A & B", ["u"], ["one two", "threex"])
    assert got[2] == ("", [], [])


def test_list_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", "甲,\n乙", "", "要約"), ("p2", "", "請求", "")], "`文献番号` string, `発明の名称` string, `請求項` string, `要約` string")
    tables.write_list(df, str(tmp_path / "list"))
    back = tables.read_list(spark, str(tmp_path / "list"))
    docs = tables.documents(back, tables.detect_columns(back.columns))
    assert sorted((r.id, r.title, r.text, r.text_source) for r in docs.collect()) == [("p1", "甲,\n乙", "要約", "abstract"), ("p2", None, "請求", "claim")] or rows(docs)


def test_collection(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"meta": {}, "patents": [{"id": "a", "analyzed": false}, {"id": "b"}]}')
    assert rows(tables.read_collection(spark, str(tmp_path / "c.json")).select("id", "analyzed")) == [("a", False), ("b", True)]
    (tmp_path / "d.json").write_text('{"meta": {}}')
    with pytest.raises(ValueError):
        tables.read_collection(spark, str(tmp_path / "d.json"))


def test_stream_resumes(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    batch = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60 + 1_000_000).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    schema = "event_id long, ts timestamp, event_type string, value double"
    for lo, hi in ((0, 10), (5, 15)):
        batch(lo, hi).write.mode("append").parquet(source)
        q = progress.append_to(progress.unseen(progress.arriving(spark, source, schema)), out, at)
        q.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == list(range(15))


def test_tokens_read_apart_are_joined(spark):
    rows = [(1, 1, "30ap", 0, 0, 40, 20), (1, 2, "1", 42, 0, 50, 20), (1, 3, "124", 0, 100, 30, 120), (1, 4, "1", 31, 110, 36, 122), (1, 5, "12", 200, 0, 220, 20), (1, 6, "13", 300, 0, 320, 20), (1, 7, "a", 51, 0, 60, 20), (2, 1, "9", 42, 0, 50, 20)]
    tokens = spark.createDataFrame(rows, "page int, box_id int, label string, x0 int, y0 int, x1 int, y1 int")
    got = boxes.joined_tokens(tokens, text.CODE)
    assert rows_of(got, "page", "label", "x0", "x1") == [(1, "12", 200, 220), (1, "1241", 0, 36), (1, "13", 300, 320), (1, "30ap1a", 0, 60), (2, "9", 42, 50)]
    known = spark.createDataFrame([("1241",)], "code string")
    assert [r for r in rows_of(boxes.joined_tokens(tokens, text.CODE, known), "label") if len(r[0]) > 2] == [("1241",), ("30ap",)]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def plain_joins(tokens, known=None):
    """One pair at a time, looked for from the start each time."""
    tokens = [list(t) for t in sorted(tokens, key=lambda t: (t[3], t[2], t[0]))]

    def fits(a, b):
        ah, bh, gap = a[5] - a[3], b[5] - b[3], b[2] - a[4]
        dy = abs((a[3] + a[5]) / 2 - (b[3] + b[5]) / 2)
        near = dy < 0.35 * ah or (bh < 0.85 * ah and b[5] >= a[5] - 0.2 * ah and dy < 0.6 * ah)
        return near and -2 <= gap < 0.45 * ah and re.fullmatch(text.CODE, a[1] + b[1]) and (known is None or a[1] + b[1] in known)

    while pair := next(((a, b) for a in tokens for b in tokens if a is not b and fits(a, b)), None):
        a, b = pair
        a[1:] = [a[1] + b[1], a[2], min(a[3], b[3]), b[4], max(a[5], b[5])]
        tokens.remove(b)
    return [tuple(t) for t in tokens]


def test_tokens_are_joined_to_the_end(spark):
    """Thirty letters and digits in a row, and pages of crowded tokens, as one pair at a time from the start gives them."""
    rng = random.Random(4)
    rows = [(1, k, "ab1c2"[k % 5], 10 * k, 0, 10 * k + 9, 10) for k in range(30)] + [(2, k, str(k % 10), 10 * k, 0, 10 * k + 9, 10) for k in range(30)]
    for page in range(3, 30):
        for k in range(rng.randint(1, 14)):
            x, y, h = rng.randint(0, 60), rng.randint(0, 12), rng.choice([6, 10, 12])
            rows.append((page, k, rng.choice(["1", "2", "3a", "b", "4", "10", "ap"]), x, y, x + rng.randint(3, 9), y + h))
    schema = "page int, box_id int, label string, x0 int, y0 int, x1 int, y1 int"
    got = {}
    for r in boxes.joined_tokens(spark.createDataFrame(rows, schema), text.CODE).collect():
        got.setdefault(r.page, []).append(tuple(r)[1:])
    for page in {r[0] for r in rows}:
        assert sorted(got[page]) == sorted(plain_joins([r[1:] for r in rows if r[0] == page])), page
    assert len(got[2]) == 8  # thirty digits make codes of four


def test_joins_look_up_codes_in_tiers_and_leave_rotated_tokens(spark):
    schema = "page int, box_id int, label string, x0 int, y0 int, x1 int, y1 int, rotated int, conf double"
    pair = lambda page, a, b, rotated=0: [(page, 1, a, 0, 0, 10, 10, rotated, 90.0), (page, 2, b, 11, 0, 20, 10, None, 60.0)]
    tokens = spark.createDataFrame(pair(1, "1", "0") + pair(2, "1", "A") + pair(3, "B", "0") + pair(4, "1", "0", 1) + pair(5, "9", "9") + pair(6, "1", "0"), schema)
    known = spark.createDataFrame([(1, "10"), (2, "1a"), (3, "80"), (4, "10"), (5, "98")], "page int, code string")
    got = boxes.joined_tokens(tokens, text.CODE, known)
    assert sorted((r.page, r.label, r.conf) for r in got.collect() if len(r.label) > 1) == [(1, "10", 60.0), (2, "1A", 60.0), (3, "B0", 60.0)]
    assert sorted(r.page for r in boxes.joined_tokens(tokens, text.CODE, known.select("code")).collect() if len(r.label) > 1) == [1, 2, 3, 6]


def test_centres_keep_their_distance(spark):
    schema = "page int, box_id int, x0 int, y0 int, x1 int, y1 int"
    old = spark.createDataFrame([(1, 0, 100, 100, 110, 110)], schema)
    new = spark.createDataFrame([(1, 1, 124, 81, 134, 91), (1, 2, 125, 100, 135, 110), (1, 3, 76, 124, 86, 134), (2, 4, 100, 100, 110, 110)], schema)
    assert sorted(r.box_id for r in boxes.away_from(new, old).collect()) == [2, 4]


def test_bracketed_tokens_keep_their_places(spark):
    token = spark.createDataFrame([(1, "20(20)", 0, 0, 60, 10), (2, "7", 5, 0, 9, 10), (3, "()", 0, 0, 8, 4)], "box_id int, label string, x0 int, y0 int, x1 int, y1 int")
    assert rows_of(boxes.split_tokens(token), "box_id", "label", "x0", "x1") == [(1, "20", 0, 20), (1, "20", 30, 50), (2, "7", 5, 9), (3, "()", 0, 8)]


def test_either_end_of_a_segment_may_be_near(spark):
    box = spark.createDataFrame([(1, 1, 100, 100, 120, 110)], "page int, box_id int, x0 int, y0 int, x1 int, y1 int")
    segments = [(1, 1, 200, 200, 122, 105), (1, 2, 150, 105, 300, 300), (1, 3, 121, 105, 110, 105)]
    found = boxes.nearest_segment(box, spark.createDataFrame(segments, "page int, segment_id int, sx0 int, sy0 int, sx1 int, sy1 int"))
    assert rows(found) == [(1, 1, 1)]


def test_most_alike_documents(spark, sf_dir):
    """Against plain sets, also where nothing is shared."""
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["q"]), (3, [])], "id int, terms array<string>")
    b = spark.createDataFrame([(5, ["x", "y", "z"]), (6, ["x", "y", "w"]), (4, ["k"])], "id int, terms array<string>")
    assert rows(similarity.best_matches(a, b, block=1)) == [(1, 5, 2, 3), (2, 4, 0, 2), (3, 4, 0, 1)]
    assert rows(similarity.best_matches(a, b)) == [(1, 5, 2, 3), (2, 4, 0, 2), (3, 4, 0, 1)]
    assert similarity.best_matches(a.limit(0), b).count() == similarity.best_matches(a, b.limit(0)).count() == 0


def test_titles_of_all_pages(spark, sf_dir):
    import html
    import re

    from factloom.plans import registry

    got = {r.page_id: r.title for r in registry.QUERIES["html_title"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        raw = re.search(r"(?is)<title[^>]*>(.*?)</title>", r.html)
        assert got[r.page_id] == " ".join(html.unescape(raw[1]).split())


def test_texts_stand_for_their_pairs(spark):
    a, b = (spark.createDataFrame(x, "id int, terms string") for x in ([(1, "abab😀"), (2, "q"), (3, None)], [(5, "abc"), (6, "bab😀"), (4, "")]))
    assert rows(similarity.best_matches(a, b)) == [(1, 6, 3, 3), (2, 4, 0, 0), (3, 4, 0, 0)]


@pytest.mark.parametrize("budget", [0, 30, 5000])
def test_pruned_cosine_is_exact(spark, budget):
    """Against all pairs: a term in every text, ties, texts that share nothing, and fewer partners than are asked for."""
    rng = random.Random(budget)
    terms = [(i, t) for i in range(120) for t in {"all", *(f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 25)))} for _ in range(rng.randint(1, 3))]
    terms += [(200, "only"), (201, "only"), (202, "lonely"), (203, "x"), (203, "y"), (204, "x"), (204, "y"), (205, "x"), (205, "y")]
    w = similarity.weights(spark.createDataFrame(terms, "id long, term string")).cache()
    asked = F.col("id").isin(0, 1, 2, 60, 119, 200, 202, 203)
    full = similarity.nearest(similarity.cosine(w.where(asked), w), 4)
    pruned = similarity.top_cosine(w.where(asked), w, 4, budget=budget)
    shown = lambda df: sorted((r.id, r.other, r["rank"], round(r.sim, 9)) for r in df.collect())
    assert shown(pruned) == shown(full) and len(shown(full)) > 20


def test_confidence_and_labels(spark):
    rows_ = spark.createDataFrame([(True, 2, False, 0.9, True), (True, 1, False, 0.7, False), (False, 2, True, 0.6, False), (False, 1, False, 0.5, False), (True, 3, True, 0.1, True)], "a boolean, n int, only boolean, sim double, same boolean")
    got = rows_.select(review.confidence(F.col("a"), F.col("n"), F.col("only")).alias("c"), review.match_label(F.col("same"), F.col("sim")).alias("l"))
    assert [tuple(r) for r in got.collect()] == [(1.0, "exact"), (0.8, "near"), (0.5, "near"), (0.1, "weak"), (0.6, "exact")]


def test_numbers_of_seven_digits(spark, tmp_path):
    """Keys with more digits than a number of a year has, as in larger tables."""
    from factloom.plans import registry
    from tests import oracle

    spark.sql("SELECT id AS o_orderkey, DATE '1996-03-01' AS o_orderdate FROM VALUES (12L), (999999L), (1234560L), (1234561L), (1234562L), (1234563L), (20345679L) t(id)").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    oracle.same(registry.QUERIES["doc_candidates"](spark, str(tmp_path)), con, registry.ORACLE_SQL["doc_candidates"])


def test_copies_cost_no_pairs(spark):
    """Many equal rows are one class: exact, and no pair of rows is joined by a term, which is what filled the disk."""
    terms = [(i, t) for i in range(400) for t in ("all", f"a{i % 3}", f"b{i % 2}")]
    v = similarity.vectors(spark.createDataFrame(terms, "id long, term string")).checkpoint()
    w = similarity.weights(spark.createDataFrame(terms, "id long, term string"))
    asked = F.col("id").isin(0, 7, 399)
    found = similarity.top_cosine(v.where(asked), v, 5)
    assert "term#" not in found._jdf.queryExecution().optimizedPlan().toString()
    shown = lambda df: sorted((r.id, r.other, r["rank"], round(r.sim, 9)) for r in df.collect())
    assert shown(found) == shown(similarity.nearest(similarity.cosine(w.where(asked), w), 5))


def test_equal_vectors_in_blocks(spark):
    """Each block of queries by itself; the same vector under another id is marked, vectors of zeros are no error."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "id long, v array<float>")
    for block in (1, 100):
        got = sorted((r.id, r.other, r.same) for r in similarity.vector_matches(v.where("id < 4"), v.where("id < 5"), 0.5, block=block).collect())
        assert got == [(1, 2, False), (1, 3, True), (2, 1, False), (2, 3, False), (3, 1, True), (3, 2, False)]
    assert similarity.vector_matches(v.where("id = 1"), v.where("id = 5"), 0.5).count() == 1


def test_vectors_of_lists(spark):
    """Lists with repeats, nulls and an id twice, in one block and in many, equal rows too many for one: the numbers of `weights`."""
    rng = random.Random(4)
    lists = [(i, [f"t{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randint(1, 20))]) for i in range(60)]
    lists += [(100 + i, ["all", "same", "same"]) for i in range(50)] + [(3, ["again", "t1", None]), (200, []), (201, None), (202, [None])]
    terms = [(i, t) for i, x in lists for t in x or () if t is not None]
    expected = {(r.id, r.term): round(r.w, 12) for r in similarity.weights(spark.createDataFrame(terms, "id long, term string")).collect()}
    for rows, schema in ((lists, "id long, terms array<string>"), (terms, "id long, term string")):
        for budget in (10, 10_000):
            got = similarity.vectors(spark.createDataFrame(rows, schema), budget=budget).collect()
            found = {(r.id, t): round(w, 12) for r in got for t, w in zip(r.terms, r.ws, strict=True)}
            assert found == expected and len(got) == len({i for i, _ in terms}) and all(r.terms == sorted(r.terms) for r in got)


def test_terms_are_not_dealt_one_by_one(spark):
    """Rows go out whole, and no exchange has a row for each term of each text but the one that a block asks with."""
    v = similarity.vectors(spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "id long, terms array<string>"))
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(block" in plan and "BroadcastHashJoin [term" not in plan


@pytest.mark.parametrize("rows, entries", [(64, 1 << 20), (640, 300), (1 << 18, 1 << 20)])
def test_rows_without_a_heavy_term_are_passed_over(rows, entries):
    """Whatever the sizes of the chunks, the best of all pairs, ties by id; a query with near rows looks at few of the others."""
    rng = np.random.default_rng(3)
    sets = [{0, *rng.integers(1, 30, rng.integers(1, 6)).tolist()} for _ in range(300)] + [{0, 50, 51}] * 9
    w = [np.array([0.2 if t == 0 else 1.0 for t in sorted(x)]) for x in sets]
    ws = [(x / np.sqrt((x * x).sum())).tolist() for x in w]
    table = pa.table({"id": list(range(len(sets))), "terms": [[f"{t:02}" for t in sorted(x)] for x in sets], "ws": ws, "h": [hash(tuple(sorted(x))) for x in sets], "g": [0] * len(sets)})
    asked, vocabulary = [3, 77, 300], pa.array([f"{t:02}" for t in range(60)])
    heavy = [sorted(zip(sorted(sets[q]), ws[q], strict=True), key=lambda x: -x[1]) for q in asked]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in heavy])]).tolist()
    block = SimpleNamespace(value=(pa.array(asked), vocabulary, starts, [t for x in heavy for t, _ in x], np.array([v for x in heavy for _, v in x])))
    dense = np.zeros((len(sets), 60))
    for i, x in enumerate(sets):
        dense[i, sorted(x)] = ws[i]
    sims = dense @ dense[asked].T
    expected = [(q, i) for k, q in enumerate(asked) for i in sorted(range(len(sets)), key=lambda i: (-round(sims[i, k], 9), i))[:6]]
    got = pa.Table.from_batches(similarity._best_in(block, 6, 9, rows, entries)(iter(table.to_batches(max_chunksize=50))))
    assert list(zip(got["q"].to_pylist(), got["other"].to_pylist(), strict=True)) == expected
    chunk, (a, b) = similarity._Chunk(table, vocabulary, 6), starts[2:4]
    places, v = block.value[3][a:b], block.value[4][a:b]
    found, _ = chunk.hits(places, v, np.sqrt(np.cumsum((v**2)[::-1])[::-1]), 0.9, 6, 1e-9)
    assert len(found) == 1 and len(chunk.starts) < len(sets)  # the nine equal ones are one row


def test_lists_of_grains(spark):
    rows = spark.createDataFrame([(1, "a", "r", "b"), (1, "a", "r", "b"), (1, "b", "s", "a"), (2, "a", "r", "c")], "id long, source string, relation string, target string")
    expected = sorted((r.id, f"{r.grain}:{r.term}") for r in similarity.grains(rows).collect())
    assert sorted((r.id, t) for r in similarity.grain_lists(rows).collect() for t in r.terms) == expected
    assert similarity.grain_lists(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
