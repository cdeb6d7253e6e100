"""Linking names, codes and texts: suffix links, tiered matches, contained names, priority merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.session import by_key, stored


def link_names(components: DataFrame, signs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Best-scored signs (code, name) of each component (comp), all ties kept; where `by` names columns, within equal values of them.
    A match ends in the component's name without ordinals, so the two sides meet by equal suffixes instead of a cross join; of a sign
    only the suffixes as long as some component's name are made, where `by` names columns as some component's with equal values."""
    stem = lambda c: text.without_ordinal(text.norm(F.col(c)))
    plain = lambda c: text.nfkc(F.col(c))
    left = components.select(*by, "comp", plain("comp").alias("plain_comp")).distinct().withColumn("stem", stem("plain_comp")).where("stem <> ''")
    lengths = left.groupBy(*by).agg(F.collect_set(F.length("stem")).alias("lengths"))
    met = signs.select(*by, "code", "name").join(by_key(lengths), list(by)) if by else signs.select("code", "name").crossJoin(F.broadcast(lengths))
    ends = F.transform(F.filter("lengths", lambda n: n <= F.length("whole")), lambda n: F.right(F.col("whole"), n))
    right = met.withColumn("plain_name", plain("name")).withColumn("whole", stem("plain_name")).select(*by, "code", "name", "plain_name", F.explode(ends).alias("stem"))
    scored = left.join(by_key(right) if by else right, [*by, "stem"]).select(*by, "comp", "code", "name", text.name_match(F.col("plain_comp"), F.col("plain_name")).alias("score")).where("score > 0").distinct()
    w = Window.partitionBy(*by, "comp").orderBy(F.desc("score"))
    return scored.withColumn("r", F.rank().over(w)).where("r = 1").drop("r")


def link_with_fallback(components: DataFrame, signs: DataFrame, body: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Links by the sign table, and by the body table for components without any."""
    first = stored(link_names(components, signs, by).withColumn("origin", F.lit("signs")), "links")  # used twice
    rest = components.select(*by, "comp").distinct().join(by_key(first), [*by, "comp"], "left_anti")
    return first.unionByName(link_names(rest, body, by).withColumn("origin", F.lit("body")))


def match_codes(read: DataFrame, known: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Known code of each text read, where `by` names columns within equal values of them: the same; else the same but for case; else,
    for two characters or more, the only one that is the same after folding what is often misread. tier tells which."""
    codes = known.select(*by, "code").distinct()

    def only(name: str, c: Column) -> DataFrame:
        return codes.select(*by, F.col("code").alias(name), c.alias(f"{name}_key")).groupBy(*by, f"{name}_key").agg(F.min(name).alias(name), F.count("*").alias("hits"))

    t = read.select(*by, "text").distinct().withColumns({"exact_key": F.col("text"), "lower_key": F.lower("text"), "fold_key": F.when(F.length("text") >= 2, text.folded(F.col("text")))})
    exact = codes.select(*by, F.col("code").alias("exact_key"), F.col("code").alias("exact"))
    lower, folded = only("lower", F.lower("code")).drop("hits"), only("fold", text.folded(F.col("code"))).where("hits = 1").drop("hits")
    exact, lower, folded = (by_key(df) if by else df for df in (exact, lower, folded))
    m = t.join(exact, [*by, "exact_key"], "left").join(lower, [*by, "lower_key"], "left").join(folded, [*by, "fold_key"], "left")
    tier = F.when(F.col("exact").isNotNull(), 1).when(F.col("lower").isNotNull(), 2).when(F.col("fold").isNotNull(), 3)
    return m.select(*by, "text", F.coalesce("exact", "lower", "fold").alias("code"), tier.alias("tier")).where("code IS NOT NULL")


def contained_words(texts: DataFrame, names: DataFrame, letters: str = r"\p{L}", *, least: int = 1, present: DataFrame | None = None) -> DataFrame:
    """Names (name, of `least` characters or more) that occur in texts (id, text) without a letter before, each once for an id;
    those that `present` (id, name) holds already are left out. What a word starts with does not depend on its text: each
    distinct word's prefixes meet the names once, and only the words that hold one go back to their texts."""
    names = names.select("name").where(F.length("name") >= least).distinct()
    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{letters}]+"), F.lit(0)))).alias("word"))
    lengths = names.agg(F.min(F.length("name")).alias("short"), F.max(F.length("name")).alias("long"))
    cut = words.select("word").distinct().crossJoin(F.broadcast(lengths)).where(F.length("word") >= F.col("short"))
    prefixes = F.transform(F.sequence(F.col("short"), F.least(F.length("word"), F.col("long"))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    holding = cut.select("word", F.explode(prefixes).alias("name")).join(names, "name", "left_semi")
    found = words.join(holding, "word").select("id", "name").distinct()
    return found if present is None else found.join(present.select("id", "name"), ["id", "name"], "left_anti")


def merged_by_priority(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Value of each key from the first table that has it; within a table the least value."""
    union = None
    for k, t in enumerate(tables):
        part = t.where(F.col(value).isNotNull()).select(key, value, F.lit(k).alias("priority"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.min(F.struct("priority", value)).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col("m.priority").alias("priority"))


def best_hit(hits: DataFrame, *, stop: float = 0.8, least: float = 0.35) -> DataFrame:
    """The first hit by rank that reaches `stop`, else the most similar one if it reaches `least`."""
    first = F.min(F.when(F.col("sim") >= stop, F.struct("rank", "hit", "sim")))
    best = F.max_by(F.struct("rank", "hit", "sim"), F.struct("sim", -F.col("rank")))
    chosen = hits.groupBy("id").agg(F.coalesce(first, best).alias("c"))
    return chosen.select("id", "c.hit", "c.sim").where(F.col("sim") >= least)
