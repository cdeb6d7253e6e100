"""Numbered claims: references, expansion of dependent ones, signs and their majority names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import stats

# Fixed values of the notation.
REFERENCE = r"請求項\s*([0-9]+)"
STOPPED = "(?:特開|特表|特許|公報|図|表|式|項|文献|形態|例|ステップ|工程|段落|番号|数|量|率|係数|度|角|比|倍|個|本|枚|層目|番目)$"
NAME = "[一-龥々ァ-ヴー]"


def numbered(docs: DataFrame, column: str = "text") -> DataFrame:
    """id, no, text and ref (the first claim it refers to, null where it stands alone) of texts in numbered claims."""
    rows = docs.select("id", F.explode(text.claims_block(text.nfkc(F.col(column)))).alias("c")).select("id", "c.no", "c.text")
    ref = F.regexp_extract("text", REFERENCE, 1).try_cast("int")
    return rows.dropDuplicates(["id", "no"]).withColumn("ref", F.when(ref < F.col("no"), ref))


def expanded(claims: DataFrame, mark: str = "\n") -> DataFrame:
    """Each claim (id, no, text, ref) after the claims it builds on, first one first: id, no, n_parts, text. A reference to a claim
    that is absent, or not to an earlier one, ends the chain; no chain is too long.

    Rounds double the way looked back: a claim holds the places of its last 1, 2, 4... claims and where the next one is, and takes
    over the whole of that one's. Texts join once, at the end."""
    known = claims.select("id", "no").distinct().select("id", F.col("no").alias("ref"), F.lit(True).alias("there"))
    linked = claims.select("id", "no", F.when(F.col("ref") < F.col("no"), F.col("ref")).alias("ref")).join(known, ["id", "ref"], "left")
    rows = linked.select("id", "no", F.array("no").alias("way"), F.when(F.col("there"), F.col("ref")).alias("next")).checkpoint()
    while not rows.where("next IS NOT NULL").isEmpty():
        open_, further = rows.where("next IS NOT NULL"), rows.select("id", F.col("no").alias("next"), F.col("way").alias("more"), F.col("next").alias("then"))
        moved = open_.join(further, ["id", "next"]).select("id", "no", F.concat("more", "way").alias("way"), F.col("then").alias("next"))
        rows = rows.where("next IS NULL").unionByName(moved).checkpoint()
    parts = rows.select("id", "no", F.posexplode("way").alias("at", "part")).join(claims.select("id", F.col("no").alias("part"), F.col("text").alias("piece")), ["id", "part"])
    joined = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    return parts.groupBy("id", "no").agg(F.count("*").cast("int").alias("n_parts"), F.array_join(joined, mark).alias("text"))


def body_signs(docs: DataFrame, column: str = "text") -> DataFrame:
    """Name of each code (id, code, name) that a text writes as a noun followed by the code: the most frequent, then the first.

    Codes right behind a noun cut the text; what stands before each cut ends in its name."""
    code = rf"(?<={NAME})(?<!第){text.CODE}(?![0-9A-Za-z.])"
    read = docs.select("id", F.regexp_replace(text.nfkc(F.col(column)), "前記|当該|上記|該", "、").alias("t"))
    cuts = read.select("id", F.posexplode(F.arrays_zip(F.split("t", code).alias("before"), F.regexp_extract_all("t", F.lit(code), F.lit(0)).alias("code"))).alias("at", "c")).where("c.code IS NOT NULL")
    noun = F.regexp_extract("c.before", f"(?:第[0-9]+の?)?{NAME}+$", 0)
    named = cuts.select(F.struct("id", F.replace("c.code", F.lit("'"), F.lit("")).alias("code")).alias("key"), "at", text.norm(noun).alias("name"))
    real = named.where(F.col("key.code").rlike("[0-9]") & (F.col("name") != "") & ~F.col("name").rlike(STOPPED))
    return stats.majority(real, "key", "name", "at").select("key.id", "key.code", "name")


def sign_table(docs: DataFrame, column: str = "signs", least: int = 3) -> DataFrame:
    """id, code, name of texts that are lists of reference signs (`text.sign_list`)."""
    return docs.select("id", F.explode(text.sign_list(F.col(column), least)).alias("p")).select("id", "p.code", "p.name")


def publication_signs(pages: DataFrame, last: int = 6) -> DataFrame:
    """id, at, code, name and origin of the signs of parsed publications (id, signs, paragraphs, and description where there is one):
    the marked list; else the last of the closing paragraphs that is a list; else what follows the heading for signs in the
    description, if it is a list of two codes or more. `at` is a sign's place in its list."""
    listed = pages.select("id", text.sign_list(F.col("signs"), 1).alias("pairs"), F.lit(1).alias("least"), F.lit("list").alias("origin"), F.lit(0).alias("way"))
    paragraphs = pages.select("id", F.size("paragraphs").alias("n"), F.posexplode("paragraphs").alias("at", "p")).where(F.col("at") >= F.col("n") - last).select("id", "at", text.sign_list(F.col("p")).alias("pairs"))
    closing = paragraphs.where(F.size("pairs") > 0).groupBy("id").agg(F.max_by("pairs", "at").alias("pairs")).select("id", "pairs", F.lit(1), F.lit("paragraph"), F.lit(1))
    told = F.col("description") if "description" in pages.columns else F.array_join("paragraphs", "\n")
    whole = pages.select("id", told.alias("t")).where(F.contains(text.nfkc(F.col("t")), F.lit("符号の説明")))
    headed = whole.select("id", text.sign_list(text.sign_section(F.col("t")), 1).alias("pairs"), F.lit(2), F.lit("heading"), F.lit(2))
    ways = listed.union(closing).union(headed).where(F.size("pairs") >= F.col("least"))
    best = ways.groupBy("id").agg(F.min_by(F.struct("pairs", "origin"), "way").alias("w"))
    return best.select("id", F.posexplode("w.pairs").alias("at", "p"), "w.origin").select("id", "at", "p.code", "p.name", "origin")


def code_order(c: Column) -> list[Column]:
    """Shorter codes first, then by letters."""
    return [F.length(c), c]


def family_order(c: Column) -> list[Column]:
    """Own publications first, international ones next, republications last."""
    return [F.when(F.startswith(c, F.lit("JP")), 0).when(F.startswith(c, F.lit("WO")), 1).otherwise(2), F.endswith(c, F.lit("A5"))]


def is_drawing(page: Column, few: int = 120) -> Column:
    """Whether a page's text looks like a sheet of drawings: a figure mark and few kana or kanji besides the marks."""
    t = text.nfkc(page)
    return F.contains(t, F.lit("【図")) & (F.regexp_count(F.regexp_replace(t, "【図[0-9]+】", ""), F.lit("[ぁ-んァ-ヴ一-龥]")) < few)
