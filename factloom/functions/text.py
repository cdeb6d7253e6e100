"""Text functions as columns: normalisation, names, codes, identifiers, character bigrams.

Only NFKC and lists of signs with dot leaders need Python, in Arrow UDFs; everything else is a built-in expression.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StringType, StructField, StructType

# Fixed values of the notation that the texts use.
SAID = "前記"
LEADING = "前記|該|当該|上記"
QUANTITIES = "複数の|一対の|少なくとも[0-9一二]+つの|[0-9]+つの|各"
ORDINAL = "第[0-9一二三四五六七八九十]+の?"
CODE = r"(?:[A-Za-z]{0,4}[0-9]{1,4}(?:[A-Za-z]{1,3}[0-9]{0,2}){0,2}'?)"
CODE_LETTERS = r"(?:[A-Z][A-Za-z]{1,5})"
CONFUSED, MEANT = "OoDQlIi|tSsZzBGbqgAT", "00001111155228669947"
ERAS = {"平": "H", "昭": "S", "令": "R"}


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x and not x.isascii() else x or "")


def nfkc(c: Column) -> Column:
    """Compatibility form; null becomes the empty string. Plain ASCII takes no trip to Python when guarded by the caller."""
    return _nfkc(F.coalesce(c, F.lit("")))


def squeezed(c: Column) -> Column:
    """Without white space of any kind."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """A name without spaces, leading references and quantities, and "said"."""
    x = F.regexp_replace(squeezed(c), f"^(?:{LEADING})", "")
    return F.replace(F.regexp_replace(x, f"^(?:{QUANTITIES})", ""), F.lit(SAID), F.lit(""))


def without_ordinal(c: Column) -> Column:
    return F.regexp_replace(c, ORDINAL, "")


def name_match(component: Column, sign: Column) -> Column:
    """3 for the same name; 2 where the sign only adds an ordinal, or ends with the component; 1 where only the component has
    an ordinal; else 0. Two different ordinals are two different parts."""
    a, b = norm(component), norm(sign)
    a0, b0 = without_ordinal(a), without_ordinal(b)
    a_has, b_has = a.rlike(ORDINAL), b.rlike(ORDINAL)
    rest = F.when(a_has & b_has, 0).when(b_has, 2).otherwise(1)
    longer = (F.length(a0) >= 2) & F.endswith(b0, a0)
    return F.when((a == "") | (b == ""), 0).when(a == b, 3).when((a0 == b0) & (a0 != ""), rest).when(longer, 2).otherwise(0)


def canon_code(c: Column) -> Column:
    """A code in compatibility form without primes."""
    return F.translate(F.trim(nfkc(c)), "'’", "")


def clean_name(c: Column) -> Column:
    marks = r"[ 　…・:：.。]"
    bare = F.regexp_replace(c, f"^{marks}+|{marks}+$", "")
    return F.trim(F.regexp_replace(bare, r"[（(][^）)]*[）)]$", ""))


def folded(c: Column) -> Column:
    """A code with characters that are often misread brought together."""
    return F.lower(F.translate(c, CONFUSED, MEANT))


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    letters = F.split(c, "")
    count = F.greatest(F.lit(0), F.size(letters) - 1)
    pairs = F.zip_with(F.slice(letters, F.lit(1), count), F.slice(letters, F.lit(2), count), lambda x, y: F.concat(x, y))
    return F.when(F.length(c) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 0 where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def bare_claim(c: Column) -> Column:
    """A claim without spaces, punctuation and brackets."""
    return F.regexp_replace(norm(c), r"(?U)[\s、。，．,.（）()「」]", "")


def claim_grams(c: Column) -> Column:
    return bigrams(bare_claim(c))


def base_term(c: Column) -> Column:
    """A component without its ordinal, trailing number and "said"."""
    return F.regexp_replace(without_ordinal(norm(c)), r"(?U)[0-9０-９]+$", "")


def clean_relation(c: Column) -> Column:
    """A relation without particles left at its head."""
    return F.regexp_replace(c, "^(?:には|では|とは|から|まで|に|を|が|は|で|と|へ)(?=.)", "")


def company_name(c: Column) -> Column:
    """An applicant without its legal form."""
    return F.trim(F.regexp_replace(c, r"(?i)株式会社|有限会社|合同会社|\s*(?:co\.?,?\s*)?(?:ltd|inc|corp|llc|gmbh)\.?$", ""))


def first_claim(c: Column) -> Column:
    """Claim 1 of a text in numbered claims; the whole text without numbers."""
    found = F.regexp_extract(c, r"(?s)【請求項[1１]】(.*?)(?:【請求項|$)", 1)
    return stripped(F.when(found != "", found).otherwise(c))


def claims_block(c: Column) -> Column:
    """array<struct<no, text>> of a text in numbered claims."""
    pattern = F.lit(r"(?s)【請求項([0-9]+)】(.*?)(?=【請求項|$)")
    numbers, texts = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.transform(F.arrays_zip(numbers.alias("no"), texts.alias("text")), lambda x: F.struct(x["no"].cast("int").alias("no"), stripped(x["text"]).alias("text")))


def fig_label(c: Column) -> Column:
    """"figure: description", shortened to 36 characters."""
    t = F.trim(nfkc(c))
    named = "^[【\\[]?(図[0-9]+(?:\\([a-zA-Z0-9]\\))?)"
    figure = F.regexp_extract(t, named, 1)
    told = F.substring(t, F.length(F.regexp_extract(t, named, 0)) + 1, F.length(t))
    # What stands between figure and description, then the ways in which a description ends, from the last mark on.
    for ends in ("^[】\\]]?\\s*(?:は、?|:|、)?\\s*", "。$", "(?:である|です)$", "(?:を示す図|を示す|の図)$"):
        told = F.regexp_replace(told, ends, "")
    told = F.trim(told)
    short = F.when(F.length(told) > 36, F.concat(F.left(told, F.lit(35)), F.lit("…"))).otherwise(told)
    return F.when(figure == "", F.left(t, F.lit(40))).when(short == "", figure).otherwise(F.concat(figure, F.lit("："), short))


def doc_key(c: Column) -> Column:
    """A document number without spaces and words around it."""
    return F.regexp_replace(F.upper(squeezed(nfkc(c))), "第|号|公報", "")


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def doc_candidates(c: Column) -> Column:
    """Publication numbers to try for a document number, in order; empty for one of no known form."""
    # The key is bound as a variable: as a column it would be worked out again in every branch.
    return F.transform(F.array(doc_key(c)), _candidates_of)[0]


def _candidates_of(s: Column) -> Column:
    plain = F.translate(s, "/-", "")
    foreign = s.rlike("^(?:JP|WO|US|EP|CN|KR|DE)[A-Z0-9/-]+$")
    typed = F.substring(plain, 3, 1000).rlike("[A-Z][0-9]?$")
    form = "^(特開|特表|特公|再表|再公表|実開|実登|実用新案登録|特許)(平|昭|令)?([0-9]+)?[-/]?([0-9]+)$"
    kind, era, year, number = (F.regexp_extract(s, form, k) for k in range(1, 5))
    padded = F.lpad(F.regexp_replace(number, "^0+(?=.)", ""), 6, "0")
    padded = F.when(F.length(F.regexp_replace(number, "^0+(?=.)", "")) > 6, F.regexp_replace(number, "^0+(?=.)", "")).otherwise(padded)
    letter = reduce(lambda acc, kv: acc.when(era == kv[0], F.lit(kv[1])), ERAS.items(), F.when(F.lit(False), ""))
    short = F.regexp_replace(year, "^0+(?=.)", "")
    when = F.when(era == "", year).otherwise(F.concat(letter, F.when(F.length(short) < 2, F.lpad(short, 2, "0")).otherwise(short)))
    whole = F.concat(year, number)
    year_only, seven = "^([0-9]{4})[-/]([0-9]{5,6})$", "^[0-9]{7}$"
    none = F.array().cast("array<string>")
    tail = F.concat(when, padded)
    return (
        F.when(foreign & typed, F.array(plain))
        .when(foreign & plain.startswith("WO"), F.array(_joined(plain, "A1")))
        .when(foreign, F.array(_joined(plain, "A"), _joined(plain, "B2"), _joined(plain, "B1")))
        .when(s.rlike(year_only), F.array(_joined("JP", F.regexp_extract(s, year_only, 1), F.lpad(F.regexp_extract(s, year_only, 2), 6, "0"), "A")))
        .when(s.rlike(seven), F.array(_joined("JP", s, "B2"), _joined("JP", s, "B1")))
        .when(kind == "", none)
        .when(kind == "特許", F.array(_joined("JP", whole, "B2"), _joined("JP", whole, "B1")))
        .when(kind.isin("実登", "実用新案登録"), F.array(_joined("JP", whole, "U")))
        .when(year == "", none)
        .when(kind.isin("特開", "特表"), F.array(_joined("JP", tail, "A")))
        .when(kind == "特公", F.array(_joined("JP", tail, "B2"), _joined("JP", tail, "B")))
        .when(kind == "実開", F.array(_joined("JP", tail, "U")))
        .otherwise(F.array(_joined("JPWO", tail, "A1"), _joined("WO", tail, "A1")))
    )


def document_address(c: Column, base: str) -> Column:
    """Fixed address of a document under a site's base, or null."""
    s = doc_key(c)
    laid = "^(特開|特表|特願)([0-9]{4})[-/]?([0-9]{1,6})$"
    granted, published, utility = "^(?:特許|JP)?([0-9]{7})(?:B[12]?)?$", "^JP([0-9]{4})([0-9]{6})A$", "^(?:実登|実用新案登録)([0-9]{7})$"
    at = lambda number, kind: F.concat(F.lit(f"{base}/c1801/PU/JP-"), number, F.lit(f"/{kind}/ja"))
    number = F.concat_ws("-", F.regexp_extract(s, laid, 2), F.lpad(F.regexp_extract(s, laid, 3), 6, "0"))
    bare = s.rlike("^(?:特許)?[0-9]{7}$") | s.rlike("^JP[0-9]{7}B[12]?$")
    return (
        F.when(F.regexp_extract(s, laid, 1) == "特願", at(number, 10))
        .when(s.rlike(laid), at(number, 11))
        .when(bare, at(F.regexp_extract(s, granted, 1), 15))
        .when(s.rlike(published), at(F.concat_ws("-", F.regexp_extract(s, published, 1), F.regexp_extract(s, published, 2)), 11))
        .when(s.rlike(utility), at(F.regexp_extract(s, utility, 1), 25))
    )


_PAIRS = "array<struct<code:string,name:string>>"


def sign_items(text: Column) -> Column:
    """struct<pairs, n_ok, n_bad> of a list of reference signs: items split at line ends, commas and semicolons; codes that stand
    alone belong to the next item that has a name; a chunk that is neither ends that and is bad. A code's first name wins.

    The fold carries the codes that wait, the pairs found, and the items with a name and without."""
    chunks = F.filter(F.transform(F.split(nfkc(text), r"[\n、,，;；]+"), lambda x: F.regexp_replace(x, r"(?U)^[\s。.]+|[\s。.]+$", "")), lambda x: x != "")
    only, named = f"^(?:{CODE}|{CODE_LETTERS})$", rf"^({CODE}|{CODE_LETTERS})(?:\s+|(?=[^\x00-\x7F]))(.+)$"
    none = F.array().cast("array<string>")
    bare = lambda x: F.translate(x, "'’", "")
    state = lambda waiting, pairs, ok, bad: F.struct(waiting.alias("waiting"), pairs.alias("pairs"), ok.alias("n_ok"), bad.alias("n_bad"))

    def step(acc: Column, x: Column) -> Column:
        name = clean_name(F.regexp_extract(x, named, 2))
        good = x.rlike(named) & name.rlike(r"[^\x00-\x7F]")
        codes = F.array_distinct(F.array_append(acc["waiting"], bare(F.regexp_extract(x, named, 1))))
        codes = F.filter(codes, lambda c: ~F.exists(acc["pairs"], lambda p: p["code"] == c))
        more = F.concat(acc["pairs"], F.transform(codes, lambda c: F.struct(c.alias("code"), name.alias("name"))))
        return (
            F.when(x.rlike(only), state(F.array_append(acc["waiting"], bare(x)), acc["pairs"], acc["n_ok"], acc["n_bad"]))
            .when(good, state(none, more, acc["n_ok"] + 1, acc["n_bad"]))
            .otherwise(state(none, acc["pairs"], acc["n_ok"], acc["n_bad"] + 1))
        )

    return F.aggregate(chunks, state(none, F.array().cast(_PAIRS), F.lit(0), F.lit(0)), step, lambda acc: F.struct(acc["pairs"].alias("pairs"), acc["n_ok"].alias("n_ok"), acc["n_bad"].alias("n_bad")))


def sign_pairs(text: Column) -> Column:
    """array<struct<code, name>> of a list of reference signs, whatever else stands in it."""
    return sign_items(text)["pairs"]


def sign_list(text: Column, least: int = 3) -> Column:
    """array<struct<code, name>> of a text if it is a list of reference signs, else empty. With three dot leaders or more it is read
    as dotted items, if there are `least` of them; otherwise it counts as a list with `least` named items and at most half as many
    chunks that are none."""
    dotted, plain = dotted_items(text), sign_items(text)
    leaders = F.regexp_count(nfkc(text), F.lit(_LEADER))
    good = (plain["n_ok"] >= least) & (plain["n_ok"] >= 2 * plain["n_bad"])
    return F.when((leaders >= 3) & (dotted["n_ok"] >= least), dotted["pairs"]).when(good, plain["pairs"]).otherwise(F.array().cast(_PAIRS))


def sign_section(c: Column) -> Column:
    """The part of a text under the heading for reference signs, up to the next heading; the whole text without one."""
    t = nfkc(c)
    after = F.split(t, "符号の説明", 2)
    under = F.try_element_at(F.split(F.try_element_at(after, F.lit(2)), "【(?![0-9]+】|符号)"), F.lit(1))
    part = F.when(F.size(after) > 1, F.regexp_replace(under, r"^[】\]]", "")).otherwise(t)
    return F.regexp_replace(part, "【[0-9]+】", "\n")  # paragraph numbers


#: Dots that lead from codes to a name, in compatibility form.
_LEADER = r"(?:…|\.\.|‥|・・・)[…\.‥・]*"


class _Dotted:
    """Items of codes, a leader and a name, read from leader to leader: what stands before a leader ends with its codes, and what is
    left of it names the codes before."""

    def __init__(self, text: str):
        self.names: dict[str, str] = {}
        self.wholes: dict[str, str] = {}  # numbers by the last subscript that they were seen with
        self.n_ok = 0
        spans = re.split(_LEADER, text)
        codes: list[str] = []
        for k, span in enumerate(spans):
            rest, ahead = (span, []) if k == len(spans) - 1 else self.tail(span)
            if k:
                self.item(codes, rest)
            codes = ahead

    def tail(self, span: str) -> tuple[str, list[str]]:
        """The span without its last words that are codes, and these codes. A digit or n at their head, set apart from a number
        before it, is that number's subscript."""
        rest, group = re.fullmatch(r"(.*?)(\S*)\s*", span, re.DOTALL).groups()
        while (first := re.match(r"([0-9]|n)(?=$|[、,，)）])", group)) and (number := re.search(r"[0-9]+$", rest.rstrip())):
            self.wholes[number[0]] = number[0] + first[0]
            words = rest.split()
            rest, group = rest.rstrip()[: -len(words[-1])], words[-1] + group
        return rest, [bare for part in re.split("[、,，・()（）]+", group) if re.fullmatch(f"{CODE}|{CODE_LETTERS}", bare := re.sub("['’]", "", part))]

    def item(self, codes: list[str], told: str) -> None:
        name = re.split(r"\s{2,}|\n", told.strip())[0] if told.strip() else ""
        name = re.sub(r"[（(][^）)]*[）)]$", "", name.strip(" 　…・:：.。")).strip()
        if codes and (not name.isascii() or re.fullmatch(r"[A-Z][A-Za-z0-9\- ]+", name)):
            self.n_ok += 1
            for code in codes:
                self.names.setdefault(code, name)

    def pairs(self) -> list[dict]:
        for number, whole in self.wholes.items():
            if whole in self.names:
                self.names.setdefault(number, self.names[whole])
        return [{"code": c, "name": n} for c, n in self.names.items()]


@F.pandas_udf(StructType([StructField("pairs", ArrayType(StructType([StructField("code", StringType()), StructField("name", StringType())]))), StructField("n_ok", IntegerType())]))
def _dotted(texts: pd.Series) -> pd.DataFrame:
    read = [_Dotted(t or "") for t in texts]
    return pd.DataFrame({"pairs": [r.pairs() for r in read], "n_ok": [r.n_ok for r in read]})


def dotted_items(c: Column) -> Column:
    """struct<pairs, n_ok> of items that join codes and a name by dot leaders and stand apart by white space. A digit or n set apart
    after a number, as a subscript, belongs to it. A code's first name wins. Since a drawing may show a subscript too small to
    read, a number known only with a subscript also stands for its last one. n_ok counts the items."""
    return _dotted(nfkc(c))


def dotted_signs(c: Column) -> Column:
    """array<struct<code, name>> of items that join codes and a name by dot leaders."""
    return dotted_items(c)["pairs"]


def solution_part(c: Column) -> Column:
    """The part of an abstract under its solution heading, without bracketed reference signs."""
    part = F.regexp_extract(c, "(?s)【解決手段】(.*?)(?:【|$)", 1)
    return stripped(F.regexp_replace(F.when(part != "", part).otherwise(c), rf"[（(]{CODE}(?:[,、，]\s*{CODE})*[）)]|(?<=[^\x00-\x7F]){CODE}(?=[^\x00-\x7F]|$)", ""))


def item_label(key: Column, title: Column, company: Column) -> Column:
    """key, title and company in one line, with words for what is missing."""
    shown = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    return F.concat_ws("｜", key, shown(title, "no title"), shown(company, "unknown"))


def text_label(c: Column) -> Column:
    """The kind of a text's source without the remark in brackets."""
    return F.split_part(c, F.lit("（"), F.lit(1))


def clean_answer(c: Column) -> Column:
    """A language model's answer without its notes."""
    return stripped(F.regexp_replace(c, r"(?is)<think>.*?(?:</think>|$)|<note>.*?(?:</note>|$)", ""))


def _canonical(c: Column, kind: DataType) -> Column:
    """A value whose fields and map entries stand in order of their names and keys."""
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _canonical(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(_canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    return c


def fingerprint(df: DataFrame, *names: str) -> Column:
    """A key of the values of some columns of df that depends neither on the order of the columns nor on that of fields and map entries within them."""
    return F.sha2(F.to_json(F.struct(*(_canonical(F.col(n), df.schema[n].dataType).alias(n) for n in sorted(names)))), 256)
