"""Quality rules as learned decision lists, in DataFrame functions only.

`statistics` gives counts of each text by built-in functions. `learn` fits an
ordered list of rules to a bounded sample of labelled rows: sequential covering
grows one conjunction of thresholds at a time on two thirds of the rows, prunes
it on the rest, and drops what it covers. `verdict` turns the list into one
ordered Spark conditional expression.

Words are maximal runs of anything but space, tab, line feed, vertical tab, form
feed and carriage return. Repeated windows are found by sorting the window
hashes (64 bits) of each text that has some, so nothing is shuffled.

Defined cases: a null or empty text has zero words and counts, fails the base
rule and is not kept; ratios over zero are 0; with no labels, or labels of one
kind, there are no rules and the base rule decides; a document labelled twice
takes its lowest label; repeated rows and ids each keep their own row; other
columns of the inputs are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import read, sampled, spread

#: Most labelled ids that rules are learned from.
TRAIN_ROWS = 20_000
#: A power of two.
WINDOW = 8
#: As in a pattern's class of characters.
SYMBOLS = "#*$%&|<>"

_SPACE = r"[\x20\x09-\x0D]"
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "words_a_line", "distinct_share")


def _among(text: Column, chars: str) -> Column:
    """Number of characters of text that are in a class of characters."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _windows(df: DataFrame) -> DataFrame:
    """Adds windows, the hashes of all windows of WINDOW words, made from hashes of words by doubling; none where no window repeats.

    A window that repeats has WINDOW + 1 - k runs of k words that occurred before, so texts with fewer are done at that length."""
    df, k = df.withColumn("windows", F.col("hashes")), 1
    while k <= WINDOW:
        few = f"size(windows) - size(array_distinct(windows)) < {WINDOW + 1 - k}"
        rest = f"greatest(size(windows) - {k}, 0)"
        longer = f"zip_with(slice(windows, 1, {rest}), slice(windows, {k + 1}, {rest}), (a, b) -> xxhash64(a, b))" if k < WINDOW else "windows"
        df, k = df.withColumn("windows", F.expr(f"IF({few}, cast(array() AS array<bigint>), {longer})")), 2 * k
    return df


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the counts and the features of the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    df = df.select("id", "text", F.array_remove(F.split("text", f"{_SPACE}+"), "").alias("words"), F.split("text", "\n").alias("all_lines"))
    df = df.select("*", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.filter("all_lines", lambda x: ~x.rlike(rf"^{_SPACE}*$")).alias("lines"))
    df = _windows(df).select(
        "id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _among(F.col("text"), SYMBOLS).alias("n_symbols"),
        _among(F.col("text"), "A-Z").alias("n_upper"),
        _among(F.col("text"), "!?").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        "windows",
        F.ceil(F.log2(F.col("n_words") + 2)).cast("int").alias("bits"),
    )
    # The upper bits of a window's hash and its position in one long: sorting brings equal windows together.
    df = df.select("*", F.expr("sort_array(transform(windows, (h, i) -> shiftleft(shiftrightunsigned(h, bits), bits) | cast(i AS bigint)))").alias("sorted"))
    same = "shiftrightunsigned(x, bits) = shiftrightunsigned({0}, bits) AND get(windows, cast(x & (shiftleft(1L, bits) - 1) AS int)) = get(windows, cast({0} & (shiftleft(1L, bits) - 1) AS int))"
    df = df.select("*", F.expr(f"filter(sorted, (x, k) -> coalesce(k > 0 AND {same.format('get(sorted, k - 1)')}, false) OR coalesce({same.format('get(sorted, k + 1)')}, false))").alias("twice"))
    df = df.select("*", F.expr("sort_array(transform(twice, x -> x & (shiftleft(1L, bits) - 1)))").alias("at"))
    df = df.select("*", F.expr(f"aggregate(transform(at, (x, k) -> IF(k = 0, {WINDOW}L, least({WINDOW}L, x - get(at, k - 1)))), 0L, (a, x) -> a + x)").alias("n_repeat_words"))

    def share(x: str, y: str) -> Column:
        return F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0))

    return df.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "n_words").alias("mark_share"),
        share("n_words", "n_lines").alias("words_a_line"), share("n_distinct", "n_words").alias("distinct_share"),
    ).withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Test:
    """One threshold: feature >= limit, or feature < limit."""

    feature: str
    above: bool
    limit: float

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] >= self.limit) == self.above

    def column(self) -> Column:
        return F.col(self.feature) >= self.limit if self.above else F.col(self.feature) < self.limit


Rule = tuple[Test, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    for test in rule:
        rows = [r for r in rows if test.holds(r)]
    return rows


def _bad(rows: list[dict]) -> int:
    return sum(r["bad"] for r in rows)


def _limits(rows: list[dict], feature: str, steps: int = 32) -> list[float]:
    values = sorted({r[feature] for r in rows})
    middle = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return middle if len(middle) <= steps else [middle[len(middle) * k // steps] for k in range(steps)]


def _grow(rows: list[dict], most: int) -> Rule:
    """Adds the threshold of the highest information gain until no good row is covered."""
    rule: Rule = ()
    while rows and _bad(rows) < len(rows) and len(rule) < most:
        bad = _bad(rows)
        now = math.log2(bad / len(rows)) if bad else 0.0
        best, gain = None, 1e-9
        for feature in FEATURES:
            ordered = sorted((r[feature], r["bad"]) for r in rows)
            values = [v for v, _ in ordered]
            sums = [0]
            for _, b in ordered:
                sums.append(sums[-1] + b)
            for limit in _limits(rows, feature):
                k = _below(values, limit)
                for above, p, n in ((True, bad - sums[k], len(rows) - k), (False, sums[k], k)):
                    if p and (g := p * (math.log2(p / n) - now)) > gain:
                        best, gain = Test(feature, above, limit), g
        if best is None:
            break
        rule += (best,)
        rows = _covered((best,), rows)
    return rule


def _below(values: list[float], limit: float) -> int:
    from bisect import bisect_left

    return bisect_left(values, limit)


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """The leading part of the rule with the best (bad - good) / covered on rows it has not seen."""

    def worth(k: int) -> float:
        hit = _covered(rule[:k], rows)
        return (2 * _bad(hit) - len(hit)) / len(hit) if hit else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def cover(rows: list[dict], *, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9) -> list[Rule]:
    """Sequential covering over rows of features and `bad` (0 or 1); rows are dealt to growing and pruning by position."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < most_rules and _bad(grow):
        rule = _prune(_grow(grow, most_tests), prune)
        seen, held = _covered(rule, grow), _covered(rule, prune)
        both = seen + held
        if not rule or not seen or _bad(both) < precision * len(both) or _bad(held) < precision * len(held):
            break
        rules.append(rule)
        gone = set(map(id, both))
        grow, prune = [r for r in grow if id(r) not in gone], [r for r in prune if id(r) not in gone]
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = TRAIN_ROWS) -> list[Rule]:
    """Rules for documents labelled 0, from at most `sample` labelled ids, chosen by hash; of an id's texts the smallest counts."""
    marks = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).alias("label")).where(F.col("labelled").isNotNull() & F.col("label").isNotNull())
    marks = sampled(marks.groupBy("labelled").agg(F.min("label").alias("label")), sample, "labelled")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = texts.join(F.broadcast(marks), F.col("id") == F.col("labelled"))  # at most `sample` rows of two numbers
    some = some.groupBy("id", "label").agg(F.min("text").alias("text"))
    found = statistics(some.select(F.struct("id", "label").alias("id"), "text"), id_col="id", text_col="text")
    rows = [r.asDict(recursive=True) for r in found.select("id", *FEATURES).orderBy(F.xxhash64("id.id"), "id.id", "n_words").collect()]
    return cover([{**{f: float(r[f]) for f in FEATURES}, "bad": int(r["id"]["label"] == 0)} for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """False for rows that some rule covers: one conditional expression, rule after rule."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for t in rule:
            test = test & t.column()
        out = F.when(test, False).otherwise(out)
    return out


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents", "doc_id", "text"))
    rules = learn(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged(statistics(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
