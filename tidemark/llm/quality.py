"""Learned decision lists over text statistics, with built-in functions alone.

`text_statistics` counts what the rules look at.  Every statistic that a rule may
use is turned into a whole level from 0 to 1000, so that all that learning needs is
a table of counts by statistic, level, fold and label: a few ten thousand numbers,
whatever the number of labelled rows.  All labelled rows are counted.

`learn` covers sequentially: it grows a conjunction of thresholds by FOIL's gain
on two folds of three, prunes its last conditions on the third, keeps the rule if
it is precise enough there, takes away what the rule covers, and begins again.
`verdict` is the list as one ordered conditional expression.

Defined cases: a null or blank text has no words and all counts 0; texts of any
length are counted whole; equal rows give equal rows; without labelled rows, or
with labels of one kind, the list is empty and keeps every row that the base rules
keep; labels other than 0 and 1, and null ids of labels, are not counted, and of
several labels of one id the least counts; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

WORD = "[^ \\t-\\r]+"
LEVELS = 1000
FOLDS = 3


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the counts that only the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("_text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike("[^ \\t-\\r]")))
    # a hash of the three words that begin at each place
    triples = F.expr("CASE WHEN size(_words) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, _words[i + 1], _words[i + 2])) END")
    rows = rows.withColumn("_triples", triples)
    # where any hash comes twice, by hash, words and place; equal ones then stand together, and the words decide
    by_hash = F.expr("CASE WHEN size(array_distinct(_triples)) < size(_triples) THEN sort_array(transform(_triples, (h, i) -> struct(h, _words[i] AS a, _words[i + 1] AS b, _words[i + 2] AS c, i))) END")
    rows = rows.withColumn("_by_hash", F.coalesce(by_hash, F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,i:int>>")))
    same = "x.h = {0}.h AND x.a = {0}.a AND x.b = {0}.b AND x.c = {0}.c"
    again = F.expr(f"sort_array(filter(transform(_by_hash, (x, k) -> CASE WHEN (k > 0 AND {same.format('_by_hash[greatest(k - 1, 0)]')}) OR ({same.format('get(_by_hash, k + 1)')}) THEN x.i END), i -> i IS NOT NULL))")
    rows = rows.withColumn("_again", again)
    covered = F.expr("aggregate(transform(_again, (p, k) -> least(3, coalesce(get(_again, k + 1), p + 3) - p)), 0L, (a, x) -> a + x)")
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.regexp_count("_text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        (F.char_length("_text") - F.char_length(F.translate("_text", "0123456789", ""))).cast("long").alias("n_digits"),
    )


def levels() -> dict[str, Column]:
    """The statistics that rules may use, as whole levels from 0 to LEVELS."""

    def share(part: str, whole: str, scale: int = LEVELS) -> Column:
        return F.least(F.lit(LEVELS), F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).otherwise(0)).cast("int")

    return {
        "length": F.least(F.lit(LEVELS), F.floor(F.log1p(F.col("n_words")) * 50)).cast("int"),
        "word_length": share("word_chars", "n_words", 20),
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "digits": share("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    least: bool  # whether the level has to be at least the limit, or at most
    limit: int

    def column(self) -> Column:
        return F.col(self.name) >= self.limit if self.least else F.col(self.name) <= self.limit


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Whether a row with level columns is kept: the first rule that holds rejects it."""
    out = F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(holds(rule), False)
    return out.otherwise(True)


def best_condition(counts: dict[str, dict[int, list[int]]], positives: int, negatives: int) -> Condition | None:
    """The threshold of most gain on [negatives, positives] by statistic and level, or none that gains."""
    best: tuple[float, Condition | None] = (1e-9, None)
    before = math.log2(positives / (positives + negatives))
    for name, by_level in sorted(counts.items()):
        seen = sorted(by_level)
        for least in (True, False):
            order = seen[::-1] if least else seen
            p = n = 0
            for k, level in enumerate(order[:-1]):
                n += by_level[level][0]
                p += by_level[level][1]
                if p:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best[0]:
                        # the limit stands halfway to the next level that occurs
                        limit = (level + order[k + 1] + 1) // 2 if least else (level + order[k + 1]) // 2
                        best = (gain, Condition(name, least, limit))
    return best[1]


def learn(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_positives: int = 5) -> list[Rule]:
    """Rules for rows to reject, from level columns, `reject` (0 or 1) and `fold` (0 to FOLDS - 1; 0 prunes)."""
    names = list(levels())
    rules: list[Rule] = []
    left = labelled.filter(F.col("reject").isNotNull())
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("level")) for name in names)))
            table = left.filter((F.col("fold") > 0) & holds(rule)).select("reject", pairs.alias("x")).groupBy("x.name", "x.level", "reject").count()
            counts: dict[str, dict[int, list[int]]] = {name: {} for name in names}
            for name, level, reject, n in table.collect():  # two for each statistic and level at most
                counts[name].setdefault(level, [0, 0])[reject] = n
            negatives, positives = (sum(x[k] for x in counts[names[0]].values()) for k in (0, 1))
            if not positives or not negatives or positives < min_positives:
                break
            condition = best_condition(counts, positives, negatives)
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        sums = [F.sum(F.when(holds(rule[:k]) & (F.col("reject") == label), 1).otherwise(0)) for k in range(1, len(rule) + 1) for label in (0, 1)]
        row = left.filter("fold = 0").agg(*sums).first()
        worth = [(((row[2 * k + 1] or 0) - (row[2 * k] or 0)) / max(1, (row[2 * k + 1] or 0) + (row[2 * k] or 0)), -k) for k in range(len(rule))]
        kept_to = -max(worth)[1]
        negatives, positives = row[2 * kept_to] or 0, row[2 * kept_to + 1] or 0
        if positives + negatives == 0 or positives < min_precision * (positives + negatives):
            break
        rule = rule[: kept_to + 1]
        rules.append(rule)
        left = left.filter(~holds(rule))
    return rules


def quality_verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts, whether the base rules fail, and whether the document is kept, by rules learned from `labels` (doc_id, quality)."""
    counted = checkpointed(text_statistics(documents))
    with_levels = counted.withColumns(levels())
    marked = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("reject"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # rows that the base rules reject anyway teach nothing
    labelled = with_levels.filter(~failed).join(marked, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)))
    rules = learn(checkpointed(labelled.select("reject", "fold", *levels())))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return with_levels.select("doc_id", *base, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
