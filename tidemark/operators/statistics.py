"""Statistics for data sets and their evaluation, as aggregates and windows.

Where an order over all rows is needed (ranking metrics), it is taken over distinct
scores after pre-aggregation, or in blocks of a range partitioning whose sums are
added up; no window runs over all rows in one task.
"""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.selection import exact_quantiles, key_of, order_statistics
from tidemark.sources.tables import cut_lineage


def expanding_moments(population: DataFrame, time: str, value: Column) -> DataFrame:
    """By time the mean and sample deviation of all values up to and including it, from per-time sums of powers around a common centre."""
    by_time = population.select(F.col(time), value.cast("double").alias("_v")).groupBy(time).agg(F.count("_v").alias("n"), F.sum("_v").alias("s"), F.var_pop("_v").alias("var"))
    # a row for each distinct time: the window is over those only
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    sums = by_time.withColumns({"n_all": F.sum("n").over(w), "s_all": F.sum("s").over(w), "q_all": F.sum(F.col("var") * F.col("n") + F.col("s") * F.col("s") / F.col("n")).over(w)})
    mean = F.col("s_all") / F.col("n_all")
    deviation = F.when(F.col("n_all") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q_all") - F.col("s_all") * mean) / (F.col("n_all") - 1))))
    return sums.select(time, F.col("n_all").alias("n"), mean.alias("mean"), deviation.alias("deviation"))


def frequency_table(df: DataFrame, category: str, least_share: float) -> DataFrame:
    """Shares of the categories that reach `least_share`, and `Others` for all else (nulls too), so that shares add up to 1."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.sum("n").alias("total"))
    shares = counts.crossJoin(F.broadcast(everything)).withColumn("share", F.col("n") / F.col("total"))  # one row beside
    kept = shares.filter(F.col(category).isNotNull() & (F.col("share") >= least_share)).select(F.col(category).alias("category"), "share")
    return kept.union(kept.agg(F.lit("Others").alias("category"), (1 - F.coalesce(F.sum("share"), F.lit(0.0))).alias("share")))


def apply_frequencies(df: DataFrame, category: str, table: DataFrame, name: str) -> DataFrame:
    """Every row with its category's share; unseen, pooled and null ones get that of `Others`.  The table has at most 1 / least_share + 1 rows."""
    shares = table.select(F.col("category").alias("_category"), F.col("share").alias("_share"))
    others = shares.filter("_category = 'Others'").select(F.col("_share").alias("_others"))
    joined = df.join(F.broadcast(shares), F.col(category) == F.col("_category"), "left").crossJoin(F.broadcast(others))
    return joined.withColumn(name, F.coalesce("_share", "_others")).drop("_category", "_share", "_others")


def quartiles(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Exact median and quartile range."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], keys or [])
    return q.select(*(keys or []), F.col("_q")[1].alias("median"), (F.col("_q")[2] - F.col("_q")[0]).alias("spread"))


def robust_scale(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """(value - median) / quartile range, the range 1 if it is 0; by key if given, else over all."""
    stats = quartiles(df.filter(F.col(value).isNotNull()), value, keys)
    joined = df.join(stats, keys, "left") if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(name, (F.col(value) - F.col("median")) / F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread"))).drop("median", "spread")


def stratified_split(df: DataFrame, strata: list[str], place: Column, cuts: list[tuple[str, float]], name: str = "split") -> DataFrame:
    """Every row with the part it falls into: of each stratum, in the order of `place`, the first share up to each cut.

    `place` is a number, or a struct that begins with one: where a cut falls is found by
    counting (`order_statistics`), and only rows whose number stands at a cut are put in
    order.  A null number comes first.
    """
    kind = df.select(place.alias("p")).schema["p"].dataType
    first, kind = (place[kind.names[0]], kind[0].dataType) if isinstance(kind, T.StructType) else (place, kind)
    least = F.lit(-float("inf")) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(-(1 << 63))
    rows = df.withColumns({"_place": F.coalesce(first, least), "_key": key_of(strata)})
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    taken = F.array(*(F.struct(F.lit(k).alias("_target"), F.floor(F.col("_n") * cut + 0.5).alias("_taken")) for k, (_, cut) in enumerate(cuts[:-1])))
    asked = cut_lineage(sizes.select("_key", F.inline(taken)))
    ranks = asked.filter("_taken > 0").select("_key", "_target", (F.col("_taken") - 1).alias("_rank"))
    found = order_statistics(rows.select(*(F.col(f"`{c}`") for c in strata), "_place"), strata, "_place", ranks)
    limits = asked.join(found, ["_key", "_target"], "left").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_target", F.struct("_value", (F.col("_taken") - F.col("_below")).alias("_more"))))).alias("_limits"))
    limited = rows.join(cut_lineage(limits), "_key")
    at_cut = F.exists(F.map_values("_limits"), lambda x: F.coalesce(x["_value"] == F.col("_place"), F.lit(False)))
    tied = Window.partitionBy("_key", "_place").orderBy(place)
    both = limited.filter(~at_cut).withColumn("_rank", F.lit(0)).unionByName(limited.filter(at_cut).withColumn("_rank", F.row_number().over(tied)))
    part = F.when(F.lit(False), "")
    for k, (label, _) in enumerate(cuts[:-1]):
        limit = F.col("_limits")[k]
        part = part.when((F.col("_place") < limit["_value"]) | ((F.col("_place") == limit["_value"]) & (F.col("_rank") <= limit["_more"])), label)
    return both.withColumn(name, part.otherwise(cuts[-1][0])).drop("_place", "_key", "_limits", "_rank")


def by_score(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(*(keys or []), score).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))


def cumulative_counts(counts: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """Running positives (tp) and negatives (fp) by falling score, with the totals.

    Without keys the running sums are taken within blocks of scores and the blocks'
    sums, a few hundred numbers, are added, so that no task gets all scores.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy(*keys)
        return counts.withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w), "positives": F.sum("pos").over(every), "negatives": F.sum("neg").over(every)})
    blocks = counts.withColumn("_block", F.floor(F.col(score) * 256))
    sums = blocks.groupBy("_block").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("_block", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"), F.sum("_p").over(whole).alias("positives"), F.sum("_n").over(whole).alias("negatives"))
    inside = Window.partitionBy("_block").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.join(sums, "_block")
    return joined.withColumns({"tp": F.sum("pos").over(inside) + F.col("_tp"), "fp": F.sum("neg").over(inside) + F.col("_fp")}).drop("_block", "_tp", "_fp")


def ranking_metrics(df: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve (ties count half), average precision, its lift over prevalence, and prevalence."""
    c = cumulative_counts(by_score(df, score, positive, keys), score, keys)
    won = F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2)
    step = F.col("pos") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))
    prevalence = F.max("positives") / (F.max("positives") + F.max("negatives"))
    out = c.filter("positives > 0 AND negatives > 0").groupBy(*(keys or [])).agg((F.sum(won) / (F.max("positives") * F.max("negatives"))).alias("auc"), F.sum(step).alias("average_precision"), prevalence.alias("prevalence"))
    return out.withColumn("lift", F.col("average_precision") / F.col("prevalence"))


def curve_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """The points of both curves, one for each distinct score from which rows count as positive: shares of negatives and positives that do (`fpr`, `tpr`), and `precision`."""
    c = cumulative_counts(by_score(df, score, positive), score)
    share = lambda part, of: F.when(of > 0, part / of)
    return c.select(F.col(score).alias("threshold"), share(F.col("fp"), F.col("negatives")).alias("fpr"), share(F.col("tp"), F.col("positives")).alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def best_f1_threshold(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """The least score whose cut (score >= threshold) has the greatest F1, and that F1."""
    c = cumulative_counts(by_score(df, score, positive), score)
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives")), 12)
    return c.select(F.col(score).alias("threshold"), f1.alias("f1")).agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def confusion_metrics(df: DataFrame, positive: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1, 0 where their denominator is."""
    tp, fp = F.count_if(positive & predicted), F.count_if(~positive & predicted)
    fn, n = F.count_if(positive & ~predicted), F.count(F.lit(1))

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return df.groupBy(*(keys or [])).agg(share(n - fp - fn, n).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def normal_tails(z: Column) -> Column:
    """The probability that a standard normal number is as far from 0 as z."""

    @F.pandas_udf("double")
    def tails(values: pd.Series) -> pd.Series:
        return values.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")

    return tails(z)


@functools.cache
def rank_sums(n: int) -> list[int]:
    """How many sets of the numbers 1 to n have each sum up to half of all."""
    ways = [1] + [0] * (n * (n + 1) // 4)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    return ways


def exact_tails(n: int, w: float) -> float:
    """The probability that, of n pairs without ties, the lesser rank sum is at most w."""
    return min(1.0, 2 * sum(rank_sums(n)[: int(w) + 1]) / 2**n)


def exact_tails_of(n: Column, w: Column) -> Column:
    @F.pandas_udf("double")
    def tails(counts: pd.Series, sums: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) or pd.isna(x) else exact_tails(int(k), x) for k, x in zip(counts, sums, strict=True)], dtype="float64")

    return tails(n, w)


#: Pairs up to which the distribution of rank sums is counted out.
EXACT_PAIRS = 50
#: Pairs of a key up to which one task ranks them.
RANKED_ROWS = 1 << 20


def ranks_by_key(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rank sums of keys of up to RANKED_ROWS pairs: shuffled once by key, put in order once, and summed where they stand."""
    columns = [F.col(f"`{k}`") for k in keys]
    # zeros come first in the order and are taken off the ranks again
    rank = F.rank().over(Window.partitionBy(*columns).orderBy("_size"))
    ranked = pairs.withColumn("_size", F.abs("_d")).withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*columns, "_size")))
    d, mean_rank = F.col("_d"), F.col("_rank") + (F.col("_n") - 1) / 2
    tied = F.sum(F.when(d != 0, (F.col("_n") * F.col("_n") - 1) / 48.0))
    sums = ranked.groupBy(*columns).agg(F.count_if(d == 0).alias("zeros"), F.count_if(d != 0).alias("n"), F.count_if(d > 0).alias("_up"), F.sum(F.when(d > 0, mean_rank)).alias("w_plus"), F.sum(F.when(d < 0, mean_rank)).alias("w_minus"), tied.alias("_tied"))
    sums = sums.fillna(0.0, ["w_plus", "w_minus", "_tied"])
    return sums.select(*columns, "zeros", "n", (F.col("w_plus") - F.col("zeros") * F.col("_up")).alias("w_plus"), (F.col("w_minus") - F.col("zeros") * (F.col("n") - F.col("_up"))).alias("w_minus"), "_tied")


def ranks_by_block(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The same where keys have very many pairs: counted over distinct sizes, within blocks of sizes whose counts are added up."""
    pairs = pairs.withColumn("_key", key_of(keys))
    sizes = pairs.groupBy("_key", F.abs("_d").alias("_size")).agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count(F.lit(1)).alias("_n"))
    zeros = sizes.groupBy("_key").agg(F.sum(F.when(F.col("_size") == 0, F.col("_n")).otherwise(0)).alias("zeros"))
    sizes = sizes.filter("_size <> 0").withColumn("_block", F.floor(F.log(F.col("_size")) * 64))
    below = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = sizes.groupBy("_key", "_block").agg(F.sum("_n").alias("_in")).withColumn("_below", F.coalesce(F.sum("_in").over(below), F.lit(0))).drop("_in")
    inside = Window.partitionBy("_key", "_block").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.join(blocks, ["_key", "_block"]).withColumn("_rank", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2)
    tied = F.sum((F.col("_n") * F.col("_n") - 1) * F.col("_n") / 48.0)
    sums = ranked.groupBy("_key").agg(F.sum("_n").alias("n"), F.sum(F.col("_rank") * F.col("_up")).alias("w_plus"), F.sum(F.col("_rank") * (F.col("_n") - F.col("_up"))).alias("w_minus"), tied.alias("_tied"))
    out = zeros.join(sums, "_key", "left").fillna(0, ["n"]).fillna(0.0, ["w_plus", "w_minus", "_tied"])
    return out.select(*(F.col("_key")[k].alias(k) for k in keys), "zeros", "n", "w_plus", "w_minus", "_tied")


def signed_ranks(df: DataFrame, a: Column, b: Column, keys: list[str], continuity: bool = False) -> DataFrame:
    """Wilcoxon's rank sums of paired differences by key: zeros dropped, tied sizes given their mean rank; two-sided p_value.

    The p-value is exact for up to EXACT_PAIRS pairs without zeros or ties, else by the
    normal approximation (z) with the correction for ties, and for continuity if asked
    for; 1 for a key whose differences are all 0.  Pairs with a null are left out.
    Keys of up to RANKED_ROWS pairs are ranked each by one task; of larger ones no task
    gets all pairs.
    """
    columns = [F.col(f"`{k}`") for k in keys]
    pairs = df.select(*columns, (a - b).alias("_d")).filter("_d IS NOT NULL")
    large = cut_lineage(pairs.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RANKED_ROWS).select(key_of(keys).alias("_large")))
    if large.isEmpty():
        out = ranks_by_key(pairs, keys)
    else:
        named = key_of(keys).eqNullSafe(F.col("_large"))
        out = ranks_by_key(pairs.join(large, named, "left_anti"), keys).unionByName(ranks_by_block(pairs.join(large, named, "left_semi"), keys))
    mean, deviation = F.col("n") * (F.col("n") + 1) / 4, F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("_tied"))
    w = F.least("w_plus", "w_minus")
    out = out.withColumns({"w": w, "z": F.when(deviation > 0, F.least(F.lit(0.0), w - mean + (0.5 if continuity else 0.0)) / deviation)})
    out = out.withColumn("exact", (F.col("n").between(1, EXACT_PAIRS)) & (F.col("zeros") == 0) & (F.col("_tied") == 0))
    p = F.when(F.col("n") == 0, 1.0).when(F.col("exact"), exact_tails_of(F.when(F.col("exact"), F.col("n")), F.col("w"))).otherwise(normal_tails(F.col("z")))
    return out.withColumn("p_value", p).select(*columns, "n", "zeros", "w_plus", "w_minus", "w", "z", "exact", "p_value")


def dense_numbers(df: DataFrame, value: str, block: Column, name: str) -> DataFrame:
    """Rows with the number, from 1, of their value among the distinct ones in order.

    `block` has to grow with the value; values are ranked within blocks, and only the
    blocks' counts are added up in one place.
    """
    distinct = df.select(F.col(value).alias("_value"), block.alias("_block")).distinct()
    counts = distinct.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy("_value"))).join(offsets, "_block")
    numbers = ranked.select("_value", (F.col("_offset") + F.col("_rank")).cast("long").alias(name))
    return df.join(numbers, df[value] == numbers["_value"]).drop("_value")
