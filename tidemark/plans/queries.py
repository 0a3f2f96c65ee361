"""The operators on the driver's tables.  Each query has its SQL twin in `oracles`.

Roles: a customer is a company (country its nation, sector its segment), an order a
financing round, a line item a participation of a supplier as investor; events are
what persons do.  These tables have no nulls, so queries about nulls make some by a
rule that both sides share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import semantics as sem
from tidemark.operators import states, statistics, temporal
from tidemark.operators.selection import running_medians
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("day"), year.alias("year"))


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(spark, sf_dir).groupBy("o_custkey").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = temporal.expand(lives(spark, sf_dir), F.col("first_year"), F.col("last_year"), "year")
    return years.withColumn("age", F.col("year") - F.col("first_year"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


LIVES = "lives AS (SELECT o_custkey, CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, CAST(max(year(o_orderdate)) AS BIGINT) AS last_year FROM orders GROUP BY 1)"
SKELETON = f"{LIVES}, skeleton AS (SELECT o_custkey, first_year, last_year, CAST(y AS BIGINT) AS year, CAST(y - first_year AS BIGINT) AS age FROM (SELECT *, unnest(range(first_year, last_year + 1)) AS y FROM lives))"


@query(f"WITH {SKELETON} SELECT o_custkey, year, age FROM skeleton")
def skeleton_years(spark, sf_dir):
    return skeleton(spark, sf_dir).select("o_custkey", "year", "age")


@query(f"""WITH {SKELETON}, last AS (
    SELECT o_custkey, CAST(year(max(o_orderdate)) AS BIGINT) AS year, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
  SELECT s.o_custkey, s.year, l.status FROM skeleton s LEFT JOIN last l ON s.o_custkey = l.o_custkey AND s.year = l.year""")
def status_on_own_year(spark, sf_dir):
    last = rounds(spark, sf_dir).groupBy("o_custkey").agg(F.max("year").alias("year"), F.max_by("o_orderstatus", F.struct("day", "o_orderkey")).alias("status"))
    return skeleton(spark, sf_dir).select("o_custkey", "year").join(last, ["o_custkey", "year"], "left")


def click_history(spark, sf_dir) -> DataFrame:
    w = states.so_far(["user_id"], ["ts"])
    return events(spark, sf_dir).filter("event_type = 'click'").select("user_id", "ts", F.count(F.lit(1)).over(w).alias("clicks"), F.round(F.sum("value").over(w), 6).alias("clicked"))


CLICKS = "clicks AS (SELECT user_id, ts, count(*) OVER w AS clicks, round(sum(value) OVER w, 6) AS clicked FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {CLICKS} SELECT p.event_id, p.user_id, c.clicks, c.clicked FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts")
def asof_event_attributes(spark, sf_dir):
    bought = events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.asof_join(bought, click_history(spark, sf_dir), ["user_id"], "ts", "ts", ["clicks", "clicked"]).select("event_id", "user_id", "clicks", "clicked")


@query(f"WITH {CLICKS}, last AS (SELECT user_id, arg_max(clicks, ts) AS clicks, arg_max(clicked, ts) AS clicked FROM clicks GROUP BY 1) SELECT p.event_id, p.user_id, l.clicks, l.clicked FROM events p LEFT JOIN last l USING (user_id) WHERE p.event_type = 'purchase'")
def snapshot_last_attributes(spark, sf_dir):
    bought = events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id")
    return temporal.snapshot_join(bought, click_history(spark, sf_dir), ["user_id"], "ts", ["clicks", "clicked"])


@query(f"""WITH {CLICKS}, timed AS (SELECT p.event_id, p.user_id, c.clicks FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts >= c.ts),
  last AS (SELECT user_id, max(clicks) AS clicks FROM clicks GROUP BY 1)
  SELECT t.user_id, count(*) AS n, CAST(sum(CASE WHEN t.clicks IS DISTINCT FROM l.clicks THEN 1 ELSE 0 END) AS BIGINT) AS n_leaking FROM timed t LEFT JOIN last l USING (user_id) GROUP BY 1""")
def timed_vs_snapshot_diff(spark, sf_dir):
    bought = events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    history = click_history(spark, sf_dir)
    timed = temporal.asof_join(bought, history, ["user_id"], "ts", "ts", ["clicks"]).withColumnRenamed("clicks", "timed")
    both = temporal.snapshot_join(timed, history, ["user_id"], "ts", ["clicks"])
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("timed").eqNullSafe(F.col("clicks"))).alias("n_leaking"))


def companies(spark, sf_dir) -> DataFrame:
    return lives(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", "first_year", "last_year")


COMPANIES = f"{LIVES}, companies AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, first_year, last_year FROM lives JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {COMPANIES}, deals AS (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT o_orderkey, count(*) AS n_active, round(avg(c_acctbal), 6) AS mean_balance FROM deals d JOIN companies c
  ON d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment AND year BETWEEN first_year AND last_year AND o_custkey <> c_custkey GROUP BY 1""")
def active_pairs_range_join(spark, sf_dir):
    firms, key = companies(spark, sf_dir), ["c_nationkey", "c_mktsegment"]
    deals = rounds(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "year", "c_acctbal", *key)
    # a round's own company lives in its year: it is taken off
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    found = temporal.active_sums(deals.withColumn("own", cents), firms, key, "year", "first_year", "last_year", {"n": F.lit(1), "cents": cents})
    others = found.select("o_orderkey", (F.col("n") - 1).alias("n_active"), (F.col("cents") - F.col("own")).alias("cents")).filter("n_active > 0")
    return others.select("o_orderkey", "n_active", F.round(F.col("cents") / 100 / F.col("n_active"), 6).alias("mean_balance"))


@query("""WITH parts AS (SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS year, l_extendedprice FROM lineitem), years AS (SELECT DISTINCT l_suppkey, year FROM parts)
  SELECT y.l_suppkey, y.year, count(*) AS n_so_far, round(median(p.l_extendedprice), 6) AS median_so_far FROM years y JOIN parts p ON y.l_suppkey = p.l_suppkey AND p.year <= y.year GROUP BY 1, 2""")
def triangular_cumulative_median(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("long").alias("year"), "l_extendedprice")
    found = running_medians(parts, ["l_suppkey"], "year", "l_extendedprice")
    return found.select("l_suppkey", "year", F.col("_n").alias("n_so_far"), F.round("_median", 6).alias("median_so_far"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
  firsts AS (SELECT c_nationkey, o_orderpriority, o_custkey, min(o_orderdate) AS d FROM r GROUP BY 1, 2, 3)
  SELECT o_orderkey, EXISTS (SELECT 1 FROM firsts f WHERE f.c_nationkey = r.c_nationkey AND f.o_orderpriority = r.o_orderpriority AND f.o_custkey <> r.o_custkey AND f.d < r.o_orderdate) AS earlier_rival FROM r""")
def earlier_rival_exists(spark, sf_dir):
    key = ["c_nationkey", "o_orderpriority"]
    r = rounds(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    firsts = r.groupBy(*key, "o_custkey").agg(F.min("day").alias("day"))
    # the earliest company of a group, and the earliest other one
    one = firsts.groupBy(*key).agg(F.min(F.struct("day", "o_custkey")).alias("one"))
    two = firsts.join(one, key).filter("o_custkey <> one.o_custkey").groupBy(*key).agg(F.min("day").alias("two"))
    both = r.join(one, key).join(two, key, "left")
    rival = F.when(F.col("o_custkey") != F.col("one.o_custkey"), F.col("one.day")).otherwise(F.col("two"))
    return both.select("o_orderkey", F.coalesce(rival < F.col("day"), F.lit(False)).alias("earlier_rival"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_panel_members(spark, sf_dir):
    large = rounds(spark, sf_dir).filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def anti_uncovered(spark, sf_dir):
    p = rounds(spark, sf_dir).filter("o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").join(p, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER w = 1 AS ever_urgent, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w = 1 AS ever_filled,
  max(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) OVER w = 1 AS ever_large FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def cumulative_any_flags(spark, sf_dir):
    w = states.so_far(["o_custkey"], ["day", "o_orderkey"])
    flags = {"ever_urgent": F.col("o_orderpriority") == "1-URGENT", "ever_filled": F.col("o_orderstatus") == "F", "ever_large": F.col("o_totalprice") > 400000}
    return rounds(spark, sf_dir).select("o_orderkey", *(states.cumulative_any(c, w).alias(n) for n, c in flags.items()))


@query("""WITH r AS (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS amount FROM orders)
  SELECT o_orderkey, CASE WHEN max(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN round(sum(amount) OVER w, 4) END AS raised FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def poisoned_cumsum(spark, sf_dir):
    amount = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    return rounds(spark, sf_dir).select("o_orderkey", F.round(states.poisoned_sum(amount, states.so_far(["o_custkey"], ["day", "o_orderkey"])), 4).alias("raised"))


@query("""WITH r AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice * 100 + 0.5) END AS x, o_orderkey % 3 AS wt FROM orders),
  s AS (SELECT o_orderkey, sum(CASE WHEN x IS NOT NULL AND wt > 0 THEN x * wt END) OVER w AS a, sum(CASE WHEN x IS NOT NULL AND wt > 0 THEN wt END) OVER w AS b FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
  SELECT o_orderkey, CAST(CASE WHEN b > 0 THEN floor(a / b) END AS BIGINT) AS mean_so_far FROM s""")
def cumulative_weighted_mean(spark, sf_dir):
    cents = F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") * 100 + 0.5).cast("double"))
    return rounds(spark, sf_dir).select("o_orderkey", F.floor(states.weighted_mean_so_far(cents, F.col("o_orderkey") % 3, states.so_far(["o_custkey"], ["day", "o_orderkey"]))).alias("mean_so_far"))


@query("""WITH r AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS owner FROM orders)
  SELECT o_orderkey, last_value(owner IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS owner_before,
  first_value(owner IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS owner_after FROM r""")
def forward_fill_owner(spark, sf_dir):
    owner, key, order = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")), ["o_custkey"], ["day", "o_orderkey"]
    return rounds(spark, sf_dir).select("o_orderkey", temporal.forward_fill(owner, key, order).alias("owner_before"), temporal.backward_fill(owner, key, order).alias("owner_after"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(year(o_orderdate) AS BIGINT) END AS y FROM orders),
  a AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
    first_value(y IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi,
    count(y) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS g FROM r),
  b AS (SELECT *, sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, g ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS i, sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, g) AS k FROM a)
  SELECT o_orderkey, CAST(CASE WHEN y IS NOT NULL THEN y WHEN lo IS NOT NULL AND hi IS NOT NULL THEN floor(CAST(lo + (hi - lo) * i AS DOUBLE) * 0 + lo + CAST((hi - lo) * i AS DOUBLE) / (k + 1) + 0.5) END AS BIGINT) AS year_filled FROM b""")
def gap_fill_even_spacing(spark, sf_dir):
    r = rounds(spark, sf_dir).withColumn("known", F.when(F.col("o_orderkey") % 3 != 0, F.col("year")))
    return temporal.fill_gaps(r, ["o_custkey"], ["day", "o_orderkey"], "known", "year_filled").select("o_orderkey", "year_filled")


NEXT = """WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders)
  SELECT a.o_orderkey, a.state, arg_min(b.state, b.i) AS next_state, CAST(CASE WHEN a.state IS NOT NULL THEN min(b.i) - a.i END AS BIGINT) AS rows_to_next
  FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.i > a.i AND b.state <> a.state GROUP BY a.o_orderkey, a.state, a.i"""


@query(NEXT)
def next_different_state(spark, sf_dir):
    r = rounds(spark, sf_dir).withColumn("state", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")))
    return temporal.next_different(r, ["o_custkey"], ["day", "o_orderkey"], "state", "next_state", "rows_to_next").select("o_orderkey", "state", "next_state", "rows_to_next")


@query("""SELECT event_id, user_id, n_left FROM (SELECT event_id, user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ended,
  count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_left FROM events) WHERE ended = 0""")
def truncate_at_terminal(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("n_left", temporal.rows_left(["user_id"], ["ts", "event_id"]))
    return states.truncate_at(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "n_left")


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS day, user_id, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), days AS (SELECT DISTINCT day FROM p)
  SELECT d.day, count(*) AS n, round(avg(ln(p.n + 1)), 6) AS mean, round(stddev_samp(ln(p.n + 1)), 6) AS deviation FROM days d JOIN p ON p.day <= d.day GROUP BY 1""")
def expanding_standardisation(spark, sf_dir):
    population = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = statistics.expanding_moments(population, "day", sem.log_plus_one(F.col("n")))
    return out.select("day", F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) AS BIGINT) AS number FROM customer")
def dense_renumber(spark, sf_dir):
    return statistics.dense_numbers(table(spark, sf_dir, "customer"), "c_name", F.substring("c_name", 1, 15), "number").select("c_custkey", "number")


@query(f"WITH {SKELETON} SELECT count(*) AS n, CAST(min(d) AS BIGINT) AS least_step, CAST(max(d) AS BIGINT) AS greatest_step FROM (SELECT age - lag(age) OVER (PARTITION BY o_custkey ORDER BY year) AS d FROM skeleton)")
def monotonicity_check(spark, sf_dir):
    step = F.col("age") - F.lag("age").over(Window.partitionBy("o_custkey").orderBy("year"))
    return skeleton(spark, sf_dir).select(step.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least_step"), F.max("d").alias("greatest_step"))


@query("""WITH p AS (SELECT l_orderkey, CASE WHEN (l_partkey + l_suppkey) % 9 <> 0 THEN l_returnflag END AS status, l_extendedprice, l_suppkey FROM lineitem),
  g AS (SELECT l_orderkey, coalesce(bool_or(status = 'R'), false) AS some_new, coalesce(bool_or(status IS NULL), false) AS some_unknown, count(*) FILTER (WHERE status = 'R') AS n_new,
    avg(l_extendedprice) FILTER (WHERE status = 'R') AS m, coalesce(bool_or(status = 'R' AND l_suppkey % 2 = 0), false) AS even FROM p GROUP BY 1)
  SELECT l_orderkey, CASE WHEN some_new THEN true WHEN some_unknown THEN NULL ELSE false END AS has_new, n_new, CASE WHEN some_new THEN round(m, 6) END AS mean_new, CASE WHEN some_new THEN even END AS even_new FROM g""")
def tri_state_deal_flags(spark, sf_dir):
    status = F.when((F.col("l_partkey") + F.col("l_suppkey")) % 9 != 0, F.col("l_returnflag"))
    new = F.col("status") == "R"
    g = table(spark, sf_dir, "lineitem").withColumn("status", status).groupBy("l_orderkey").agg(
        sem.tri_state(new, F.col("status").isNull()).alias("has_new"), F.count_if(new).alias("n_new"),
        F.round(F.avg(F.when(new, F.col("l_extendedprice"))), 6).alias("mean_"), sem.any_true(new & (F.col("l_suppkey") % 2 == 0)).alias("even_"),
    )
    return g.select("l_orderkey", "has_new", "n_new", sem.if_else_null(F.col("has_new"), F.col("mean_"), F.lit(None)).alias("mean_new"), sem.if_else_null(F.col("has_new"), F.col("even_"), F.lit(None)).alias("even_new"))


@query("""WITH parts AS (SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1)
  SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n_rounds, round(sum(o_totalprice), 4) AS raised, coalesce(bool_or(o_orderpriority = '1-URGENT'), false) AS urgent,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share_filled, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority, CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(n_suppliers), 0) AS BIGINT) AS n_suppliers
  FROM orders LEFT JOIN parts ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def company_year_rollup(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_suppkey").alias("n_suppliers"))
    r = rounds(spark, sf_dir).join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return r.groupBy("o_custkey", "year").agg(
        F.count(F.lit(1)).alias("n_rounds"), F.round(F.sum("o_totalprice"), 4).alias("raised"), sem.any_true(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("share_filled"), F.max_by("o_orderpriority", F.struct("day", "o_orderkey")).alias("last_priority"),
        sem.total(F.col("n_lines")).alias("n_lines"), sem.total(F.col("n_suppliers")).alias("n_suppliers"),
    )


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, count(DISTINCT user_id) AS n_people, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS n_signups,
  round(100.0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END), 0), 6) AS percent_bought, CAST(floor(sum(floor(value * 100 + 0.5)) / count(*)) AS BIGINT) AS mean_cents, round(stddev_samp(value), 6) AS deviation, coalesce(bool_or(value > 99), false) AS some_large FROM events GROUP BY 1""")
def team_rollup(spark, sf_dir):
    bought, seen = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "view"))
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_people"), F.count_if(F.col("event_type") == "signup").alias("n_signups"),
        F.round(sem.ratio(100.0 * bought, seen), 6).alias("percent_bought"), F.floor(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("double")) / F.count(F.lit(1))).alias("mean_cents"), F.round(F.stddev_samp("value"), 6).alias("deviation"), sem.any_true(F.col("value") > 99).alias("some_large"),
    )


@query("SELECT conv_id, string_agg(role, ', ' ORDER BY first_turn) AS roles FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_titles(spark, sf_dir):
    firsts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return firsts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ", ").alias("roles"))


@query("""WITH a AS (SELECT user_id, event_type, CAST(ts AS DATE) AS started, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 7 AS INTEGER) END AS ended, event_id % 13 = 0 AS in_office FROM events),
  one AS (SELECT user_id, event_type, bool_or(in_office) AS in_office, min(started) AS started, CASE WHEN bool_or(in_office) OR count(ended) < count(*) THEN NULL ELSE max(ended) END AS ended FROM a GROUP BY 1, 2)
  SELECT user_id, bool_or(in_office) AS in_office, min(started) AS started, CASE WHEN bool_or(in_office) OR count(ended) < count(*) THEN NULL ELSE max(ended) END AS ended, string_agg(event_type, ', ' ORDER BY event_type) AS titles FROM one GROUP BY 1""")
def appointment_merge(spark, sf_dir):
    day = F.to_date("ts")
    a = events(spark, sf_dir).select("user_id", "event_type", day.alias("started"), F.when(F.col("event_id") % 5 != 0, F.date_add(day, (F.col("event_id") % 7).cast("int"))).alias("ended"), (F.col("event_id") % 13 == 0).alias("in_office"))
    open_ended = F.bool_or("in_office") | (F.count("ended") < F.count(F.lit(1)))
    merged = [F.bool_or("in_office").alias("in_office"), F.min("started").alias("started"), F.when(~open_ended, F.max("ended")).alias("ended")]
    one = a.groupBy("user_id", "event_type").agg(*merged)
    return one.groupBy("user_id").agg(*merged, F.array_join(F.array_sort(F.collect_list("event_type")), ", ").alias("titles"))


# Ordered patterns and what they say of a part.
PART_RULES = [("^promo", "Promotion"), ("steel|nickel", "Hard metal"), (r"\btin\b|copper", "Soft metal"), ("brush", "Surface")]


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)^promo') THEN 'Promotion' WHEN regexp_matches(p_type, '(?i)steel|nickel') THEN 'Hard metal'
  WHEN regexp_matches(p_type, '(?i)\btin\b|copper') THEN 'Soft metal' WHEN regexp_matches(p_type, '(?i)brush') THEN 'Surface' ELSE 'Other' END AS kind FROM part""")
def first_match_classifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sem.first_match(F.col("p_type"), PART_RULES, "Other").alias("kind"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%y') WHEN 2 THEN 'N/A' ELSE '13/45/2001' END AS written FROM orders)
  SELECT o_orderkey, written, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS day FROM t""")
def parse_mixed_dates(spark, sf_dir):
    form = F.col("o_orderkey") % 4
    written = F.when(form == 0, F.date_format("day", "MM/dd/yyyy")).when(form == 1, F.date_format("day", "MM/dd/yy")).when(form == 2, "N/A").otherwise("13/45/2001")
    return rounds(spark, sf_dir).withColumn("written", written).select("o_orderkey", "written", sem.parse_date(F.col("written")).alias("day"))


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 3 OR s_suppkey % 4 = 2 THEN NULL ELSE s_acctbal END AS balance FROM supplier""")
def null_token_scrub(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 6 == 0, "N/A").when(k % 6 == 1, "").when(k % 6 == 2, "NaN").otherwise(F.col("s_name"))
    balance = F.when(k % 4 == 3, float("nan")).when(k % 4 == 2, float("inf")).otherwise(F.col("s_acctbal"))
    return sem.scrub(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), balance.alias("balance")))


@query(f"""WITH {LIVES}, u AS (
    SELECT o_custkey AS person, 'order' AS source, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(year(o_orderdate) AS BIGINT) END AS declared FROM orders
    UNION ALL SELECT user_id, 'event', CASE WHEN event_id % 2 = 0 THEN CAST(year(ts) AS BIGINT) END FROM events WHERE event_type = 'signup'),
  f AS (SELECT person, source, coalesce(declared, first_year, min(declared) OVER (PARTITION BY person), 0) AS year FROM u LEFT JOIN lives ON person = o_custkey),
  g AS (SELECT person, year, CAST(sum(CASE WHEN source = 'order' THEN 1 ELSE 0 END) AS BIGINT) AS orders_, CAST(sum(CASE WHEN source = 'event' THEN 1 ELSE 0 END) AS BIGINT) AS events_ FROM f GROUP BY 1, 2)
  SELECT person, CAST(year AS BIGINT) AS year, CAST(sum(orders_) OVER w AS BIGINT) AS n_orders, CAST(sum(events_) OVER w AS BIGINT) AS n_events FROM g WINDOW w AS (PARTITION BY person ORDER BY year ROWS UNBOUNDED PRECEDING)""")
def event_year_cascade(spark, sf_dir):
    bought = rounds(spark, sf_dir).select(F.col("o_custkey").alias("person"), F.lit("order").alias("source"), F.when(F.col("o_orderkey") % 3 != 0, F.col("year")).alias("declared"))
    signed = events(spark, sf_dir).filter("event_type = 'signup'").select(F.col("user_id").alias("person"), F.lit("event").alias("source"), F.when(F.col("event_id") % 2 == 0, F.year("ts").cast("long")).alias("declared"))
    u = bought.unionByName(signed)
    # declared, else the company's founding, else the person's first known year, else 0
    own = u.groupBy("person").agg(F.min("declared").alias("own_first"))
    f = u.join(lives(spark, sf_dir), F.col("person") == F.col("o_custkey"), "left").join(own, "person").withColumn("year", F.coalesce("declared", "first_year", "own_first", F.lit(0)))
    g = f.groupBy("person", "year").agg(F.count_if(F.col("source") == "order").alias("orders_"), F.count_if(F.col("source") == "event").alias("events_"))
    w = states.so_far(["person"], ["year"])
    return g.select("person", "year", F.sum("orders_").over(w).alias("n_orders"), F.sum("events_").over(w).alias("n_events"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, event_id % 4 = 0 AS unnamed FROM events), days AS (SELECT DISTINCT user_id, day FROM d)
  SELECT a.user_id, a.day, CASE WHEN count(CASE WHEN unnamed THEN NULL ELSE event_type END) > 0 THEN coalesce(bool_or(CASE WHEN unnamed THEN NULL ELSE event_type = 'purchase' END), false) END AS has_purchase, min(d.day) AS first_day, max(floor(d.value)) AS highest
  FROM days a JOIN d ON a.user_id = d.user_id AND d.day <= a.day GROUP BY 1, 2""")
def education_profile_by_time(spark, sf_dir):
    # flags, least and greatest grow with time, so running windows over a day's aggregates say what a triangular join would
    field = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    daily = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(field).alias("n"), sem.any_true(field == "purchase").alias("p"), F.max(F.floor("value").cast("double")).alias("h"))
    w = states.so_far(["user_id"], ["day"])
    flag = F.when(F.sum("n").over(w) > 0, states.cumulative_any(F.col("p"), w))
    return daily.select("user_id", "day", flag.alias("has_purchase"), F.min("day").over(w).alias("first_day"), F.max("h").over(w).alias("highest"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey IN (0, 1, 2) THEN 'Corporate' WHEN s_nationkey IN (3, 4) THEN 'Venture' WHEN s_nationkey = 5 THEN 'Angel' ELSE 'Other' END AS category FROM supplier""")
def investor_category_map(spark, sf_dir):
    mapping = {"0": "Corporate", "1": "Corporate", "2": "Corporate", "3": "Venture", "4": "Venture", "5": "Angel"}
    return table(spark, sf_dir, "supplier").select("s_suppkey", sem.mapped(F.col("s_nationkey").cast("string"), mapping, "Other").alias("category"))


def staged(spark, sf_dir) -> DataFrame:
    """Company-years with running states, the stage they make, the next different one, cut at the terminal one."""
    yearly = rounds(spark, sf_dir).groupBy("o_custkey", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount"), sem.any_true((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 350000)).alias("exit"),
        sem.any_true((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000)).alias("later"),
    )
    panel = skeleton(spark, sf_dir).join(yearly, ["o_custkey", "year"], "left")
    w = states.so_far(["o_custkey"], ["year"])
    panel = panel.withColumns({"n_deals": F.sum(F.coalesce("n", F.lit(0))).over(w), "ever_later": states.cumulative_any(F.col("later"), w), "raised": F.coalesce("amount", F.lit(0.0)), "exit": F.coalesce("exit", F.lit(False))})
    stage = F.when(F.col("exit"), "Exit").when(F.col("ever_later"), "Later").when(F.col("n_deals") > 1, "Early")
    panel = panel.withColumn("stage", stage)
    panel = temporal.next_different(panel, ["o_custkey"], ["year"], "stage", "next_stage", "time_next").withColumn("left_", temporal.rows_left(["o_custkey"], ["year"]))
    panel = panel.withColumns({"time_next": F.coalesce("time_next", "left_"), "next_stage": F.coalesce("next_stage", F.lit("Stay"))})
    return states.truncate_at(panel, ["o_custkey"], ["year"], F.col("exit")).select("o_custkey", "first_year", "year", "age", "n_deals", "raised", "stage", "next_stage", "time_next")


STAGED = f"""{SKELETON}, yearly AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n, sum(o_totalprice) AS amount, bool_or(o_orderpriority = '1-URGENT' AND o_totalprice > 350000) AS ex, bool_or(o_orderstatus = 'P' AND o_totalprice > 200000) AS later FROM orders GROUP BY 1, 2),
  p AS (SELECT s.*, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n_deals, coalesce(amount, 0.0) AS raised, coalesce(ex, false) AS ex, max(CASE WHEN later THEN 1 ELSE 0 END) OVER w = 1 AS ever_later, max(CASE WHEN ex THEN 1 ELSE 0 END) OVER w AS ended,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY s.o_custkey) AS k FROM skeleton s LEFT JOIN yearly y ON s.o_custkey = y.o_custkey AND s.year = y.year WINDOW w AS (PARTITION BY s.o_custkey ORDER BY s.year ROWS UNBOUNDED PRECEDING)),
  q AS (SELECT *, CASE WHEN ex THEN 'Exit' WHEN ever_later THEN 'Later' WHEN n_deals > 1 THEN 'Early' END AS stage FROM p),
  nx AS (SELECT a.o_custkey, a.year, arg_min(b.stage, b.i) AS next_stage, min(b.i) - a.i AS t FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND b.i > a.i AND a.stage <> b.stage GROUP BY a.o_custkey, a.year, a.i),
  staged AS (SELECT q.o_custkey, first_year, q.year, age, n_deals, raised, stage, coalesce(next_stage, 'Stay') AS next_stage, CAST(coalesce(t, k - i) AS BIGINT) AS time_next FROM q LEFT JOIN nx ON q.o_custkey = nx.o_custkey AND q.year = nx.year WHERE ended = 0)"""


@query(f"WITH {STAGED} SELECT o_custkey, year, age, n_deals, round(raised, 4) AS raised, stage, next_stage, time_next FROM staged")
def growth_cascade(spark, sf_dir):
    return staged(spark, sf_dir).select("o_custkey", "year", "age", "n_deals", F.round("raised", 4).alias("raised"), "stage", "next_stage", "time_next")


@query(f"""WITH {SKELETON}, named AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, arg_min(o_orderkey % 5, (o_orderdate, o_orderkey)) AS ceo FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
  roles AS (SELECT o_custkey, o_orderkey % 5 AS person, CAST(min(year(o_orderdate)) AS BIGINT) AS a, CAST(max(year(o_orderdate)) AS BIGINT) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
  f AS (SELECT s.o_custkey, s.year, last_value(ceo IGNORE NULLS) OVER w AS declared, first_value(ceo IGNORE NULLS) OVER (PARTITION BY s.o_custkey ORDER BY s.year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_ceo,
    max(CASE WHEN ceo IS NOT NULL THEN s.year END) OVER w AS said FROM skeleton s LEFT JOIN named n ON s.o_custkey = n.o_custkey AND s.year = n.year WINDOW w AS (PARTITION BY s.o_custkey ORDER BY s.year ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT f.o_custkey, f.year, count(person) AS n, min(person) AS person, min(a) AS a FROM f LEFT JOIN roles r ON f.o_custkey = r.o_custkey AND f.year BETWEEN a AND b GROUP BY 1, 2)
  SELECT f.o_custkey, f.year, CAST(CASE WHEN declared IS NULL AND n = 1 AND person = first_ceo THEN person WHEN declared IS NOT NULL AND n = 1 AND a > said AND person <> declared THEN person ELSE declared END AS BIGINT) AS ceo,
    CASE WHEN declared IS NULL AND n = 1 AND person = first_ceo THEN 'filled' WHEN declared IS NOT NULL AND n = 1 AND a > said AND person <> declared THEN 'corrected' WHEN declared IS NOT NULL THEN 'declared' END AS how
  FROM f JOIN c ON f.o_custkey = c.o_custkey AND f.year = c.year""")
def ceo_resolution(spark, sf_dir):
    r, key = rounds(spark, sf_dir), ["o_custkey"]
    named = r.filter("o_orderkey % 2 = 0").groupBy("o_custkey", "year").agg(F.min_by(F.col("o_orderkey") % 5, F.struct("day", "o_orderkey")).alias("ceo"))
    roles = r.filter("o_orderstatus = 'F'").groupBy("o_custkey", (F.col("o_orderkey") % 5).alias("person")).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    f = skeleton(spark, sf_dir).select("o_custkey", "year").join(named, ["o_custkey", "year"], "left")
    said = F.max(F.when(F.col("ceo").isNotNull(), F.col("year"))).over(states.so_far(key, ["year"]))
    first = F.first("ceo", ignorenulls=True).over(Window.partitionBy(*key).orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    f = f.select("o_custkey", "year", temporal.forward_fill(F.col("ceo"), key, ["year"]).alias("declared"), first.alias("first_ceo"), said.alias("said"))
    covering = temporal.within(f.select("o_custkey", "year"), roles, key, "year", "a", "b", "left").groupBy("o_custkey", "year").agg(F.count("person").alias("n"), F.min("person").alias("person"), F.min("a").alias("a"))
    f = f.join(covering, ["o_custkey", "year"])
    one = F.col("n") == 1
    filled = F.col("declared").isNull() & one & (F.col("person") == F.col("first_ceo"))
    corrected = F.col("declared").isNotNull() & one & (F.col("a") > F.col("said")) & (F.col("person") != F.col("declared"))
    return f.select("o_custkey", "year", F.when(filled | corrected, F.col("person")).otherwise(F.col("declared")).alias("ceo"), F.when(filled, "filled").when(corrected, "corrected").when(F.col("declared").isNotNull(), "declared").alias("how"))


def peer_pairs(spark, sf_dir) -> DataFrame:
    """A customer's declared peers: the next four customer numbers, with a similarity; directed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    pairs = c.select("c_custkey", "c_nationkey", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3, 4)))).alias("step"))
    pairs = pairs.withColumns({"peer": F.col("c_custkey") + F.col("step"), "similarity": 1.0 / F.col("step"), "rival": F.col("step") % 2 == 1})
    return pairs.join(c.select(F.col("c_custkey").alias("peer"), F.col("c_nationkey").alias("peer_nation")), "peer").withColumn("same_country", (F.col("c_nationkey") == F.col("peer_nation")).cast("long"))


def peer_columns(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair is made one first, then counted; `pairs` should be partitioned by the first key, else a task aggregates all pairs that it reads."""
    rival = F.col("rival")
    by_peer = pairs.groupBy(*keys, "peer").agg(F.max(rival.cast("int")).alias("rival"), F.sum(F.when(rival, F.col("same_country")).otherwise(0)).alias("same"), F.sum("similarity").alias("sum"), F.count("similarity").alias("n"))
    return by_peer.groupBy(*keys).agg(F.count_if(F.col("rival") == 1).alias("n_competitors"), F.sum("same").alias("same_country"), F.round(F.sum("sum") / F.sum("n"), 6).alias("similarity"), F.count("peer").alias("n_similar"))


PAIRS = "pairs AS (SELECT a.c_custkey, b.c_custkey AS peer, 1.0 / step AS similarity, step % 2 = 1 AS rival, CASE WHEN a.c_nationkey = b.c_nationkey THEN 1 ELSE 0 END AS same FROM customer a, (VALUES (1), (2), (3), (4)) t(step), customer b WHERE b.c_custkey = a.c_custkey + step)"
PEERS = "count(DISTINCT CASE WHEN rival THEN peer END) AS n_competitors, CAST(sum(CASE WHEN rival THEN same ELSE 0 END) AS BIGINT) AS same_country, round(avg(CAST(similarity AS DOUBLE)), 6) AS similarity, count(DISTINCT peer) AS n_similar"


@query(f"WITH {SKELETON}, {PAIRS} SELECT c_custkey, s.year, {PEERS} FROM skeleton s JOIN pairs ON s.o_custkey = c_custkey JOIN lives l ON l.o_custkey = peer AND s.year BETWEEN l.first_year AND l.last_year GROUP BY 1, 2")
def peer_columns_timed(spark, sf_dir):
    alive = peer_pairs(spark, sf_dir).join(lives(spark, sf_dir).withColumnRenamed("o_custkey", "peer"), "peer")
    years = skeleton(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), "year")
    return peer_columns(temporal.within(years, alive, ["c_custkey"], "year", "first_year", "last_year"), ["c_custkey", "year"])


@query(f"WITH {PAIRS} SELECT c_custkey, {PEERS} FROM pairs GROUP BY 1")
def peer_columns_snapshot(spark, sf_dir):
    return peer_columns(peer_pairs(spark, sf_dir).repartition("c_custkey"), ["c_custkey"])


@query("""SELECT o_custkey, count(*) AS n_rounds, CAST(sum(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_undated, CAST(sum(CASE WHEN o_orderkey % 6 = 0 AND o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS n_lost
  FROM orders GROUP BY 1 HAVING sum(CASE WHEN o_orderkey % 6 = 0 AND o_totalprice > 250000 THEN 1 ELSE 0 END) > 0""")
def lost_rounds_report(spark, sf_dir):
    undated = F.col("o_orderkey") % 6 == 0
    return rounds(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rounds"), F.count_if(undated).alias("n_undated"), F.count_if(undated & (F.col("o_totalprice") > 250000)).alias("n_lost")).filter("n_lost > 0")


WINDOWED = """early AS (SELECT DISTINCT o_custkey FROM staged WHERE stage = 'Early'),
  ages AS (SELECT o_custkey, min(age) AS a0, max(age) AS a1 FROM staged WHERE stage IS NOT NULL AND o_custkey IN (SELECT o_custkey FROM early) GROUP BY 1),
  wd AS (SELECT s.o_custkey, s.year, s.n_deals, s.raised, s.stage, CASE WHEN t.age + t.time_next <= a0 + 3 AND t.next_stage <> 'Stay' THEN t.next_stage ELSE t.stage END AS target FROM ages a JOIN staged s ON s.o_custkey = a.o_custkey AND s.age = a0
    JOIN staged t ON t.o_custkey = a.o_custkey AND t.age = least(a0 + 3, a1) WHERE a0 <= 2 AND s.first_year + s.age <= 1998)"""


@query(f"WITH {STAGED}, {WINDOWED} SELECT o_custkey, year, n_deals, stage, target, CAST(CASE WHEN target IN ('Later', 'Exit') THEN 1 ELSE 0 END AS BIGINT) AS label FROM wd")
def windowed_dataset(spark, sf_dir):
    from tidemark.plans.dataset import windowed

    out = windowed(staged(spark, sf_dir), horizon=3, oldest_start=2, last_decision=1998)
    return out.select("o_custkey", "year", "n_deals", "stage", "target", F.col("target").isin("Later", "Exit").cast("long").alias("label"))


@query(f"""WITH {STAGED}, {WINDOWED} SELECT w.o_custkey, w.target, round(sum(s.raised), 4) AS raised, round(avg(s.n_deals), 6) AS mean_deals, arg_max(s.age, s.age) AS age, max(s.n_deals) AS n_deals FROM wd w JOIN staged s ON w.o_custkey = s.o_custkey GROUP BY 1, 2""")
def full_history_dataset(spark, sf_dir):
    from tidemark.plans.dataset import full_history, windowed

    panel = staged(spark, sf_dir)
    w = windowed(panel, horizon=3, oldest_start=2, last_decision=1998)
    out = full_history(panel, w.select("o_custkey", "target"), summed=["raised"], averaged={"mean_deals": "n_deals"}, last=["age", "n_deals"])
    return out.withColumns({"raised": F.round("raised", 4), "mean_deals": F.round("mean_deals", 6)})


@query("""WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS b, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c FROM customer)
  SELECT c_custkey, CAST(b AS BIGINT) AS b, c FROM d WHERE (b IS NULL)::INT + (c IS NULL)::INT <= 1""")
def missing_policy(spark, sf_dir):
    from tidemark.plans.dataset import drop_missing

    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 2 == 0, F.col("c_acctbal")).alias("a"), F.when(k % 5 != 0, F.col("c_nationkey").cast("long")).alias("b"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("c"))
    return drop_missing(d, least_share=0.45, most_in_row=1)


@query("SELECT d.doc_id, d.lang, d.n_chars, CAST(l.toxic AS BIGINT) AS target FROM documents d JOIN labels l USING (doc_id)")
def target_swap(spark, sf_dir):
    from tidemark.plans.dataset import swap_target

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("target")), "doc_id")
    return swap_target(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("target")), "doc_id")


@query("SELECT doc_id, n_chars, CAST(quality AS BIGINT) AS target FROM documents JOIN labels USING (doc_id)")
def ablation(spark, sf_dir):
    from tidemark.plans.dataset import ablate

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("target")), "doc_id")
    return ablate(docs, ["lang", "source", "not_there"])


FREQUENCIES = "n AS (SELECT count(*) AS n FROM documents), k AS (SELECT source AS category, count(*) / max(n.n) AS share FROM documents, n WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.05 * max(n.n)), t AS (SELECT * FROM k UNION ALL SELECT 'Others', 1 - coalesce(sum(share), 0) FROM k)"


@query(f"WITH {FREQUENCIES} SELECT category, round(share, 9) AS share FROM t")
def frequency_encoding_fit(spark, sf_dir):
    return statistics.frequency_table(table(spark, sf_dir, "documents").select("source"), "source", 0.05).withColumn("share", F.round("share", 9))


@query(f"WITH {FREQUENCIES} SELECT doc_id, round(coalesce((SELECT share FROM t WHERE category = source), (SELECT share FROM t WHERE category = 'Others')), 9) AS share FROM documents")
def frequency_encoding_apply(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return statistics.apply_frequencies(docs, "source", statistics.frequency_table(docs, "source", 0.05), "share").select("doc_id", F.round("share", 9).alias("share"))


@query("""WITH r AS (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761 + 40503) % 1000003, doc_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels)
  SELECT CAST(quality AS BIGINT) AS quality, CASE WHEN i <= floor(n * 0.6 + 0.5) THEN 'train' WHEN i <= floor(n * 0.8 + 0.5) THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2""")
def stratified_split_counts(spark, sf_dir):
    place = F.struct((F.col("doc_id") * 2654435761 + 40503) % 1000003, "doc_id")
    out = statistics.stratified_split(table(spark, sf_dir, "labels"), ["quality"], place, [("train", 0.6), ("validation", 0.8), ("test", 1.0)])
    return out.groupBy(F.col("quality").cast("long").alias("quality"), "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS s FROM documents)
  SELECT doc_id, round((n_chars - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS scaled FROM documents, q""")
def robust_scale(spark, sf_dir):
    return statistics.robust_scale(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "scaled").select("doc_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH q AS (SELECT lang, quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS s FROM documents GROUP BY 1)
  SELECT doc_id, round((n_chars - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS scaled FROM documents JOIN q USING (lang)""")
def robust_scale_by_group(spark, sf_dir):
    return statistics.robust_scale(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "scaled", ["lang"]).select("doc_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS price FROM part), known AS (SELECT * FROM p WHERE price IS NOT NULL),
  near AS (SELECT a.p_partkey, b.price, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_partkey) AS i FROM p a JOIN known b ON a.price IS NULL)
  SELECT p_partkey, round(coalesce(price, (SELECT avg(price) FROM near n WHERE n.p_partkey = p.p_partkey AND i <= 5)), 6) AS price FROM p""")
def knn_impute(spark, sf_dir):
    from tidemark.plans.imputation import impute_nearest

    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("price"))
    return impute_nearest(parts, "p_partkey", ["size"], "price", neighbours=5).select("p_partkey", F.round("price", 6).alias("price"))


SCORED = "s AS (SELECT doc_id, quality = 1 AS pos, round(((doc_id * 7919) % 1009) / 1009.0 * 0.7 + 0.3 * quality * ((doc_id % 3) / 2.0), 3) AS score FROM labels)"


def scored(spark, sf_dir) -> DataFrame:
    score = ((F.col("doc_id") * 7919) % 1009) / F.lit(1009.0) * 0.7 + 0.3 * F.col("quality") * ((F.col("doc_id") % 3) / F.lit(2.0))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("pos"), F.round(score, 3).alias("score"))


@query(f"""WITH {SCORED}, c AS (SELECT score, sum(pos::INT) AS p, sum((NOT pos)::INT) AS n FROM s GROUP BY 1), t AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM c)
  SELECT score AS threshold, round(CAST(fp AS DOUBLE) / nn, 9) AS fpr, round(CAST(tp AS DOUBLE) / np, 9) AS tpr, round(CAST(tp AS DOUBLE) / (tp + fp), 9) AS precision FROM t""")
def curve_point_data(spark, sf_dir):
    points = statistics.curve_points(scored(spark, sf_dir), "score", F.col("pos"))
    return points.select("threshold", *(F.round(c, 9).alias(c) for c in ("fpr", "tpr", "precision")))


@query(f"""WITH {SCORED}, c AS (SELECT score, sum(pos::INT) AS p, sum((NOT pos)::INT) AS n FROM s GROUP BY 1), t AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM c)
  SELECT round(CAST(sum(p * (nn - fp + n / 2.0)) AS DOUBLE) / (max(np) * max(nn)), 9) AS auc, round(sum(CAST(p AS DOUBLE) / np * tp / (tp + fp)), 9) AS average_precision, round(CAST(max(np) AS DOUBLE) / (max(np) + max(nn)), 9) AS prevalence FROM t""")
def auc_ap_metrics(spark, sf_dir):
    m = statistics.ranking_metrics(scored(spark, sf_dir), "score", F.col("pos"))
    return m.select(*(F.round(c, 9).alias(c) for c in ("auc", "average_precision", "prevalence")))


@query(f"""WITH {SCORED}, c AS (SELECT score, sum(pos::INT) AS p, sum((NOT pos)::INT) AS n FROM s GROUP BY 1), t AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS np FROM c),
  f AS (SELECT score, round(CAST(2 * tp AS DOUBLE) / (tp + fp + np), 12) AS f1 FROM t) SELECT CAST(score AS DOUBLE) AS threshold, f1 FROM f ORDER BY f1 DESC, score LIMIT 1""")
def f1_optimal_threshold(spark, sf_dir):
    return statistics.best_f1_threshold(scored(spark, sf_dir), "score", F.col("pos"))


RUNS = "runs AS (SELECT CAST(doc_id % 5 AS BIGINT) AS seed, CASE WHEN doc_id % 2 = 0 THEN 'lr' ELSE 'rf' END AS model, avg(CASE WHEN (score >= 0.5) = pos THEN 1.0 ELSE 0.0 END) AS accuracy FROM s GROUP BY 1, 2)"


def run_metrics(spark, sf_dir) -> DataFrame:
    s = scored(spark, sf_dir).withColumns({"seed": F.col("doc_id") % 5, "model": F.when(F.col("doc_id") % 2 == 0, "lr").otherwise("rf")})
    return statistics.confusion_metrics(s, F.col("pos"), F.col("score") >= 0.5, ["seed", "model"])


@query(f"WITH {SCORED}, {RUNS} SELECT model, count(*) AS n_seeds, round(avg(accuracy), 9) AS mean, round(coalesce(stddev_samp(accuracy), 0), 9) AS deviation FROM runs GROUP BY 1")
def seed_mean_std(spark, sf_dir):
    from tidemark.plans.evaluation import over_seeds

    out = over_seeds(run_metrics(spark, sf_dir), ["model"], ["accuracy"])
    return out.select("model", "n_seeds", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query(f"""WITH {SCORED}, {RUNS}, m AS (SELECT model, round(avg(accuracy), 4) AS mean FROM runs GROUP BY 1)
  SELECT 'accuracy' AS metric, a.mean AS lr, b.mean AS rf, round(100.0 * (b.mean - a.mean) / a.mean, 6) AS change FROM m a, m b WHERE a.model = 'lr' AND b.model = 'rf'""")
def metric_comparison(spark, sf_dir):
    from tidemark.plans.evaluation import compare_models

    return compare_models(run_metrics(spark, sf_dir), "model", ["accuracy"], "lr", "rf")


@query("""WITH d AS (SELECT l_linestatus, round(abs(x), 12) AS size, x FROM (SELECT l_linestatus, l_quantity - floor(l_extendedprice / 1000) AS x FROM lineitem) WHERE x <> 0),
  r AS (SELECT *, rank() OVER (PARTITION BY l_linestatus ORDER BY size) + (count(*) OVER (PARTITION BY l_linestatus, size) - 1) / 2.0 AS rk FROM d)
  SELECT l_linestatus, count(*) AS n, CAST(sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN x < 0 THEN rk ELSE 0 END) AS DOUBLE) AS w_minus FROM r GROUP BY 1""")
def wilcoxon_w_statistic(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_quantity", F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("other"))
    difference = F.round(F.col("l_quantity") - F.col("other"), 12)
    return statistics.signed_ranks(pairs, difference, F.lit(0.0), ["l_linestatus"]).select("l_linestatus", "n", "w_plus", "w_minus")


@query("""WITH d AS (SELECT l_orderkey, round(l_extendedprice - 1500 * l_quantity, 2) AS x FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(x)) AS rk FROM d WHERE x <> 0),
  k AS (SELECT l_orderkey, CAST(count(x) FILTER (WHERE x <> 0) AS BIGINT) AS n, count(*) FILTER (WHERE x = 0) AS zeros, count(DISTINCT abs(x)) FILTER (WHERE x <> 0) AS sizes FROM d GROUP BY 1),
  w AS (SELECT l_orderkey, sum(CASE WHEN x > 0 THEN rk ELSE 0 END) AS up, sum(CASE WHEN x < 0 THEN rk ELSE 0 END) AS down FROM r GROUP BY 1),
  subsets AS (SELECT m, n, (SELECT coalesce(sum(i), 0) FROM range(1, n + 1) t(i) WHERE (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT n, unnest(range(CAST(2 ** n AS BIGINT))) AS m FROM (SELECT DISTINCT n FROM k))),
  tails AS (SELECT n, s, count(*) AS c FROM subsets GROUP BY 1, 2)
  SELECT k.l_orderkey, k.n, CASE WHEN k.n = 0 THEN 1.0 WHEN zeros = 0 AND sizes = k.n THEN round(least(1.0, 2.0 * (SELECT sum(c) FROM tails t WHERE t.n = k.n AND t.s <= least(up, down)) / 2 ** k.n), 9) END AS p_value
  FROM k LEFT JOIN w USING (l_orderkey)""")
def signed_rank_p_values(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") - 1500 * F.col("l_quantity"), 2).alias("x"))
    found = statistics.signed_ranks(pairs, F.col("x"), F.lit(0.0), ["l_orderkey"])
    return found.select("l_orderkey", "n", F.when(F.col("exact") | (F.col("n") == 0), F.round("p_value", 9)).alias("p_value"))


@query("""WITH a AS (SELECT event_type AS feature, avg(abs(value)) AS v, row_number() OVER (ORDER BY avg(abs(value)) DESC, event_type) AS r FROM events WHERE event_id % 2 = 0 GROUP BY 1),
  b AS (SELECT event_type AS feature, avg(abs(value)) AS v, row_number() OVER (ORDER BY avg(abs(value)) DESC, event_type) AS r FROM events WHERE event_id % 2 = 1 GROUP BY 1)
  SELECT b.feature, a.r AS rank_first, b.r AS rank_second, a.r - b.r AS shift FROM b JOIN a USING (feature)""")
def feature_rank_shift(spark, sf_dir):
    from tidemark.plans.evaluation import rank_shift

    e = events(spark, sf_dir).select(F.col("event_type").alias("feature"), "value", (F.col("event_id") % 2).alias("half"))
    return rank_shift(e.filter("half = 0"), e.filter("half = 1"), "feature", "value", top=20)


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_discount), 6) AS price_discount, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem""")
def correlation_matrix(spark, sf_dir):
    from tidemark.plans.evaluation import correlations

    names = {("l_quantity", "l_extendedprice"): "quantity_price", ("l_quantity", "l_discount"): "quantity_discount", ("l_extendedprice", "l_discount"): "price_discount", ("l_discount", "l_tax"): "discount_tax"}
    return correlations(table(spark, sf_dir, "lineitem"), names)
