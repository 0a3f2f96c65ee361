"""The panel's own operators on frames made of the driver's tables, each with its SQL twin.

Roles as in `queries`; what a table lacks (dates unknown, statuses, founders) is made
by a rule on its keys that both sides share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import panel, people
from tidemark.plans.queries import LIVES, ORACLES, PAIRS, QUERIES, SKELETON, events, lives, peer_pairs, query, rounds, skeleton
from tidemark.plans.rules import Rules
from tidemark.plans.sources import Sources
from tidemark.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


@query(f"""WITH {LIVES}, y AS (SELECT o_custkey, first_year + 1 AS founded, last_year - 1 AS last FROM lives),
  p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN year(CAST(o_orderdate AS DATE) + 400) END AS e, o_orderkey % 11 = 0 AS founder FROM orders),
  j AS (SELECT *, CASE WHEN s IS NULL AND founder THEN founded WHEN s < founded THEN founded ELSE s END AS st, least(coalesce(e, last), last) AS en FROM p JOIN y USING (o_custkey))
  SELECT o_custkey AS "CompanyID", o_orderkey AS "PersonID", CAST(CASE WHEN founder THEN 0 ELSE st - founded END AS BIGINT) AS "DeltaStart", CAST(greatest(en, st) - founded AS BIGINT) AS "DeltaEnd" FROM j WHERE st IS NULL OR st <= last""")
def panel_presence_window(spark, sf_dir):
    key = F.col("o_orderkey")
    pairs = rounds(spark, sf_dir).select(F.col("o_custkey").alias("CompanyID"), key.alias("PersonID"), F.when(key % 5 != 0, F.col("day")).alias("StartDate"), F.when(key % 7 != 0, F.date_add("day", 400)).alias("EndDate"), (key % 11 == 0).alias("IsFounder"))
    years = lives(spark, sf_dir).select(F.col("o_custkey").alias("CompanyID"), (F.col("first_year") + 1).alias("YearFounded"), (F.col("last_year") - 1).alias("LastYear"))
    return people.presence_window(pairs, years).select("CompanyID", "PersonID", "DeltaStart", "DeltaEnd")


#: Flags of a round by a divisor of its key.
FLAGS = {"Is_Out": 13, "Is_Public_Exit": 17, "Is_MA": 19, "Is_LaterVC": 5, "Is_PE": 23, "Is_EarlyVC": 3, "Is_Seed": 2, "Is_Preseed": 29}


@query("""WITH s AS (SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'Out of Business' WHEN 1 THEN 'Publicly Held' WHEN 2 THEN 'Acquired/Merged' WHEN 3 THEN NULL ELSE 'Privately Held (backing)' END AS status FROM orders)
  SELECT k AS o_orderkey, CASE WHEN status = 'Out of Business' OR k % 13 = 0 THEN 'Out' WHEN status = 'Publicly Held' OR k % 17 = 0 THEN 'Exit_Public' WHEN status = 'Acquired/Merged' OR k % 19 = 0 THEN 'Exit_M&A'
    WHEN k % 5 = 0 OR k % 23 = 0 THEN 'LaterVC_or_Other' WHEN k % 3 = 0 THEN 'EarlyVC' WHEN k % 2 = 0 THEN 'Seed' WHEN k % 29 = 0 THEN 'Preseed' END AS stage FROM s""")
def panel_growth_stage(spark, sf_dir):
    key = F.col("o_orderkey")
    status = F.when(key % 7 == 0, "Out of Business").when(key % 7 == 1, "Publicly Held").when(key % 7 == 2, "Acquired/Merged").when(key % 7 > 3, "Privately Held (backing)")
    flagged = rounds(spark, sf_dir).withColumns({"OwnershipStatus": status, **{flag: key % n == 0 for flag, n in FLAGS.items()}})
    return flagged.select("o_orderkey", panel.growth_stage().alias("stage"))


@query("""SELECT o_custkey AS "CompanyID", count(*) AS rounds, count(*) FILTER (WHERE o_orderkey % 6 = 0) AS rounds_without_date, count(*) FILTER (WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 < 2) AS venture_rounds_without_date,
  count(*) FILTER (WHERE o_orderkey % 6 = 0) = count(*) AS loses_all FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 6 = 0) > 0""")
def panel_lost_rounds(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "Seed Round").when(key % 4 == 1, "Later Stage VC").when(key % 4 == 2, "Grant").otherwise("IPO")
    return panel.lost_rounds(rounds(spark, sf_dir).select(F.col("o_custkey").alias("CompanyID"), F.when(key % 6 != 0, F.col("year")).alias("Year"), kind.alias("DealType")))


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN year(o_orderdate) END AS y, o_totalprice FROM orders), h AS (SELECT l_suppkey, y, o_totalprice FROM lineitem JOIN d ON l_orderkey = o_orderkey WHERE y IS NOT NULL),
  m AS (SELECT a.l_suppkey, a.y, CAST(count(*) AS DOUBLE) AS n, median(o_totalprice) AS amount FROM (SELECT DISTINCT l_suppkey, y FROM h) a JOIN h ON a.l_suppkey = h.l_suppkey AND h.y <= a.y GROUP BY 1, 2)
  SELECT CAST(l_orderkey AS VARCHAR) AS "DealID", CAST(l.l_suppkey AS VARCHAR) AS "InvestorID", n AS "TotalInvestments", round(amount, 6) AS "MedianRoundAmount"
  FROM lineitem l LEFT JOIN d ON l_orderkey = o_orderkey LEFT JOIN m ON l.l_suppkey = m.l_suppkey AND d.y = m.y""")
def panel_participations(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    dated = F.when(F.col("o_orderkey") % 6 != 0, F.date_format("day", "MM/dd/yyyy"))
    frames = {
        "DealInvestorRelation": table(spark, sf_dir, "lineitem").select(text("l_orderkey").alias("DealID"), text("l_suppkey").alias("InvestorID"), F.col("l_returnflag").alias("InvestorStatus"), F.lit("No").alias("IsLeadInvestor")),
        "Investor": table(spark, sf_dir, "supplier").select(text("s_suppkey").alias("InvestorID"), F.lit("Corporation").alias("PrimaryInvestorType"), F.lit("40").alias("TotalInvestments"), F.lit("7").alias("MedianRoundAmount")),
        "Deal": rounds(spark, sf_dir).select(text("o_orderkey").alias("DealID"), dated.alias("DealDate"), text("o_totalprice").alias("DealSize")),
    }
    found = panel.participations(Sources(spark, frames=frames), Rules(), timed=True)
    return found.select("DealID", "InvestorID", "TotalInvestments", F.round("MedianRoundAmount", 6).alias("MedianRoundAmount"))


@query("""WITH g AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS year, CAST(sum((event_type = 'click')::INT) AS BIGINT) AS a, CAST(sum((event_type = 'view')::INT) AS BIGINT) AS b, CAST(sum((event_type NOT IN ('click', 'view'))::INT) AS BIGINT) AS c FROM events GROUP BY 1, 2)
  SELECT user_id AS "PersonID", year, CAST(sum(a) OVER w AS BIGINT) AS "Positions", CAST(sum(b) OVER w AS BIGINT) AS "Seats", CAST(sum(c) OVER w AS BIGINT) AS "OtherRoles" FROM g WINDOW w AS (PARTITION BY user_id ORDER BY year ROWS UNBOUNDED PRECEDING)""")
def panel_experience(spark, sf_dir):
    group = F.when(F.col("event_type") == "click", "Positions").when(F.col("event_type") == "view", "Seats").otherwise("OtherRoles")
    return people.experience(events(spark, sf_dir).select(F.col("user_id").alias("PersonID"), group.alias("group"), F.dayofmonth("ts").cast("long").alias("year")))


@query(f"""WITH {SKELETON}, {PAIRS} SELECT c_custkey AS "CompanyID", s.year AS "Year", count(DISTINCT CASE WHEN rival THEN peer END) AS "N_Competitors", count(*) FILTER (WHERE rival AND same = 1) AS "Same_Country",
  round(avg(CAST(similarity AS DOUBLE)), 6) AS "SimilarityScoreMean", count(DISTINCT peer) AS "N_Similar" FROM skeleton s JOIN pairs ON s.o_custkey = c_custkey JOIN lives l ON l.o_custkey = peer AND s.year BETWEEN l.first_year AND l.last_year GROUP BY 1, 2""")
def panel_peer_columns(spark, sf_dir):
    years = skeleton(spark, sf_dir).select(F.col("o_custkey").alias("CompanyID"), F.col("year").alias("Year"))
    alive = peer_pairs(spark, sf_dir).join(lives(spark, sf_dir).withColumnRenamed("o_custkey", "peer"), "peer")
    pairs = alive.select(F.col("c_custkey").alias("CompanyID"), F.col("peer").alias("SimilarCompanyID"), F.col("similarity").alias("Score"), "rival", (F.col("same_country") == 1).alias("same"), F.col("first_year").alias("YF"), F.col("last_year").alias("MY"))
    return panel.peer_columns(years, pairs, timed=True).withColumn("SimilarityScoreMean", F.round("SimilarityScoreMean", 6))
