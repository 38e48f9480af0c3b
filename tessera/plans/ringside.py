"""Cards, results and weights on the test tables: an order is a bout, a supplier's lines in it are its card, a line's flag and tax its rounds' points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ringside as rg
from tessera.sources.tables import load

from .catalog import named

CARD = """
WITH r AS (SELECT l_orderkey AS o, l_suppkey AS j, l_linenumber AS n, CASE l_returnflag WHEN 'R' THEN 9 ELSE 10 END AS pa, CASE WHEN l_tax < 0.03 THEN 9 WHEN l_tax > 0.07 AND l_partkey % 50 = 0 THEN 11 ELSE 10 END AS pb, l_partkey % 7 = 0 AS ded FROM lineitem),
c AS (SELECT o, j, count(*) AS rounds, count(DISTINCT n) AS numbers, max(n) AS last, max(CASE WHEN pb > 10 THEN 1 ELSE 0 END) AS out_, max(CASE WHEN greatest(pa, pb) < 10 AND NOT ded THEN 1 ELSE 0 END) AS no_ten, sum(pa) AS sa, sum(pb) AS sb FROM r GROUP BY ALL),
t AS (SELECT *, CASE WHEN o % 4 = 0 THEN 3 END AS scheduled, CASE WHEN o % 8 = 4 THEN 1 END AS stopped, CASE WHEN o % 10 = 9 AND j % 3 = 0 THEN NULL ELSE sa + CASE WHEN j % 17 = 0 THEN 1 ELSE 0 END END AS ta, sb AS tb FROM c)
"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, j, rounds, a_total, b_total, scheduled and stopped of each card."""
    l = load(spark, sf_dir, "lineitem")
    a = F.when(F.col("l_returnflag") == "R", 9).otherwise(10)
    b = F.when(F.col("l_tax") < 0.03, 9).when((F.col("l_tax") > 0.07) & (F.col("l_partkey") % 50 == 0), 11).otherwise(10)
    each = l.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("j"), F.struct(F.col("l_linenumber").alias("round"), a.alias("a"), b.alias("b"), (F.col("l_partkey") % 7 == 0).alias("deduction")).alias("r"))
    found = each.groupBy("o", "j").agg(F.collect_list("r").alias("rounds"), F.sum("r.a").alias("sa"), F.sum("r.b").alias("b_total"))
    o, j = F.col("o"), F.col("j")
    total = F.when(~((o % 10 == 9) & (j % 3 == 0)), F.col("sa") + (j % 17 == 0).cast("int"))
    return found.select("o", "j", "rounds", total.alias("a_total"), "b_total", F.when(o % 4 == 0, 3).alias("scheduled"), F.when(o % 8 == 4, 1).alias("stopped"))


@named(CARD + """
SELECT o, j, array_to_string(list_filter([CASE WHEN numbers < rounds THEN 'duplicate_round' END, CASE WHEN last > scheduled THEN 'beyond_scheduled' END, CASE WHEN out_ = 1 THEN 'points_out_of_range' END, CASE WHEN no_ten = 1 THEN 'no_ten' END, CASE WHEN rounds <> coalesce(stopped, scheduled) THEN 'round_count' END, CASE WHEN ta <> sa OR tb <> sb THEN 'totals' END], lambda p: p IS NOT NULL), ',') AS problems FROM t
""")
def scorecard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each card."""
    c = judged(spark, sf_dir)
    return c.select("o", "j", F.array_join(rg.card_problems(F.col("rounds"), F.col("a_total"), F.col("b_total"), F.col("scheduled"), F.col("stopped")), ",").alias("problems"))


@named(CARD + """,
s AS (SELECT o, count(*) AS n, count(*) FILTER (ta > tb) AS a, count(*) FILTER (tb > ta) AS b, count(*) FILTER (ta IS NULL OR tb IS NULL) AS m FROM t GROUP BY o),
k AS (SELECT *, n - a - b AS d, CASE WHEN n = 1 THEN n - a - b = 0 ELSE greatest(a, b) * 2 > n END AS won FROM s),
d AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN won THEN 'win' ELSE 'draw' END END AS co, CASE WHEN won THEN CASE WHEN a > b THEN 'a' ELSE 'b' END END AS cs, CASE WHEN n = 1 THEN 'referee' WHEN won THEN CASE WHEN greatest(a, b) = n THEN 'unanimous' WHEN least(a, b) = 0 THEN 'majority' ELSE 'split' END WHEN d = n THEN 'unanimous' WHEN d * 2 > n THEN 'majority' ELSE 'split' END AS ck FROM k),
re AS (SELECT o_orderkey AS o, CASE WHEN o_orderstatus = 'P' THEN 'draw' ELSE 'win' END AS outcome, CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'b' END AS side, CASE o_orderpriority WHEN '1-URGENT' THEN 'KO' WHEN '2-HIGH' THEN 'TECHNICAL_DECISION' ELSE 'DECISION' END AS method, CASE o_orderkey % 4 WHEN 0 THEN 'unanimous' WHEN 1 THEN 'split' WHEN 2 THEN 'majority' END AS kind FROM orders)
SELECT re.o, array_to_string(list_filter([CASE WHEN method <> 'KO' AND n > 0 AND co IS NULL THEN 'cards_incomplete' END, CASE WHEN method <> 'KO' AND co <> outcome THEN 'outcome' END, CASE WHEN method <> 'KO' AND co = 'win' AND side <> cs THEN 'winner_side' END, CASE WHEN method <> 'KO' AND co IS NOT NULL AND kind <> ck THEN 'decision_type' END], lambda p: p IS NOT NULL), ',') AS problems FROM re LEFT JOIN d ON d.o = re.o
""")
def result_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where results of decisions contradict their cards."""
    p, s, k = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 4
    results = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("o"), F.when(s == "P", "draw").otherwise("win").alias("outcome"), F.when(s == "F", "a").when(s == "O", "b").alias("winner_side"),
        F.when(p == "1-URGENT", "KO").when(p == "2-HIGH", "TECHNICAL_DECISION").otherwise("DECISION").alias("method"), F.when(k == 0, "unanimous").when(k == 1, "split").when(k == 2, "majority").alias("decision_type"),
    )
    return rg.result_problems(results, judged(spark, sf_dir).select("o", "a_total", "b_total"), "o").select("o", F.array_join("problems", ",").alias("problems"))


@named("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 5 AS way, 120 + l_quantity AS v, l_suppkey % 9 AS s, CASE WHEN l_suppkey % 11 <> 0 THEN 150 + l_partkey % 12 END AS contracted, CASE l_partkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'ceremonial' ELSE 'rehydration' END AS kind, CASE l_suppkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'reported' ELSE 'unverified' END AS ver FROM lineitem),
p AS (SELECT *, CASE way WHEN 0 THEN v WHEN 1 THEN floor(v / 0.45359237 * 100 + 0.5) / 100 - 0 WHEN 2 THEN 11 * 14 + s + 0.5 WHEN 3 THEN 12.0 * 14 END AS lb FROM w), q AS (SELECT *, floor((lb - contracted) * 100 + 0.5) / 100 AS over_ FROM p),
r AS (SELECT *, CASE WHEN over_ > 0 THEN 'missed_weight' WHEN over_ IS NOT NULL THEN 'made_weight' ELSE 'recorded' END AS status FROM q)
SELECT status, CASE WHEN kind = 'official' AND ver = 'verified' AND status = 'missed_weight' THEN 'WEIGHT_MISSED' WHEN ver IN ('verified', 'reported') AND kind <> 'ceremonial' THEN 'WEIGH_IN_RESULT' END AS news, contracted <> 154 AS catchweight, count(*) AS n, round(sum(CASE WHEN over_ > 0 THEN over_ WHEN over_ IS NOT NULL THEN 0 END), 2) AS missed_by, round(sum(floor(lb * 0.45359237 * 1000 + 0.5) / 1000), 3) AS kg FROM r GROUP BY ALL
""")
def weigh_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in pounds, kilograms or stones (or unreadable) against what bouts are contracted at, and what is news of them."""
    v, way = 120 + F.col("l_quantity"), F.col("l_partkey") % 5
    text = F.when(way == 0, v.cast("string")).when(way == 1, v.cast("string")).when(way == 2, F.concat(F.lit("11st "), F.col("l_suppkey") % 9, F.lit(".5 lbs"))).when(way == 3, "12 stone").otherwise("on weight")
    unit = F.when(way == 1, "kg").when(way.isin(2, 3), "stone_lb").otherwise("lb")
    lb, contracted = rg.pounds(text, unit), F.when(F.col("l_suppkey") % 11 != 0, 150 + F.col("l_partkey") % 12)
    kind = F.when(F.col("l_partkey") % 3 == 0, "official").when(F.col("l_partkey") % 3 == 1, "ceremonial").otherwise("rehydration")
    said = F.when(F.col("l_suppkey") % 3 == 0, "verified").when(F.col("l_suppkey") % 3 == 1, "reported").otherwise("unverified")
    rows = load(spark, sf_dir, "lineitem").select(lb.alias("lb"), contracted.alias("contracted"), kind.alias("kind"), said.alias("said"))
    status, miss = rg.weighed(F.col("lb"), F.col("contracted"))
    rows = rows.withColumns({"status": status, "miss": miss}).withColumn("news", rg.weigh_in_news(F.col("kind"), F.col("said"), F.col("status"))).withColumn("catchweight", rg.catchweight(F.col("contracted"), F.lit(154)))
    return rows.groupBy("status", "news", "catchweight").agg(F.count("*").alias("n"), F.round(F.sum("miss"), 2).alias("missed_by"), F.round(F.sum(rg.kilograms(F.col("lb"))), 3).alias("kg"))


@named("""
WITH l AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses, count(*) FILTER (o_orderstatus = 'P') AS draws FROM orders WHERE o_custkey % 10 <> 4 GROUP BY 1),
c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') + CASE o_custkey % 5 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 0 END AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses, CASE WHEN o_custkey % 3 <> 0 THEN count(*) FILTER (o_orderstatus = 'P') + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END END AS draws FROM orders GROUP BY o_custkey)
SELECT k, CASE WHEN l.k IS NULL THEN 'no_ledger' WHEN c.wins < l.wins OR c.draws < l.draws THEN 'conflict' WHEN c.wins > l.wins OR c.draws > l.draws THEN 'ledger_short' ELSE 'agrees' END AS state FROM c LEFT JOIN l USING (k)
""")
def record_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' claimed records against the ledger of their orders."""
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    ledger = o.filter("k % 10 <> 4").groupBy("k").agg(n("F").alias("wins"), n("O").alias("losses"), n("P").alias("draws"))
    k = F.col("k")
    claims = o.groupBy("k").agg(n("F").alias("wins"), n("O").alias("losses"), n("P").alias("draws")).select(
        "k", (F.col("wins") + F.when(k % 5 == 1, 2).when(k % 5 == 2, -1).otherwise(0)).alias("wins"), "losses", F.when(k % 3 != 0, F.col("draws") + (k % 7 == 0).cast("int")).alias("draws")
    )
    return rg.record_check(claims, ledger, "k").select("k", "state")
