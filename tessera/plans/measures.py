"""Measures: the metric registry and panel statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import half_up, ratio, rounded
from tessera.operators import metrics as mt
from tessera.operators import records as rc
from tessera.operators.metrics import Metric
from tessera.sources.tables import load

from .catalog import named

CUTOFF = "2001-01-01 00:00:00"



def registry() -> list[Metric]:
    return [
        Metric("activity.orders", F.col("n"), F.col("n")),
        Metric("activity.days_since_last", F.col("days_since"), F.col("n")),
        Metric("activity.last_12_months", F.col("last_year"), F.col("n")),
        Metric("activity.average_gap", F.when(F.col("n") >= 2, ratio(F.col("span"), F.col("n") - 1)), F.col("n"), 2),
        Metric("results.finished_rate", ratio(F.col("finished"), F.col("decided")), F.col("decided"), 5),
        Metric("results.urgent_share_of_finished", ratio(F.col("urgent_finished"), F.col("finished")), F.col("finished"), 5),
        Metric("results.open_rate", ratio(F.col("open_"), F.col("decided")), F.col("decided"), 5),
        Metric("value.large_orders", F.col("large"), F.col("n")),
    ]


def wide(orders: DataFrame) -> DataFrame:
    """One aggregate per customer that every metric reads, from orders known by the cutoff."""
    cut, at = F.lit(CUTOFF).cast("timestamp_ntz"), F.col("o_orderdate")
    is_ = lambda s: F.col("o_orderstatus") == s
    return orders.filter(at <= cut).groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.date_diff(cut, F.max(at)).alias("days_since"), F.count_if(F.date_diff(cut, at) <= 365).alias("last_year"),
        F.date_diff(F.max(at), F.min(at)).alias("span"), F.count_if(is_("F")).alias("finished"), F.count_if(is_("O")).alias("open_"),
        F.count_if(is_("F") | is_("O")).alias("decided"), F.count_if(is_("F") & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent_finished"),
        F.count_if(F.col("o_totalprice") > 300000).alias("large"),
    )


@named(f"""
WITH w AS (SELECT o_custkey, count(*) AS n, date_diff('day', max(o_orderdate), TIMESTAMP '{CUTOFF}') AS days_since, count(*) FILTER (date_diff('day', o_orderdate, TIMESTAMP '{CUTOFF}') <= 365) AS last_year,
  date_diff('day', min(o_orderdate), max(o_orderdate)) AS span, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open_, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS decided,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS urgent_finished, count(*) FILTER (o_totalprice > 300000) AS large FROM orders WHERE o_orderdate <= TIMESTAMP '{CUTOFF}' GROUP BY o_custkey),
m AS (SELECT o_custkey, unnest([
  {{'metric': 'activity.orders', 'v': n::DOUBLE, 's': n, 'l': 1}}, {{'metric': 'activity.days_since_last', 'v': days_since::DOUBLE, 's': n, 'l': 1}}, {{'metric': 'activity.last_12_months', 'v': last_year::DOUBLE, 's': n, 'l': 1}},
  {{'metric': 'activity.average_gap', 'v': CASE WHEN n >= 2 THEN span::DOUBLE / (n - 1) END, 's': n, 'l': 2}}, {{'metric': 'results.finished_rate', 'v': finished::DOUBLE / nullif(decided, 0), 's': decided, 'l': 5}},
  {{'metric': 'results.urgent_share_of_finished', 'v': urgent_finished::DOUBLE / nullif(finished, 0), 's': finished, 'l': 5}}, {{'metric': 'results.open_rate', 'v': open_::DOUBLE / nullif(decided, 0), 's': decided, 'l': 5}},
  {{'metric': 'value.large_orders', 'v': large::DOUBLE, 's': n, 'l': 1}}]) AS x FROM w)
SELECT o_custkey, x.metric AS metric, 1 AS version, CASE WHEN x.s < x.l THEN 'insufficient_sample' WHEN x.v IS NULL THEN 'not_applicable' ELSE 'available' END AS status,
  CASE WHEN x.s >= x.l THEN floor(x.v * 10000 + 0.5) / 10000 END AS value, x.s AS sample FROM m
""")
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered metrics of each customer at a cutoff, in long form."""
    return mt.told(wide(load(spark, sf_dir, "orders")), ["o_custkey"], registry())


@named("""
SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open_, count(*) FILTER (o_orderstatus = 'P') AS partial,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS pressing, count(*) FILTER (o_totalprice > 300000) AS large, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 300000) AS large_finished,
  count(DISTINCT year(o_orderdate)) AS years, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey
""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's record: conditional counts in one aggregation."""
    s, p, big = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice") > 300000
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("open_"), F.count_if(s == "P").alias("partial"), F.count_if(p == "1-URGENT").alias("urgent"),
        F.count_if(p.isin("1-URGENT", "2-HIGH")).alias("pressing"), F.count_if(big).alias("large"), F.count_if((s == "F") & big).alias("large_finished"),
        F.count_distinct(F.year("o_orderdate")).alias("years"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"),
    )


@named("""
WITH w AS (SELECT l_orderkey, l_quantity, count(*) OVER p AS n, sum(l_quantity) OVER p AS s, l_suppkey FROM lineitem WINDOW p AS (PARTITION BY l_orderkey))
SELECT l_suppkey, count(*) AS panels, round(sum(CAST(abs(l_quantity - (s - l_quantity) / (n - 1)) AS DECIMAL(28,10)))::DOUBLE / count(*), 6) AS distance FROM w WHERE n >= 3 GROUP BY l_suppkey
""")
def leave_one_out_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each supplier's quantities are from the mean of the others in their orders, in panels of three or more."""
    from pyspark.sql import Window

    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    w = mt.leave_one_out(l, ["l_orderkey"], "l_quantity").withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).filter("n >= 3")
    distance = F.abs(F.col("l_quantity") - F.col("others_mean")).cast("decimal(28,10)")
    return w.groupBy("l_suppkey").agg(F.count("*").alias("panels"), rounded(F.sum(distance).cast("double") / F.count("*")).alias("distance"))


@named("""
WITH v AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT k, CAST(sum(n) AS BIGINT) AS m FROM v GROUP BY k),
o AS (SELECT x.k, x.f, x.n AS members, t.m - 1 AS others, max(y.n - CASE WHEN y.f = x.f THEN 1 ELSE 0 END) AS top, arg_max(y.f, y.n - CASE WHEN y.f = x.f THEN 1 ELSE 0 END) AS g
  FROM v x JOIN v y ON x.k = y.k JOIN t ON t.k = x.k GROUP BY x.k, x.f, x.n, t.m),
c AS (SELECT f AS l_returnflag, CAST(sum(members) AS BIGINT) AS lines, CAST(coalesce(sum(members) FILTER (others >= 2 AND top * 2 > others), 0) AS BIGINT) AS comparable,
  CAST(coalesce(sum(members) FILTER (others >= 2 AND top * 2 > others AND g <> f), 0) AS BIGINT) AS different FROM o GROUP BY f)
SELECT *, CASE WHEN comparable >= 10 THEN floor(CAST(different AS DOUBLE) / comparable * 10000 + 0.5) / 10000 END AS rate FROM c
""")
def majority_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a line's flag differs from the strict majority of the other lines of its order, of two others at least."""
    found = mt.against_others(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag").groupBy("l_returnflag").agg(F.sum("members").alias("lines"), F.sum("comparable").alias("comparable"), F.sum("different").alias("different"))
    return found.withColumn("rate", F.when(F.col("comparable") >= 10, half_up(ratio(F.col("different"), F.col("comparable")))))


@named("""
WITH s AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS price FROM orders GROUP BY o_custkey),
p AS (SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer)
SELECT p.a, p.b, x.n - y.n AS d_n, round(x.price - y.price, 8) AS d_price FROM p JOIN s x ON x.o_custkey = p.a JOIN s y ON y.o_custkey = p.b
""")
def matchup_differentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two customers' measures for neighbours of one nation."""
    from pyspark.sql import Window

    s = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("price"))
    p = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("b"))
    return mt.differentials(s, p, "o_custkey", "a", "b", ["n", "price"]).select("a", "b", "d_n", F.round("d_price", 8).alias("d_price"))


@named("""
SELECT a.l_orderkey, a.l_suppkey AS side, b.l_suppkey AS other, a.l_quantity - b.l_quantity AS margin FROM
  (SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber = 2) b ON a.l_orderkey = b.l_orderkey
""")
def participations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sides of each order: its first and second line's suppliers."""
    l = load(spark, sf_dir, "lineitem")
    a = l.filter("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("side"), F.col("l_quantity").alias("q"))
    b = l.filter("l_linenumber = 2").select("l_orderkey", F.col("l_suppkey").alias("other"), F.col("l_quantity").alias("p"))
    return a.join(b, "l_orderkey").select("l_orderkey", "side", "other", (F.col("q") - F.col("p")).alias("margin"))


@named("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'split' END AS family,
  concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_totalprice > 400000 THEN 'large' END, CASE WHEN o_totalprice < 5000 THEN 'small' END) AS flags FROM orders
""")
def result_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's family of results and its flags."""
    flags = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_totalprice") > 400000, "large"), F.when(F.col("o_totalprice") < 5000, "small"))
    family = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "pending").otherwise("split")
    return load(spark, sf_dir, "orders").select("o_orderkey", family.alias("family"), F.array_join(F.array_compact(flags), ",").alias("flags"))


@named("""
WITH j AS (SELECT l_orderkey, count(*) AS judges, count(*) FILTER (l_quantity > 25) AS a, count(*) FILTER (l_quantity < 25) AS b, count(*) FILTER (l_quantity = 25) AS d, bool_or(l_partkey % 50 = 0) AS void FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, judges,
  CASE WHEN void THEN NULL WHEN judges = 1 AND d = 1 THEN 'draw' WHEN judges = 1 OR a > judges / 2 OR b > judges / 2 THEN 'win' ELSE 'draw' END AS outcome,
  CASE WHEN void OR (judges = 1 AND d = 1) THEN NULL WHEN a > judges / 2 THEN 'a' WHEN b > judges / 2 THEN 'b' END AS winner_side,
  CASE WHEN void THEN NULL WHEN judges = 1 THEN 'referee' WHEN a = judges OR b = judges OR d = judges THEN 'unanimous'
    WHEN (a > judges / 2 AND b = 0) OR (b > judges / 2 AND a = 0) THEN 'majority' WHEN a > judges / 2 OR b > judges / 2 THEN 'split' WHEN d > judges / 2 THEN 'majority' ELSE 'split' END AS decision_type
FROM j
""")
def decision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a panel's cards amount to; a card of a part divisible by 50 lacks its total."""
    q = F.col("l_quantity")
    j = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("judges"), F.count_if(q > 25).alias("a"), F.count_if(q < 25).alias("b"), F.count_if(F.col("l_partkey") % 50 == 0).alias("missing"))
    outcome, side, kind = rc.decision(*map(F.col, ("judges", "a", "b", "missing")))
    return j.select("l_orderkey", "judges", outcome.alias("outcome"), side.alias("winner_side"), kind.alias("decision_type"))


@named("""
WITH m AS (SELECT l_suppkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, floor(CAST(count(*) FILTER (CAST(q AS DOUBLE) / n > 25.5) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 AS share, count(*) AS rounds FROM m WHERE l_linenumber >= 3 GROUP BY l_suppkey HAVING count(*) >= 3
""")
def nested_round_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of late rounds with a mean margin over a bound: an aggregate of aggregates."""
    m = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("mean")).filter("l_linenumber >= 3")
    found = m.groupBy("l_suppkey").agg(half_up(ratio(F.count_if(F.col("mean") > 25.5), F.count("*"))).alias("share"), F.count("*").alias("rounds"))
    return found.filter("rounds >= 3")
