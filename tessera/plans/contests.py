"""Ranked boards and contest metrics on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import ratio
from tessera.operators import metrics as mt
from tessera.operators import rankings as rk
from tessera.operators.metrics import Metric
from tessera.operators.temporal import top_per_key
from tessera.sources.tables import load

from .catalog import named

ENTRIES = """
WITH m AS (SELECT l_suppkey, year(l_shipdate) AS y, p_brand, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1997) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, y ORDER BY q DESC, p_brand) AS rn FROM m),
e AS (SELECT l_suppkey, y, rn AS position, rn = 1 AND q % 5 <> 0 AS champion, rn = 1 AND q % 5 = 0 AS vacant, CASE WHEN rn > 1 THEN rn - 1 END AS rank, r AS flags, n,
  CASE WHEN CAST(right(p_brand, 1) AS INTEGER) = 3 THEN 'name:' || replace(lower(p_brand), '#', ' ') ELSE 'id:' || p_brand END AS key, CASE WHEN r >= 3 THEN 'returned' END AS designation, CASE WHEN n >= 6 THEN TRUE WHEN n >= 3 THEN FALSE END AS mandatory
  FROM r WHERE rn <= 15)
"""


@named(ENTRIES + """,
p AS (SELECT * FROM e WHERE y = 1996 AND NOT vacant), c AS (SELECT * FROM e WHERE y = 1997 AND NOT vacant), listed AS (SELECT DISTINCT l_suppkey FROM e WHERE y = 1997),
f AS (SELECT coalesce(c.l_suppkey, p.l_suppkey) AS l_suppkey, coalesce(c.key, p.key) AS key, c.key IS NOT NULL AS now, p.key IS NOT NULL AS before, coalesce(c.position, p.position) AS position, CASE WHEN c.key IS NOT NULL THEN c.rank ELSE p.rank END AS rank, p.rank AS old_rank, c.rank AS new_rank,
  c.champion AS cc, p.champion AS pc, c.designation AS cd, p.designation AS pd, c.mandatory AS cm, p.mandatory AS pm FROM c FULL JOIN p ON c.l_suppkey = p.l_suppkey AND c.key = p.key),
t AS (
  SELECT *, CASE WHEN cc THEN 'new_champion_listed' ELSE 'new_entrant' END AS type FROM f WHERE now AND NOT before
  UNION ALL SELECT *, 'removed' FROM f WHERE before AND NOT now
  UNION ALL SELECT *, CASE WHEN cc THEN 'became_champion' ELSE 'no_longer_champion' END FROM f WHERE now AND before AND cc <> pc
  UNION ALL SELECT *, CASE WHEN new_rank < old_rank THEN 'moved_up' ELSE 'moved_down' END FROM f WHERE now AND before AND cc = pc AND NOT cc AND new_rank <> old_rank
  UNION ALL SELECT *, 'designation_changed' FROM f WHERE now AND before AND cd IS DISTINCT FROM pd
  UNION ALL SELECT *, 'mandatory_changed' FROM f WHERE now AND before AND cm <> pm),
b AS (SELECT l_suppkey, max(key) FILTER (y = 1996 AND champion) AS was, max(key) FILTER (y = 1997 AND champion) AS is_, coalesce(bool_or(vacant) FILTER (y = 1997), FALSE) AS gap FROM e GROUP BY l_suppkey),
a AS (SELECT l_suppkey, type, key, position, rank, CASE WHEN type LIKE 'moved%' THEN old_rank END AS previous_rank, CASE WHEN type LIKE 'moved%' THEN abs(new_rank - old_rank) END AS places, key LIKE 'name:%' AS unresolved FROM t JOIN listed USING (l_suppkey)
  UNION ALL SELECT l_suppkey, CASE WHEN is_ IS NULL THEN 'title_vacant_in_ranking' ELSE 'champion_changed' END, NULL, NULL, NULL, NULL, NULL, FALSE FROM b JOIN listed USING (l_suppkey) WHERE was IS NOT NULL AND ((is_ IS NULL AND gap) OR is_ <> was))
SELECT *, list_position(['champion_changed', 'title_vacant_in_ranking', 'became_champion', 'no_longer_champion', 'new_champion_listed', 'moved_up', 'moved_down', 'new_entrant', 'removed', 'designation_changed', 'mandatory_changed'], type) AS type_order FROM a
""")
def ranking_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of change between the lists of brands that each supplier sold most of in two years."""
    l = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"), "l_quantity", "l_returnflag").filter(F.col("y").isin(1996, 1997))
    sold = l.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_suppkey", "y", "p_brand")
    sums = sold.agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    top = top_per_key(sums, ["l_suppkey", "y"], [F.desc("q"), F.asc("p_brand")], 15)
    lead, open_ = F.col("rn") == 1, F.col("q") % 5 == 0
    entries = top.select(
        "l_suppkey", "y", F.col("rn").alias("position"), F.when(~lead, F.col("rn") - 1).alias("rank"), F.when(lead, "C").otherwise((F.col("rn") - 1).cast("string")).alias("rank_label"),
        F.when(~F.col("p_brand").endswith("3"), F.col("p_brand")).alias("entity_id"), F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  ")).alias("source_name"), (lead & ~open_).alias("is_champion"), (lead & open_).alias("is_vacant"),
        F.when(F.col("r") >= 3, "returned").alias("designation"), F.when(F.col("n") >= 6, True).when(F.col("n") >= 3, False).alias("mandatory"),
    )
    return rk.ranking_changes(entries.filter("y = 1996"), entries.filter("y = 1997"), ["l_suppkey"])


CUTOFF = "2001-01-01 00:00:00"


def contests(lines: DataFrame) -> DataFrame:
    """Lines known by the cutoff as contests: outcome by return flag, method by quantity, round by line number, coverage of knockdowns by supplier."""
    cut, q = F.lit(CUTOFF).cast("timestamp_ntz"), F.col("l_quantity")
    return lines.filter(F.col("l_shipdate") < cut).select(
        "l_suppkey", F.date_diff(cut, "l_shipdate").alias("age"), F.col("l_returnflag").alias("outcome"), F.when(q <= 15, "KO").when(q <= 25, "TKO").when(q <= 30, "RTD").when(q <= 48, "DECISION").when(q <= 49, "DQ").alias("method"),
        F.when(q <= 30, F.col("l_linenumber")).alias("round"), F.when(F.col("l_tax") > 0.035, 12).otherwise(8).alias("scheduled"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linenumber")).alias("knockdowns"),
    )


def contest_registry() -> list[Metric]:
    c = F.col
    return [
        Metric("activity.contests", c("n"), c("n"), 0),
        Metric("activity.rounds", c("rounds"), c("rounds_known")),
        Metric("activity.days_since_last", c("since"), c("n")),
        Metric("activity.last_12_months", c("year1"), c("n"), 0),
        Metric("activity.last_24_months", c("year2"), c("n"), 0),
        Metric("activity.average_gap", F.when(c("n") >= 2, ratio(c("span"), c("n") - 1)), c("n"), 2),
        Metric("results.win_rate", ratio(c("wins"), c("n")), c("n"), 5),
        Metric("results.stoppage_win_share", ratio(c("stopped"), c("wins")), c("wins"), 5),
        Metric("results.decision_win_share", ratio(c("outpointed"), c("wins")), c("wins"), 5),
        Metric("results.distance_rate", ratio(c("distance"), c("methods")), c("methods"), 5),
        Metric("results.stoppage_loss_rate", ratio(c("lost_early"), c("n")), c("n"), 5),
        Metric("finishing.stoppage_win_rate", ratio(c("stopped"), c("n")), c("n"), 5),
        Metric("finishing.early_stoppage_share", ratio(c("early"), c("stopped")), c("stopped"), 3),
        Metric("finishing.late_stoppage_share", ratio(c("late"), c("stopped_long")), c("stopped_long"), 3),
        Metric("durability.stoppage_losses", c("lost_early"), c("n"), 0),
        Metric("durability.knockdowns_suffered", ratio(c("suffered"), c("covered")), c("covered"), 5, covered=c("covered")),
    ]


@named(f"""
WITH b AS (SELECT l_suppkey, date_diff('day', l_shipdate, TIMESTAMP '{CUTOFF}') AS age, l_returnflag AS o, l_quantity AS q, l_linenumber AS r, l_tax > 0.035 AS twelve, l_suppkey % 4 <> 0 AS cover FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUTOFF}'),
w AS (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN q <= 30 THEN r - 1 WHEN q <= 48 THEN CASE WHEN twelve THEN 12 ELSE 8 END END) AS rounds, count(*) FILTER (q <= 48) AS rounds_known, min(age) AS since, count(*) FILTER (age <= 365) AS year1, count(*) FILTER (age <= 730) AS year2,
  max(age) - min(age) AS span, count(*) FILTER (o = 'A') AS wins, count(*) FILTER (o = 'A' AND q <= 30) AS stopped, count(*) FILTER (o = 'A' AND q > 30 AND q <= 48) AS outpointed, count(*) FILTER (q > 30 AND q <= 48) AS distance, count(*) FILTER (q <= 49) AS methods,
  count(*) FILTER (o = 'R' AND q <= 30) AS lost_early, count(*) FILTER (o = 'A' AND q <= 30 AND r <= 3) AS early, count(*) FILTER (o = 'A' AND q <= 30 AND twelve) AS stopped_long, count(*) FILTER (o = 'A' AND q <= 30 AND twelve AND r >= 9) AS late,
  count(*) FILTER (cover) AS covered, sum(r) FILTER (cover) AS suffered FROM b GROUP BY l_suppkey),
m AS (SELECT l_suppkey, unnest([
  {{'k': 'activity.contests', 'v': n::DOUBLE, 's': n, 'l': 0, 'u': FALSE}}, {{'k': 'activity.rounds', 'v': rounds::DOUBLE, 's': rounds_known, 'l': 1, 'u': FALSE}}, {{'k': 'activity.days_since_last', 'v': since::DOUBLE, 's': n, 'l': 1, 'u': FALSE}},
  {{'k': 'activity.last_12_months', 'v': year1::DOUBLE, 's': n, 'l': 0, 'u': FALSE}}, {{'k': 'activity.last_24_months', 'v': year2::DOUBLE, 's': n, 'l': 0, 'u': FALSE}}, {{'k': 'activity.average_gap', 'v': span::DOUBLE / nullif(n - 1, 0), 's': n, 'l': 2, 'u': FALSE}},
  {{'k': 'results.win_rate', 'v': wins::DOUBLE / n, 's': n, 'l': 5, 'u': FALSE}}, {{'k': 'results.stoppage_win_share', 'v': stopped::DOUBLE / nullif(wins, 0), 's': wins, 'l': 5, 'u': FALSE}}, {{'k': 'results.decision_win_share', 'v': outpointed::DOUBLE / nullif(wins, 0), 's': wins, 'l': 5, 'u': FALSE}},
  {{'k': 'results.distance_rate', 'v': distance::DOUBLE / nullif(methods, 0), 's': methods, 'l': 5, 'u': FALSE}}, {{'k': 'results.stoppage_loss_rate', 'v': lost_early::DOUBLE / n, 's': n, 'l': 5, 'u': FALSE}}, {{'k': 'finishing.stoppage_win_rate', 'v': stopped::DOUBLE / n, 's': n, 'l': 5, 'u': FALSE}},
  {{'k': 'finishing.early_stoppage_share', 'v': early::DOUBLE / nullif(stopped, 0), 's': stopped, 'l': 3, 'u': FALSE}}, {{'k': 'finishing.late_stoppage_share', 'v': late::DOUBLE / nullif(stopped_long, 0), 's': stopped_long, 'l': 3, 'u': FALSE}}, {{'k': 'durability.stoppage_losses', 'v': lost_early::DOUBLE, 's': n, 'l': 0, 'u': FALSE}},
  {{'k': 'durability.knockdowns_suffered', 'v': suffered::DOUBLE / nullif(covered, 0), 's': covered, 'l': 5, 'u': covered = 0}}]) AS x FROM w)
SELECT l_suppkey, x.k AS metric, 1 AS version, CASE WHEN x.u THEN 'source_unavailable' WHEN x.s < x.l THEN 'insufficient_sample' WHEN x.v IS NULL THEN 'not_applicable' ELSE 'available' END AS status,
  CASE WHEN x.s >= x.l THEN floor(x.v * 10000 + 0.5) / 10000 END AS value, x.s AS sample FROM m
""")
def contest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity, results, finishing and durability of each supplier, all from one wide aggregate."""
    b = contests(load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_linenumber", "l_tax"))
    early, won, lost = F.col("method").isin("KO", "TKO", "RTD"), F.col("outcome") == "A", F.col("outcome") == "R"
    rounds = F.when(early, F.col("round") - 1).when(F.col("method") == "DECISION", F.col("scheduled"))
    n = F.count_if
    wide = b.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum(rounds).alias("rounds"), F.count(rounds).alias("rounds_known"), F.min("age").alias("since"), n(F.col("age") <= 365).alias("year1"), n(F.col("age") <= 730).alias("year2"),
        (F.max("age") - F.min("age")).alias("span"), n(won).alias("wins"), n(won & early).alias("stopped"), n(won & (F.col("method") == "DECISION")).alias("outpointed"), n(F.col("method") == "DECISION").alias("distance"),
        F.count("method").alias("methods"), n(lost & early).alias("lost_early"), n(won & early & (F.col("round") <= 3)).alias("early"), n(won & early & (F.col("scheduled") > 8)).alias("stopped_long"),
        n(won & early & (F.col("scheduled") > 8) & (F.col("round") >= 9)).alias("late"), F.count("knockdowns").alias("covered"), F.sum("knockdowns").alias("suffered"),
    )
    return mt.told(wide, ["l_suppkey"], contest_registry())
