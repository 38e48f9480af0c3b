"""Time series: a user's events of one type are a price series, users are the sources of a market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import rounded
from tessera.operators import market as mk
from tessera.operators import temporal as tp
from tessera.sources.tables import load

from .catalog import named

AS_OF = "2024-01-20 00:00:00"
SERIES = ["user_id", "event_type"]


@named("""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT user_id, event_type, max(value) FILTER (a = 1) AS opening, max(value) FILTER (z = 1) AS latest,
  round(max(value) FILTER (z = 1) - max(value) FILTER (a = 1), 6) AS change, min(ts) AS opened_at, max(ts) AS latest_at, count(*) AS ticks
FROM e GROUP BY user_id, event_type
""")
def series_open_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening, latest, change and ticks of every series."""
    return tp.series_bounds(load(spark, sf_dir, "events"), SERIES, "ts", "event_id", "value").withColumn("change", rounded(F.col("change")))


@named(f"""
SELECT user_id, event_type, value AS closing, ts AS closed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts < TIMESTAMP '{AS_OF}') WHERE rn = 1
""")
def series_close_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of each series before a fixed start."""
    e = load(spark, sf_dir, "events").filter(F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz")).select(*SERIES, "ts", "event_id", "value")
    return tp.latest_per_key(e, SERIES, ["ts", "event_id"]).select(*SERIES, F.col("value").alias("closing"), F.col("ts").alias("closed_at"))


@named("""
SELECT event_id, user_id, event_type, step FROM (
  SELECT *, lag(step) OVER w AS before, row_number() OVER w AS rn FROM (SELECT *, CAST(floor(value / 10) AS BIGINT) AS step FROM events)
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE rn = 1 OR step IS DISTINCT FROM before
""")
def change_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks that change their series; repeats of the standing value are dropped."""
    e = load(spark, sf_dir, "events").withColumn("step", F.floor(F.col("value") / 10))
    return tp.changes(e, SERIES, ["ts", "event_id"], ["step"], F.to_date("ts")).select("event_id", *SERIES, "step")


@named(f"""
WITH s AS (SELECT user_id, event_type, max(date_trunc('second', ts)) AS last, user_id % 240 - 20 AS hours_left FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id, event_type),
h AS (SELECT *, epoch(TIMESTAMP '{AS_OF}') - epoch(last) AS age FROM s)
SELECT user_id, event_type, CASE
  WHEN event_type = 'click' AND age <= 120 THEN 'live' WHEN event_type = 'click' THEN 'stale'
  WHEN hours_left <= 0 THEN 'closed'
  WHEN hours_left <= 3 AND age <= 1800 THEN 'fresh'
  WHEN hours_left > 3 AND hours_left <= 24 AND age <= 7200 THEN 'fresh'
  WHEN hours_left > 24 AND hours_left <= 168 AND age <= 43200 THEN 'fresh'
  WHEN hours_left > 168 AND age <= 129600 THEN 'fresh'
  ELSE 'stale' END AS freshness
FROM h
""")
def freshness_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each series' last price fresh enough for how soon its market starts?"""
    at = F.lit(AS_OF).cast("timestamp_ntz")
    s = load(spark, sf_dir, "events").filter(F.col("ts") <= at).groupBy(*SERIES).agg(F.max(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("last"))
    start = F.timestamp_add("HOUR", (F.pmod("user_id", F.lit(240)) - 20).cast("int"), at)
    return s.select(*SERIES, mk.freshness(F.col("last"), at, start, F.col("event_type") == "click").alias("freshness"))


@named("""
WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT event_type, count(*) AS sources, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS lowest, max(value) AS highest, round(max(value) - min(value), 6) AS spread
FROM l GROUP BY event_type
""")
def consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, range and number of sources of each market's latest prices."""
    e = load(spark, sf_dir, "events").select(*SERIES, "ts", "event_id", "value")
    return mk.consensus(tp.latest_per_key(e, SERIES, ["ts", "event_id"]), ["event_type"], "value")


@named(f"""
WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR) WHERE rn = 1)
SELECT event_type, count(*) AS sources, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS lowest, max(value) AS highest, round(max(value) - min(value), 6) AS spread
FROM l GROUP BY event_type
""")
def consensus_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus at a fixed time from prices of the 48 hours before."""
    return mk.consensus_as_of(load(spark, sf_dir, "events"), ["event_type"], ["user_id"], "ts", "event_id", "value", AS_OF, 48)


@named(f"""
WITH b AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS n, arg_max(value, (ts, event_id)) FILTER (ts <= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR) AS t
  FROM events WHERE ts <= TIMESTAMP '{AS_OF}' AND event_id % 10 <> 0 AND value IS NOT NULL GROUP BY user_id, event_type),
m AS (SELECT event_type, count(*) AS sources, quantile_cont(t, 0.5) AS x, quantile_cont(n, 0.5) AS y FROM b WHERE t IS NOT NULL GROUP BY event_type)
SELECT event_type, sources, round(x, 6) AS before, round(y, 6) AS after, round(y - x, 6) AS move, CASE WHEN y > x THEN 'shortened' ELSE 'drifted' END AS direction,
  CAST(floor(x / 0.5) AS BIGINT) AS from_band, CAST(floor(y / 0.5) AS BIGINT) AS band FROM m WHERE sources >= 2 AND abs(y - x) >= 0.5
""")
def market_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets whose median over the sources priced at both times moved by a threshold since ten days before; one price in ten is suspended."""
    return mk.moved(load(spark, sf_dir, "events"), ["event_type"], ["user_id"], "ts", "event_id", "value", AS_OF, 240, 0.5, open_=F.col("event_id") % 10 != 0)


@named("""
WITH c AS (SELECT o_orderstatus AS market, o_orderpriority AS outcome, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT market, sum(n) AS m FROM c GROUP BY market),
w AS (SELECT market, outcome, CASE WHEN market = 'P' AND outcome = '5-LOW' THEN NULL ELSE round(n * 1.06 / m, 8) END AS implied FROM c JOIN t USING (market)),
bad AS (SELECT market FROM w GROUP BY market HAVING count(*) < 2 OR bool_or(implied IS NULL OR implied <= 0 OR implied >= 1)),
s AS (SELECT market, sum(implied) AS a FROM w WHERE market NOT IN (SELECT market FROM bad) GROUP BY market)
SELECT market, outcome, implied, round(a, 8) AS overround, round(implied / a, 8) AS share FROM w LEFT JOIN s USING (market)
""")
def devig_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proportional shares of whole markets: priorities within an order status; one market lacks a price and has none."""
    c = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("market"), F.col("o_orderpriority").alias("outcome")).agg(F.count("*").alias("n"))
    met = c.join(c.groupBy("market").agg(F.sum("n").alias("m")), "market")
    implied = F.when((F.col("market") == "P") & (F.col("outcome") == "5-LOW"), None).otherwise(F.round(F.col("n") * 1.06 / F.col("m"), 8))
    return mk.fair_shares(met.select("market", "outcome", implied.cast("double").alias("implied")), ["market"], "implied")


@named("""
WITH p AS (SELECT p_partkey, CAST(p_partkey * 7 % 1201 - 600 AS DOUBLE) AS odds FROM part),
v AS (SELECT p_partkey, odds, CASE WHEN odds >= 100 OR odds <= -100 THEN odds END AS a FROM p),
d AS (SELECT *, round(CASE WHEN a > 0 THEN 1 + a / 100 ELSE 1 - 100 / a END, 6) AS decimal_odds, round(CASE WHEN a > 0 THEN 100 / (a + 100) ELSE a / (a - 100) END, 8) AS implied FROM v)
SELECT p_partkey, CAST(odds AS BIGINT) AS american, decimal_odds, implied, CAST(CASE WHEN decimal_odds >= 2 THEN round((decimal_odds - 1) * 100) ELSE -round(100 / (decimal_odds - 1)) END AS BIGINT) AS again,
  CAST(CASE WHEN implied >= 0.5 THEN -round(100 * implied / (1 - implied)) ELSE round(100 * (1 - implied) / implied) END AS BIGINT) AS by_probability FROM d
""")
def odds_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """American odds to decimal odds and implied probability, and back; odds between -100 and 100 are none."""
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 1201 - 600).cast("double").alias("odds"))
    d, implied = mk.decimal_from_american(F.col("odds")), mk.implied_from_american(F.col("odds"))
    return p.select("p_partkey", F.col("odds").cast("long").alias("american"), d.alias("decimal_odds"), implied.alias("implied"), mk.american_from_decimal(d).alias("again"), mk.american_from_probability(implied).alias("by_probability"))


@named("""
SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return tp.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@named("""
SELECT l_orderkey, l_linenumber AS revision, l_shipdate AS known_at, l_returnflag AS result FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) AS rn
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-01-01') WHERE rn = 1
""")
def as_of_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision of each order that was known at a cutoff."""
    order = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    found = tp.as_of(l, ["l_orderkey"], {"l_shipdate": "1998-01-01 00:00:00"}, order)
    return found.select("l_orderkey", F.col("l_linenumber").alias("revision"), F.col("l_shipdate").alias("known_at"), F.col("l_returnflag").alias("result"))


@named("""
WITH o AS (SELECT *, o_orderkey - 1 AS replaces FROM orders WHERE o_orderkey % 4 IN (1, 2)), a AS (SELECT o_orderkey, NULL AS replaces FROM orders WHERE o_orderkey % 4 IN (0, 3) UNION ALL SELECT o_orderkey, replaces FROM o)
SELECT a.o_orderkey, replaces FROM a WHERE NOT EXISTS (SELECT 1 FROM a AS b WHERE b.replaces = a.o_orderkey)
""")
def current_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that nothing supersedes: every four orders are a chain of three and one alone."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when((F.col("o_orderkey") % 4).isin(1, 2), F.col("o_orderkey") - 1).alias("replaces"))
    return tp.current_revisions(o, "o_orderkey", "replaces")


@named("""
SELECT c, count(*) AS orders FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY l_orderkey) GROUP BY c
""")
def revision_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders have how many revisions."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("c")).groupBy("c").agg(F.count("*").alias("orders"))


@named("""
WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS near_id, ts AS near_at FROM events WHERE event_type = 'view'),
m AS (SELECT a.user_id, event_id, near_id, abs(date_diff('second', date_trunc('second', near_at), date_trunc('second', ts))) AS gap FROM a JOIN b ON a.user_id = b.user_id)
SELECT user_id, event_id, near_id, gap AS gap_seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY gap, near_id) AS rn FROM m WHERE gap <= 172800) WHERE rn = 1
""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view nearest to each purchase within two days."""
    e = load(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    a = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    b = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("near_id"), F.col("ts").alias("near_at"))
    return tp.nearest_in_time(a, b, ["user_id"], "event_id", "ts", "near_id", "near_at", 2)


@named("""
SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 25 THEN 'medium' WHEN p_size < 40 THEN 'large' ELSE 'huge' END AS band FROM part
""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size band of each part."""
    bands = [("small", None, 10), ("medium", 10, 25), ("large", 25, 40), ("huge", 40, None)]
    return tp.interval_of(load(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size"), bands, "band")


@named("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS a, max(l_shipdate) AS z FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT x.o_custkey, x.o_orderkey AS first_id, y.o_orderkey AS second_id FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.z AND y.a <= x.z
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a customer's orders that were open at the same time."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    ends = l.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("z"))
    s = o.join(ends, o.o_orderkey == ends.l_orderkey).select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("a"), "z")
    return tp.overlapping(s, ["o_custkey"], "o_orderkey", "a", "z", days=60)


@named("""
SELECT date_trunc('week', ts) AS week, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM events GROUP BY ALL
""")
def week_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their sums by week."""
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@named("""
SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL
""")
def decade_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by decade and status."""
    return load(spark, sf_dir, "orders").groupBy((F.floor(F.year("o_orderdate") / 10) * 10).cast("long").alias("decade"), "o_orderstatus").agg(F.count("*").alias("n"))


@named("""
WITH g AS (SELECT *, CASE WHEN date_diff('second', lag(s) OVER w, s) <= 21600 THEN 0 ELSE 1 END AS new FROM (SELECT *, date_trunc('second', ts) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM g)
SELECT user_id, min(s) AS started_at, count(*) AS n FROM n GROUP BY user_id, k
""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events at most six hours apart."""
    e = load(spark, sf_dir, "events").withColumn("s", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    s = F.session_window("s", "6 hours 1 microsecond")
    return e.groupBy("user_id", s).agg(F.min("s").alias("started_at"), F.count("*").alias("n")).select("user_id", "started_at", "n")
