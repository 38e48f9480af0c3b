"""Recording and folding facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import rounded, slug
from tessera.operators import records as rc
from tessera.sources.shared import PAIRS_A_LINE, dealt
from tessera.sources.tables import load

from .catalog import named

AS_OF = "2024-01-20 00:00:00"


@named("""
SELECT user_id, event_id, b AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision FROM (
  SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, sha256(event_type) AS b FROM events)) WHERE n = 1 OR b IS DISTINCT FROM p
""")
def content_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a user as revisions: a new one only where the content's hash changed."""
    e = load(spark, sf_dir, "events").withColumn("content", F.sha2("event_type", 256))
    return rc.revisions(e, ["user_id"], ["ts", "event_id"], "content").select("user_id", "event_id", "content", F.col("revision").cast("long").alias("revision"))


@named("""
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS view, arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id
""")
def card_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a change log leads to: the last value of each field."""
    return rc.folded_fields(load(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["ts", "event_id"], ["view", "click", "purchase"])


@named("""
SELECT l_suppkey, coalesce(CASE WHEN s_suppkey IS NULL THEN 'not registered' WHEN NOT s_acctbal > 0 THEN 'closed' END, 'accepted') AS gate, count(*) AS n
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) ON l_suppkey = s_suppkey GROUP BY ALL
""")
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines accepted and refused by whether their supplier is registered and open."""
    gates = load(spark, sf_dir, "supplier").filter("s_nationkey <> 3").withColumnRenamed("s_suppkey", "l_suppkey")
    good, bad = rc.gated(load(spark, sf_dir, "lineitem").select("l_suppkey"), gates, "l_suppkey", F.col("s_acctbal") > 0)
    return good.withColumn("reason", F.lit("accepted")).unionByName(bad).groupBy("l_suppkey", F.col("reason").alias("gate")).agg(F.count("*").alias("n"))


@named(f"""
SELECT user_id, event_type, event_id, ts < TIMESTAMP '2024-01-19 00:00:00' AS seed FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-19 00:00:00' AND TIMESTAMP '{AS_OF}'
UNION ALL SELECT user_id, event_type, event_id, true FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-19 00:00:00') WHERE rn = 1
""")
def tick_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a day and the tick that stood before it for each series."""
    e = load(spark, sf_dir, "events")
    return rc.seeded_window(e, ["user_id", "event_type"], "ts", "event_id", "2024-01-19 00:00:00", AS_OF).select("user_id", "event_type", "event_id", "seed")


@named("""
WITH n AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 13), r AS (SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 3)
SELECT c_custkey, coalesce(n.n_name, r.r_name, 'unregistered') AS jurisdiction FROM customer JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN n ON c_nationkey = n.n_nationkey LEFT JOIN r ON a.n_regionkey = r.r_regionkey
""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's jurisdiction: the registered nation, else the registered region, else unregistered."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    found = rc.first_match(c, [(n.filter("n_nationkey < 13"), {"c_nationkey": "n_nationkey"}, "n_name"), (r.filter("r_regionkey <> 3"), {"n_regionkey": "r_regionkey"}, "r_name")], "jurisdiction", "unregistered")
    return found.select("c_custkey", "jurisdiction")


@named("""
WITH h AS (SELECT c_nationkey, c_mktsegment, arg_max({'h': CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 2 END}, (c_acctbal, c_custkey)).h AS holder, CAST(min(c_custkey) % 120 AS BIGINT) AS age
  FROM (SELECT * REPLACE (CAST(c_custkey AS BIGINT) AS c_custkey) FROM customer) GROUP BY ALL),
x AS (SELECT *, age > min(age) OVER (PARTITION BY c_nationkey) + 90 AS old FROM h),
t AS (SELECT c_nationkey, count(*) AS docs, count(*) FILTER (old) AS stale FROM x GROUP BY c_nationkey),
o AS (SELECT c_nationkey, holder, count(*) AS n FROM x WHERE NOT old AND holder IS NOT NULL GROUP BY ALL),
m AS (SELECT c_nationkey, count(*) AS holders, max(n) AS belts, min(holder) FILTER (n = 5) AS holder FROM o GROUP BY c_nationkey)
SELECT c_nationkey, CASE WHEN belts = 5 THEN 'undisputed' WHEN belts >= 2 THEN 'unified' WHEN docs < 5 OR stale > 0 THEN 'incomplete' ELSE 'none' END AS state,
  docs = 5 AND stale = 0 AS complete, coalesce(holders, 0) AS holders, coalesce(belts, 0) AS belts, holder FROM t LEFT JOIN m USING (c_nationkey)
""")
def derived_unification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one holder has a nation's titles of all segments, by documents not 90 days older than the nation's newest."""
    c = load(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey").cast("long"))
    top = F.max_by(F.struct(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 2).alias("holder")), F.struct("c_acctbal", "c_custkey"))
    held = c.groupBy("c_nationkey", "c_mktsegment").agg(top.holder.alias("holder"), (F.min("c_custkey") % 120).alias("age"))
    return rc.unified(held, ["c_nationkey"], "c_mktsegment", "holder", "age", 5, 90)


@named("""
WITH s AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS side, l_quantity FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_suppkey AS a, b.l_suppkey AS b, CASE WHEN a.l_quantity = b.l_quantity THEN 'draw' WHEN a.l_quantity + b.l_quantity > 95 THEN 'void' ELSE 'decided' END AS outcome,
  CASE WHEN a.l_quantity > b.l_quantity THEN a.l_suppkey ELSE b.l_suppkey END AS winner FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.side = 1 AND b.side = 2),
x AS (SELECT l_orderkey, a AS me, outcome, winner FROM p UNION ALL SELECT l_orderkey, b, outcome, winner FROM p)
SELECT me, CASE WHEN outcome = 'draw' THEN 'D' WHEN outcome = 'void' THEN 'NC' WHEN winner = me THEN 'W' ELSE 'L' END AS code, count(*) AS n FROM x GROUP BY ALL
""")
def result_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's results from its own side, in one pass over the orders' two first lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    l = load(spark, sf_dir, "lineitem").withColumn("side", F.row_number().over(w)).filter("side <= 2")
    at = lambda c, n: F.max(F.when(F.col("side") == n, F.col(c)))
    p = l.groupBy("l_orderkey").agg(at("l_suppkey", 1).alias("a"), at("l_suppkey", 2).alias("b"), at("l_quantity", 1).alias("x"), at("l_quantity", 2).alias("y")).filter("b IS NOT NULL")
    outcome = F.when(F.col("x") == F.col("y"), "draw").when(F.col("x") + F.col("y") > 95, "void").otherwise("decided")
    winner = F.when(F.col("x") > F.col("y"), F.col("a")).otherwise(F.col("b"))
    sides = p.select(outcome.alias("outcome"), winner.alias("winner"), F.explode(F.array("a", "b")).alias("me"))
    return sides.groupBy("me", rc.result_code(F.col("outcome"), F.col("winner"), F.col("me")).alias("code")).agg(F.count("*").alias("n"))


@named("""
SELECT event_id, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS mmss FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS s FROM events)
""")
def minutes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as minutes and seconds."""
    return load(spark, sf_dir, "events").select("event_id", rc.minutes(F.floor("value")).alias("mmss"))


@named("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\bsmall widget\\b') THEN 'small widget' WHEN regexp_matches(p_name, '\\bwidget\\b') THEN 'widget' WHEN regexp_matches(p_name, '\\bsmall\\b') THEN 'small' WHEN regexp_matches(p_name, '\\bring\\b') THEN 'ring' END AS label FROM part
""")
def division_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest label of a vocabulary in each name."""
    labels = {k: rf"\b{k}\b" for k in ("ring", "small", "widget", "small widget")}
    return load(spark, sf_dir, "part").select("p_partkey", rc.longest_label(F.col("p_name"), labels).alias("label"))


@named("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS place, t[i + 1] AS part, CASE WHEN t[i + 1] IN ('red', 'blue', 'green') THEN 'colour' WHEN t[i + 1] IN ('small', 'large', 'big') THEN 'size' ELSE 'noun' END AS kind FROM (SELECT p_partkey, t, unnest(range(len(t))) AS i FROM w)
""")
def remark_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names split into parts with their places, each part classified."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "part"))
    kind = F.when(F.col("part").isin("red", "blue", "green"), "colour").when(F.col("part").isin("small", "large", "big"), "size").otherwise("noun")
    return p.withColumn("kind", kind)


@named("""
SELECT user_id, min(ts) FILTER (event_type = 'signup') AS signed_up, min(ts) FILTER (event_type = 'view') AS viewed, min(ts) FILTER (event_type = 'purchase') AS purchased, count(*) FILTER (event_type = 'error' AND ts < TIMESTAMP '2024-01-10 00:00:00') AS early_errors FROM events GROUP BY user_id
""")
def staged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each stage of a user's timeline was first reached."""
    first = lambda t: F.min(F.when(F.col("event_type") == t, F.col("ts")))
    early = F.count_if((F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(first("signup").alias("signed_up"), first("view").alias("viewed"), first("purchase").alias("purchased"), early.alias("early_errors"))


@named("""
SELECT 'order' AS kind, o_orderkey AS ref, o_orderdate AS "at" FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40) UNION ALL SELECT 'event', event_id, ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 40)
ORDER BY "at" DESC, kind, ref DESC LIMIT 40
""")
def wire_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest forty facts of two kinds: a top-k report."""
    o = load(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"), F.col("o_orderdate").alias("at"))
    e = load(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("ref"), F.col("ts").alias("at"))
    return o.unionByName(e).orderBy(F.desc("at"), "kind", F.desc("ref")).limit(40)


@named("""
SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_final, bool_and(o_orderstatus = 'F') AS all_final, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY o_custkey
""")
def group_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any or all of a customer's orders have a property."""
    final = F.col("o_orderstatus") == "F"
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(final).alias("any_final"), F.bool_and(final).alias("all_final"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


@named("""
SELECT o_orderstatus || ':' || o_orderpriority AS tally, count(*) AS n FROM orders GROUP BY 1
""")
def tally_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a joined key."""
    return load(spark, sf_dir, "orders").groupBy(F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("tally")).agg(F.count("*").alias("n"))


@named("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final, c_acctbal > 0 AS solvent FROM customer
""")
def completeness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each customer; one aggregate of the orders serves all flags."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("has"), F.bool_or(F.col("o_orderstatus") == "F").alias("final"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left")
    known = lambda x: F.coalesce(x, F.lit(False))
    return c.select("c_custkey", known("has").alias("has_orders"), known("final").alias("has_final"), (F.col("c_acctbal") > 0).alias("solvent"))


@named(f"""
SELECT event_type, max(ts) FILTER (ts <= TIMESTAMP '{AS_OF}') AS last_capture, count(*) FILTER (ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS day_credits, count(*) FILTER (ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR) AS week_credits,
  CASE WHEN count(*) FILTER (ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) >= 70 THEN 'exhausted' ELSE 'open' END AS budget FROM events GROUP BY event_type
""")
def schedule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last capture and the credits used of sliding budgets at a fixed time."""
    at = F.lit(AS_OF).cast("timestamp_ntz")
    used = lambda h: F.count_if((F.col("ts") <= at) & (F.col("ts") > at - F.expr(f"INTERVAL {h} HOURS")))
    found = load(spark, sf_dir, "events").groupBy("event_type").agg(F.max(F.when(F.col("ts") <= at, F.col("ts"))).alias("last_capture"), used(24).alias("day_credits"), used(168).alias("week_credits"))
    return found.withColumn("budget", F.when(F.col("day_credits") >= 70, "exhausted").otherwise("open"))


@named("""
WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), b AS (SELECT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey)
SELECT a, b, o_orderkey, row_number() OVER (PARTITION BY a, b ORDER BY o_orderdate, o_orderkey) AS meeting FROM orders JOIN b ON o_orderkey = l_orderkey
""")
def previous_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered meetings of every two suppliers in one order; an order has a few lines, so its pairs are few."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = PAIRS_A_LINE * l.count()
    sides = dealt(l, "l_orderkey", rows=n).groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    one = sides.select("l_orderkey", "s", F.posexplode("s").alias("i", "a"))
    pairs = one.select("l_orderkey", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    met = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(pairs, F.col("o_orderkey") == F.col("l_orderkey"))
    met = dealt(met.select("a", "b", "o_orderkey", "o_orderdate"), "a", "b", rows=n)
    return met.select("a", "b", "o_orderkey", F.row_number().over(Window.partitionBy("a", "b").orderBy("o_orderdate", "o_orderkey")).alias("meeting"))


@named("""
SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS spread, count(*) AS cards FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2
""")
def card_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a panel's cards are apart, for panels of two or more."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"), F.count("*").alias("cards")).filter("cards >= 2")


@named("""
SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier
""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as slugs."""
    return load(spark, sf_dir, "supplier").select("s_suppkey", slug(F.col("s_name")).alias("slug"))


@named("""
WITH m AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS mean FROM customer GROUP BY ALL)
SELECT c_nationkey, round(sum(CASE WHEN mean > 4500 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS share, count(*) AS segments, max(n) AS largest FROM m GROUP BY c_nationkey
""")
def segment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a nation's segments whose mean balance is over a bound."""
    m = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), rounded(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"))
    return m.groupBy("c_nationkey").agg(rounded(F.count_if(F.col("mean") > 4500) / F.count("*")).alias("share"), F.count("*").alias("segments"), F.max("n").alias("largest"))
