"""Sequences: runs, streaks, folds and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sequences as sq
from tessera.sources.tables import load

from .catalog import named


@named("""
WITH d AS (SELECT *, CASE WHEN event_type = 'error' THEN '' WHEN event_type IN ('purchase', 'signup') THEN event_type END AS st FROM events),
k AS (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM d WHERE st IS NOT NULL),
c AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended_at FROM k WHERE st IS DISTINCT FROM p)
SELECT user_id, st AS holder, ts AS started_at, ended_at FROM c WHERE st <> ''
""")
def reigns_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reigns from an event log: purchases and signups take the seat, errors vacate it, the rest changes nothing."""
    holder = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return sq.reigns(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "ts", holder, F.col("event_type") == "error")


@named("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS length FROM r GROUP BY user_id, event_type, g
""")
def title_runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type of a user."""
    return sq.runs(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "ts", F.to_date("ts")).drop("island")


@named("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS g FROM orders),
i AS (SELECT o_custkey, o_orderpriority, min((o_orderdate, o_orderkey)) AS a, min(o_orderdate) AS started_at, count(*) AS length FROM r GROUP BY o_custkey, o_orderpriority, g)
SELECT o_custkey, o_orderpriority, started_at, length FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a DESC) AS n FROM i) WHERE n = 1
""")
def latest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last run of orders of one priority."""
    return sq.latest_streak(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", "o_orderdate")


@named("""
SELECT o_orderkey, count(*) FILTER (o_orderstatus = 'F') OVER w AS finished, count(*) FILTER (o_orderstatus = 'O') OVER w AS open_, count(*) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def record_entering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's record when entering each order."""
    counts = {"finished": F.col("o_orderstatus") == "F", "open_": F.col("o_orderstatus") == "O", "before": F.lit(True)}
    return sq.entering(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], counts, F.year("o_orderdate")).select("o_orderkey", *counts)


@named("""
SELECT * FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before_key, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS INTEGER) AS days
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE before_key IS NOT NULL
""")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the one before it and the days between."""
    o = sq.consecutive(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"o_orderkey": "before_key", "o_orderdate": "before_at"}, F.year("o_orderdate"))
    return o.select("o_custkey", "o_orderkey", "before_key", F.date_diff("o_orderdate", "before_at").alias("days"))


SNAPSHOTS = """
WITH m AS (SELECT year(o_orderdate) AS y, o_orderstatus AS board, o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY y, board ORDER BY v DESC, o_custkey) AS place FROM m),
a AS (SELECT board, o_custkey, place AS old_place FROM r WHERE y = 1996 AND place <= 50), b AS (SELECT board, o_custkey, place AS new_place FROM r WHERE y = 1997 AND place <= 50),
f AS (SELECT board, o_custkey, old_place, new_place, CASE WHEN old_place IS NULL THEN 'joined' WHEN new_place IS NULL THEN 'left' WHEN new_place < old_place THEN 'up' WHEN new_place > old_place THEN 'down' ELSE 'same' END AS change,
  old_place - new_place AS move FROM a FULL JOIN b USING (board, o_custkey))
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.temporal import top_per_key

    o = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("board"), "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    sums = o.filter(F.col("y").isin(1996, 1997)).groupBy("y", "board", "o_custkey").agg(F.sum("v").alias("v"))
    r = top_per_key(sums, ["y", "board"], [F.desc("v"), F.asc("o_custkey")], 50)
    return sq.snapshot_diff(r.filter("y = 1996"), r.filter("y = 1997"), ["board"], "o_custkey", "rn")


@named(SNAPSHOTS + "SELECT * FROM f")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who joined, left, rose and fell between two years' boards of top customers."""
    return _snapshots(spark, sf_dir)


@named(SNAPSHOTS + "SELECT board, change, count(*) AS n, CAST(sum(move) AS BIGINT) AS moved FROM f GROUP BY board, change")
def movement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many moved how far."""
    return _snapshots(spark, sf_dir).groupBy("board", "change").agg(F.count("*").alias("n"), F.sum("move").cast("long").alias("moved"))


@named("""
WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS month FROM orders), s AS (SELECT o_custkey, min(month) AS a, max(month) AS b FROM m GROUP BY o_custkey),
f AS (SELECT o_custkey, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM s)
SELECT f.o_custkey, f.month FROM f ANTI JOIN m ON f.o_custkey = m.o_custkey AND f.month = m.month
""")
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without an order between a customer's first and last."""
    return sq.missing_months(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")


@named("""
SELECT DISTINCT a.o_custkey, least(a.o_orderkey, b.o_orderkey) AS a_key, greatest(a.o_orderkey, b.o_orderkey) AS b_key
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', a.o_orderdate, b.o_orderdate)) <= 1 AND a.o_orderstatus = b.o_orderstatus
""")
def possible_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and status at most a day apart."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    near = o.withColumn("d2", F.explode(F.array(F.col("d"), F.date_add("d", 1))))  # meets its own and the next day: an equi-join
    b = o.select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("other"), F.col("d").alias("d2"))
    met = near.join(b, ["o_custkey", "o_orderstatus", "d2"]).filter("o_orderkey <> other AND (d <> d2 OR o_orderkey < other)")
    return met.select("o_custkey", F.least("o_orderkey", "other").alias("a_key"), F.greatest("o_orderkey", "other").alias("b_key")).distinct()


@named("""
WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
SELECT user_id, event_id, from_state, event_type FROM c WHERE from_state IS NOT NULL AND from_state <> event_type AND NOT (
  (from_state = 'signup' AND event_type IN ('view', 'click')) OR (from_state = 'view' AND event_type IN ('click', 'purchase', 'error'))
  OR (from_state = 'click' AND event_type IN ('view', 'purchase', 'error')) OR (from_state = 'purchase' AND event_type IN ('view', 'click')) OR (from_state = 'error' AND event_type = 'view'))
""")
def illegal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State changes that a fixed state machine does not allow."""
    from tessera.operators.reads import illegal_moves as find

    allowed = {"signup": ["view", "click"], "view": ["click", "purchase", "error"], "click": ["view", "purchase", "error"], "purchase": ["view", "click"], "error": ["view"]}
    return find(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", allowed).select("user_id", "event_id", "from_state", "event_type")
