"""Incremental and fail-closed steps on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import flows as fl
from tessera.operators.temporal import latest_per_key as last_rows
from tessera.sources.tables import load

from .catalog import named

NOW = "2001-07-01 00:00:00"


@named("""
WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-30'), k AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM n))
SELECT c_custkey FROM customer SEMI JOIN k ON customer.c_nationkey = k.c_nationkey AND customer.c_mktsegment = k.c_mktsegment
""")
def touched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to recompute after new orders: their own and the neighbours of their nation's segment."""
    new = load(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-07-30").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("place"))
    return fl.touched(new, c, "c_custkey", "place")


@named("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01' OR (o_orderdate = TIMESTAMP '1999-06-01' AND o_orderkey < 7000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25
""")
def keyset_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a place in the order by date and key."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return fl.keyset_page(o, {"o_orderdate": "1999-06-01 00:00:00", "o_orderkey": 7000}, 25)


@named("""
WITH c AS (SELECT c_custkey AS subject, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) AS attribute, unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value FROM customer)
SELECT *, sha256(CAST(subject AS VARCHAR) || '|' || attribute || '|' || value) AS claim FROM c
""")
def attribute_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' attributes as hashed claims."""
    return fl.claims(load(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@named("""
SELECT l_orderkey, count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS unknown, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'refused' ELSE 'imported' END AS decision FROM lineitem GROUP BY l_orderkey
""")
def refused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refused as a whole because one of their lines has a flag that the vocabulary lacks."""
    return fl.refused_groups(load(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag").isin("A", "N"))


@named("""
SELECT user_id, band, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, band ORDER BY ts, event_id) AS n FROM (SELECT user_id, CAST(floor(value / 50) AS BIGINT) AS band, event_id, ts FROM events)) WHERE n = 1
""")
def emit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a user in each band of values."""
    e = load(spark, sf_dir, "events").select("user_id", F.floor(F.col("value") / 50).alias("band"), "event_id", "ts")
    return fl.emitted_once(e, ["user_id", "band"], ["ts", "event_id"])


@named(f"""
WITH m AS (SELECT o_orderkey, epoch(o_orderdate - INTERVAL (o_orderkey % 300) MINUTE) - epoch(TIMESTAMP '{NOW}') AS s FROM orders)
SELECT o_orderkey, CAST(CASE WHEN s >= -7200 AND s <= 10800 THEN 15 WHEN s > 0 AND s <= 86400 THEN 30 WHEN s > 0 AND s <= 604800 THEN 120 ELSE 360 END AS INTEGER) AS minutes FROM m
""")
def cadence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each order should be polled."""
    o = load(spark, sf_dir, "orders")
    due = F.timestamp_add("MINUTE", (-(F.col("o_orderkey") % 300)).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    return o.select("o_orderkey", fl.cadence(F.timestamp_diff("SECOND", F.lit(NOW).cast("timestamp_ntz"), due) / 60.0).alias("minutes"))


@named(f"""
SELECT CASE WHEN o_orderpriority <> '1-URGENT' AND date_diff('day', o_orderdate, TIMESTAMP '{NOW}') > 45 THEN 'skipped' ELSE 'pending' END AS state, count(*) AS n FROM orders GROUP BY 1
""")
def temporal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts too old to be news; urgent ones are exempt."""
    state = fl.temporal_gate(F.col("o_orderdate"), F.lit(NOW).cast("timestamp_ntz"), 45, F.col("o_orderpriority") == "1-URGENT")
    return load(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@named("""
SELECT r_name, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS document FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def nested_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with its nations as one JSON document."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.to_json(rows).alias("document"))


@named("""
SELECT user_id, event_type AS decision, ts AS decided_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type IN ('purchase', 'signup')
""")
def latest_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose latest decision, of any kind, is a binding one."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    last = last_rows(e, ["user_id"], ["ts", "event_id"]).filter(F.col("event_type").isin("purchase", "signup"))
    return last.select("user_id", F.col("event_type").alias("decision"), F.col("ts").alias("decided_at"))


@named("""
WITH k AS (SELECT o_custkey, o_orderstatus, max(l_shipdate) AS known FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY o_custkey, o_orderkey, o_orderstatus)
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus = 'O') AS losses, count(*) FILTER (o_orderstatus = 'P') AS draws FROM k WHERE known <= TIMESTAMP '1998-03-01' GROUP BY o_custkey
""")
def record_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from orders before a time whose results were known by a cutoff: two clocks."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    known = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("known")).filter(F.col("known") <= t("1998-03-01"))
    o = load(spark, sf_dir, "orders").filter(F.col("o_orderdate") < t("1998-01-01")).join(known, F.col("o_orderkey") == F.col("l_orderkey"))
    s = F.col("o_orderstatus")
    return o.groupBy("o_custkey").agg(F.count_if(s == "F").alias("wins"), F.count_if(s == "O").alias("losses"), F.count_if(s == "P").alias("draws"))


@named("""
SELECT c_mktsegment, count(*) FILTER (c_nationkey % 3 = 0) AS lane_0, count(*) FILTER (c_nationkey % 3 = 1) AS lane_1, count(*) FILTER (c_nationkey % 3 = 2) AS lane_2 FROM customer GROUP BY c_mktsegment
""")
def pivoted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of segments by lane, a column a lane."""
    c = load(spark, sf_dir, "customer").withColumn("lane", F.concat(F.lit("lane_"), (F.col("c_nationkey") % 3).cast("string")))
    return c.groupBy("c_mktsegment").pivot("lane", ["lane_0", "lane_1", "lane_2"]).agg(F.count(F.lit(1))).fillna(0)


@named("""
SELECT o_orderkey, s AS side, CASE WHEN s = 'a' THEN o_custkey ELSE o_custkey + 1 END AS corner FROM orders, (VALUES ('a'), ('b')) v(s)
""")
def both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order from both of its sides, by exploding the two literal sides."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    return o.select("o_orderkey", "side", F.when(F.col("side") == "a", F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("corner"))
