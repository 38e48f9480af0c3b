"""Reads: directories, facets, coverage, ledgers, joins on bands, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import content_hash, place_in
from tessera.operators import reads as rd
from tessera.operators.temporal import top_per_key
from tessera.sources.shared import PAIRS_A_LINE, dealt
from tessera.sources.tables import load, merged, new_rows

from .catalog import named

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@named("""
WITH f AS (SELECT * FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012'))
SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM f) AS total FROM f ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5
""")
def directory_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a searched directory with the total."""
    f = rd.searched(load(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "%00012_")
    return rd.page(f, [F.desc("c_acctbal"), F.asc("c_custkey")], 20, 5).select("c_custkey", "c_name", "c_mktsegment", "total")


@named("""
SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size
""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by brand, type and size in one pass."""
    return rd.facets(load(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@named(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table."""
    return rd.coverage({t: load(spark, sf_dir, t) for t in TABLES})


@named("""
SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS ref, o_orderdate AS "at", o_totalprice AS amount FROM orders
UNION ALL SELECT 'line', CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR), l_shipdate, l_extendedprice FROM lineitem
UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), ts, value FROM events
""")
def union_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, lines and events as one ledger."""
    o, l, e = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    return rd.ledger({
        "order": (o, F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_totalprice")),
        "line": (l, F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.col("l_shipdate"), F.col("l_extendedprice")),
        "event": (e, F.col("event_id"), F.col("ts"), F.col("value")),
    })


@named("""
SELECT 'order without customer' AS "check", (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) AS violations
UNION ALL SELECT 'line without order', (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey)
UNION ALL SELECT 'order key repeated', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'line key repeated', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'shipped before ordered', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)
""")
def graph_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule about keys and times is broken."""
    o, l, c = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    early = l.join(o, l.l_orderkey == o.o_orderkey).filter("l_shipdate < o_orderdate")
    return rd.violations({
        "order without customer": rd.orphans(o, "o_custkey", c, "c_custkey"), "line without order": rd.orphans(l, "l_orderkey", o, "o_orderkey"),
        "order key repeated": rd.repeated(o, ["o_orderkey"]), "line key repeated": rd.repeated(l, ["l_orderkey", "l_linenumber"]), "shipped before ordered": early,
    })


@named("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 1 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 WHEN o_totalprice > 300000 THEN 3 ELSE 4 END AS tier,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 ELSE 4 END AS place FROM orders
""")
def tiered_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by priority and price, and the place of the status in a fixed order."""
    big, urgent = F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "1-URGENT"
    tier = F.when(urgent & big, 1).when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2).when(big, 3).otherwise(4)
    return load(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"), place_in(["O", "P", "F"], F.col("o_orderstatus")).cast("int").alias("place"))


@named("""
WITH n AS (SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS lines, count(*) FILTER (l_linestatus = 'F') AS done FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderkey, lines, CASE WHEN lines = 0 THEN 'empty' WHEN done = lines THEN 'complete' WHEN done > 0 THEN 'partial' ELSE 'open' END AS completeness FROM n
""")
def completeness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How complete each order's lines are."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    o = load(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n, done = F.coalesce("lines", F.lit(0)), F.coalesce("done", F.lit(0))
    state = F.when(n == 0, "empty").when(done == n, "complete").when(done > 0, "partial").otherwise("open")
    return o.select("o_orderkey", n.cast("long").alias("lines"), state.alias("completeness"))


@named("""
SELECT DISTINCT a.l_suppkey FROM lineitem a WHERE a.l_partkey = 17 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_partkey BETWEEN 100 AND 200
""")
def intersect_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that two groups of parts have in common."""
    l = load(spark, sf_dir, "lineitem")
    return l.filter("l_partkey = 17").select("l_suppkey").intersect(l.filter("l_partkey BETWEEN 100 AND 200").select("l_suppkey"))


@named("""
WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS a_supp, b.l_suppkey AS b_supp, count(*) AS orders FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL HAVING count(*) >= 12
""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers that often share an order. An order has a few lines, so pairs are made inside its array."""
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = PAIRS_A_LINE * l.count()
    d = dealt(l, "l_orderkey", rows=n).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    pairs = d.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a_supp"), y.alias("b_supp")))))).alias("p")).select("p.*")
    return dealt(pairs, "a_supp", "b_supp", rows=n).groupBy("a_supp", "b_supp").agg(F.count("*").alias("orders")).filter("orders >= 12")


@named("""
SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND abs(date_diff('day', o_orderdate, l_shipdate)) <= 10
""")
def band_join_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within ten days of their order."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    l = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    met = rd.band_join(o, l, ["k"], "o_orderdate", "l_shipdate", 10)
    return met.select(o["k"].alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", F.date_diff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@named("""
SELECT r_name, md5(string_agg(CAST(n_nationkey AS VARCHAR) || ':' || n_name, ',' ORDER BY n_nationkey)) AS fingerprint, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def scope_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each region's ordered nations."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat_ws(":", x.n_nationkey.cast("string"), x.n_name))
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.md5(F.array_join(rows, ",")).alias("fingerprint"), F.count("*").alias("n"))


@named("""
SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3
""")
def top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's three largest orders."""
    return top_per_key(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rn")


@named("""
SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ';' ORDER BY c_mktsegment) AS segments FROM (SELECT c_nationkey, c_mktsegment, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey
""")
def map_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each nation's segments as one ordered map, told as text."""
    n = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("c_mktsegment", F.col("n").cast("string")))))
    return n.groupBy("c_nationkey").agg(entries.alias("m")).select("c_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e.key, e.value)), ";").alias("segments"))


@named("""
SELECT sha256(text) AS content, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1
""")
def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document contents with the first id and the number of copies."""
    return load(spark, sf_dir, "documents").groupBy(content_hash("text").alias("content")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@named("""
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def append_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append of all orders would add to those that have lines."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return new_rows(o, load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@named("""
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM events GROUP BY user_id
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the events merged into one row a user by their rules."""
    e = load(spark, sf_dir, "events").select("user_id", F.col("ts").alias("first_at"), F.col("ts").alias("last_at"), F.col("value").cast("decimal(18,2)").alias("total"), "event_id")
    rules = {"first_at": "min", "last_at": "max", "total": "sum"}
    halves = [e.filter(f"event_id % 2 = {i}").groupBy("user_id").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("total").alias("total")) for i in (0, 1)]
    return merged(halves[0], halves[1], ["user_id"], rules).withColumn("total", F.round(F.col("total").cast("double"), 2))


@named("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_discount < 0.1 THEN 'discount' END, CASE WHEN NOT l_shipdate < TIMESTAMP '2001-06-01' THEN 'late' END) AS problems
FROM lineitem WHERE l_quantity > 45 OR l_discount >= 0.1 OR l_shipdate >= TIMESTAMP '2001-06-01'
""")
def problem_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break rules, with the rules' names."""
    rules = {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1, "late": F.col("l_shipdate") < F.lit("2001-06-01").cast("timestamp_ntz")}
    return rd.validated(load(spark, sf_dir, "lineitem"), rules).filter("problems <> ''").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "problems")


@named("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'p_size' END, CASE WHEN p_brand = 'Brand#7' THEN 'p_brand' END) AS changed FROM part WHERE p_size % 5 = 0 OR p_brand = 'Brand#7'
""")
def frozen_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen columns that a rewritten table has changed."""
    p = load(spark, sf_dir, "part")
    new = p.withColumn("p_size", F.when(F.col("p_size") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_brand") == "Brand#7", None).otherwise(F.col("p_brand")))
    return rd.changed_frozen(p, new, ["p_partkey"], ["p_size", "p_brand", "p_type"])
