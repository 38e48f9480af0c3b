"""Documents, printed times and records, vocabularies, interval tables and chains of lists on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import clock as ck
from tessera.operators import documents as dc
from tessera.operators import rankings as rk
from tessera.operators import records as rc
from tessera.operators import temporal as tp
from tessera.operators.temporal import top_per_key
from tessera.sources.shared import dealt
from tessera.sources.tables import load

from .catalog import named


@named("""
WITH c AS (SELECT event_id, user_id, event_type, '{"a":[{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"},null],"b":{"event_id":' || event_id || ',"x":{"id":' || user_id || ',"public_id":"u' || user_id || '"}},"user_id":' || user_id || '}' AS full_,
  '{"a":[{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"},null],"b":{"x":{"public_id":"u' || user_id || '"}}}' AS bare FROM events)
SELECT event_id, sha256(full_) AS digest, bare AS public_document, 'event:' || substr(sha256('[' || full_ || ',' || user_id || ']'), 1, 40) AS dedupe FROM c
""")
def document_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of events as nested documents, whose keys stand in another order in every other one, and the documents without internal ids at any level."""
    k = F.get_json_object("props", "$.k")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    u, e, t = F.col("user_id"), F.col("event_id"), F.col("event_type")
    one = say('{ "user_id":', u, ',"a":[{"type":"', t, '","k":', k, '},null], "b":{"x":{"public_id":"u', u, '","id":', u, '},"event_id":', e, "}}")
    two = say('{"b":{"event_id":', e, ',"x":{"id":', u, ',"public_id":"u', u, '"}},"a":[{"k":', k, ', "type":"', t, '"},null],"user_id":', u, "}")
    rows = load(spark, sf_dir, "events").select(e, u, F.when(e % 2 == 0, one).otherwise(two).alias("document"))
    return rows.select("event_id", dc.digest(F.col("document")).alias("digest"), dc.without_keys(F.col("document")).alias("public_document"), dc.dedupe_key("event", F.col("document"), F.col("user_id").cast("string")).alias("dedupe"))


@named("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 25 YEAR AS d, o_orderkey % 7 AS way FROM orders),
w AS (SELECT o_orderkey, CAST(d AS DATE) AS d, way, CASE way WHEN 0 THEN 20 WHEN 1 THEN 20 WHEN 2 THEN 19 WHEN 3 THEN 2 WHEN 4 THEN 21 END AS h, CASE way WHEN 1 THEN 30 WHEN 2 THEN 30 WHEN 3 THEN 30 ELSE 0 END AS mi, CASE way WHEN 0 THEN 'e' WHEN 1 THEN 'c' WHEN 2 THEN 'l' WHEN 3 THEN 'e' WHEN 4 THEN 'e' END AS z, CASE way WHEN 0 THEN 17 WHEN 4 THEN 17 END AS h2 FROM o),
u AS (SELECT w.*, date_diff('day', DATE '1970-01-01', d) * 86400 AS day, year(d) AS y FROM w),
c AS (SELECT *, make_date(y, 3, 8) + CAST((7 - dayofweek(make_date(y, 3, 8))) % 7 AS INTEGER) AS us_on, make_date(y, 11, 1) + CAST((7 - dayofweek(make_date(y, 11, 1))) % 7 AS INTEGER) AS us_off, make_date(y, 3, 31) - CAST(dayofweek(make_date(y, 3, 31)) AS INTEGER) AS uk_on, make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INTEGER) AS uk_off FROM u),
s AS (SELECT *, date_diff('day', DATE '1970-01-01', us_on) * 86400 + 7200 AS on_, date_diff('day', DATE '1970-01-01', us_off) * 86400 + 3600 AS off_, date_diff('day', DATE '1970-01-01', uk_on) * 86400 + 3600 AS kon, date_diff('day', DATE '1970-01-01', uk_off) * 86400 + 3600 AS koff, day + h * 3600 + mi * 60 AS naive, day + h2 * 3600 AS naive2 FROM c),
g AS (SELECT *, naive - CASE z WHEN 'e' THEN CASE WHEN naive >= on_ + 18000 AND naive < off_ + 18000 THEN -14400 ELSE -18000 END WHEN 'c' THEN CASE WHEN naive >= on_ + 21600 AND naive < off_ + 21600 THEN -18000 ELSE -21600 END WHEN 'l' THEN CASE WHEN naive >= kon AND naive < koff THEN 3600 ELSE 0 END END AS g1, naive2 - CASE WHEN naive2 >= on_ + 28800 AND naive2 < off_ + 28800 THEN -25200 ELSE -28800 END AS g2 FROM s),
i AS (SELECT *, naive - CASE z WHEN 'e' THEN CASE WHEN g1 >= on_ + 18000 AND g1 < off_ + 18000 THEN -14400 ELSE -18000 END WHEN 'c' THEN CASE WHEN g1 >= on_ + 21600 AND g1 < off_ + 21600 THEN -18000 ELSE -21600 END WHEN 'l' THEN CASE WHEN g1 >= kon AND g1 < koff THEN 3600 ELSE 0 END END AS i1, naive2 - CASE WHEN g2 >= on_ + 28800 AND g2 < off_ + 28800 THEN -25200 ELSE -28800 END AS i2, CASE WHEN o_orderkey % 4 <> 0 THEN day + 86400 + CASE WHEN o_orderkey % 4 = 1 THEN 3600 ELSE 0 END END AS js FROM g),
r AS (SELECT *, CASE WHEN i1 IS NULL THEN CASE WHEN way = 5 AND js IS NOT NULL THEN 'unresolved' WHEN js IS NOT NULL THEN 'structured' ELSE 'none' END WHEN i2 <> i1 THEN 'unresolved' WHEN js IS NULL THEN 'visible' WHEN i1 = js THEN 'corroborated' ELSE 'visible_preferred' END AS basis FROM i)
SELECT o_orderkey, basis, CASE basis WHEN 'structured' THEN js WHEN 'none' THEN NULL WHEN 'unresolved' THEN NULL ELSE i1 END AS start FROM r
""")
def announced_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of events announced 25 years after each order's date, as an instant, in printed times of one or two zones, or both, over changes of the clock."""
    k = F.col("o_orderkey")
    lines = ["8pm ET / 5pm PT", "Doors 8:30 P.M. CT", "7.30pm GMT", "2:30 am ET", "9pm ET/5pm PT", "8pm ZZ"]
    line = F.lit(None).cast("string")
    for i, text in enumerate(lines):
        line = F.when(k % 7 == i, text).otherwise(line)
    date = F.add_months(F.to_date("o_orderdate"), 300)
    told = F.when(k % 4 != 0, F.date_diff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + 86_400 + F.when(k % 4 == 1, 3_600).otherwise(0))
    found = load(spark, sf_dir, "orders").select(k, date.alias("date"), told.alias("told"), line.alias("line")).withColumn("x", ck.announced_start(F.col("date"), F.col("told"), F.col("line")))
    return found.select("o_orderkey", "x.basis", "x.start")


@named("""
WITH p AS (SELECT o_orderkey, o_orderkey % 40 AS w, o_custkey % 9 AS l, o_orderkey % 6 AS d, o_orderkey % 9 AS way, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f FROM orders)
SELECT o_orderkey, CASE way WHEN 6 THEN NULL WHEN 7 THEN 'held' WHEN 4 THEN CASE WHEN d + 20 > w THEN 'held' ELSE 'parsed' END ELSE 'parsed' END AS state, CASE WHEN way < 4 OR (way = 4 AND d + 20 <= w) OR way IN (5, 8) THEN w END AS wins, CASE WHEN way < 4 OR (way = 4 AND d + 20 <= w) OR way IN (5, 8) THEN l END AS losses,
  CASE WHEN way IN (1, 2, 3, 8) THEN d END AS draws, CASE WHEN way = 3 THEN 1 END AS no_contests, CASE WHEN way = 2 THEN 0 WHEN way = 4 AND d + 20 <= w THEN d + 20 END AS ko_wins FROM p
""")
def printed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as documents print them, in nine ways by the order's number."""
    k = F.col("o_orderkey")
    w, l, d = (k % 40).cast("string"), (F.col("o_custkey") % 9).cast("string"), (k % 6).cast("string")
    plain = F.concat_ws("-", w, l)
    forms = [plain, F.concat_ws("-", w, l, d), F.concat(F.concat_ws("-", w, l, d), F.lit(" (0 KO)")), F.concat_ws("-", w, l, d, F.lit("1")), F.concat(plain, F.lit(", "), (k % 6 + 20).cast("string"), F.lit(" KOs")), F.concat(F.lit("  "), plain, F.lit(" ")), F.lit("   "), F.lit("Debut"), F.concat(F.concat_ws("-", w, l, d), F.lit("  "))]
    text = F.element_at(F.array(*forms), (k % 9 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(k, ck.printed_record(text).alias("x")).select("o_orderkey", "x.*")


@named("""
WITH i AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS low, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS high FROM orders), p AS (SELECT o_custkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.o_custkey, i.o_orderkey, count(*) AS lines, count(*) FILTER (l_orderkey <> i.o_orderkey) AS of_others FROM p JOIN i ON p.o_custkey = i.o_custkey AND d >= low AND (high IS NULL OR d < high) GROUP BY ALL
""")
def periods_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of its customer's periods, each from an order to the next, a line was shipped: points in a table of intervals, the last of which are open."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    periods = o.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("low"), F.to_date(F.lead("o_orderdate").over(w)).alias("high"))
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("d"))
    n = l.count()
    p = dealt(l, "l_orderkey", rows=n).join(o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("o_custkey", "l_orderkey", "d")
    met = tp.within_intervals(p, periods, ["o_custkey"], "d", "low", "high", rows=n + o.count())
    return met.groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_orderkey") != F.col("o_orderkey")).alias("of_others"))


@named(r"""
WITH v AS (SELECT item_id, k, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')[1:k] AS w FROM benchmark, (VALUES (1), (2), (4)) t(k)), p AS (SELECT item_id, k, array_to_string(w, ' ') AS phrase FROM v WHERE len(w) > 0),
d AS (SELECT doc_id, ' ' || regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), '  '), '$', ' ') AS t FROM documents)
SELECT doc_id, item_id, k, phrase, len(string_split(t, ' ' || replace(phrase, ' ', '  ') || ' ')) - 1 AS n FROM d JOIN p ON contains(t, ' ' || replace(phrase, ' ', '  ') || ' ')
""")
def phrases_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the beginnings of benchmark items, of one, two and four words, stand in each document, and how often."""
    words = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    v = load(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("k"))
    phrases = v.select("item_id", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("phrase"))
    return rc.phrases_found(load(spark, sf_dir, "documents").select("doc_id", "text"), phrases, "doc_id", "text", "phrase")


CHAIN = """
WITH m AS (SELECT l_suppkey, year(l_shipdate) AS y, p_brand, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_suppkey % 10 = 3 AND year(l_shipdate) = 1998) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, y ORDER BY q DESC, p_brand) AS rn FROM m), e AS (SELECT l_suppkey, y, p_brand AS key, rn AS position, rn = 1 AS champion, CASE WHEN rn > 1 THEN rn - 1 END AS rank, CASE WHEN r >= 3 THEN 'returned' END AS designation FROM k WHERE rn <= 10),
l AS (SELECT l_suppkey, y, lag(y) OVER (PARTITION BY l_suppkey ORDER BY y) AS was FROM (SELECT DISTINCT l_suppkey, y FROM e)), a AS (SELECT e.* FROM e JOIN l USING (l_suppkey, y) WHERE was IS NOT NULL), b AS (SELECT e.l_suppkey, l.y, key, position, champion, rank, designation FROM e JOIN l ON l.l_suppkey = e.l_suppkey AND l.was = e.y),
j AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.y, b.y) AS y, a.key IS NOT NULL AS now, b.key IS NOT NULL AS before, a.champion AS ac, b.champion AS bc, a.rank AS ar, b.rank AS br, a.designation AS ad, b.designation AS bd FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.y = b.y AND a.key = b.key),
t AS (SELECT l_suppkey, y, CASE WHEN now AND NOT before THEN CASE WHEN ac THEN 'new_champion_listed' ELSE 'new_entrant' END WHEN before AND NOT now THEN 'removed' WHEN ac <> bc THEN CASE WHEN ac THEN 'became_champion' ELSE 'no_longer_champion' END WHEN NOT ac AND ar < br THEN 'moved_up' WHEN NOT ac AND ar > br THEN 'moved_down' END AS type FROM j
  UNION ALL SELECT l_suppkey, y, 'designation_changed' FROM j WHERE now AND before AND ad IS DISTINCT FROM bd UNION ALL SELECT a.l_suppkey, a.y, 'champion_changed' FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.y = b.y WHERE a.champion AND b.champion AND a.key <> b.key)
"""


@named(CHAIN + "SELECT l_suppkey, CAST(y AS INTEGER) AS y, type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY ALL")
def ranking_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes of each kind every supplier's list of brands had from one year's list to the next it has, over the whole chain of years."""
    l = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"), "l_quantity", "l_returnflag").filter("NOT (l_suppkey % 10 = 3 AND y = 1998)")
    sums = l.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_suppkey", "y", "p_brand").agg(F.sum("l_quantity").cast("long").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    top = top_per_key(sums, ["l_suppkey", "y"], [F.desc("q"), F.asc("p_brand")], 10)
    lists = top.select(
        "l_suppkey", "y", F.col("p_brand").alias("entity_id"), F.lit(None).cast("string").alias("source_name"), F.col("rn").alias("position"), F.when(F.col("rn") > 1, F.col("rn") - 1).alias("rank"), F.when(F.col("rn") == 1, "C").otherwise((F.col("rn") - 1).cast("string")).alias("rank_label"),
        (F.col("rn") == 1).alias("is_champion"), F.lit(False).alias("is_vacant"), F.when(F.col("r") >= 3, "returned").alias("designation"), F.lit(None).cast("boolean").alias("mandatory"),
    )
    return rk.chain_changes(lists, ["l_suppkey"], "y").groupBy("l_suppkey", "y", "type").agg(F.count("*").alias("n"))
