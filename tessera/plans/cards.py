"""Cards made of orders: an order is a card, its lines are its bouts, and a document of it differs by the bouts' and the card's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import cards as cd
from tessera.operators import names as nm
from tessera.sources.shared import ROWS_A_TASK, cut
from tessera.sources.tables import load

from .catalog import named
from .identities import PEOPLE, people

#: Lines that a task is given, as documents and as bouts: fewer than other rows, as each stage of matching sorts them whole in the same task.
LINES_A_TASK = ROWS_A_TASK // 4

LINES = """
WITH n AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_tax, l_discount, l_extendedprice) AS rn, l_partkey, l_suppkey, l_quantity AS q, l_tax, l_discount, l_linestatus FROM lineitem),
v AS (SELECT *, (o * 31 + rn * 7) % 20 AS v, CASE WHEN rn % 3 <> 0 THEN 'x' || rn END AS x, 'p' || l_partkey AS a, 's' || l_suppkey AS b, CASE WHEN l_tax > 0.035 THEN 12 ELSE 8 END AS rounds, 'd' || l_partkey % 17 AS class, CASE WHEN l_discount > 0.05 THEN 't' || l_suppkey % 4 END AS title, 'r' || l_partkey % 20 AS ref, 'j' || l_suppkey % 10 AS judge,
  CASE WHEN rn % 7 = 0 THEN 'complete' ELSE 'scheduled' END AS status, CASE WHEN l_linestatus = 'O' THEN 'main' END AS segment FROM n),
s AS (SELECT *, o || '-' || rn AS bout, least(a, b) || '|' || greatest(a, b) AS pair FROM v WHERE o % 11 <> 0),
d AS (SELECT o, rn, v, CASE WHEN v IN (3, 4) THEN NULL WHEN v = 5 THEN 'new' || rn ELSE x END AS x, a, CASE WHEN v IN (0, 4) THEN 'z' || l_suppkey ELSE b END AS b, rounds, q, class, title, ref FROM v WHERE v <> 1),
dp AS (SELECT *, least(a, b) || '|' || greatest(a, b) AS pair FROM d),
m1 AS (SELECT dp.o, dp.rn, s.bout, 'external_id' AS how FROM dp JOIN s ON s.o = dp.o AND s.x = dp.x),
m2 AS (SELECT l.o, l.rn, f.bout, 'pair' AS how FROM (SELECT *, row_number() OVER (PARTITION BY o, pair ORDER BY rn) AS k FROM dp WHERE x IS NOT NULL AND (o, rn) NOT IN (SELECT o, rn FROM m1)) l JOIN (SELECT *, row_number() OVER (PARTITION BY o, pair ORDER BY bout) AS k FROM s WHERE x IS NULL AND bout NOT IN (SELECT bout FROM m1)) f ON l.o = f.o AND l.pair = f.pair AND l.k = f.k),
m3 AS (SELECT l.o, l.rn, f.bout, 'pair' AS how FROM (SELECT *, row_number() OVER (PARTITION BY o, pair ORDER BY rn) AS k FROM dp WHERE x IS NULL) l JOIN (SELECT *, row_number() OVER (PARTITION BY o, pair ORDER BY bout) AS k FROM s WHERE bout NOT IN (SELECT bout FROM m1) AND bout NOT IN (SELECT bout FROM m2)) f ON l.o = f.o AND l.pair = f.pair AND l.k = f.k),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
j AS (SELECT dp.*, m.how, s.bout, s.a AS sa, s.b AS sb, s.rn AS srn, s.status AS sstatus, s.rounds AS srounds, s.q AS sq, s.class AS sclass, s.title AS stitle, s.ref AS sref, s.judge AS sjudge, s.segment AS ssegment, coalesce(s.bout, 'ext:' || dp.x, 'pair:' || dp.pair) AS ref_ FROM dp LEFT JOIN m ON m.o = dp.o AND m.rn = dp.rn LEFT JOIN s ON s.bout = m.bout),
e AS (SELECT o_orderkey AS o, o_orderkey % 11 AS e, CAST(o_orderdate AS DATE) AS date, o_orderdate AS ts, 'v' || o_custkey % 13 AS venue, 'n' || o_orderkey % 7 AS commission FROM orders),
ed AS (SELECT *, CASE e WHEN 1 THEN ts + INTERVAL 30 DAY WHEN 2 THEN ts - INTERVAL 3 DAY WHEN 7 THEN ts + INTERVAL 1 DAY ELSE ts END AS dat FROM e)
"""


def cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(document events, document bouts, events, bouts)."""
    text = lambda *parts: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in parts])
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    lines = load(spark, sf_dir, "lineitem")
    # dealt by card before all else, to a number of tasks that is kept: documents and bouts are made where a card's lines lie, and meet there
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * lines.count() // LINES_A_TASK))
    l = lines.repartition(tasks, "l_orderkey").withColumn("rn", F.row_number().over(own)).withColumnRenamed("l_orderkey", "event_id")
    o, rn, none = F.col("event_id"), F.col("rn"), F.lit(None).cast("string")
    title = lambda t, e: F.struct(t.alias("title"), e.alias("eligible"))
    post = lambda who, role, slot: F.struct(who.alias("official"), F.lit(role).alias("role"), F.lit(slot).cast("int").alias("slot"))
    no_titles = F.array().cast("array<struct<title:string,eligible:string>>")
    held = text("t", F.col("l_suppkey") % 4)
    l = l.withColumns({
        "v": (o * 31 + rn * 7) % 20, "external_id": F.when(rn % 3 != 0, text("x", rn)), "a": text("p", F.col("l_partkey")), "b": text("s", F.col("l_suppkey")), "rounds": F.when(F.col("l_tax") > 0.035, 12).otherwise(8), "weight": F.col("l_quantity"),
        "weight_class": text("d", F.col("l_partkey") % 17), "titles": F.when(F.col("l_discount") > 0.05, F.array(title(held, none))).otherwise(no_titles), "referee": text("r", F.col("l_partkey") % 20), "judge": text("j", F.col("l_suppkey") % 10),
    })
    bouts = l.filter(o % 11 != 0).select(
        "event_id", text(o, "-", rn).alias("bout_id"), "external_id", F.when(rn % 7 == 0, "complete").otherwise("scheduled").alias("status"), rn.alias("bout_order"), F.when(F.col("l_linestatus") == "O", "main").alias("segment"), "rounds", "weight", "weight_class", "a", "b", "titles",
        F.array(post(F.col("referee"), "referee", None), post(F.col("judge"), "judge", 1)).alias("officials"),
    )
    v = F.col("v")
    eligible = F.transform("titles", lambda t: title(t.title, F.col("a")))
    docs = l.filter(v != 1).select(
        "event_id", rn.alias("n"), F.when(v.isin(3, 4), None).when(v == 5, text("new", rn)).otherwise(F.col("external_id")).alias("external_id"), F.when(v == 6, "cancelled").alias("status"), F.when(v == 16, rn + 1).alias("bout_order"), F.when(v == 17, "undercard").alias("segment"),
        F.when(v == 7, F.col("rounds") + 2).alias("rounds"), F.when(v == 8, F.col("weight") + 1).alias("weight"), F.when(v == 9, "dX").alias("weight_class"), F.when(v == 2, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(v == 2, F.col("a")).when(v.isin(0, 4), text("z", F.col("l_suppkey"))).otherwise(F.col("b")).alias("b"), F.when(v == 11, no_titles).when(v == 12, F.concat("titles", F.array(title(F.lit("tn"), none)))).when(v == 13, eligible).alias("titles"),
        F.when(v == 14, F.array(post(F.lit("rr"), "referee", None))).when(v == 15, F.array(post(F.col("referee"), "referee", None))).alias("officials"), (v == 10).alias("class_contradicted"), (v == 15).alias("officials_complete"),
    )
    e = load(spark, sf_dir, "orders").withColumn("e", F.col("o_orderkey") % 11)
    k, day = F.col("e"), F.to_date("o_orderdate")
    same = [F.lit(None).cast("timestamp_ntz").alias("start_at")]
    venue, commission = text("v", F.col("o_custkey") % 13), text("n", F.col("o_orderkey") % 7)
    doc_events = e.select(
        F.col("o_orderkey").alias("event_id"), F.when(k == 1, F.date_add(day, 30)).when(k == 2, F.date_sub(day, 3)).when(k == 7, F.date_add(day, 1)).otherwise(day).alias("event_date"), *same,
        F.when(k == 3, "cancelled").when(k == 4, "live").otherwise("scheduled").alias("status"), F.when(k == 5, "vx").otherwise(venue).alias("venue"), F.when(k == 6, "nx").otherwise(commission).alias("commission"),
    )
    events = e.filter(k != 0).select(F.col("o_orderkey").alias("event_id"), day.alias("event_date"), *same, F.lit("scheduled").alias("status"), venue.alias("venue"), commission.alias("commission"), (k == 7).alias("deferred"))
    return doc_events, docs, events, bouts


@named(LINES + """
SELECT o AS event_id, NULL AS ref, 'event_announced' AS type, NULL AS before, CAST(CAST(dat AS DATE) AS VARCHAR) AS after FROM ed WHERE e = 0
UNION ALL SELECT o, NULL, CASE WHEN dat > ts THEN 'event_postponed' ELSE 'event_date_changed' END, CAST(ts AS VARCHAR), CAST(dat AS VARCHAR) FROM ed WHERE e IN (1, 2)
UNION ALL SELECT o, NULL, CASE e WHEN 3 THEN 'event_cancelled' ELSE 'event_status_changed' END, 'scheduled', CASE e WHEN 3 THEN 'cancelled' ELSE 'live' END FROM ed WHERE e IN (3, 4)
UNION ALL SELECT o, NULL, 'venue_changed', CASE WHEN e <> 0 THEN venue END, CASE e WHEN 5 THEN 'vx' ELSE venue END FROM ed WHERE e IN (0, 5)
UNION ALL SELECT o, NULL, 'commission_changed', CASE WHEN e <> 0 THEN commission END, CASE e WHEN 6 THEN 'nx' ELSE commission END FROM ed WHERE e IN (0, 6)
UNION ALL SELECT o, ref_, 'bout_added', NULL, pair FROM j WHERE bout IS NULL
UNION ALL SELECT o, ref_, 'title_added', NULL, title || ':' || CASE WHEN v = 13 THEN a ELSE '-' END FROM j WHERE v IN (12, 13) AND title IS NOT NULL AND bout IS NULL
UNION ALL SELECT o, ref_, 'title_added', NULL, 'tn:-' FROM j WHERE v = 12
UNION ALL SELECT o, ref_, 'official_assigned', NULL, 'referee:-:' || CASE WHEN v = 14 THEN 'rr' ELSE ref END FROM j WHERE v IN (14, 15) AND bout IS NULL
UNION ALL SELECT o, ref_, 'opponent_replaced', sb, b FROM j WHERE how = 'external_id' AND v = 0
UNION ALL SELECT o, ref_, 'bout_cancelled', sstatus, 'cancelled' FROM j WHERE bout IS NOT NULL AND v = 6
UNION ALL SELECT o, ref_, 'scheduled_rounds_changed', CAST(srounds AS VARCHAR), CAST(rounds + 2 AS VARCHAR) FROM j WHERE bout IS NOT NULL AND v = 7 AND srounds <> rounds + 2
UNION ALL SELECT o, ref_, 'contracted_weight_changed', CAST(sq AS VARCHAR), CAST(q + 1 AS VARCHAR) FROM j WHERE bout IS NOT NULL AND v = 8 AND sq <> q + 1
UNION ALL SELECT o, ref_, 'weight_class_changed', sclass, CASE WHEN v = 9 THEN 'dX' END FROM j WHERE bout IS NOT NULL AND v IN (9, 10)
UNION ALL SELECT o, ref_, 'title_removed', stitle || ':-', NULL FROM j WHERE bout IS NOT NULL AND stitle IS NOT NULL AND (v = 11 OR (v IN (12, 13) AND title IS DISTINCT FROM stitle))
UNION ALL SELECT o, ref_, 'title_added', NULL, title || ':' || CASE WHEN v = 13 THEN a ELSE '-' END FROM j WHERE bout IS NOT NULL AND v IN (12, 13) AND title IS NOT NULL AND title IS DISTINCT FROM stitle
UNION ALL SELECT o, ref_, 'title_eligibility_changed', stitle || ':-', title || ':' || a FROM j WHERE bout IS NOT NULL AND v = 13 AND title = stitle
UNION ALL SELECT o, ref_, 'official_replaced', 'referee:-:' || sref, 'referee:-:' || CASE WHEN v = 14 THEN 'rr' ELSE ref END FROM j WHERE bout IS NOT NULL AND (v = 14 OR (v = 15 AND ref <> sref))
UNION ALL SELECT o, ref_, 'official_removed', 'judge:1:' || sjudge, NULL FROM j WHERE bout IS NOT NULL AND v = 15
UNION ALL SELECT o, ref_, 'official_removed', 'referee:-:' || sref, NULL FROM j WHERE bout IS NOT NULL AND v = 15 AND ref <> sref
UNION ALL SELECT o, ref_, 'card_order_changed', CAST(srn AS VARCHAR), CAST(rn + 1 AS VARCHAR) FROM j WHERE bout IS NOT NULL AND v = 16 AND srn <> rn + 1
UNION ALL SELECT o, ref_, 'card_segment_changed', ssegment, 'undercard' FROM j WHERE bout IS NOT NULL AND v = 17
""")
def card_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change that a document of each card makes to the card on record."""
    return cd.card_changes(*cards(spark, sf_dir), lying=True)[0]


@named(LINES + """
SELECT o AS event_id, 'event_field_disagreement' AS reason, 'event_date: ' || date || ' or ' || CAST(dat AS DATE) AS detail FROM ed WHERE e = 7
UNION ALL SELECT o, 'possible_replacement_without_external_id', ref_ || ' for ' || bouts FROM (SELECT j.o, j.ref_, string_agg(DISTINCT s.bout, ',' ORDER BY s.bout) AS bouts FROM j JOIN s ON s.o = j.o AND s.status <> 'complete' AND (s.a IN (j.a, j.b) OR s.b IN (j.a, j.b)) WHERE j.bout IS NULL AND j.x IS NULL GROUP BY ALL)
""")
def card_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person must look at in those documents."""
    return cd.card_changes(*cards(spark, sf_dir), lying=True)[1]


@named("""
WITH l AS (SELECT o_custkey AS k, year(o_orderdate) AS y, 'Part' || l_partkey % 50 AS a, 'Supp' || l_suppkey AS b, min(l_linenumber) AS rounds, min(l_returnflag) AS titles, min(l_orderkey) AS bout_order FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) IN (1997, 1998) GROUP BY ALL),
p AS (SELECT *, a || ' vs ' || b AS pair FROM l WHERE y = 1997), n AS (SELECT *, a || ' vs ' || b AS pair FROM l WHERE y = 1998), bo AS (SELECT n.k, p.rounds AS pr, n.rounds AS nr, p.titles AS pt, n.titles AS nt, p.bout_order AS po, n.bout_order AS no FROM p JOIN n ON p.k = n.k AND p.a = n.a AND p.b = n.b),
came AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = n.k AND p.pair = n.pair)), gone AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE p.k = n.k AND p.pair = n.pair)),
f AS (SELECT came.k, came.pair AS is_, arg_min(p.pair, (p.bout_order, p.pair)) AS was FROM came LEFT JOIN p ON p.k = came.k AND (p.a = came.a OR p.b = came.b) GROUP BY ALL)
SELECT k, 'CHANGED_ROUNDS' AS change, CAST(pr AS VARCHAR) AS was, CAST(nr AS VARCHAR) AS is_ FROM bo WHERE pr <> nr UNION ALL SELECT k, 'CHANGED_TITLE', pt, nt FROM bo WHERE pt <> nt UNION ALL SELECT k, 'CHANGED_CARD_POSITION', CAST(po AS VARCHAR), CAST(no AS VARCHAR) FROM bo WHERE po <> no
UNION ALL SELECT k, CASE WHEN was IS NULL THEN 'NEW_BOUT' ELSE 'CHANGED_OPPONENT' END, was, is_ FROM f UNION ALL SELECT k, 'REMOVED_BOUT', pair, NULL FROM gone WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = gone.k AND (n.a = gone.a OR n.b = gone.b))
""")
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's list of parts by supplier changed from one year to the next, as a source's listing of a card would."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).filter(F.col("y").isin(1997, 1998))
    l = load(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("k", "y", F.concat(F.lit("Part"), F.col("l_partkey") % 50).alias("a"), F.concat(F.lit("Supp"), "l_suppkey").alias("b"), "l_linenumber", "l_returnflag", "l_orderkey")
    listed = l.groupBy("k", "y", "a", "b").agg(F.min("l_linenumber").alias("rounds"), F.min("l_returnflag").alias("titles"), F.min("l_orderkey").alias("bout_order"))
    year = lambda y: listed.filter(F.col("y") == y).drop("y")
    return cd.listing_delta(year(1997), year(1998), ["k"])


@named(PEOPLE + """,
bt AS (SELECT x.o_orderkey AS o, x.k AS ka, y.k AS kb, r.o_orderdate AS starts FROM o x JOIN orders r ON r.o_orderkey = x.o_orderkey JOIN o y ON y.o_orderkey = x.o_orderkey + 1 WHERE x.k <> y.k),
ev AS (SELECT o, ka, kb, o % 7 AS way, CASE WHEN o % 35 = 4 THEN NULL ELSE starts + to_days(CAST(o % 4 AS INTEGER)) END AS ts, CASE WHEN o % 9 = 0 THEN o WHEN o % 9 = 3 THEN -o WHEN o % 45 = 6 THEN o + 1 END AS mapped FROM bt WHERE o % 3 = 0),
nm AS (SELECT *, CASE WHEN way = 1 THEN kb WHEN way = 6 THEN NULL ELSE ka END AS home, CASE WHEN way = 1 THEN ka WHEN way = 4 THEN NULL WHEN way = 5 THEN ka ELSE kb END AS away FROM ev),
met AS (SELECT nm.o, b.o AS bout, b.starts, CASE home WHEN b.ka THEN 'a' WHEN b.kb THEN 'b' END AS h, CASE away WHEN b.ka THEN 'a' WHEN b.kb THEN 'b' END AS w, b.o = mapped AS is_map, abs(epoch(b.starts) - epoch(ts)) <= 172800 AS near FROM nm JOIN bt b ON home IN (b.ka, b.kb) OR away IN (b.ka, b.kb)),
f AS (SELECT o, count(*) FILTER (near AND h IS NOT NULL AND w IS NOT NULL AND h <> w) AS hits, min(bout) FILTER (near AND h IS NOT NULL AND w IS NOT NULL AND h <> w) AS hit, arg_min(h, bout) FILTER (near AND h IS NOT NULL AND w IS NOT NULL AND h <> w) AS side, count(*) FILTER (near AND NOT coalesce(h <> w, FALSE)) AS partial, min(h) FILTER (is_map AND h <> w) AS map_side FROM met GROUP BY o),
t AS (SELECT nm.o, ts, mapped, f.* EXCLUDE (o), EXISTS (SELECT 1 FROM bt b WHERE b.o = mapped) AS alive, EXISTS (SELECT 1 FROM bt b WHERE abs(epoch(b.starts) - epoch(ts)) <= 172800) AS any_near FROM nm LEFT JOIN f USING (o)),
r AS (SELECT *, CASE WHEN ts IS NULL THEN 'invalid_time' WHEN mapped IS NOT NULL AND NOT alive THEN 'mapped_bout_not_schedulable' WHEN mapped IS NOT NULL THEN CASE WHEN map_side IS NOT NULL THEN 'existing_mapping' ELSE 'mapped_bout_participant_mismatch' END WHEN hits = 1 THEN 'both_corners_resolved' WHEN hits > 1 THEN 'ambiguous_multiple_bouts'
  WHEN NOT any_near THEN 'no_candidate_bout_in_window' WHEN partial > 0 THEN 'no_bout_with_both_fighters' ELSE 'participants_not_found' END AS outcome FROM t)
SELECT o AS event, CASE outcome WHEN 'both_corners_resolved' THEN hit WHEN 'existing_mapping' THEN mapped END AS bout_id, CASE outcome WHEN 'both_corners_resolved' THEN side WHEN 'existing_mapping' THEN map_side END AS home_side, outcome FROM r
""")
def two_corner_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bout (a customer's order against the next order's customer) each of a provider's events is, by both corners' names."""
    # a name stands for one customer here: three syllables make few surnames and near ones, so consonants by the number's hash follow, of which any two customers' differ in most places
    rest = F.translate(F.lpad(F.lower(F.hex(F.xxhash64("k"))), 16, "0"), "0123456789abcdef", "bcdfgjklmnprstvz")
    p = people(spark, sf_dir).select("k", "first", "next_first", F.concat("last", rest).alias("last"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    other = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("kb"))
    bt = o.withColumnRenamed("o_custkey", "ka").join(other, "o_orderkey").filter("ka <> kb")
    of = lambda side: p.select(F.col("k").alias(f"k{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("first", "next_first", "last")])
    bt = bt.join(of("a"), "ka").join(of("b"), "kb")
    plain = lambda side: F.concat_ws(" ", f"first_{side}", f"last_{side}")
    bouts = bt.select(F.col("o_orderkey").alias("bout_id"), F.col("o_orderdate").alias("starts_at"), "last_a", "last_b", plain("a").alias("name_a"), plain("b").alias("name_b"))
    k, way = F.col("o_orderkey"), F.col("o_orderkey") % 7
    initial = F.concat(F.substring("first_a", 1, 1), F.lit(". "), "last_a")
    home = F.when(way == 1, plain("b")).when(way.isin(2, 5), initial).when(way == 3, F.col("last_a")).when(way == 6, F.concat_ws(" ", "next_first_a", "last_a")).otherwise(plain("a"))
    away = F.when(way.isin(1, 5), plain("a")).when(way == 4, F.lit("someone else")).otherwise(plain("b"))
    events = bt.filter(k % 3 == 0).select(
        k.alias("event"), F.when(k % 35 != 4, F.col("o_orderdate") + F.make_dt_interval((k % 4).cast("int"))).alias("at"), F.when(k % 9 == 0, k).when(k % 9 == 3, -k).when(k % 45 == 6, k + 1).alias("mapped"), home.alias("home"), away.alias("away"),
        F.array("last_a", "last_b").alias("lasts"),
    )
    # each different name is parsed once
    texts = p.select(F.concat_ws(" ", "first", "last").alias("text")).union(events.select("home")).union(events.select("away")).distinct()
    known = cut(texts.select("text", nm.parsed(nm.romanised(F.col("text"))).alias("p"))).withColumn("p", F.col("p").dropFields("keys"))
    of_text = lambda text, name: known.select(F.col("text").alias(text), F.col("p").alias(name))
    # names meet corners by surname, as all of a name's forms have it; the other corner need not meet
    surname = lambda text: known.select(F.col("text").alias(text), F.element_at("p.core", -1).alias(f"last_{text}"))
    asked = events.join(surname("home"), "home").join(surname("away"), "away")
    # only bouts near in time, or one that an earlier match names, can count: those of a surname meet by days before any names are compared
    surnames = F.explode(F.array_distinct(F.array("last_home", "last_away"))).alias("last")
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    said = asked.select("event", "at", surnames).withColumn("day", F.explode(F.sequence(day("at") - cd.NEAR_DAYS, day("at") + cd.NEAR_DAYS)))
    there = bouts.select("bout_id", day("starts_at").alias("day"), F.explode(F.array_distinct(F.array("last_a", "last_b"))).alias("last"))
    pairs = said.join(there, ["last", "day"]).select("event", "bout_id").union(events.filter("mapped IS NOT NULL").select("event", F.col("mapped").alias("bout_id"))).distinct()
    met = pairs.join(events.select("event", "home", "away"), "event").join(bouts.select("bout_id", "name_a", "name_b"), "bout_id")
    for text, name in (("home", "ph"), ("away", "pw"), ("name_a", "pa"), ("name_b", "pb")):
        met = met.join(of_text(text, name), text)
    side = lambda name: cd.corner_of(F.col(name), F.col("pa"), F.col("pb"))
    corners = met.select("event", "bout_id", side("ph").alias("home"), side("pw").alias("away"))
    return cd.two_corner_match(events.select("event", "at", "mapped"), bouts.select("bout_id", "starts_at"), corners)
