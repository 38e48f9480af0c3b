"""Career graphs on derived lives: people of `identities`, their orders as contests, some of them only known as appearances under a name.

The initial h. and hugo have one skeleton, so they count as spellings of one name. An order with a number that leaves 1 on division by 4 is an appearance; the others are contests on record, some of which also stand in a second document, or twice on one card.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.operators import names as nm
from tessera.operators import resolution as rs
from tessera.sources.tables import load

from .catalog import named
from .identities import PEOPLE, people

SHEETS = PEOPLE.replace("o AS (SELECT o_orderkey", "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date", 1) + """,
x AS (SELECT * FROM (SELECT l_orderkey, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1),
c AS (SELECT o.*, 'n' || o_orderkey % 7 AS commission, 'v' || l_suppkey % 11 AS venue, strftime(date, '%Y-%m-%d') || '-n' || o_orderkey % 7 AS event, 's' || l_suppkey AS opponent, CASE WHEN o_orderkey % 13 <> 0 THEN 140 + k % 40 + l_partkey % 9 + CASE WHEN o_orderkey % 29 = 0 THEN 40 ELSE 0 END END AS weight,
  'city' || k % 50 || ', ' || nation AS town FROM o JOIN x ON o_orderkey = l_orderkey),
b AS (SELECT 'p' || k AS entity, 'b' || o_orderkey AS bout, event, date, o_orderkey % 5 <> 0 AS complete, commission, venue, opponent, weight FROM c WHERE o_orderkey % 4 <> 1),
a AS (SELECT 'a' || o_orderkey AS app, o_orderkey, k, first, last, event, date, commission, venue, CASE WHEN o_orderkey % 9 = 0 THEN 'elsewhere, ' || nation WHEN o_orderkey % 9 <> 1 THEN town END AS town, weight, o_orderkey % 31 = 0 AS debut, CASE WHEN o_orderkey % 8 = 1 THEN opponent END AS opponent, CAST(NULL AS VARCHAR) AS bout FROM c WHERE o_orderkey % 4 = 1
  UNION ALL SELECT 'd' || o_orderkey, o_orderkey, k, first, last, 'doc' || o_orderkey, date + CAST(o_orderkey // 12 % 2 AS INTEGER), commission, venue, town, weight, FALSE, opponent, NULL FROM c WHERE o_orderkey % 12 = 0
  UNION ALL SELECT 'r' || o_orderkey, o_orderkey, k, first, last, event, date, commission, venue, town, weight, FALSE, opponent, 'b' || o_orderkey || '|2' FROM c WHERE o_orderkey % 20 = 0),
"""


#: Which orders are appearances, and how often.
APPEARANCES = "o_orderkey % 4 = 1 OR o_orderkey % 12 = 0 OR o_orderkey % 20 = 0"
APPEARANCES_OF = "CAST(o_orderkey % 4 = 1 AS INT) + CAST(o_orderkey % 12 = 0 AS INT) + CAST(o_orderkey % 20 = 0 AS INT)"


def printed() -> Column:
    way, first, last = F.col("o_orderkey") % 5, F.col("first"), F.col("last")
    return F.when(way == 2, F.concat(last, F.lit(", "), first)).when(way == 3, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).when(way == 4, F.concat_ws(" ", first, last, F.lit("Jr."))).otherwise(F.concat_ws(" ", first, last))


def sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, contests on record, appearances with the printed name)."""
    p, o = people(spark, sf_dir), F.col("o_orderkey")
    x = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("x"))
    c = load(spark, sf_dir, "orders").join(p, F.col("o_custkey") == F.col("k")).join(x, o == F.col("l_orderkey"))
    text = lambda *parts: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in parts])
    c = c.withColumns({
        "date": F.to_date("o_orderdate"), "commission": text("n", o % 7), "venue": text("v", F.col("x.l_suppkey") % 11), "event_id": text(F.date_format("o_orderdate", "yyyy-MM-dd"), "-n", o % 7), "opponent": text("s", F.col("x.l_suppkey")),
        "weight": F.when(o % 13 != 0, 140 + F.col("k") % 40 + F.col("x.l_partkey") % 9 + F.when(o % 29 == 0, 40).otherwise(0)).cast("double"), "town": text("city", F.col("k") % 50, ", ", F.col("nation")),
    })
    bouts = c.filter(o % 4 != 1).select(text("p", F.col("k")).alias("entity_id"), text("b", o).alias("bout_id"), "event_id", "date", (o % 5 != 0).alias("complete"), "commission", "venue", F.col("opponent").alias("opponent_id"), "weight", F.lit(None).cast("int").alias("bout_order"), F.concat_ws(" ", "first", "last").alias("known"))
    none = F.lit(None).cast("string")
    shared = ["k", "first", "last", "o_orderkey", "commission", "venue", "weight"]
    a = c.filter(o % 4 == 1).select(text("a", o).alias("app_id"), *shared, "event_id", "date", F.when(o % 9 == 0, text("elsewhere, ", F.col("nation"))).when(o % 9 != 1, F.col("town")).alias("hometown"), (o % 31 == 0).alias("debut"), F.when(o % 8 == 1, F.col("opponent")).alias("opponent_id"), none.alias("bout_id"))
    d = c.filter(o % 12 == 0).select(text("d", o).alias("app_id"), *shared, text("doc", o).alias("event_id"), F.date_add("date", (F.floor(o / 12) % 2).cast("int")).alias("date"), F.col("town").alias("hometown"), F.lit(False).alias("debut"), F.col("opponent").alias("opponent_id"), none.alias("bout_id"))
    r = c.filter(o % 20 == 0).select(text("r", o).alias("app_id"), *shared, "event_id", "date", F.col("town").alias("hometown"), F.lit(False).alias("debut"), F.col("opponent").alias("opponent_id"), text("b", o, "|2").alias("bout_id"))
    apps = a.unionByName(d).unionByName(r).withColumns({"name": printed(), "may_create": o % 3 != 0, "bout_order": F.lit(None).cast("int"), "other_app": none})
    return p, bouts, apps


@named(SHEETS + """
pairs AS (SELECT a.*, 'p' || e.k AS entity, CASE WHEN e.first <> a.first THEN 'none' WHEN o_orderkey % 5 = 2 THEN 'reordered' WHEN o_orderkey % 5 = 3 AND a.first = 'hugo' THEN 'transliteration' WHEN o_orderkey % 5 = 3 THEN 'initial' WHEN o_orderkey % 5 = 4 THEN 'containment' ELSE 'exact' END AS level FROM a JOIN e ON e.last = a.last),
towns AS (SELECT 'p' || k AS entity, 'city' || k % 50 || ', ' || lower(nation) AS town FROM e),
m AS (SELECT p.app, p.entity, b.bout, b.weight, abs(date_diff('day', b.date, p.date)) AS days, coalesce(b.event = p.event, FALSE) AS same_event, coalesce(b.opponent = p.opponent AND abs(date_diff('day', b.date, p.date)) <= 1, FALSE) AS fight, coalesce(b.event = p.event AND b.bout <> p.bout, FALSE) AS differs,
  b.commission = p.commission AS here, b.venue = p.venue AS there, b.opponent = p.opponent AS rematch, b.complete AND date_diff('day', b.date, p.date) > 1 AS earlier FROM pairs p JOIN b ON b.entity = p.entity),
n AS (SELECT app, entity, bool_or(fight AND NOT differs) AS same_fight, bool_or(fight AND differs) AS again, bool_or(NOT same_event AND NOT fight AND days <= 2 AND NOT (here AND there)) AS elsewhere, bool_or(NOT same_event AND NOT fight AND days <= 2 AND here AND there) AS twice,
  bool_or(NOT same_event AND NOT fight AND days > 2 AND days <= 13) AS close, arg_min(weight, (days, bout)) FILTER (NOT same_event AND NOT fight AND days <= 400 AND weight IS NOT NULL) AS weighed, bool_or(here AND NOT same_event AND NOT fight) AS here, bool_or(there AND NOT same_event AND NOT fight) AS there, bool_or(rematch AND NOT same_event AND NOT fight) AS rematch, bool_or(earlier) AS earlier FROM m GROUP BY ALL),
ev AS (SELECT p.app, p.entity, level, p.opponent, coalesce(same_fight, FALSE) AS same_fight, coalesce(again, FALSE) AS again, list_filter([CASE WHEN t.town = lower(p.town) THEN 'hometown' END, CASE WHEN here THEN 'jurisdiction' END, CASE WHEN rematch THEN 'opponent_graph' END, CASE WHEN there THEN 'venue' END, CASE WHEN abs(p.weight - weighed) <= greatest(8, 0.05 * p.weight) THEN 'weight' END], lambda f: f IS NOT NULL) AS families,
  list_filter([CASE WHEN level = 'containment' THEN 'suffix_missing' END, CASE WHEN t.town <> lower(p.town) THEN 'hometown_different_city' END, CASE WHEN twice THEN 'possible_duplicate_event' END, CASE WHEN close THEN 'fought_within_13_days' END, CASE WHEN abs(p.weight - weighed) > greatest(20, 0.12 * p.weight) THEN 'weight_incompatible' END], lambda f: f IS NOT NULL) AS soft,
  coalesce(elsewhere, FALSE) OR coalesce(debut AND earlier, FALSE) AS hard FROM pairs p JOIN towns t USING (entity) LEFT JOIN n ON n.app = p.app AND n.entity = p.entity),
w AS (SELECT *, CASE WHEN hard THEN 'D' WHEN (same_fight OR again) AND level IN ('exact', 'reordered', 'transliteration', 'containment') AND len(soft) = 0 THEN 'A' WHEN level IN ('exact', 'reordered') AND len(soft) = 0 AND list_contains(families, 'hometown') AND list_contains(families, 'weight') AND len(families) >= 3 THEN 'B' ELSE 'C' END AS tier FROM ev),
s AS (SELECT *, CASE tier WHEN 'D' THEN 0 WHEN 'A' THEN 98 ELSE greatest(0, least(CASE tier WHEN 'B' THEN 95 ELSE 79 END, 40 + CASE WHEN level IN ('exact', 'reordered') THEN 20 WHEN level IN ('transliteration', 'containment') THEN 10 ELSE 0 END + len(families) * 9 - len(soft) * 15)) END AS confidence FROM w WHERE level <> 'none'),
g AS (SELECT app, count(*) AS alike, count(*) FILTER (tier <> 'D') AS live, arg_min(entity, (-confidence, entity)) FILTER (tier <> 'D') AS entity, arg_min(tier, (-confidence, entity)) FILTER (tier <> 'D') AS tier, arg_min(confidence, (-confidence, entity)) FILTER (tier <> 'D') AS confidence,
  arg_min(again, (-confidence, entity)) FILTER (tier <> 'D') AS again, arg_min(array_to_string(families, '+'), (-confidence, entity)) FILTER (tier <> 'D') AS families, arg_min(array_to_string(soft, '+'), (-confidence, entity)) FILTER (tier <> 'D') AS soft FROM s GROUP BY app),
t AS (SELECT a.app AS app_id, o_orderkey % 3 <> 0 AS may_create, g.* EXCLUDE (app) FROM a LEFT JOIN g ON g.app = a.app)
SELECT app_id, CASE WHEN alike IS NULL THEN 'none' WHEN live = 0 THEN CASE WHEN may_create THEN 'created' ELSE 'review' END WHEN live > 1 THEN 'review' WHEN tier IN ('A', 'B') THEN 'matched' ELSE 'review' END AS decision, CASE WHEN alike IS NULL THEN NULL WHEN live = 0 THEN CASE WHEN may_create THEN 'D' ELSE 'C' END WHEN live > 1 THEN 'C' ELSE tier END AS tier,
  CASE WHEN live = 1 AND tier IN ('A', 'B') THEN entity END AS entity_id, CASE WHEN alike IS NULL THEN NULL WHEN live = 0 THEN CASE WHEN may_create THEN 90 ELSE 0 END ELSE confidence END AS confidence,
  CASE WHEN alike IS NULL THEN 'no_name_similar_candidates' WHEN live = 0 THEN CASE WHEN may_create THEN 'every_name_similar_candidate_conflicts' ELSE 'every_candidate_conflicts_source_cannot_create' END WHEN live > 1 THEN 'more_than_one_plausible_candidate' WHEN tier = 'A' THEN CASE WHEN again THEN 'repeat_pairing_identity_continuity' ELSE 'same_fight_already_on_record' END
    WHEN tier = 'B' THEN 'graph:' || families WHEN soft <> '' THEN 'contradiction:' || soft ELSE 'insufficient_graph_evidence:' || CASE WHEN families = '' THEN 'none' ELSE families END END AS reason, coalesce(alike, 0) AS candidates FROM t
""")
def career_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which person each appearance under a name is, by the person's other contests, or why that is left open."""
    p, bouts, apps = sheets(spark, sf_dir)
    id_, known = F.concat(F.lit("p"), "k"), F.concat_ws(" ", "first", "last").alias("known")
    # names meet by surname, each different one once; orders without lines have a name too, so that these are a bound that needs no lines
    said = load(spark, sf_dir, "orders").join(p, F.col("o_custkey") == F.col("k"))
    said = gr.cut(said.filter(APPEARANCES).withColumn("name", printed()).groupBy("name", "last").agg(F.sum(F.expr(APPEARANCES_OF)).alias("n")))
    pairs = said.select("name", "last").join(p.select("last", known).distinct(), "last").select(F.col("name").alias("obs_id"), F.col("known").alias("entity_id"))
    texts = lambda df, id_: rs.named(df, id_, F.array(F.struct(F.col(id_).alias("text"), F.lit("name").alias("kind"))))
    level = rs.name_evidence(pairs, texts(said.select(F.col("name").alias("obs_id")), "obs_id"), texts(p.select(known.alias("entity_id")).distinct(), "entity_id"))
    # no decision counts persons of other names
    alike = gr.cut(level.withColumnsRenamed({"obs_id": "name", "entity_id": "known"}).filter(F.col("level").isin([*nm.STRONG, *nm.WEAK])))
    towns = p.select(id_.alias("entity_id"), F.concat(F.lit("city"), F.col("k") % 50, F.lit(", "), "nation").alias("hometown"))
    return gr.decided_by_names(apps, p.select(id_.alias("entity_id"), known), alike, bouts, towns, said.select("name", "n"))


PASSES = 4
_PASS = "p{n} AS (SELECT DISTINCT e.a AS k FROM e JOIN ({all}) h ON e.b = h.k WHERE e.a NOT IN (SELECT k FROM ({all})) GROUP BY e.a HAVING count(*) >= 2)"
_ALL = [" UNION ALL ".join(f"SELECT k, {i} AS found_in FROM p{i}" for i in range(n + 1)) for n in range(PASSES + 1)]


@named("""
WITH t AS (SELECT DISTINCT o_custkey AS k, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM t x JOIN t y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey AND x.k <> y.k),
p0 AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 = 0), """ + ", ".join(_PASS.format(n=n, all=_ALL[n - 1]) for n in range(1, PASSES + 1)) + f" SELECT * FROM ({_ALL[PASSES]})")
def binding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers bound pass by pass: every tenth to begin with, then those who bought the same part of the same supplier as two bound ones did, for four passes at most."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    t = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), "l_partkey", "l_suppkey").distinct()
    edges = gr.cut(t.join(t.withColumnRenamed("k", "b"), ["l_partkey", "l_suppkey"]).filter("k <> b").select(F.col("k").alias("a"), "b").distinct())

    def step(delta: DataFrame, held: DataFrame) -> DataFrame:
        # only neighbours of what came last can have gained one
        touched = edges.join(delta.select(F.col("k").alias("b")), "b", "left_semi").select("a").distinct()
        met = edges.join(touched, "a", "left_semi").join(held.select(F.col("k").alias("b")), "b", "left_semi")
        return met.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("n")).filter("n >= 2").select("k")

    start = load(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("k"))
    return gr.fixed_point(start, step, ["k"], PASSES)
