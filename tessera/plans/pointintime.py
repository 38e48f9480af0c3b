"""Histories as they were known, on a contest graph of the test tables.

An order is a contest of a customer (side a) with the supplier of its first line (side b). It starts on the order's date, and its result is known once the last line
has shipped. Priority 4 is no contest, 5 an unknown outcome; otherwise status F is a win of side a, O of side b, P a draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import half_up, ratio
from tessera.operators import history as hs
from tessera.sources.tables import load

from .catalog import named

CONTESTS = """
WITH first AS (SELECT * FROM (SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_linenumber, l_tax, l_discount, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS known,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_tax, l_discount) AS rn FROM lineitem) WHERE rn = 1),
g AS (SELECT o_orderkey, o_orderdate AS starts, CAST(known AS DATE) AS known, 'c' || o_custkey AS a, 's' || l_suppkey AS b, l_partkey, l_linenumber, l_tax, l_discount, l_quantity AS q,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'no_contest' WHEN o_orderstatus = 'P' THEN 'draw' ELSE 'win' END AS outcome,
  CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'b' END END AS winner FROM orders JOIN first ON o_orderkey = l_orderkey),
ap AS (SELECT g.*, s AS side, CASE WHEN s = 'a' THEN a ELSE b END AS subject, CASE WHEN s = 'a' THEN b ELSE a END AS opponent, CASE WHEN outcome = 'win' THEN CASE WHEN winner = s THEN 'win' ELSE 'loss' END ELSE outcome END AS result FROM g, (VALUES ('a'), ('b')) v(s))
"""
RECORDS = CONTESTS + """,
asked AS (SELECT o_orderkey, side, subject, starts AS before, CAST(starts AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS cutoff FROM ap),
rec AS (SELECT p.o_orderkey, p.side, p.subject, count(f.result) AS contests, count(*) FILTER (f.result = 'win') AS wins, count(*) FILTER (f.result = 'loss') AS losses, count(*) FILTER (f.result = 'draw') AS draws,
  arg_max(f.o_orderkey, (f.starts, f.o_orderkey)) AS last_contest, arg_max(CASE WHEN f.o_orderkey IS NOT NULL THEN coalesce(f.result, 'unknown') END, (f.starts, f.o_orderkey)) AS last_result
  FROM asked p LEFT JOIN ap f ON f.subject = p.subject AND f.starts < p.before AND f.known <= p.cutoff GROUP BY ALL)
"""


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a contest: who met (a, b), when it starts and when it is known, outcome (null if unknown) and winner (a side), and the first line's columns that other stand-ins are made of."""
    own = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_tax", "l_discount"]
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct(*own)).alias("x"), F.max("l_shipdate").cast("date").alias("known"))
    o = load(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    outcome = F.when(priority == "5-LOW", None).when(priority == "4-NOT SPECIFIED", "no_contest").when(status == "P", "draw").otherwise("win")
    return o.select(
        "o_orderkey", F.col("o_orderdate").alias("starts"), "known", F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "x.l_suppkey").alias("b"), "x.l_partkey", "x.l_linenumber", "x.l_tax", "x.l_discount",
        F.col("x.l_quantity").alias("q"), outcome.alias("outcome"), F.when(~priority.isin("4-NOT SPECIFIED", "5-LOW"), F.when(status == "F", "a").when(status == "O", "b")).alias("winner"),
    )


def appearances(contests_: DataFrame) -> DataFrame:
    """Each contest from both sides: side, subject, opponent and result (win, loss, draw, no_contest; null if unknown)."""
    rows = contests_.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))
    of = lambda own, other: F.when(F.col("side") == "a", F.col(own)).otherwise(F.col(other))
    result = F.when(F.col("outcome") == "win", F.when(F.col("winner") == F.col("side"), "win").otherwise("loss")).otherwise(F.col("outcome"))
    return rows.withColumns({"subject": of("a", "b"), "opponent": of("b", "a"), "result": result})


def records_entering(rows: DataFrame, probes: DataFrame, values: dict[str, str] | None = None) -> DataFrame:
    """probes with contests, wins, losses and draws of their subject before `before`, as known at `cutoff`, and with values of the last such contest. Subjects with very many contests are dealt out by months."""
    counts = {"contests": F.col("result").isNotNull(), **{n: F.col("result").eqNullSafe(r) for n, r in (("wins", "win"), ("losses", "loss"), ("draws", "draw"))}}
    facts = rows.select("subject", "starts", "known", "result", "o_orderkey").withColumn("told", F.coalesce("result", F.lit("unknown")))
    return hs.as_of(facts, probes, ["subject"], "starts", hs.day_number(F.col("known")), "before", hs.day_number(F.col("cutoff")), counts, values or {}, "o_orderkey", F.trunc("__at", "month"))


def probes_of(rows: DataFrame, *more: Column) -> DataFrame:
    """Each appearance asks for its subject's record before it, as known some days (0 to 89, by its number) after."""
    return rows.select("o_orderkey", "side", "subject", F.col("starts").alias("before"), F.date_add("starts", (F.col("o_orderkey") % 90).cast("int")).alias("cutoff"), *more)


@named(RECORDS + "SELECT * FROM rec")
def history_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each side of each contest on entering it, as known at a cutoff of its own, and its last known contest."""
    rows = appearances(contests(spark, sf_dir))
    return records_entering(rows, probes_of(rows), {"o_orderkey": "last_contest", "told": "last_result"}).drop("before", "cutoff")


SOURCED = "a.o_orderkey % 7 = 0"
QUALITY = RECORDS + f""",
told AS (SELECT a.o_orderkey, a.side, a.subject, {SOURCED} AS sourced, CASE WHEN {SOURCED} THEN a.o_orderkey % 31 ELSE r.wins END AS w, CASE WHEN {SOURCED} THEN a.o_orderkey % 5 ELSE r.losses END AS l,
  CASE WHEN {SOURCED} THEN 0 ELSE r.draws END AS d, CASE WHEN {SOURCED} THEN a.o_orderkey % 31 + a.o_orderkey % 5 ELSE r.contests END AS n
  FROM ap a JOIN rec r ON r.o_orderkey = a.o_orderkey AND r.side <> a.side),
quality AS (SELECT *, coalesce(CAST(w AS DOUBLE) / nullif(w + l + d, 0), 0) AS win_share, 0.5 * coalesce(CAST(w AS DOUBLE) / nullif(w + l + d, 0), 0) + 0.5 * least(n, 30) / 30.0::DOUBLE AS quality FROM told)
"""


def opposition(rows: DataFrame) -> DataFrame:
    """For each appearance its result, its opponent's record on entering (w, l, d, n), whether a source tells it or the graph, its share of wins and its quality.

    A sourced record stands before that of the graph. Stand-in: contests with a number divisible by seven come with a sourced record.
    """
    # an opponent's probe carries what is told of the other side, so that they need not meet again
    result = F.when(F.col("result") == "win", "loss").when(F.col("result") == "loss", "win").otherwise(F.col("result"))
    known = records_entering(rows, probes_of(rows, F.col("opponent").alias("other"), result.alias("result")))
    sourced, k = F.col("o_orderkey") % 7 == 0, F.col("o_orderkey")
    told = known.select(
        "o_orderkey", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), F.col("other").alias("subject"), "result", sourced.alias("sourced"), F.when(sourced, k % 31).otherwise(F.col("wins")).alias("w"), F.when(sourced, k % 5).otherwise(F.col("losses")).alias("l"),
        F.when(sourced, 0).otherwise(F.col("draws")).alias("d"), F.when(sourced, k % 31 + k % 5).otherwise(F.col("contests")).alias("n"),
    )
    w, l, d, n = (F.col(c) for c in "wldn")
    return told.withColumn("win_share", F.coalesce(w / F.nullif(w + l + d, F.lit(0)), F.lit(0.0))).withColumn("quality", hs.entering_quality(w, l, d, n))


@named(QUALITY + "SELECT o_orderkey, side, subject, sourced, n, floor(win_share * 10000 + 0.5) / 10000 AS win_share, floor(quality * 10000 + 0.5) / 10000 AS quality FROM quality")
def opponent_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each side's opponent on entering the contest: half its share of wins, half its experience, never anything that was known later."""
    found = opposition(appearances(contests(spark, sf_dir)))
    return found.select("o_orderkey", "side", "subject", "sourced", "n", half_up(F.col("win_share")).alias("win_share"), half_up(F.col("quality")).alias("quality"))


@named(QUALITY + """
SELECT ap.subject, count(*) AS decided, count(*) FILTER (result = 'win') AS wins, floor(sum(CASE WHEN result = 'win' THEN CAST(quality AS DECIMAL(28,10)) ELSE 0 END)::DOUBLE / nullif(sum(CAST(quality AS DECIMAL(28,10)))::DOUBLE, 0) * 10000 + 0.5) / 10000 AS adjusted_rate
FROM ap JOIN quality q ON q.o_orderkey = ap.o_orderkey AND q.side = ap.side WHERE result IN ('win', 'loss', 'draw') GROUP BY ap.subject HAVING count(*) >= 5
""")
def opponent_adjusted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of wins of subjects with five decided contests, each weighted by its opponent's quality on entering; null where no opponent had any."""
    met = opposition(appearances(contests(spark, sf_dir))).filter(F.col("result").isin("win", "loss", "draw")).select("subject", (F.col("result") == "win").alias("won"), F.col("quality").cast("decimal(28,10)").alias("q"))
    found = met.groupBy("subject").agg(F.count("*").alias("decided"), F.count_if("won").alias("wins"), half_up(ratio(F.sum(F.when(F.col("won"), F.col("q")).otherwise(0)), F.sum("q"))).alias("adjusted_rate"))
    return found.filter("decided >= 5")


@named(RECORDS + """
SELECT g.o_orderkey, g.starts, g.outcome, CASE WHEN g.l_tax > 0.035 THEN 12 ELSE 8 END AS scheduled, g.l_partkey % 17 AS division, g.l_discount > 0.08 AS title, g.a, g.b, x.contests AS a_contests, x.wins AS a_wins, x.losses AS a_losses, y.contests AS b_contests, y.wins AS b_wins, y.losses AS b_losses,
  x.last_result = 'win' AS a_won_last, y.last_result = 'win' AS b_won_last FROM g JOIN rec x ON x.o_orderkey = g.o_orderkey AND x.side = 'a' JOIN rec y ON y.o_orderkey = g.o_orderkey AND y.side = 'b'
""")
def matchup_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is put into a comparison of the two sides of each contest: its terms, and both records on entering."""
    g = contests(spark, sf_dir)
    known = history_as_of(spark, sf_dir)
    told = ("contests", "wins", "losses", "last_result")
    # both sides' records of a contest meet in one aggregation of one row a side
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct(*told)))
    of = lambda s: [*[F.col(f"__{s}.{c}").alias(f"{s}_{c}") for c in told[:3]], (F.col(f"__{s}.last_result") == "win").alias(f"{s}_won_last")]
    both = known.groupBy("o_orderkey").agg(side("a").alias("__a"), side("b").alias("__b"))
    terms = g.select("o_orderkey", "starts", "outcome", F.when(F.col("l_tax") > 0.035, 12).otherwise(8).alias("scheduled"), (F.col("l_partkey") % 17).alias("division"), (F.col("l_discount") > 0.08).alias("title"), "a", "b")
    return terms.join(both, "o_orderkey").select(*terms.columns, *of("a"), *of("b"))
