"""The whole registry of career and official metrics at a cutoff, on the contest graph of `pointintime`.

Stand-ins, beside that graph: contests with a number divisible by eleven are not professional; the first line's quantity tells the method, its line number the round, its tax the
scheduled rounds, its discount whether a title is at stake, its part the division. Lines of an order are its punch statistics (odd lines side a's, even ones side b's)
and the rounds on its judges' cards (a supplier is a judge, its lines in an order its card). A customer's number tells the referee.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import ratio
from tessera.operators import metrics as mt
from tessera.operators.metrics import Kind
from tessera.operators.sequences import before, islands
from tessera.operators.temporal import latest_per_key, newest_per_key
from tessera.sources.shared import dealt, written
from tessera.sources.tables import load

from .catalog import named
from .pointintime import CONTESTS, QUALITY, appearances, contests, opposition

CUTOFF = "2000-07-01"

#: How contests end.
STOPPAGES, DECISIONS = ("KO", "TKO", "RTD"), ("DECISION", "TECHNICAL_DECISION")

METHOD = "CASE WHEN q <= 15 THEN 'KO' WHEN q <= 25 THEN 'TKO' WHEN q <= 30 THEN 'RTD' WHEN q <= 40 THEN 'DECISION' WHEN q <= 44 THEN 'TECHNICAL_DECISION' WHEN q <= 47 THEN 'DQ' END"
SCHEDULED = "CASE WHEN l_tax = 0 THEN NULL WHEN l_tax > 0.035 THEN 12 ELSE 8 END"
ROUND = "CASE WHEN q > 40 OR q <= 30 THEN least(l_linenumber + o_orderkey % 5, 12) END"
#: A contest at the cutoff: what is known later is unknown.
VIEW = f"""
v1 AS (SELECT *, date_diff('day', starts, TIMESTAMP '{CUTOFF}') AS age, {SCHEDULED} AS scheduled, l_discount > 0.08 AS title, CASE WHEN l_partkey % 19 <> 0 THEN l_partkey % 17 END AS division, known <= DATE '{CUTOFF}' AND result IS NOT NULL AS seen FROM ap WHERE starts < TIMESTAMP '{CUTOFF}'),
v2 AS (SELECT *, CASE WHEN seen THEN result END AS res, CASE WHEN seen THEN {METHOD} END AS method, CASE WHEN seen THEN {ROUND} END AS round FROM v1),
v AS (SELECT *, method IN ('KO', 'TKO', 'RTD') AS stopped, res IN ('win', 'loss', 'draw') AS decided,
  CASE WHEN method = 'DECISION' AND scheduled IS NOT NULL THEN scheduled WHEN round IS NOT NULL THEN round - 1 + CASE WHEN o_orderkey % 3 <> 0 THEN least(((o_orderkey * 37) % 200) / 180.0::DOUBLE, 1) ELSE 0 END END AS completed,
  o_orderkey % 4 <> 0 AS covered, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS down, o_orderkey % 12 + 1 AS down_round, CAST(substr(opponent, 2) AS BIGINT) % 3 AS stance FROM v2)
"""
CARDS = """
cards AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_partkey % 12 + 1 AS round, 10 - CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS pa, 10 - CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END - CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS pb FROM lineitem)
"""


def with_view(rows: DataFrame) -> DataFrame:
    """Appearances or contests before the cutoff with age, scheduled, title, division, res, method, round, stopped, decided and completed rounds, as known at the cutoff."""
    k, q = F.col("o_orderkey"), F.col("q")
    cut = F.lit(CUTOFF).cast("date")
    view = rows.filter(F.col("starts") < cut.cast("timestamp_ntz")).withColumns({
        "age": F.date_diff(cut, F.col("starts").cast("date")), "scheduled": F.when(F.col("l_tax") == 0, None).when(F.col("l_tax") > 0.035, 12).otherwise(8), "title": F.col("l_discount") > 0.08,
        "division": F.when(F.col("l_partkey") % 19 != 0, F.col("l_partkey") % 17), "__seen": (F.col("known") <= cut) & F.col("result").isNotNull(),
    })
    method = F.when(q <= 15, "KO").when(q <= 25, "TKO").when(q <= 30, "RTD").when(q <= 40, "DECISION").when(q <= 44, "TECHNICAL_DECISION").when(q <= 47, "DQ")
    round_ = F.when((q > 40) | (q <= 30), F.least(F.col("l_linenumber") + k % 5, F.lit(12)))
    seen = lambda c: F.when(F.col("__seen"), c)
    view = view.withColumns({"res": seen(F.col("result")), "method": seen(method), "round": seen(round_)}).drop("__seen")
    part = F.when(k % 3 != 0, F.least(((k * 37) % 200) / 180, F.lit(1.0))).otherwise(0.0)
    return view.withColumns({
        "stopped": F.col("method").isin(*STOPPAGES), "decided": F.col("res").isin("win", "loss", "draw"),
        "completed": F.when((F.col("method") == "DECISION") & F.col("scheduled").isNotNull(), F.col("scheduled").cast("double")).when(F.col("round").isNotNull(), F.col("round") - 1 + part),
    })


def punches(lines: DataFrame) -> DataFrame:
    """Punch statistics of each order and side from approved and complete sources: rows, sums, and whether a field is missing in a row."""
    q, lack = F.col("l_quantity"), F.col("l_tax") == 0
    rows = lines.filter("l_orderkey % 5 = 0 AND l_orderkey % 3 <> 0").select(
        F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 2 == 1, "a").otherwise("b").alias("side"), q.cast("long").alias("thrown"), F.floor(q * F.col("l_discount") * 10).alias("landed"),
        F.when(~lack, F.floor(q / 2)).alias("jabs"), F.floor(q / 5).alias("jabs_landed"), F.ceil(q / 2).alias("power"), F.floor(q / 4).alias("power_landed"),
    )
    fields = ["thrown", "landed", "jabs", "jabs_landed", "power", "power_landed"]
    return rows.groupBy("o_orderkey", "side").agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in fields], F.count_if(F.col("jabs").isNull()).alias("no_jabs"))


def cards(lines: DataFrame) -> DataFrame:
    """Rounds on judges' cards: order, judge, round and the points of both sides."""
    return lines.select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", (F.col("l_partkey") % 12 + 1).alias("round"), (10 - (F.col("l_partkey") % 3 == 0).cast("int")).alias("pa"),
        (10 - (F.col("l_suppkey") % 4 == 0).cast("int") - (F.col("l_linenumber") % 5 == 0).cast("int")).alias("pb"),
    )


def career_registry() -> list[Kind]:
    """Keys and least samples of the 45 career metrics."""
    c = F.col
    rate = lambda top, bottom: ratio(c(top), c(bottom))
    out = [
        Kind("activity.pro_bouts", c("known"), c("known"), 0),
        Kind("activity.rounds_boxed", c("rounds"), c("rounds_n")),
        Kind("activity.days_since_last_bout", c("since"), c("pro")),
        Kind("activity.bouts_last_12_months", c("year1"), c("pro"), 0),
        Kind("activity.bouts_last_24_months", c("year2"), c("pro"), 0),
        Kind("activity.avg_days_between_bouts", ratio(c("span"), c("pro") - 1), c("pro"), 2),
        Kind("results.win_rate", rate("wins", "decided"), c("decided"), 5),
        Kind("results.stoppage_win_share", rate("stop_wins", "wins"), c("wins"), 5),
        Kind("results.decision_win_share", rate("dec_wins", "wins"), c("wins"), 5),
        Kind("results.distance_rate", rate("distance", "methods"), c("methods"), 5),
        Kind("results.stoppage_loss_rate", rate("stop_losses", "decided"), c("decided"), 5),
        Kind("results.outcome_summary", F.to_json(F.struct("wins", "losses", "draws", "no_contests", "no_decisions", "dq_wins", "dq_losses")), c("known"), 0, "json"),
        Kind("finishing.stoppage_win_rate", rate("stop_wins", "decided"), c("decided"), 5),
        Kind("finishing.opponent_adjusted_stoppage_win_rate", rate("q_stop_wins", "q_decided"), c("q_n"), 5),
        Kind("finishing.early_stoppage_share", rate("early", "stop_wins_r"), c("stop_wins_r"), 3),
        Kind("finishing.late_stoppage_share", rate("late", "stop_wins_long"), c("stop_wins_long"), 3),
        Kind("durability.stoppage_losses", c("stop_losses"), c("decided"), 0),
        Kind("durability.knockdowns_suffered_per_bout", rate("downs", "covered"), c("covered"), 5, covered=c("covered")),
        Kind("durability.rounds_completed_ratio", rate("ratio_rounds", "ratio_scheduled"), c("ratio_n"), 5),
        Kind("durability.reached_round_9_rate", rate("reached", "long_n"), c("long_n"), 3),
        Kind("durability.opponent_adjusted_stoppage_loss_rate", rate("q_stop_losses", "q_decided"), c("q_n"), 5),
    ]
    punch = {
        "thrown_per_round": rate("my_thrown", "my_rows"), "landed_per_round": rate("my_landed", "my_rows"), "total_accuracy": rate("my_landed", "my_thrown"), "jab_attempt_share": rate("my_jabs", "my_thrown"),
        "jab_accuracy": rate("my_jabs_landed", "my_jabs"), "power_accuracy": rate("my_power_landed", "my_power"),
    }
    out += [Kind(f"output.{k}", v, c("my_rows"), 10, covered=c("punched"), gap=c("my_no_jabs") > 0 if "jab" in k else None) for k, v in punch.items()]
    # as many rounds of one's own as the others need, but the opponent's rounds are the sample
    out += [Kind("output.opponent_landed_per_round", F.when(c("my_rows") >= 10, rate("op_landed", "op_rows")), F.when(c("my_rows") < 10, c("my_rows")).otherwise(F.greatest("op_rows", F.lit(10))), 10, covered=c("punched"), gap=c("op_rows") == 0)]
    out += [
        Kind("late.bouts_scheduled_beyond_8", c("beyond8"), c("pro"), 0),
        Kind("late.rounds_boxed_9_plus", c("late_rounds"), c("late_n")),
        Kind("late.stoppage_wins_after_round_8", c("late_stop_wins"), c("decided"), 0),
        Kind("late.knockdowns_after_round_8", F.to_json(F.struct("scored", "suffered")), c("covered_long"), 1, "json", covered=c("covered_long")),
        Kind("late.round_scoring_share_9_plus", rate("rounds_won", "rounds_scored"), c("rounds_scored"), 6),
        Kind("opposition.avg_opponent_win_pct_entering", rate("op_win", "op_n"), c("op_n"), 5),
        Kind("opposition.avg_opponent_prior_bouts", rate("op_bouts", "op_n"), c("op_n"), 5),
        Kind("opposition.opponent_quality_index", rate("op_quality", "op_n"), c("op_n"), 5),
        Kind("opposition.title_fights", c("titles"), c("pro"), 0),
        Kind("opposition.championship_rounds_boxed", c("title_rounds"), c("title_n"), 0),
        Kind("division.current", F.concat(F.lit("d"), c("division")), c("with_division"), 1, "text"),
        Kind("division.recent", c("recent"), c("with_division"), 1, "json"),
        Kind("division.bouts_at_current", c("streak"), c("with_division")),
        Kind("division.days_since_change", F.when(c("was").isNotNull(), c("streak_age")), c("with_division"), 2),
        Kind("division.last_move", F.when(c("was").isNotNull(), F.when(c("division") > c("was"), "up").otherwise("down")), c("with_division"), 2, "text"),
        Kind("stance.win_rate_vs_orthodox", rate("wins_0", "stance_0"), c("stance_0"), 5),
        Kind("stance.win_rate_vs_southpaw", rate("wins_1", "stance_1"), c("stance_1"), 5),
    ]
    return out


def division_facts(pro: DataFrame) -> DataFrame:
    """Of each subject with a division: the current one, how long it has lasted and since when, the one before, and the last five contests' divisions."""
    held = pro.filter("division IS NOT NULL").select("subject", "starts", "o_orderkey", "division", "age")
    month = F.trunc("starts", "month")
    runs = islands(held, ["subject"], ["starts", "o_orderkey"], "division", month).groupBy("subject", "island").agg(F.first("division").alias("division"), F.max("age").alias("streak_age"), F.count("*").alias("streak"), F.min("starts").alias("begun"))
    ordered = before(runs, ["subject"], ["island"], {"division": "was"}, F.trunc("begun", "year")).drop("first", "begun")
    last = latest_per_key(ordered, ["subject"], ["island"]).drop("island")
    newest = newest_per_key(held, ["subject"], ["starts", "o_orderkey"], 5, month)
    recent = newest.groupBy("subject").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rn", "division"))), lambda x: F.concat(F.lit("d"), x.division))).alias("recent"))
    return last.join(recent, "subject")


@named(QUALITY.replace("told AS", f"{VIEW}, told AS", 1).rstrip() + f""",{CARDS},
pro AS (SELECT v.*, qu.n AS q_bouts, qu.win_share, qu.quality FROM v JOIN quality qu ON qu.o_orderkey = v.o_orderkey AND qu.side = v.side WHERE v.o_orderkey % 11 <> 0),
pl AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS side, count(*) AS rows, sum(CAST(l_quantity AS BIGINT)) AS thrown, sum(floor(l_quantity * l_discount * 10)) AS landed, sum(CASE WHEN l_tax <> 0 THEN floor(l_quantity / 2) END) AS jabs, sum(floor(l_quantity / 5)) AS jl,
  sum(ceil(l_quantity / 2)) AS power, sum(floor(l_quantity / 4)) AS wl, count(*) FILTER (l_tax = 0) AS lack FROM lineitem WHERE l_orderkey % 5 = 0 AND l_orderkey % 3 <> 0 GROUP BY ALL),
rm AS (SELECT l_orderkey, round, avg(pa - pb) AS m FROM cards WHERE round >= 9 GROUP BY ALL), rs AS (SELECT l_orderkey, count(*) AS scored, count(*) FILTER (m > 0) AS for_a, count(*) FILTER (m < 0) AS for_b FROM rm GROUP BY 1),
wide AS (SELECT subject, count(*) AS pro, count(res) AS known, CAST(sum(CAST(completed AS DECIMAL(28,10))) AS DOUBLE) AS rounds, count(completed) AS rounds_n, min(age) AS since, count(*) FILTER (age <= 365) AS year1, count(*) FILTER (age <= 730) AS year2, max(age) - min(age) AS span,
  count(*) FILTER (decided) AS decided, count(*) FILTER (res = 'win') AS wins, count(*) FILTER (res = 'loss') AS losses, count(*) FILTER (res = 'draw') AS draws, count(*) FILTER (res = 'no_contest') AS no_contests, count(*) FILTER (res = 'win' AND method = 'DQ') AS dq_wins, count(*) FILTER (res = 'loss' AND method = 'DQ') AS dq_losses,
  count(*) FILTER (res = 'win' AND stopped) AS stop_wins, count(*) FILTER (res = 'loss' AND stopped) AS stop_losses, count(*) FILTER (res = 'win' AND method IN ('DECISION', 'TECHNICAL_DECISION')) AS dec_wins, count(*) FILTER (method = 'DECISION') AS distance, count(method) AS methods,
  CAST(sum(CAST(CASE WHEN res = 'win' AND stopped THEN quality ELSE 0 END AS DECIMAL(28,10))) FILTER (decided) AS DOUBLE) AS q_stop_wins, CAST(sum(CAST(CASE WHEN res = 'loss' AND stopped THEN quality ELSE 0 END AS DECIMAL(28,10))) FILTER (decided) AS DOUBLE) AS q_stop_losses, CAST(sum(CAST(quality AS DECIMAL(28,10))) FILTER (decided) AS DOUBLE) AS q_decided, count(quality) FILTER (decided) AS q_n,
  count(round) FILTER (res = 'win' AND stopped) AS stop_wins_r, count(*) FILTER (res = 'win' AND stopped AND round <= 3) AS early, count(round) FILTER (res = 'win' AND stopped AND scheduled > 8) AS stop_wins_long, count(*) FILTER (res = 'win' AND stopped AND scheduled > 8 AND round >= 9) AS late,
  count(*) FILTER (covered) AS covered, count(*) FILTER (covered AND down = pro.side) AS downs, CAST(sum(CAST(completed AS DECIMAL(28,10))) FILTER (scheduled IS NOT NULL) AS DOUBLE) AS ratio_rounds, sum(scheduled) FILTER (completed IS NOT NULL) AS ratio_scheduled, count(completed) FILTER (scheduled IS NOT NULL) AS ratio_n,
  count(*) FILTER (scheduled > 8 AND (method = 'DECISION' OR (method IS NOT NULL AND round IS NOT NULL))) AS long_n, count(*) FILTER (scheduled > 8 AND (method = 'DECISION' OR (method IS NOT NULL AND round >= 9))) AS reached,
  count(pl.rows) + count(po.rows) AS punched, coalesce(sum(pl.rows), 0) AS my_rows, sum(pl.thrown) AS my_thrown, sum(pl.landed) AS my_landed, sum(pl.jabs) AS my_jabs, sum(pl.jl) AS my_jl, sum(pl.power) AS my_power, sum(pl.wl) AS my_wl, coalesce(sum(pl.lack), 0) AS my_lack, sum(po.landed) AS op_landed, coalesce(sum(po.rows), 0) AS op_rows,
  count(*) FILTER (scheduled > 8) AS beyond8, CAST(sum(CAST(greatest(completed - 8, 0) AS DECIMAL(28,10))) FILTER (scheduled > 8) AS DOUBLE) AS late_rounds, count(completed) FILTER (scheduled > 8) AS late_n, count(*) FILTER (res = 'win' AND stopped AND round >= 9) AS late_stop_wins,
  count(*) FILTER (covered AND scheduled > 8) AS covered_long, count(*) FILTER (covered AND scheduled > 8 AND down_round >= 9 AND down IS NOT NULL AND down <> pro.side) AS scored, count(*) FILTER (covered AND scheduled > 8 AND down_round >= 9 AND down = pro.side) AS suffered,
  coalesce(sum(rs.scored), 0) AS rounds_scored, coalesce(sum(CASE WHEN pro.side = 'a' THEN rs.for_a ELSE rs.for_b END), 0) AS rounds_won, CAST(sum(CAST(win_share AS DECIMAL(28,10))) AS DOUBLE) AS op_win, sum(q_bouts) AS op_bouts, CAST(sum(CAST(quality AS DECIMAL(28,10))) AS DOUBLE) AS op_quality, count(quality) AS op_n,
  count(*) FILTER (title) AS titles, coalesce(CAST(sum(CAST(greatest(completed - 9, 0) AS DECIMAL(28,10))) FILTER (title) AS DOUBLE), 0) AS title_rounds, count(completed) FILTER (title) AS title_n, count(division) AS with_division,
  count(*) FILTER (decided AND stance = 0) AS stance_0, count(*) FILTER (res = 'win' AND stance = 0) AS wins_0, count(*) FILTER (decided AND stance = 1) AS stance_1, count(*) FILTER (res = 'win' AND stance = 1) AS wins_1
  FROM pro LEFT JOIN pl ON pl.l_orderkey = pro.o_orderkey AND pl.side = pro.side LEFT JOIN pl po ON po.l_orderkey = pro.o_orderkey AND po.side <> pro.side LEFT JOIN rs ON rs.l_orderkey = pro.o_orderkey GROUP BY subject),
dn AS (SELECT subject, starts, o_orderkey, division, age, lag(division) OVER w AS p, row_number() OVER (PARTITION BY subject ORDER BY starts DESC, o_orderkey DESC) AS rn FROM pro WHERE division IS NOT NULL WINDOW w AS (PARTITION BY subject ORDER BY starts, o_orderkey)),
di AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM division THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY starts, o_orderkey) AS island FROM dn),
dl AS (SELECT subject, max(island) AS last FROM di GROUP BY 1), dc AS (SELECT di.subject, any_value(division) AS division, count(*) AS streak, max(age) AS streak_age FROM di JOIN dl ON di.subject = dl.subject AND island = last GROUP BY 1),
dp AS (SELECT di.subject, any_value(division) AS was FROM di JOIN dl ON di.subject = dl.subject AND island = last - 1 GROUP BY 1), dr AS (SELECT subject, '["' || string_agg('d' || division, '","' ORDER BY rn) || '"]' AS recent FROM dn WHERE rn <= 5 GROUP BY 1),
w AS (SELECT wide.*, dc.division, streak, streak_age, was, recent FROM wide LEFT JOIN dc USING (subject) LEFT JOIN dp USING (subject) LEFT JOIN dr USING (subject)),
m AS (SELECT subject, unnest([{", ".join("{'k': '" + k + "', 'n': CAST(" + (n or "NULL") + " AS DOUBLE), 't': CAST(" + (t or "NULL") + " AS VARCHAR), 'j': CAST(" + (j or "NULL") + " AS VARCHAR), 's': CAST(" + s + " AS BIGINT), 'l': " + str(l) + ", 'u': " + u + ", 'g': " + g + "}" for k, n, t, j, s, l, u, g in [
    ("activity.pro_bouts", "known", "", "", "known", 0, "FALSE", "FALSE"), ("activity.rounds_boxed", "rounds", "", "", "rounds_n", 1, "FALSE", "FALSE"), ("activity.days_since_last_bout", "since", "", "", "pro", 1, "FALSE", "FALSE"),
    ("activity.bouts_last_12_months", "year1", "", "", "pro", 0, "FALSE", "FALSE"), ("activity.bouts_last_24_months", "year2", "", "", "pro", 0, "FALSE", "FALSE"), ("activity.avg_days_between_bouts", "span::DOUBLE / nullif(pro - 1, 0)", "", "", "pro", 2, "FALSE", "FALSE"),
    ("results.win_rate", "wins::DOUBLE / nullif(decided, 0)", "", "", "decided", 5, "FALSE", "FALSE"), ("results.stoppage_win_share", "stop_wins::DOUBLE / nullif(wins, 0)", "", "", "wins", 5, "FALSE", "FALSE"), ("results.decision_win_share", "dec_wins::DOUBLE / nullif(wins, 0)", "", "", "wins", 5, "FALSE", "FALSE"),
    ("results.distance_rate", "distance::DOUBLE / nullif(methods, 0)", "", "", "methods", 5, "FALSE", "FALSE"), ("results.stoppage_loss_rate", "stop_losses::DOUBLE / nullif(decided, 0)", "", "", "decided", 5, "FALSE", "FALSE"),
    ("results.outcome_summary", "", "", "concat('{\"wins\":', wins, ',\"losses\":', losses, ',\"draws\":', draws, ',\"no_contests\":', no_contests, ',\"no_decisions\":0,\"dq_wins\":', dq_wins, ',\"dq_losses\":', dq_losses, '}')", "known", 0, "FALSE", "FALSE"),
    ("finishing.stoppage_win_rate", "stop_wins::DOUBLE / nullif(decided, 0)", "", "", "decided", 5, "FALSE", "FALSE"), ("finishing.opponent_adjusted_stoppage_win_rate", "q_stop_wins / nullif(q_decided, 0)", "", "", "q_n", 5, "FALSE", "FALSE"),
    ("finishing.early_stoppage_share", "early::DOUBLE / nullif(stop_wins_r, 0)", "", "", "stop_wins_r", 3, "FALSE", "FALSE"), ("finishing.late_stoppage_share", "late::DOUBLE / nullif(stop_wins_long, 0)", "", "", "stop_wins_long", 3, "FALSE", "FALSE"),
    ("durability.stoppage_losses", "stop_losses", "", "", "decided", 0, "FALSE", "FALSE"), ("durability.knockdowns_suffered_per_bout", "downs::DOUBLE / nullif(covered, 0)", "", "", "covered", 5, "covered = 0", "FALSE"),
    ("durability.rounds_completed_ratio", "ratio_rounds / nullif(ratio_scheduled, 0)", "", "", "ratio_n", 5, "FALSE", "FALSE"), ("durability.reached_round_9_rate", "reached::DOUBLE / nullif(long_n, 0)", "", "", "long_n", 3, "FALSE", "FALSE"),
    ("durability.opponent_adjusted_stoppage_loss_rate", "q_stop_losses / nullif(q_decided, 0)", "", "", "q_n", 5, "FALSE", "FALSE"),
    ("output.thrown_per_round", "my_thrown::DOUBLE / nullif(my_rows, 0)", "", "", "my_rows", 10, "punched = 0", "FALSE"), ("output.landed_per_round", "my_landed::DOUBLE / nullif(my_rows, 0)", "", "", "my_rows", 10, "punched = 0", "FALSE"),
    ("output.total_accuracy", "my_landed::DOUBLE / nullif(my_thrown, 0)", "", "", "my_rows", 10, "punched = 0", "FALSE"), ("output.jab_attempt_share", "my_jabs::DOUBLE / nullif(my_thrown, 0)", "", "", "my_rows", 10, "punched = 0", "my_lack > 0"),
    ("output.jab_accuracy", "my_jl::DOUBLE / nullif(my_jabs, 0)", "", "", "my_rows", 10, "punched = 0", "my_lack > 0"), ("output.power_accuracy", "my_wl::DOUBLE / nullif(my_power, 0)", "", "", "my_rows", 10, "punched = 0", "FALSE"),
    ("output.opponent_landed_per_round", "op_landed::DOUBLE / nullif(op_rows, 0)", "", "", "CASE WHEN my_rows < 10 THEN my_rows ELSE greatest(op_rows, 10) END", 10, "punched = 0", "op_rows = 0"),
    ("late.bouts_scheduled_beyond_8", "beyond8", "", "", "pro", 0, "FALSE", "FALSE"), ("late.rounds_boxed_9_plus", "late_rounds", "", "", "late_n", 1, "FALSE", "FALSE"), ("late.stoppage_wins_after_round_8", "late_stop_wins", "", "", "decided", 0, "FALSE", "FALSE"),
    ("late.knockdowns_after_round_8", "", "", "concat('{\"scored\":', scored, ',\"suffered\":', suffered, '}')", "covered_long", 1, "covered_long = 0", "FALSE"), ("late.round_scoring_share_9_plus", "rounds_won::DOUBLE / nullif(rounds_scored, 0)", "", "", "rounds_scored", 6, "FALSE", "FALSE"),
    ("opposition.avg_opponent_win_pct_entering", "op_win / nullif(op_n, 0)", "", "", "op_n", 5, "FALSE", "FALSE"), ("opposition.avg_opponent_prior_bouts", "op_bouts::DOUBLE / nullif(op_n, 0)", "", "", "op_n", 5, "FALSE", "FALSE"), ("opposition.opponent_quality_index", "op_quality / nullif(op_n, 0)", "", "", "op_n", 5, "FALSE", "FALSE"),
    ("opposition.title_fights", "titles", "", "", "pro", 0, "FALSE", "FALSE"), ("opposition.championship_rounds_boxed", "title_rounds", "", "", "title_n", 0, "FALSE", "FALSE"),
    ("division.current", "", "'d' || division", "", "with_division", 1, "FALSE", "FALSE"), ("division.recent", "", "", "recent", "with_division", 1, "FALSE", "FALSE"), ("division.bouts_at_current", "streak", "", "", "with_division", 1, "FALSE", "FALSE"),
    ("division.days_since_change", "CASE WHEN was IS NOT NULL THEN streak_age END", "", "", "with_division", 2, "FALSE", "FALSE"), ("division.last_move", "", "CASE WHEN was IS NOT NULL THEN CASE WHEN division > was THEN 'up' ELSE 'down' END END", "", "with_division", 2, "FALSE", "FALSE"),
    ("stance.win_rate_vs_orthodox", "wins_0::DOUBLE / nullif(stance_0, 0)", "", "", "stance_0", 5, "FALSE", "FALSE"), ("stance.win_rate_vs_southpaw", "wins_1::DOUBLE / nullif(stance_1, 0)", "", "", "stance_1", 5, "FALSE", "FALSE"),
])}]) AS x FROM w),
s AS (SELECT subject, x, CASE WHEN x.u THEN 'source_unavailable' WHEN x.s < x.l THEN 'insufficient_sample' WHEN x.g THEN 'source_unavailable' WHEN x.n IS NULL AND x.t IS NULL AND x.j IS NULL THEN 'not_applicable' ELSE 'available' END AS status FROM m)
SELECT subject, x.k AS metric, status, CASE WHEN status = 'available' THEN floor(x.n * 10000 + 0.5) / 10000 END AS value_number, CASE WHEN status = 'available' THEN x.t END AS value_text, CASE WHEN status = 'available' THEN x.j END AS value_json, CASE WHEN status = 'source_unavailable' THEN 0 ELSE x.s END AS sample FROM s
""")
def career_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All career metrics of every subject at the cutoff: numbers, categories and documents, each with its status and sample."""
    # contests are asked for six times, and each step's rows are few beside what it is shuffled through
    rows = appearances(written(contests(spark, sf_dir)))
    lines = load(spark, sf_dir, "lineitem")
    quality = written(opposition(rows).select("o_orderkey", "side", F.col("n").alias("q_bouts"), "win_share", "quality"))
    seen = with_view(rows).filter("o_orderkey % 11 <> 0")
    pro = seen.join(quality, ["o_orderkey", "side"])
    own = punches(lines)
    mine = own.select("o_orderkey", "side", *[F.col(c).alias(f"my_{c}") for c in ("rows", "thrown", "landed", "jabs", "jabs_landed", "power", "power_landed", "no_jabs")])
    theirs = own.select("o_orderkey", F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), F.col("rows").alias("op_rows"), F.col("landed").alias("op_landed"))
    margins = cards(lines).filter("round >= 9").groupBy("l_orderkey", "round").agg(F.avg(F.col("pa") - F.col("pb")).alias("m"))
    scored = margins.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("scored_rounds"), F.count_if(F.col("m") > 0).alias("for_a"), F.count_if(F.col("m") < 0).alias("for_b"))
    scored = scored.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b"))))  # one shuffle of the appearances serves all joins
    met = pro.join(mine, ["o_orderkey", "side"], "left").join(theirs, ["o_orderkey", "side"], "left").join(scored, ["o_orderkey", "side"], "left")
    c, n = F.col, F.count_if
    win, loss, stop, long_ = c("res") == "win", c("res") == "loss", F.coalesce(c("stopped"), F.lit(False)), F.coalesce(c("scheduled") > 8, F.lit(False))
    decided, k = F.coalesce(c("decided"), F.lit(False)), c("o_orderkey")
    covered, late_down = k % 4 != 0, k % 12 + 1 >= 9
    down = F.when(k % 3 == 0, "a").when(k % 3 == 1, "b")
    exact = lambda x: x.cast("decimal(28,10)")  # noqa: E731  sums of doubles hang on their order
    total = lambda x, where=None: F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0))
    stance = F.substring("opponent", 2, 20).cast("long") % 3
    wide = met.groupBy("subject").agg(
        F.count("*").alias("pro"), F.count("res").alias("known"), F.sum(exact(c("completed"))).alias("rounds"), F.count("completed").alias("rounds_n"), F.min("age").alias("since"), n(c("age") <= 365).alias("year1"), n(c("age") <= 730).alias("year2"), (F.max("age") - F.min("age")).alias("span"),
        n(decided).alias("decided"), n(win).alias("wins"), n(loss).alias("losses"), n(c("res") == "draw").alias("draws"), n(c("res") == "no_contest").alias("no_contests"), n(c("res") == "no_decision").alias("no_decisions"),
        n(win & (c("method") == "DQ")).alias("dq_wins"), n(loss & (c("method") == "DQ")).alias("dq_losses"), n(win & stop).alias("stop_wins"), n(loss & stop).alias("stop_losses"), n(win & c("method").isin(*DECISIONS)).alias("dec_wins"),
        n(c("method") == "DECISION").alias("distance"), F.count("method").alias("methods"), total(exact(c("quality")), decided & win & stop).alias("q_stop_wins"), total(exact(c("quality")), decided & loss & stop).alias("q_stop_losses"), total(exact(c("quality")), decided).alias("q_decided"),
        F.count(F.when(decided, c("quality"))).alias("q_n"), n(win & stop & c("round").isNotNull()).alias("stop_wins_r"), n(win & stop & (c("round") <= 3)).alias("early"), n(win & stop & long_ & c("round").isNotNull()).alias("stop_wins_long"), n(win & stop & long_ & (c("round") >= 9)).alias("late"),
        n(covered).alias("covered"), n(covered & (down == c("side"))).alias("downs"), F.sum(F.when(c("scheduled").isNotNull(), exact(c("completed")))).alias("ratio_rounds"), F.sum(F.when(c("completed").isNotNull(), c("scheduled"))).alias("ratio_scheduled"),
        F.count(F.when(c("scheduled").isNotNull(), c("completed"))).alias("ratio_n"), n(long_ & ((c("method") == "DECISION") | (c("method").isNotNull() & c("round").isNotNull()))).alias("long_n"),
        n(long_ & ((c("method") == "DECISION") | (c("method").isNotNull() & (c("round") >= 9)))).alias("reached"), (F.count("my_rows") + F.count("op_rows")).alias("punched"), total(c("my_rows")).alias("my_rows"),
        *[F.sum(f"my_{x}").alias(f"my_{x}") for x in ("thrown", "landed", "jabs", "jabs_landed", "power", "power_landed")], total(c("my_no_jabs")).alias("my_no_jabs"), F.sum("op_landed").alias("op_landed"), total(c("op_rows")).alias("op_rows"),
        n(long_).alias("beyond8"), F.sum(F.when(long_, exact(F.greatest(c("completed") - 8, F.when(c("completed").isNotNull(), 0.0))))).alias("late_rounds"), F.count(F.when(long_, c("completed"))).alias("late_n"), n(win & stop & (c("round") >= 9)).alias("late_stop_wins"),
        n(covered & long_).alias("covered_long"), n(covered & long_ & late_down & (down != c("side"))).alias("scored"), n(covered & long_ & late_down & (down == c("side"))).alias("suffered"),
        total(c("scored_rounds")).alias("rounds_scored"), total(F.when(c("side") == "a", c("for_a")).otherwise(c("for_b"))).alias("rounds_won"), F.sum(exact(c("win_share"))).alias("op_win"), F.sum("q_bouts").alias("op_bouts"), F.sum(exact(c("quality"))).alias("op_quality"), F.count("quality").alias("op_n"),
        n(c("title")).alias("titles"), total(exact(F.greatest(c("completed") - 9, F.when(c("completed").isNotNull(), 0.0))), c("title")).alias("title_rounds"), F.count(F.when(c("title"), c("completed"))).alias("title_n"), F.count("division").alias("with_division"),
        *[x for s in (0, 1) for x in (n(decided & (stance == s)).alias(f"stance_{s}"), n(win & (stance == s)).alias(f"wins_{s}"))],
    )
    # the joins' files are gone before those of the divisions come
    return mt.told_kinds(written(wide).join(division_facts(seen), "subject", "left"), ["subject"], career_registry())


def official_registry() -> list[Kind]:
    """Keys and least samples of the 19 metrics of judges and referees."""
    c = F.col
    rate = lambda top, bottom: ratio(c(top), c(bottom))
    return [
        Kind("judge.bouts_scored", c("judged"), c("judged"), 0),
        Kind("judge.rounds_scored", c("rounds"), c("judged"), 0),
        Kind("judge.avg_card_margin", rate("margin", "judged"), c("judged"), 10),
        Kind("judge.panel_disagreement_rate", rate("different", "comparable"), c("comparable"), 10),
        Kind("judge.split_decision_involvement", rate("split", "decisions"), c("decisions"), 10),
        Kind("judge.majority_decision_involvement", rate("majority", "decisions"), c("decisions"), 10),
        Kind("judge.round_10_10_rate", rate("even", "rounds"), c("rounds"), 60),
        Kind("judge.round_10_8_rate", rate("wide", "rounds"), c("rounds"), 60),
        Kind("judge.round_consensus_distance", rate("distance", "compared"), c("compared"), 60),
        Kind("judge.title_fight_assignments", c("judged_titles"), c("judged"), 0),
        Kind("judge.jurisdictions", c("jurisdictions"), c("judged"), 0, "json"),
        Kind("referee.bouts_refereed", c("refereed_known"), c("refereed_known"), 0),
        Kind("referee.stoppage_rate", rate("stops", "refereed_known"), c("refereed_known"), 10),
        Kind("referee.avg_stoppage_round", rate("stop_rounds", "stops_r"), c("stops_r"), 5),
        Kind("referee.ko_tko_stoppages", c("stops"), c("refereed_known"), 0),
        Kind("referee.disqualifications", c("dqs"), c("refereed_known"), 0),
        Kind("referee.point_deductions_per_bout", rate("deductions", "refereed"), c("refereed"), 10),
        Kind("referee.title_fights", c("refereed_titles"), c("refereed"), 0),
        Kind("referee.avg_completed_rounds", rate("completed", "completed_n"), c("completed_n"), 10),
    ]


def judged_rounds(lines: DataFrame) -> DataFrame:
    """One entry a judge, order and round, of cards known at the cutoff, the first in order where a card has two."""
    known = cards(lines.filter(F.col("l_shipdate") <= F.lit(CUTOFF).cast("timestamp_ntz")))
    return known.groupBy("l_orderkey", "l_suppkey", "round").agg(F.min(F.struct("l_linenumber", "l_partkey", "pa", "pb")).alias("x")).select("l_orderkey", "l_suppkey", "round", "x.pa", "x.pb")


@named(CONTESTS + f"""
, bouts AS (SELECT v.*, CASE WHEN method IN ('DECISION', 'TECHNICAL_DECISION') THEN CASE o_orderkey % 3 WHEN 0 THEN 'split' WHEN 1 THEN 'majority' ELSE 'unanimous' END END AS decision, 'n' || o_orderkey % 25 AS commission FROM (SELECT * FROM v0 WHERE side = 'a') v),
{CARDS},
rounds AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.l_orderkey, c.l_suppkey, c.round ORDER BY c.l_linenumber, c.l_partkey) AS rn FROM cards c JOIN lineitem l ON l.l_orderkey = c.l_orderkey AND l.l_suppkey = c.l_suppkey AND l.l_partkey = c.l_partkey AND l.l_linenumber = c.l_linenumber WHERE l_shipdate <= TIMESTAMP '{CUTOFF}') WHERE rn = 1),
seen AS (SELECT r.* FROM rounds r JOIN bouts ON l_orderkey = o_orderkey),
con AS (SELECT *, count(*) OVER p - 1 AS others, CAST(sum(pa - pb) OVER p - (pa - pb) AS DOUBLE) / nullif(count(*) OVER p - 1, 0) AS om FROM seen WINDOW p AS (PARTITION BY l_orderkey, round)),
card AS (SELECT l_orderkey, l_suppkey, count(*) AS rounds, sum(pa) - sum(pb) AS gap, sign(sum(pa) - sum(pb)) AS vote, count(*) FILTER (pa = pb) AS even, count(*) FILTER (abs(pa - pb) >= 2) AS wide, sum(CAST(abs(pa - pb - om) AS DECIMAL(28,10))) FILTER (others >= 2) AS distance, count(*) FILTER (others >= 2) AS compared FROM con GROUP BY ALL),
votes AS (SELECT l_orderkey, vote, count(*) AS n FROM card GROUP BY ALL), panel AS (SELECT l_orderkey, count(*) - 1 AS others FROM card GROUP BY 1),
rest AS (SELECT c.l_orderkey, c.l_suppkey, p.others, max(y.n - CASE WHEN y.vote = c.vote THEN 1 ELSE 0 END) AS top, arg_max(y.vote, y.n - CASE WHEN y.vote = c.vote THEN 1 ELSE 0 END) AS g FROM card c JOIN votes y USING (l_orderkey) JOIN panel p USING (l_orderkey) GROUP BY ALL),
jd AS (SELECT c.*, r.others >= 2 AND r.top * 2 > r.others AS comparable, g <> c.vote AS differs, decision, title, commission FROM card c JOIN rest r ON r.l_orderkey = c.l_orderkey AND r.l_suppkey = c.l_suppkey JOIN bouts ON c.l_orderkey = o_orderkey),
jw AS (SELECT 'judge' || l_suppkey AS official, count(*) AS judged, sum(rounds) AS rounds, sum(abs(gap)) AS margin, count(*) FILTER (comparable) AS comparable, count(*) FILTER (comparable AND differs) AS different, count(decision) AS decisions, count(*) FILTER (decision = 'split') AS split, count(*) FILTER (decision = 'majority') AS majority,
  sum(even) AS even, sum(wide) AS wide, CAST(sum(distance) AS DOUBLE) AS distance, sum(compared) AS compared, count(*) FILTER (title) AS judged_titles FROM jd GROUP BY 1),
jj AS (SELECT official, '{{' || string_agg('"' || commission || '":' || n, ',' ORDER BY commission) || '}}' AS jurisdictions FROM (SELECT 'judge' || l_suppkey AS official, commission, count(*) AS n FROM jd GROUP BY ALL) GROUP BY 1),
rw AS (SELECT 'referee' || CAST(substr(subject, 2) AS BIGINT) % 25 AS official, count(*) AS refereed, count(res) AS refereed_known, count(*) FILTER (stopped) AS stops, sum(round) FILTER (stopped) AS stop_rounds, count(round) FILTER (stopped) AS stops_r, count(*) FILTER (method = 'DQ') AS dqs,
  sum(o_orderkey % 3) AS deductions, count(*) FILTER (title) AS refereed_titles, CAST(sum(CAST(completed AS DECIMAL(28,10))) AS DOUBLE) AS completed, count(completed) AS completed_n FROM bouts GROUP BY 1),
m AS (SELECT official, unnest([{", ".join("{'k': '" + k + "', 'n': CAST(" + (n or "NULL") + " AS DOUBLE), 'j': CAST(" + (j or "NULL") + " AS VARCHAR), 's': CAST(" + s_ + " AS BIGINT), 'l': " + str(l_) + "}" for k, n, j, s_, l_ in [
    ("judge.bouts_scored", "judged", "", "judged", 0), ("judge.rounds_scored", "rounds", "", "judged", 0), ("judge.avg_card_margin", "margin::DOUBLE / judged", "", "judged", 10), ("judge.panel_disagreement_rate", "different::DOUBLE / nullif(comparable, 0)", "", "comparable", 10),
    ("judge.split_decision_involvement", "split::DOUBLE / nullif(decisions, 0)", "", "decisions", 10), ("judge.majority_decision_involvement", "majority::DOUBLE / nullif(decisions, 0)", "", "decisions", 10), ("judge.round_10_10_rate", "even::DOUBLE / rounds", "", "rounds", 60),
    ("judge.round_10_8_rate", "wide::DOUBLE / rounds", "", "rounds", 60), ("judge.round_consensus_distance", "distance / nullif(compared, 0)", "", "compared", 60), ("judge.title_fight_assignments", "judged_titles", "", "judged", 0), ("judge.jurisdictions", "", "jurisdictions", "judged", 0),
])}]) AS x FROM jw JOIN jj USING (official)
UNION ALL SELECT official, unnest([{", ".join("{'k': '" + k + "', 'n': CAST(" + n + " AS DOUBLE), 'j': CAST(NULL AS VARCHAR), 's': CAST(" + s_ + " AS BIGINT), 'l': " + str(l_) + "}" for k, n, s_, l_ in [
    ("referee.bouts_refereed", "refereed_known", "refereed_known", 0), ("referee.stoppage_rate", "stops::DOUBLE / nullif(refereed_known, 0)", "refereed_known", 10), ("referee.avg_stoppage_round", "stop_rounds::DOUBLE / nullif(stops_r, 0)", "stops_r", 5),
    ("referee.ko_tko_stoppages", "stops", "refereed_known", 0), ("referee.disqualifications", "dqs", "refereed_known", 0), ("referee.point_deductions_per_bout", "deductions::DOUBLE / refereed", "refereed", 10), ("referee.title_fights", "refereed_titles", "refereed", 0), ("referee.avg_completed_rounds", "completed / nullif(completed_n, 0)", "completed_n", 10),
])}]) FROM rw),
s AS (SELECT official, x, CASE WHEN x.s < x.l THEN 'insufficient_sample' WHEN x.n IS NULL AND x.j IS NULL THEN 'not_applicable' ELSE 'available' END AS status FROM m)
SELECT official, x.k AS metric, status, CASE WHEN status = 'available' THEN floor(x.n * 10000 + 0.5) / 10000 END AS value_number, CAST(NULL AS VARCHAR) AS value_text, CASE WHEN status = 'available' THEN x.j END AS value_json, x.s AS sample FROM s
""".replace("(SELECT * FROM v0 WHERE side = 'a') v)", "v WHERE side = 'a')").replace(", bouts AS", f",{VIEW}, bouts AS", 1))
def official_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of judges (a supplier's lines in an order are its card) and referees (by the customer's number) at the cutoff."""
    c, n, lines = F.col, F.count_if, load(spark, sf_dir, "lineitem")
    k = c("o_orderkey")
    bouts = with_view(appearances(contests(spark, sf_dir)).filter("side = 'a'"))
    decision = F.when(c("method").isin(*DECISIONS), F.when(k % 3 == 0, "split").when(k % 3 == 1, "majority").otherwise("unanimous"))
    bouts = bouts.withColumns({"decision": decision, "commission": F.concat(F.lit("n"), k % 25)})
    # all that is asked of a panel's cards is done where its lines are dealt to
    lines = dealt(lines.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate"), "l_orderkey", rows=lines.count())
    seen = judged_rounds(lines).join(bouts.select(k.alias("l_orderkey")), "l_orderkey")
    margins = mt.leave_one_out(seen.withColumn("margin", c("pa") - c("pb")), ["l_orderkey", "round"], "margin")
    size = F.count("margin").over(Window.partitionBy("l_orderkey", "round"))
    margins = margins.withColumn("off", F.when(size >= 3, F.abs(c("margin") - c("others_mean")).cast("decimal(28,10)")))
    card = margins.groupBy("l_orderkey", "l_suppkey").agg(
        F.count("*").alias("rounds"), F.sum("margin").alias("gap"), F.signum(F.sum("margin")).alias("vote"), n(c("margin") == 0).alias("even"), n(F.abs("margin") >= 2).alias("wide"), F.sum("off").alias("distance"), F.count("off").alias("compared"),
    )
    # members of a panel with one vote are compared alike
    against = mt.against_others(card, ["l_orderkey"], "vote").select("l_orderkey", "vote", (c("comparable") > 0).alias("comparable"), (c("different") > 0).alias("different"))
    terms = bouts.select(k.alias("l_orderkey"), "decision", "title", "commission")
    judged = card.join(against, ["l_orderkey", "vote"]).join(terms, "l_orderkey").withColumn("official", F.concat(F.lit("judge"), "l_suppkey"))
    wide = judged.groupBy("official").agg(
        F.count("*").alias("judged"), F.sum("rounds").alias("rounds"), F.sum(F.abs("gap")).alias("margin"), n("comparable").alias("comparable"), n("different").alias("different"), F.count("decision").alias("decisions"), n(c("decision") == "split").alias("split"),
        n(c("decision") == "majority").alias("majority"), F.sum("even").alias("even"), F.sum("wide").alias("wide"), F.sum("distance").alias("distance"), F.sum("compared").alias("compared"), n("title").alias("judged_titles"),
    )
    by_place = judged.groupBy("official", "commission").agg(F.count("*").alias("n")).groupBy("official").agg(F.array_sort(F.collect_list(F.struct("commission", "n"))).alias("places"))
    wide = wide.join(by_place.select("official", F.to_json(F.map_from_entries("places")).alias("jurisdictions")), "official")
    refereed = bouts.withColumn("official", F.concat(F.lit("referee"), F.substring("subject", 2, 20).cast("long") % 25)).groupBy("official").agg(
        F.count("*").alias("refereed"), F.count("res").alias("refereed_known"), n("stopped").alias("stops"), F.sum(F.when(c("stopped"), c("round"))).alias("stop_rounds"), F.count(F.when(c("stopped"), c("round"))).alias("stops_r"), n(c("method") == "DQ").alias("dqs"),
        F.sum(k % 3).alias("deductions"), n("title").alias("refereed_titles"), F.sum(c("completed").cast("decimal(28,10)")).alias("completed"), F.count("completed").alias("completed_n"),
    )
    metrics = official_registry()
    return mt.told_kinds(wide, ["official"], [m for m in metrics if m.key.startswith("judge")]).union(mt.told_kinds(refereed, ["official"], [m for m in metrics if m.key.startswith("referee")]))
