"""Checks of what officials write down: judges' cards, results against the cards, and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.records import decision

# The most points of a side in a round, kilograms of a pound, pounds of a stone, and how stones are printed.
MOST_POINTS, KG_PER_LB, LB_PER_STONE = 10, 0.45359237, 14
STONES = r"(?i)^\s*(\d+)\s*st(?:one)?s?\s*(?:(\d+(?:\.\d+)?)\s*(?:lb|lbs|pounds?))?\s*$"


def card_problems(rounds: Column, a_total: Column, b_total: Column, scheduled: Column, stopped: Column) -> Column:
    """What is wrong with a card, as an array of names, empty if nothing: invalid_round, duplicate_round, beyond_scheduled, points_out_of_range, no_ten (and no deduction), round_count, totals.

    rounds is array<struct<round, a, b, deduction>>, empty (or null) if only totals are known; a fight stopped in a round has cards up to that one. What isn't known is not checked.
    """
    r = F.coalesce(rounds, F.array().cast("array<struct<round:int,a:int,b:int,deduction:boolean>>"))
    numbers = F.transform(r, lambda x: x["round"])
    wrong = lambda p: p.isNull() | (p < 0) | (p > MOST_POINTS)
    total = lambda side: F.aggregate(r, F.lit(0), lambda acc, x: acc + x[side])
    wanted = F.coalesce(stopped, scheduled)
    rules = {
        "invalid_round": F.exists(numbers, lambda n: n.isNull() | (n < 1)), "duplicate_round": F.size(F.array_distinct(numbers)) < F.size(numbers), "beyond_scheduled": F.exists(numbers, lambda n: n > scheduled),
        "points_out_of_range": F.exists(r, lambda x: wrong(x.a) | wrong(x.b)), "no_ten": F.exists(r, lambda x: (F.greatest(x.a, x.b) < MOST_POINTS) & ~F.coalesce(x.deduction, F.lit(False))),
        "round_count": (F.size(r) > 0) & (F.size(r) != wanted), "totals": (F.size(r) > 0) & ((total("a") != a_total) | (total("b") != b_total)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items()]))


def result_problems(results: DataFrame, cards: DataFrame, bout: str) -> DataFrame:
    """results with `problems`: where a decision's outcome, winner's side or kind is not what its cards (a_total, b_total) say, as an array of names; cards_incomplete where a card lacks a total.

    Results: outcome, winner_side, method, decision_type. Only decisions with a card are checked, and a kind or winner only where the result names one.
    """
    t = cards.groupBy(bout).agg(F.count("*").alias("__n"), F.count_if(F.col("a_total") > F.col("b_total")).alias("__a"), F.count_if(F.col("b_total") > F.col("a_total")).alias("__b"), F.count_if(F.col("a_total").isNull() | F.col("b_total").isNull()).alias("__m"))
    outcome, side, kind = decision(F.col("__n"), F.col("__a"), F.col("__b"), F.col("__m"))
    met = results.join(t, bout, "left").withColumns({"__o": outcome, "__s": side, "__k": kind})
    checked = F.col("method").isin("DECISION", "TECHNICAL_DECISION") & (F.col("__n") > 0)
    told = F.col("__o").isNotNull()
    rules = {
        "cards_incomplete": ~told, "outcome": told & ~F.col("__o").eqNullSafe(F.col("outcome")), "winner_side": told & (F.col("__o") == "win") & (F.col("winner_side") != F.col("__s")), "decision_type": told & (F.col("decision_type") != F.col("__k")),
    }
    problems = F.array_compact(F.array(*[F.when(F.coalesce(checked & holds, F.lit(False)), name) for name, holds in rules.items()]))
    return met.withColumn("problems", problems).drop("__n", "__a", "__b", "__m", "__o", "__s", "__k")


def pounds(value: Column, unit: Column) -> Column:
    """A reading in pounds: lb as it is, kg to two places, stone_lb as printed (`10st 7.5lb`); null for what can't be read or another unit."""
    number = value.try_cast("double")
    stones = lambda i: F.nullif(F.regexp_extract(value, STONES, i), F.lit("")).cast("double")
    return F.when(unit == "lb", number).when(unit == "kg", F.floor(number / KG_PER_LB * 100 + 0.5) / 100).when(unit == "stone_lb", stones(1) * LB_PER_STONE + F.coalesce(stones(2), F.lit(0.0)))


def kilograms(lb: Column) -> Column:
    return F.floor(lb * KG_PER_LB * 1000 + 0.5) / 1000


def weighed(official: Column, contracted: Column) -> tuple[Column, Column]:
    """(status, miss): made_weight, or missed_weight by so many pounds over what this bout is contracted at, not over the division's limit; recorded where either is unknown."""
    over = F.floor((official - contracted) * 100 + 0.5) / 100
    return F.when(over > 0, "missed_weight").when(over.isNotNull(), "made_weight").otherwise("recorded"), F.when(over > 0, over).when(over.isNotNull(), 0.0)


def catchweight(contracted: Column, limit: Column) -> Column:
    """Whether a bout is contracted at another weight than its division's limit; null if either is unknown."""
    return contracted != limit


def weigh_in_news(kind: Column, verification: Column, status: Column) -> Column:
    """WEIGHT_MISSED for a verified official miss alone; WEIGH_IN_RESULT for what is verified or reported and not for show; else nothing."""
    return F.when((kind == "official") & (verification == "verified") & (status == "missed_weight"), "WEIGHT_MISSED").when(verification.isin("verified", "reported") & ~kind.eqNullSafe("ceremonial"), "WEIGH_IN_RESULT")


def record_check(claims: DataFrame, ledger: DataFrame, subject: str) -> DataFrame:
    """claims (one a subject: wins, losses, draws as printed) with `state` and the ledger's counts: agrees, ledger_short (the ledger has fewer, as its cover may begin late), conflict (it has more of something), or no_ledger; a draw count that isn't printed is not compared."""
    l = ledger.select(subject, *[F.col(c).alias(f"l_{c}") for c in ("wins", "losses", "draws")])
    met = claims.join(l, subject, "left")
    gap = lambda c: F.coalesce(F.col(c) - F.col(f"l_{c}"), F.lit(0))
    gaps = [gap(c) for c in ("wins", "losses", "draws")]
    state = F.when(F.col("l_wins").isNull(), "no_ledger").when(F.least(*gaps) < 0, "conflict").when(F.greatest(*gaps) > 0, "ledger_short").otherwise("agrees")
    return met.withColumn("state", state)
