"""Recording facts: revisions by content, folds of field changes, gates, as-of seeds and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revisions(df: DataFrame, keys: list[str], order: list[str], content: str) -> DataFrame:
    """Rows whose content differs, null-safe, from the key's row before, numbered as revisions from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = df.withColumn("__n", (F.row_number().over(w) == 1) | ~F.col(content).eqNullSafe(F.lag(content).over(w))).filter("__n").drop("__n")
    return fresh.withColumn("revision", F.row_number().over(w))


def folded_fields(log: DataFrame, keys: list[str], field: str, value: str, order: list[str], fields: list[str]) -> DataFrame:
    """The state that a log of (field, value) changes leads to: the last value of each field, one aggregation."""
    last = lambda f: F.max_by(F.struct(value), F.when(F.col(field) == f, F.struct(*order)))[value].alias(f)
    return log.groupBy(*keys).agg(*[last(f) for f in fields])


def gated(rows: DataFrame, gates: DataFrame, key: str, is_open: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose gate is known and open, and the others with the reason."""
    met = rows.join(gates.withColumn("__open", is_open).select(key, "__open"), key, "left")
    reason = F.when(F.col("__open").isNull(), "not registered").when(~F.col("__open"), "closed")
    met = met.withColumn("reason", reason).drop("__open")
    return met.filter("reason IS NULL").drop("reason"), met.filter("reason IS NOT NULL")


def seeded_window(df: DataFrame, keys: list[str], at: str, id_: str, since: str, until: str) -> DataFrame:
    """Rows of [since, until] and each key's last row before, marked as its seed."""
    a, z = (F.lit(t).cast("timestamp_ntz") for t in (since, until))
    last = F.max(F.when(F.col(at) < a, F.struct(at, id_))).over(Window.partitionBy(*keys))
    seed = F.coalesce(F.struct(F.col(at), F.col(id_)) == last, F.lit(False))
    return df.withColumn("seed", seed).filter((F.col(at).between(a, z)) | F.col("seed"))


def first_match(df: DataFrame, lookups: list[tuple[DataFrame, dict[str, str], str]], name: str, default: str) -> DataFrame:
    """The first lookup that knows a row's keys: lookups are (table, {column: lookup column}, value column), each with unique keys."""
    out, found = df, []
    for n, (table, on, value) in enumerate(lookups):
        side = table.select(*[F.col(c).alias(f"__k{n}_{i}") for i, c in enumerate(on.values())], F.col(value).alias(f"__v{n}"))
        out = out.join(side, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{n}_{i}") for i, c in enumerate(on)]), "left")
        found.append(F.col(f"__v{n}"))
    return out.withColumn(name, F.coalesce(*found, F.lit(default))).select(*df.columns, name)


def unified(held: DataFrame, subject: list[str], body: str, holder: str, age_days: str, bodies: int, stale_after: int) -> DataFrame:
    """(subject, state, complete, holders, belts, holder): what the bodies' documents amount to, a row (subject, body, holder, age) each.

    A document is stale if it is more than `stale_after` days older than the subject's newest one; a body without a holder is vacant; else its holder counts. One holder of
    all bodies is undisputed, one of two or more unified; else a missing or stale document leaves the subject incomplete, and otherwise the state is none.
    """
    newest = held.groupBy(*subject).agg(F.min(age_days).alias("__newest"))
    met = held.join(newest, subject).withColumn("__stale", F.coalesce(F.col(age_days) > F.col("__newest") + stale_after, F.lit(True)))
    own = met.groupBy(*subject, F.when(~F.col("__stale"), F.col(holder)).alias("__holder")).agg(F.count_distinct(body).alias("n"), F.count_if("__stale").alias("stale"))
    kept = F.col("__holder").isNotNull()
    found = own.groupBy(*subject).agg(
        F.sum("n").alias("documents"), F.sum("stale").alias("stale"), F.count("__holder").alias("holders"), F.coalesce(F.max(F.when(kept, F.col("n"))), F.lit(0)).alias("belts"),
        F.min(F.when(kept & (F.col("n") == bodies), F.col("__holder"))).alias("holder"),
    )
    complete = (F.col("documents") == bodies) & (F.col("stale") == 0)
    state = F.when(F.col("belts") == bodies, "undisputed").when(F.col("belts") >= 2, "unified").when(~complete, "incomplete").otherwise("none")
    return found.select(*subject, state.alias("state"), complete.alias("complete"), "holders", "belts", "holder")


def decision(cards: Column, a: Column, b: Column, missing: Column) -> tuple[Column, Column, Column]:
    """(outcome, winner_side, decision_type) of a panel: its cards, those for either side, and those without a total, one of which voids all.

    One card is the referee's. A side needs over half of the cards; a draw has its kinds as a win has.
    """
    draws = cards - a - b
    known = (cards > 0) & (missing == 0)
    most, rest = F.greatest(a, b), F.least(a, b)
    won = F.when(cards == 1, draws == 0).otherwise(most * 2 > cards)
    kind = F.when(cards == 1, "referee").when(won, F.when(most == cards, "unanimous").when(rest == 0, "majority").otherwise("split"))
    kind = F.coalesce(kind, F.when(draws == cards, "unanimous").when(draws * 2 > cards, "majority").otherwise("split"))
    return F.when(known, F.when(won, "win").otherwise("draw")), F.when(known & won, F.when(a > b, "a").otherwise("b")), F.when(known, kind)


def result_code(outcome: Column, winner: Column, me: Column) -> Column:
    """W, L, D or NC from one side's view; ND where nothing is decided."""
    return F.when(outcome == "draw", "D").when(outcome == "void", "NC").when(winner == me, "W").when(winner.isNotNull(), "L").otherwise("ND")


def minutes(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def longest_label(text: Column, labels: dict[str, str]) -> Column:
    """The key of the longest pattern label that a text holds; a fixed, small vocabulary."""
    held = F.array(*[F.when(text.rlike(pattern), F.struct(F.lit(len(key)).alias("n"), F.lit(key).alias("key"))) for key, pattern in labels.items()])
    return F.array_max(F.array_compact(held)).key


#: Phrases whose list is sent to every task at once.
PHRASES = 1_000_000


def phrases_found(texts: DataFrame, vocabulary: DataFrame, id_: str, text: str, phrase: str, block: int = PHRASES) -> DataFrame:
    """(id, *vocabulary's columns, n): which phrases of a vocabulary table stand in each text at word edges, and how often.

    Both sides are cut to words of letters and digits in lower case, and every run of as many words as some phrase has meets the phrases where it stands: their list is sent to the tasks, in blocks of `block` different
    ones, so that only runs that are phrases are shuffled and counted. A vocabulary of any size does; phrases without a word find nothing.
    """
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    wanted = vocabulary.withColumn("__w", words(phrase)).filter(F.size("__w") > 0).withColumns({"__n": F.size("__w"), "__phrase": F.array_join("__w", " ")}).drop("__w")
    sizes = wanted.groupBy("__n").agg(F.count_distinct("__phrase").alias("n")).orderBy("__n").collect()  # the different lengths of phrases
    held = texts.select(F.col(id_), words(text).alias("__w"))
    lengths = F.array(*[F.lit(r[0]) for r in sizes]).cast("array<int>")
    runs = F.flatten(F.transform(lengths, lambda n: F.when(F.size("__w") >= n, F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: F.array_join(F.slice("__w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    each = held.select(id_, F.explode(runs).alias("__phrase"))
    blocks = max(1, -(-sum(r.n for r in sizes) // block))
    listed = wanted.select("__phrase").distinct()
    of = lambda b: listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("__phrase"), F.lit(blocks)) == b)
    met = reduce(DataFrame.unionAll, [each.join(F.broadcast(of(b)), "__phrase", "left_semi") for b in range(blocks)])
    return met.groupBy(id_, "__phrase").agg(F.count("*").alias("n")).join(wanted.drop("__n"), "__phrase").select(id_, *vocabulary.columns, "n")
