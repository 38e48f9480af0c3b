"""A versioned registry of measures over an aggregate, told in long form with status and sample size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import half_up, ratio, status


@dataclass(frozen=True)
class Metric:
    """value and sample are expressions over a wide aggregate; below `least` samples there is no value, and where `covered` is 0 no source tells it."""

    key: str
    value: Column
    sample: Column
    least: int = 1
    version: int = 1
    covered: Column | None = None


def told(wide: DataFrame, subject: list[str], metrics: list[Metric]) -> DataFrame:
    """(subject, metric, version, status, value, sample): a row for each metric, exploded from one wide aggregate."""
    missing = lambda m: F.lit(False) if m.covered is None else m.covered == 0
    rows = [
        F.struct(
            F.lit(m.key).alias("metric"), F.lit(m.version).alias("version"), F.when(missing(m), "source_unavailable").when(m.value.isNull() & (m.sample >= m.least), "not_applicable").otherwise(status(m.sample, m.least)).alias("status"),
            half_up(F.when(m.sample >= m.least, m.value.cast("double"))).alias("value"), m.sample.cast("long").alias("sample"),
        )
        for m in metrics
    ]
    return wide.select(*subject, F.explode(F.array(*rows)).alias("m")).select(*subject, "m.*")


@dataclass(frozen=True)
class Kind:
    """A metric whose value is a number, a category or a document.

    Where `covered` is 0 no source tells it; below `least` samples there is no value; where `gap` holds the source lacks a field; a null value then means that the
    metric doesn't apply. What no source tells has a sample of 0.
    """

    key: str
    value: Column
    sample: Column
    least: int = 1
    kind: str = "number"
    covered: Column | None = None
    gap: Column | None = None


def told_kinds(wide: DataFrame, subject: list[str], metrics: list[Kind]) -> DataFrame:
    """(subject, metric, status, value_number, value_text, value_json, sample): a row for each metric of one wide aggregate; only an available metric has a value."""
    rows = []
    for m in metrics:
        state = F.when(m.sample < m.least, "insufficient_sample")
        if m.covered is not None:
            state = F.when(m.covered == 0, "source_unavailable").when(m.sample < m.least, "insufficient_sample")
        if m.gap is not None:
            state = state.when(m.gap, "source_unavailable")
        state = state.when(m.value.isNull(), "not_applicable").otherwise("available")
        value = F.when(state == "available", m.value)
        none = F.lit(None).cast("string")
        rows.append(F.struct(
            F.lit(m.key).alias("metric"), state.alias("status"), (half_up(value.cast("double")) if m.kind == "number" else F.lit(None).cast("double")).alias("value_number"),
            (value if m.kind == "text" else none).alias("value_text"), (value if m.kind == "json" else none).alias("value_json"), F.when(state == "source_unavailable", 0).otherwise(m.sample).cast("long").alias("sample"),
        ))
    return wide.select(*subject, F.explode(F.array(*rows)).alias("m")).select(*subject, "m.*")


def weighted_mean(x: Column, weight: Column) -> Column:
    """Mean over rows where both are known; null where the weights sum to zero."""
    known = x.isNotNull() & weight.isNotNull()
    return ratio(F.sum(F.when(known, x * weight)), F.sum(F.when(known, weight)))


def leave_one_out(df: DataFrame, panel: list[str], value: str, name: str = "others_mean") -> DataFrame:
    """Rows with the mean of the other known values of their panel; null for a panel of one."""
    w = Window.partitionBy(*panel)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), ratio(total - F.col(value), n - 1)))


def strict_majority(df: DataFrame, panel: list[str], value: str) -> DataFrame:
    """(panel, majority, votes, members): the value that over half of a panel's known votes have, if any."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*panel, value).agg(F.count("*").alias("n"))
    found = votes.groupBy(*panel).agg(F.max_by(value, F.struct("n", value)).alias("majority"), F.max("n").alias("votes"), F.sum("n").alias("members"))
    return found.withColumn("majority", F.when(F.col("votes") * 2 > F.col("members"), F.col("majority")))


def differentials(subjects: DataFrame, pairs: DataFrame, id_: str, a: str, b: str, measures: list[str]) -> DataFrame:
    """Pairs with the difference of each measure, null where either side lacks it."""
    side = lambda name, p: subjects.select(F.col(id_).alias(name), *[F.col(m).alias(f"{p}_{m}") for m in measures])
    return pairs.join(side(a, "a"), a).join(side(b, "b"), b).withColumns({f"d_{m}": F.col(f"a_{m}") - F.col(f"b_{m}") for m in measures})


def against_others(df: DataFrame, panel: list[str], vote: str) -> DataFrame:
    """(panel, vote, members, comparable, different): how many members of a panel with a vote can be compared, and differ, with the strict majority of the others.

    A member's own vote is not in the majority it is compared with, and it takes two others at least. Null votes are none. Votes are few kinds, so a panel's tally is short.
    """
    tally = df.filter(F.col(vote).isNotNull()).groupBy(*panel, vote).agg(F.count("*").alias("n"))
    panels = tally.groupBy(*panel).agg(F.collect_list(F.struct("n", vote)).alias("all_"), (F.sum("n") - 1).alias("others"))
    one = panels.select(*panel, "all_", "others", F.explode("all_").alias("own"))
    top = F.array_max(F.transform("all_", lambda x: F.struct((x.n - (x[vote] == F.col(f"own.{vote}")).cast("int")).alias("n"), x[vote].alias("vote"))))
    met = one.withColumn("top", top).withColumn("ok", (F.col("others") >= 2) & (F.col("top.n") * 2 > F.col("others")))
    return met.select(
        *panel, F.col(f"own.{vote}").alias(vote), F.col("own.n").alias("members"), F.when(F.col("ok"), F.col("own.n")).otherwise(0).alias("comparable"),
        F.when(F.col("ok") & (F.col("top.vote") != F.col(f"own.{vote}")), F.col("own.n")).otherwise(0).alias("different"),
    )
