"""Price series: freshness, consensus, fair shares and movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import ratio, rounded
from tessera.operators.temporal import latest_per_key


# Seconds to the start up to which a window holds, and the age in seconds that it allows; the age of a live price.
PREMATCH_WINDOWS = ((3 * 3600, 30 * 60), (24 * 3600, 2 * 3600), (7 * 86400, 12 * 3600))
FAR_WINDOW, LIVE_WINDOW = 36 * 3600, 120


def freshness(last: Column, at: Column, start: Column | None = None, live: Column | None = None) -> Column:
    """unknown without a time; live or stale for a live price; closed once the start is reached; else fresh or stale by the window for the time that is left."""
    age = F.timestamp_diff("SECOND", last, at)
    limit, closed = F.lit(FAR_WINDOW), F.lit(False)
    if start is not None:
        left = F.timestamp_diff("SECOND", at, start)
        limit = F.lit(FAR_WINDOW)
        for until, window in reversed(PREMATCH_WINDOWS):
            limit = F.when(left <= until, window).otherwise(limit)
        closed = F.coalesce(left <= 0, F.lit(False))
    told = F.when(closed, "closed").when(age <= limit, "fresh").otherwise("stale")
    if live is not None:
        told = F.when(F.coalesce(live, F.lit(False)), F.when(age <= LIVE_WINDOW, "live").otherwise("stale")).otherwise(told)
    return F.when(last.isNull(), "unknown").otherwise(told)


def _american(odds: Column) -> Column:
    """American odds are whole numbers of at least 100 either way; others are null."""
    return F.when((F.abs(odds) >= 100) & (odds == F.floor(odds)), odds)


def implied_from_american(odds: Column) -> Column:
    a = _american(odds)
    return F.round(F.when(a > 0, 100.0 / (a + 100.0)).when(a < 0, -a / (-a + 100.0)), 8)


def decimal_from_american(odds: Column) -> Column:
    a = _american(odds)
    return F.round(F.when(a > 0, 1.0 + a / 100.0).when(a < 0, 1.0 + 100.0 / -a), 6)


def american_from_decimal(odds: Column) -> Column:
    """Decimal odds are over 1; others are null."""
    return F.when(odds >= 2.0, F.round((odds - 1.0) * 100.0)).when(odds > 1.0, -F.round(100.0 / (odds - 1.0))).cast("long")


def american_from_probability(p: Column) -> Column:
    """Probabilities are between 0 and 1, ends excluded; others are null."""
    return F.when((p >= 0.5) & (p < 1), -F.round(100.0 * p / (1.0 - p))).when((p > 0) & (p < 0.5), F.round(100.0 * (1.0 - p) / p)).cast("long")


def consensus(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sources, exact median (the mean of the middle two), lowest, highest and spread of each market."""
    v = F.col(value)
    median = F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY `{value}`)")
    found = df.groupBy(*keys).agg(F.count(v).alias("sources"), rounded(median).alias("median"), F.min(v).alias("lowest"), F.max(v).alias("highest"))
    return found.withColumn("spread", rounded(F.col("highest") - F.col("lowest")))


def consensus_as_of(df: DataFrame, market: list[str], source: list[str], at: str, id_: str, value: str, as_of: str, hours: int) -> DataFrame:
    """Consensus of each source's last price by `as_of`, no older than `hours`."""
    t = F.lit(as_of).cast("timestamp_ntz")
    seen = df.filter((F.col(at) <= t) & (F.col(at) > t - F.expr(f"INTERVAL {hours} HOURS")))
    return consensus(latest_per_key(seen.select(*market, *source, at, id_, value), [*market, *source], [at, id_]), market, value)


def moved(
    df: DataFrame, market: list[str], source: list[str], at: str, id_: str, value: str, as_of: str, hours: int = 24, threshold: float = 0.04, least: int = 2, open_: Column | None = None
) -> DataFrame:
    """Markets whose median moved by the threshold since `hours` before: the difference of two medians over the sources priced at both times, `least` of them at least.

    A source's price is its last open one that is not null. Both reads come from one aggregation. `band` and `from_band` are the steps of the threshold that the
    medians fall in, by which the same move is told again or not.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    then = now - F.expr(f"INTERVAL {hours} HOURS")
    order = F.struct(at, id_)
    priced = df.filter(F.col(value).isNotNull() & (F.col(at) <= now) & (F.lit(True) if open_ is None else F.coalesce(open_, F.lit(False))))
    last = lambda until: F.max_by(value, F.when(F.col(at) <= until, order))
    both = priced.groupBy(*market, *source).agg(last(now).alias("now_"), last(then).alias("then_")).filter("then_ IS NOT NULL")
    median = lambda c: F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY {c})")
    found = both.groupBy(*market).agg(F.count("*").alias("sources"), median("then_").alias("before"), median("now_").alias("after")).filter(F.col("sources") >= least)
    found = found.withColumn("move", F.col("after") - F.col("before")).filter(F.abs("move") >= threshold)
    band = lambda c: F.floor(F.col(c) / threshold)
    return found.select(
        *market, "sources", rounded(F.col("before")).alias("before"), rounded(F.col("after")).alias("after"), rounded(F.col("move")).alias("move"),
        F.when(F.col("move") > 0, "shortened").otherwise("drifted").alias("direction"), band("before").alias("from_band"), band("after").alias("band"),
    )


def fair_shares(df: DataFrame, market: list[str], implied: str) -> DataFrame:
    """df with overround and share: each outcome's part of its market's sum, of 8 places.

    A market is told only whole: both are null unless it has two outcomes at least and every one a probability between 0 and 1.
    """
    p = F.col(implied)
    sums = df.groupBy(*market).agg(F.sum(implied).alias("all_"), F.count("*").alias("n_"), F.count_if((p > 0) & (p < 1)).alias("valid_"))
    whole = (F.col("n_") >= 2) & (F.col("n_") == F.col("valid_"))
    found = df.join(sums, market).withColumn("all_", F.when(whole, F.col("all_")))
    return found.withColumns({"overround": rounded(F.col("all_"), 8), "share": rounded(ratio(p, F.col("all_")), 8)}).drop("all_", "n_", "valid_")
