"""Reads of revisioned and time-stamped facts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import all_of
from tessera.operators.sequences import before, carried
from tessera.sources.shared import dealt


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by `order`; one aggregation with map-side combining. Order by a unique column last."""
    others = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key by `order`, with their place `rn`."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= k)


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], k: int, bucket: Column) -> DataFrame:
    """The last k rows of each key by `order`, with their place `rn` from the newest: first of each bucket of a key, then of what these leave, so that a key of any size spreads."""
    newest = [F.desc(c) for c in order]
    inner = top_per_key(df.withColumn("__b", bucket), [*keys, "__b"], newest, k).drop("rn", "__b")
    return top_per_key(inner, keys, newest, k)


def as_of(df: DataFrame, keys: list[str], clocks: dict[str, str], order: list[str]) -> DataFrame:
    """The last row of each key that every clock allows: clocks maps a time column to the latest time it may hold."""
    allowed = all_of([F.col(c) <= F.lit(t).cast("timestamp_ntz") for c, t in clocks.items()])
    return latest_per_key(df.filter(allowed), keys, order)


def current_revisions(df: DataFrame, id_: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    gone = df.select(F.col(supersedes).alias("__gone")).filter("__gone IS NOT NULL").distinct()
    return df.join(gone, df[id_] == gone["__gone"], "left_anti")


def changes(df: DataFrame, keys: list[str], order: list[str], watched: list[str], bucket: Column | None = None) -> DataFrame:
    """Rows in which a watched column differs, null-safe, from the row before; the first of a key counts as a change.

    Rows are taken in the given order, which is that of arrival only where rows arrive in order. A bucket deals large keys out, see sequences.before.
    """
    seen = before(df, keys, order, {c: f"__was_{c}" for c in watched}, bucket)
    same = all_of([F.col(c).eqNullSafe(F.col(f"__was_{c}")) for c in watched])
    return seen.filter(F.col("first") | ~same).select(*df.columns)


def series_bounds(df: DataFrame, keys: list[str], at: str, id_: str, value: str) -> DataFrame:
    """opening, latest, change, opened_at, latest_at and ticks of each series, in one aggregation."""
    order = F.struct(at, id_)
    found = df.groupBy(*keys).agg(
        F.min_by(value, order).alias("opening"), F.max_by(value, order).alias("latest"), F.min(at).alias("opened_at"), F.max(at).alias("latest_at"), F.count("*").alias("ticks")
    )
    return found.withColumn("change", F.col("latest") - F.col("opening"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, at: str, right_id: str, right_at: str, days: int) -> DataFrame:
    """For each left row the nearest right row of its key within `days`; the earlier id on ties.

    Both sides are dealt to day buckets as wide as the band, so that a key of any size spreads out.
    """
    width = days * 86400
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c)) / width)
    l = left.withColumn("__b", F.explode(F.array(*[bucket(at) + i for i in (-1, 0, 1)])))
    met = l.join(right.withColumn("__b", bucket(right_at)), [*keys, "__b"])
    gap = F.abs(F.timestamp_diff("SECOND", F.col(right_at), F.col(at)))
    met = met.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") <= width)
    return met.groupBy(*keys, left_id).agg(F.min(F.struct("gap_seconds", right_id)).alias("__n")).select(*keys, left_id, F.col(f"__n.{right_id}").alias(right_id), "__n.gap_seconds")


def interval_of(df: DataFrame, value: Column, bands: list[tuple[str, float | None, float | None]], name: str) -> DataFrame:
    """The name of the fixed band [low, high) that holds a value; open ends are null."""
    out = None
    for label, low, high in bands:
        inside = F.lit(True)
        inside = inside & (value >= low) if low is not None else inside
        inside = inside & (value < high) if high is not None else inside
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return df.withColumn(name, out)


def overlapping(df: DataFrame, keys: list[str], id_: str, start: str, end: str, days: int = 90) -> DataFrame:
    """(keys, first_id, second_id): all pairs of rows of one key whose closed intervals overlap, the smaller id first.

    A null end is open, a row with a null start overlaps nothing. Intervals are dealt to time buckets of `days`, so that a key with many rows spreads, and a pair is told in the
    bucket in which its later interval starts. No interval of a key starts after its latest start, so that open ones need no bucket beyond it.
    """
    at = lambda c: F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / (days * 86400))
    rows = df.filter(F.col(start).isNotNull()).select(*keys, F.col(id_).alias("id"), F.col(start).alias("a"), F.col(end).alias("z"))
    latest = rows.groupBy(*keys).agg(F.max("a").alias("latest"))
    held = rows.join(latest, keys).withColumn("b", at(F.col("a"))).withColumn("last", F.greatest("b", at(F.least("latest", "z"))))
    first = held.select(*keys, F.col("id").alias("x"), F.col("a").alias("xa"), F.col("z").alias("xz"), F.explode(F.sequence("b", "last")).alias("b"))
    later = held.select(*keys, F.col("id").alias("y"), F.col("a").alias("ya"), F.col("z").alias("yz"), "b")
    met = first.join(later, [*keys, "b"]).filter((F.struct("xa", "x") < F.struct("ya", "y")) & (F.col("xz").isNull() | (F.col("xz") >= F.col("ya"))) & (F.col("yz").isNull() | (F.col("yz") >= F.col("xa"))))
    return met.select(*keys, F.least("x", "y").alias("first_id"), F.greatest("x", "y").alias("second_id"))


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, rows: int | None = None) -> DataFrame:
    """points with the columns of each interval [low, high) of a table that holds them (all of them, if several do); an open end is null, a point in none is left out. Values are whole numbers or days.

    Where no two intervals of a key overlap, a point can only be in the last one that starts at it or before, which one pass over both in order carries to it: each row
    is shuffled once, whatever the lengths. `rows` is a bound of both tables' rows for who knows one without counting. Keys with overlapping intervals go by a ladder of buckets, see _by_ladder.
    """
    number = lambda c: F.date_diff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long") if dict(points.dtypes)[at] == "date" else F.col(c).cast("long")
    others = [c for c in intervals.columns if c not in keys]
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    held = intervals.filter(known & (F.col(low).isNull() | F.col(high).isNull() | (F.col(low) < F.col(high)))).select(*keys, F.struct(*others).alias("__i"), number(low).alias("__lo"), number(high).alias("__hi"))
    asked = points.filter(F.col(at).isNotNull() & known).withColumn("__v", number(at))
    first, last = F.lit(-(2**63)), F.lit(2**63 - 1)
    start = F.coalesce("__lo", first)
    # an interval that starts before the latest end so far overlaps another
    ended = F.max(F.coalesce("__hi", last)).over(Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1))
    mixed = held.withColumn("__e", ended).filter(start < F.col("__e")).select(*keys).distinct()
    rest = [F.col(f"__p_{c}").alias(c) for c in points.columns if c not in keys]

    def by_order(asked: DataFrame, held: DataFrame) -> DataFrame:
        at_start = held.select(*keys, start.alias("__s"), F.lit(0).alias("__kind"), F.struct("__i", "__hi").alias("__f"))
        at_point = asked.select(*keys, F.col("__v").alias("__s"), F.lit(1).alias("__kind"), *[F.col(c).alias(f"__p_{c}") for c in points.columns if c not in keys])
        met = carried(dealt(at_start.unionByName(at_point, allowMissingColumns=True), *keys, rows=rows), keys, ["__s", "__kind"], "__f", "__in").filter("__kind = 1 AND __in IS NOT NULL AND (__in.__hi IS NULL OR __s < __in.__hi)")
        told = met.select(*keys, *rest, *[F.col(f"__in.__i.{c}").alias(c) for c in others])
        return told.select(*points.columns, *others)

    if mixed.isEmpty():
        return by_order(asked, held)
    of = lambda df, how: df.join(mixed, keys, how)
    return by_order(of(asked, "left_anti"), of(held, "left_anti")).unionByName(_by_ladder(of(asked, "left_semi"), of(held, "left_semi"), keys, points.columns, others))


def _by_ladder(asked: DataFrame, held: DataFrame, keys: list[str], columns: list[str], others: list[str]) -> DataFrame:
    """An interval of length l stands at the level whose buckets are as wide as the power of two from l up, where it touches two at most, and one with an open end at a level of its own, where a key has few; a point asks
    each level that its key has. Nothing is compared that isn't in one bucket.
    """
    level = F.when(F.col("__lo").isNull() | F.col("__hi").isNull(), -1).otherwise(F.ceil(F.log2(F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)).cast("double"))).cast("int"))
    bucket = lambda v, l: F.call_function("shiftright", v, l)
    held = held.withColumn("__l", level)
    touched = F.when(F.col("__l") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bucket(F.col("__lo"), F.col("__l")), bucket(F.col("__hi") - 1, F.col("__l"))))
    held = held.withColumn("__b", F.explode(touched))
    levels = held.groupBy(*keys).agg(F.collect_set("__l").alias("__ls"))  # 65 at most
    asked = asked.join(levels, keys).withColumn("__l", F.explode("__ls")).drop("__ls")
    asked = asked.withColumn("__b", F.when(F.col("__l") < 0, F.lit(0).cast("long")).otherwise(bucket(F.col("__v"), F.col("__l"))))
    met = asked.join(held, [*keys, "__l", "__b"]).filter((F.col("__lo").isNull() | (F.col("__v") >= F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("__v") < F.col("__hi"))))
    return met.select(*columns, *[F.col(f"__i.{c}").alias(c) for c in others])
