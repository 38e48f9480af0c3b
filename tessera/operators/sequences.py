"""Runs, streaks, folds of event logs and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, keys: list[str], order: list[str], carried: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Rows with `first` and, for each column of `carried`, its value in the key's row before under the new name.

    With a bucket, a non-decreasing function of the order such as a date, a key of any size is dealt to its buckets: the row before is found
    inside the bucket, and for a bucket's first row in the last row of the bucket before, of which there is one.
    """
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: F.lag(old).over(w) for old, new in carried.items()} | {"first": F.row_number().over(w) == 1})
    rows = df.withColumn("__b", bucket)
    last = F.max_by(F.struct(*[F.col(old).alias(new) for old, new in carried.items()]), F.struct(*order))
    edges = rows.groupBy(*keys, "__b").agg(last.alias("__last"))
    edges = edges.withColumn("__edge", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b"))).drop("__last")
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    head = F.col("__n") == 1
    inner = rows.withColumns({f"__{new}": F.lag(old).over(w) for old, new in carried.items()} | {"__n": F.row_number().over(w)})
    met = inner.join(edges, [*keys, "__b"])
    found = {new: F.when(head, F.col(f"__edge.{new}")).otherwise(F.col(f"__{new}")) for new in carried.values()}
    met = met.withColumns(found | {"first": head & F.col("__edge").isNull()})
    return met.drop("__b", "__n", "__edge", *[f"__{new}" for new in carried.values()])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], bucket: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Rows with running sums over the key in order, of the rows before and, if inclusive, their own. Buckets as in `before`: a bucket's sums start from those of the buckets before."""
    end = 0 if inclusive else -1
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, end)
    if bucket is None:
        w = frame(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumns({k: F.coalesce(F.sum(c.cast("long")).over(w), F.lit(0)) for k, c in sums.items()})
    rows = df.withColumn("__b", bucket).withColumns({f"__x_{k}": c.cast("long") for k, c in sums.items()})
    totals = rows.groupBy(*keys, "__b").agg(*[F.sum(f"__x_{k}").alias(f"__t_{k}") for k in sums])
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums])
    w = frame(Window.partitionBy(*keys, "__b").orderBy(*order))
    inner = rows.withColumns({f"__i_{k}": F.coalesce(F.sum(f"__x_{k}").over(w), F.lit(0)) for k in sums})
    met = inner.join(totals, [*keys, "__b"]).withColumns({k: F.col(f"__i_{k}") + F.col(f"__o_{k}") for k in sums})
    return met.drop("__b", *[f"__{p}_{k}" for k in sums for p in "xoi"])


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, bucket: Column | None = None) -> DataFrame:
    """Rows with the last known `value` at or before them in the key's order. Buckets as in `before`: a bucket starts from the last known value of the buckets before."""
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if bucket is None:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(frame(Window.partitionBy(*keys).orderBy(*order))))
    rows = df.withColumn("__b", bucket)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last")
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*keys, "__b").agg(last).select(*keys, "__b", F.last("__last", ignorenulls=True).over(earlier).alias("__edge"))
    inner = rows.withColumn("__in", F.last(value, ignorenulls=True).over(frame(Window.partitionBy(*keys, "__b").orderBy(*order))))
    same = [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in [*keys, "__b"]]
    met = inner.alias("__l").join(edges.alias("__r"), same, "left").select("__l.*", "__r.__edge")
    return met.withColumn(name, F.coalesce("__in", "__edge")).drop("__b", "__in", "__edge")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Rows with `island`, the number of their run of equal neighbouring values (null-safe) within the key."""
    marked = before(df, keys, order, {value: "__before"}, bucket)
    starts = F.col("first") | ~F.col(value).eqNullSafe(F.col("__before"))
    return running(marked, keys, order, {"island": starts}, bucket).drop("__before", "first")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, at: str, bucket: Column | None = None) -> DataFrame:
    """One row a run: value, first and last time, length."""
    return islands(df, keys, order, value, bucket).groupBy(*keys, "island").agg(
        F.first(value).alias(value), F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count("*").alias("length")
    )


def latest_streak(df: DataFrame, keys: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """The last run of each key."""
    found = runs(df, keys, order, value, at)
    row = F.max_by(F.struct(value, "started_at", "length"), "island").alias("r")
    return found.groupBy(*keys).agg(row).select(*keys, "r.*")


def reigns(df: DataFrame, keys: list[str], order: list[str], at: str, holder: Column, vacates: Column) -> DataFrame:
    """Folds an event log into reigns: an event names a holder, vacates the seat, or leaves things as they are.

    State after each event is the last deciding one; a reign lasts from the event that sets it to the next that
    changes it. Open reigns have ended_at null.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    decided = df.withColumn("__d", F.when(vacates, F.lit("")).otherwise(holder)).filter("__d IS NOT NULL")
    changed = decided.withColumn("__p", F.lag("__d").over(w)).filter(~F.col("__d").eqNullSafe(F.col("__p")))
    spans = changed.withColumn("ended_at", F.lead(at).over(w)).filter("__d <> ''")
    return spans.select(*keys, F.col("__d").alias("holder"), F.col(at).alias("started_at"), "ended_at")


def entering(df: DataFrame, keys: list[str], order: list[str], counts: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """Rows with how often each condition held in the key's rows before."""
    return running(df, keys, order, counts, bucket, inclusive=False)


def consecutive(df: DataFrame, keys: list[str], order: list[str], carried: dict[str, str], bucket: Column | None = None) -> DataFrame:
    """Rows with columns of the row before: carried maps a column to the name of its earlier value; first rows are left out."""
    return before(df, keys, order, carried, bucket).filter(~F.col("first")).drop("first")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], member: str, place: str) -> DataFrame:
    """What changed from one ranked snapshot to the next: joined, left, up, down or same, with both places and the move."""
    a = old.select(*keys, member, F.col(place).alias("old_place"))
    b = new.select(*keys, member, F.col(place).alias("new_place"))
    both = a.join(b, [*keys, member], "full_outer")
    kind = (
        F.when(F.col("old_place").isNull(), "joined").when(F.col("new_place").isNull(), "left")
        .when(F.col("new_place") < F.col("old_place"), "up").when(F.col("new_place") > F.col("old_place"), "down").otherwise("same")
    )
    return both.withColumn("change", kind).withColumn("move", F.col("old_place") - F.col("new_place"))


def missing_months(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Months without a row between the first and last month of each key."""
    month = F.trunc(F.col(at), "month")
    have = df.select(*keys, month.alias("month")).distinct()
    span = have.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    all_ = span.select(*keys, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return all_.join(have, [*keys, "month"], "left_anti")
