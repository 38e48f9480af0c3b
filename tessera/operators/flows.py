"""Steps of incremental and fail-closed pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def touched(new: DataFrame, all_: DataFrame, key: str, neighbour: str) -> DataFrame:
    """Keys to be recomputed: those of the new rows and those that share a neighbour value with them."""
    own = new.select(key).distinct()
    shared = all_.join(own, key, "left_semi").select(neighbour).distinct()
    return all_.join(shared, neighbour, "left_semi").select(key).union(own).distinct()


def keyset_page(df: DataFrame, order: dict[str, object], limit: int) -> DataFrame:
    """The rows behind a place in a descending total order, compared as a whole; no offset is counted."""
    place = F.struct(*[F.lit(v).alias(c) for c, v in order.items()])
    here = F.struct(*[F.col(c).cast(dict(df.select(*order).dtypes)[c]).alias(c) for c in order])
    return df.filter(here < place.cast(df.select(here.alias("h")).schema["h"].dataType)).orderBy(*[F.desc(c) for c in order]).limit(limit)


def claims(df: DataFrame, subject: str, attributes: list[str]) -> DataFrame:
    """(subject, attribute, value, claim): known attributes as rows with a hash of what they say."""
    long = df.select(F.col(subject).alias("subject"), *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot("subject", attributes, "attribute", "value")
    return long.filter("value IS NOT NULL").withColumn("claim", F.sha2(F.concat_ws("|", F.col("subject").cast("string"), "attribute", "value"), 256))


def refused_groups(df: DataFrame, group: list[str], known: Column) -> DataFrame:
    """(group, rows, unknown, decision): a document is imported whole or, if one row is unknown, refused whole."""
    found = df.groupBy(*group).agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"))
    return found.withColumn("decision", F.when(F.col("unknown") > 0, "refused").otherwise("imported"))


def emitted_once(df: DataFrame, dedupe: list[str], order: list[str]) -> DataFrame:
    """The first row of each dedupe key."""
    others = [c for c in df.columns if c not in dedupe]
    first = df.groupBy(*dedupe).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__r"))
    return first.select(*dedupe, *[F.col(f"__r.{c}").alias(c) for c in others])


def cadence(minutes_left: Column) -> Column:
    """Polling interval in minutes: 15 from three hours before the start to two after it, else by the time that is left; far where nothing is ahead."""
    return F.when(minutes_left.between(-120, 180), 15).when(minutes_left <= 0, 360).when(minutes_left <= 1440, 30).when(minutes_left <= 10080, 120).otherwise(360)


def temporal_gate(at: Column, now: Column, days: int, exempt: Column) -> Column:
    """skipped where a fact is older than `days` and of no exempt kind, else pending."""
    return F.when(~exempt & (F.date_diff(now, at) > days), "skipped").otherwise("pending")
