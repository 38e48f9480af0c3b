"""Announced starts: printed local times become instants, and several statements of one start are brought together or left open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Printed zone labels by the zone whose rules they follow, and how a printed time looks.
ZONES = {
    "America/New_York": "et edt est eastern", "America/Chicago": "ct cdt cst central", "America/Denver": "mt mdt mst mountain", "America/Los_Angeles": "pt pdt pst pacific", "Europe/London": "gmt bst uk",
}
TIME = r"(?i)\b(\d{1,2})(?:[:.](\d{2}))?\s*(a\.?m\.?|p\.?m\.?)?\s*([A-Za-z]{2,8})\b"
CLOCK = r"(?i)\b(\d{1,2})(?:[:.](\d{2}))?\s*(a\.?m\.?|p\.?m\.?)"


def instant(date: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """The UTC second of a wall clock time in a zone, by the zone's rules of that date.

    Of an hour that comes twice the first counts; a time that a change of the clock leaves out is read by the rule after the change.
    """
    naive = F.date_diff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + hour * 3_600 + minute * 60
    offset = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone)) - s
    guess = naive - offset(naive)
    return naive - offset(guess)


def printed_starts(line: Column, date: Column) -> Column:
    """The instants (seconds) of all printed times of a line with a zone that is known, distinct, in their order."""
    zone_of = F.create_map(*[F.lit(x) for zone, labels in ZONES.items() for label in labels.split() for x in (label, zone)])
    group = lambda i: F.regexp_extract_all(line, F.lit(TIME), F.lit(i))
    seen = F.arrays_zip(group(1).alias("h"), group(2).alias("m"), group(3).alias("half"), group(4).alias("zone"))
    told = F.transform(seen, lambda x: F.struct(x.h.cast("int").alias("h"), F.coalesce(F.nullif(x.m, F.lit("")).cast("int"), F.lit(0)).alias("m"), F.lower(F.replace(x.half, F.lit("."), F.lit(""))).alias("half"), F.try_element_at(zone_of, F.lower(x.zone)).alias("zone")))
    known = F.filter(told, lambda x: x.zone.isNotNull() & (x.h <= 23))
    hour = lambda x: F.when((x.half == "pm") & (x.h < 12), x.h + 12).when((x.half == "am") & (x.h == 12), 0).otherwise(x.h)
    return F.array_distinct(F.transform(known, lambda x: instant(date, hour(x), x.m, x.zone)))


def announced_start(date: Column, structured: Column, line: Column) -> Column:
    """struct(start, basis) of a start that is stated as an instant (seconds; or null) and printed with zones (or null).

    structured and visible where only one is there, corroborated where both agree, visible_preferred where the printed times agree with each other only, unresolved (and no start) where they don't,
    or where a time is printed in no known zone beside an instant; none where nothing is told.
    """
    seen = F.coalesce(printed_starts(line, date), F.array().cast("array<bigint>"))
    unknown = F.coalesce(line.rlike(CLOCK), F.lit(False))
    first = F.get(seen, F.lit(0))
    basis = (
        F.when(F.size(seen) == 0, F.when(unknown & structured.isNotNull(), "unresolved").when(structured.isNotNull(), "structured").otherwise("none")).when(F.size(seen) > 1, "unresolved")
        .when(structured.isNull(), "visible").when(first == structured, "corroborated").otherwise("visible_preferred")
    )
    told = F.transform(F.array(F.struct(basis.alias("basis"), first.alias("first"))), lambda x: F.struct(F.when(x.basis == "structured", structured).when(x.basis.isin("visible", "corroborated", "visible_preferred"), x["first"]).alias("start"), x.basis.alias("basis")))
    return told[0]


# A record as documents print it.
RECORD = r"(?i)^(\d{1,3})-(\d{1,3})(?:-(\d{1,3}))?(?:-(\d{1,3}))?(?:\s*[,(]?\s*(\d{1,3})\s*KOs?\s*\)?)?$"


def printed_record(text: Column) -> Column:
    """struct(state, wins, losses, draws, no_contests, ko_wins) of a printed record, null of a blank one: parsed, or held (and no counts) where it isn't wins-losses[-draws[-no contests]] with or without knockouts, or has more of these than wins.

    A count that isn't printed is null and not 0.
    """
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    n = lambda i: F.nullif(F.regexp_extract(bare, RECORD, i), F.lit("")).cast("int")
    fits = bare.rlike(RECORD) & ~F.coalesce(n(5) > n(1), F.lit(False))
    counts = [F.when(fits, n(i)).alias(c) for i, c in enumerate(("wins", "losses", "draws", "no_contests", "ko_wins"), 1)]
    return F.when(bare != "", F.struct(F.when(fits, "parsed").otherwise("held").alias("state"), *counts))
