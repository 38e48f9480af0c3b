"""Semi-structured documents as rows, and the state of long backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import append_new


def json_ld(pages: DataFrame, html: str, schema: str) -> DataFrame:
    """A row for each linked-data block of a page, parsed by a declared schema; unreadable blocks have `ld` null."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return pages.withColumn("block", F.explode(found)).withColumn("ld", F.from_json("block", schema)).drop("block")


def calendar_events(files: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """A row for each VEVENT of an iCalendar text: folded lines are joined, parameters dropped, escapes undone."""
    unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    block = F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1)))
    rows = files.withColumn("event", block)

    def value(name: str) -> Column:
        raw = F.regexp_extract("event", rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\n", "\n"), r"\\([,;])", "$1"), r"\\\\", r"\\")
        return F.nullif(plain, F.lit("")).alias(name.lower())

    return rows.select(*[c for c in files.columns if c != text], *[value(f) for f in fields])


def replayed(stored: DataFrame, at: list[str], id_: str, since: str | None = None) -> DataFrame:
    """Stored payloads oldest first, by the first known of several times."""
    t = F.coalesce(*at)
    rows = stored if since is None else stored.filter(t >= F.lit(since).cast("timestamp_ntz"))
    return rows.orderBy(t, id_)


def pending(jobs: DataFrame, done: DataFrame, key: str, tries: int) -> DataFrame:
    """Jobs of a backfill that are neither completed nor have failed `tries` times; done has (key, ok)."""
    state = done.groupBy(key).agg(F.bool_or("ok").alias("__ok"), F.count_if(~F.col("ok")).alias("__failed"))
    over = state.filter(F.col("__ok") | (F.col("__failed") >= tries)).select(key)
    return jobs.join(over, key, "left_anti")


def record_done(results: DataFrame, path: str, key: str) -> int:
    """Appends a backfill's results (key, attempt, ok) to its log; a result that is there already is not written again."""
    return append_new(results, path, [key, "attempt"])
