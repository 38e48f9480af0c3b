"""Lookups and coverage, by stated cases."""

from datetime import date

from pyspark.sql import functions as F

from tessera.operators import identity, reads


def test_date_likeness(spark):
    cases = [
        ("1990-04-07", "1990-07-04", "typo_like"), ("1990-04-07", "1990-04-08", "typo_like"), ("1990-04-07", "1980-04-07", "typo_like"), ("1990-04-07", "1990-04-07", "exact"), ("1990-04-07", "1991-05-08", "conflict"),
        ("1999-12-31", "2000-01-01", "typo_like"), (None, "1990-04-07", "unknown"), ("1990-04-07", None, "unknown"),
    ]
    read = lambda d: None if d is None else date.fromisoformat(d)
    df = spark.createDataFrame([(i, read(a), read(b)) for i, (a, b, _) in enumerate(cases)], "i int, a date, b date")
    got = {r.i: r.like for r in df.select("i", identity.date_likeness(F.col("a"), F.col("b")).alias("like")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_id_prefix_needs_one(spark):
    ids = spark.createDataFrame([(i,) for i in range(40)] + [(7,)], "id long")
    whole = F.sha2(F.col("id").cast("string"), 256)
    asked = ids.select(F.substring(whole, F.lit(1), (12 + F.col("id") % 21).cast("int")).alias("slug")).distinct()
    odd = spark.createDataFrame([("none",), (None,), ("ABCDEF012345",), ("abc",)], "slug string").union(ids.limit(3).select(F.substring(whole, 1, 11))).union(ids.limit(2).select(F.substring(whole, 1, 33)))
    got = identity.by_id_prefix(asked.union(odd), "slug", ids, "id").collect()
    assert sorted(r.id for r in got if r.outcome == "matched") == list(range(40)) and sum(r.outcome == "unmatched" for r in got) == 9


def test_sharing_pairs_and_scopes(spark):
    df = spark.createDataFrame([(1, "g", [1, 2, 2]), (2, "g", [2, 1]), (3, "g", [9]), (4, "h", [1]), (5, "g", []), (6, "g", None)], "id int, k string, m array<int>")
    assert [tuple(r) for r in reads.sharing_pairs(df, "id", "m", ["k"]).collect()] == [("g", 1, 2, 2)]
    rows = [("all", None, None), ("upcoming", 5, "scheduled"), ("upcoming", 4, None), ("upcoming", 6, "complete"), ("results", 4, None), ("results", 5, None), ("results", 9, "complete"), ("other", 4, None), (None, 4, None), ("all", 4, "cancelled"), ("upcoming", None, None), ("results", None, None)]
    s = spark.createDataFrame(rows, "s string, t int, u string")
    kept = s.filter(reads.in_scope(F.col("s"), F.col("t"), F.col("u"), F.lit(5))).collect()
    assert [tuple(r) for r in kept] == [rows[i] for i in (0, 1, 4, 6, 7, 8)]


def test_pages_are_held_and_sorted_by_scope(spark):
    df = spark.createDataFrame([(i, date(2020, 1, 1 + i), None, f"n{i % 2}") for i in range(20)] + [(99, None, None, "z")], "id int, at date, st string, name string")
    page = lambda *a, **k: [r.id for r in reads.scoped_page(df, *a, "at", "st", "name", F.lit(date(2020, 1, 11)), **k).orderBy("place").collect()]
    assert page("upcoming", limit=3) == [10, 11, 12] and page("results", limit=2, offset=1) == [8, 7] and page("other", limit=0) == [19]
    assert page(None, limit=None)[-1] == 99 and len(page("all", limit=1000)) == 21 and page("all", offset=-4, limit=1) == [19]


def test_year_coverage_counts_what_is_held(spark):
    events = spark.createDataFrame([(1, "s", date(2001, 5, 1)), (2, "s", date(2001, 6, 1)), (3, "t", date(2001, 6, 1))], "event int, source string, event_date date")
    bouts = spark.createDataFrame([(11, 1, "scheduled", "2001-05-01-a"), (12, 1, "replaced", None), (13, 2, None, None)], "bout int, event int, status string, external_id string")
    members = spark.createDataFrame([(11, "x"), (11, "y"), (12, "z"), (13, "x")], "bout int, member string")
    decided = [("s", "k1", "2001-05-01-a", 1, "review"), ("s", "k2", "2001-05-01-b", 1, "matched"), ("s", "k2", "2001-05-01-b", 2, "review"), ("s", "k3", "2001-05-01-b", 1, "review"), ("s", "k4", "2001-06-01-c", 1, "review"), ("s", "k4", "2001-06-01-c", 2, "matched"), ("s", "k5", "2002-01-01-d", 1, "review")]
    told, by_event = reads.year_coverage(events, bouts, members, spark.createDataFrame(decided, "source string, appearance string, external_id string, seq int, decision string"))
    assert sorted(tuple(r) for r in told.select("source", "year", "events", "live", "replaced", "total", "linked", "held", "events_with_held").collect()) == [("s", 2001, 2, 2, 1, 3, 2, 1, 1), ("s", 2002, 0, 0, 0, 0, 0, 1, 1), ("t", 2001, 1, 0, 0, 0, 0, 0, 0)]
    assert sorted(tuple(r) for r in by_event.collect()) == [("s", 2001, "2001-05-01", 1), ("s", 2002, "2002-01-01", 1)]


def test_year_coverage_of_members_in_arrays_and_appearances_by_columns(spark):
    events = spark.createDataFrame([(1, "s", date(2001, 5, 1))], "event int, source string, event_date date")
    bouts = spark.createDataFrame([(11, 1, "scheduled", "2001-05-01-a", ["x", "y"]), (12, 1, "replaced", None, ["z"]), (13, 1, None, None, ["x"]), (14, 1, None, None, None)], "bout int, event int, status string, external_id string, members array<string>")
    decided = [("s", 1, 1, "2001-05-01-b", 1, "matched"), ("s", 1, 1, "2001-05-01-b", 2, "review"), ("s", 1, 2, "2001-05-01-c", 1, "review"), ("s", 1, 2, "2001-05-01-c", 2, "matched")]
    decisions = spark.createDataFrame(decided, "source string, event int, corner int, external_id string, seq int, decision string").repartition(3, "event")
    told, by_event = reads.year_coverage(events, bouts, None, decisions, ["event", "corner"])
    assert [tuple(r) for r in told.select("events", "live", "replaced", "total", "linked", "held", "events_with_held").collect()] == [(1, 3, 1, 4, 2, 1, 1)]
    assert [tuple(r) for r in by_event.collect()] == [("s", 2001, "2001-05-01", 1)]
