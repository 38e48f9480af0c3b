import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import cards as cd
from tessera.operators import names as nm

BOUT = "event_id string, bout_id string, external_id string, status string, bout_order int, segment string, rounds int, weight double, weight_class string, a string, b string, titles array<struct<title: string, eligible: string>>, officials array<struct<official: string, role: string, slot: int>>"
DOC = BOUT.replace("bout_id string", "n int") + ", class_contradicted boolean, officials_complete boolean"
EVENT = "event_id string, event_date date, start_at timestamp_ntz, status string, venue string, commission string, deferred boolean"
DAY = dt.date(2026, 11, 7)


def bout(id_, a, b, **more):
    return {"event_id": "e", "bout_id": id_, "external_id": None, "status": "scheduled", "bout_order": 1, "segment": None, "rounds": 10, "weight": None, "weight_class": None, "a": a, "b": b, "titles": [], "officials": [], **more}


def doc(n, a, b, **more):
    none = dict.fromkeys("external_id status bout_order segment rounds weight weight_class titles officials class_contradicted officials_complete".split())
    return {"event_id": "e", "n": n, "a": a, "b": b, **none, **more}


STATE = [bout("B1", "x", "y", external_id="b1"), bout("B2", "p", "q", external_id="b2", titles=[("t1", None)], officials=[("r1", "referee", None), ("j1", "judge", 1)], weight_class="middle"), bout("B3", "m", "n"), bout("B4", "m", "n", bout_order=2)]
CASES = [  # documents, changes as (ref, type, before, after), reasons to look
    ([doc(1, "x", "z", external_id="b1")], [("B1", "opponent_replaced", "y", "z")], []),
    ([doc(1, "x", "z")], [("pair:x|z", "bout_added", None, "x|z")], ["pair:x|z for B1"]),
    ([doc(1, "q", "p", external_id="b2")], [], []),
    ([], [], []),
    ([doc(1, "y", "x", status="cancelled", rounds=12)], [("B1", "bout_cancelled", "scheduled", "cancelled"), ("B1", "scheduled_rounds_changed", "10", "12")], []),
    ([doc(1, "x", "y", external_id="b9")], [("ext:b9", "bout_added", None, "x|y")], []),
    ([doc(1, "m", "n", external_id="b3", bout_order=1), doc(2, "n", "m", external_id="b4", bout_order=7)], [("B4", "card_order_changed", "2", "7")], []),
    ([doc(1, "m", "n", bout_order=1), doc(2, "m", "n", bout_order=2), doc(3, "m", "n")], [("pair:m|n", "bout_added", None, "m|n")], ["pair:m|n for B3,B4"]),
    ([doc(1, "p", "q", titles=[])], [("B2", "title_removed", "t1:-", None)], []),
    ([doc(1, "p", "q", titles=[("t1", "p"), ("t2", None)])], [("B2", "title_added", None, "t2:-"), ("B2", "title_eligibility_changed", "t1:-", "t1:p")], []),
    ([doc(1, "p", "q", officials=[("r2", "referee", None), ("j1", "judge", 3)], officials_complete=False)], [("B2", "official_replaced", "referee:-:r1", "referee:-:r2")], []),
    ([doc(1, "p", "q", officials=[("r1", "referee", None), ("j5", "judge", 2)], officials_complete=True)], [("B2", "official_assigned", None, "judge:2:j5"), ("B2", "official_removed", "judge:1:j1", None)], []),
    ([doc(1, "p", "q", weight=165.0, class_contradicted=True)], [("B2", "contracted_weight_changed", None, "165.0"), ("B2", "weight_class_changed", "middle", None)], []),
    ([doc(1, "p", "q", weight_class="light", class_contradicted=True, segment="main")], [("B2", "card_segment_changed", None, "main"), ("B2", "weight_class_changed", "middle", "light")], []),
    ([doc(1, "u", "v", external_id="n1", titles=[("t1", "u")], officials=[("r1", "referee", None)])], [("ext:n1", "bout_added", None, "u|v"), ("ext:n1", "official_assigned", None, "referee:-:r1"), ("ext:n1", "title_added", None, "t1:u")], []),
    ([doc(1, "z", "w", external_id="b1")], [("B1", "opponent_replaced", "x", "z"), ("B1", "opponent_replaced", "y", "w")], []),
]


def test_bouts(spark):
    docs, state = [], []
    for i, (own, *_) in enumerate(CASES):  # every case is a card of its own
        docs += [{**d, "event_id": f"{i}"} for d in own]
        state += [{**b, "event_id": f"{i}"} for b in STATE]
    changes, review = cd.bout_changes(spark.createDataFrame(docs, DOC), spark.createDataFrame(state, BOUT))
    got, odd = changes.collect(), review.collect()
    for i, (_, want, reasons) in enumerate(CASES):
        assert sorted([(r.ref, r.type, r.before, r.after) for r in got if r.event_id == f"{i}"], key=str) == sorted(want, key=str), i
        assert [r.detail for r in odd if r.event_id == f"{i}"] == reasons, i


EVENTS = [  # on record, document, changes, disagreements
    (None, {}, [("event_announced", None, "2026-11-07"), ("venue_changed", None, "v"), ("commission_changed", None, "c")], []),
    ({}, {}, [], []),
    ({}, {"event_date": dt.date(2026, 12, 1)}, [("event_postponed", "2026-11-07 00:00:00", "2026-12-01 00:00:00")], []),
    ({}, {"event_date": dt.date(2026, 11, 1)}, [("event_date_changed", "2026-11-07 00:00:00", "2026-11-01 00:00:00")], []),
    ({}, {"start_at": dt.datetime(2026, 11, 7, 20)}, [("event_postponed", "2026-11-07 00:00:00", "2026-11-07 20:00:00")], []),
    ({}, {"status": "cancelled"}, [("event_cancelled", "scheduled", "cancelled")], []),
    ({}, {"status": "live", "venue": "v2", "commission": None}, [("event_status_changed", "scheduled", "live"), ("venue_changed", "v", "v2")], []),
    ({"commission": None}, {}, [("commission_changed", None, "c")], []),
    ({"deferred": True}, {"event_date": dt.date(2026, 12, 1), "venue": "v2", "status": "cancelled"}, [], ["event_date: 2026-11-07 or 2026-12-01", "status: scheduled or cancelled", "venue: v or v2"]),
    ({"deferred": True, "venue": None}, {}, [], []),
]


def test_events(spark):
    base = {"event_date": DAY, "start_at": None, "status": "scheduled", "venue": "v", "commission": "c", "deferred": False}
    docs = spark.createDataFrame([{"event_id": f"{i}", **base, **d} for i, (_, d, *_) in enumerate(EVENTS)], EVENT).drop("deferred")
    state = spark.createDataFrame([{"event_id": f"{i}", **base, **s} for i, (s, *_) in enumerate(EVENTS) if s is not None], EVENT)
    changes, odd = (x.collect() for x in cd.event_changes(docs, state))
    for i, (_, _, want, reasons) in enumerate(EVENTS):
        assert sorted([(r.type, r.before, r.after) for r in changes if r.event_id == f"{i}"], key=str) == sorted(want, key=str), i
        assert sorted(r.detail for r in odd if r.event_id == f"{i}") == reasons, i


def test_listings(spark):
    schema = "k int, a string, b string, rounds int, titles string, bout_order int"
    old = [(1, "Ann", "Bea", 10, None, 1), (1, "Cat", "Dot", 8, "x", 2), (1, "Eve", "Fay", 8, None, 3), (1, "Gia", "Hal", 6, None, 4)]
    new = [(1, "ANN", "Bea", 12, "y", 1), (1, "Cat", "Ida", 8, None, 2), (1, "Eve", "Fay", 8, None, 5), (1, "Jo", "Kim", 4, None, 6), (2, "New", "Card", 4, None, 1)]
    got = cd.listing_delta(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, "CHANGED_ROUNDS", "10", "12"), (1, "CHANGED_TITLE", None, "y"), (1, "CHANGED_OPPONENT", "Cat vs Dot", "Cat vs Ida"), (1, "CHANGED_CARD_POSITION", "3", "5"), (1, "NEW_BOUT", None, "Jo vs Kim"),
        (1, "REMOVED_BOUT", "Gia vs Hal", None), (2, "NEW_BOUT", None, "New vs Card"),
    ], key=str)


T = dt.datetime(2026, 10, 10, 2)
MATCHES = [  # home, away, hours after T, mapped, outcome, bout, home side
    ("D. Volk", "Bergson", 1, None, "both_corners_resolved", "b1", "b"),
    ("Dmitri Volk", "Emil Okon", 1, None, "no_bout_with_both_fighters", None, None),
    ("Dmitri Volk", "Jonas Bergson", 24 * 10, None, "no_candidate_bout_in_window", None, None),
    ("Dmitri Volk", "Jonas Bergson", 48, None, "both_corners_resolved", "b1", "b"),
    ("Nobody Here", "None At All", 1, None, "participants_not_found", None, None),
    ("Dmitri Volk", "D. Volk", 1, None, "no_bout_with_both_fighters", None, None),
    ("Dmitry Volk", "Jonas Bergson", 1, None, "no_bout_with_both_fighters", None, None),  # another first name never matches
    ("Dmitri Volk", "Jonas Bergson", 1, "b1", "existing_mapping", "b1", "b"),
    ("Dmitri Volk", "Aaron Stone", 1, "b1", "mapped_bout_participant_mismatch", None, None),
    ("Dmitri Volk", "Jonas Bergson", 1, "gone", "mapped_bout_not_schedulable", None, None),
    ("Dmitri Volk", "Jonas Bergson", None, None, "invalid_time", None, None),
    ("Rita Pohl", "Uma Quist", 1, None, "ambiguous_multiple_bouts", None, None),
]
BOUTS = [("b1", T, "Jonas Bergson", "Dmitri Volk"), ("b2", T, "Emil Okon", "Jose Nunes"), ("b3", T, "Rita Pohl", "Uma Quist"), ("b4", T + dt.timedelta(days=1), "Uma Quist", "Rita Pohl"), ("b0", None, "Jonas Bergson", "Dmitri Volk")]


def test_two_corners(spark):
    events = spark.createDataFrame([(f"{i:02d}", None if h is None else T + dt.timedelta(hours=h), m, a, b) for i, (a, b, h, m, *_) in enumerate(MATCHES)], "event string, at timestamp_ntz, mapped string, home_name string, away_name string")
    bouts = spark.createDataFrame(BOUTS, "bout_id string, starts_at timestamp_ntz, a_name string, b_name string")
    p = lambda c: nm.parsed(nm.romanised(F.col(c))).alias(c)
    met = events.select("event", p("home_name"), p("away_name")).join(bouts.select("bout_id", p("a_name"), p("b_name")))
    side = lambda name: cd.corner_of(F.col(name), F.col("a_name"), F.col("b_name"))
    corners = met.select("event", "bout_id", side("home_name").alias("home"), side("away_name").alias("away"))
    got = {r.event: tuple(r)[1:] for r in cd.two_corner_match(events.select("event", "at", "mapped"), bouts.select("bout_id", "starts_at"), corners).collect()}
    for i, (_, _, _, _, outcome, bout_id, home) in enumerate(MATCHES):
        assert got[f"{i:02d}"] == (bout_id, home, outcome), (MATCHES[i], got[f"{i:02d}"])


def test_empty(spark):
    docs, state = spark.createDataFrame([], DOC), spark.createDataFrame([], BOUT)
    assert all(x.count() == 0 for x in cd.bout_changes(docs, state))
    with pytest.raises(Exception):
        cd.bout_changes(docs.drop("a"), state)


def test_cards_are_shuffled_once_for_all_stages(spark):
    docs = spark.createDataFrame([(1, 1, "x1", "a", "b"), (1, 2, "x9", "c", "d"), (1, 3, None, "d", "c"), (1, 4, None, "d", "c"), (1, 5, "x1", "q", "r"), (2, 1, None, "a", "b"), (None, 1, "x1", "a", "b"), (None, 2, None, "c", "d")], "event_id long, n int, external_id string, a string, b string")
    bouts = spark.createDataFrame([(1, "1-1", "x1", "b", "a"), (1, "1-2", None, "c", "d"), (1, "1-3", "x3", "c", "d"), (1, "1-4", "x1", "z", "y"), (2, "2-1", None, "a", None), (None, "n-1", "x1", "a", "b"), (None, "n-2", None, "c", "d")], "event_id long, bout_id string, external_id string, a string, b string")
    found = cd.matched(docs, bouts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "1-1", "external_id"), (1, 2, "1-2", "pair"), (1, 3, "1-3", "pair"), (1, 5, "1-1", "external_id")]


def test_corners_of_like_syllables_against_the_sql(spark, tmp_path):
    """Customers 6325 and 2945 are nils vlayeltso and rafael vlacziczi, surnames of one skeleton, and the event has a surname alone."""
    import duckdb

    from tessera.plans import catalog

    catalog.load_all()
    duck = duckdb.connect()
    on = [(61533, 6325, "2000-11-04"), (61534, 2945, "1999-01-31")]
    orders = ", ".join(f"({o}::BIGINT, {k}::BIGINT, TIMESTAMP '{d}')" for o, k, d in on)
    rows = {"customer": "SELECT k AS c_custkey, 3 AS c_nationkey FROM (VALUES (6325::BIGINT), (2945)) t(k)", "orders": f"SELECT * FROM (VALUES {orders}) t(o_orderkey, o_custkey, o_orderdate)"}
    for name, sql in rows.items():
        duck.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    want = duck.execute(catalog.SQL["two_corner_matches"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["two_corner_matches"](spark, str(tmp_path)).collect()] == want and len(want) == 1


def test_cards_stay_where_their_lines_lie(spark, tmp_path):
    """Lines are shuffled for documents and for bouts; what is made of them meets without another shuffle, and orders are the only other rows."""
    from tessera.plans import catalog

    catalog.load_all()
    found = catalog.QUERIES["card_changes"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange hashpartitioning") <= 4


def test_sides_that_lie_together_change_nothing(spark):
    docs = spark.createDataFrame([{**doc(n, *c), "event_id": f"e{n % 3}", "external_id": x} for n, (c, x) in enumerate([(("x", "y"), "b1"), (("p", "q"), None), (("q", "p"), None), (("new", "one"), "z"), (("x", "z"), "b1"), (("p", "r"), None)] * 4)], DOC)
    state = spark.createDataFrame([{**bout(f"B{n}", *c), "event_id": f"e{n % 3}", "external_id": x} for n, (c, x) in enumerate([(("x", "y"), "b1"), (("p", "q"), "b2"), (("q", "p"), None), (("x", "w"), None)] * 3)], BOUT)
    want = [sorted(map(str, f.collect())) for f in cd.bout_changes(docs, state)]
    got = [sorted(map(str, f.collect())) for f in cd.bout_changes(docs.repartition(5, "event_id"), state.repartition(5, "event_id"), lying=True)]
    assert got == want and all(want)
