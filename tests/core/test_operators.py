import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions import columns as cl
from tessera.operators import flows, identity, market, metrics, reads, records, sequences, temporal
from tessera.sources import tables


def test_null_values_stand_and_change(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, 5), (1, 4, None)], "k int, t int, v int")
    assert [r.t for r in temporal.changes(df, ["k"], ["t"], ["v"]).orderBy("t").collect()] == [1, 3, 4]
    assert temporal.latest_per_key(df, ["k"], ["t"]).first() == (1, 4, None)


def test_buckets_change_nothing(spark):
    rows = [(i % 3, (i * 7) % 50, i, (i * i) % 4 if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    plain = lambda d: sorted(map(str, d.collect()))
    b = F.floor(F.col("t") / 10)
    order = ["t", "id"]
    assert plain(temporal.changes(df, ["k"], order, ["v"], b)) == plain(temporal.changes(df, ["k"], order, ["v"]))
    pick = ["k", "id", "island"]
    assert plain(sequences.islands(df, ["k"], order, "v", b).select(pick)) == plain(sequences.islands(df, ["k"], order, "v").select(pick))
    pick, counts = ["k", "id", "n", "m"], {"n": F.lit(True), "m": F.col("v") == 1}
    assert plain(sequences.entering(df, ["k"], order, counts, b).select(pick)) == plain(sequences.entering(df, ["k"], order, counts).select(pick))


def test_as_of_holds_all_clocks(spark):
    t = datetime
    df = spark.createDataFrame([(1, 1, t(2024, 1, 1), t(2024, 1, 5)), (1, 2, t(2024, 1, 2), t(2024, 2, 1))], "k int, rev int, valid timestamp_ntz, known timestamp_ntz")
    got = temporal.as_of(df, ["k"], {"valid": "2024-01-10 00:00:00", "known": "2024-01-10 00:00:00"}, ["rev"])
    assert [r.rev for r in got.collect()] == [1]


def test_reigns(spark):
    log = [(1, 1, "A"), (1, 2, "x"), (1, 3, "A"), (1, 4, "B"), (1, 5, "-"), (1, 6, "-"), (1, 7, "B")]
    df = spark.createDataFrame(log, "seat int, t int, e string")
    got = sequences.reigns(df, ["seat"], ["t"], "t", F.when(F.col("e").isin("A", "B"), F.col("e")), F.col("e") == "-").orderBy("started_at").collect()
    assert [(r.holder, r.started_at, r.ended_at) for r in got] == [("A", 1, 4), ("B", 4, 5), ("B", 7, None)]


def test_guards_and_rounding(spark):
    r = spark.range(1).select(cl.half_up(F.lit(-0.00005)).alias("h"), cl.ratio(F.lit(1), F.lit(0)).alias("z"), cl.status(F.lit(3), 5).alias("s"), cl.status(F.lit(9), 5, F.lit(False)).alias("u")).first()
    assert (r.h, r.z, r.s, r.u) == (0.0, None, "insufficient_sample", "source_unavailable")


def test_metric_without_sample_has_no_value(spark):
    wide = spark.createDataFrame([(1, 2, 4), (2, 0, 6)], "k int, a int, n int")
    got = {r.k: (r.status, r.value) for r in metrics.told(wide, ["k"], [metrics.Metric("m", cl.ratio(F.col("n"), F.col("a")), F.col("n"), 5)]).collect()}
    assert got == {1: ("insufficient_sample", None), 2: ("not_applicable", None)}


def test_majority_and_leave_one_out(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 6.0), (2, "a", 1.0), (2, "b", None), (3, None, 4.0)], "p int, v string, x double")
    assert {r.p: r.majority for r in metrics.strict_majority(df, ["p"], "v").collect()} == {1: "a", 2: None}
    assert sorted((r.p, r.others_mean) for r in metrics.leave_one_out(df, ["p"], "x").filter("p = 1").collect()) == [(1, 1.5), (1, 3.5), (1, 4.0)]


def test_names(spark):
    df = spark.createDataFrame([("José  Ramírez Jr.",), ("O'Neil, Sean",), (None,), ("TBA",)], "n string")
    words = [r[0] for r in df.select(identity.tokens(identity.folded(F.col("n")))).collect()]
    assert words == [["jose", "ramirez"], ["o", "neil", "sean"], None, ["tba"]]
    names = ["José  Ramírez Jr.", "O'Neil, Sean", None, "TBA", "T.B.C.", "Opponent", "Opponent TBD", "to be announced", "Tba Jones", "Li", "Lee A", "x" * 121, "Zhilei"]
    q = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(identity.name_quality(F.col("n"))).collect()]
    assert q == ["ok", "ok", *["placeholder"] * 6, "ok", "short", "ok", "long", "ok"]
    pairs = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["a", "c", "b"], ["a", "b", "c"]), (["b"], ["a", "b"]), ([], ["a"])], "s array<string>, l array<string>")
    assert [r[0] for r in pairs.select(identity.contained(F.col("s"), F.col("l"))).collect()] == [True, False, False, False]


def test_similar_pairs_against_brute_force(spark):
    names = ["small ring", "small rings", "smal ring", "red widget", "red widgets", "blue anvil", "ring small", "", "x"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, t string")
    grams = {r.id: set(r.g) for r in df.select("id", identity.trigrams(F.col("t")).alias("g")).collect()}
    for least in (0.3, 0.6, 0.9, 1.0):
        want = {(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b] and round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) >= least}
        assert {(r.a, r.b) for r in identity.similar_pairs(df, "id", "t", least).collect()} == want


def test_one_candidate(spark):
    probes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p int, k string")
    entities = spark.createDataFrame([(10, "a"), (20, "b"), (21, "b")], "e int, k string")
    got = {r.p: (r.outcome, r.e) for r in identity.one_candidate(probes, entities, ["k"], "p", "e").collect()}
    assert got == {1: ("matched", 10), 2: ("ambiguous", None), 3: ("unmatched", None)}


def test_overlaps_and_bands(spark):
    t = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([(1, 1, t(1), t(9)), (1, 2, t(2), t(3)), (1, 3, t(5), t(6)), (1, 4, t(10), None), (1, 5, t(20), t(21))], "k int, id int, a timestamp_ntz, z timestamp_ntz")
    got = {(r.first_id, r.second_id) for r in temporal.overlapping(df, ["k"], "id", "a", "z").collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}


def test_json_is_quarantined(spark):
    df = spark.createDataFrame([('{"k": 1, "n": "x"}',), ('{"k": "no"}',), ("{",), (None,), ('{"n": "y"}',)], "j string")
    good, bad = tables.parsed_json(df, "j", "k BIGINT NOT NULL, n STRING")
    assert [r.parsed.k for r in good.collect()] == [1] and bad.count() == 4


def test_appends_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, h string")
    assert [tables.append_new(df, f"{tmp_path}/t", ["k", "h"]) for _ in range(2)] == [2, 0]


def test_page_is_clamped(spark):
    got = reads.page(spark.range(7).toDF("id"), [F.asc("id")], 1000, -5, most=3).collect()
    assert [r.id for r in got] == [0, 1, 2] and got[0].total == 7


def test_freshness(spark):
    now = datetime(2026, 1, 10, 12)
    h = lambda n: now + timedelta(hours=n)
    cases = [  # last seen, start, live, what it is
        (None, h(5), False, "unknown"), (h(-20), h(120), False, "stale"), (h(-11), h(120), False, "fresh"), (h(-20), h(240), False, "fresh"), (h(-37), h(240), False, "stale"),
        (h(-1), h(4), False, "fresh"), (h(-1), h(3), False, "stale"), (h(-0.4), h(2), False, "fresh"), (h(-1), h(0), False, "closed"), (h(-1), h(-1), False, "closed"),
        (h(-0.01), h(-1), True, "live"), (h(-0.1), h(-1), True, "stale"), (h(-30), None, False, "fresh"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, last timestamp_ntz, start timestamp_ntz, live boolean, want string")
    got = df.select("i", "want", market.freshness(F.col("last"), F.lit(now).cast("timestamp_ntz"), F.col("start"), F.col("live")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


def test_prices(spark):
    df = spark.createDataFrame([(150.0,), (-150.0,), (100.0,), (-100.0,), (50.0,), (150.5,), (None,)], "o double")
    got = df.select(market.decimal_from_american(F.col("o")), market.implied_from_american(F.col("o")), market.american_from_decimal(market.decimal_from_american(F.col("o")))).collect()
    assert [tuple(r) for r in got] == [(2.5, 0.4, 150), (1.666667, 0.6, -150), (2.0, 0.5, 100), (2.0, 0.5, 100), (None,) * 3, (None,) * 3, (None,) * 3]
    p = spark.createDataFrame([(0.6,), (0.25,), (0.5,), (0.0,), (1.0,)], "p double").select(market.american_from_probability(F.col("p"))).collect()
    assert [r[0] for r in p] == [-150, 300, -100, None, None]


def test_only_whole_markets_are_shared_out(spark):
    rows = [("a", 0.6), ("a", 0.5), ("b", 0.6), ("b", None), ("c", 0.6), ("c", 1.0), ("d", 0.6), ("e", 0.5), ("e", 0.0)]
    got = market.fair_shares(spark.createDataFrame(rows, "m string, p double"), ["m"], "p").collect()
    assert {(r.m, r.overround, r.share) for r in got} == {("a", 1.1, 0.54545455), ("a", 1.1, 0.45454545), ("b", None, None), ("c", None, None), ("d", None, None), ("e", None, None)}


def test_moves_are_differences_of_medians_over_common_sources(spark):
    t = lambda d: datetime(2026, 1, d)
    rows = [("m", 1, t(1), 0.50, True), ("m", 2, t(1), 0.40, True), ("m", 3, t(1), 0.60, True), ("m", 1, t(3), 0.56, True), ("m", 2, t(3), 0.60, True), ("m", 3, t(3), 0.61, True), ("m", 4, t(3), 0.90, True)]
    rows += [("m", 1, t(3), 0.99, False), ("n", 1, t(1), 0.1, True), ("n", 1, t(3), 0.9, True), ("o", 1, t(1), 0.5, True), ("o", 2, t(1), 0.5, True), ("o", 1, t(3), 0.53, True), ("o", 2, t(3), 0.53, True)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "m string, s int, at timestamp_ntz, v double, open boolean, id int")
    got = market.moved(df, ["m"], ["s"], "at", "id", "v", "2026-01-03 00:00:00", open_=F.col("open")).collect()
    assert [(r.m, r.sources, r.before, r.after, r.move, r.direction) for r in got] == [("m", 3, 0.5, 0.6, 0.1, "shortened")]


def test_decisions(spark):
    cases = [  # cards as a's lead, outcome, side, kind
        ([1], "win", "a", "referee"), ([0], "draw", None, "referee"), ([1, 1, 1], "win", "a", "unanimous"), ([-1, -1, 0], "win", "b", "majority"), ([1, 1, -1], "win", "a", "split"),
        ([0, 0, 0], "draw", None, "unanimous"), ([0, 0, 1], "draw", None, "majority"), ([1, -1, 0], "draw", None, "split"), ([1, -1], "draw", None, "split"), ([1, 1, None], None, None, None),
    ]
    rows = [(i, v) for i, (cards, *_) in enumerate(cases) for v in cards]
    v = F.col("v")
    j = spark.createDataFrame(rows, "i int, v int").groupBy("i").agg(F.count("*").alias("n"), F.count_if(v > 0).alias("a"), F.count_if(v < 0).alias("b"), F.count_if(v.isNull()).alias("missing"))
    got = j.select("i", *records.decision(*map(F.col, ("n", "a", "b", "missing")))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(c[1:]) for c in cases]


def test_unification(spark):
    rows = [("all", b, "x", 1) for b in "1234"] + [("two", "1", "x", 1), ("two", "2", "x", 5), ("two", "3", "y", 1), ("two", "4", None, 1)]
    rows += [("old", "1", "x", 1), ("old", "2", "y", 92), ("old", "3", "z", 2), ("old", "4", "w", 3), ("none", "1", "x", 200), ("none", "2", "y", 290), ("none", "3", "z", 201), ("none", "4", None, 203), ("few", "1", "x", 1)]
    got = records.unified(spark.createDataFrame(rows, "s string, b string, h string, age int"), ["s"], "b", "h", "age", 4, 90).collect()
    assert {r.s: (r.state, r.complete, r.holder) for r in got} == {"all": ("undisputed", True, "x"), "two": ("unified", True, None), "old": ("incomplete", False, None), "none": ("none", True, None), "few": ("incomplete", False, None)}


def test_own_vote_is_not_in_the_majority(spark):
    rows = [("p", "a"), ("p", "a"), ("p", "b"), ("q", "a"), ("q", "b"), ("r", "a"), ("r", "a"), ("r", "a"), ("r", "b"), ("r", None)]
    got = metrics.against_others(spark.createDataFrame(rows, "k string, v string"), ["k"], "v").collect()
    assert {(r.k, r.v): (r.members, r.comparable, r.different) for r in got} == {("p", "a"): (2, 0, 0), ("p", "b"): (1, 1, 1), ("q", "a"): (1, 0, 0), ("q", "b"): (1, 0, 0), ("r", "a"): (3, 3, 0), ("r", "b"): (1, 1, 1)}


def test_cadence(spark):
    df = spark.createDataFrame([(m,) for m in (-121, -120, 180, 181, 1440, 1441, 10080, 10081)], "m int")
    assert [r[0] for r in df.select(flows.cadence(F.col("m"))).collect()] == [360, 15, 15, 30, 30, 120, 120, 360]


def test_edit_pairs_are_complete(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(1)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(90)}
    for d in (1, 2, 4):
        got = {(r.a, r.b, r.distance) for r in identity.edit_pairs(spark.createDataFrame([(w,) for w in words] + [(None,)], "w string"), "w", d).collect()}
        assert got == {(a, b, n) for a in words for b in words if a < b and (n := distance(a, b)) <= d}


def test_candidates_of_similar_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"word{i} other{i % 7} third{i % 3}") for i in range(50)], "id int, t string")
    plan = identity.similar_pairs(df, "id", "t", 0.6)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("SortMergeJoin")] if "SortMergeJoin" in plan else plan[: plan.index("HashJoin")]
    assert "Exchange" not in top and "Aggregate" not in top


def test_pieces_of_texts_are_not_gathered_before_they_meet(spark):
    df = spark.createDataFrame([(f"title number {i} of many",) for i in range(50)], "w string")
    plan = identity.edit_pairs(df, "w", 4)._jdf.queryExecution().executedPlan().toString()
    assert "piece#" in plan and not re.search(r"HashAggregate\(keys=\[[^\]]*piece", plan)


def test_similar_pairs_ask_bitmaps_before_trigrams(spark):
    """Every pair of random titles is found, and trigrams are compared only where sizes, places and bitmaps leave it possible."""
    import random

    rnd = random.Random(5)
    words = ["ring", "hot bolt", "ande", "the", "thon", "ereste", "onan", "hathe", "stonen", "a"]
    texts = sorted({" ".join(rnd.choices(words, k=rnd.randrange(1, 14))) for _ in range(160)})
    grams = {t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)} for t in texts}
    want = {(a, b): round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) for a in texts for b in texts if a < b and round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) >= 0.6}
    found = identity.similar_pairs(spark.createDataFrame([(t, t) for t in texts], "id string, text string"), "id", "text", 0.6)
    assert {(r.a, r.b): r.similarity for r in found.collect()} == want and len(want) > 100
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner") :].split("\n")[0]
    assert "bit_count" in joined and joined.index("bit_count") < joined.index("array_intersect")
