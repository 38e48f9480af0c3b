from pyspark.sql import functions as F

from tessera.operators import ringside as rg

ROUNDS = "array<struct<round:int,a:int,b:int,deduction:boolean>>"


def test_cards(spark):
    good = [(1, 10, 9, None), (2, 9, 10, None), (3, 10, 10, None)]
    cases = [
        (good, 29, 29, 3, None, []), (good, 29, 29, None, None, []), (good, 28, 29, 3, None, ["totals"]), (good, None, None, 3, None, []), (None, 29, 28, 3, None, []), ([], 29, 28, 3, None, []),
        (good, 29, 29, 12, None, ["round_count"]), (good, 29, 29, 12, 3, []), ([*good[:2], (2, 10, 10, None)], 29, 29, 3, None, ["duplicate_round"]), ([*good[:2], (4, 10, 10, None)], 29, 29, 3, None, ["beyond_scheduled"]),
        ([*good[:2], (0, 10, 10, None)], 29, 29, 3, None, ["invalid_round"]), ([*good[:2], (3, 11, 10, None)], 30, 29, 3, None, ["points_out_of_range"]), ([*good[:2], (3, 10, None, None)], 29, None, 3, None, ["points_out_of_range"]),
        ([*good[:2], (3, 9, 9, None)], 28, 28, 3, None, ["no_ten"]), ([*good[:2], (3, 9, 9, True)], 28, 28, 3, None, []),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], f"i int, r {ROUNDS}, a int, b int, s int, t int")
    got = {r.i: r.p for r in df.select("i", rg.card_problems(*[F.col(c) for c in "rabst"]).alias("p")).collect()}
    assert got == {i: c[5] for i, c in enumerate(cases)}


def test_results_against_cards(spark):
    results = [("a", "win", "a", "DECISION", "split"), ("b", "win", "b", "DECISION", "unanimous"), ("c", "win", "a", "KO", None), ("d", "draw", None, "TECHNICAL_DECISION", None), ("e", "win", None, "DECISION", None), ("f", "win", "a", "DECISION", None)]
    cards = [("a", 115, 113), ("a", 113, 115), ("a", 116, 112), ("b", 115, 113), ("b", 115, 113), ("b", 115, 113), ("c", 1, 9), ("d", 40, 38), ("e", 40, None), ("e", 40, 38)]
    df = rg.result_problems(spark.createDataFrame(results, "k string, outcome string, winner_side string, method string, decision_type string"), spark.createDataFrame(cards, "k string, a_total int, b_total int"), "k")
    assert {r.k: r.problems for r in df.collect()} == {"a": [], "b": ["winner_side"], "c": [], "d": ["outcome"], "e": ["cards_incomplete"], "f": []}


def test_weights(spark):
    rows = [("147.5", "lb", 147.5), ("66.7", "kg", 147.05), ("10st 7lb", "stone_lb", 147.0), ("10 stone", "stone_lb", 140.0), (" 10 St 7.5 lbs", "stone_lb", 147.5), ("ten", "lb", None), ("10", "stone_lb", None), ("10", "oz", None), (None, "kg", None)]
    df = spark.createDataFrame(rows, "v string, u string, want double").withColumn("lb", rg.pounds(F.col("v"), F.col("u")))
    assert [r.lb for r in df.collect()] == [w for *_, w in rows]
    status, miss = rg.weighed(F.col("o"), F.col("c"))
    got = spark.createDataFrame([(147.2, 147.0), (147.0, 147.0), (146.0, 147.0), (None, 147.0), (147.0, None)], "o double, c double").select(status.alias("s"), miss.alias("m"), rg.catchweight(F.col("c"), F.lit(147.0)).alias("k")).collect()
    assert [tuple(r) for r in got] == [("missed_weight", 0.2, False), ("made_weight", 0.0, False), ("made_weight", 0.0, False), ("recorded", None, False), ("recorded", None, None)]
    news = spark.createDataFrame([("official", "verified", "missed_weight"), ("official", "reported", "missed_weight"), ("ceremonial", "verified", "missed_weight"), (None, "verified", "made_weight"), ("official", None, "missed_weight")], "k string, v string, s string")
    assert [r[0] for r in news.select(rg.weigh_in_news(F.col("k"), F.col("v"), F.col("s"))).collect()] == ["WEIGHT_MISSED", "WEIGH_IN_RESULT", None, "WEIGH_IN_RESULT", None]


def test_records(spark):
    claims = spark.createDataFrame([("a", 3, 1, None), ("b", 4, 1, 0), ("c", 2, 1, 0), ("d", 1, 0, 0), ("e", 3, 1, 0)], "k string, wins int, losses int, draws int")
    ledger = spark.createDataFrame([("a", 3, 1, 2), ("b", 3, 1, 0), ("c", 3, 1, 0), ("e", 3, 1, 1)], "k string, wins int, losses int, draws int")
    assert {r.k: r.state for r in rg.record_check(claims, ledger, "k").collect()} == {"a": "agrees", "b": "ledger_short", "c": "conflict", "d": "no_ledger", "e": "conflict"}
