import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators import history as hs

FACTS = "id long, k string, holds timestamp_ntz, known date, win int"
PROBES = "probe long, k string, before timestamp_ntz, cutoff date"
START = dt.datetime(2020, 1, 1)


def made(seed, facts, probes, keys, days):
    rnd = random.Random(seed)
    at = lambda: START + dt.timedelta(days=rnd.randrange(days))
    f = []
    for i in range(facts):
        holds = at()
        f.append((i, rnd.choice(keys), rnd.choice([holds] * 9 + [None]), rnd.choice([(holds + dt.timedelta(days=rnd.randrange(-3, 40))).date()] * 9 + [None]), rnd.randrange(2)))
    return f, [(i, rnd.choice(keys), rnd.choice([at()] * 9 + [None]), rnd.choice([at().date()] * 9 + [None])) for i in range(probes)]


def brute(f, p):
    out = {}
    for probe, k, before, cutoff in p:
        seen = [x for x in f if x[1] == k and None not in (before, cutoff, x[2], x[3]) and x[2] < before and x[3] <= cutoff]
        last = max(seen, key=lambda x: (x[2], x[0]), default=None)
        out[probe] = (len(seen), sum(x[4] for x in seen), last and last[0], last and last[4])
    return out


def found(spark, f, p, bucket):
    facts, probes = spark.createDataFrame(f, FACTS), spark.createDataFrame(p, PROBES)
    args = (facts, probes, ["k"], "holds", hs.day_number(F.col("known")), "before", hs.day_number(F.col("cutoff")))
    sums = hs.totals_as_of(*args, {"n": F.lit(1), "wins": F.col("win")}, bucket)
    last = hs.last_as_of(*args, {"id": "last_id", "win": "last_win"}, "id", bucket)
    got = {r.probe: (r.n, r.wins, r.last_id, r.last_win) for r in sums.join(last.select("probe", "last_id", "last_win"), "probe").collect()}
    assert len(got) == sums.count() == len(p) and sums.columns == ["probe", "k", "before", "cutoff", "n", "wins"]
    return got


def test_against_brute_force(spark):
    for seed, days in ((1, 90), (2, 700), (3, 4)):
        f, p = made(seed, 300, 150, ["a", "a", "a", "b", "c"], days)
        want = brute(f, p)
        assert found(spark, f, p, None) == want
        assert found(spark, f, p, F.trunc(F.col("__at"), "month")) == want


def test_no_facts_no_probes_and_one_day(spark):
    f, p = made(4, 20, 10, ["a", "b"], 1)
    assert found(spark, f, p, None) == brute(f, p)
    assert set(found(spark, [], p, None).values()) == {(0, 0, None, None)}
    assert found(spark, f, [], None) == {}


def test_what_is_known_later_is_not_seen(spark):
    day = lambda n: START + dt.timedelta(days=n)
    f = [(1, "a", day(0), day(50).date(), 1), (2, "a", day(10), day(11).date(), 0), (3, "a", day(20), day(20).date(), 1)]
    p = [(1, "a", day(30), day(30).date()), (2, "a", day(30), day(50).date()), (3, "a", day(20), day(50).date()), (4, "a", day(10), day(49).date())]
    assert found(spark, f, p, None) == {1: (2, 1, 3, 1), 2: (3, 2, 3, 1), 3: (2, 1, 2, 0), 4: (0, 0, None, None)}


def test_probes_and_facts_never_pair(spark):
    rows = spark.range(100_000)
    facts = rows.select(F.col("id"), F.lit("hot").alias("k"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 7 % 1000).cast("int"))).alias("holds"), F.date_add(F.lit("2020-01-01"), (F.col("id") * 11 % 1000).cast("int")).alias("known"))
    probes = rows.select(F.col("id").alias("probe"), F.lit("hot").alias("k"), (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") * 3 % 1000).cast("int"))).alias("before"), F.date_add(F.lit("2020-01-01"), (F.col("id") * 13 % 1000).cast("int")).alias("cutoff"))
    got = hs.totals_as_of(facts, probes, ["k"], "holds", hs.day_number(F.col("known")), "before", hs.day_number(F.col("cutoff")), {"n": F.lit(1)}, F.trunc("__at", "month"))
    # facts of (days held, days known) are equally many: 100 of each (7 i mod 1000, 11 i mod 1000)
    days = [(i * 7 % 1000, i * 11 % 1000) for i in range(1000)]
    for r in got.filter("probe % 9973 = 1").collect():
        b, c = r.probe * 3 % 1000, r.probe * 13 % 1000
        assert r.n == 100 * sum(x < b and y <= c for x, y in days)
    assert got.count() == 100_000


def test_quality_of_a_record(spark):
    rows = [(3, 1, 0, 4), (0, 0, 0, 0), (20, 10, 10, 45), (0, 0, 0, 2), (None, None, None, None)]
    got = spark.createDataFrame(rows, "w int, l int, d int, n int").select(hs.entering_quality(*[F.col(c) for c in "wldn"]).alias("q")).collect()
    assert [None if r.q is None else round(r.q, 6) for r in got] == [round(0.375 + 4 / 60, 6), 0.0, 0.75, round(2 / 60, 6), None]


def test_keys_beyond_the_limit_are_dealt_out(spark, monkeypatch):
    f, p = made(5, 300, 150, ["a", "a", "a", "b", "c"], 200)
    monkeypatch.setattr(hs, "LARGE", 120)
    monkeypatch.setattr(hs, "ROWS_A_TASK", 50)
    assert found(spark, f, p, None) == found(spark, f, p, F.trunc(F.col("__at"), "month")) == brute(f, p)


def test_rows_are_shuffled_before_they_are_multiplied(spark):
    f, p = made(6, 300, 150, ["a", "b", "c"], 200)
    facts, probes = spark.createDataFrame(f, FACTS), spark.createDataFrame(p, PROBES)
    both = hs.totals_as_of(facts, probes, ["k"], "holds", hs.day_number(F.col("known")), "before", hs.day_number(F.col("cutoff")), {"n": F.lit(1)}, F.trunc("__at", "month"))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate explode")  # the exchange lies below
